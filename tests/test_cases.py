"""Hand-made cases: calendars, bounds, missing values, ties, invariants, texts, streams."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sylvaframe.functions import calendar as C
from sylvaframe.functions import science as S
from sylvaframe.functions import sketch
from sylvaframe.operators import design as X
from sylvaframe.operators import downscale as D
from sylvaframe.operators import ensemble as E
from sylvaframe.operators import forcing as G
from sylvaframe.operators import joins as J
from sylvaframe.operators import metrics as M
from sylvaframe.operators import reduce as A
from sylvaframe.operators import select as K
from sylvaframe.operators import slices as L
from sylvaframe.schema import Kind, nan_to_null
from sylvaframe.sources import catalog, readers, store, writers
from sylvaframe.streaming import jobs


def series(spark, rows):
    return spark.createDataFrame([(f, v, dt.datetime.fromisoformat(t), x) for f, v, t, x in rows], "fid INT, variable STRING, ts TIMESTAMP_NTZ, value DOUBLE")


def one(df):
    return [tuple(r) for r in df.collect()]


def test_noleap_around_leap_days_and_before_year_one(spark):
    at = lambda doy: (doy - 1) * 86400
    df = spark.createDataFrame([(0,), (at(59),), (at(60),), (at(365) + 86399,), (365 * 86400,), (-1,)], "s LONG")
    p = C.noleap_parts(F.col("s"))
    assert one(df.select(p["year"], p["month"], p["day"], p["hour"], p["second"])) == [(0, 1, 1, 0, 0), (0, 2, 28, 0, 0), (0, 3, 1, 0, 0), (0, 12, 31, 23, 59), (1, 1, 1, 0, 0), (-1, 12, 31, 23, 59)]
    fine, year = C.decode_model_time(F.col("s"), 2000, True)
    assert one(df.limit(3).select(fine))[-1] == (dt.datetime(2000, 3, 1),)  # 29 February 2000 is skipped
    assert one(df.select(C.decode_model_time(F.col("s"), 0, True)[0].isNull(), C.decode_model_time(F.col("s"), 0, True)[1]))[0] == (True, 0)


def test_time_units(spark):
    df = spark.createDataFrame([("seconds since 1901-1-1 0:0:0",), ("seconds since 2000-02-29 12:30",)], "u STRING")
    assert one(df.select(C.parse_time_unit(F.col("u")))) == [(dt.datetime(1901, 1, 1),), (dt.datetime(2000, 2, 29, 12, 30),)]
    with pytest.raises(Exception, match="unknown time unit"):
        spark.createDataFrame([("days since 1901-01-01",)], "u STRING").select(C.parse_time_unit(F.col("u"))).collect()


def test_first_step_and_snapping(spark):
    df = spark.createDataFrame([(1, 1800), (1, 3600), (2, 0), (2, 1800)], "fid INT, offset LONG")
    assert sorted(one(C.fix_first_step(df, ["fid"]))) == [(1, 0), (1, 1800), (2, 0), (2, 1800)]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 15),), (dt.datetime(2024, 1, 1, 0, 45),), (dt.datetime(2024, 1, 1, 23, 50),)], "ts TIMESTAMP_NTZ")
    assert one(t.select(C.snap_half_hour(F.col("ts")))) == [(0.0,), (1.0,), (24.0,)]  # ties to even


def test_bounds_are_half_open_unless_closed(spark):
    df = series(spark, [(1, "a", "2024-01-01", 1.0), (1, "a", "2024-01-02", 2.0)])
    assert L.slice_dates(df, "2024-01-01", "2024-01-02").count() == 1
    assert L.slice_dates(df, "2024-01-01", "2024-01-02", closed=True).count() == 2
    assert C.drop_leap_days(series(spark, [(1, "a", "2024-02-29", 1.0), (1, "a", "2023-02-28", 1.0)])).count() == 1


def test_missing_values_and_single_rows(spark):
    df = nan_to_null(series(spark, [(1, "a", "2024-01-01", float("nan")), (1, "a", "2024-01-01", 4.0), (2, "a", "2024-01-01", 1.0)]))
    got = {r.fid: r for r in A.reduce_time(df, Kind.DAILY_SERIES, ["fid"]).collect()}
    assert got[1].mean == 4.0 and got[2]["std"] is None and got[2].median == 1.0
    assert A.reduce_time(df.limit(0), Kind.DAILY_SERIES, ["fid"]).count() == 0
    j = spark.createDataFrame([(1, 2.0, 2.0)], "fid INT, m DOUBLE, o DOUBLE")
    assert one(M.efficiency(j, ["fid"])) == [(1, None, None)]


def test_unknown_runs_and_codes_are_errors(spark):
    df = series(spark, [(1, "a", "2024-01-01", 1.0)])
    assert L.select_runs(df, [1]).count() == 1
    with pytest.raises(Exception, match="unknown runs"):
        L.select_runs(df, [1, 9]).collect()
    with pytest.raises(Exception, match="unknown code"):
        J.map_codes(spark.createDataFrame([("XX",)], "PFT STRING"), J.PLANT_TYPES, "PFT", "n").collect()
    with pytest.raises(Exception, match="missing or repeated"):
        readers.read_sites(spark.createDataFrame([("A", 1.0), ("A", 2.0)], "site STRING, lat DOUBLE")).collect()


def test_evenly_spaced_ties(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(1, 7)], "fid INT, x DOUBLE")
    assert [r.fid for r in K.evenly_spaced(df, 3, "x").orderBy("fid").collect()] == [1, 4, 6]  # 3.5 goes to 4


def test_nearest_ties_and_rings(spark):
    grid = spark.createDataFrame([(0.0, 0.0, 1.0), (10.0, 0.0, 2.0)], "lon DOUBLE, lat DOUBLE, value DOUBLE")
    at = spark.createDataFrame([("p", 5.0, 3.0)], "site STRING, lon DOUBLE, lat DOUBLE")
    assert J.nearest_cell(at, grid).first().value == 1.0
    assert J.nearest_point(at, grid, "site").first().c_value == 1.0
    far = spark.createDataFrame([("q", 170.0, 80.0)], "site STRING, lon DOUBLE, lat DOUBLE")
    assert J.nearest_point(far, grid, "site").first().c_value == 2.0
    cells = spark.createDataFrame([(x, y, None if (x, y) in ((1, 1), (1, 0)) else float(10 * x + y)) for x in range(3) for y in range(3)], "ix INT, iy INT, value DOUBLE")
    assert J.nearest_valid_cell(spark.createDataFrame([("p", 1, 1)], "site STRING, ix INT, iy INT"), cells, "site").first().value == 12.0  # -lat is empty, +lat is next


def test_exact_quantiles_of_large_and_small_groups(spark, monkeypatch):
    import numpy as np

    from sylvaframe.operators import order

    rng = np.random.default_rng(0)
    groups = {"one": [4.0], "pair": [1.0, 2.0], "ties": [3.0] * 400 + [5.0] * 400, "wide": rng.normal(size=3000).tolist(), "steps": rng.integers(0, 9, 2500).astype(float).tolist(), "none": [None], None: [1.0, 5.0, 9.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k STRING, value DOUBLE")
    for accuracy in (10_000, 200):  # below: a group as it is; above: only what lies near a quantile
        monkeypatch.setattr(order, "ACCURACY", accuracy)
        got = {r.k: r for r in order.exact_quantiles(df, [0.0, 0.2, 0.5, 0.99, 1.0], ["k"]).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            if k == "none":
                assert got[k]["mean"] is None and set(got[k]["_q"]) == {None}
            else:
                assert np.allclose(got[k]["_q"], np.quantile(v, [0.0, 0.2, 0.5, 0.99, 1.0]), rtol=0, atol=1e-12) and math.isclose(got[k]["mean"], np.mean(v), abs_tol=1e-12)
        assert np.allclose(order.exact_quantiles(df.filter("k = 'wide'"), [0.3], []).first()["_q"], np.quantile(groups["wide"], 0.3))


def test_ranks_and_positions_over_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.integers(0, 300, 2000)]
    df = spark.createDataFrame([(i, x, -x * (i % 3)) for i, x in enumerate(values)], "fid INT, a DOUBLE, b DOUBLE")
    rank = lambda v: [sum(y < x for y in v) + (v.count(x) + 1) / 2 for x in v]
    want = np.corrcoef(rank(values), rank([-x * (i % 3) for i, x in enumerate(values)]))[0, 1]
    assert math.isclose(K.spearman_matrix(df, ["a", "b"]).first().r, want, abs_tol=1e-12)
    picked = sorted((r.position, r.fid) for r in K.evenly_spaced(df, 7, "a").collect())
    in_order = sorted(range(2000), key=lambda i: (values[i], i))
    assert picked == [(round(1 + i * 1999 / 6), in_order[round(1 + i * 1999 / 6) - 1]) for i in range(7)]


def test_nearest_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    cells = [(float(x), float(y), float(i)) for i, (x, y) in enumerate({(a, b) for a, b in rng.integers(-40, 40, (150, 2)).tolist()})]
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-180, 180, (80, 2)).tolist())]
    grid = spark.createDataFrame(cells, "lon DOUBLE, lat DOUBLE, value DOUBLE")
    points = spark.createDataFrame(at, "site INT, lon DOUBLE, lat DOUBLE")
    for tile_cells in (64, 5, 1):
        got = {r.site: (r.d2, r.c_lon, r.c_lat) for r in J.nearest_point(points, grid, "site", tile_cells).collect()}
        assert got == {s: min(((x - a) ** 2 + (y - b) ** 2, a, b) for a, b, _ in cells) for s, x, y in at}
    axis = {r.lon: r.g_lon for r in J.nearest_on_axis(points, grid, "lon").collect()}
    assert axis == {x: min((abs(a - x), a) for a, _, _ in cells)[1] for _, x, _ in at}


def test_importance_and_empty_columns(spark):
    rows = [(float(i % 17), float(i * 7 % 13), float(i % 17) * 3) for i in range(300)]
    got = K.feature_importance(spark.createDataFrame(rows, "signal DOUBLE, noise DOUBLE, y DOUBLE"), ["noise", "signal"], "y", trees=20).collect()
    assert [r.feature for r in got] == ["signal", "noise"] and got[0].importance > 0.9 and math.isclose(sum(r.importance for r in got), 1.0)
    df = spark.createDataFrame([(1, None, float("nan"), "x", None), (2, None, float("nan"), None, None)], "a INT, b STRING, c DOUBLE, d STRING, e DOUBLE")
    assert L.drop_empty_columns(df).columns == ["a", "d"]


def test_window_boundary_years_count_twice(spark):
    df = series(spark, [(1, "a", f"{y}-08-15", float(y)) for y in (2020, 2030, 2031)])
    got = {r.window: r.mean for r in A.window_means(df, 2020, 2030, 10, 10, 8, ["fid"]).collect()}
    assert got == {2020: 2025.0, 2030: 2030.5}


def test_monthly_means_are_conserved(spark):
    df = spark.createDataFrame([("c", 2000, m, float(v)) for m, v in enumerate([5, 9, 2, 8, 30, 1, 4, 4, 7, 3, 0, 6], 1)], "cell STRING, year INT, month INT, value DOUBLE")
    days = D.monthly_to_daily(df, ["cell"])
    assert days.count() == 365
    for a, b in zip(df.orderBy("month").collect(), days.groupBy("month").agg(F.avg("value").alias("v")).orderBy("month").collect()):
        assert math.isclose(a.value, b.v, abs_tol=1e-9)
    low = D.monthly_to_daily(df, ["cell"], low=0.0, high=31.0)
    assert low.agg(F.min("value"), F.max("value")).first()[0] >= 0


def test_polar_days(spark):
    df = spark.createDataFrame([(80.0, 172), (80.0, 355), (0.0, 80)], "lat DOUBLE, doy INT")
    a, b, c = [r[0] for r in df.select(S.day_length(F.col("lat"), F.col("doy"))).collect()]
    assert (a, b) == (24.0, 0.0) and abs(c - 12) < 0.2


def test_latin_hypercube_has_one_point_in_each_stratum(spark):
    out = X.latin_hypercube(spark.range(50), ["a", "b"], 3).collect()
    for d in ("a", "b"):
        assert sorted(int(r[d] * 50) for r in out) == list(range(50))
    assert X.soil_closure(spark.createDataFrame([(0.3, 0.4)], "silt DOUBLE, sand DOUBLE")).first().clay == pytest.approx(0.3)
    with pytest.raises(Exception, match="exceed 1"):
        X.soil_closure(spark.createDataFrame([(0.8, 0.4)], "silt DOUBLE, sand DOUBLE")).collect()


def test_merging_does_not_depend_on_the_split(spark):
    rows = [(i, float(i)) for i in range(10)]
    part = lambda x: spark.createDataFrame(x, "fid INT, value DOUBLE")
    whole = sorted(one(M.merge_partials([part(rows)], ["fid"])))
    assert whole == sorted(one(M.merge_partials([part(rows[:3]), part(rows[3:])], ["fid"])))


def test_ensemble_of_one_run_is_the_run(spark):
    df = series(spark, [(1, "a", f"2024-0{m}-0{k}", float(m * k)) for m in (1, 2) for k in (1, 2, 3)])
    a = {r.bucket: r.mean for r in E.multi_slice_avg(df, Kind.MONTHLY_AVG, ["variable"]).collect()}
    assert a == {r.bucket: r.mean for r in A.reduce_time(df, Kind.MONTHLY_AVG, ["fid", "variable"]).collect()}


def test_filling_years(spark):
    rows = [("s", 2000, d, 0.0, float(d)) for d in (1, 2)] + [("s", 2001, 1, 0.0, None), ("s", 2001, 2, 0.0, None)]
    got = G.fill_years(spark.createDataFrame(rows, "site STRING, year INT, doy INT, hour DOUBLE, lai DOUBLE"), "lai")
    assert [r.lai for r in got.orderBy("year", "doy").collect()] == [1.0, 2.0, 1.0, 2.0]


def test_namelists_and_type_tables(spark):
    text = "! top\n&veg_ctl\n  ! note\n  scheme=\"dyn!amic\" ! why\n  n=5\n flag=.TRUE.\n x = -1.5e-3\n/\nlost=1\n"
    df = spark.createDataFrame([(7, text), (8, "")], "fid INT, text STRING")
    assert sorted(one(readers.parse_namelists(df))) == [(7, "VEG_CTL", "flag", "bool", "true"), (7, "VEG_CTL", "n", "int", "5"), (7, "VEG_CTL", "scheme", "string", "dyn!amic"), (7, "VEG_CTL", "x", "float", "-1.5e-3")]
    good, bad = readers.parse_type_table(spark.createDataFrame([(1, "# c\nk 1 2 3\nshort 1\n")], "fid INT, text STRING"), 3)
    assert sorted(one(good)) == [(1, "k", 1, 1.0), (1, "k", 2, 2.0), (1, "k", 3, 3.0)] and bad.first().key == "short"


def test_text_files(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "forcing.dat").write_text("year doy hour\n-  -  h\n 2000 1   0.5\n2000 1 1.0\n")
    assert [(r.year, r.hour) for r in readers.read_forcing(spark, str(tmp_path / "7"), ["year", "doy", "hour"]).orderBy("hour").collect()] == [(2000.0, 0.5), (2000.0, 1.0)]
    assert readers.whole_texts(spark, str(tmp_path)).first().fid == 7
    (tmp_path / "sites.dat").write_text("Site-ID lon lat\nDE-Abc 10.4 51.1\nFR-Xyz 3.6 -9999\n")
    sites = readers.read_site_text(spark, str(tmp_path / "sites.dat")).select(F.col("Site-ID").alias("site"), F.col("lat").cast("double").alias("lat"))
    assert sorted(one(readers.read_sites(sites))) == [("DE-Abc", 51.1), ("FR-Xyz", None)]
    lines = writers.forcing_lines(spark.createDataFrame([("a", 2000, 1, 0.5)], "site STRING, year INT, doy INT, hour DOUBLE"), ["year", "hour"], ["-", "h"])
    assert [r.value for r in lines.orderBy("at").collect()] == ["year hour", "- h", "2000 0.5"]


def test_catalog_errors(spark):
    v = spark.createDataFrame([("gpp", "g", 1)], "variable STRING, unit STRING, ndim INT")
    assert catalog.list_variables(v, ["gpp"]).count() == 1
    with pytest.raises(Exception, match="unknown variable"):
        catalog.list_variables(v, ["nope"]).collect()


def test_nearest_point_where_cells_cluster(spark):
    """A dense knot, a far single cell, cells at one place, places without coordinates: no point looks at more than a few tiles."""
    import numpy as np

    rng = np.random.default_rng(4)
    knot = [(10 + float(x), 20 + float(y)) for x, y in rng.normal(0, 0.001, (400, 2))]
    places = [*knot, (-170.0, -80.0), (10.0, 20.0), (179.5, 0.0)]
    cells = [(x, y, float(i)) for i, (x, y) in enumerate(places)] + [(10.0, 20.0, -5.0), (None, 1.0, 0.0), (float("nan"), 1.0, 0.0)]
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-90, 90, (60, 2)))] + [(90 + i, *knot[i]) for i in range(9)] + [(200, None, 3.0)]
    grid = spark.createDataFrame(cells, "lon DOUBLE, lat DOUBLE, value DOUBLE")
    points = spark.createDataFrame(at, "site INT, lon DOUBLE, lat DOUBLE")
    got = {r.site: (r.d2, r.c_lon, r.c_lat) for r in J.nearest_point(points, grid, "site", 16).collect()}
    assert got == {s: min(((a - x) ** 2 + (b - y) ** 2, a, b) for a, b in places) for s, x, y in at if x is not None}
    assert J.nearest_point(points, grid.limit(0), "site").collect() == []
    assert {r.c_value for r in J.nearest_point(spark.createDataFrame([(1, 10.0, 20.0)], points.schema), grid, "site").collect()} == {-5.0}  # of one place, the smallest


def ring_search(valid, ix, iy, most):
    """The search as it is told: ring by ring, eight steps each, indices below 0 taken as 0."""
    if (ix, iy) in valid:
        return 0, valid[ix, iy]
    for r in range(1, most):
        for k, (dx, dy) in enumerate(J.RING):
            cell = max(ix + r * dx, 0), max(iy + r * dy, 0)
            if cell in valid:
                return (r - 1) * 8 + k + 1, valid[cell]
    return None, None


def test_nearest_valid_cell_however_far(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    wide = {(int(x), int(y)): float(x * 1000 + y) for x, y in zip(rng.integers(0, 130, 40), rng.integers(0, 90, 40))}
    for valid in (wide, {(0, 79): 1.0, (120, 0): 2.0, (60, 60): 3.0}, {(99, 3): 9.0}):
        cells = [(x, y, valid.get((x, y))) for x in range(0, 130, 1) for y in range(90) if (x, y) in valid or (x + y) % 11 == 0]
        at = [(i, int(x), int(y)) for i, (x, y) in enumerate(zip(rng.integers(0, 130, 150), rng.integers(0, 90, 150)))] + [(900, 5, 5), (901, 5, 5), (902, 0, 0)]
        got = J.nearest_valid_cell(spark.createDataFrame(at, "site INT, ix INT, iy INT"), spark.createDataFrame(cells, "ix INT, iy INT, value DOUBLE"), "site").collect()
        assert {r.site: (r.priority, r.value) for r in got} == {s: ring_search(valid, x, y, 140) for s, x, y in at}
        assert valid is wide or any(r.priority and r.priority > 36 * 8 for r in got)


def test_phosphorus_pools_search_each_map_by_itself(spark):
    cells = [("labile", 0, 0, 1.0), ("labile", 9, 9, 2.0), ("slow", 9, 0, 3.0), ("occluded", 5, 5, 4.0), ("occluded", 4, 4, float("nan")), ("other", 4, 4, 9.0)]
    at = spark.createDataFrame([("a", 4, 4), ("b", 9, 9), ("c", 9, 9)], "site STRING, ix INT, iy INT")
    got = {r.site: tuple(r)[1:] for r in G.p_pools(at, spark.createDataFrame(cells, "map STRING, ix INT, iy INT, value DOUBLE")).collect()}
    assert got == {"a": (1.0, 3.0, 4.0, None, 0.5), "b": (2.0, 3.0, 4.0, None, 0.5), "c": (2.0, 3.0, 4.0, None, 0.5)}


def test_scorecard_pairs_variables_with_their_own_series(spark):
    """Two sources by era, a window, magnitudes, factors; a pairing kept as a table; overlapping eras; nothing to compare."""
    model = series(spark, [(f, v, f"2024-01-{d:02d}", sign * (d + f)) for f in (1, 2) for v, sign in (("a", 1.0), ("b", -1.0), ("other", 1.0)) for d in range(1, 21)] + [(3, "a", "2025-01-01", 1.0)])
    obs = spark.createDataFrame([(s, dt.datetime(2024, 1, d), float(x * d)) for s, x in (("old", 1), ("new", 2), ("flow", 3)) for d in range(1, 21)], "source STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    eras = [("all", "2024-01-01", "2024-02-01"), ("first", "2024-01-01", "2024-01-11"), ("second", "2024-01-08", "2024-01-21")]
    pairings = [M.Pairing("a", "old", eras=("first",)), M.Pairing("a", "new", eras=("second", "all")), M.Pairing("b", "flow", "flow", begin="2024-01-05", until="2024-01-10", absolute=True, factors=(("", 1.0), ("_half", 0.5)))]
    want = {}
    for f in (1, 2):
        def put(metric, era, days, k, g):
            want[f, metric, era] = math.sqrt(sum((g(d) - k * d) ** 2 for d in days) / len(days))

        put("a_rmse", "first", range(1, 11), 1, lambda d: d + f)
        put("a_rmse", "second", range(8, 21), 2, lambda d: d + f)
        put("a_rmse", "all", range(1, 21), 2, lambda d: d + f)
        for suffix, half in (("", 1.0), ("_half", 0.5)):
            put(f"flow_rmse{suffix}", "first", range(5, 10), 3, lambda d: (d + f) * half)
            put(f"flow_rmse{suffix}", "all", range(5, 10), 3, lambda d: (d + f) * half)
            put(f"flow_rmse{suffix}", "second", range(8, 10), 3, lambda d: (d + f) * half)
    got = {(r.fid, r.metric, r.era): r.value for r in M.scorecard(model, obs, eras, pairings).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    table = spark.createDataFrame([(p.variable, p.source, p.metric, None if p.eras is None else list(p.eras), p.begin, p.until, p.absolute, [list(x) for x in ()] or [(a, b) for a, b in p.factors]) for p in pairings], "variable STRING, source STRING, metric STRING, eras ARRAY<STRING>, begin STRING, until STRING, absolute BOOLEAN, factors ARRAY<STRUCT<suffix: STRING, factor: DOUBLE>>")
    assert M.pairings_of(table) == pairings
    listed = M.per_run_list(model, obs, eras[1], pairings)
    assert listed.columns == ["fid", "a_rmse", "flow_rmse", "flow_rmse_half"] and [r.fid for r in listed.collect()] == [1, 2]
    assert M.scorecard(model, obs.limit(0), eras, pairings).count() == 0
    plan = M.score_columns(model, obs, eras, pairings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate") == 1  # one join, a row to its sources, no copy by era
    with pytest.raises(ValueError):
        M.scores_of(eras, [M.Pairing("a", "old"), M.Pairing("a", "new")])


def files_read(df):
    """(files, rows) that the scan of a collected plan has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_stored_model_is_pruned(spark, tmp_path):
    """One variable of all runs opens that variable's files only; one run or period of it, some of their row groups."""
    at = dt.datetime(2000, 1, 1)
    rows = spark.range(48_000).select((F.col("id") % 40).cast("int").alias("fid"), F.when(F.col("id") % 2 == 0, "transient").otherwise("static").alias("sim_type"), F.lit("daily").alias("time_res"), F.lit("VEG").alias("cat"), F.concat(F.lit("v"), F.floor(F.col("id") / 40) % 6).alias("variable"), F.lit(None).cast("int").alias("layer"), (F.lit(at).cast("timestamp_ntz") + F.make_dt_interval(F.floor(F.col("id") / 240).cast("int"))).alias("ts"), F.rand(3).alias("value"))
    path = str(tmp_path / "store")
    store.write_model(rows, path, rows_a_file=500)
    every = store.read_model(spark, path)
    assert sorted(every.columns) == sorted(rows.columns) and every.exceptAll(rows.select(every.columns)).count() == 0 == rows.select(every.columns).exceptAll(every).count()
    files, n = files_read(every)
    one = store.read_model(spark, path, ["v3"], "static")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "variable#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "sim_type#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    few, some = files_read(one)
    assert some == 4000 and few <= files / 12 + 1
    narrow = store.read_model(spark, path, ["v3"], "static", fids=[11, 13], begin="2000-02-01", until="2000-03-01")
    pushed = narrow._jdf.queryExecution().toString().split("PushedFilters: [")[1]
    assert "(ts" in pushed and "fid" in pushed
    _, read = files_read(narrow)
    assert narrow.count() == rows.filter("variable = 'v3' AND fid IN (11, 13) AND ts >= '2000-02-01' AND ts < '2000-03-01'").count() > 0
    assert read < some / 2  # other row groups were skipped by their statistics
    assert store.read_model(spark, path, []).count() == 0


def test_scenarios_have_labels_from_their_folders(spark, tmp_path):
    rows = spark.createDataFrame([(m, p, x) for x, (m, p) in enumerate((m, p) for m in ("b", "a", "c") for p in ("low", "high"))], "model STRING, pathway STRING, x INT")
    store.write_scenarios(rows, str(tmp_path / "s"), ["model", "pathway"])
    assert sorted(f.name for f in (tmp_path / "s").iterdir() if f.is_dir()) == ["a", "b", "c"]
    back = store.read_scenarios(spark, str(tmp_path / "s"), "x INT", ("model", "pathway"))
    assert sorted(map(tuple, back.select("model", "pathway", "x").collect())) == sorted(map(tuple, rows.collect()))
    got = E.scenario_stack(back, {"model": ["c", "b"], "pathway": ["low", "high"]}).orderBy("stack_order")
    assert [tuple(r) for r in got.select("model", "pathway", "stack_order").collect()] == [("c", "low", 0), ("c", "high", 1), ("b", "low", 2), ("b", "high", 3)]
    only = E.scenario_stack(back, {"model": ["a"]}).select("x")
    assert only._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and files_read(only)[1] == 2


def test_scenario_labels_cost_little_for_each_row(spark, tmp_path):
    """Labels come from the path of each row's file: no pattern is tried along it. A folder's rows are shared among tasks."""
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("a").alias("model"), F.lit("low").alias("pathway"), (F.xxhash64("id") % 1_000_000_007).alias("x"))
    with_small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB"}
    for k, v in with_small.items():
        spark.conf.set(k, v)
    try:
        store.write_scenarios(rows, str(tmp_path / "s"), ["model", "pathway"])
    finally:
        for k in with_small:
            spark.conf.unset(k)
    back = store.read_scenarios(spark, str(tmp_path / "s"), "x LONG", ("model", "pathway"))
    plan = E.scenario_stack(back, {"model": ["a"], "pathway": ["low"]})._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and back.filter("model = 'a' AND pathway = 'low'").count() == 200_000
    assert len(list((tmp_path / "s" / "a" / "low").glob("*.parquet"))) > 2


def test_hypercube_never_broadcasts_its_points(spark, tmp_path):
    """By the size of their file the points look small; the ranges, a row each, are what is sent to all tasks."""
    spark.range(1, 3001).write.parquet(str(tmp_path / "ids"))
    cube = X.latin_hypercube(spark.read.parquet(str(tmp_path / "ids")), ["a", "b"], 7)
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    for dim in "ab":
        assert sorted(math.floor(r[dim] * 3000) for r in cube.collect()) == list(range(3000))


def test_deposition_is_shared_among_tasks_by_sites(spark, tmp_path):
    from sylvaframe.plans import registry

    spark.range(1, 2501).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(dt.datetime(1995, m, 1), 100.0 * m) for m in range(1, 13)], "l_shipdate TIMESTAMP_NTZ, l_extendedprice DOUBLE").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = registry.queries()["g01_n_deposition"](spark, str(tmp_path))
    each = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 2500 * 365 and max(each) <= 1000 * 365


def test_monthly_deposition_is_assembled_like_its_days(spark):
    monthly = spark.createDataFrame([(s, f, y, m, s * y * m * 1e-9) for s in (1, 2) for f in ("historic", "rcp85") for y in (1995, 1996) for m in range(1, 13)], "site INT, family STRING, year INT, month INT, value DOUBLE")
    met = spark.createDataFrame([(s, 10.0, y, d, 0, 1.0) for s in (1, 2) for y in (1995, 1996) for d in (1, 31, 32, 59, 60, 365)], "site INT, lat DOUBLE, year INT, day INT, hour INT, wind_air DOUBLE")
    year = spark.createDataFrame([(1995, 1.0), (1996, 2.0)], "year INT, value DOUBLE")
    c14 = year.select("year", *[F.col("value").alias(c) for c in ("north", "tropics", "south")])
    p = spark.createDataFrame([(1, 0.1), (2, 0.2)], "site INT, p_srf_down DOUBLE")
    columns = ("year", "doy", "wind_air", "nhx_srf_down", "noy_srf_down", "p_srf_down")
    days, months = G.n_deposition(monthly, "rcp85"), G.monthly_deposition(monthly, "rcp85")
    want, got = (sorted(one(G.assemble(met, year, year, c14, n, n, p, columns))) for n in (days, months))
    assert len(got) == 24 and got == want


def test_sketches_are_merged_within_their_error(spark):
    """Over runs and buckets of very different sizes, with gaps; the error is measured in the rows themselves."""
    import numpy as np

    rng = np.random.default_rng(9)
    values = [(f, b, float(x)) for f in range(30) for b in range(4) for x in rng.gamma(f % 5 + 1, 2.0, int(rng.integers(1, 900)))]
    df = spark.createDataFrame(values + [(99, 0, None), (99, 0, float("nan")), (98, 9, None)], "fid INT, b INT, value DOUBLE")
    kept = sketch.sketched(df, ["fid", "b"])
    for keys in ([], ["b"], ["fid"]):
        twice = sketch.merged(sketch.merged(kept, [*keys, "fid"] if "fid" not in keys else keys), keys)
        q = [0.0, 0.05, 0.2, 0.5, 0.8, 0.95, 1.0]
        for r in sketch.quantiles(twice, q).collect():
            own = np.sort([x for f, b, x in values if ("b" not in keys or b == r.b) and ("fid" not in keys or f == r.fid)])
            assert r.n == len(own)
            for x in q:
                got = r[f"q{round(x * 100)}"]
                if not len(own):
                    assert got is None
                    continue
                below, upto = np.searchsorted(own, got, "left") / len(own), np.searchsorted(own, got, "right") / len(own)
                assert below - 2 * sketch.RANK_ERROR <= x <= upto + 2 * sketch.RANK_ERROR
    exact = {r.set: r for r in K.set_summary(df.withColumn("set", F.when(F.col("b") < 4, F.col("b"))).filter("NOT isnan(value)"), "value").collect()}
    near = {r.set: r for r in K.set_summary(df.withColumn("set", F.when(F.col("b") < 4, F.col("b"))), "value", approx=True).collect()}
    assert set(exact) == set(near) == {0, 1, 2, 3, None} and exact.pop(None).q50 is None and near[None].q50 is None and near[None].n == 1
    assert all(math.isclose(exact[k].mean, near[k].mean) and abs(exact[k].q50 - near[k].q50) < 0.2 for k in exact)
    band = E.ensemble_band(df.withColumn("ts", F.col("b")), ["ts"], approx=True).filter("ts < 4").collect()
    want = {r.ts: r for r in E.ensemble_band(df.withColumn("ts", F.col("b")), ["ts"]).collect()}
    assert all(abs(r.qlow - want[r.ts].qlow) < 0.3 and abs(r.qup - want[r.ts].qup) < 0.6 and r.n == want[r.ts].n for r in band)


def test_registered_importance_finds_what_matters(spark, tmp_path):
    """The registered query on tables in which the price is made of size and discount: both measures agree on the order, and the signs are right."""
    from sylvaframe.plans import registry

    n = 1200
    part = spark.range(n).select(F.col("id").alias("p_partkey"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("int").alias("p_size"), F.lit("b").alias("p_brand"))
    line = part.select(F.col("p_partkey").alias("l_partkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).withColumns({"l_discount": F.pmod(F.xxhash64("l_partkey", F.lit(1)), F.lit(100)) / 1000.0, "l_tax": F.pmod(F.xxhash64("l_partkey", F.lit(2)), F.lit(80)) / 1000.0, "l_quantity": F.pmod(F.xxhash64("l_partkey", "k"), F.lit(50)).cast("double")})
    price = part.withColumn("p_retailprice", 10.0 * F.col("p_size") - 1500.0 * F.pmod(F.xxhash64("p_partkey", F.lit(1)), F.lit(100)) / 1000.0)
    price.write.parquet(str(tmp_path / "part.parquet"))
    line.drop("k").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = registry.queries()["k11_feature_importance"](spark, str(tmp_path)).collect()
    assert [r.feature for r in rows][:2] == ["size", "disc"] and math.isclose(sum(r.importance for r in rows), 1.0)
    by = {r.feature: r for r in rows}
    assert sorted(by, key=lambda f: -by[f].permuted)[:2] == ["size", "disc"]
    assert by["size"].r > 0.5 and by["disc"].r < -0.1 and by["size"].permuted > 0.5
    assert all(abs(by[f].permuted) < 0.1 and abs(by[f].r) < 0.15 for f in ("tax", "qty_sd"))


def test_importance_reads_its_rows_once(spark):
    """The rows are made once, however many jobs need them; the cells' errors tell what matters."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.floor(F.col("id") / 20) % 2).cast("double").alias("b"), (3.0 * (F.col("id") % 20) + F.col("id") % 3).alias("y"))
    found = {r.feature: r for r in K.feature_importance(rows.mapInArrow(count, rows.schema), ["a", "b"], "y", trees=5).collect()}
    assert seen.value == 400
    assert found["a"].permuted > 1.0 and found["a"].r > 0.9 and found["a"].importance > 0.9
    assert abs(found["b"].permuted) < 0.1 and found["b"].importance < 0.1


def test_streams_equal_batches(spark, tmp_path):
    rows = series(spark, [(k % 2, "a", f"2024-01-{1 + k:02d} 00:10:00", float(k)) for k in range(20)])
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    key = lambda df: sorted(one(df))
    keys = ["fid", "variable", "bucket"]
    for k, unit in enumerate(("month", "year", "day", "week")):
        assert key(jobs.drain(jobs.stream_monitor(stream(), unit), keys, str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}"))) == key(jobs.stream_monitor(rows, unit))
        assert {r.bucket for r in jobs.stream_monitor(rows, unit).collect()} == {r.bucket for r in rows.select(F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("bucket")).collect()}
    again = jobs.drain(jobs.stream_monitor(stream()), keys, str(tmp_path / "o0"), str(tmp_path / "c0"))  # nothing new
    assert key(again) == key(jobs.stream_monitor(rows))
    assert len(list((tmp_path / "o0").iterdir())) > 2  # several batches


def test_each_run_is_judged_once(spark, tmp_path):
    """Runs with an end, a run that never ends, one that goes on after its timeout, a late file, a run without observations."""
    schema = "fid INT, variable STRING, ts TIMESTAMP_NTZ, value DOUBLE"
    obs = spark.createDataFrame([(dt.datetime(2024, m, d, h), 0.0) for m in (1, 2, 3, 4, 5) for d in range(1, 29) for h in (0, 12)], "bin TIMESTAMP_NTZ, o DOUBLE")
    ends = spark.createDataFrame([(1, dt.datetime(2024, 1, 20)), (2, dt.datetime(2024, 2, 10)), (4, dt.datetime(2024, 3, 20))], "fid INT, end TIMESTAMP_NTZ")

    def arrive(rows):
        series(spark, [(f, "a", t, x) for f, t, x in rows]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.to_files(jobs.stream_scores(stream, obs, 2.5, ends, "20 days", "2 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len({r.fid for r in found}) == len(found)  # one row for each run, ever
        return {r.fid: (r.n, round(r.rmse, 9), r.rejected, r.closed_by) for r in found}

    assert arrive([(1, "2024-01-10", 2.0), (2, "2024-01-10", 4.0), (3, "2024-01-10", 1.0), (4, "2024-01-11", 9.0), (5, "2024-01-11 05:00:00", 1.0)]) == {}
    # late, but the run is open: it counts; what comes after a run's end does not
    assert arrive([(1, "2024-01-18", 4.0), (1, "2024-01-12", 2.0), (1, "2024-01-21", 100.0), (3, "2024-01-21", 1.0)]) == {}
    first = {1: (3, round(math.sqrt((4 + 16 + 4) / 3), 9), True, "end")}
    assert arrive([(2, "2024-01-25", 2.0)]) == first
    # late for a run that has been judged
    assert arrive([(1, "2024-01-15", 50.0), (2, "2024-02-09", 0.0)]) == first | {4: (1, 9.0, True, "timeout")}  # silent for 20 days
    assert arrive([(2, "2024-02-15", 7.0), (4, "2024-02-14", 1.0), (3, "2024-02-26", 1.0)]) == first | {4: (1, 9.0, True, "timeout"), 2: (3, round(math.sqrt(20 / 3), 9), True, "end")}
    # the run that was closed by its timeout goes on until its end; the one without an end falls silent
    last = arrive([(4, "2024-03-19", 1.0), (3, "2024-04-20", 3.0), (2, "2024-05-20", 1.0)])
    assert last[3] == (4, round(math.sqrt(3), 9), False, "timeout") and last[4] == (1, 9.0, True, "timeout") and set(last) == {1, 2, 3, 4}
    every = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    batch = {r.fid: (r.n, round(r.rmse, 9), r.rejected) for r in jobs.stream_scores(every, obs, 2.5, ends).collect()}
    joined = every.withColumn("bin", F.col("ts")).join(obs, "bin").join(ends, "fid", "left").filter("end IS NULL OR ts <= end").select("fid", F.col("value").alias("m"), "o")
    assert {f: x[1:] for f, x in batch.items()} == {r.fid: (round(r.rmse, 9), r.rejected) for r in M.reject_runs(joined, 2.5).collect()}
    assert batch[2] == last[2][:3]


def test_snapshots_replace_batches(spark, tmp_path):
    """The result is the same with and without them, also where batches go on, are deleted, or are repeated."""
    rows = series(spark, [(k % 3, "a", f"2024-01-{1 + k:02d} 00:10:00", float(k)) for k in range(12)])
    out, keys = str(tmp_path / "out"), ["fid", "variable", "bucket"]

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        return sorted(one(jobs.drain(jobs.stream_monitor(stream), keys, out, str(tmp_path / "checkpoint"))))

    want = lambda n: sorted(one(jobs.stream_monitor(rows.filter(F.dayofmonth("ts") <= n))))
    assert arrive(rows.filter(F.dayofmonth("ts") <= 4)) == want(4)
    first = jobs.snapshot(spark, out, keys)
    assert sorted(one(jobs.current(spark, out, keys))) == want(4) and jobs.snapshot(spark, out, keys) == first
    assert arrive(rows.filter(F.dayofmonth("ts").between(5, 8))) == want(8)
    second = jobs.snapshot(spark, out, keys, forget=True)
    assert second > first and [f.name for f in (tmp_path / "out").glob("batch=*")] == ["batch=-1"] and len(list((tmp_path / "out-snapshots").glob("upto=*"))) == 1
    assert sorted(one(jobs.current(spark, out, keys))) == want(8)
    rows.limit(1).groupBy("fid", "variable").agg(F.lit(None).cast("timestamp").alias("bucket"), F.avg("value").alias("mean"), F.count("*").alias("n"), F.max(F.col("ts").cast("timestamp")).alias("latest")).write.parquet(f"{out}/batch={second}")  # as if repeated
    assert sorted(one(jobs.current(spark, out, keys))) == want(8)
    assert arrive(rows.filter(F.dayofmonth("ts") > 8)) == want(12)


def test_late_rows_are_left_out(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "fid INT, variable STRING, ts TIMESTAMP_NTZ, value DOUBLE"

    def arrive(rows):
        series(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        return {(r.fid, r.bucket.month): (r.n, r["mean"]) for r in jobs.drain(jobs.stream_monitor(stream, "month", 30), ["fid", "variable", "bucket"], str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()}

    arrive([(1, "a", "2024-01-10", 1.0), (1, "a", "2024-06-20", 5.0)])
    arrive([(1, "a", "2024-06-25", 7.0)])
    # January ended more than 30 days before the latest stamp, May did not
    got = arrive([(1, "a", "2024-01-11", 100.0), (2, "a", "2024-05-30", 3.0)])
    assert got == {(1, 1): (1, 1.0), (1, 6): (2, 6.0), (2, 5): (1, 3.0)}
