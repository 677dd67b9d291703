"""M, K: metrics and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sketch
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import select as K
from ..operators.reduce import bucket, resample_30min
from ..schema import Kind
from ..sources import testbed as T
from .book import Book, r_all
from .ensemble_queries import bins, obs_bins

book = Book()
add = book.add

JOINED = """bins AS (SELECT fid, variable, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM model GROUP BY 1, 2, 3),
obins AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM obs GROUP BY 1),
j AS (SELECT b.fid, b.variable, b.ts, b.value AS m, o.value AS o FROM bins b JOIN obins o USING (ts))"""
CORR = "(CASE WHEN isfinite(corr(m, o)) THEN corr(m, o) END)"  # one row has none
RMSE = "sqrt(avg((m - o) * (m - o)))"


def joined(s, d):
    return J.join_model_obs(bins(s, d), obs_bins(s, d), ["ts"])


KEYS = ["fid", "variable"]


@add("m01_rmse", f"WITH {JOINED} SELECT fid, variable, round(CAST({RMSE} AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse FROM j GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(joined(s, d).groupBy(*KEYS).agg(M.rmse().alias("rmse")))


@add("m02_rmse_abs", f"WITH {JOINED} SELECT fid, variable, round(CAST(sqrt(avg((abs(20 - m) - abs(o)) * (abs(20 - m) - abs(o)))) AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse FROM j GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(joined(s, d).withColumn("m", 20 - F.col("m")).groupBy(*KEYS).agg(M.rmse_abs().alias("rmse")))


@add("m03_rmse_by_flag", f"WITH {JOINED} SELECT j.fid, variable, round(CAST(sqrt(avg((CASE WHEN p.size / 50.0::DOUBLE > 0.5 THEN m ELSE -m END - o) * (CASE WHEN p.size / 50.0::DOUBLE > 0.5 THEN m ELSE -m END - o))) AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse FROM j JOIN params p ON p.fid = j.fid GROUP BY 1, 2", "model obs params")
def _(s, d):
    flags = T.params(s, d).select("fid", (F.col("size") / 50.0).alias("use_physics"))
    return r_all(J.attach_params(joined(s, d), flags).groupBy(*KEYS).agg(M.rmse_by_flag(F.col("use_physics") > 0.5).alias("rmse")))


@add("m04_rmse_norm", f"WITH {JOINED}, n AS (SELECT fid, variable, m / max(m) OVER w AS m, o / max(o) OVER w AS o FROM j WINDOW w AS (PARTITION BY fid, variable)) SELECT fid, variable, round(CAST({RMSE} AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse FROM n GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(M.normalized(joined(s, d), KEYS).groupBy(*KEYS).agg(M.rmse().alias("rmse")))


FACTORS = [("", 1.0), ("_05", 0.5), ("_025", 0.25), ("_2", 2.0)]
SCALED = " UNION ALL ".join(f"SELECT fid, variable, '{x}' AS suffix, round(CAST(sqrt(avg((m * {f} - o) * (m * {f} - o))) AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse FROM j GROUP BY 1, 2" for x, f in FACTORS)


@add("m05_rmse_scaled", f"WITH {JOINED} {SCALED}", "model obs")
def _(s, d):
    return r_all(M.rmse_scaled(joined(s, d), KEYS, FACTORS))


@add("m06_corr_r2", f"WITH {JOINED} SELECT fid, variable, round(CAST({CORR} AS DECIMAL(38, 9)), 6)::DOUBLE AS r, round(CAST({CORR} * {CORR} AS DECIMAL(38, 9)), 6)::DOUBLE AS r2 FROM j GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(joined(s, d).groupBy(*KEYS).agg(M.corr().alias("r"), (M.corr() * M.corr()).alias("r2")))


SPREAD = "d AS (SELECT *, avg({0}) OVER (PARTITION BY fid, variable) AS mean FROM j)"


@add("m07_nse", f"WITH {JOINED}, {SPREAD.format('o')} SELECT fid, variable, round(CAST(1 - sum((m - o) * (m - o)) / nullif(sum((o - mean) * (o - mean)), 0) AS DECIMAL(38, 9)), 6)::DOUBLE AS nse FROM d GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(M.efficiency(joined(s, d), KEYS).select(*KEYS, "nse"))


@add("m07_nse_reference_variant", f"WITH {JOINED}, {SPREAD.format('m')} SELECT fid, variable, round(CAST(1 - sum((m - o) * (m - o)) / nullif(sum((o - mean) * (o - mean)), 0) AS DECIMAL(38, 9)), 6)::DOUBLE AS nse FROM d GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(M.efficiency(joined(s, d), KEYS, "reference").select(*KEYS, "nse"))


@add("m08_rsr", f"WITH {JOINED}, {SPREAD.format('o')} SELECT fid, variable, round(CAST(sqrt(sum((m - o) * (m - o))) / nullif(sqrt(sum((o - mean) * (o - mean))), 0) AS DECIMAL(38, 9)), 6)::DOUBLE AS rsr FROM d GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(M.efficiency(joined(s, d), KEYS).select(*KEYS, "rsr"))


@add("m09_pbias", f"WITH {JOINED} SELECT fid, variable, round(CAST(100 * sum(m - o) / sum(o) AS DECIMAL(38, 9)), 6)::DOUBLE AS pbias FROM j GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(joined(s, d).groupBy(*KEYS).agg(M.pbias().alias("pbias")))


@add("m10_metric_table", f"""WITH {JOINED}, {SPREAD.format('o')}
SELECT fid, variable, round(CAST(round({RMSE}, 3) AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse, round(CAST(round({CORR} * {CORR}, 3) AS DECIMAL(38, 9)), 6)::DOUBLE AS r2, round(CAST(round(1 - sum((m - o) * (m - o)) / nullif(sum((o - mean) * (o - mean)), 0), 3) AS DECIMAL(38, 9)), 6)::DOUBLE AS nse,
  round(CAST(round(sqrt(sum((m - o) * (m - o))) / nullif(sqrt(sum((o - mean) * (o - mean))), 0), 3) AS DECIMAL(38, 9)), 6)::DOUBLE AS rsr, round(CAST(round(100 * sum(m - o) / sum(o), 3) AS DECIMAL(38, 9)), 6)::DOUBLE AS pbias FROM d GROUP BY 1, 2""", "model obs")
def _(s, d):
    return r_all(M.metric_table(joined(s, d), KEYS))


ERAS = [("full", "2024-01-01", "2024-02-01"), ("early", "2024-01-01", "2024-01-11"), ("mid", "2024-01-08", "2024-01-22"), ("late", "2024-01-20", "2024-02-01")]
#: Another source in later eras, magnitudes, a window of its own with factors: as a comparison of one site's variables needs them.
PAIRINGS = [
    M.Pairing("click", "flux_a", eras=("full", "early")),
    M.Pairing("click", "flux_b", eras=("mid", "late")),
    M.Pairing("purchase", "flux_b", absolute=True, factors=(("", -1.0),)),
    M.Pairing("signup", "sap", metric="flow", begin="2024-01-05", until="2024-01-25", factors=tuple((x, f) for x, f in FACTORS)),
    M.Pairing("click", "sap", metric="click_sap", until="2024-01-15"),
]
TARGETS = ", ".join(f"('{x.metric}', '{x.era}', '{x.pairing.variable}', '{x.pairing.source}', {x.factor}::DOUBLE, {str(x.pairing.absolute).lower()}, TIMESTAMP '{x.begin}', TIMESTAMP '{x.until}')" for x in M.scores_of(ERAS, PAIRINGS))
SCORECARD = f"""WITH bins AS (SELECT fid, variable, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM model GROUP BY 1, 2, 3),
obins AS (SELECT source, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM obs_sources GROUP BY 1, 2),
targets(metric, era, variable, source, factor, magnitude, a, b) AS (VALUES {TARGETS}),
errors AS (SELECT fid, metric, era, CASE WHEN magnitude THEN abs(m.value * factor) - abs(o.value) ELSE m.value * factor - o.value END AS e
  FROM bins m JOIN targets t USING (variable) JOIN obins o ON o.source = t.source AND o.ts = m.ts WHERE m.ts >= a AND m.ts < b),
card AS (SELECT fid, metric, era, sqrt(avg(e * e)) AS value FROM errors GROUP BY 1, 2, 3)"""


def source_bins(s, d):
    return resample_30min(T.obs_sources(s, d), ["source"]).withColumnRenamed("bin", "ts")


@add("m11_scorecard", f"{SCORECARD} SELECT fid, metric, era, round(CAST(value AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM card", "model obs_sources")
def _(s, d):
    return r_all(M.scorecard(bins(s, d), source_bins(s, d), ERAS, PAIRINGS))


@add("s16_score_table", f"{SCORECARD} SELECT fid, " + ", ".join(f"round(CAST(max(CASE WHEN metric = '{x.metric}' AND era = '{x.era}' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS {x.name}" for x in M.scores_of(ERAS, PAIRINGS)) + " FROM card GROUP BY fid", "model obs_sources")
def _(s, d):
    return r_all(M.score_columns(bins(s, d), source_bins(s, d), ERAS, PAIRINGS))


@add("s16_pivoted_scores", f"{SCORECARD} SELECT fid, " + ", ".join(f"round(CAST(max(CASE WHEN metric = '{v}' AND era = '{e[0]}' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS {v}_{e[0]}" for v in ("click_rmse", "flow_rmse_05") for e in ERAS) + " FROM card GROUP BY fid", "model obs_sources")
def _(s, d):
    card = M.scorecard(bins(s, d), source_bins(s, d), ERAS, PAIRINGS)
    return r_all(M.score_table(card, ["click_rmse", "flow_rmse_05"], [e[0] for e in ERAS]))


@add("m12_merge_partials", """
WITH parts AS (SELECT fid, disc AS value, 0 AS part FROM scores UNION ALL SELECT fid, CASE WHEN tax >= 0.04 THEN tax END, 1 FROM scores UNION ALL SELECT fid, CASE WHEN qty_sd < 14 THEN qty_sd END, 2 FROM scores)
SELECT fid, arg_max(value, part) AS value FROM parts WHERE value IS NOT NULL GROUP BY 1""", "scores")
def _(s, d):
    x = T.scores(s, d)
    # each part has a row for every run, some without a value
    parts = F.col("disc"), F.when(F.col("tax") < 0.04, float("nan")).otherwise(F.col("tax")), F.when(F.col("qty_sd") < 14, F.col("qty_sd"))
    return M.merge_partials([x.select("fid", c.alias("value")) for c in parts], ["fid"])


@add("m13_reject_runs", f"WITH {JOINED} SELECT fid, round(CAST({RMSE} AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse, {RMSE} > 75 AS rejected FROM j WHERE variable = 'click' GROUP BY 1", "model obs")
def _(s, d):
    return r_all(M.reject_runs(joined(s, d).filter("variable = 'click'"), 75.0))


@add("m14_daily_metric", """
WITH m AS (SELECT fid, variable, date_trunc('day', ts) AS day, avg(value) AS m FROM model GROUP BY 1, 2, 3), o AS (SELECT date_trunc('day', ts) AS day, avg(value) AS o FROM obs GROUP BY 1)
SELECT fid, variable, round(CAST(sqrt(avg((m - o) * (m - o))) AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse FROM m JOIN o USING (day) GROUP BY 1, 2""", "model obs")
def _(s, d):
    day = bucket(Kind.DAILY_SERIES, F.col("ts")).alias("day")
    m = T.model(s, d).groupBy("fid", "variable", day).agg(F.avg("value").alias("value"))
    o = T.obs(s, d).groupBy(day).agg(F.avg("value").alias("value"))
    return r_all(J.join_model_obs(m, o, ["day"]).groupBy(*KEYS).agg(M.rmse().alias("rmse")))


@add("m15_diurnal_pair", f"WITH {JOINED} SELECT variable, CAST(hour(ts) AS INTEGER) AS hour, round(CAST(avg(m) AS DECIMAL(38, 9)), 6)::DOUBLE AS m, round(CAST(avg(o) AS DECIMAL(38, 9)), 6)::DOUBLE AS o FROM j GROUP BY 1, 2", "model obs")
def _(s, d):
    return r_all(joined(s, d).groupBy("variable", F.hour("ts").alias("hour")).agg(F.avg("m").alias("m"), F.avg("o").alias("o")))


@add("m16_diff_runs", f"""WITH {JOINED}, a AS (SELECT ts, value AS m FROM bins WHERE fid = 1 AND variable = 'click'), b AS (SELECT ts, value AS o FROM bins WHERE fid = 2 AND variable = 'click')
SELECT round(CAST(min(m - o) AS DECIMAL(38, 9)), 6)::DOUBLE AS min_diff, round(CAST(max(m - o) AS DECIMAL(38, 9)), 6)::DOUBLE AS max_diff, CAST(sum(CASE WHEN m IS NULL OR o IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched,
  (SELECT min(ts) FROM a) = (SELECT min(ts) FROM b) AS same_first, (SELECT max(ts) FROM a) = (SELECT max(ts) FROM b) AS same_last FROM a FULL JOIN b USING (ts)""", "model obs")
def _(s, d):
    one = lambda k: bins(s, d).filter((F.col("variable") == "click") & (F.col("fid") == k)).select("ts", "value")
    return r_all(M.diff_runs(one(1), one(2), ["ts"]))


@add("m17_per_run_list", f"{SCORECARD} SELECT fid, " + ", ".join(f"round(CAST(max(CASE WHEN metric = '{x.metric}' AND era = 'mid' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS {x.metric}" for x in M.scores_of([ERAS[2]], PAIRINGS)) + " FROM card WHERE era = 'mid' GROUP BY fid", "model obs_sources")
def _(s, d):
    return r_all(M.per_run_list(bins(s, d), source_bins(s, d), ERAS[2], PAIRINGS))


# K: selection


@add("k01_rank_runs", f"WITH {JOINED} SELECT fid, round(CAST({RMSE} AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse, count(*) AS n FROM j WHERE variable = 'click' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1 ORDER BY 2, 1 LIMIT 5", "model obs")
def _(s, d):
    rows = M.scored_bins(T.model(s, d).filter("variable = 'click'"), T.obs(s, d).select("ts", "value"), "2024-01-01", "2024-01-21")
    return K.rank_runs(r_all(rows.groupBy("fid").agg(M.rmse().alias("rmse"), F.count("*").alias("n"))), "rmse", 5)


@add("k02_best_per_group", "WITH x AS (SELECT brand, fid, disc, row_number() OVER (PARTITION BY brand ORDER BY disc, fid) AS n FROM scores JOIN params USING (fid) WHERE tax <= 0.045) SELECT brand, fid, disc FROM x WHERE n = 1", "scores params")
def _(s, d):
    return K.best_per_group(J.attach_params(T.scores(s, d), T.params(s, d)), "brand", "disc", {"tax": 0.045})


@add("k03_evenly_spaced", """
WITH x AS (SELECT fid, disc, CAST(row_number() OVER (ORDER BY disc, fid) AS INTEGER) AS position, count(*) OVER () AS n FROM scores),
p AS (SELECT DISTINCT CAST(round_even(1 + i * ((SELECT max(n) FROM x) - 1) / 29.0::DOUBLE, 0) AS INTEGER) AS position FROM range(0, 30) t(i))
SELECT fid, disc, position FROM x WHERE position IN (SELECT position FROM p)""", "scores")
def _(s, d):
    return K.evenly_spaced(T.scores(s, d).select("fid", "disc"), 30, "disc")


NESTED = [("leaf", {"disc": 0.055}), ("leaf_stem", {"tax": 0.045}), ("leaf_stem_flow", {"qty_sd": (10.0, 16.0)})]
SETS = """sets AS (SELECT 'leaf' AS "set", fid FROM scores WHERE disc <= 0.055 UNION ALL SELECT 'leaf_stem', fid FROM scores WHERE disc <= 0.055 AND tax <= 0.045
UNION ALL SELECT 'leaf_stem_flow', fid FROM scores WHERE disc <= 0.055 AND tax <= 0.045 AND qty_sd BETWEEN 10 AND 16)"""


@add("k04_nested_constraints", f"WITH {SETS} SELECT \"set\", fid FROM sets", "scores")
def _(s, d):
    return K.nested_sets(T.scores(s, d), NESTED)


@add("k05_set_summary", f"WITH {SETS} SELECT \"set\", round(CAST(avg(qty_sd) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(quantile_cont(qty_sd, 0.2) AS DECIMAL(38, 9)), 6)::DOUBLE AS q20, round(CAST(quantile_cont(qty_sd, 0.5) AS DECIMAL(38, 9)), 6)::DOUBLE AS q50, round(CAST(quantile_cont(qty_sd, 0.8) AS DECIMAL(38, 9)), 6)::DOUBLE AS q80, count(*) AS n FROM sets JOIN scores USING (fid) GROUP BY 1", "scores")
def _(s, d):
    return r_all(K.set_summary(K.nested_sets(T.scores(s, d), NESTED).join(T.scores(s, d), "fid"), "qty_sd"))


RANKED = "x AS (SELECT variable, date_trunc('month', ts)::TIMESTAMP AS bucket, value FROM daily), q(q) AS (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE))"


@add("k05_merged_sketches", f"WITH {RANKED} SELECT variable, CAST(round(q * 100) AS INTEGER) AS percent, count(*) AS n, round(CAST(avg(value) AS DECIMAL(38, 7)), 4)::DOUBLE AS mean, TRUE AS within FROM x CROSS JOIN q GROUP BY 1, 2", "daily")
def _(s, d):
    """Sketches of each run and month, merged over runs and months; each quantile's rank is counted in the rows themselves, and is within the error that is stated."""
    rows = T.daily(s, d).withColumn("bucket", bucket(Kind.MONTHLY_SERIES, F.col("ts")))
    kept = sketch.merged(sketch.sketched(rows, ["fid", "variable", "bucket"]), ["variable"])
    wide = sketch.quantiles(kept, [0.2, 0.5, 0.8])
    long = wide.unpivot(["variable", "n", "mean"], ["q20", "q50", "q80"], "name", "at").withColumn("percent", F.expr("CAST(substring(name, 2) AS INT)"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    counted = rows.join(F.broadcast(long), "variable").groupBy("variable", "percent", "n", "mean").agg(share(F.col("value") < F.col("at")).alias("below"), share(F.col("value") <= F.col("at")).alias("upto"))
    margin = 2 * sketch.RANK_ERROR
    return r_all(counted.select("variable", "percent", "n", "mean", ((F.col("below") <= F.col("percent") / 100 + margin) & (F.col("upto") >= F.col("percent") / 100 - margin)).alias("within")), 4)


COMPLETE = "c AS (SELECT disc, tax, qty_sd, CAST(size AS DOUBLE) AS size, price FROM scores JOIN params USING (fid) WHERE qty_sd IS NOT NULL)"
NAMES = ["disc", "tax", "qty_sd", "size", "price"]
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]


@add("k06_pearson_matrix", f"WITH {COMPLETE}, r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM c" for a, b in PAIRS) + ") SELECT a, b, round(CAST(r AS DECIMAL(38, 9)), 6)::DOUBLE AS r, CASE WHEN abs(r) >= 0.05 THEN 'strong' ELSE 'weak' END AS class FROM r WHERE abs(r) >= 0.01", "scores params")
def _(s, d):
    return r_all(K.pearson_matrix(J.attach_params(T.scores(s, d), T.params(s, d)), NAMES, 0.01, 0.05))


RANKS = "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NAMES) + " FROM c)"


@add("k07_spearman_matrix", f"WITH {COMPLETE}, {RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CAST(corr({a}, {b}) AS DECIMAL(38, 9)), 6)::DOUBLE AS r FROM k" for a, b in PAIRS), "scores params")
def _(s, d):
    return r_all(K.spearman_matrix(J.attach_params(T.scores(s, d), T.params(s, d)), NAMES))


HIST = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(least(floor(({c} - lo) / (hi - lo) * 30) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM (SELECT {c}::DOUBLE AS {c}, min({c}::DOUBLE) OVER () AS lo, max({c}::DOUBLE) OVER () AS hi FROM c) GROUP BY 2" for c in ("price", "size", "qty_sd"))


@add("k08_histogram", f"WITH {COMPLETE} {HIST}", "scores params")
def _(s, d):
    return K.histogram(J.attach_params(T.scores(s, d), T.params(s, d)).dropna(subset=NAMES), ["price", "size", "qty_sd"])


@add("k09_value_counts", "SELECT brand, count(*) AS n FROM params GROUP BY 1 ORDER BY 1", "params")
def _(s, d):
    return K.value_counts(T.params(s, d), "brand")


@add("k10_parameter_long", f"WITH {SETS} SELECT s.\"set\", p.fid, v.parameter, v.value FROM sets s JOIN params p USING (fid) CROSS JOIN LATERAL (VALUES ('size', CAST(p.size AS DOUBLE)), ('price', p.price)) v(parameter, value)", "scores params")
def _(s, d):
    return K.parameter_long(T.params(s, d), K.nested_sets(T.scores(s, d), NESTED), ["size", "price"])


@add("k11_feature_importance")
def _(s, d):
    x = J.attach_params(T.scores(s, d), T.params(s, d)).select(*[F.col(c).cast("double").alias(c) for c in NAMES])
    return K.feature_importance(x, ["disc", "tax", "size", "qty_sd"], "price")
