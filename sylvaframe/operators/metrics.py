"""Model against observations: joined tables have columns ``m`` and ``o``."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_model_obs
from .slices import slice_dates


def rmse(m: Column | str = "m", o: Column | str = "o") -> Column:
    m, o = (F.col(x) if isinstance(x, str) else x for x in (m, o))
    return F.sqrt(F.avg((m - o) * (m - o)))


def rmse_abs() -> Column:
    return rmse(F.abs(F.col("m")), F.abs(F.col("o")))


def rmse_by_flag(flag: Column) -> Column:
    """The model's sign is turned where the run's flag is off."""
    return rmse(F.when(flag, F.col("m")).otherwise(-F.col("m")))


def normalized(df: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides divided by their maximum over the joined rows of each key."""
    top = df.groupBy(*keys).agg(F.max("m").alias("_m"), F.max("o").alias("_o"))
    return df.join(top, keys).withColumns({"m": F.try_divide("m", "_m"), "o": F.try_divide("o", "_o")}).drop("_m", "_o")


def rmse_scaled(df: DataFrame, keys: list[str], factors: list[tuple[str, float]]) -> DataFrame:
    """RMSE of the model times each factor: (keys, factor's suffix, rmse); one aggregation, no copy of the rows."""
    one = df.groupBy(*keys).agg(*[rmse(F.col("m") * f).alias(s) for s, f in factors])
    return one.unpivot(keys, [s for s, _ in factors], "suffix", "rmse")


def corr() -> Column:
    return F.corr("m", "o")


def efficiency(df: DataFrame, keys: list[str], variant: str = "standard") -> DataFrame:
    """nse and rsr. The spread is that of the observations around their mean; with ``variant='reference'``, around
    the model's mean; without a spread (one row) they are NULL. Two steps, so that no mean comes from running sums of squares."""
    mean = df.groupBy(*keys).agg(F.avg("m" if variant == "reference" else "o").alias("_mean"))
    sse, sst = F.sum((F.col("m") - F.col("o")) * (F.col("m") - F.col("o"))), F.sum((F.col("o") - F.col("_mean")) * (F.col("o") - F.col("_mean")))
    return df.join(mean, keys).groupBy(*keys).agg((1 - F.try_divide(sse, sst)).alias("nse"), F.try_divide(F.sqrt(sse), F.sqrt(sst)).alias("rsr"))


def pbias() -> Column:
    return F.try_divide(100 * F.sum(F.col("m") - F.col("o")), F.sum("o"))


def metric_table(df: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """rmse, r2, nse, rsr, pbias of each key, rounded."""
    base = df.groupBy(*keys).agg(rmse().alias("rmse"), (corr() * corr()).alias("r2"), pbias().alias("pbias"))
    out = base.join(efficiency(df, keys), keys)
    return out.select(*keys, *[F.round(c, digits).alias(c) for c in ("rmse", "r2", "nse", "rsr", "pbias")])


@dataclass(frozen=True)
class Pairing:
    """A modelled variable and the observed series it is compared with. ``eras``: those it holds for (None: all), so that a variable can have another
    source in other years; ``begin`` and ``until``: a window of its own, cut with the era's; ``absolute``: magnitudes are compared; ``factors``:
    (suffix, factor) by which the model is multiplied, each a score of its own; ``metric``: the scores' name, else the variable's."""

    variable: str
    source: str
    metric: str | None = None
    eras: tuple[str, ...] | None = None
    begin: str | None = None
    until: str | None = None
    absolute: bool = False
    factors: tuple[tuple[str, float], ...] = (("", 1.0),)


@dataclass(frozen=True)
class Score:
    """One column of a scorecard: what is compared, from when until when."""

    metric: str
    era: str
    pairing: Pairing
    factor: float
    begin: str
    until: str

    @property
    def name(self) -> str:
        return f"{self.metric}_{self.era}"

    def inside(self, ts: Column) -> Column:
        return (ts >= F.lit(self.begin).cast("timestamp_ntz")) & (ts < F.lit(self.until).cast("timestamp_ntz"))


def pairings_of(table: DataFrame) -> list[Pairing]:
    """Pairings kept as a table: a column for each field of ``Pairing`` that is used. A configuration: a row for each variable and source."""
    rows = table.select(*[f.name for f in fields(Pairing) if f.name in table.columns]).collect()
    tuples = lambda k, v: tuple(map(tuple, v)) if k == "factors" else tuple(v) if k == "eras" else v
    return [Pairing(**{k: tuples(k, v) for k, v in r.asDict().items() if v is not None}) for r in rows]


def scores_of(eras: list[tuple[str, str, str]], pairings: list[Pairing]) -> list[Score]:
    """The scores that eras (name, begin, end) and pairings ask for. Bounds are compared as ISO texts."""
    out = []
    for p in pairings:
        for era, a, b in eras:
            begin, until = max(a, p.begin or a), min(b, p.until or b)
            if begin < until and (p.eras is None or era in p.eras):
                out += [Score(f"{p.metric or p.variable}_rmse{suffix}", era, p, factor, begin, until) for suffix, factor in p.factors]
    if len({s.name for s in out}) < len(out):
        raise ValueError("two pairings give the same metric and era")
    return out


def paired(model: DataFrame, obs: DataFrame, scores: list[Score]) -> DataFrame:
    """(fid, variable, source, ts, m, o): one equi-join for all scores. A model row goes to the sources that a score compares it with at its time, mostly one;
    rows that no score needs are left out before, by bounds that reach the scan. ``obs``: source, ts, value."""
    ts, needs = F.col("ts"), {}
    for s in scores:
        needs.setdefault((s.pairing.variable, s.pairing.source), {})[s.begin, s.until] = s.inside(ts)
    if not scores:
        needs = {(None, None): {("", ""): F.lit(False)}}
    to = F.array(*[F.when((F.col("variable") == v) & reduce(or_, spans.values()), F.lit(source)) for (v, source), spans in needs.items()])
    rows = model
    if scores:
        bound = lambda x: F.lit(x).cast("timestamp_ntz")
        rows = model.filter(F.col("variable").isin(*sorted({v for v, _ in needs})) & (ts >= bound(min(s.begin for s in scores))) & (ts < bound(max(s.until for s in scores))))
    rows = rows.select("fid", "variable", "ts", "value", F.explode(F.array_compact(to)).alias("source"))
    return join_model_obs(rows, obs.select("source", "ts", "value"), ["source", "ts"])


def score_columns(model: DataFrame, obs: DataFrame, eras: list[tuple[str, str, str]], pairings: list[Pairing]) -> DataFrame:
    """fid and a column for each metric and era, NULL where nothing is compared: RMSE of every run. Eras may overlap: a row is read once, and each score
    takes it or not in one aggregation."""
    scores = scores_of(eras, pairings)

    def value(s: Score) -> Column:
        side = F.abs if s.pairing.absolute else lambda c: c
        error = side(F.col("m") * s.factor) - side(F.col("o"))
        own = (F.col("variable") == s.pairing.variable) & (F.col("source") == s.pairing.source) & s.inside(F.col("ts"))
        return F.sqrt(F.avg(F.when(own, error * error))).alias(s.name)

    joined = paired(model, obs, scores)
    return joined.groupBy("fid").agg(*map(value, scores)) if scores else joined.select("fid").distinct()


def scorecard(model: DataFrame, obs: DataFrame, eras: list[tuple[str, str, str]], pairings: list[Pairing]) -> DataFrame:
    """(fid, metric, era, value): ``score_columns`` as rows, without those where nothing was compared. ``model``: fid, variable, ts, value; ``obs``: source, ts,
    value; eras: (name, begin, end), half open."""
    rows = [F.struct(F.lit(s.metric).alias("metric"), F.lit(s.era).alias("era"), F.col(s.name).alias("value")) for s in scores_of(eras, pairings)]
    wide = score_columns(model, obs, eras, pairings)
    return wide.select("fid", F.explode(F.array(*rows)).alias("s")).select("fid", "s.*").filter("value IS NOT NULL")


def per_run_list(model: DataFrame, obs: DataFrame, era: tuple[str, str, str], pairings: list[Pairing]) -> DataFrame:
    """fid and the metrics of one era, in the order of the runs."""
    scores = scores_of([era], pairings)
    return score_columns(model, obs, [era], pairings).select("fid", *[F.col(s.name).alias(s.metric) for s in scores]).orderBy("fid")


def score_table(scores: DataFrame, metrics: list[str], eras: list[str]) -> DataFrame:
    """The wide form, a column for each metric and era; the columns are given, so no job looks for them."""
    wide = scores.withColumn("name", F.concat_ws("_", "metric", "era")).groupBy("fid")
    return wide.pivot("name", [f"{m}_{e}" for m in metrics for e in eras]).agg(F.first("value"))


def merge_partials(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial score tables as one: of a key, the last part's value that is not missing."""
    rows = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(F.max_by("value", "_part").alias("value"))


def reject_runs(joined: DataFrame, threshold: float) -> DataFrame:
    """(fid, rmse, rejected)"""
    out = joined.groupBy("fid").agg(rmse().alias("rmse"))
    return out.withColumn("rejected", F.col("rmse") > threshold)


def diff_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs compared element by element: extremes of the difference, unmatched rows, and whether first and last keys agree."""
    left, right = a.withColumnRenamed("value", "m").withColumn("_l", F.lit(1)), b.withColumnRenamed("value", "o").withColumn("_r", F.lit(1))
    joined, k = left.join(right, keys, "full"), keys[0]
    side = lambda agg, flag: agg(F.when(F.col(flag).isNotNull(), F.col(k)))
    return joined.agg(
        F.min(F.col("m") - F.col("o")).alias("min_diff"), F.max(F.col("m") - F.col("o")).alias("max_diff"), F.sum(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1).otherwise(0)).alias("unmatched"),
        (side(F.min, "_l") == side(F.min, "_r")).alias("same_first"), (side(F.max, "_l") == side(F.max, "_r")).alias("same_last"),
    )


def scored_bins(model: DataFrame, obs: DataFrame, begin: str, end: str) -> DataFrame:
    """The minimum slice: half-hourly means of both sides in a period, joined."""
    from .reduce import resample_30min

    m = resample_30min(slice_dates(model, begin, end), ["fid", "variable"]).withColumnRenamed("bin", "ts")
    o = resample_30min(slice_dates(obs, begin, end), []).withColumnRenamed("bin", "ts")
    return join_model_obs(m, o, ["ts"])
