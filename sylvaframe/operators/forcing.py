"""Forcing tables for many sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .design import hashed
from .joins import common_sites, map_codes, nearest_cell, nearest_valid_cell, update_join

#: Fixed values.
DAYS_IN_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
PHOSPHORUS_POOLS = ("labile", "slow", "occluded", "primary")
PER_SECOND_TO_DAILY = 86_400 * 1e6
FORCING_COLUMNS = ("year", "doy", "hour", "swvis_srf_down", "lw_srf_down", "t_air", "q_air", "press_srf", "rain", "snow", "wind_air", "co2_mixing_ratio", "co2_dC13", "co2DC14", "nhx_srf_down", "noy_srf_down", "p_srf_down")


def days_of_year(spark) -> DataFrame:
    """(doy, month) of a 365-day year."""
    on = F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int"))
    return spark.range(365).select((F.col("id") + 1).cast("int").alias("doy"), F.month(on).alias("month"))


def monthly_deposition(monthly: DataFrame, scenario: str, factor: float = PER_SECOND_TO_DAILY, historic_until: int = 1996) -> DataFrame:
    """(site, year, month, value): what each day of the month has, from monthly means (site, family, year, month, value); the family is
    'historic' before ``historic_until``, else the scenario."""
    rows = monthly.filter(F.col("family") == F.when(F.col("year") < historic_until, "historic").otherwise(scenario))
    return rows.select("site", "year", "month", (F.col("value") * factor).alias("value"))


def n_deposition(monthly: DataFrame, scenario: str, factor: float = PER_SECOND_TO_DAILY, historic_until: int = 1996) -> DataFrame:
    """Daily values (site, year, doy, value) of ``monthly_deposition``: constant within a month."""
    rows = monthly_deposition(monthly, scenario, factor, historic_until)
    return rows.join(F.broadcast(days_of_year(monthly.sparkSession)), "month").select("site", "year", "doy", "value")


def p_deposition(points: DataFrame, grid: DataFrame) -> DataFrame:
    return nearest_cell(points, grid).withColumn("p_srf_down", F.col("value") / 365)


def map_lookup(points: DataFrame, grid: DataFrame, factor: float = 1.0) -> DataFrame:
    return nearest_cell(points, grid).withColumn("value", F.col("value") * factor)


def p_pools(at: DataFrame, maps: DataFrame, pools: tuple[str, ...] = PHOSPHORUS_POOLS, key: str = "site", depth: float = 0.5) -> DataFrame:
    """(key, a column for each pool, depth): the pools' maps at each place, or at the nearest valid cell of that map. ``at``: key, ix, iy; ``maps``: map, ix, iy,
    value. All maps are searched in one pass."""
    found = nearest_valid_cell(at, maps, key, list(pools)).groupBy(key).pivot("map", list(pools)).agg(F.first("value"))
    return found.withColumn("depth", F.lit(depth))


def add_annual(df: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """An annual value (year, value) for each row."""
    return df.join(series.select("year", F.col("value").alias(name)), "year")


def add_c14(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Radiocarbon by latitude band: ``bands`` has year, north (> 30), tropics, south (<= -30)."""
    long = bands.unpivot("year", ["north", "tropics", "south"], "band", "co2DC14")
    band = F.when(F.col("lat") > 30, "north").when(F.col("lat") > -30, "tropics").otherwise("south")
    return df.withColumn("band", band).join(long, ["year", "band"]).drop("band")


def assemble(met: DataFrame, co2: DataFrame, c13: DataFrame, c14: DataFrame, nhx: DataFrame, noy: DataFrame, p: DataFrame, columns: tuple[str, ...] = FORCING_COLUMNS) -> DataFrame:
    """The forcing table of all sites. ``met``: site, lat, year, day, hour and weather; ``p``: site, p_srf_down. ``nhx`` and ``noy`` have a value for each
    day (doy) or each month, which its days share: a month is joined as one row, not as its days."""
    df = met.withColumnRenamed("day", "doy").withColumn("wind_air", F.greatest("wind_air", F.lit(0.1)))
    df = add_annual(add_annual(df, co2, "co2_mixing_ratio"), c13, "co2_dC13")
    df = add_c14(df, c14)
    df = df.withColumn("month", F.month(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("doy") - 1).cast("int"))))
    for part, name in ((nhx, "nhx_srf_down"), (noy, "noy_srf_down")):
        keys = ["site", "year", "month" if "month" in part.columns else "doy"]
        df = df.join(part.select(*keys, F.col("value").alias(name)), keys)
    return df.join(p.select("site", "p_srf_down"), "site").select("site", *columns)


def complete_sites(df: DataFrame, columns: list[str], key: str = "site") -> DataFrame:
    """(site, missing rows, ok): a site with any missing value fails."""
    gap = F.lit(False)
    kinds = dict(df.dtypes)
    for c in columns:
        gap = gap | F.col(c).isNull() | (F.isnan(c) if kinds[c] == "double" else F.lit(False))
    return df.groupBy(key).agg(F.sum(F.when(gap, 1).otherwise(0)).alias("missing")).withColumn("ok", F.col("missing") == 0)


def fill_years(df: DataFrame, value: str, keys: tuple[str, ...] = ("doy", "hour"), site: str = "site", seed: int = 42) -> DataFrame:
    """Years with any missing value are overwritten, where the donor has a value, from a year that has data; then the last
    value is carried forward. The donor of a year is chosen by a hash of seed, site and year."""
    years = df.groupBy(site, "year").agg(F.count(value).alias("n"), F.count(F.lit(1)).alias("rows"))
    have = years.filter("n > 0").groupBy(site).agg(F.sort_array(F.collect_list("year")).alias("have"))  # calendar years of a site
    pick = (hashed(seed, F.col(site), F.col("year")) % F.size("have")).cast("int")
    donors = years.filter("n < rows").join(have, site).select(site, "year", F.element_at("have", pick + 1).alias("donor"))
    source = df.select(site, F.col("year").alias("donor"), *keys, value)
    given = donors.join(source, [site, "donor"]).drop("donor")
    filled = update_join(df, given, [site, "year", *keys], [value])
    order = W.partitionBy(site).orderBy("year", *keys).rowsBetween(W.unboundedPreceding, 0)
    return filled.withColumn(value, F.last(value, ignorenulls=True).over(order))


def site_settings(sites: DataFrame, codes: dict[str, int], columns: list[str]) -> DataFrame:
    """(site, key, value as text) for each setting of each site, the plant type as the model's number."""
    rows = map_codes(sites, codes, "PFT", "plant_functional_type_id")
    keep = [*columns, "plant_functional_type_id"]
    return rows.select("site", *[F.col(c).cast("string").alias(c) for c in keep]).unpivot("site", keep, "key", "value")


def filter_site_list(sites: DataFrame, a: DataFrame, b: DataFrame, start: int = 1901, key: str = "site") -> DataFrame:
    return common_sites(sites, a, b, key).withColumn("start", F.lit(start))


def grid_monthly_series(long: DataFrame, variables: list[str], first_year: int = 1981) -> DataFrame:
    """(lon, lat, date, a column for each variable) from (lon, lat, variable, step from 0, value)."""
    date = F.add_months(F.lit(f"{first_year}-01-01").cast("date"), F.col("step").cast("int"))
    return long.withColumn("date", date).groupBy("lon", "lat", "date").pivot("variable", variables).agg(F.first("value"))
