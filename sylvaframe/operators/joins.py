"""Joins. Sides are broadcast by Spark where it knows that they are small; only fixed tables are hinted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import nearest_values


def join_model_obs(model: DataFrame, obs: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on time: columns ``m`` and ``o``; rows without both are left out."""
    return model.withColumnRenamed("value", "m").join(obs.withColumnRenamed("value", "o"), on).filter(F.col("m").isNotNull() & F.col("o").isNotNull())


def align_outer(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    return left.withColumnRenamed("value", names[0]).join(right.withColumnRenamed("value", names[1]), on, "full")


def join_many(df: DataFrame, variables: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Several variables of a long table side by side where all of them exist: one shuffle, not one for each join."""
    wide = df.filter(F.col("variable").isin(*variables)).groupBy(*keys).pivot("variable", variables).agg(F.first(value))
    return wide.dropna(subset=variables)


def attach_params(df: DataFrame, params: DataFrame) -> DataFrame:
    return df.join(params, "fid")


def only_in(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def overlap_or_full(model: DataFrame, obs: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Model rows at observed times; a key without any overlap keeps all its rows."""
    times = obs.select(ts).distinct().withColumn("_seen", F.lit(True))
    marked = model.join(times, ts, "left")
    some = marked.groupBy(*keys).agg(F.count("_seen").alias("_hits"))
    return marked.join(some, keys).filter(F.col("_seen").isNotNull() | (F.col("_hits") == 0)).drop("_seen", "_hits")


def left_join_series(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left")


def wrap_lon(lon: Column, to_360: bool = False) -> Column:
    """Longitudes to (-180, 180], or for a grid from 0 to 360."""
    return F.pmod(lon, F.lit(360.0)) if to_360 else F.when(lon > 180, lon - 360).otherwise(lon)


def nearest_on_axis(points: DataFrame, grid: DataFrame, axis: str) -> DataFrame:
    """For each distinct coordinate of the points, the nearest of the grid's axis, ties to the smaller: its neighbours in the order of both."""
    return nearest_values(points, grid, axis, f"g_{axis}")


def spread(df: DataFrame, rows: int = 1000) -> DataFrame:
    """A small table each row of which makes many, dealt to tasks of about so many rows: they grow in number with the table, not in size."""
    return df.repartition(max(1, -(-df.count() // rows)))


def nearest_cell(points: DataFrame, grid: DataFrame) -> DataFrame:
    """The points with g_lon, g_lat (each axis by itself) and the cell's columns, NULL where there is no such cell."""
    at = points.join(nearest_on_axis(points, grid, "lon"), "lon").join(nearest_on_axis(points, grid, "lat"), "lat")
    return at.join(grid.withColumnsRenamed({"lon": "g_lon", "lat": "g_lat"}), ["g_lon", "g_lat"], "left")


#: Cells of a tile at most where coordinates allow; a tile is split into 4 x 4; no more splits than these.
TILE_CELLS, MOST_SPLITS = 64, 12


def nearest_point(points: DataFrame, cells: DataFrame, key: str, tile_cells: int = TILE_CELLS) -> DataFrame:
    """The nearest cell by squared distance in degrees, ties to the smaller lon, then lat.

    The cells' extent is split into 4 x 4 tiles again and again until no tile has more than ``tile_cells`` cells of different places; each tile knows the box around its
    cells. The points go down this pyramid, all of them one level at a time: of the tiles that a point still looks at, one is surely as near as its
    farthest corner, and tiles whose nearest corner is farther than that are left. A point ends at a few tiles of few cells, whatever the density.
    Points or cells without a place are left out."""
    x, y = F.col("lon"), F.col("lat")
    placed = cells.filter(x.isNotNull() & y.isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")).select(x.cast("double").alias("c_lon"), y.cast("double").alias("c_lat"), F.col("value").alias("c_value"))
    have = placed.groupBy("c_lon", "c_lat").agg(F.min("c_value").alias("c_value"))
    ends = placed.agg(F.min("c_lon"), F.max("c_lon"), F.min("c_lat"), F.max("c_lat"), F.count("*")).first()
    west, east, south, north, n = ends if ends[4] else (0.0, 0.0, 0.0, 0.0, 0)
    span = max(east - west, north - south) or 1.0
    tile = lambda c, low, level: F.least(F.floor((F.col(c) - low) / span * 4**level), F.lit(4**level - 1)).cast("long")
    at = lambda level: (tile("c_lon", west, level).alias("bx"), tile("c_lat", south, level).alias("by"))
    level = 0
    while level < MOST_SPLITS and 16**level * tile_cells < n:
        level += 1
    crowded = lambda df: df.groupBy(*at(level)).count().agg(F.max("count")).first()[0] > tile_cells
    while 0 < level < MOST_SPLITS and crowded(placed) and crowded(have):
        level += 1
    box = lambda w, e, s_, n_: (F.min(w).alias("x0"), F.max(e).alias("x1"), F.min(s_).alias("y0"), F.max(n_).alias("y1"))
    pyramid = [have.groupBy(*at(level)).agg(*box("c_lon", "c_lon", "c_lat", "c_lat"))]
    for _ in range(level):
        pyramid.insert(0, pyramid[0].groupBy(F.shiftright("bx", 2).alias("bx"), F.shiftright("by", 2).alias("by")).agg(*box("x0", "x1", "y0", "y1")))
    least = F.greatest(F.col("x0") - x, x - F.col("x1"), F.lit(0.0)) ** 2 + F.greatest(F.col("y0") - y, y - F.col("y1"), F.lit(0.0)) ** 2
    most = F.greatest(F.abs(x - F.col("x0")), F.abs(x - F.col("x1"))) ** 2 + F.greatest(F.abs(y - F.col("y0")), F.abs(y - F.col("y1"))) ** 2
    at_point = points.select(key, x.cast("double").alias("lon"), y.cast("double").alias("lat")).filter(x.isNotNull() & y.isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    looks = at_point.withColumns({"bx": F.lit(0).cast("long"), "by": F.lit(0).cast("long")})
    for tiles in pyramid[1:]:
        inside = tiles.withColumnsRenamed({"bx": "tx", "by": "ty"}).withColumns({"bx": F.shiftright("tx", 2), "by": F.shiftright("ty", 2)})
        tried = looks.join(inside, ["bx", "by"]).withColumn("reach", F.min(most).over(W.partitionBy(key)))
        looks = tried.filter(least <= F.col("reach") * (1 + 1e-12)).select(key, "lon", "lat", F.col("tx").alias("bx"), F.col("ty").alias("by"))
    d2 = (F.col("c_lon") - x) ** 2 + (F.col("c_lat") - y) ** 2
    found = looks.join(have.select("*", *at(level)), ["bx", "by"]).groupBy(key).agg(F.min(F.struct(d2.alias("d2"), "c_lon", "c_lat", "c_value")).alias("best"))
    return found.select(key, "best.c_lon", "best.c_lat", "best.d2", "best.c_value")


#: Search order around a cell, as (lon, lat) steps: fixed values.
RING = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, -1), (-1, 1), (1, 1))


def nearest_valid_cell(at: DataFrame, grid: DataFrame, key: str, maps: list[str] | None = None) -> DataFrame:
    """For cells given by axis index (ix, iy), from 0: the cell's own value, or the first valid one in rings of growing
    distance, in the order of RING, however far; indices below 0 are taken as 0, cells beyond the grid do not exist. NULL where the grid has no such cell.

    A ring's eight cells lie on eight rays, which at index 0 go on along the edge. So the first valid cell of a ray is the next one on a column, a row or a diagonal:
    every valid cell and every place that looks for one is put on these lines, and a window along each line finds what is next. Places that
    several rows share look once, so a line holds no more rows than the grid is wide. With ``maps``, the grid's column ``map`` tells several maps apart, and each row
    looks in all those named, in one pass: the result has a row for each of them."""
    one, looked = ([], at) if maps is None else (["map"], at.withColumn("map", F.explode(F.array(*map(F.lit, maps)))))
    valid = grid.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*one, F.col("ix").cast("long").alias("x"), F.col("iy").cast("long").alias("y")).agg(F.min("value").alias("value"))
    x, y = F.col("x"), F.col("y")
    places = looked.select(*one, F.greatest(F.col("ix"), F.lit(0)).cast("long").alias("x"), F.greatest(F.col("iy"), F.lit(0)).cast("long").alias("y")).distinct()
    empty = places.join(valid, [*one, "x", "y"], "left_anti")
    line = lambda kind, name, place: (F.lit(kind).alias("kind"), name.alias("line"), place.alias("place"))
    column, row, rising, falling = line("column", x, y), line("row", y, x), line("rising", x - y, x), line("falling", x + y, x)
    edge_column = lambda place: line("column", F.lit(0).cast("long"), place)
    edge_row = lambda place: line("row", F.lit(0).cast("long"), place)
    none = F.lit(0).cast("long")
    # (line, +1: the next place above, -1: below, distance at which the ray enters the line, order in the ring, whether the ray comes there)
    rays = [
        (column, -1, none, 1, None), (column, 1, none, 2, None), (row, -1, none, 3, None), (row, 1, none, 4, None),
        (rising, -1, none, 5, None), (edge_column(y - x), -1, x, 5, x < y), (edge_row(x - y), -1, y, 5, y < x),
        (falling, 1, none, 6, None), (edge_row(x + y), 1, y, 6, None), (falling, -1, none, 7, None), (edge_column(x + y), 1, x, 7, None), (rising, 1, none, 8, None),
    ]
    asks = F.array(*[F.when(F.lit(True) if comes is None else comes, F.struct(*on, F.lit(side).alias("side"), far.alias("far"), F.lit(k).alias("k"))) for on, side, far, k, comes in rays])
    asked = empty.select(*one, "x", "y", F.explode(F.array_compact(asks)).alias("a")).select(*one, "x", "y", "a.*")
    cells = valid.select(*one, "value", F.explode(F.array(*[F.struct(*on) for on in (column, row, rising, falling)])).alias("a")).select(*one, "value", "a.*")
    both = asked.unionByName(cells.withColumn("valid", F.struct("place", "value")), allowMissingColumns=True)
    along = W.partitionBy(*one, "kind", "line")
    near = both.withColumn("below", F.last("valid", ignorenulls=True).over(along.orderBy("place"))).withColumn("above", F.last("valid", ignorenulls=True).over(along.orderBy(F.desc("place"))))
    hit = F.when(F.col("side") > 0, F.col("above")).otherwise(F.col("below"))
    near = near.filter("k IS NOT NULL").select(*one, "x", "y", "far", "k", "place", hit.alias("hit")).filter("hit IS NOT NULL")
    ring = F.col("far") + F.abs(F.col("hit.place") - F.col("place"))
    first = near.groupBy(*one, "x", "y").agg(F.min(F.struct(((ring - 1) * len(RING) + F.col("k")).cast("int").alias("priority"), F.col("hit.value").alias("value"))).alias("m")).select(*one, "x", "y", "m.*")
    own = places.join(valid, [*one, "x", "y"]).select(*one, "x", "y", F.lit(0).alias("priority"), "value")
    found = own.unionByName(first).withColumnsRenamed({"x": "_x", "y": "_y", "map": "_map"})
    on = (F.greatest(F.col("ix"), F.lit(0)) == F.col("_x")) & (F.greatest(F.col("iy"), F.lit(0)) == F.col("_y"))
    on = on & (F.col("map") == F.col("_map")) if one else on
    return looked.join(found, on, "left").select(*looked.columns, "priority", "value")


def update_join(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Values of the right side where it has any, else of the left."""
    new = right.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return left.join(new, on, "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def common_sites(df: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return df.join(a.select(key).intersect(b.select(key)), key, "left_semi")


def cross_design(*tables: DataFrame) -> DataFrame:
    """Every combination of rows of small design tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out


#: The model's plant types by name, and the site codes with the names they stand for.
MODEL_TYPES = {"BEM": 1, "BED": 2, "BDR": 3, "BDS": 4, "NE": 5, "NS": 6, "TeH": 7, "TrH": 8, "TeP": 9, "TrP": 10, "TeC": 11, "TrC": 12, "BSO": 13, "UAR": 14}
SITE_TYPES = {"TrBE": "BEM", "TeBE": "BED", "TrBR": "BDR", "TeBS": "BDS", "BBS": "BDS", "BNE": "NE", "TeNE": "NE", "BNS": "NS", "TeH": "TeH", "TeC": "TeH", "TrH": "TrH", "TrC": "TrH"}
PLANT_TYPES = {site: MODEL_TYPES[name] for site, name in SITE_TYPES.items()}


def map_codes(df: DataFrame, codes: dict[str, int], code: str, name: str) -> DataFrame:
    """A lookup by a small table; an unknown code is an error, raised when the result is computed."""
    small = df.sparkSession.createDataFrame(list(codes.items()), f"{code} STRING, {name} INT")
    out = df.join(F.broadcast(small), code, "left")
    return out.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(code, F.lit("null")))).cast("int")))
