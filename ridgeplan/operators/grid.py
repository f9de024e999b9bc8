"""Terrain grids: extent, mosaic, resampling, elevations at points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeplan.functions import geo


def bounding_box(points: DataFrame, pad_share: float = 0.0, least_pad_km: float = 0.1) -> DataFrame:
    """One row n, s, e, w; with ``pad_share`` the box grows by that share of its sides (``least_pad_km`` if a side is zero)."""
    box = points.agg(F.max("lat").alias("n"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.min("lng").alias("w"))
    if not pad_share:
        return box
    height = geo.haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("w")) * pad_share
    width = geo.haversine_km(F.col("s"), F.col("w"), F.col("s"), F.col("e")) * pad_share
    pad = lambda x: F.when(x == 0, least_pad_km).otherwise(x)
    degrees = lambda km: F.degrees(km / geo.EARTH_KM)
    return box.select(
        (F.col("n") + degrees(pad(height))).alias("n"), (F.col("s") - degrees(pad(height))).alias("s"),
        (F.col("e") + degrees(pad(width)) / F.cos(F.radians("n"))).alias("e"), (F.col("w") - degrees(pad(width)) / F.cos(F.radians("s"))).alias("w"),
    )


def tile_requests(box: DataFrame) -> DataFrame:
    """Distinct tile names whose square meets the box."""
    lats = F.explode(F.sequence(F.floor("s"), F.floor("n"))).alias("lat")
    cells = box.select("e", "w", lats).select("lat", F.explode(F.sequence(F.floor("w"), F.floor("e"))).alias("lng"))
    return cells.select(geo.tile_name(F.col("lat"), F.col("lng")).alias("tile")).distinct()


def grid_size(cells: DataFrame) -> DataFrame:
    """One row n_rows, n_cols, n_cells."""
    return cells.agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"), F.count(F.lit(1)).alias("n_cells"))


def positive_or_null(z: Column) -> Column:
    """Elevations that are not positive are no data."""
    return F.when(z > 0, z)


def mosaic(tiles: DataFrame) -> DataFrame:
    """(lat_key, lng_key, z) of several tiles: the first tile in order that has data."""
    return tiles.groupBy("lat_key", "lng_key").agg(F.min(F.when(F.col("z").isNotNull(), F.struct("tile_ord", "z"))).getField("z").alias("z"))


def crop(points: DataFrame, box: DataFrame) -> DataFrame:
    """Points inside a one-row box."""
    b = F.broadcast(box)  # one row
    return points.join(b, geo.in_box(points.lat, points.lng, b.n, b.s, b.e, b.w)).select(points.columns)


def resample(cells: DataFrame, n_rows: int, n_cols: int, source_rows: int, source_cols: int) -> DataFrame:
    """Nearest-sample grid of n_rows by n_cols, numbered anew in row-major order.

    Every target cell has one source cell, by arithmetic; each source cell finds the target
    cells that want it, so the join is on the source's number.
    """
    spark = cells.sparkSession
    target = spark.range(n_rows * n_cols).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / n_cols).cast("int").alias("r"), (F.col("id") % n_cols).cast("int").alias("c"))
    near = lambda k, n, m: F.floor((2 * F.col(k) + 1) * m / (2 * n)).cast("int")
    target = target.select("*", near("r", n_rows, source_rows).alias("sr"), near("c", n_cols, source_cols).alias("sc"))
    source = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "lat", "lng", "z")
    return target.join(source, ["sr", "sc"]).select("cell_id", "r", "c", "lat", "lng", "z")


def square_side(target_cells: int) -> int:
    return max(1, math.isqrt(target_cells))


def numbered(cells: DataFrame, n_cols: int) -> DataFrame:
    """Row-major ids by arithmetic."""
    return cells.withColumn("cell_id", F.col("r").cast("long") * n_cols + F.col("c"))


def elevation_at(points: DataFrame, cells: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """Points with the elevation ``z`` of the sample at their row and column (null outside)."""
    located = points.withColumn("r", F.floor((F.lit(north) - F.col("lat")) / step + 0.5).cast("int")).withColumn("c", F.floor((F.col("lng") - F.lit(west)) / step + 0.5).cast("int"))
    return located.join(cells.select("r", "c", "z"), ["r", "c"], "left").drop("r", "c")


def weighted_elevation(points: DataFrame, cells: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """Elevation as the mean of the nearest sample and its four neighbours, the nearer the heavier.

    The weight of a sample is one step minus its distance (in steps of the grid), zero at
    least; a neighbour without data, or of elevation zero, counts as the nearest sample.
    """
    y, x = (F.lit(north) - F.col("lat")) / step, (F.col("lng") - F.lit(west)) / step
    located = points.select("*", F.monotonically_increasing_id().alias("__row"), y.alias("y"), x.alias("x"), F.floor(y + 0.5).cast("int").alias("r0"), F.floor(x + 0.5).cast("int").alias("c0"))
    shifts = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    asked = located.withColumn("shift", F.explode(shifts)).select("*", (F.col("r0") + F.col("shift.dr")).alias("r"), (F.col("c0") + F.col("shift.dc")).alias("c"))
    met = asked.join(cells.select("r", "c", "z"), ["r", "c"], "left")
    weight = F.greatest(F.lit(0.0), 1 - F.sqrt((F.col("y") - F.col("r")) * (F.col("y") - F.col("r")) + (F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))))
    keys = [c for c in points.columns]
    centre = F.max(F.when((F.col("r") == F.col("r0")) & (F.col("c") == F.col("c0")), F.col("z")))
    grouped = met.withColumn("weight", weight).groupBy("__row", *keys).agg(centre.alias("z0"), F.sum("weight").alias("total"), F.collect_list(F.struct("weight", "z")).alias("near"))
    value = F.aggregate("near", F.lit(0.0), lambda acc, x: acc + x["weight"] * F.when(F.coalesce(x["z"], F.lit(0)) == 0, F.col("z0")).otherwise(x["z"]))
    return grouped.select(*keys, F.when(F.col("total") > 0, value / F.col("total")).otherwise(F.col("z0")).alias("z"))


def filled_track(track: DataFrame, key: str, order: str, known: str, along: str) -> DataFrame:
    """Missing values of a track, interpolated linearly along its distance between known ones.

    Before the first and after the last known value the nearest one holds; without any: null.
    """
    w = Window.partitionBy(key).orderBy(order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(known).isNotNull(), F.struct(F.col(along).alias("d"), F.col(known).alias("v")))
    ends = track.withColumn("before", F.last(here, ignorenulls=True).over(back)).withColumn("after", F.first(here, ignorenulls=True).over(on))
    span = F.col("after.d") - F.col("before.d")
    between = F.col("before.v") + (F.col("after.v") - F.col("before.v")) * (F.col(along) - F.col("before.d")) / span
    value = F.when(F.col("before").isNull(), F.col("after.v")).when(F.col("after").isNull() | (span == 0), F.col("before.v")).otherwise(between)
    return ends.withColumn("filled", value).drop("before", "after")


def sampled_track(track: DataFrame, key: str, order: str, value: str, along: str, interval: float) -> DataFrame:
    """A track's values taken only where a new interval of its length begins, interpolated between (``filled``)."""
    step = F.floor(F.col(along) / interval)
    before = F.lag(step).over(Window.partitionBy(key).orderBy(order))
    known = F.when(before.isNull() | (step != before), F.col(value))
    return filled_track(track.withColumn("__known", known), key, order, "__known", along).drop("__known")


#: The sampling intervals in metres whose mean smooths a track.
INTERVALS = (35.0, 141.0, 241.0)


def smoothed_track(track: DataFrame, key: str, order: str, value: str, along: str, present: str | None = None) -> DataFrame:
    """The mean of a track's samplings at three intervals (``filled``); values of ``present`` stay as they are."""
    out = track
    for k, interval in enumerate(INTERVALS):
        out = sampled_track(out, key, order, value, along, interval).withColumnRenamed("filled", f"__s{k}")
    names = [f"__s{k}" for k in range(len(INTERVALS))]
    mean = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
    return out.withColumn("filled", mean if present is None else F.coalesce(F.col(present), mean)).drop(*names)


def points_in_polygon(points: DataFrame, polygon: DataFrame, point_key: str = "point_id") -> DataFrame:
    """Points with ``inside`` by the crossing number; polygon rows: ord, lat, lng (closed by itself).

    The polygon is one object of few corners and travels as an array in each row's plan.
    """
    corners = polygon.agg(F.sort_array(F.collect_list(F.struct("ord", F.col("lat").alias("y"), F.col("lng").alias("x")))).alias("corners"))
    joined = points.join(F.broadcast(corners))
    edges = F.transform(F.sequence(F.lit(0), F.size("corners") - 1), lambda k: F.struct(F.col("corners")[k].alias("a"), F.col("corners")[F.pmod(k + 1, F.size("corners"))].alias("b")))
    crosses = lambda e: ((e["a"]["y"] > F.col("lat")) != (e["b"]["y"] > F.col("lat"))) & (F.col("lng") < (e["b"]["x"] - e["a"]["x"]) * (F.col("lat") - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return joined.withColumn("inside", F.size(F.filter(edges, crosses)) % 2 == 1).drop("corners")


def contours(cells: DataFrame, interval: int = 100) -> DataFrame:
    """Grid edges that a contour crosses: (level, cell_id, side) with side E or S.

    Both ends of an edge between neighbours are compared; every multiple of ``interval``
    above the lower and up to the higher end is a crossing.
    """
    a = cells.filter("z IS NOT NULL").select("cell_id", "r", "c", "z")
    sides = F.explode(F.array(F.struct(F.lit("E").alias("side"), F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit("S").alias("side"), F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    asked = a.withColumn("n", sides).select("cell_id", "z", "n.side", (F.col("r") + F.col("n.dr")).alias("r"), (F.col("c") + F.col("n.dc")).alias("c"))
    met = asked.join(a.select("r", "c", F.col("z").alias("z2")), ["r", "c"])
    low, high = F.floor(F.least("z", "z2") / interval), F.floor(F.greatest("z", "z2") / interval)
    return met.filter(low < high).select(F.explode(F.sequence(low + 1, high)).alias("k"), "cell_id", "side").select((F.col("k") * interval).cast("int").alias("level"), "cell_id", "side")
