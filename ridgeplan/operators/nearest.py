"""Nearest-cell joins on a regular grid, by arithmetic instead of a scan of all cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeplan.functions import geo


@dataclass(frozen=True)
class Lattice:
    """A grid whose cell (r, c) lies at (north - r * step, west + c * step).

    Only its last row may be incomplete.
    """

    north: float
    west: float
    step: float
    n_rows: int
    n_cols: int

    def near(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        """Row and column of the grid position nearest to a point, clamped to the grid."""
        r = F.floor((F.lit(self.north) - lat) / self.step + 0.5)
        c = F.floor((lng - F.lit(self.west)) / self.step + 0.5)
        clamp = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)).cast("int")
        return clamp(r, self.n_rows), clamp(c, self.n_cols)


#: Distances are compared in units of a micrometre, so that both engines see the same ties.
def _rank_km(km: Column) -> Column:
    return F.round(km, 9)


def nearest_cell(points: DataFrame, cells: DataFrame, grid: Lattice, key: str = "site_id") -> DataFrame:
    """Each point with ``cell_id`` and ``km`` of its nearest cell; of equally near ones the highest id.

    A point looks at the 3 by 3 block of cells around its grid position: an equi-join on
    (r, c) of nine rows per point, whatever the size of the grid.  Equal points stay rows
    of their own.
    """
    r, c = grid.near(F.col("lat"), F.col("lng"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asked = points.withColumn("__row", F.monotonically_increasing_id()).withColumn("r", r).withColumn("c", c).withColumn("d", around).withColumn("r", F.col("r") + F.col("d.dr")).withColumn("c", F.col("c") + F.col("d.dc")).drop("d")
    met = asked.join(cells.select("r", "c", "cell_id", F.col("lat").alias("cell_lat"), F.col("lng").alias("cell_lng")), ["r", "c"])
    km = _rank_km(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("cell_lat"), F.col("cell_lng")))
    best = met.withColumn("km", km).groupBy("__row", *points.columns).agg(F.min(F.struct("km", (-F.col("cell_id")).alias("k"))).alias("b"))
    return best.select(*points.columns, (-F.col("b.k")).alias("cell_id"), F.col("b.km").alias("km"))


#: Neighbours in the order in which equal distances are settled: right, left, top, bottom, then the corners.
NEIGHBOURS = ((0, 1), (0, -1), (-1, 0), (1, 0), (-1, 1), (1, 1), (-1, -1), (1, -1))


def nearest_valid_cell(points: DataFrame, cells: DataFrame, grid: Lattice, key: str = "site_id") -> DataFrame:
    """As :func:`nearest_cell`; if that cell has no data, the nearest of its neighbours that has.

    Without a valid neighbour the point keeps the cell without data.
    """
    own = nearest_cell(points, cells, grid, key).join(cells.select("cell_id", "r", "c", "z"), "cell_id")
    around = F.explode(F.array(*[F.struct(F.lit(k).alias("pref"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(NEIGHBOURS)]))
    asked = own.filter("z IS NULL").withColumn("n", around).select(key, "lat", "lng", "n.pref", (F.col("r") + F.col("n.dr")).alias("r"), (F.col("c") + F.col("n.dc")).alias("c"))
    valid = cells.filter("z IS NOT NULL").select("r", "c", F.col("cell_id").alias("other"), F.col("lat").alias("cell_lat"), F.col("lng").alias("cell_lng"))
    km = _rank_km(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("cell_lat"), F.col("cell_lng")))
    moved = asked.join(valid, ["r", "c"]).groupBy(key).agg(F.min(F.struct(km.alias("km"), "pref", "other")).alias("m"))
    both = own.join(moved, key, "left")
    return both.select(*points.columns, F.coalesce("m.other", "cell_id").alias("cell_id"), F.col("z").isNull().alias("moved"))


def unique_source(source_cell: DataFrame, sink_cells: DataFrame, cells: DataFrame) -> DataFrame:
    """One row ``cell_id``: the source's cell, or the nearest cell without a sink if it holds one.

    Of equally near cells the highest id is taken.
    """
    used = sink_cells.select("cell_id").distinct()
    free = cells.join(used, "cell_id", "left_anti").select("cell_id", "lat", "lng")
    own = F.broadcast(source_cell.select(F.col("cell_id").alias("own")))  # one row
    taken = used.join(own, F.col("cell_id") == F.col("own"), "left_semi").agg((F.count(F.lit(1)) > 0).alias("taken"))
    at = own.join(cells.select(F.col("cell_id").alias("own"), F.col("lat").alias("lat0"), F.col("lng").alias("lng0")), "own")
    km = _rank_km(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("lat0"), F.col("lng0")))
    near = free.join(F.broadcast(at)).agg(F.min(F.struct(km.alias("km"), (-F.col("cell_id")).alias("k"))).alias("b"))
    return own.join(F.broadcast(taken)).join(F.broadcast(near)).select(F.when(F.col("taken"), F.coalesce(-F.col("b.k"), F.col("own"))).otherwise(F.col("own")).alias("cell_id"))


def snapped_links(links: DataFrame, cells: DataFrame, grid: Lattice) -> DataFrame:
    """Links by coordinates (lat1, lng1, lat2, lng2) as links between cells: adds tail and head.

    Equal links stay rows of their own; a link off the grid goes to the cells at its edge.
    """
    held = F.struct(*links.columns).alias("link")
    first = nearest_cell(links.select(held, F.col("lat1").alias("lat"), F.col("lng1").alias("lng")), cells, grid)
    second = nearest_cell(first.select("link", F.col("cell_id").alias("tail"), F.col("link.lat2").alias("lat"), F.col("link.lng2").alias("lng")), cells, grid)
    return second.select("link.*", "tail", F.col("cell_id").alias("head"))


def latest(points: DataFrame) -> DataFrame:
    """The last row by ``ord`` (a source file's last line wins)."""
    return points.agg(F.max_by(F.struct(*points.columns), "ord").alias("p")).filter("p IS NOT NULL").select("p.*")
