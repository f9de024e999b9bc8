"""Planning tables derived from the general test tables, by integer arithmetic.

Every part is a grid cell, every customer a site, every supplier a device and every order
a wish for a link from its customer's site to a cell; whole tables, no row left out.  ``CTE``
holds the same definitions in DuckDB's SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.operators.nearest import Lattice
from ridgeplan.runtime import load

NORTH, WEST, STEP, HEIGHT = 35.3, -106.6, 0.01, 10


def lattice(spark: SparkSession, sf_dir: str) -> Lattice:
    n = load(spark, sf_dir, "part").count()
    side = max(1, math.isqrt(max(0, n - 1)) + 1)
    return Lattice(NORTH, WEST, STEP, -(-n // side), side)


def full_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid that are complete: resampling takes its samples from these."""
    return max(1, load(spark, sf_dir, "part").count() // lattice(spark, sf_dir).n_cols)


def cells(spark: SparkSession, sf_dir: str, grid: Lattice | None = None) -> DataFrame:
    side = (grid or lattice(spark, sf_dir)).n_cols
    key = F.col("p_partkey")
    at = load(spark, sf_dir, "part").select(key, F.floor(key / side).cast("int").alias("r"), (key % side).cast("int").alias("c"))
    relief = 100 + 6 * F.abs(F.col("r") - side // 2) + 4 * F.abs(F.col("c") - side * 7 // 12) + key * 7919 % 5
    return at.select(
        key.alias("cell_id"), "r", "c", (F.lit(NORTH) - F.lit(STEP) * F.col("r")).alias("lat"), (F.lit(WEST) + F.lit(STEP) * F.col("c")).alias("lng"),
        F.when(key % 37 != 36, relief.cast("int")).alias("z"), F.lit(HEIGHT).alias("mount_h"),
    )


def sites(spark: SparkSession, sf_dir: str, grid: Lattice | None = None) -> DataFrame:
    g = grid or lattice(spark, sf_dir)
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.alias("site_id"), (F.lit(NORTH) - (key * 7919 % 1101) / F.lit(1100.0) * (STEP * (g.n_rows - 1))).alias("lat"), (F.lit(WEST) + (key * 104729 % 1103) / F.lit(1102.0) * (STEP * (g.n_cols - 1))).alias("lng"),
        (5 + key % 4).cast("int").alias("demand"), (100 + key % 50).cast("int").alias("revenue"), (10 + key % 3 * 5).cast("int").alias("mounting_height"), key.alias("ord"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        (key + 1).cast("int").alias("device_id"), key.cast("int").alias("ord"), F.col("s_name").alias("name"), (100 + key * 37 % 11 * 100).cast("int").alias("throughput"),
        (2 + key * 5 % 9 * 3).cast("int").alias("range_km"), (90 + key * 211 % 1900).cast("int").alias("pair_cost"), (key % 3 != 0).alias("selected"),
    )


def links(spark: SparkSession, sf_dir: str, grid: Lattice | None = None) -> DataFrame:
    """link_id, site, cell and both ends' coordinates; need is the site's demand times 20."""
    g = grid or lattice(spark, sf_dir)
    n = load(spark, sf_dir, "part").count()
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("site_id"), (F.col("o_orderkey") * 31 % n).alias("cell_id"))
    s = sites(spark, sf_dir, g).select("site_id", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), (F.col("demand") * 20).alias("need"), "demand")
    c = cells(spark, sf_dir, g).select("cell_id", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return orders.join(s, "site_id").join(c, "cell_id")


#: DuckDB's side.  Literals with an exponent are doubles.
CTE = """
size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM part),
grid AS (SELECT n, side AS n_cols, (n + side - 1) // side AS n_rows, greatest(1, n // side) AS full_rows FROM size),
spot AS (SELECT p_partkey AS cell_id, CAST(p_partkey // n_cols AS INTEGER) AS r, CAST(p_partkey % n_cols AS INTEGER) AS c, n_cols FROM part, grid),
cell AS (SELECT cell_id, r, c, 35.3e0 - 0.01e0 * r AS lat, -106.6e0 + 0.01e0 * c AS lng,
                CASE WHEN cell_id % 37 <> 36 THEN CAST(100 + 6 * abs(r - n_cols // 2) + 4 * abs(c - n_cols * 7 // 12) + cell_id * 7919 % 5 AS INTEGER) END AS z, 10 AS mount_h FROM spot),
site AS (SELECT c_custkey AS site_id, 35.3e0 - (c_custkey * 7919 % 1101) / 1100e0 * (0.01e0 * (n_rows - 1)) AS lat, -106.6e0 + (c_custkey * 104729 % 1103) / 1102e0 * (0.01e0 * (n_cols - 1)) AS lng,
                CAST(5 + c_custkey % 4 AS INTEGER) AS demand, CAST(100 + c_custkey % 50 AS INTEGER) AS revenue, CAST(10 + c_custkey % 3 * 5 AS INTEGER) AS mounting_height, c_custkey AS ord FROM customer, grid),
device AS (SELECT CAST(s_suppkey + 1 AS INTEGER) AS device_id, CAST(s_suppkey AS INTEGER) AS ord, s_name AS name, CAST(100 + s_suppkey * 37 % 11 * 100 AS INTEGER) AS throughput,
                  CAST(2 + s_suppkey * 5 % 9 * 3 AS INTEGER) AS range_km, CAST(90 + s_suppkey * 211 % 1900 AS INTEGER) AS pair_cost, s_suppkey % 3 <> 0 AS selected FROM supplier),
link AS (SELECT o_orderkey AS link_id, site_id, cell.cell_id, site.lat AS lat1, site.lng AS lng1, cell.lat AS lat2, cell.lng AS lng2, demand * 20 AS need, demand
         FROM orders JOIN site ON site_id = o_custkey, grid JOIN cell ON true WHERE cell.cell_id = o_orderkey * 31 % grid.n)"""


def km_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2)"
    return f"(2 * 6371e0 * asin(sqrt({a})))"
