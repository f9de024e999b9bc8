"""Devices: the cheapest feasible one per link, costs and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators.graph import join_counted

#: Largest catalogue that travels with each row's plan as an array.
MOST_DEVICES = 100_000


def catalogue(devices: DataFrame) -> DataFrame:
    """One row: the devices that no other device beats, cheapest first.

    A device is beaten by a cheaper one (or an equally dear one earlier in file order) with at
    least its range and throughput.  Devices are taken from the cheapest on and compared
    with those that are left so far: a staircase, which stays small for any catalogue.
    """
    n = devices.count()
    if n > MOST_DEVICES:
        raise ValueError(f"{n} devices; a catalogue of at most {MOST_DEVICES} is expected")
    ranked = devices.select(F.struct(F.col("pair_cost").alias("cost"), "ord", "device_id", "throughput", "range_km").alias("d"))
    listed = ranked.agg(F.sort_array(F.collect_list("d")).alias("all"))
    beaten = lambda left, d: F.exists(left, lambda o: (o["range_km"] >= d["range_km"]) & (o["throughput"] >= d["throughput"]))
    none = F.filter("all", lambda d: F.lit(False))
    return listed.select(F.aggregate("all", none, lambda left, d: F.when(beaten(left, d), left).otherwise(F.concat(left, F.array(d)))).alias("devices"))


def best_device(links: DataFrame, devices: DataFrame, km: str = "km", need: str = "need") -> DataFrame:
    """Links with the cheapest device whose range and throughput suffice (first in file order on ties).

    Adds device_id (-1: none), pair_cost, capacity.  No join per device: each row scans the
    small staircase of undominated devices, from the cheapest on.
    """
    fits = lambda d: (d["range_km"] >= F.col(km)) & (d["throughput"] >= F.col(need))
    met = links.join(F.broadcast(catalogue(devices)))  # one row
    chosen = met.withColumn("d", F.try_element_at(F.filter("devices", fits), F.lit(1)))
    return chosen.select(*links.columns, F.coalesce("d.device_id", F.lit(-1)).alias("device_id"), F.coalesce("d.cost", F.lit(0)).alias("pair_cost"), F.coalesce("d.throughput", F.lit(0)).alias("capacity"))


def device_usage(edges: DataFrame, devices: DataFrame) -> DataFrame:
    """device_id, name, n_links, total_cost of the devices in use; unknown devices are dropped."""
    used = edges.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_links"))
    return used.join(devices.select("device_id", "name", "pair_cost"), "device_id").select("device_id", "name", "n_links", (F.col("n_links") * F.col("pair_cost")).alias("total_cost"))


def solution_costs(edges: DataFrame) -> DataFrame:
    """One row: unit cost, cost by length and device cost, per used arc and not per unit of flow."""
    return edges.filter("flow > 0").agg(
        F.sum("unit_cost").alias("unit_cost"), F.round(F.sum(geo.link_cost(F.col("km")))).cast("long").alias("link_cost"), F.sum("pair_cost").cast("long").alias("equipment_cost"), F.count(F.lit(1)).alias("n_edges"),
    )


def equipment_cost(edges: DataFrame, pinned: DataFrame, devices: DataFrame) -> DataFrame:
    """One row: device costs of the used arcs (flow over zero); a pinned arc has its own device's cost.

    A pinned link without a known device keeps the cost of the arc.
    """
    own = pinned.select("tail", "head", F.col("device_id").alias("pin")).dropDuplicates(["tail", "head"]).join(devices.select(F.col("device_id").alias("pin"), F.col("pair_cost").alias("pin_cost")), "pin", "left").drop("pin")
    met = edges.filter("flow > 0").join(own, ["tail", "head"], "left")
    return met.agg(F.sum(F.coalesce("pin_cost", "pair_cost")).cast("long").alias("equipment_cost"), F.count("pin_cost").alias("n_pinned"))


def pinned_overlay(arcs: DataFrame, pinned: DataFrame, unlimited: int = 2**31 - 1) -> DataFrame:
    """Candidate arcs with pinned ones in their place: cost 0, own capacity (0: unlimited), seen or not."""
    capacity = F.when(F.col("throughput") == 0, unlimited).otherwise(F.col("throughput")).alias("capacity")
    fixed = pinned.select("tail", "head", F.lit(0).cast("long").alias("unit_cost"), capacity, "device_id", F.lit(True).alias("pinned"))
    free = join_counted(arcs, pinned.select("tail", "head").distinct(), ["tail", "head"], "left_anti")  # few pins: no arc is exchanged
    return free.select("tail", "head", "unit_cost", "capacity", "device_id", F.lit(False).alias("pinned")).unionByName(fixed)


def job_devices(devices: DataFrame, used: DataFrame) -> DataFrame:
    """The master catalogue with ``selected``: whether the job uses the device."""
    flag = used.select("device_id").distinct().withColumn("selected", F.lit(True))
    return devices.drop("selected").join(flag, "device_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
