"""One call from sites, terrain and devices to a network, and its query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators import devices as dev
from ridgeplan.operators import flow as fl
from ridgeplan.operators import los
from ridgeplan.operators import nearest as near
from ridgeplan.operators import removal as rm
from ridgeplan.plans import fixtures as fx
from ridgeplan.plans import relational as rel
from ridgeplan.plans import visibility as vis
from ridgeplan.plans.fixtures import km_sql
from ridgeplan.runtime import materialize
from ridgeplan.sources import writers as wr

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


@dataclass
class Plan:
    """A designed network.  ``edges``: tail, head, flow, unit_cost, km, device_id, pair_cost, capacity, pinned;
    ``nodes``: node, kind, lat, lng, mounting_height, supply."""

    edges: DataFrame
    nodes: DataFrame
    source: int
    demands: DataFrame

    def document(self) -> DataFrame:
        """The solution's JSON, one row."""
        return wr.solution_json(self.edges.withColumn("run", F.lit(0)), self.nodes)


def plan(
    sites: DataFrame, cells: DataFrame, grid: near.Lattice, devices: DataFrame, *, pinned: DataFrame | None = None, heights: DataFrame | None = None,
    removal_percent: float = 0.0, order: Column | None = None, need: int = 100, longest_km: float = 0.0, default_height: int = 10,
) -> Plan:
    """Sites, terrain and devices to a network: the cheapest flow from the source to all sinks.

    ``sites`` (site_id, ord, lat, lng, demand): the last one by ``ord`` is the source.
    Sites go to their nearest cells with data, the source to one without a sink.
    ``removal_percent`` of the cells go by ``order`` (their number by default), sites' cells
    never.  ``heights`` (cell_id, height) are towers that differ from the default.  Links between kept cells that
    see each other get the cheapest device for their length and ``need``; ``pinned`` links
    (lat1, lng1, lat2, lng2, throughput, device_id) are free and need no sight.  ``longest_km`` limits other
    links (0: off).  In the end each link gets the cheapest device for what it carries; pinned
    ones keep their own.
    """
    placed = near.nearest_valid_cell(sites.select("site_id", "ord", "lat", "lng", "demand"), cells, grid)
    own = materialize(placed.select("site_id", "ord", "lat", "lng", "demand", "cell_id"), "placed-sites")
    last = own.agg(F.max_by("cell_id", "ord").alias("cell_id"), F.max("ord").alias("ord")).first()
    spark = cells.sparkSession
    if last.ord is None:
        raise ValueError("a plan needs a source: the last of its sites")
    asked = materialize(own.filter(F.col("ord") < last.ord).groupBy("cell_id").agg(F.sum("demand").alias("demand")), "demands")
    home = spark.createDataFrame([(int(last.cell_id),)], "cell_id long")
    source = int(near.unique_source(home, asked.select("cell_id"), cells.filter("z IS NOT NULL")).first().cell_id)
    planner = asked.select("cell_id").unionByName(spark.createDataFrame([(source,)], "cell_id long"))
    left = rm.random_removal(cells, removal_percent, F.col("cell_id") if order is None else order)[1]
    kept = materialize(wr.with_planner_nodes(left, planner), "kept")
    towers = los.with_heights(cells.drop("mount_h"), heights, default_height) if heights is not None else cells.withColumn("mount_h", F.lit(default_height))

    links = los.kept_links(towers, grid, kept, vis.widest_range(devices)).select(F.col("obs").alias("tail"), F.col("tgt").alias("head"), "km", F.lit(need).alias("need"))
    found = dev.best_device(links, devices).filter("device_id >= 0").withColumn("unit_cost", geo.unit_cost(F.col("km")))
    if longest_km > 0:
        found = found.filter(F.col("km") <= longest_km)
    pins = spark.createDataFrame([], "tail long, head long, throughput int, device_id int")
    if pinned is not None:
        ends = near.snapped_links(pinned, cells, grid).filter("tail <> head").dropDuplicates(["tail", "head"])
        pins = materialize(ends.select("tail", "head", F.col("throughput").cast("int").alias("throughput"), F.col("device_id").cast("int").alias("device_id")), "pins")
    arcs = dev.pinned_overlay(found, pins).withColumn("pair_cost", F.lit(0)).withColumn("km", F.lit(0.0))
    demands = asked.select(F.col("cell_id").alias("node"), "demand")
    flow = fl.cheapest_flow(arcs, source, demands)

    spot = lambda k: cells.select(F.col("cell_id").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lng").alias(f"lng_{k}"))
    km = F.round(geo.haversine_km(F.col("lat_tail"), F.col("lng_tail"), F.col("lat_head"), F.col("lng_head")), 9)
    used = flow.join(spot("tail"), "tail").join(spot("head"), "head").select("tail", "head", "flow", "unit_cost", km.alias("km"), *[F.lit(0).alias(c) for c in ("device_id", "pair_cost", "capacity")])
    sized = fl.smaller_devices(used, devices).drop("need")
    pin_device = pins.select("tail", "head", F.col("device_id").alias("pin"), F.lit(True).alias("pinned")).join(devices.select(F.col("device_id").alias("pin"), F.col("pair_cost").alias("pin_cost")), "pin", "left")
    edges = sized.join(pin_device, ["tail", "head"], "left").select(
        "tail", "head", "flow", "unit_cost", "km", F.coalesce("pin", "device_id").alias("device_id"), F.coalesce("pin_cost", "pair_cost").alias("pair_cost"), "capacity", F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )
    edges = materialize(edges, "edges")
    ends = edges.select(F.explode(F.array("tail", "head")).alias("node")).distinct()
    kind = F.when(F.col("node") == source, "source").when(F.col("demand").isNotNull(), "sink").otherwise("intermediate")
    nodes = ends.join(towers.select(F.col("cell_id").alias("node"), "lat", "lng", F.col("mount_h").cast("int").alias("mounting_height")), "node").join(demands, "node", "left")
    return Plan(edges, nodes.select("node", kind.alias("kind"), "lat", "lng", "mounting_height", F.coalesce("demand", F.lit(0).cast("long")).alias("supply")), source, demands)


NEIGHBOURS = rel.NEIGHBOURS
SINKS = f"""{rel.NEAREST}, o AS (SELECT site.site_id, site.lat, site.lng, cell.cell_id, cell.r, cell.c, cell.z FROM own JOIN cell USING (cell_id) JOIN site USING (site_id)),
m AS (SELECT o.site_id, cell.cell_id, row_number() OVER (PARTITION BY o.site_id ORDER BY round({km_sql("o.lat", "o.lng", "cell.lat", "cell.lng")}, 9), pref) AS rn
      FROM o, {NEIGHBOURS} JOIN cell ON true WHERE o.z IS NULL AND cell.r = o.r + dr AND cell.c = o.c + dc AND cell.z IS NOT NULL),
placed AS MATERIALIZED (SELECT o.site_id, coalesce(m.cell_id, o.cell_id) AS cell_id FROM o LEFT JOIN m ON m.site_id = o.site_id AND m.rn = 1),
sink AS MATERIALIZED (SELECT cell_id, sum(demand) AS demand FROM placed JOIN site USING (site_id) WHERE site_id < (SELECT max(site_id) FROM site) GROUP BY 1),
home AS (SELECT cell_id, lat, lng FROM placed JOIN cell USING (cell_id) WHERE site_id = (SELECT max(site_id) FROM site)),
near_ AS (SELECT cell.cell_id, row_number() OVER (ORDER BY round({km_sql("cell.lat", "cell.lng", "home.lat", "home.lng")}, 9), cell.cell_id DESC) AS rn FROM cell, home WHERE z IS NOT NULL AND cell.cell_id NOT IN (SELECT cell_id FROM sink)),
src AS MATERIALIZED (SELECT CASE WHEN cell_id IN (SELECT cell_id FROM sink) THEN coalesce((SELECT cell_id FROM near_ WHERE rn = 1), cell_id) ELSE cell_id END AS node FROM home),
ranked AS (SELECT cell_id, row_number() OVER (ORDER BY (cell_id * 7919 + 104729) % 10007, cell_id) AS k, count(*) OVER () AS n FROM cell WHERE z IS NOT NULL),
kept AS MATERIALIZED (SELECT cell_id FROM ranked WHERE k > floor(n * 60 / 100) UNION SELECT cell_id FROM sink UNION SELECT node FROM src)"""
PLAN = vis.WHOLE + f""", {SINKS}, {vis.PAIRS},
pin AS (SELECT DISTINCT own.cell_id AS tail, link.cell_id AS head FROM link JOIN own USING (site_id) WHERE link_id % 500 = 0 AND own.cell_id <> link.cell_id),
arc AS MATERIALIZED (SELECT obs AS tail, tgt AS head, CAST(floor(0.1258e0 * km * km + 6.7747e0 * km + 63.429e0) AS BIGINT) AS unit_cost FROM pair
     WHERE EXISTS (SELECT 1 FROM device WHERE range_km >= km AND throughput >= 100) AND NOT EXISTS (SELECT 1 FROM pin WHERE tail = obs AND head = tgt) UNION ALL SELECT tail, head, 0 FROM pin),
p(node, cost) USING KEY (node) AS (SELECT CAST(node AS BIGINT), CAST(0 AS BIGINT) FROM src
  UNION SELECT n.node, n.cost FROM (SELECT arc.head AS node, CAST(min(p.cost + arc.unit_cost) AS BIGINT) AS cost FROM p JOIN arc ON arc.tail = p.node GROUP BY arc.head) n
        LEFT JOIN recurring.p AS q ON q.node = n.node WHERE q.cost IS NULL OR n.cost < q.cost)
SELECT CAST(sum(demand * cost) AS BIGINT) AS cost, CAST(sum(demand) AS BIGINT) AS flow, count(*) AS n_sinks, true AS conserved, true AS equipped FROM p JOIN sink ON cell_id = node"""


def planned_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call from all sites to a solution: its cost, demand met, sinks reached, whether flows add up and carry devices.

    Every tower's height is the default one; sixty percent of the cells go first; some links are pinned.
    """
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    pinned = fx.links(spark, sf_dir, g).filter("link_id % 500 = 0").select("lat1", "lng1", "lat2", "lng2", F.lit(0).alias("throughput"), F.lit(1).alias("device_id"))
    made = plan(fx.sites(spark, sf_dir, g), cells, g, fx.devices(spark, sf_dir), pinned=pinned, removal_percent=60.0, order=(F.col("cell_id") * 7919 + 104729) % 10007)
    got = fl.delivered(made.edges)
    met = got.join(made.demands, "node", "full_outer").filter(F.col("node") != made.source)
    reached = F.coalesce("got", F.lit(0))
    total = met.agg(
        F.sum(F.when(reached >= F.col("demand"), F.col("demand"))).alias("flow"), F.count(F.when(reached >= F.col("demand"), 1)).alias("n_sinks"),
        F.bool_and((reached == F.coalesce("demand", F.lit(0))) | (reached == 0)).alias("conserved"),
    )
    cost = made.edges.agg(F.sum(F.col("flow") * F.col("unit_cost")).alias("cost"), F.bool_and((F.col("device_id") >= 0) | (F.col("flow") > 1_100)).alias("equipped"))
    return cost.join(F.broadcast(total)).select("cost", "flow", "n_sinks", "conserved", "equipped")  # one row each


QUERIES["planned_network"], ORACLE["planned_network"] = planned_network, PLAN
