"""Queries of the graph and removal operators, over whole grids and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators import graph as gp
from ridgeplan.operators import los
from ridgeplan.operators import removal as rm
from ridgeplan.plans import fixtures as fx
from ridgeplan.plans import visibility as vis
from ridgeplan.plans.fixtures import CTE, km_sql
from ridgeplan.runtime import load, materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def area_sql(width: int) -> str:
    return f"""WITH RECURSIVE {CTE}, g AS MATERIALIZED (SELECT cell_id, r, c, CAST(z // {width} AS INTEGER) AS bucket FROM cell WHERE z IS NOT NULL),
e AS MATERIALIZED (SELECT a.cell_id AS a, b.cell_id AS b FROM g a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS s(dr, dc) JOIN g b ON true WHERE b.r = a.r + dr AND b.c = a.c + dc AND a.bucket = b.bucket),
w AS (SELECT cell_id AS x, cell_id AS low FROM g UNION SELECT e.b, w.low FROM w JOIN e ON e.a = w.x WHERE w.low < e.b),
area AS (SELECT g.cell_id, r, c, bucket, min(low) AS area_id FROM g JOIN w ON w.x = g.cell_id GROUP BY g.cell_id, r, c, bucket)"""


@query(area_sql(10) + " SELECT cell_id, bucket, area_id FROM area")
def elevation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: connected areas of equal ten-metre bucket."""
    return gp.elevation_areas(fx.cells(spark, sf_dir)).select("cell_id", "bucket", "area_id")


@query(area_sql(10) + """ SELECT DISTINCT a.area_id, b.area_id AS parent_area_id FROM area a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS s(dr, dc) JOIN area b ON true WHERE b.r = a.r + dr AND b.c = a.c + dc AND b.bucket = a.bucket + 1""")
def area_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas one bucket higher next to each area."""
    return gp.area_parents(materialize(gp.elevation_areas(fx.cells(spark, sf_dir)), "areas"))


def _order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected sites graph: a site is linked with the site of the next order of its nation's customers."""
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey", "o_orderpriority", "o_orderstatus", F.date_trunc("month", "o_orderdate")).orderBy("o_orderkey")
    return orders.select(F.col("o_custkey").alias("a"), F.lead("o_custkey").over(w).alias("b"), F.col("o_orderkey").alias("edge_id")).filter("b IS NOT NULL AND a <> b")


ORDER_GRAPH = """eg AS MATERIALIZED (SELECT a, b, edge_id FROM (SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY c_nationkey, o_orderpriority, o_orderstatus, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS b, o_orderkey AS edge_id FROM orders JOIN customer ON o_custkey = c_custkey) WHERE b IS NOT NULL AND a <> b),
both_ AS MATERIALIZED (SELECT a, b FROM eg UNION SELECT b, a FROM eg)"""


@query(f"""WITH RECURSIVE {ORDER_GRAPH}, w AS (SELECT c_custkey AS x, c_custkey AS low FROM customer UNION SELECT b, low FROM w JOIN both_ ON a = x WHERE low < b),
m AS (SELECT x AS node, min(low) AS component FROM w GROUP BY x) SELECT node, component FROM m""")
def site_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the sites' graph; a site alone is its own."""
    comps = gp.connected_components(_order_graph(spark, sf_dir).select("a", "b"))
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query(f"""WITH RECURSIVE {ORDER_GRAPH}, w AS (SELECT c_custkey AS x, c_custkey AS low FROM customer UNION SELECT b, low FROM w JOIN both_ ON a = x WHERE low < b),
m AS MATERIALIZED (SELECT x AS node, min(low) AS component FROM w GROUP BY x),
t(node, level) USING KEY (node) AS (SELECT node, 0 FROM m WHERE node = component UNION SELECT n.node, n.level FROM (SELECT b AS node, CAST(min(level + 1) AS INTEGER) AS level FROM t JOIN both_ ON a = t.node GROUP BY b) n
  LEFT JOIN recurring.t AS q ON q.node = n.node WHERE q.level IS NULL OR n.level < q.level),
l AS MATERIALIZED (SELECT node, level FROM t)
SELECT l.node, m.component, l.level, (SELECT min(p.node) FROM both_ JOIN l p ON p.node = both_.a WHERE both_.b = l.node AND p.level = l.level - 1) AS parent FROM l JOIN m USING (node)""")
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first trees of the sites' graph."""
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return gp.spanning_tree(_order_graph(spark, sf_dir).select("a", "b"), nodes)


@query(f"""WITH RECURSIVE {ORDER_GRAPH},
we AS MATERIALIZED (SELECT a, b, min(edge_id % 97 + 1) AS w FROM (SELECT a, b, edge_id FROM eg UNION ALL SELECT b, a, edge_id FROM eg) GROUP BY a, b),
p(source, node, cost) USING KEY (source, node) AS (SELECT CAST(s_suppkey AS BIGINT), CAST(s_suppkey AS BIGINT), CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey IN (SELECT a FROM we)
  UNION SELECT n.source, n.node, n.cost FROM (SELECT p.source, we.b AS node, CAST(min(p.cost + we.w * 1000000 + 1) AS BIGINT) AS cost FROM p JOIN we ON we.a = p.node GROUP BY p.source, we.b) n
        LEFT JOIN recurring.p AS q ON q.source = n.source AND q.node = n.node WHERE q.cost IS NULL OR n.cost < q.cost),
far AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cost // 1000000 DESC, node) AS rn FROM p)
SELECT source, node, cost // 1000000 AS dist, cost % 1000000 AS hops FROM far WHERE rn = 1""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farthest site, distance and hops from every supplier's namesake site."""
    edges = _weighted(spark, sf_dir)
    sources = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return gp.shortest_paths(edges, sources, last_only=True).select("source", "node", F.col("dist").cast("long").alias("dist"), "hops")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _order_graph(spark, sf_dir)
    ends = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("edge_id") % 97 + 1).alias("w"))
    return materialize(ends.groupBy("a", "b").agg(F.min("w").alias("w")), "edges")


@query(f"""WITH RECURSIVE {ORDER_GRAPH}, h(node, hops) USING KEY (node) AS (SELECT 0::BIGINT, 0::BIGINT WHERE EXISTS (SELECT 1 FROM both_ WHERE a = 0) UNION SELECT n.node, n.hops FROM (SELECT b AS node, CAST(min(hops + 1) AS BIGINT) AS hops FROM h JOIN both_ ON a = h.node GROUP BY b) n
  LEFT JOIN recurring.h AS q ON q.node = n.node WHERE q.hops IS NULL OR n.hops < q.hops)
SELECT node, hops FROM h""")
def shortest_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the first site to all sites in reach."""
    edges = _order_graph(spark, sf_dir).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("w", F.lit(1))
    source = spark.range(1).select(F.col("id").alias("node"))
    return gp.shortest_paths(materialize(edges, "edges"), source).select("node", "hops")


@query(f"""WITH {ORDER_GRAPH}, n AS (SELECT c_custkey AS node FROM customer)
SELECT node, (SELECT count(*) FROM eg WHERE b = node) AS n_in, (SELECT count(*) FROM eg WHERE a = node) AS n_out FROM n""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in and out of every site."""
    edges = _order_graph(spark, sf_dir).select(F.col("a").alias("tail"), F.col("b").alias("head"))
    return gp.degrees(edges, load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")))


TREE = "ends AS (SELECT l_partkey % (SELECT count(*) FROM customer) AS a, l_orderkey % (SELECT count(*) FROM customer) AS b FROM lineitem), edge AS MATERIALIZED (SELECT least(a, b) AS tail, greatest(a, b) AS head FROM ends WHERE a <> b)"


def _line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges from lower to higher site numbers, made from the line items."""
    n = load(spark, sf_dir, "customer").count()
    a, b = F.col("l_partkey") % n, F.col("l_orderkey") % n
    return load(spark, sf_dir, "lineitem").select(F.least(a, b).alias("tail"), F.greatest(a, b).alias("head")).filter("tail <> head")


@query(f"WITH {TREE} SELECT DISTINCT tail, head FROM edge WHERE head NOT IN (SELECT tail FROM edge)")
def leaf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose head starts no edge."""
    return gp.leaf_edges(_line_edges(spark, sf_dir).distinct())


@query(f"""WITH RECURSIVE {TREE}, d AS MATERIALIZED (SELECT DISTINCT tail, head FROM edge), fixed AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < 0),
gone AS (SELECT c_custkey AS node FROM customer WHERE c_custkey = (SELECT max(c_custkey) - 2 FROM customer) UNION SELECT head FROM gone JOIN d ON tail = node WHERE head NOT IN (SELECT node FROM fixed)),
l0 AS MATERIALIZED (SELECT * FROM d WHERE tail NOT IN (SELECT node FROM gone) AND head NOT IN (SELECT node FROM gone)),
keep AS (SELECT tail, head FROM l0 WHERE head IN (SELECT node FROM fixed) OR head NOT IN (SELECT tail FROM d) UNION SELECT l0.tail, l0.head FROM keep JOIN l0 ON l0.head = keep.tail)
SELECT tail, head FROM keep""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete a node with all that hangs on it."""
    customers = load(spark, sf_dir, "customer")
    fixed = customers.filter("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    start = customers.agg((F.max("c_custkey") - 2).alias("node"))
    return gp.cascade_delete(_line_edges(spark, sf_dir).distinct(), fixed, start)


@query(f"""WITH RECURSIVE {CTE}, p AS MATERIALIZED (SELECT a.site_id AS a, b.site_id AS b FROM site a JOIN site b ON a.site_id <> b.site_id AND abs(a.lat - b.lat) < 0.02e0 WHERE {km_sql("a.lat", "a.lng", "b.lat", "b.lng")} * 1000 <= 500),
w AS (SELECT site_id AS x, site_id AS low FROM site UNION SELECT b, low FROM w JOIN p ON a = x WHERE low < b)
SELECT x AS site_id, min(low) AS cluster FROM w GROUP BY x""")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites chained by steps of at most 500 m."""
    return gp.density_clusters(fx.sites(spark, sf_dir).select("site_id", "lat", "lng"), 500.0)


@query(f"""WITH {CTE}, s AS (SELECT site_id, lat, lng, demand, revenue, site_id % 25 AS cluster FROM site),
m AS (SELECT cluster, avg(cos(radians(lat)) * cos(radians(lng))) AS x, avg(cos(radians(lat)) * sin(radians(lng))) AS y, avg(sin(radians(lat))) AS z FROM s GROUP BY cluster),
c AS (SELECT cluster, degrees(atan2(z, sqrt(x * x + y * y))) AS lat0, degrees(atan2(y, x)) AS lng0 FROM m)
SELECT s.cluster, sum(demand)::BIGINT AS demand, sum(revenue)::BIGINT AS revenue, count(*) AS n, arg_min(site_id, (round({km_sql("lat", "lng", "lat0", "lng0")}, 9), site_id)) AS centre_member FROM s JOIN c USING (cluster) GROUP BY s.cluster""")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters merged to sums and their centre-most member."""
    sites = fx.sites(spark, sf_dir).withColumn("cluster", F.col("site_id") % 25)
    return rm.merged_clusters(sites, "cluster", "site_id")


@query(f"""WITH {CTE}, s AS (SELECT lat, lng, site_id % 25 AS cluster FROM site),
m AS (SELECT cluster, avg(cos(radians(lat)) * cos(radians(lng))) AS x, avg(cos(radians(lat)) * sin(radians(lng))) AS y, avg(sin(radians(lat))) AS z FROM s GROUP BY cluster),
c AS (SELECT cluster, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lng FROM m),
l AS (SELECT *, lag(lat) OVER (ORDER BY cluster) AS lat0, lag(lng) OVER (ORDER BY cluster) AS lng0 FROM c)
SELECT CAST(round(min({km_sql("lat", "lng", "lat0", "lng0")}) * 0.6e0 * 1000) AS BIGINT) AS gap_m FROM l""")
def least_centroid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of consecutive centroids, times the trade-off."""
    centres = rm.centroid(fx.sites(spark, sf_dir).withColumn("cluster", F.col("site_id") % 25), "cluster").withColumnRenamed("cluster", "ord")
    return rm.least_step(centres).select(F.round(F.col("gap") * 1000).cast("long").alias("gap_m"))


@query(f"""WITH {CTE}, o AS (SELECT cell_id, row_number() OVER (ORDER BY (cell_id * 7919 + 104729) % 10007, cell_id) AS k, count(*) OVER () AS n FROM cell WHERE z IS NOT NULL)
SELECT cell_id FROM o WHERE k > floor(n * 60 / 100)""")
def random_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells kept after 60 percent went, in a repeatable order."""
    return rm.random_removal(fx.cells(spark, sf_dir), 60.0, (F.col("cell_id") * 7919 + 104729) % 10007)[1]


@query(f"""WITH {CTE}, a AS (SELECT cell_id, cell_id % 7 AS area_id, count(*) OVER (PARTITION BY cell_id % 7) AS n, row_number() OVER (PARTITION BY cell_id % 7 ORDER BY (cell_id * 7919 + 104729) % 10007, cell_id) AS rn FROM cell)
SELECT area_id, cell_id FROM a WHERE rn <= CASE WHEN n > 300 THEN 300 WHEN n > 200 THEN 200 WHEN n > 100 THEN 100 ELSE n END""")
def area_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large areas sampled down by the fixed steps."""
    areas = fx.cells(spark, sf_dir).select("cell_id", (F.col("cell_id") % 7).alias("area_id"))
    return rm.area_sample(areas, 100, (F.col("cell_id") * 7919 + 104729) % 10007).select("area_id", "cell_id")


@query()
def elevation_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept cells per elevation bucket of the whole grid, by the union of viewsheds."""
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    buckets = cells.filter("z IS NOT NULL").select("cell_id", geo.elevation_bucket(F.col("z")).alias("bucket"))
    return rm.viewed_removal(cells, g.n_rows, g.n_cols, buckets, 90.0)


@query()
def whole_map_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what the subsets see of the whole map."""
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    buckets = cells.filter("z IS NOT NULL").select("cell_id", geo.elevation_bucket(F.col("z")).alias("bucket"))
    return rm.viewed_removal(cells, g.n_rows, g.n_cols, buckets, 95.0, scope="map")


@query()
def cluster_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept cells per elevation area by clusters and spaced picks, from the highest areas down."""
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    areas = materialize(gp.elevation_areas(cells, 100), "areas")
    sample = materialize(rm.area_sample(areas, 100, (F.col("cell_id") * 7919 + 104729) % 10007).join(cells.select("cell_id", "lat", "lng"), "cell_id"), "sample")
    bits = materialize(los.visible_bits(cells, g.n_rows, g.n_cols, observers=cells.join(sample.select("cell_id"), "cell_id", "left_semi")).select("obs", "bits"), "bits")
    return rm.remove_from_above(sample, areas, gp.area_parents(areas), bits, g.n_rows * g.n_cols, 90.0)


@query(vis.WHOLE + """, ar AS (SELECT cell_id, CAST(z // 100 AS INTEGER) AS area_id FROM cell WHERE z IS NOT NULL)
SELECT a.cell_id, count(v.tgt) AS n_all, count(CASE WHEN a.area_id = b.area_id THEN 1 END) AS n_area, count(CASE WHEN b.area_id = a.area_id + 1 AND v.tgt % 2 = 0 THEN 1 END) AS n_parent
FROM ar a LEFT JOIN visible v ON a.cell_id = v.obs LEFT JOIN ar b ON b.cell_id = v.tgt GROUP BY a.cell_id""")
def parent_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: cells seen in all, in the same bucket and among the even cells one bucket higher."""
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    areas = cells.filter("z IS NOT NULL").select("cell_id", geo.elevation_bucket(F.col("z"), 100).cast("long").alias("area_id"))
    above = {int(r.area_id): (int(r.area_id) + 1,) for r in areas.select("area_id").distinct().collect()}  # a few hundred-metre buckets
    alive = los.cell_flags(areas.filter("cell_id % 2 = 0"), g.n_rows * g.n_cols)
    return los.looked_counts(cells, g.n_rows, g.n_cols, rm.area_array(areas, g.n_rows * g.n_cols), above, alive)


@query(f"""WITH {CTE}, s AS (SELECT site_id, site_id % 25 AS cluster, demand, revenue FROM site) SELECT site_id, row_number() OVER (PARTITION BY cluster ORDER BY demand DESC, revenue DESC, site_id)::INTEGER AS rank FROM s""")
def ranked_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank in the cluster by two keys, best first."""
    rows = fx.sites(spark, sf_dir).select(F.col("site_id").alias("cell_id"), F.lit(0).alias("area_id"), (F.col("site_id") % 25).alias("cluster"), F.col("demand").alias("n_parent"), F.col("revenue").alias("n_all"))
    return rm.ranked_in_cluster(rows).select(F.col("cell_id").alias("site_id"), "rank")


@query(f"""WITH {CTE}, p AS (SELECT link_id, CAST(least(greatest(floor((35.3e0 - lat1) / 0.01e0 + 0.5e0), 0), n_rows - 1) AS INTEGER) AS r1, CAST(least(greatest(floor((lng1 - -106.6e0) / 0.01e0 + 0.5e0), 0), n_cols - 1) AS INTEGER) AS c1, cell.r AS r2, cell.c AS c2
FROM link JOIN cell USING (cell_id), grid), ends AS (SELECT *, abs(c2 - c1) > abs(r2 - r1) AS steep FROM p),
line AS (SELECT *, CASE WHEN steep THEN c1 ELSE r1 END AS x1, CASE WHEN steep THEN r1 ELSE c1 END AS y1, CASE WHEN steep THEN c2 ELSE r2 END AS x2, CASE WHEN steep THEN r2 ELSE c2 END AS y2 FROM ends),
asc_ AS (SELECT *, least(x1, x2) AS xa, greatest(x1, x2) AS xb, CASE WHEN x1 > x2 THEN y2 ELSE y1 END AS ya, CASE WHEN x1 > x2 THEN y1 ELSE y2 END AS yb FROM line WHERE x1 <> x2),
step AS (SELECT *, unnest(generate_series(0, xb - xa - 1)) AS k FROM asc_),
spot_ AS (SELECT link_id, steep, xa + k AS x, ya + CASE WHEN ya < yb THEN 1 ELSE -1 END * ((2 * k * abs(yb - ya) + (xb - xa) - 1) // (2 * (xb - xa))) AS y FROM step),
b AS (SELECT link_id, z // 100 AS bucket FROM spot_ JOIN cell ON cell.r = CASE WHEN steep THEN y ELSE x END AND cell.c = CASE WHEN steep THEN x ELSE y END WHERE z IS NOT NULL)
SELECT link_id FROM b GROUP BY link_id HAVING min(bucket) = max(bucket)""")
def edges_in_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose line, in any direction, stays in one elevation bucket of 100 m."""
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    r, c = g.near(F.col("lat1"), F.col("lng1"))
    edges = fx.links(spark, sf_dir, g).join(cells.select("cell_id", F.col("r").alias("r2"), F.col("c").alias("c2")), "cell_id").select("link_id", r.alias("r1"), c.alias("c1"), "r2", "c2")
    ground = cells.filter("z IS NOT NULL").select("r", "c", "z")
    on_line = los.ray_steps(edges).join(ground, ["r", "c"]).select(F.col("link_id").alias("edge_id"), geo.elevation_bucket(F.col("z"), 100).alias("bucket"))
    return rm.stays_in_bucket(edges.select(F.col("link_id").alias("edge_id")), on_line).select(F.col("edge_id").alias("link_id"))


@query(f"WITH {ORDER_GRAPH}, n AS (SELECT c_custkey AS node, c_acctbal < 0 AS fixed FROM customer) SELECT node FROM n WHERE fixed OR node IN (SELECT a FROM both_)")
def without_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate nodes without any link are dropped."""
    edges = _order_graph(spark, sf_dir).select(F.col("a").alias("tail"), F.col("b").alias("head"))
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") < 0).alias("fixed"))
    return gp.without_isolated(nodes, edges).select("node")


DIST = """we AS MATERIALIZED (SELECT a, b, min(edge_id % 97 + 1) AS w FROM (SELECT a, b, edge_id FROM eg UNION ALL SELECT b, a, edge_id FROM eg) GROUP BY a, b)"""


@query(f"""WITH RECURSIVE {ORDER_GRAPH}, {DIST},
p(source, node, cost) USING KEY (source, node) AS (SELECT CAST(s_suppkey AS BIGINT), CAST(s_suppkey AS BIGINT), CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey IN (SELECT a FROM we)
  UNION SELECT n.source, n.node, n.cost FROM (SELECT p.source, we.b AS node, CAST(min(p.cost + we.w) AS BIGINT) AS cost FROM p JOIN we ON we.a = p.node GROUP BY p.source, we.b) n
        LEFT JOIN recurring.p AS q ON q.source = n.source AND q.node = n.node WHERE q.cost IS NULL OR n.cost < q.cost)
SELECT source AS u, node AS v, cost AS d FROM p""")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distances from every supplier's namesake site, in rows."""
    sources = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    paths = gp.shortest_paths(_weighted(spark, sf_dir), sources)
    return paths.select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").cast("long").alias("d"))
