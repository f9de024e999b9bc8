"""Queries that write planner files, read them again, and handle jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators import devices as dev
from ridgeplan.operators import flow as fl
from ridgeplan.operators import grid as gr
from ridgeplan.operators import jobs as jb
from ridgeplan.operators import los
from ridgeplan.operators import nearest as near
from ridgeplan.plans import fixtures as fx
from ridgeplan.plans import relational as rel
from ridgeplan.plans import visibility as vis
from ridgeplan.plans.fixtures import CTE
from ridgeplan.runtime import load, materialize, new_path
from ridgeplan.sources import readers as rd
from ridgeplan.sources import writers as wr

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {CTE}\n{sql}"
        return f

    return put


@query("SELECT ord, CAST(round(lat * 1e6) AS BIGINT) AS lat_e6, CAST(round(lng * 1e6) AS BIGINT) AS lng_e6, demand, revenue, mounting_height FROM site")
def sink_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web job's site file with the source as its last row, written and read again."""
    path, sites = new_path(spark, "sinks"), fx.sites(spark, sf_dir)
    wr.write_csv(wr.job_rows(sites, sites.orderBy(F.desc("ord")).limit(1)), path, ["part", "ord"], ["lat", "lng", "demand", "revenue", "mounting_height"])
    got = rd.read_sinks(spark, path, last_row_is_source=True)
    return got.select("ord", F.round(F.col("lat") * 1e6).cast("long").alias("lat_e6"), F.round(F.col("lng") * 1e6).cast("long").alias("lng_e6"), "demand", "revenue", "mounting_height")


@query("SELECT CAST(round(lat * 1e6) AS BIGINT) AS lat_e6, mounting_height FROM site WHERE ord = (SELECT max(ord) FROM site)")
def source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of a source file counts."""
    path = new_path(spark, "source")
    wr.write_csv(fx.sites(spark, sf_dir), path, ["ord"], ["lat", "lng", "mounting_height"])
    return rd.read_source(spark, path).select(F.round(F.col("lat") * 1e6).cast("long").alias("lat_e6"), "mounting_height")


@query(f"WITH {CTE}, {rel.BEST} SELECT link_id AS ord, CAST(device_id AS INTEGER) AS device_id, CAST(pair_cost AS INTEGER) AS pair_cost FROM best")
def pinned_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned links with device columns, written and read again."""
    path = new_path(spark, "pinned")
    rows = dev.best_device(fx.links(spark, sf_dir).withColumn("km", rel.link_km()), fx.devices(spark, sf_dir)).withColumn("throughput", F.col("capacity").cast("double")).withColumn("range_km", F.lit(0.0))
    wr.write_csv(rows, path, ["link_id"], ["lat1", "lng1", "lat2", "lng2", "throughput", "range_km", "pair_cost", "device_id"])
    return rd.read_pinned_links(spark, path).select("ord", "device_id", "pair_cost")


@query("SELECT device_id, ord, name, throughput, range_km, pair_cost, selected FROM device")
def device_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's device file of any number of rows."""
    path = new_path(spark, "devices")
    wr.write_csv(fx.devices(spark, sf_dir), path, ["ord"], ["name", "throughput", "range_km", "pair_cost", "device_id", "selected"])
    return rd.read_devices(spark, path)


@query("SELECT device_id, ord, name, throughput, range_km, pair_cost FROM device")
def master_device_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master catalogue's other column order."""
    path = new_path(spark, "master")
    wr.write_csv(fx.devices(spark, sf_dir), path, ["ord"], ["device_id", "name", "throughput", "range_km", "pair_cost"])
    return rd.read_master_devices(spark, path).drop("selected")


@query("SELECT cell_id, r, c, z FROM cell")
def ascii_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as an ASCII raster, written and read again."""
    g, path = fx.lattice(spark, sf_dir), new_path(spark, "grid")
    cells = fx.cells(spark, sf_dir, g)
    wr.write_aaigrid(cells, path, n_rows=g.n_rows, n_cols=g.n_cols, xll=fx.WEST, yll=fx.NORTH - fx.STEP * g.n_rows, dx=fx.STEP, dy=fx.STEP)
    meta, got = rd.read_aaigrid(spark, path)
    return got.select("cell_id", "r", "c", "z")


@query("SELECT cell_id, CAST(round(lat * 1e6) AS BIGINT) AS lat_e6, CAST(round(lng * 1e6) AS BIGINT) AS lng_e6 FROM cell")
def index_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells' coordinates in a file numbered from 1."""
    path = new_path(spark, "mapping")
    fx.cells(spark, sf_dir).select("lng", "lat", (F.col("cell_id") + 1).alias("cat")).write.csv(path, sep="|")
    return rd.read_index_mapping(spark, path).select("cell_id", F.round(F.col("lat") * 1e6).cast("long").alias("lat_e6"), F.round(F.col("lng") * 1e6).cast("long").alias("lng_e6"))


@query(f"WITH {CTE}, {rel.NEAREST} SELECT own.cell_id, CAST(sum(demand) AS BIGINT) AS demand, max(mounting_height) AS mounting_height FROM own JOIN site USING (site_id) GROUP BY 1")
def planner_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner JSON of all sites, written and read again; equal cells add up."""
    g, path = fx.lattice(spark, sf_dir), new_path(spark, "planner")
    own = near.nearest_cell(fx.sites(spark, sf_dir, g), fx.cells(spark, sf_dir, g), g)
    source = own.orderBy(F.desc("ord")).limit(1)
    wr.planner_json(own, source).select(F.col("json").alias("value")).write.text(path)
    return rd.read_planner_nodes(spark, path)[1]


@query(vis.WHOLE + " SELECT obs, count(*) AS n, CAST(sum(tgt) AS BIGINT) AS sum_tgt FROM visible GROUP BY obs")
def bit_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visibility of the whole grid as one bit matrix, written and read again."""
    g, folder = fx.lattice(spark, sf_dir), new_path(spark, "matrix")
    n = g.n_rows * g.n_cols
    wr.write_bit_matrix(materialize(los.visible_bits(fx.cells(spark, sf_dir, g), g.n_rows, g.n_cols), "bits"), n, folder)
    return rd.read_matrix_digest(spark, folder, n)


@query("SELECT c.r, c.c, CAST(CASE WHEN c.z BETWEEN -1000 AND 10000 THEN c.z END AS INTEGER) AS z FROM cell c")
def hgt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as an elevation tile of big-endian samples, written and read again."""
    g, folder = fx.lattice(spark, sf_dir), new_path(spark, "tile")
    wr.write_hgt(fx.cells(spark, sf_dir, g), max(g.n_cols, 2), folder, "N35W107")
    whole = F.col("r") * g.n_cols + F.col("c") < load(spark, sf_dir, "part").count()  # the last row may be incomplete
    return rd.read_hgt(spark, folder).filter(whole).select("r", "c", "z")


@query("""WITH t AS (SELECT 'T' || (p_partkey % 400) AS tile, p_size FROM part), f AS (SELECT tile, min('fine/' || tile) AS path FROM t WHERE p_size > 45 GROUP BY 1), c AS (SELECT tile, min('coarse/' || tile) AS path FROM t GROUP BY 1)
SELECT tile, coalesce(f.path, c.path) AS path FROM f FULL JOIN c USING (tile)""")
def preferred_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finer of two catalogues where it has the tile."""
    tiles = load(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.col("p_partkey") % 400).alias("tile"), "p_size")
    fine = tiles.filter("p_size > 45").select("tile").distinct().withColumn("path", F.concat(F.lit("fine/"), "tile"))
    return rd.preferred_tiles(fine, tiles.select("tile").distinct().withColumn("path", F.concat(F.lit("coarse/"), "tile")))


@query("SELECT cell_id, CAST(round(lat * 1e6) AS BIGINT) AS lat_e6 FROM cell WHERE cell_id % 4 = 0 OR cell_id % 9 = 0")
def kept_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and planner cells as a list, read again with coordinates."""
    path, cells = new_path(spark, "kept"), fx.cells(spark, sf_dir)
    both = wr.with_planner_nodes(cells.filter("cell_id % 4 = 0"), cells.filter("cell_id % 9 = 0"))
    wr.write_kept(both, path)
    return wr.kept_with_coordinates(rd.read_kept(spark, path, cells), cells).select("cell_id", F.round(F.col("lat") * 1e6).cast("long").alias("lat_e6"))


@query(f"""WITH {CTE}, {rel.BEST}, e AS (SELECT CAST(link_id % 10 AS BIGINT) AS run, link.site_id AS tail, link.cell_id AS head, device_id, best.pair_cost, CAST(floor(0.1258e0 * km * km + 6.7747e0 * km + 63.429e0) AS BIGINT) AS unit_cost FROM best JOIN link USING (link_id)),
n AS (SELECT run, count(*) AS n_nodes, sum(mount_h) AS heights FROM (SELECT run, tail AS cell_id FROM e UNION SELECT run, head FROM e) JOIN cell USING (cell_id) GROUP BY run)
SELECT run, count(*) AS n_edges, max(n_nodes) AS n_nodes, CAST(sum(pair_cost) AS BIGINT) AS equipment, CAST(sum(unit_cost) AS BIGINT) AS costs, CAST(sum(pair_cost) AS BIGINT) AS device_cost, CAST(sum(head + 1) AS BIGINT) AS sum_heads, CAST(max(heights) AS BIGINT) AS sum_heights FROM e JOIN n USING (run) GROUP BY run""")
def solution_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: solution JSON per run, written and parsed again."""
    best = dev.best_device(fx.links(spark, sf_dir).withColumn("km", rel.link_km()), fx.devices(spark, sf_dir))
    edges = best.select((F.col("link_id") % 10).alias("run"), F.col("site_id").alias("tail"), F.col("cell_id").alias("head"), F.lit(1).alias("flow"), geo.unit_cost(F.col("km")).alias("unit_cost"), "device_id", "pair_cost", "km")
    nodes = fx.cells(spark, sf_dir).select(F.col("cell_id").alias("node"), F.lit("intermediate").alias("kind"), "lat", "lng", F.col("mount_h").alias("mounting_height"))
    path = new_path(spark, "solutions")
    wr.write_solution(edges, nodes, path)
    listed, ends, totals = rd.read_solution(spark, path)
    count = F.count(F.lit(1))
    e = listed.groupBy("run").agg(count.alias("n_edges"), F.sum("edge.edgeProperty.deviceCost").alias("device_cost"), F.sum(F.col("edge.nodes")[1]).alias("sum_heads"))
    n = ends.groupBy("run").agg(count.alias("n_nodes"), F.sum("node.nodeProperty.mountingHeight").alias("sum_heights"))
    return e.join(n, "run").join(totals, "run").select("run", "n_edges", "n_nodes", F.col("equipmentCost").alias("equipment"), "costs", "device_cost", "sum_heads", "sum_heights")


@query("SELECT link_id, 'L 2 1' || chr(10) || printf('%.6f', lng1) || ' ' || printf('%.6f', lat1) || chr(10) || printf('%.6f', lng2) || ' ' || printf('%.6f', lat2) || chr(10) || '1 ' || link_id AS text FROM (SELECT link_id, floor(lat1 * 1e4) / 1e4 AS lat1, floor(lng1 * 1e4) / 1e4 AS lng1, floor(lat2 * 1e4) / 1e4 AS lat2, floor(lng2 * 1e4) / 1e4 AS lng2 FROM link)")
def polyline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: links as line texts."""
    rows = fx.links(spark, sf_dir).select(F.col("link_id").alias("edge_id"), *[(F.floor(F.col(c) * 1e4) / 1e4).alias(c) for c in ("lat1", "lng1", "lat2", "lng2")])
    return wr.polylines(rows).withColumnRenamed("edge_id", "link_id")


USERS = "users AS (SELECT 'u' || (o_custkey % 700) AS user_id, list(DISTINCT 'j' || (o_orderkey % 997)) AS jobs FROM orders GROUP BY 1), done AS (SELECT DISTINCT 'j' || (l_partkey % 500) AS job_id FROM lineitem WHERE l_returnflag = 'R')"


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    users = load(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey") % 700).alias("user_id"), F.concat(F.lit("j"), F.col("o_orderkey") % 997).alias("job"))
    done = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("j"), F.col("l_partkey") % 500).alias("job_id")).distinct()
    return users.groupBy("user_id").agg(F.collect_set("job").alias("jobs")), done


@query(f"WITH {USERS} SELECT user_id, string_agg(j || CASE WHEN j IN (SELECT job_id FROM done) THEN ':1' ELSE ':0' END, ',' ORDER BY j || CASE WHEN j IN (SELECT job_id FROM done) THEN ':1' ELSE ':0' END) AS jobs FROM (SELECT user_id, unnest(jobs) AS j FROM users) GROUP BY user_id")
def users_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' jobs with finished flags."""
    return jb.users_with_flags(*_users(spark, sf_dir))


@query(f"WITH {USERS} SELECT user_id, len(jobs)::INTEGER AS n, list_aggregate(list_sort(jobs), 'string_agg', ',') AS jobs FROM users")
def users_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their jobs as a quoted, comma-joined column, written and read again."""
    path, (users, _) = new_path(spark, "users"), _users(spark, sf_dir)
    joined = users.select("user_id", F.lit("-").alias("address"), F.array_join("jobs", ",").alias("jobs"), *[F.lit(x).alias(x) for x in ("city", "country", "flag")])
    joined.write.csv(path, quoteAll=True)
    return rd.read_users(spark, path).select("user_id", F.size("jobs").alias("n"), F.array_join(F.sort_array("jobs"), ",").alias("jobs"))


@query(f"WITH {USERS} SELECT user_id, len(jobs)::INTEGER AS n, CASE WHEN len(jobs) < 3 THEN len(jobs) + 1 ELSE len(jobs) END::INTEGER AS after_add, len(list_filter(jobs, lambda x: x <> 'j7'))::INTEGER AS after_remove FROM users")
def job_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding (at most three) and removing jobs."""
    users, _ = _users(spark, sf_dir)
    return users.select("user_id", F.size("jobs").alias("n"), F.size(jb.add_job(F.col("jobs"), F.lit("new"))).alias("after_add"), F.size(jb.remove_job(F.col("jobs"), F.lit("j7"))).alias("after_remove"))


@query("""WITH t AS (SELECT CAST(l_partkey * 37 + l_suppkey * 4001 AS BIGINT) AS cells, l_linenumber % 3 AS k FROM lineitem), u AS (SELECT cells, CASE k WHEN 0 THEN 100 WHEN 1 THEN 1 ELSE 0 END AS trade_off FROM t)
SELECT CASE WHEN trade_off = 100 THEN 'quick' WHEN trade_off = 1 OR cells > 640000 THEN 'proportional' ELSE 'original' END AS mode, count(*) AS n, CAST(sum(CASE WHEN trade_off = 100 THEN 1600 WHEN cells > 640000 THEN 638000 ELSE cells END) AS BIGINT) AS target FROM u GROUP BY 1""")
def command_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of jobs by trade-off and grid size."""
    sizes = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 37 + F.col("l_suppkey") * 4001).alias("cells"), F.when(F.col("l_linenumber") % 3 == 0, 100).when(F.col("l_linenumber") % 3 == 1, 1).otherwise(0).alias("trade_off"))
    chosen = sizes.select(jb.command(F.col("trade_off"), F.col("cells")).alias("p"))
    return chosen.groupBy("p.mode").agg(F.count(F.lit(1)).alias("n"), F.sum("p.target").alias("target"))


@query("SELECT 'sink' AS kind, count(*) AS n, count(demand) AS n_demand FROM site UNION ALL SELECT 'source', 1, 1 UNION ALL SELECT 'line', count(*), 0 FROM link")
def tagged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: a job's input as tagged rows with missing columns filled."""
    sites = fx.sites(spark, sf_dir)
    rows = jb.input_rows(sites, sites.orderBy(F.desc("ord")).limit(1), fx.links(spark, sf_dir).select("lat1", "lng1", "lat2", "lng2"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("demand").alias("n_demand"))


@query(f"""WITH {CTE}, {rel.BEST}, j AS (SELECT 'j' || (link_id % 40) AS job_id, pair_cost FROM best), n AS (SELECT 'j' || (cell_id % 40) AS job_id, z IS NULL AS relay FROM cell)
SELECT job_id, (SELECT CAST(sum(pair_cost) AS BIGINT) FROM j WHERE j.job_id = d.job_id) AS cost, (SELECT count(*) FROM n WHERE n.job_id = d.job_id) AS towers, (SELECT count(*) FROM j WHERE j.job_id = d.job_id) AS links, (SELECT count(*) FROM n WHERE n.job_id = d.job_id AND relay) AS relays FROM (SELECT DISTINCT job_id FROM j) d""")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost, towers, links and relays per job."""
    best = dev.best_device(fx.links(spark, sf_dir).withColumn("km", rel.link_km()), fx.devices(spark, sf_dir))
    edges = best.select(F.concat(F.lit("j"), F.col("link_id") % 40).alias("job_id"), "pair_cost")
    nodes = fx.cells(spark, sf_dir).select(F.concat(F.lit("j"), F.col("cell_id") % 40).alias("job_id"), F.when(F.col("z").isNull(), "intermediate").otherwise("sink").alias("kind"))
    return jb.job_summary(edges, nodes)


@query("""WITH f AS (SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 11 = 0 THEN 'final_2_2' WHEN o_orderkey % 7 = 0 THEN 'final_1_2' ELSE 'output_' || (o_orderkey % 13) END AS name FROM orders),
r AS (SELECT job_id, name, row_number() OVER (PARTITION BY job_id ORDER BY CASE name WHEN 'final_2_2' THEN 0 WHEN 'final_1_2' THEN 1 ELSE 2 END, TRY_CAST(regexp_extract(name, '^output_([0-9]+)$', 1) AS INTEGER) DESC NULLS LAST, name) AS rn FROM f)
SELECT job_id, name FROM r WHERE rn = 1""")
def final_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best result file of each job."""
    k = F.col("o_orderkey")
    name = F.when(k % 11 == 0, "final_2_2").when(k % 7 == 0, "final_1_2").otherwise(F.concat(F.lit("output_"), k % 13))
    return jb.final_solutions(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), name.alias("name")))


@query("SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS node FROM orders")
def next_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New node numbers after the largest one."""
    existing = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return jb.next_ids(existing, load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey % 5, (o_orderkey || ',' || o_custkey)) AS INTEGER) AS place FROM orders")
def kept_edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which kept edges are tried."""
    edges = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("flow"), F.col("o_orderkey").alias("tail"), F.col("o_custkey").alias("head"))
    return jb.kept_order(edges).select("o_orderkey", "place")


@query(f"""WITH {CTE}, a AS (SELECT DISTINCT demand % 3 + site_id * 10 AS tail, site_id AS head, CAST(revenue AS BIGINT) AS unit_cost, demand AS capacity, site_id % 9 AS device_id FROM site), p AS (SELECT tail, head, demand2 * 10 AS throughput, 77 AS device_id FROM (SELECT demand % 3 + site_id * 10 AS tail, site_id AS head, demand % 2 AS demand2, site_id FROM site) WHERE site_id % 4 = 0)
SELECT coalesce(a.tail, p.tail) AS tail, coalesce(a.head, p.head) AS head, CASE WHEN p.tail IS NOT NULL THEN 0 ELSE unit_cost END AS unit_cost, CASE WHEN p.tail IS NOT NULL THEN CASE WHEN throughput = 0 THEN 2147483647 ELSE throughput END ELSE capacity END AS capacity, CAST(CASE WHEN p.tail IS NOT NULL THEN p.device_id ELSE a.device_id END AS BIGINT) AS device_id, p.tail IS NOT NULL AS pinned FROM a FULL JOIN p USING (tail, head)""")
def pinned_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned links take the place of candidate arcs."""
    sites = fx.sites(spark, sf_dir)
    ends = [(F.col("demand") % 3 + F.col("site_id") * 10).alias("tail"), F.col("site_id").alias("head")]
    arcs = sites.select(*ends, F.col("revenue").cast("long").alias("unit_cost"), F.col("demand").alias("capacity"), (F.col("site_id") % 9).alias("device_id"))
    pinned = sites.filter("site_id % 4 = 0").select(*ends, (F.col("demand") % 2 * 10).alias("throughput"), F.lit(77).cast("long").alias("device_id"))
    return dev.pinned_overlay(arcs, pinned)


@query("SELECT o_custkey AS site_id, cell_id, CAST(sum(CASE WHEN z IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_void FROM link JOIN cell USING (cell_id) JOIN orders ON o_orderkey = link_id GROUP BY 1, 2")
def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the properties of their cells."""
    met = fx.links(spark, sf_dir).join(fx.cells(spark, sf_dir).select("cell_id", "z"), "cell_id")
    return met.groupBy("site_id", "cell_id").agg(F.sum(F.when(F.col("z").isNull(), 1).otherwise(0)).alias("n_void"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 7 > 0 THEN ceil(p_size / CAST(p_size % 7 AS DOUBLE) * 100) ELSE 0 END AS BIGINT) AS percent, CAST(ceil(p_size / 50e0 * 100) AS BIGINT) AS seen FROM part")
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visibility percent and rounding chance, with a guard for no capacity."""
    size = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", geo.rounding_percent(size, size % 7).alias("percent"), geo.visible_percent(size, F.lit(50.0)).alias("seen"))


@query("SELECT link_id, CAST(round(sqrt((r1 * 1112e0) * (r1 * 1112e0) + (c1 * 908e0) * (c1 * 908e0))) AS BIGINT) AS metres FROM (SELECT link_id, floor((35.3e0 - lat1) * 100 + 1e-6) - floor((35.3e0 - lat2) * 100 + 1e-6) AS r1, floor((lng1 + 106.6e0) * 100 + 1e-6) - floor((lng2 + 106.6e0) * 100 + 1e-6) AS c1 FROM link)")
def planar_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distances by cell counts and cell sizes."""
    row = lambda c: F.floor((35.3 - F.col(c)) * 100 + 1e-6)
    col = lambda c: F.floor((F.col(c) + 106.6) * 100 + 1e-6)
    km = geo.planar_km(row("lat1"), col("lng1"), row("lat2"), col("lng2"), F.lit(1112.0), F.lit(908.0))
    return fx.links(spark, sf_dir).select("link_id", F.round(km * 1000).cast("long").alias("metres"))


@query(f"""WITH {CTE}, n AS (SELECT DISTINCT cell_id AS node FROM link), l AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS local FROM n)
SELECT cell.cell_id, CAST(coalesce(local, -1) AS BIGINT) AS local FROM cell LEFT JOIN l ON node = cell.cell_id""")
def local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the cells inside a plan, -1 for those outside."""
    g = fx.lattice(spark, sf_dir)
    ids = jb.local_ids(fx.links(spark, sf_dir, g).select(F.col("cell_id").alias("node")))
    return jb.to_local(fx.cells(spark, sf_dir, g).select("cell_id"), ids, "cell_id")


@query(f"""WITH {CTE}, {rel.NEAREST}, e AS (SELECT own.cell_id AS tail, link.cell_id AS head, demand AS flow FROM link JOIN own USING (site_id)), p AS (SELECT DISTINCT own.cell_id AS tail, link.cell_id AS head FROM link JOIN own USING (site_id) WHERE link_id % 50 = 0 AND demand > 5)
SELECT count(*) = 0 AS ok, count(*) AS n_idle FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.tail = p.tail AND e.head = p.head AND flow >= 8)""")
def pins_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned links, snapped to cells, that carry less than eight units."""
    g = fx.lattice(spark, sf_dir)
    cells = fx.cells(spark, sf_dir, g)
    links = materialize(near.snapped_links(fx.links(spark, sf_dir, g), cells, g), "links")
    pinned = links.filter("link_id % 50 = 0 AND demand > 5")
    return fl.pins_carry_flow(links.select("tail", "head", F.col("demand").alias("flow")), pinned, least=8)


@query(f"""WITH {CTE}, {rel.NEAREST} SELECT link_id, own.cell_id AS tail, link.cell_id AS head FROM link JOIN own USING (site_id)""")
def snapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by coordinates as links between their nearest cells."""
    g = fx.lattice(spark, sf_dir)
    return near.snapped_links(fx.links(spark, sf_dir, g).select("link_id", "lat1", "lng1", "lat2", "lng2"), fx.cells(spark, sf_dir, g), g).select("link_id", "tail", "head")


@query(f"""WITH {CTE}, {rel.BEST}, p AS (SELECT link.site_id AS tail, link.cell_id AS head, min(1 + link_id % 7) AS device_id FROM link WHERE link_id % 20 = 0 GROUP BY 1, 2)
SELECT CAST(sum(coalesce(device.pair_cost, best.pair_cost)) AS BIGINT) AS equipment_cost, count(device.pair_cost) AS n_pinned FROM best JOIN link USING (link_id) LEFT JOIN p ON p.tail = link.site_id AND p.head = link.cell_id LEFT JOIN device ON device.device_id = p.device_id""")
def pinned_equipment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device costs where a pinned link has its own device."""
    devices, links = fx.devices(spark, sf_dir), fx.links(spark, sf_dir)
    edges = dev.best_device(links.withColumn("km", rel.link_km()), devices).select(F.col("site_id").alias("tail"), F.col("cell_id").alias("head"), F.lit(1).alias("flow"), "pair_cost")
    pinned = links.filter("link_id % 20 = 0").groupBy(F.col("site_id").alias("tail"), F.col("cell_id").alias("head")).agg(F.min(1 + F.col("link_id") % 7).cast("int").alias("device_id"))
    return dev.equipment_cost(edges, pinned, devices)


@query(f"""WITH {CTE}, k AS (SELECT link_id, {rel.LINK_KM} AS km, demand FROM link),
b AS (SELECT link_id, device_id, pair_cost, row_number() OVER (PARTITION BY link_id ORDER BY pair_cost, device.ord) AS rn FROM k JOIN device ON range_km >= km AND throughput >= demand * 3)
SELECT k.link_id, coalesce(device_id, -1) AS device_id, coalesce(pair_cost, 0) AS pair_cost FROM k LEFT JOIN b ON b.link_id = k.link_id AND rn = 1""")
def smaller_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the cheapest device for the flow that they really carry."""
    edges = fx.links(spark, sf_dir).withColumn("km", rel.link_km()).select("link_id", "km", (F.col("demand") * 3).alias("flow"), F.lit(0).alias("device_id"), F.lit(0).alias("pair_cost"), F.lit(0).alias("capacity"))
    return fl.smaller_devices(edges, fx.devices(spark, sf_dir)).select("link_id", "device_id", "pair_cost")


@query("""WITH n AS (SELECT 'j' || (o_custkey % 300) AS job_id, CASE WHEN o_orderkey % 41 = 0 THEN 'source' ELSE 'sink' END AS kind FROM orders)
SELECT job_id, count(*) FILTER (WHERE kind = 'source') AS n_sources, count(*) FILTER (WHERE kind = 'source') = 1 AS ok FROM n GROUP BY 1""")
def one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job has exactly one source."""
    kind = F.when(F.col("o_orderkey") % 41 == 0, "source").otherwise("sink")
    return jb.one_source(load(spark, sf_dir, "orders").select(F.concat(F.lit("j"), F.col("o_custkey") % 300).alias("job_id"), kind.alias("kind")))


SAMPLED = ", ".join(f"""s{k} AS (SELECT *, CASE WHEN lag(along) OVER o IS NULL OR floor(along / {w}e0) <> floor(lag(along) OVER o / {w}e0) THEN {{'d': along, 'v': value}} END AS known FROM t WINDOW o AS (PARTITION BY user_id ORDER BY along)),
f{k} AS (SELECT event_id, CASE WHEN b IS NULL THEN a.v WHEN a IS NULL OR a.d = b.d THEN b.v ELSE b.v + (a.v - b.v) * (along - b.d) / (a.d - b.d) END AS v FROM
 (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY along ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY along ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM s{k}))""" for k, w in enumerate((35, 141, 241)))


@query(f"""WITH t AS (SELECT event_id, user_id, value, CASE WHEN event_id % 3 = 0 THEN value END AS present, CAST(sum(event_id % 50 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS along FROM events), {SAMPLED}
SELECT event_id, CAST(round(coalesce(present, (f0.v + f1.v + f2.v) / 3) * 1000) AS BIGINT) AS filled FROM t JOIN f0 USING (event_id) JOIN f1 USING (event_id) JOIN f2 USING (event_id)""")
def smoothed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracks smoothed by the mean of three interval samplings, only where a value is missing."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("present"), F.sum(F.col("event_id") % 50 + 1).over(order).cast("double").alias("along"))
    return gr.smoothed_track(events, "user_id", "along", "value", "along", "present").select("event_id", F.round(F.col("filled") * 1000).cast("long").alias("filled"))
