"""Queries of the relational operators: distances, grids, nearest cells, devices, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators import devices as dev
from ridgeplan.operators import grid as gr
from ridgeplan.operators import nearest as near
from ridgeplan.plans import fixtures as fx
from ridgeplan.plans.fixtures import CTE, km_sql
from ridgeplan.runtime import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LINK_KM = km_sql("lat1", "lng1", "lat2", "lng2")


def query(sql: str | None = None):
    """Register a query and, where there is one, its SQL (over the common definitions)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {CTE}\n{sql}"
        return f

    return put


def metres(km):
    return F.round(km * 1000).cast("long")


def link_km() -> F.Column:
    return geo.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))


@query(f"""SELECT link_id, CAST(round({LINK_KM} * 1000) AS BIGINT) AS asin_m, CAST(round({LINK_KM} * 1000) AS BIGINT) AS atan_m,
CAST(round(degrees(acos(least(1, greatest(-1, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng1 - lng2)))))) * 60 * 1.1515e0 * 1.609344e0 * 100) AS BIGINT) AS cosine_dam,
CAST(round(sqrt((lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * cos(radians(lat1)) * ((lng1 - lng2) * cos(radians(lat1)))) * 111120) AS BIGINT) AS flat_m FROM link""")
def distance_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distance formulas on every link."""
    ends = [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2")]
    return fx.links(spark, sf_dir).select(
        "link_id", metres(geo.haversine_km(*ends)).alias("asin_m"), metres(geo.haversine_atan_km(*ends)).alias("atan_m"),
        F.round(geo.cosine_law_distance(*ends) * 100).cast("long").alias("cosine_dam"), F.round(geo.equirectangular_m(*ends)).cast("long").alias("flat_m"),
    )


@query("""SELECT site_id, CAST(round((lat + 2 / 6371e0 * (180 / pi())) * 1e6) AS BIGINT) AS lat_e6, CAST(round((lng + 3 / 6371e0 * (180 / pi()) / cos(radians(lat))) * 1e6) AS BIGINT) AS lng_e6 FROM site""")
def shifted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every site moved 3 km east and 2 km north."""
    lat, lng = geo.shifted(F.col("lat"), F.col("lng"), 3.0, 2.0)
    return fx.sites(spark, sf_dir).select("site_id", F.round(lat * 1e6).cast("long").alias("lat_e6"), F.round(lng * 1e6).cast("long").alias("lng_e6"))


BOX = "box AS (SELECT max(lat) AS n, min(lat) AS s, max(lng) AS e, min(lng) AS w FROM site)"


@query(f"""WITH {CTE}, {BOX}, km AS (SELECT *, {km_sql("s", "w", "n", "w")} AS h, {km_sql("s", "w", "s", "e")} AS v FROM box)
SELECT CAST(round(km.n * 1e6) AS BIGINT) AS n, CAST(round(s * 1e6) AS BIGINT) AS s, CAST(round(e * 1e6) AS BIGINT) AS e, CAST(round(w * 1e6) AS BIGINT) AS w,
CAST(floor(h * 1000 / 30) AS BIGINT) AS want_rows, CAST(floor(v * 1000 / 25) AS BIGINT) AS want_cols, CAST(round(h / n_rows * 1000) AS BIGINT) AS cell_h_m, CAST(round(v / n_cols * 1000) AS BIGINT) AS cell_w_m FROM km, grid""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of all sites, expected grid, cell size."""
    g = fx.lattice(spark, sf_dir)
    box = gr.bounding_box(fx.sites(spark, sf_dir, g))
    h, v = geo.haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("w")), geo.haversine_km(F.col("s"), F.col("w"), F.col("s"), F.col("e"))
    return box.select(
        *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in "nsew"], geo.expected_rows(h).alias("want_rows"), geo.expected_cols(v).alias("want_cols"),
        F.round(geo.cell_size_m(h, F.lit(g.n_rows))).cast("long").alias("cell_h_m"), F.round(geo.cell_size_m(v, F.lit(g.n_cols))).cast("long").alias("cell_w_m"),
    )


@query(f"""WITH {CTE}, {BOX}, km AS (SELECT *, {km_sql("s", "w", "n", "w")} * 0.1e0 AS h0, {km_sql("s", "w", "s", "e")} * 0.1e0 AS v0 FROM box), p AS (SELECT *, CASE WHEN h0 = 0 THEN 0.1e0 ELSE h0 END AS h, CASE WHEN v0 = 0 THEN 0.1e0 ELSE v0 END AS v FROM km)
SELECT CAST(round((n + degrees(h / 6371e0)) * 1e6) AS BIGINT) AS n, CAST(round((s - degrees(h / 6371e0)) * 1e6) AS BIGINT) AS s, CAST(round((e + degrees(v / 6371e0) / cos(radians(n))) * 1e6) AS BIGINT) AS e, CAST(round((w - degrees(v / 6371e0) / cos(radians(s))) * 1e6) AS BIGINT) AS w FROM p""")
def padded_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the extent of all sites, grown by a tenth."""
    return gr.bounding_box(fx.sites(spark, sf_dir), 0.1).select(*[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in "nsew"])


@query(f"""WITH {CTE}, {BOX}, t AS (SELECT unnest(generate_series(CAST(floor(s) AS BIGINT), CAST(floor(n) AS BIGINT))) AS lat, w, e FROM box), u AS (SELECT lat, unnest(generate_series(CAST(floor(w) AS BIGINT), CAST(floor(e) AS BIGINT))) AS lng FROM t)
SELECT DISTINCT CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lng >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lng) AS VARCHAR), 3, '0') AS tile FROM u""")
def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tiles that the extent needs."""
    return gr.tile_requests(gr.bounding_box(fx.sites(spark, sf_dir)))


TILE = "CASE WHEN floor(lat) >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(abs(floor(lat)) AS BIGINT) AS VARCHAR), 2, '0') || CASE WHEN floor(lng) >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(abs(floor(lng)) AS BIGINT) AS VARCHAR), 3, '0')"


@query(f"""SELECT {TILE} AS tile, CAST(min(floor(lat)) AS INTEGER) AS origin_lat, CAST(min(floor(lng)) AS INTEGER) AS origin_lng, count(*) AS n_sites FROM site GROUP BY 1""")
def tile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites per tile, with the origin parsed back from the tile's file name."""
    named = fx.sites(spark, sf_dir).select(geo.tile_name(F.col("lat"), F.col("lng")).alias("tile"))
    lat, lng = geo.tile_origin(F.concat("tile", F.lit(".hgt")))
    return named.groupBy("tile").agg(F.count(F.lit(1)).alias("n_sites")).select("tile", lat.alias("origin_lat"), lng.alias("origin_lng"), "n_sites")


@query("""SELECT r, c, count(*) AS n, min(CAST(cell_id AS BIGINT)) AS cell_id FROM cell GROUP BY r, c""")
def cell_row_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and column of every cell number."""
    side = F.lit(fx.lattice(spark, sf_dir).n_cols)
    rc = load(spark, sf_dir, "part").select("p_partkey", geo.row_of(F.col("p_partkey"), side).alias("r"), geo.col_of(F.col("p_partkey"), side).alias("c"))
    return rc.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("cell_id"))


@query("""SELECT CAST(z // 10 AS INTEGER) AS bucket, count(*) AS n, max(z) AS top FROM cell WHERE z IS NOT NULL GROUP BY 1""")
def elevation_bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and top per ten-metre bucket."""
    cells = fx.cells(spark, sf_dir).filter("z IS NOT NULL")
    return cells.groupBy(geo.elevation_bucket(F.col("z")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"))


@query(f"""WITH {CTE}, k AS (SELECT link_id, {LINK_KM} AS km FROM link)
SELECT link_id, CAST(floor(0.1258e0 * km * km + 6.7747e0 * km + 63.429e0) AS BIGINT) AS unit_cost FROM k""")
def edge_unit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the solver's cost of every link."""
    return fx.links(spark, sf_dir).select("link_id", geo.unit_cost(link_km()).alias("unit_cost"))


@query("""WITH t AS (SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_partkey * 37 + l_suppkey * 4001 AS BIGINT) AS cells FROM lineitem)
SELECT CASE WHEN cells > 640000 THEN 99.7e0 WHEN cells >= 360000 THEN 99.5e0 WHEN cells >= 160000 THEN 99.3e0 WHEN cells >= 40000 THEN 99.0e0 WHEN cells >= 10000 THEN 98.5e0 ELSE 0e0 END AS percent,
count(*) AS n, sum(CASE WHEN cells > 640000 THEN 638000 ELSE cells END)::BIGINT AS target FROM t GROUP BY 1""")
def removal_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removal percentage and rescale target by grid size, over made-up sizes."""
    sizes = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 37 + F.col("l_suppkey") * 4001).alias("cells"))
    return sizes.groupBy(geo.removal_percent(F.col("cells")).alias("percent")).agg(F.count(F.lit(1)).alias("n"), F.sum(geo.rescale_target(F.col("cells"))).alias("target"))


@query("""SELECT cell_id, CASE WHEN z - 104 > 0 THEN z - 104 END AS z FROM cell""")
def positive_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations that are not positive become null."""
    return fx.cells(spark, sf_dir).select("cell_id", gr.positive_or_null(F.col("z") - 104).alias("z"))


@query("""SELECT cell_id, CAST(floor(255 * least(1, greatest(0, (z - 100) / 200e0))) AS INTEGER) AS red, CAST(floor(64 + least(1, greatest(0, (z - 100) / 200e0)) * 128) AS INTEGER) AS green, CAST(floor(200 - least(1, greatest(0, (z - 100) / 200e0)) * 200) AS INTEGER) AS blue FROM cell WHERE z IS NOT NULL""")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the elevation image as colours."""
    rgb = geo.ramp_colour(F.col("z"), F.lit(100), F.lit(300), (0, 64, 200), (255, 192, 0))
    return fx.cells(spark, sf_dir).filter("z IS NOT NULL").select("cell_id", *[rgb[k].alias(c) for k, c in enumerate(("red", "green", "blue"))])


@query("""WITH t AS (SELECT o_orderkey, o_orderpriority || '  x   ' || o_orderkey || ' ' || o_custkey AS s FROM orders)
SELECT o_orderkey, regexp_replace(s, ' {2,}', ' ', 'g') AS tidy, substr(s, instr(s, ' ') + 1) AS tail, list_sum(list_transform(list_filter(string_split(regexp_extract(s, '[0-9]+ [0-9]+$'), ' '), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)))::BIGINT AS total FROM t""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tidy spaces, text after the first space, split to ints."""
    s = F.concat("o_orderpriority", F.lit("  x   "), "o_orderkey", F.lit(" "), "o_custkey")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    numbers = geo.split_ints(F.regexp_extract("s", "[0-9]+ [0-9]+$", 0))
    return rows.select("o_orderkey", geo.tidy_spaces(F.col("s")).alias("tidy"), geo.after_first_space(F.col("s")).alias("tail"), F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {CTE}, k AS (SELECT link_id, {LINK_KM} AS km, need FROM link) SELECT link_id, printf('%d.%02d Km', CAST(floor(km * 100 + 0.5e0) AS BIGINT) // 100, CAST(floor(km * 100 + 0.5e0) AS BIGINT) % 100) AS length_text, printf('$%d', CAST(floor(km) AS BIGINT) * need) AS cost_text FROM k""")
def formatted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lengths and costs as texts."""
    rows = fx.links(spark, sf_dir).withColumn("km", link_km())
    return rows.select("link_id", geo.length_text(F.col("km")).alias("length_text"), geo.cost_text(F.floor("km") * F.col("need")).alias("cost_text"))


@query(f"""WITH {CTE}, k AS (SELECT site_id, cell_id, round({km_sql("site.lat", "site.lng", "cell.lat", "cell.lng")}, 9) AS km FROM site, cell),
b AS (SELECT site_id, cell_id, km, row_number() OVER (PARTITION BY site_id ORDER BY km, cell_id DESC) AS rn FROM k)
SELECT site_id, cell_id, CAST(round(km * 1000) AS BIGINT) AS metres FROM b WHERE rn = 1""")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cell of every site."""
    g = fx.lattice(spark, sf_dir)
    return near.nearest_cell(fx.sites(spark, sf_dir, g).select("site_id", "lat", "lng"), fx.cells(spark, sf_dir, g), g).select("site_id", "cell_id", metres(F.col("km")).alias("metres"))


NEIGHBOURS = "(VALUES (0, 0, 1), (1, 0, -1), (2, -1, 0), (3, 1, 0), (4, -1, 1), (5, 1, 1), (6, -1, -1), (7, 1, -1)) AS nb(pref, dr, dc)"
NEAREST = f"""k AS (SELECT site_id, cell_id, round({km_sql("site.lat", "site.lng", "cell.lat", "cell.lng")}, 9) AS km FROM site, cell),
own AS (SELECT site_id, max_by(cell_id, cell_id) FILTER (WHERE km = m) AS cell_id FROM (SELECT *, min(km) OVER (PARTITION BY site_id) AS m FROM k) GROUP BY site_id)"""


@query(f"""WITH {CTE}, {NEAREST}, o AS (SELECT site.site_id, site.lat, site.lng, cell.cell_id, cell.r, cell.c, cell.z FROM own JOIN cell USING (cell_id) JOIN site USING (site_id)),
m AS (SELECT o.site_id, cell.cell_id, row_number() OVER (PARTITION BY o.site_id ORDER BY round({km_sql("o.lat", "o.lng", "cell.lat", "cell.lng")}, 9), pref) AS rn FROM o, {NEIGHBOURS} JOIN cell ON true WHERE o.z IS NULL AND cell.r = o.r + dr AND cell.c = o.c + dc AND cell.z IS NOT NULL)
SELECT o.site_id, coalesce(m.cell_id, o.cell_id) AS cell_id, o.z IS NULL AS moved FROM o LEFT JOIN m ON m.site_id = o.site_id AND m.rn = 1""")
def nearest_valid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cell of every site, moved off cells without data."""
    g = fx.lattice(spark, sf_dir)
    return near.nearest_valid_cell(fx.sites(spark, sf_dir, g).select("site_id", "lat", "lng"), fx.cells(spark, sf_dir, g), g).select("site_id", "cell_id", "moved")


@query(f"""WITH {CTE}, {NEAREST}, src AS (SELECT cell_id FROM own WHERE site_id = (SELECT max(site_id) FROM site)), home AS (SELECT cell.* FROM cell JOIN src USING (cell_id)),
f AS (SELECT cell.cell_id, row_number() OVER (ORDER BY round({km_sql("cell.lat", "cell.lng", "home.lat", "home.lng")}, 9), cell.cell_id DESC) AS rn FROM cell, home WHERE cell.cell_id NOT IN (SELECT cell_id FROM own))
SELECT CASE WHEN src.cell_id IN (SELECT cell_id FROM own) THEN coalesce((SELECT cell_id FROM f WHERE rn = 1), src.cell_id) ELSE src.cell_id END AS cell_id FROM src""")
def unique_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last site is also the source; it moves to the nearest cell without a site."""
    g = fx.lattice(spark, sf_dir)
    cells, sites = fx.cells(spark, sf_dir, g), fx.sites(spark, sf_dir, g)
    own = near.nearest_cell(sites.select("site_id", "lat", "lng"), cells, g)
    source = near.nearest_cell(sites.orderBy(F.desc("ord")).limit(1).select("site_id", "lat", "lng"), cells, g)
    return near.unique_source(source, own, cells)


BEST = f"""k AS (SELECT link_id, {LINK_KM} AS km, need FROM link),
b AS (SELECT link_id, km, device_id, pair_cost, row_number() OVER (PARTITION BY link_id ORDER BY pair_cost, device.ord) AS rn FROM k JOIN device ON range_km >= km AND throughput >= need),
best AS (SELECT k.link_id, k.km, coalesce(device_id, -1) AS device_id, coalesce(pair_cost, 0) AS pair_cost FROM k LEFT JOIN b ON b.link_id = k.link_id AND rn = 1)"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dev.best_device(fx.links(spark, sf_dir).withColumn("km", link_km()), fx.devices(spark, sf_dir))


@query(f"WITH {CTE}, {BEST} SELECT link_id, device_id, pair_cost FROM best")
def best_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest feasible device of every link."""
    return _best(spark, sf_dir).select("link_id", "device_id", "pair_cost")


@query(f"""WITH {CTE}, {BEST} SELECT best.device_id, name, count(*) AS n_links, count(*) * CAST(min(device.pair_cost) AS BIGINT) AS total_cost FROM best JOIN device USING (device_id) GROUP BY 1, 2""")
def device_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and cost per device."""
    return dev.device_usage(_best(spark, sf_dir), fx.devices(spark, sf_dir))


@query(f"""WITH {CTE}, {BEST} SELECT CAST(sum(floor(0.1258e0 * km * km + 6.7747e0 * km + 63.429e0)) AS BIGINT) AS unit_cost, CAST(round(sum(0.1258e0 * km * km + 6.7747e0 * km + 63.429e0)) AS BIGINT) AS link_cost, CAST(sum(pair_cost) AS BIGINT) AS equipment_cost, count(*) AS n_edges FROM best WHERE link_id % 3 > 0""")
def solution_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the used arcs (flow over zero)."""
    edges = _best(spark, sf_dir).select("*", geo.unit_cost(F.col("km")).alias("unit_cost"), (F.col("link_id") % 3).alias("flow"))
    return dev.solution_costs(edges)


@query(f"""WITH {CTE}, {BEST} SELECT device.device_id, name, throughput, range_km, pair_cost, device_id IN (SELECT device_id FROM best) AS selected FROM device""")
def job_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with flags of the devices in use."""
    return dev.job_devices(fx.devices(spark, sf_dir), _best(spark, sf_dir)).select("device_id", "name", "throughput", "range_km", "pair_cost", "selected")


@query(f"""WITH {CTE}, {NEAREST} SELECT own.cell_id, sum(demand)::BIGINT AS capacity, sum(revenue)::BIGINT AS revenue, count(*) AS n_sites FROM own JOIN site USING (site_id) GROUP BY 1""")
def demand_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: demand and revenue of the sites on one cell add up."""
    g = fx.lattice(spark, sf_dir)
    own = near.nearest_cell(fx.sites(spark, sf_dir, g), fx.cells(spark, sf_dir, g), g)
    return own.groupBy("cell_id").agg(F.sum("demand").alias("capacity"), F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("n_sites"))


@query("SELECT sum(demand)::BIGINT AS source_capacity, max(demand) AS largest_demand, count(*) AS n_sinks FROM site")
def total_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A4: the source's capacity and the largest demand of a row."""
    return fx.sites(spark, sf_dir).agg(F.sum("demand").alias("source_capacity"), F.max("demand").alias("largest_demand"), F.count(F.lit(1)).alias("n_sinks"))


@query("SELECT site_id, demand FROM site WHERE ord < (SELECT max(ord) FROM site)")
def without_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the last row of a web job's file is its source."""
    sites = fx.sites(spark, sf_dir)
    last = F.broadcast(sites.agg(F.max("ord").alias("last")))  # one row
    return sites.join(last, F.col("ord") < F.col("last")).select("site_id", "demand")


@query("""SELECT link_id, n.z AS nearest_z, CAST(round(lat1 * 100) AS BIGINT) AS lat_c FROM link LEFT JOIN cell n ON n.r = CAST(floor((35.3e0 - lat1) / 0.01e0 + 0.5e0) AS INTEGER) AND n.c = CAST(floor((lng1 - -106.6e0) / 0.01e0 + 0.5e0) AS INTEGER)""")
def elevation_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elevation of the nearest sample at every link's start."""
    g = fx.lattice(spark, sf_dir)
    points = fx.links(spark, sf_dir, g).select("link_id", F.col("lat1").alias("lat"), F.col("lng1").alias("lng"))
    found = gr.elevation_at(points, fx.cells(spark, sf_dir, g), fx.NORTH, fx.WEST, fx.STEP)
    return found.select("link_id", F.col("z").alias("nearest_z"), F.round(F.col("lat") * 100).cast("long").alias("lat_c"))


@query("""WITH """ + CTE + """, p AS (SELECT site_id, (35.3e0 - lat) / 0.01e0 AS y, (lng - -106.6e0) / 0.01e0 AS x FROM site), q AS (SELECT *, CAST(floor(y + 0.5e0) AS INTEGER) AS r0, CAST(floor(x + 0.5e0) AS INTEGER) AS c0 FROM p),
n AS (SELECT q.*, dr, dc, greatest(0e0, 1 - sqrt((y - (r0 + dr)) * (y - (r0 + dr)) + (x - (c0 + dc)) * (x - (c0 + dc)))) AS w FROM q, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(dr, dc)),
m AS (SELECT n.*, cell.z, z0.z AS z0 FROM n LEFT JOIN cell ON cell.r = r0 + dr AND cell.c = c0 + dc LEFT JOIN cell z0 ON z0.r = r0 AND z0.c = c0)
SELECT site_id, CAST(round(CASE WHEN min(z0) IS NULL THEN NULL WHEN sum(w) > 0 THEN sum(w * CASE WHEN coalesce(z, 0) = 0 THEN z0 ELSE z END) / sum(w) ELSE min(z0) END * 1000) AS BIGINT) AS z_mm FROM m GROUP BY site_id""")
def weighted_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elevation of every site by its nearest sample and four neighbours."""
    g = fx.lattice(spark, sf_dir)
    found = gr.weighted_elevation(fx.sites(spark, sf_dir, g).select("site_id", "lat", "lng"), fx.cells(spark, sf_dir, g), fx.NORTH, fx.WEST, fx.STEP)
    return found.select("site_id", F.round(F.col("z") * 1000).cast("long").alias("z_mm"))


@query("""WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN value END AS known, CAST(sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS along, ts FROM events),
w AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN {'d': along, 'v': known} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY along ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
first_value(CASE WHEN known IS NOT NULL THEN {'d': along, 'v': known} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY along ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM t)
SELECT event_id, CAST(round(CASE WHEN b IS NULL THEN a.v WHEN a IS NULL OR a.d = b.d THEN b.v ELSE b.v + (a.v - b.v) * (along - b.d) / (a.d - b.d) END * 1000) AS BIGINT) AS filled FROM w""")
def filled_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """missing elevations of tracks (one per user), interpolated along the way."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("known"), F.sum(F.col("event_id") % 7 + 1).over(order).cast("double").alias("along"))
    return gr.filled_track(events, "user_id", "along", "known", "along").select("event_id", F.round(F.col("filled") * 1000).cast("long").alias("filled"))


POLYGON = ((0, 0.1, 0.2), (1, 0.9, 0.1), (2, 0.7, 0.6), (3, 0.95, 0.9), (4, 0.3, 0.8))


@query("""WITH """ + CTE + """, span AS (SELECT 0.01e0 * (n_rows - 1) AS h, 0.01e0 * (n_cols - 1) AS v FROM grid),
p AS (SELECT k, 35.3e0 - y * h AS y, -106.6e0 + x * v AS x FROM (VALUES (0, 0.1e0, 0.2e0), (1, 0.9e0, 0.1e0), (2, 0.7e0, 0.6e0), (3, 0.95e0, 0.9e0), (4, 0.3e0, 0.8e0)) AS t(k, y, x), span),
e AS (SELECT a.y AS ay, a.x AS ax, b.y AS "by", b.x AS bx FROM p a JOIN p b ON b.k = (a.k + 1) % 5)
SELECT site_id, sum(CASE WHEN (ay > lat) <> ("by" > lat) AND lng < (bx - ax) * (lat - ay) / ("by" - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM site, e GROUP BY site_id""")
def sites_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which sites lie in a polygon."""
    g = fx.lattice(spark, sf_dir)
    h, v = fx.STEP * (g.n_rows - 1), fx.STEP * (g.n_cols - 1)
    polygon = spark.createDataFrame([(k, fx.NORTH - y * h, fx.WEST + x * v) for k, y, x in POLYGON], "ord int, lat double, lng double")
    return gr.points_in_polygon(fx.sites(spark, sf_dir, g).select("site_id", "lat", "lng"), polygon).select("site_id", "inside")


@query(f"""WITH {CTE}, {BOX} SELECT cell_id, z FROM cell, box WHERE lat BETWEEN s AND n AND lng BETWEEN w AND e""")
def cropped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells inside the sites' extent."""
    g = fx.lattice(spark, sf_dir)
    return gr.crop(fx.cells(spark, sf_dir, g), gr.bounding_box(fx.sites(spark, sf_dir, g))).select("cell_id", "z")


@query("""WITH """ + CTE + """, t AS (SELECT r AS lat_key, c AS lng_key, 0 AS tile_ord, CASE WHEN cell_id % 3 = 0 THEN z END AS z FROM cell UNION ALL SELECT r, c, 1, CASE WHEN cell_id % 2 = 0 THEN z + 1000 END FROM cell UNION ALL SELECT r, c, 2, z + 2000 FROM cell)
SELECT lat_key, lng_key, first(z ORDER BY tile_ord) FILTER (WHERE z IS NOT NULL) AS z FROM t GROUP BY 1, 2""")
def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of overlapping tiles the first with data counts."""
    c = fx.cells(spark, sf_dir)
    keys = [F.col("r").alias("lat_key"), F.col("c").alias("lng_key")]
    layers = [c.select(*keys, F.lit(k).alias("tile_ord"), z.alias("z")) for k, z in enumerate((F.when(F.col("cell_id") % 3 == 0, F.col("z")), F.when(F.col("cell_id") % 2 == 0, F.col("z") + 1000), F.col("z") + 2000))]
    return gr.mosaic(layers[0].unionByName(layers[1]).unionByName(layers[2]))


@query("""SELECT CAST(tr * 20 + tc AS BIGINT) AS cell_id, z FROM (SELECT unnest(generate_series(0, 19)) AS tr), (SELECT unnest(generate_series(0, 19)) AS tc), grid JOIN cell ON true WHERE cell.r = (2 * tr + 1) * full_rows // 40 AND cell.c = (2 * tc + 1) * n_cols // 40""")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the grid resampled to 400 cells."""
    g = fx.lattice(spark, sf_dir)
    return gr.resample(fx.cells(spark, sf_dir, g), 20, 20, fx.full_rows(spark, sf_dir), g.n_cols).select("cell_id", "z")


@query("""WITH RECURSIVE """ + CTE + """, k AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM k, grid WHERE CAST(floor(k * (full_rows / CAST(n_cols AS DOUBLE))) AS BIGINT) * k <= 400),
s AS (SELECT max(k) AS tc FROM k), t AS (SELECT tc, greatest(1, CAST(floor(tc * (full_rows / CAST(n_cols AS DOUBLE))) AS BIGINT)) AS tr FROM s, grid)
SELECT CAST(a * tc + b AS BIGINT) AS cell_id, z FROM (SELECT *, unnest(generate_series(0, tr - 1)) AS a FROM t) JOIN (SELECT unnest(generate_series(0, tc - 1)) AS b FROM t) ON true, grid JOIN cell ON true WHERE cell.r = (2 * a + 1) * full_rows // (2 * tr) AND cell.c = (2 * b + 1) * n_cols // (2 * tc)""")
def proportional_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled to about 400 cells in the grid's own proportions."""
    g = fx.lattice(spark, sf_dir)
    full = fx.full_rows(spark, sf_dir)
    rows, cols = geo.proportional_size(full, g.n_cols, 400)
    return gr.resample(fx.cells(spark, sf_dir, g), rows, cols, full, g.n_cols).select("cell_id", "z")


@query("""WITH """ + CTE + """, e AS (SELECT a.cell_id, s.side, a.z AS z1, b.z AS z2 FROM cell a, (VALUES ('E', 0, 1), ('S', 1, 0)) AS s(side, dr, dc) JOIN cell b ON true WHERE b.r = a.r + dr AND b.c = a.c + dc AND a.z IS NOT NULL AND b.z IS NOT NULL)
SELECT CAST(unnest(generate_series(least(z1, z2) // 100 + 1, greatest(z1, z2) // 100)) * 100 AS INTEGER) AS level, cell_id, side FROM e WHERE least(z1, z2) // 100 < greatest(z1, z2) // 100""")
def contour_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where contours every 100 m cross the grid."""
    return gr.contours(fx.cells(spark, sf_dir))
