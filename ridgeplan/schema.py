"""Schemas of the planning tables (Spark DDL)."""

SITE = "site_id long, ord long, kind string, lat double, lng double, demand int, revenue int, mounting_height int"
SINK_CSV = "lat double, lng double, demand int, revenue int, mounting_height int"
SOURCE_CSV = "lat double, lng double, mounting_height int"
DEVICE = "device_id int, ord int, name string, throughput int, range_km int, pair_cost int, selected boolean"
PINNED = "lat1 double, lng1 double, lat2 double, lng2 double, throughput int, range_km int, pair_cost int, device_id int"
CELL = "cell_id long, r int, c int, lat double, lng double, z int, mount_h int"
GRID_META = "n_rows int, n_cols int, xll double, yll double, dx double, dy double, nodata double"
VISIBLE = "obs long, tgt long"
VISIBLE_BITS = "obs long, bits binary"
ARC = "tail long, head long, km double, unit_cost long, capacity int, device_id int, pinned boolean"
SOLUTION_EDGE = "run int, stage string, tail long, head long, flow long, unit_cost long, device_id int, pair_cost int, km double"
SOLUTION_NODE = "run int, node long, supply long, kind string, lat double, lng double, mounting_height int"
