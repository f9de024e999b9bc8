"""Kernels against plain re-derivations, and edge cases of grids, devices and files."""

import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators import devices as dev
from ridgeplan.operators import flow as fl
from ridgeplan.operators import graph as gp
from ridgeplan.operators import grid as gr
from ridgeplan.operators import jobs as jb
from ridgeplan.operators import los
from ridgeplan.operators import nearest as near
from ridgeplan.operators import rays
from ridgeplan.operators import removal as rm
from ridgeplan.plans.registry import QUERIES
from ridgeplan.sources import readers as rd
from ridgeplan.sources import writers as wr


def plain_view(z, h, r0, c0, order="reference"):
    """Line of sight by the stepwise description: an error term decides when the minor axis moves."""
    n, m = z.shape
    seen = set()
    for r2 in range(n):
        for c2 in range(m):
            if not (r2 in (0, n - 1) or c2 in (0, m - 1)) or (r2, c2) == (r0, c0):
                continue
            steep = abs(c2 - c0) > abs(r2 - r0)
            a, b = ((c0, r0), (c2, r2)) if steep else ((r0, c0), (r2, c2))
            swapped = a[0] > b[0]
            if swapped:
                a, b = b, a
            line, y, error = [], a[1], (b[0] - a[0]) / 2
            for x in range(a[0], b[0]):
                line.append((y, x) if steep else (x, y))
                error -= abs(b[1] - a[1])
                if error < 0:
                    y += 1 if a[1] < b[1] else -1
                    error += b[0] - a[0]
            walk = line[1:]
            if order == "outward" and swapped:
                walk = walk[::-1]
            level = -np.inf
            for r, c in [*walk, (r2, c2)]:
                if np.isnan(z[r, c]) or (r, c) == (r0, c0):
                    continue
                d = ((r - r0) ** 2 + (c - c0) ** 2) ** 0.5
                if (z[r, c] - z[r0, c0]) / d >= level:
                    seen.add((r, c))
                    level = (z[r, c] - z[r0, c0] - h) / d
    return seen


@pytest.mark.parametrize("shape", [(1, 1), (1, 6), (6, 1), (5, 7), (8, 8)])
@pytest.mark.parametrize("order", ["reference", "outward"])
def test_view(shape, order):
    rng = np.random.default_rng(sum(shape))
    z = rng.integers(100, 160, shape).astype(float)
    z[rng.random(shape) < 0.1] = np.nan
    terrain = los.Terrain(z, np.full(shape, 10.0), order)
    for r in range(shape[0]):
        for c in range(shape[1]):
            want = set() if np.isnan(z[r, c]) else plain_view(z, 10, r, c, order)
            assert {tuple(x) for x in np.argwhere(terrain.view(r, c)).tolist()} == want


def test_row_form_is_the_kernel(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(100, 160, (7, 7))
    cells = square(spark, 7, lambda r, c: None if (r, c) == (2, 3) else int(z[r, c])).withColumn("mount_h", F.lit(10))
    bits = los.visible_bits(cells, 7, 7)
    assert {tuple(r) for r in los.visible_rows(cells, 7, 7).collect()} == {tuple(r) for r in los.pairs_of_bits(bits).collect()}
    assert {(r.obs, r.n_seen) for r in los.seen_digest(bits).collect()} == {(r.obs, r.n_visible) for r in bits.collect()}


def test_ray_totals_are_the_rows(spark, monkeypatch):
    """Sums by arithmetic equal those of the row form, on grids of any shape; no row is made of a step."""
    for n_rows, n_cols in ((9, 9), (1, 6), (7, 1), (12, 5), (8, 15), (1, 1)):
        at = frame(spark, [(r * n_cols + c, r, c) for r in range(n_rows) for c in range(n_cols)], "cell_id long, r int, c int")
        ends = los.edge_cells(at, n_rows, n_cols).select(F.col("r").alias("r2"), F.col("c").alias("c2"))
        rays = at.select(F.col("cell_id").alias("obs"), F.col("r").alias("r1"), F.col("c").alias("c1")).join(ends, (F.col("r1") != F.col("r2")) | (F.col("c1") != F.col("c2")))
        want = los.ray_steps(rays).groupBy("obs").agg(F.count(F.lit(1)), F.sum("r"), F.sum("c")).collect()
        monkeypatch.setattr(los, "SUM_RAYS", 40)
        assert sorted(map(tuple, los.ray_totals(at, n_rows, n_cols).collect())) == sorted(map(tuple, want))
    plan = los.ray_totals(at, 1, 1)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_flags_stay_in_the_task(spark):
    """Digests equal those of the packed rows, and no plan sends a packed row on: neither to a digest nor to a join."""
    rng = np.random.default_rng(13)
    z = rng.integers(100, 190, (9, 9))
    cells = square(spark, 9, lambda r, c: None if (r, c) == (3, 3) else int(z[r, c])).withColumn("mount_h", F.lit(10))
    digest = los.visible_digest(cells, 9, 9)
    assert sorted(map(tuple, digest.collect())) == sorted(map(tuple, los.seen_digest(los.visible_bits(cells, 9, 9)).collect()))
    assert "bits" not in digest._jdf.queryExecution().toString()


def test_heights_without_packed_rows(spark, monkeypatch):
    """Asked cells travel to their observers; before, packed rows of the whole grid met the asked cells in a join."""
    rng = np.random.default_rng(15)
    z = rng.integers(100, 190, (9, 9))
    cells = square(spark, 9, lambda r, c: None if (r, c) == (3, 3) else int(z[r, c])).withColumn("mount_h", F.lit(10))
    asked = frame(spark, [(int(a), int(b)) for a, b in rng.integers(0, 81, (60, 2)) if a != b], "obs long, tgt long")
    seen = {h: {tuple(r) for r in los.pairs_of_bits(los.visible_bits(cells.withColumn("mount_h", F.lit(float(h))), 9, 9)).collect()} for h in (5, 30, 200)}
    want = {(r.obs, r.tgt): next((h for h in (5, 30, 200) if (r.obs, r.tgt) in seen[h]), None) for r in asked.collect()}
    monkeypatch.setattr(los, "visible_bits", None)
    got = los.least_heights(cells, 9, 9, asked, (5, 30, 200)).collect()
    assert {(r.obs, r.tgt): r.height for r in got} == want and len(got) == len(want)


def test_unions_links_and_heights(spark, monkeypatch):
    monkeypatch.setattr(los, "BLOCK_BYTES", 2)
    rng = np.random.default_rng(5)
    z = rng.integers(100, 190, (9, 9))
    grid = near.Lattice(1.0, 2.0, 0.01, 9, 9)
    cells = square(spark, 9, lambda r, c: int(z[r, c])).withColumn("mount_h", F.lit(10))
    kept = cells.filter("cell_id % 4 = 1").select("cell_id")
    bits = los.visible_bits(cells, 9, 9, observers=cells.join(kept, "cell_id", "left_semi"))
    pairs = los.pairs_of_bits(los.visible_bits(cells, 9, 9))
    assert los.coverage_of_bits(bits, 81).collect() == los.coverage(pairs, kept, 81).collect()
    assert los.coverage_of_bits(bits.filter("false"), 81).first().n_seen == 0
    want = {tuple(r) for r in los.candidate_links(pairs, kept).collect()}
    got = los.kept_links(cells, grid, kept).collect()
    assert {(r.obs, r.tgt) for r in got} == want
    assert {(r.obs, r.tgt) for r in los.kept_links(cells, grid, kept, 2.5).collect()} == {(r.obs, r.tgt) for r in got if r.km <= 2.5}
    asked = kept.select(F.col("cell_id").alias("obs"), F.lit(40).cast("long").alias("tgt")).filter("obs <> tgt")
    first = {r.obs: r.height for r in los.least_heights(cells, 9, 9, asked, (5, 50, 500)).collect()}
    for height in (5, 50, 500):
        seen = {r.obs for r in los.pairs_of_bits(los.visible_bits(cells.withColumn("mount_h", F.lit(float(height))), 9, 9)).collect() if r.tgt == 40}
        assert all((h is not None and h <= height) for o, h in first.items() if o in seen) and all(h != height or o in seen for o, h in first.items())
    counts = {r.cell_id: tuple(r)[1:] for r in los.sight_counts(bits, np.arange(81) // 9, {4: (3, 5)}, np.arange(81) % 2 == 0).collect()}
    of = {}
    for o, t in {tuple(r) for r in pairs.collect()}:
        of.setdefault(o, set()).add(t)
    for o, (n, area, parent) in counts.items():
        assert (n, area, parent) == (len(of.get(o, ())), sum(t // 9 == o // 9 for t in of.get(o, ())), sum(o // 9 == 4 and t // 9 in (3, 5) and t % 2 == 0 for t in of.get(o, ())))


def rough(spark, n, seed, amp=90):
    z = np.random.default_rng(seed).integers(100, 100 + amp, (n, n))
    return z, square(spark, n, lambda r, c: None if (r * n + c) % 11 == 5 else int(z[r, c])).withColumn("mount_h", F.lit(10))


def test_rays_that_pass_a_cell():
    """Asking for single cells, or for those near, gives what the whole view gives."""
    for shape in ((1, 6), (7, 1), (9, 14), (12, 12)):
        for order in ("reference", "outward"):
            rng = np.random.default_rng(sum(shape))
            z = rng.integers(100, 125, shape).astype(float)
            z[rng.random(shape) < 0.1] = np.nan
            terrain = los.Terrain(z, rng.integers(5, 15, shape).astype(float), order)
            r, c = np.nonzero(np.isfinite(z))
            seen = terrain.views(r, c)
            obs, tgt = (x.ravel() for x in np.indices(seen.shape))
            obs, tgt = obs[other := r[obs] * shape[1] + c[obs] != tgt], tgt[other]
            assert (terrain.sees(r[obs], c[obs], tgt // shape[1], tgt % shape[1]) == seen[obs, tgt]).all()
            for reach in ((2, 3), (0, 4), (30, 30)):
                near_ = (np.abs(tgt // shape[1] - r[obs]) <= reach[0]) & (np.abs(tgt % shape[1] - c[obs]) <= reach[1]) & seen[obs, tgt]
                got = list(zip(*(x.tolist() for x in terrain.near(r, c, reach)), strict=True))
                assert sorted(got) == sorted(zip(obs[near_].tolist(), tgt[near_].tolist(), strict=True))


@pytest.mark.parametrize("looks", [1, 2, 48])
def test_coverage_without_every_view(spark, monkeypatch, looks):
    """The union is that of all views, though few are made; before, each kept cell sent its packed row."""
    monkeypatch.setattr(los, "FIRST_LOOKS", looks)
    monkeypatch.setattr(los, "LOOK_CHUNK", 3)
    monkeypatch.setattr(los, "LOOK_PAIRS", 16)
    _, cells = rough(spark, 9, 21, 200)
    kept = cells.filter("cell_id % 10 = 3").select("cell_id")
    pairs = los.pairs_of_bits(los.visible_bits(cells, 9, 9))
    want = los.coverage(pairs, kept, 81).collect()
    assert 0 < want[0].n_seen < 73  # some cells with data are seen by none
    monkeypatch.setattr(los, "visible_bits", None)
    assert los.covered(cells, 9, 9, kept).collect() == want
    assert los.covered(cells, 9, 9, kept.filter("false")).first().n_seen == 0


def test_coverage_query_looks_a_few_times(spark, sf_dir, monkeypatch):
    """Before, coverage looked from each site's cell by packed rows."""
    monkeypatch.setattr(los, "visible_bits", None)
    assert QUERIES["coverage"](spark, sf_dir).first().n_seen > 0


@pytest.mark.parametrize("within", [0.0, 1.2, 4.0, 1000.0])
def test_links_look_as_far_as_they_reach(spark, monkeypatch, within):
    """Links within a range equal those of whole views; before, packed rows of the whole grid were made for them."""
    _, cells = rough(spark, 12, 8, 40)
    grid = near.Lattice(1.0, 2.0, 0.01, 12, 12)
    kept = cells.filter("cell_id % 3 <> 1").select("cell_id")
    whole = {(r.obs, r.tgt): r.km for r in los.kept_links(cells, grid, kept).collect()}
    monkeypatch.setattr(los, "visible_bits", None)
    got = los.kept_links(cells, grid, kept, within).collect()
    assert {(r.obs, r.tgt): r.km for r in got} == {k: x for k, x in whole.items() if x <= within} and len({(r.obs, r.tgt) for r in got}) == len(got)


@pytest.mark.parametrize("name", ["candidate_links", "plan_report", "parent_visibility"])
def test_queries_without_packed_rows(spark, sf_dir, monkeypatch, name):
    """Before, these made the packed row of each observer."""
    monkeypatch.setattr(los, "visible_bits", None)
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize(("n", "kind"), [(1, "whole"), (9, "whole"), (23, "whole"), (17, "parts"), (14, "towers")])
def test_blocks_see_what_single_observers_see(n, kind):
    """Rays of neighbouring observers, walked together, against those of each; towers of height 0 make most comparisons ties."""
    rng = np.random.default_rng(n)
    for wide, height in ((n, 10.0), (max(1, n // 2), 0.0), (2 * n + 5, 3.0)):
        z = rng.integers(100, 112, (n, wide)) + 3.0 * np.abs(np.arange(wide) - wide // 2) + (rng.random((n, wide)) if kind == "parts" else 0.0)
        z[rng.random(z.shape) < 0.06] = np.nan
        tower = rng.integers(0, 9, z.shape).astype(float) if kind == "towers" else np.full(z.shape, height)
        reach = (n // 2, wide // 3)
        r, c = np.nonzero(np.isfinite(z))
        who, tgt = los.Terrain(z, tower).near(r, c, reach)
        looker, got = rays.Looker(z, tower, reach), []
        for top in range(0, n, 10):
            for left in range(0, wide, 7):
                asked = np.isfinite(z[top : top + 10, left : left + 7])
                down, right, i, j = np.nonzero(looker.block(asked, top, left) & asked)
                got += zip(((top + i) * wide + left + j).tolist(), ((top + i + down - reach[0]) * wide + left + j + right - reach[1]).tolist(), strict=True)
        looker.close()
        assert sorted(got) == sorted(zip((r[who] * wide + c[who]).tolist(), tgt.tolist(), strict=True))


def test_report_makes_no_row_of_a_pair(spark, sf_dir, monkeypatch):
    """Before, every candidate link was a row; blocks and single observers count the same, also without Java."""
    want = sorted(map(tuple, QUERIES["plan_report"](spark, sf_dir).collect()))
    monkeypatch.setattr(los, "near_links", None)
    monkeypatch.setattr(los, "BLOCK_STEPS", 0)
    assert sorted(map(tuple, QUERIES["plan_report"](spark, sf_dir).collect())) == want and want


def test_counts_in_the_task_that_looked(spark):
    """Counts equal those of packed rows, also where a cell has no area or its area no parents."""
    _, cells = rough(spark, 10, 2)
    areas, parents, alive = np.arange(100) // 17 - 1, {2: (3, 4), 3: (4,), -1: (1,)}, np.arange(100) % 2 == 0
    want = los.sight_counts(los.visible_bits(cells, 10, 10), areas, parents, alive)
    assert sorted(map(tuple, los.looked_counts(cells, 10, 10, areas, parents, alive).collect())) == sorted(map(tuple, want.collect()))


def test_equal_rows_stay(spark):
    cells = square(spark, 4, lambda r, c: 10 * r + c)
    grid = near.Lattice(1.0, 2.0, 0.01, 4, 4)
    points = frame(spark, [(1, 0.991, 2.012), (1, 0.991, 2.012), (2, 0.974, 2.022)], "site_id long, lat double, lng double")
    assert near.nearest_cell(points, cells, grid).count() == 3
    assert gr.weighted_elevation(points, cells, 1.0, 2.0, 0.01).count() == 3
    links = frame(spark, [(0.991, 2.012, 0.974, 2.022, 7)] * 2, "lat1 double, lng1 double, lat2 double, lng2 double, cell_id long")
    snapped = near.snapped_links(links, cells, grid).collect()
    assert len(snapped) == 2 and len({(r.tail, r.head) for r in snapped}) == 1 and snapped[0].cell_id == 7


@pytest.mark.parametrize("lat", [0.0, 60.0, 84.0, -89.0])
def test_density_clusters_at_any_latitude(spark, lat):
    rng = np.random.default_rng(int(abs(lat)))
    wide = 0.002 / max(np.cos(np.radians(abs(lat) + 0.01)), 1e-3)
    points = [(k, float(lat + rng.uniform(-0.002, 0.002)), float(rng.choice([10.0, 179.9999, -179.9999]) + rng.uniform(-wide, wide) * (rng.random() < 0.9))) for k in range(60)]
    points = [(k, a, (b + 180) % 360 - 180) for k, a, b in points]
    comp = {k: k for k, _, _ in points}
    for i, a, b in points:
        for j, c, d in points:
            p, q = np.radians([a, b]), np.radians([c, d])
            h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
            if j < i and 2 * 6371000 * np.arcsin(np.sqrt(min(h, 1))) <= 50.0:
                x, y = comp[i], comp[j]
                comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    got = gp.density_clusters(frame(spark, points, "site_id long, lat double, lng double"), 50.0).collect()
    assert {r.site_id: r.cluster for r in got} == comp


def test_components_in_a_task_and_by_stars(spark):
    rng = np.random.default_rng(2)
    edges = frame(spark, [(int(a), int(b)) for a, b in rng.integers(-40, 40, (50, 2))], "a long, b long")
    here = {tuple(r) for r in gp.connected_components(edges).collect()}
    assert here == {tuple(r) for r in gp.connected_components(edges, most_in_task=0).collect()} and here
    assert gp.connected_components(edges.filter("false")).count() == 0


def test_ids_orders_and_sources(spark):
    nodes = frame(spark, [(7,), (3,), (7,), (100,)], "node long")
    ids = jb.local_ids(nodes)
    assert sorted(map(tuple, ids.collect())) == [(3, 0), (7, 1), (100, 2)]
    asked = frame(spark, [(7, "x"), (8, "y")], "node long, name string")
    assert sorted((r.node, r.local) for r in jb.to_local(asked, ids).collect()) == [(7, 1), (8, -1)]
    edges = frame(spark, [(k % 3, k, k * 7 % 50) for k in range(200)], "flow long, tail long, head long")
    want = sorted(edges.collect(), key=lambda r: (r.flow, f"{r.tail},{r.head}"))
    assert [tuple(r)[:3] for r in jb.kept_order(edges).orderBy("place").collect()] == [tuple(r) for r in want]
    kinds = frame(spark, [("a", "source"), ("a", "sink"), ("b", "sink"), ("c", "source"), ("c", "source")], "job_id string, kind string")
    assert sorted(map(tuple, jb.one_source(kinds).collect())) == [("a", 1, True), ("b", 0, False), ("c", 2, False)]


def test_bit_matrix_round_trip(spark, tmp_path):
    """Rows that do not end at a byte, and cells without an observer."""
    z = np.random.default_rng(8).integers(100, 150, (5, 5))
    cells = square(spark, 5, lambda r, c: None if (r, c) == (4, 4) else int(z[r, c])).withColumn("mount_h", F.lit(10))
    bits = los.visible_bits(cells, 5, 5)
    wr.write_bit_matrix(bits, 25, str(tmp_path / "m"))
    assert {tuple(r) for r in rd.read_bit_matrix(spark, str(tmp_path / "m"), 25).collect()} == {tuple(r) for r in los.pairs_of_bits(bits).collect()}


def test_bit_matrix_of_several_files(spark, tmp_path, monkeypatch):
    """A matrix beyond one file's bytes is cut between observers; its files joined are the one file."""
    z = np.random.default_rng(9).integers(100, 150, (7, 7))
    cells = square(spark, 7, lambda r, c: None if r == 3 else int(z[r, c])).withColumn("mount_h", F.lit(10))
    bits = los.visible_bits(cells, 7, 7)
    wr.write_bit_matrix(bits, 49, str(tmp_path / "one"))
    monkeypatch.setattr(wr, "MATRIX_BYTES", 100)
    wr.write_bit_matrix(bits, 49, str(tmp_path / "more"))
    files = sorted((tmp_path / "more").glob("out_49.bin.*"))
    assert len(files) == 4 and b"".join(f.read_bytes() for f in files) == (tmp_path / "one" / "out_49.bin").read_bytes()
    pairs = {tuple(r) for r in los.pairs_of_bits(bits).collect()}
    for k in ("one", "more"):
        assert {tuple(r) for r in rd.read_bit_matrix(spark, str(tmp_path / k), 49).collect()} == pairs
        assert {tuple(r) for r in rd.read_matrix_digest(spark, str(tmp_path / k), 49).collect()} == {(o, n, s) for o, n, s in map(tuple, los.seen_digest(bits).collect()) if n}


def test_large_matrix_is_no_error(spark, tmp_path):
    """More cells than one file used to hold: the files of the first and last observers are there."""
    n = 60_008
    row = np.zeros(n, np.uint8)
    row[[5, n - 1]] = 1
    bits = frame(spark, [(3, bytearray(np.packbits(row, bitorder="little").tobytes()))], "obs long, bits binary")
    made = {}
    class Stop(Exception):
        pass

    def first_files(_, path, parts):
        made[path] = next(iter(parts))
        raise Stop
    from unittest import mock

    with mock.patch.object(wr, "write_bytes", first_files), pytest.raises(Stop):
        wr.write_bit_matrix(bits, n, str(tmp_path))
    (path, eight), = made.items()
    assert path.endswith(f"out_{n}.bin.{0:012d}") and np.flatnonzero(np.unpackbits(np.frombuffer(eight, np.uint8), bitorder="little")).tolist() == [3 * n + 5, 4 * n - 1]


def test_catalogue_is_the_undominated_stairs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k, f"d{k}", int(rng.integers(1, 9)), int(rng.integers(1, 9)), int(rng.integers(1, 9)), True) for k in range(60)]
    devices = frame(spark, rows, "device_id int, ord int, name string, throughput int, range_km int, pair_cost int, selected boolean")
    left = {d.device_id for d in dev.catalogue(devices).first().devices}
    assert left == {a[0] for a in rows if not any((b[5], b[1]) < (a[5], a[1]) and b[3] >= a[3] and b[4] >= a[4] for b in rows)}
    edges = frame(spark, [(1, 2, 1, 50), (1, 3, 1, 60), (1, 4, 0, 70)], "tail long, head long, flow long, pair_cost int")
    pinned = frame(spark, [(1, 3, 5), (1, 9, 5)], "tail long, head long, device_id int")
    assert tuple(dev.equipment_cost(edges, pinned, devices).first()) == (50 + rows[5][5], 1)


def test_plan_with_pins_and_heights(spark):
    """A wall hides the sinks; a higher tower or a pinned link reaches them."""
    from ridgeplan.plans import planner

    cells = square(spark, 6, lambda r, c: 400 if c == 3 else 100)
    grid = near.Lattice(1.0, 2.0, 0.01, 6, 6)
    sites = frame(spark, [(0, 0, 0.99, 2.05, 4), (1, 1, 0.97, 2.04, 3), (2, 2, 0.97, 2.0, 0)], "site_id long, ord long, lat double, lng double, demand int")
    devices = frame(spark, [(1, 0, "a", 1000, 900, 50, True), (2, 1, "b", 5, 900, 20, True)], "device_id int, ord int, name string, throughput int, range_km int, pair_cost int, selected boolean")
    bare = planner.plan(sites, cells, grid, devices, removal_percent=100.0)
    assert bare.edges.count() == 0 and bare.document().count() == 0
    pinned = frame(spark, [(0.97, 2.0, 0.97, 2.04, 0, 1)], "lat1 double, lng1 double, lat2 double, lng2 double, throughput int, device_id int")
    made = planner.plan(sites, cells, grid, devices, removal_percent=100.0, pinned=pinned)
    got = {(r.tail, r.head): r for r in made.edges.collect()}
    assert set(got) == {(18, 22), (22, 11)} and got[18, 22].flow == 7 and got[18, 22].pinned and got[18, 22].device_id == 1 and got[18, 22].unit_cost == 0
    assert got[22, 11].flow == 4 and got[22, 11].device_id == 2 and got[22, 11].pair_cost == 20
    assert {(r.node, r.kind, r.supply) for r in made.nodes.collect()} == {(18, "source", 0), (22, "sink", 3), (11, "sink", 4)}
    assert '"equipmentCost":70' in made.document().first().json
    tall = planner.plan(sites, cells, grid, devices, heights=cells.select("cell_id", F.lit(900).alias("height")))
    assert sum(r.got for r in fl.delivered(tall.edges).filter("node <> 18").collect()) == 7


def test_flat_and_wall():
    flat = los.Terrain(np.full((7, 7), 5.0), np.full((7, 7), 10.0))
    assert flat.view(3, 3).sum() == 48
    z = np.zeros((7, 7))
    z[:, 3] = 1000
    wall = los.Terrain(z, np.full((7, 7), 10.0), "outward").view(3, 0)
    assert not wall[:, 4:].any() and wall[:, 3].any()
    assert not los.Terrain(np.full((3, 3), np.nan), np.full((3, 3), 10.0)).view(1, 1).any()


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


CELL = "cell_id long, r int, c int, lat double, lng double, z int"


def square(spark, n, z=lambda r, c: 100):
    return frame(spark, [(r * n + c, r, c, 1.0 - 0.01 * r, 2.0 + 0.01 * c, z(r, c)) for r in range(n) for c in range(n)], CELL)


def test_nearest_ties_go_to_the_highest(spark):
    grid = near.Lattice(1.0, 2.0, 0.01, 3, 3)
    points = frame(spark, [(1, 1.0, 2.005), (2, 5.0, 9.0), (3, 1.0, 2.0)], "site_id long, lat double, lng double")
    got = {r.site_id: r.cell_id for r in near.nearest_cell(points, square(spark, 3), grid).collect()}
    assert got == {1: 1, 2: 2, 3: 0}


def test_valid_neighbour(spark):
    grid = near.Lattice(1.0, 2.0, 0.01, 3, 3)
    points = frame(spark, [(1, 0.99, 2.01)], "site_id long, lat double, lng double")
    some = square(spark, 3, lambda r, c: None if (r, c) == (1, 1) else 100)
    got = near.nearest_valid_cell(points, some, grid).collect()[0]
    assert got.moved and got.cell_id != 4
    none = square(spark, 3, lambda r, c: None)
    assert near.nearest_valid_cell(points, none, grid).collect()[0].cell_id == 4


def test_source_moves_off_a_sink(spark):
    cells = square(spark, 3)
    source, sinks = frame(spark, [(4,)], "cell_id long"), frame(spark, [(4,), (5,)], "cell_id long")
    assert near.unique_source(source, sinks, cells).collect()[0].cell_id != 4
    assert near.unique_source(source, frame(spark, [(5,)], "cell_id long"), cells).collect()[0].cell_id == 4


def test_devices(spark):
    devices = frame(spark, [(1, 0, "a", 100, 10, 50), (2, 1, "b", 100, 10, 50), (3, 2, "c", 900, 40, 500), (4, 3, "d", 100, 5, 60)], "device_id int, ord int, name string, throughput int, range_km int, pair_cost int")
    links = frame(spark, [(1, 9.0, 50), (2, 9.0, 500), (3, 99.0, 1)], "link_id long, km double, need int")
    got = {r.link_id: r.device_id for r in dev.best_device(links, devices).collect()}
    assert got == {1: 1, 2: 3, 3: -1}
    assert {r.device_id for r in dev.best_device(links, devices.filter("false")).collect()} == {-1}


def test_many_devices(spark):
    devices = frame(spark, [(k, k, str(k), 10 * k, 10, 100 - k) for k in range(1, 11)], "device_id int, ord int, name string, throughput int, range_km int, pair_cost int")
    links = frame(spark, [(1, 1.0, 95)], "link_id long, km double, need int")
    assert dev.best_device(links, devices).collect()[0].device_id == 10


def test_tile_names(spark):
    rows = frame(spark, [(35.2, -106.6), (-0.5, 0.0), (0.0, -0.1), (7.0, 100.0)], "lat double, lng double")
    names = [r[0] for r in rows.select(geo.tile_name(F.col("lat"), F.col("lng"))).collect()]
    assert names == ["N35W107", "S01E000", "N00W001", "N07E100"]
    back = frame(spark, [("S01E000.hgt",), ("x.hgt",)], "t string").select(*geo.tile_origin(F.col("t"))).collect()
    assert tuple(back[0]) == (-1, 0) and tuple(back[1]) == (None, None)


@pytest.mark.parametrize("head", ["cellsize 0.5", "dx 0.5\ndy 0.5", "dx 0.5\ndy 0.5\nNODATA_value -1"])
def test_ascii_grid(spark, tmp_path, head):
    path = tmp_path / "grid.asc"
    path.write_text(f"ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\n{head}\n1 2 65535\n-1 5 6\n")
    meta, cells = rd.read_aaigrid(spark, str(path))
    z = [r.z for r in cells.orderBy("cell_id").collect()]
    assert z == ([1, 2, 65535, None, 5, 6] if "NODATA" in head else [1, 2, None, -1, 5, 6])
    assert meta.collect()[0].dx == 0.5


def test_hgt(spark, tmp_path):
    z = np.array([[1, 2, 3], [4, -32768, 6], [7, 8, 20000]], ">i2")
    (tmp_path / "N35W107.hgt").write_bytes(z.tobytes())
    got = rd.read_hgt(spark, str(tmp_path)).orderBy("r", "c").collect()
    assert [r.z for r in got] == [1, 2, 3, 4, None, 6, 7, 8, None]
    assert (got[0].lat, got[0].lng) == (36.0, -107.0) and (got[-1].lat, got[-1].lng) == (35.0, -106.0)


def test_paths_of_a_graph_beyond_the_broadcast(spark, monkeypatch):
    """A graph of more edges than are broadcast is dealt out by components and gives the same paths."""
    rng = np.random.default_rng(31)
    rows = [(int(a) + 100 * k, int(b) + 100 * k, int(w)) for k in range(5) for a, b, w in zip(*rng.integers(0, 25, (2, 60)), rng.integers(1, 9, 60), strict=True) if a != b]
    edges = frame(spark, rows, "a long, b long, w int").groupBy("a", "b").agg(F.min("w").alias("w"))
    asked = frame(spark, [(k,) for k in (*range(9), 101, 303, 304, 999)], "node long")
    want = sorted(map(tuple, gp.shortest_paths(edges, asked).collect()))
    monkeypatch.setattr(gp, "MOST_EDGES", 10)
    assert sorted(map(tuple, gp.shortest_paths(edges, asked).collect())) == want and want
    assert gp.shortest_paths(edges, asked.filter("node = 999")).count() == 0


def test_many_sources_are_walked_by_a_child(spark, monkeypatch):
    """Distances, hops and farthest nodes of the child process are those of the plain search; before, each source kept a heap in Python."""
    rng = np.random.default_rng(8)
    u, v, w = *rng.integers(0, 300, (2, 900)), rng.integers(1, 12, 900)
    graph = gp.Csr(*(np.append(x[u != v], more) for x, more in ((u, 400), (v, 401), (w, 3))))
    sources = [*range(0, 300, 7), 401, 4711]
    want = {s: graph.shortest(s) for s in sources if s in graph.nodes}
    monkeypatch.setattr(gp, "WALKED_ARCS", 0)
    monkeypatch.setattr(gp.Csr, "shortest", None)
    got = {s: (dist, hops) for s, dist, hops in graph.shortest_of(sources)}
    assert got.keys() == want.keys() and any(np.isinf(dist).any() for dist, _ in want.values())
    for s, (dist, hops) in want.items():
        near = np.isfinite(dist)
        assert (got[s][0] == dist).all() and (got[s][1][near] == hops[near]).all()


def test_farthest_is_chosen_where_paths_are_found(spark):
    """One row per source leaves the task; before, all paths were exchanged."""
    rng = np.random.default_rng(12)
    edges = frame(spark, [(int(a), int(b), int(w)) for a, b, w in zip(*rng.integers(0, 60, (2, 90)), rng.integers(1, 4, 90), strict=True) if a != b], "a long, b long, w int")
    asked = frame(spark, [(k,) for k in range(60)], "node long")
    want = sorted(map(tuple, gp.farthest(gp.shortest_paths(edges, asked)).collect()))
    assert sorted(map(tuple, gp.shortest_paths(edges, asked, last_only=True).collect())) == want and want


def test_flow_keeps_its_arcs_in_a_file(spark):
    """The task of a cheapest flow holds runs of tails, not arcs; runs of one tail may lie apart."""
    import pyarrow as pa

    rng = np.random.default_rng(37)
    arcs = {(int(a), int(b)): int(c) for a, b, c in zip(*rng.integers(0, 40, (2, 500)), rng.integers(0, 30, 500), strict=True) if a != b}
    order = sorted(arcs)
    batches = [pa.record_batch({"tail": [a for a, _ in part], "head": [b for _, b in part], "unit_cost": [arcs[x] for x in part]}) for part in (order[1::2], order[::2])]
    file = fl.ArcFile(iter(batches), np.array([99]))
    assert not any(isinstance(x, np.ndarray) and len(x) > 2 * len(file.nodes) + 2 for x in vars(file).values())
    for u, name in enumerate(file.nodes.tolist()):
        head, cost = file.arcs_of(u)
        assert sorted(zip(file.nodes[head].tolist(), cost.tolist(), strict=True)) == sorted((b, c) for (a, b), c in arcs.items() if a == name)
    dist = {0: 0}
    for _ in range(60):
        for (a, b), c in arcs.items():
            if a in dist and dist[a] + c < dist.get(b, 10**9):
                dist[b] = dist[a] + c
    got, before, price, settled = fl.shortest_tree(len(file.nodes), file.arcs_of, int(np.searchsorted(file.nodes, 0)))
    assert {int(file.nodes[v]): int(got[v]) for v in settled} == dist
    assert all(got[v] == got[before[v]] + price[v] for v in settled[1:])


def test_arcs_of_a_flow_are_exchanged_once_and_packed(spark, monkeypatch):
    """One exchange of three columns, of parallel arcs the cheapest, and a file of fewer than eight bytes an arc; before, two exchanges and sixteen bytes."""
    import pyarrow as pa

    plans, plain = [], fl.materialize
    monkeypatch.setattr(fl, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, tag))
    arcs = frame(spark, [(0, 1, 5, 1, 9, False, 1.0), (0, 1, 4, 1, 9, False, 1.0), (1, 2, 3, 1, 9, False, 1.0), (0, 2, 1, 0, 9, False, 1.0)], "tail long, head long, unit_cost long, capacity int, pair_cost int, pinned boolean, km double")
    demands = frame(spark, [(2, 7)], "node long, demand long")
    assert sorted(map(tuple, fl.cheapest_flow(arcs, 0, demands).collect())) == [(0, 1, 7, 4), (1, 2, 7, 3)]
    assert plans[0].count("Exchange hashpartitioning") == 1
    rng = np.random.default_rng(3)
    heads = [np.sort(rng.choice(900, 300, replace=False)) for _ in range(20)]
    batches = [pa.record_batch({"tail": np.full(300, k), "head": h, "unit_cost": 60 + np.abs(h - 450) // 4}) for k, h in enumerate(heads)]
    file = fl.ArcFile(iter(batches), np.array([0]))
    assert file.file.tell() < 8 * 20 * 300 and all((file.nodes[file.arcs_of(int(np.searchsorted(file.nodes, k)))[0]] == h).all() for k, h in enumerate(heads))


def test_pins_do_not_exchange_arcs(spark):
    """A few pins take the place of their arcs or stand alone; before, all arcs were exchanged and sorted to meet them."""
    from ridgeplan.operators import devices as dev

    arcs = frame(spark, [(0, 1, 5, 3, 8), (1, 2, 6, 3, 8), (2, 0, 7, 3, 8)], "tail long, head long, unit_cost long, capacity int, device_id int")
    pinned = frame(spark, [(1, 2, 0, 4), (5, 6, 9, None)], "tail long, head long, throughput int, device_id int")
    got = dev.pinned_overlay(arcs, pinned, 100)
    assert sorted(map(tuple, got.collect()), key=str) == [(0, 1, 5, 3, 8, False), (1, 2, 0, 100, 4, True), (2, 0, 7, 3, 8, False), (5, 6, 0, 9, None, True)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_bit_matrix(spark, tmp_path):
    m = np.zeros((9, 9), np.uint8)
    m[0, 8] = m[4, 1] = m[8, 8] = 1
    (tmp_path / "out_9.bin").write_bytes(np.packbits(m.ravel(), bitorder="little").tobytes())
    assert {tuple(r) for r in rd.read_bit_matrix(spark, str(tmp_path), 9).collect()} == {(0, 8), (4, 1), (8, 8)}


def test_sink_files_of_both_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0, 2.0, 5, 100\n1.1, 2.1, 6, 100\n")
    assert [r.mounting_height for r in rd.read_sinks(spark, str(tmp_path / "a.csv")).collect()] == [10, 10]
    (tmp_path / "b.csv").write_text("1.0,2.0,5,100,15\n1.1,2.1,6.0,100,20\n")
    assert [r.demand for r in rd.read_sinks(spark, str(tmp_path / "b.csv"), last_row_is_source=True).collect()] == [5]
    (tmp_path / "p.csv").write_text("1,2,3,4\n1,2,3,4,100.0,5.0,90.0,2.0\n")
    assert [r.device_id for r in rd.read_pinned_links(spark, str(tmp_path / "p.csv")).orderBy("ord").collect()] == [None, 2]
    (tmp_path / "u.csv").write_text('u1,x,"a,b",c,d,e\nu2,x,,c,d,e\n')
    assert {r.user_id: r.jobs for r in rd.read_users(spark, str(tmp_path / "u.csv")).collect()} == {"u1": ["a", "b"], "u2": []}


def test_missing_kept_file_keeps_all(spark, tmp_path):
    assert rd.read_kept(spark, str(tmp_path / "none.txt"), square(spark, 2)).count() == 4


def test_cluster_folder(spark, tmp_path):
    (tmp_path / "c1").write_text("1.0,2.0\n1.1,2.1\n")
    assert [r.is_centre for r in rd.read_cluster_folder(spark, str(tmp_path)).orderBy("lat").collect()] == [True, False]


def test_preferred_tiles(spark):
    fine, coarse = frame(spark, [("A", "f")], "tile string, path string"), frame(spark, [("A", "c"), ("B", "c")], "tile string, path string")
    assert {r.tile: r.path for r in rd.preferred_tiles(fine, coarse).collect()} == {"A": "f", "B": "c"}


def unit_steps(cost, source, demand, limit):
    """Min-cost flow, one unit at a time along a cheapest residual path."""
    n, flow, left = len(cost), np.zeros(cost.shape, int), demand.copy()
    while left.any():
        dist, before = np.full(n, np.inf), [None] * n
        dist[source] = 0
        for _ in range(n):
            for u in range(n):
                for v in range(n):
                    if flow[u, v] < limit[u, v] and dist[u] + cost[u, v] < dist[v] - 1e-9:
                        dist[v], before[v] = dist[u] + cost[u, v], (u, 1)
                    if flow[v, u] > 0 and dist[u] - cost[v, u] < dist[v] - 1e-9:
                        dist[v], before[v] = dist[u] - cost[v, u], (u, -1)
        open_ = [t for t in range(n) if left[t] > 0 and np.isfinite(dist[t])]
        if not open_:
            break
        t = v = min(open_, key=lambda t: dist[t])
        while v != source:
            u, way = before[v]
            if way == 1:
                flow[u, v] += 1
            else:
                flow[v, u] -= 1
            v = u
        left[t] -= 1
    return flow, left


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_min_cost_flow(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 7))
    cost = np.where(rng.random((n, n)) < 0.6, rng.integers(0, 9, (n, n)).astype(float), np.inf)
    np.fill_diagonal(cost, np.inf)
    limit, demand = np.where(np.isfinite(cost), rng.integers(1, 5, (n, n)), 0), rng.integers(0, 4, n)
    demand[0] = 0
    flow = fl.min_cost_flow(cost, 0, demand, limit)
    want, left = unit_steps(cost, 0, demand, limit)
    net = (flow.sum(0) - flow.sum(1))[1:]
    assert (flow >= 0).all() and (flow <= limit).all() and (net >= 0).all() and (net <= demand[1:]).all()
    assert net.sum() == (want.sum(0) - want.sum(1))[1:].sum()
    price = lambda f: (np.where(f > 0, cost, 0) * f).sum()
    if not left.any():
        assert price(flow) == price(want)
    free, _ = unit_steps(cost, 0, demand, np.where(np.isfinite(cost), 10**6, 0))
    assert price(fl.min_cost_flow(cost, 0, demand)) == price(free)


def small_net(seed):
    rng = np.random.default_rng(seed)
    n = 5
    cost = np.full((n, n), np.inf)
    arcs = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (0, 3)]
    for u, v in arcs:
        cost[u, v] = rng.integers(1, 20)
    have = np.isfinite(cost)
    return fl.Network(np.arange(n), cost, np.where(have, rng.integers(5, 9, (n, n)), 0), np.where(have, rng.integers(10, 99, (n, n)), 0), 0, np.array([0, 1, 1, 2, 1]))


@pytest.mark.parametrize("seed", range(4))
def test_designs(seed):
    net = small_net(seed)
    flow, kept, trace, complete = fl.randomised_rounding(net, seed, False)
    assert complete and trace[-1] == 0 and fl._met(net, flow) == 5
    cut = fl.randomised_rounding(net, seed, False, most=1)
    assert len(cut[2]) == 1 and fl._met(net, cut[0]) == 5 and (cut[3] == (not ((cut[0] > 0) & ~cut[1]).any()) or not cut[3])
    better, _, _, done = fl.local_search(net, flow, kept, "leaf")
    better, _, _, done = fl.local_search(net, better, kept, "rest")
    assert done and not fl.local_search(net, flow, np.isfinite(net.cost), "leaf", most=0)[3]
    assert fl.equipment_cost(net, better) <= fl.equipment_cost(net, flow) and fl._met(net, better) == 5
    exact = fl.fixed_charge_exact(net, net.device_cost)
    incumbents = list(fl.slope_scaling(net, net.device_cost))
    assert exact is not None and incumbents[-1][0] >= exact[0]
    totals = [t for t, _ in incumbents]
    assert all(fl._met(net, f) == 5 for _, f in incumbents[-1:]) and totals


def test_no_feasible_device_drops_the_arc(spark):
    arcs = frame(spark, [(0, 1, 5, 0, 0, False), (0, 2, 5, 9, 10, False)], "tail long, head long, unit_cost long, capacity int, pair_cost int, pinned boolean")
    net = fl.network(arcs, 0, frame(spark, [(1, 2), (2, 1), (2, 1)], "node long, demand int"))
    assert np.isfinite(net.cost).sum() == 1 and net.demand.tolist() == [0, 2, 2]
    assert fl.min_cost_flow(net.cost, net.source, net.demand).sum() == 2


def test_components_and_trees(spark):
    edges = frame(spark, [(1, 2), (2, 3), (7, 8), (8, 8), (3, 1)], "a long, b long")
    got = {r.node: r.component for r in gp.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    tree = {r.node: (r.level, r.parent) for r in gp.spanning_tree(edges, frame(spark, [(k,) for k in (1, 2, 3, 7, 8, 9)], "node long")).collect()}
    assert tree == {1: (0, None), 2: (1, 1), 3: (1, 1), 7: (0, None), 8: (1, 7), 9: (0, None)}
    assert gp.connected_components(edges.filter("false")).count() == 0


def test_shortest_paths(spark):
    edges = frame(spark, [(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0), (5, 6, 1.0)], "a long, b long, w double")
    got = {(r.source, r.node): (r.dist, r.hops) for r in gp.shortest_paths(edges, frame(spark, [(1,), (77,)], "node long")).collect()}
    assert got == {(1, 1): (0.0, 0), (1, 2): (5.0, 1), (1, 3): (6.0, 2)}


def test_cascade(spark):
    edges = frame(spark, [(1, 2), (2, 3), (4, 5), (5, 6), (9, 5)], "tail long, head long")
    left = gp.cascade_delete(edges, frame(spark, [(3,), (9,)], "node long"), frame(spark, [(6,)], "node long"))
    assert {tuple(r) for r in left.collect()} == {(1, 2), (2, 3)}


@pytest.mark.parametrize("seed", range(3))
def test_sparse_flow_is_the_dense_one(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(u), int(v), int(rng.integers(0, 30)), int(rng.integers(0, 4)), 5, False, float(rng.integers(1, 9))) for u, v in rng.integers(0, 12, (60, 2)) if u != v]
    arcs = frame(spark, rows, "tail long, head long, unit_cost long, capacity int, pair_cost int, pinned boolean, km double")
    demands = frame(spark, [(k, int(rng.integers(1, 5))) for k in range(1, 12)] + [(3, 2), (99, 1)], "node long, demand int")
    for longest in (0.0, 6.0):
        flow = fl.cheapest_flow(arcs, 0, demands, longest)
        net = fl.network(arcs, 0, demands, longest)
        dense = fl.min_cost_flow(net.cost, net.source, net.demand)
        assert sum(r.flow * r.unit_cost for r in flow.collect()) == fl.flow_cost(net, dense)
        got = {r.node: r.got for r in fl.delivered(flow).collect() if r.node != 0}
        want = dict(zip(net.nodes.tolist(), (dense.sum(0) - dense.sum(1)).tolist(), strict=True))
        assert all(want[k] == v for k, v in got.items()) and sum(got.values()) == sum(v for k, v in want.items() if k != 0)
    assert fl.cheapest_flow(arcs.filter("false"), 0, demands).count() == 0


def test_pins_and_traces(spark):
    edges = frame(spark, [(0, 1, 5), (1, 2, 1)], "tail long, head long, flow long")
    pinned = frame(spark, [(0, 1), (1, 2), (1, 2), (7, 8)], "tail long, head long")
    assert tuple(fl.pins_carry_flow(edges, pinned).first()) == (False, 2)
    assert tuple(fl.pins_carry_flow(edges, pinned.limit(0)).first()) == (True, 0)
    runs = fl.solved_runs(small_net(1), spark, 2, 3)
    trace = fl.search_trace(runs.filter("stage = 'rounding'")).collect()
    assert {r.run for r in trace} == {0, 1} and all(r.cost >= 0 for r in trace) and runs.filter("NOT complete").count() == 0


def test_areas_and_contours(spark):
    cells = square(spark, 4, lambda r, c: None if r == 3 else 100 + 100 * (c > 1))
    areas = gp.elevation_areas(cells, 100)
    assert {r.area_id for r in areas.collect()} == {0, 2} and areas.count() == 12
    assert {tuple(r) for r in gp.area_parents(areas).collect()} == {(0, 2)}
    assert {r.level for r in gr.contours(cells).collect()} == {200}


def test_best_subset():
    rows = [np.array([0b0011], np.uint8), np.array([0b0110], np.uint8), np.array([0b1100], np.uint8)]
    assert rm.best_subset(rows, 2) == [0, 2]
    assert rm.best_subset(rows, 0) == [] and rm.best_subset(rows, 9) == [0, 1, 2]
    many = [np.array([k], np.uint8) for k in range(21)]
    assert len(rm.best_subset(many, 5)) == 5


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_removal_counts(spark, percent):
    cells = square(spark, 4, lambda r, c: None if (r, c) == (0, 0) else 100)
    removed, kept = rm.random_removal(cells, percent, F.col("cell_id") % 5)
    assert removed.count() == 15 * percent // 100 and kept.count() == 15 - removed.count()
    bits = los.visible_bits(cells.withColumn("mount_h", F.lit(10)), 4, 4).select("obs", "bits")
    kept = rm.elevation_removal(bits, cells.filter("z IS NOT NULL").select("cell_id", geo.elevation_bucket(F.col("z")).alias("bucket")), percent)
    assert kept.count() == -(-15 * (100 - percent) // 100)


@pytest.mark.parametrize("scope", ["bucket", "map"])
@pytest.mark.parametrize("percent", [40, 90])
def test_elevation_removal_by_hand(spark, scope, percent):
    """Unions by subset are those of the packed rows; the first of the best subsets is kept."""
    rng = np.random.default_rng(percent)
    z = rng.integers(100, 125, (8, 8))
    cells = square(spark, 8, lambda r, c: int(z[r, c])).withColumn("mount_h", F.lit(10))
    bits = los.visible_bits(cells, 8, 8)
    buckets = cells.select("cell_id", geo.elevation_bucket(F.col("z")).alias("bucket"))
    got = {}
    for r in rm.elevation_removal(bits.select("obs", "bits"), buckets, percent, scope).collect():
        got.setdefault(r.bucket, set()).add(r.cell_id)
    rows = {r.obs: np.frombuffer(bytes(r.bits), np.uint8) for r in bits.collect()}
    for bucket in range(10, 13):
        own = np.flatnonzero((z // 10).ravel() == bucket)
        mask = np.full(64, scope == "map")
        mask[own] = True
        mask = np.packbits(mask, bitorder="little")
        best, most = None, -1
        for chosen in rm.keep_options(own, percent):
            n = int(np.bitwise_count(np.bitwise_or.reduce([rows[k] for k in chosen.tolist()]) & mask).sum())
            if n > most:
                best, most = set(chosen.tolist()), n
        assert got[bucket] == best


@pytest.mark.parametrize("scope", ["bucket", "map"])
@pytest.mark.parametrize("percent", [0, 40, 90, 95, 100])
def test_removal_without_every_view(spark, monkeypatch, scope, percent):
    """Large, small and single-subset buckets keep what the packed rows of all cells keep; before, every cell looked."""
    monkeypatch.setattr(los, "FIRST_LOOKS", 1)
    monkeypatch.setattr(rm, "EXHAUSTIVE", 6)
    z, cells = rough(spark, 11, percent, 28)
    buckets = cells.filter("z IS NOT NULL").select("cell_id", F.when(F.col("z") > 126, 99).otherwise(geo.elevation_bucket(F.col("z"))).alias("bucket"))
    want = rm.elevation_removal(los.visible_bits(cells, 11, 11).select("obs", "bits"), buckets, percent, scope).collect()
    monkeypatch.setattr(los, "visible_bits", None)
    got = rm.viewed_removal(cells, 11, 11, buckets, percent, scope).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and (len({r.bucket for r in want}) > 2) == (percent < 100)


@pytest.mark.parametrize("name", ["elevation_removal", "whole_map_removal"])
def test_removal_queries_look_from_few_cells(spark, sf_dir, monkeypatch, name):
    """Before, both made the packed row of every cell with data."""
    monkeypatch.setattr(los, "visible_bits", None)
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_random_removal_with_ties(spark):
    cells = square(spark, 12, lambda r, c: None if (r + c) % 7 == 0 else 100)
    ids = sorted((k * 31 % 5, k) for k in range(144) if (k // 12 + k % 12) % 7)
    for percent in (0, 33, 60, 99.9, 100):
        removed, kept = rm.random_removal(cells, percent, F.col("cell_id") * 31 % 5)
        n = int(len(ids) * percent // 100)
        assert {r.cell_id for r in removed.collect()} == {k for _, k in ids[:n]} and {r.cell_id for r in kept.collect()} == {k for _, k in ids[n:]}
    assert rm.random_removal(cells.filter("false"), 50, F.col("cell_id"))[1].count() == 0


def test_cluster_removal_goes_down_from_the_highest(spark):
    """A cell of the lower area that sees the kept cell of the upper one comes first."""
    cells = square(spark, 6, lambda r, c: 250 if c >= 4 else 150).withColumn("mount_h", F.lit(10))
    areas = gp.elevation_areas(cells, 100)
    bits = los.visible_bits(cells, 6, 6).select("obs", "bits")
    sample = areas.join(cells.select("cell_id", "lat", "lng"), "cell_id")
    kept = rm.remove_from_above(sample, areas, gp.area_parents(areas), bits, 36, 95.0).collect()
    assert Counter(r.area_id for r in kept) == {0: 2, 4: 1}
    top = next(r.cell_id for r in kept if r.area_id == 4)
    seen = {(r.obs, r.tgt) for r in los.pairs_of_bits(bits).collect()}
    sees = {r.cell_id for r in areas.collect() if r.area_id == 0 and (r.cell_id, top) in seen}
    assert not sees or any(r.cell_id in sees for r in kept)


def test_spaced_pick_stops():
    far = [[(1, 0.0, 0.0), (2, 0.0, 1.0)], [(3, 0.0, 0.5)]]
    assert rm.spaced_pick(far, 1000.0, 3) == [1]
    assert sorted(rm.spaced_pick(far, 0.0, 3)) == [1, 2, 3]


def test_spectral():
    x = np.array([0.0, 0.1, 0.2, 9.0, 9.1])
    labels = gp.spectral_clusters(np.abs(x[:, None] - x[None, :]), 2)
    assert len(set(labels[:3])) == 1 and len(set(labels[3:])) == 1 and labels[0] != labels[4]
    assert len(gp.spectral_clusters(np.empty((0, 0)), 3)) == 0


def test_track(spark):
    rows = frame(spark, [("a", 0.0, None), ("a", 1.0, 10.0), ("a", 3.0, None), ("a", 5.0, 30.0), ("a", 6.0, None), ("b", 0.0, None)], "k string, d double, z double")
    got = [r.filled for r in gr.filled_track(rows, "k", "d", "z", "d").orderBy("k", "d").collect()]
    assert got == [10.0, 10.0, 20.0, 30.0, 30.0, None]


def test_padded_box_of_one_point(spark):
    box = gr.bounding_box(frame(spark, [(1.0, 2.0)], "lat double, lng double"), 0.1).collect()[0]
    assert box.n > 1.0 > box.s and box.e > 2.0 > box.w


def test_job_arrays(spark):
    rows = frame(spark, [(["a", "b", "c"],), (["a"],)], "jobs array<string>")
    got = [r[0] for r in rows.select(jb.add_job(F.col("jobs"), F.lit("x"))).collect()]
    assert got == [["a", "b", "c"], ["a", "x"]]


def test_planner_json_round_trip(spark, tmp_path):
    sinks = frame(spark, [(3, 5, 100, 10, 1.0, 2.0), (3, 6, 100, 15, 1.0, 2.0)], "cell_id long, demand int, revenue int, mounting_height int, lat double, lng double")
    source = frame(spark, [(7, 10, 1.5, 2.5)], "cell_id long, mounting_height int, lat double, lng double")
    wr.planner_json(sinks, source).select(F.col("json").alias("value")).write.text(str(tmp_path / "j"))
    sources, back = rd.read_planner_nodes(spark, str(tmp_path / "j"))
    assert [(r.cell_id, r.demand) for r in back.collect()] == [(3, 11)]
    assert [(r.cell_id, r.capacity) for r in sources.collect()] == [(7, 11)]


def test_solution_in_lines(spark, sf_dir, tmp_path, monkeypatch):
    """The lines of a run are its document, dealt over files; before, a run was one row of arrays and text."""
    rng = np.random.default_rng(4)
    rows = [(run, int(a), int(b), int(f), 70, 3, 900, 1.5, 11) for run in range(3) for a, b, f in rng.integers(0, 4, (30, 3))] + [(7, 90, 91, 2, 5, 1, 10, 0.5, None)]
    edges = frame(spark, rows, "run long, tail long, head long, flow long, unit_cost long, device_id int, pair_cost int, km double, capacity int")
    nodes = frame(spark, [(k, "sink" if k % 2 else "intermediate", 1.0 + k, 2.0, 10, 5 * k) for k in range(4)], "node long, kind string, lat double, lng double, mounting_height int, supply long")
    for own, of in ((edges, nodes), (edges.drop("capacity"), nodes.drop("supply"))):
        path = str(tmp_path / f"solutions-{len(own.columns)}")
        wr.write_solution(own.repartition(5), of, path)
        want = {r.run: json.loads(r.json) for r in wr.solution_json(own, of).collect()}
        got = {k: json.loads("\n".join(part.read_text() for part in sorted((tmp_path / path / f"run={k}").glob("part-*")))) for k in want}
        assert got == want and set(want) == {0, 1, 2, 7}
        links, ends, totals = rd.read_solution(spark, path)
        assert {r.run: r.n for r in links.groupBy("run").agg(F.count("edge.edgeProperty.length").alias("n")).collect()} == {k: len(x["edges"]) for k, x in want.items()}
        assert {r.run: r.n for r in ends.groupBy("run").agg(F.sum("node.node").alias("n")).collect()} == {k: sum(n["node"] for n in x["nodes"]) for k, x in want.items() if "nodes" in x}
        assert {r.run: (r.costs, r.originalCost, r.equipmentCost) for r in totals.collect()} == {k: (x["costs"], x["originalCost"], x["equipmentCost"]) for k, x in want.items()}
    monkeypatch.setattr(wr, "solution_json", None)
    assert QUERIES["solution_document"](spark, sf_dir).count() == 10


def test_resample_and_bits(spark):
    cells = square(spark, 4, lambda r, c: 10 * r + c)
    assert [r.z for r in gr.resample(cells, 2, 2, 4, 4).orderBy("cell_id").collect()] == [11, 13, 31, 33]
    pairs = frame(spark, [(0, 3), (0, 8), (5, 1)], "obs long, tgt long")
    assert {tuple(r) for r in los.pairs_of_bits(los.bits_of_pairs(pairs, 9)).collect()} == {(0, 3), (0, 8), (5, 1)}


def test_browser_json(spark):
    nodes = frame(spark, [(1, "sink", 1.0, 2.0), (2, "source", 3.0, 4.0)], "node long, kind string, lat double, lng double")
    edges = frame(spark, [(1, 1, 2, 5), (2, 1, 2, None)], "edge_id long, tail long, head long, device_id int")
    back_nodes, back_edges = wr.from_browser_json(wr.browser_json(nodes, edges))
    assert sorted(back_nodes.collect()) == sorted(nodes.collect())
    assert [tuple(r) for r in back_edges.orderBy("edge_id").collect()] == [(1, 1, 2, 5), (2, 1, 2, None)]


def test_lp_lines():
    net = small_net(0)
    lines = wr.lp_lines(net, net.device_cost)
    assert lines[0] == "Minimize" and lines[-1] == "End"
    assert sum(line.startswith(" cap_") for line in lines) == 8 and sum(line.startswith(" sink_") for line in lines) == 4
