"""Graphs on cells: areas of equal elevation, components, spanning trees, shortest paths, cascades.

Iterative operators write each round's table to the shared folder (``materialize``) and stop
when nothing changes; the number of rounds is that of the longest path involved, or
logarithmic for components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.operators.paths import Walker, walkable
from ridgeplan.runtime import materialize

#: Rows of a small table (a few longs each) that may be broadcast after they were counted.
BROADCAST_ROWS = 150_000
#: Links (two longs each) that one task joins; a few dozen MB.
TASK_EDGES = 1_000_000


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join a materialised table: broadcast if it has few rows, else exchanged on the key."""
    return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right.hint("merge"), on, how)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    met = join_counted(pairs, least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter("u <> v").distinct()


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), ascending, and the smallest node of each one's component."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, label = both[: len(u)], both[len(u) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)  # hooks roots, so that a whole tree follows
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _solve_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        node, component = least_labels(*(np.concatenate(c) for c in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(component, pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, most_in_task: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: its smallest node.

    Up to ``most_in_task`` distinct links, which are counted, are joined in one task of an
    executor.  More go through alternating stars:
    a large star links every larger neighbour of a node with the node's smallest neighbour,
    a small star does so with the smaller neighbours and the node.
    Self links and repeated links change nothing; no links give no rows.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "links")
    seen = _state(now)
    if seen[0] <= most_in_task:
        return materialize(now.coalesce(1).mapInArrow(_solve_here, "node long, component long"), "components")
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = materialize(_star(both, large=True), "links")
        now = materialize(_star(larger.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large=False), "links")
        fresh = _state(now)
        if fresh == seen:
            break
        seen = fresh
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct(), "components")


def grid_neighbours(cells: DataFrame) -> DataFrame:
    """(a, b) of cells side by side, each pair once (east and south)."""
    shift = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    asked = cells.withColumn("s", shift).select(F.col("cell_id").alias("a"), F.col("bucket").alias("bucket_a"), (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return asked.join(cells.select(F.col("cell_id").alias("b"), F.col("bucket").alias("bucket_b"), "r", "c"), ["r", "c"]).select("a", "b", "bucket_a", "bucket_b")


def elevation_areas(cells: DataFrame, width: int = 10) -> DataFrame:
    """(cell_id, bucket, area_id): 4-connected cells of one elevation bucket; area: its smallest cell.

    Cells without data are in no area.
    """
    ground = cells.filter("z IS NOT NULL").select("cell_id", "r", "c", geo.elevation_bucket(F.col("z"), width).alias("bucket"))
    pairs = grid_neighbours(ground).filter("bucket_a = bucket_b").select("a", "b")
    area = connected_components(pairs)
    return ground.join(area, ground.cell_id == area.node, "left").select("cell_id", "r", "c", "bucket", F.coalesce("component", "cell_id").alias("area_id"))


def area_parents(areas: DataFrame) -> DataFrame:
    """(area_id, parent_area_id): neighbouring areas one bucket higher."""
    near = grid_neighbours(areas)
    both = near.select("a", "b", "bucket_a", "bucket_b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bucket_b").alias("bucket_a"), F.col("bucket_a").alias("bucket_b")))
    of = areas.select("cell_id", "area_id")
    up = both.filter("bucket_b = bucket_a + 1").join(of.withColumnRenamed("cell_id", "a"), "a").join(of.select(F.col("cell_id").alias("b"), F.col("area_id").alias("parent_area_id")), "b")
    return up.select("area_id", "parent_area_id").distinct()


def spanning_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, level, parent) of the breadth-first tree from each component's smallest node.

    ``edges``: (a, b) taken both ways.  Of several possible parents the smallest is taken.
    Nodes without an edge are their own component.
    """
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    comps = connected_components(edges)
    known = nodes.select("node").distinct().join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    front = materialize(known.filter("node = component").select("node", "component", F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")), "tree")
    reached, level = front, 0
    while front.limit(1).count():
        level += 1
        step = front.select(F.col("node").alias("a"), "component").join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("component"), F.min("a").alias("parent"))
        front = materialize(step.join(reached.select("node"), "node", "left_anti").select("node", "component", F.lit(level).alias("level"), "parent"), "tree")
        reached = reached.unionByName(front)
    return reached


class Csr:
    """An undirected weighted graph of a checked size as arrays."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        self.nodes = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(self.nodes, np.concatenate([u, v])), np.searchsorted(self.nodes, np.concatenate([v, u]))
        order = np.argsort(a, kind="stable")
        self.to, self.weight = b[order], np.concatenate([w, w])[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))

    def shortest(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance and hops (of the shortest path with fewest hops) from a node; infinite if out of reach."""
        n = len(self.nodes)
        dist, hops = np.full(n, np.inf), np.zeros(n, np.int64)
        start = int(np.searchsorted(self.nodes, source))
        if start == n or self.nodes[start] != source:
            return dist, hops
        dist[start] = 0.0
        heap, done = [(0.0, 0, start)], np.zeros(n, bool)
        while heap:
            d, h, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x], hops[x] = True, h
            for k in range(self.first[x], self.first[x + 1]):
                y, nd = self.to[k], d + self.weight[k]
                if nd < dist[y] or (nd == dist[y] and not done[y] and h + 1 < hops[y]):
                    dist[y], hops[y] = nd, h + 1
                    heapq.heappush(heap, (nd, h + 1, int(y)))
        return dist, hops

    def shortest_of(self, sources: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(source, distance, hops) of each source that is a node; much work of whole weights goes to a child process."""
        places = np.searchsorted(self.nodes, sources)
        known = [(s, int(p)) for s, p in zip(sources, places, strict=True) if p < len(self.nodes) and self.nodes[p] == s]
        walker = None
        if len(known) * len(self.to) > WALKED_ARCS and walkable(self.weight, len(self.nodes)):
            try:
                walker = Walker(self.first, self.to, self.weight)
            except OSError:
                pass
        if walker is None:
            yield from ((s, *self.shortest(s)) for s, _ in known)
            return
        try:
            for (s, _), (dist, hops) in zip(known, walker.walks(np.array([p for _, p in known])), strict=True):
                yield s, np.where(dist < 0, np.inf, dist), hops.astype(np.int64)
        finally:
            walker.close()


#: Arcs that one process looks at by itself; beyond that it starts a child.
WALKED_ARCS = 4_000_000
#: Edges of a graph that is broadcast whole; beyond that tasks get its components.
MOST_EDGES = 5_000_000
PATHS = "source long, node long, dist double, hops long"


def _paths_from(graph: Csr, sources: list[int], last_only: bool) -> Iterator[pa.RecordBatch]:
    for source, dist, hops in graph.shortest_of(sources):
        near = np.flatnonzero(np.isfinite(dist))
        if last_only:  # nodes are in order, so the first of the farthest is the smallest
            near = near[dist[near].argmax()][None]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), source), pa.int64()), pa.array(graph.nodes[near], pa.int64()), pa.array(dist[near]), pa.array(hops[near], pa.int64())], ["source", "node", "dist", "hops"])


def shortest_paths(edges: DataFrame, sources: DataFrame, last_only: bool = False) -> DataFrame:
    """(source, node, dist, hops) from each source over undirected (a, b, w); nodes in reach only, or the farthest only (smallest on ties).

    A graph of at most ``MOST_EDGES`` edges is broadcast and its sources are spread over tasks.  A larger
    one is dealt out by components: a task holds the edges of one component that has
    sources, and a component goes to several tasks with a share of its sources each.
    """
    asked = sources.select(F.col("node").cast("long")).distinct()
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        return paths_by_component(edges, asked, last_only)
    got = edges.select("a", "b", F.col("w").cast("double").alias("w")).toArrow()
    sent = edges.sparkSession.sparkContext.broadcast(Csr(*(got.column(k).to_numpy() for k in "abw")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = sent.value
        for batch in batches:
            yield from _paths_from(graph, batch.column(0).to_pylist(), last_only)

    return asked.repartition(edges.sparkSession.sparkContext.defaultParallelism, "node").mapInArrow(search, PATHS)


def paths_by_component(edges: DataFrame, asked: DataFrame, last_only: bool = False) -> DataFrame:
    """:func:`shortest_paths` of a graph of any size whose components each fit a task; the driver holds none of it."""
    parallel = edges.sparkSession.sparkContext.defaultParallelism
    of = connected_components(edges)
    wanted = materialize(asked.join(of.hint("merge"), "node"), "sources")
    sizes = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    shares = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.lit(8 * parallel) / F.count(F.lit(1)).over(Window.partitionBy())))).cast("int")
    cut = materialize(sizes.select("component", shares.alias("shares")), "shares")  # a row per component with sources
    dealt = wanted.join(cut, "component").select("component", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "node", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"))
    placed = edges.select("a", "b", F.col("w").cast("double").alias("w")).join(of.select(F.col("node").alias("a"), "component").hint("merge"), "a").join(cut, "component")
    held = placed.select("component", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("node"), "b", "w")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, arrays, own = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if last is not None and tuple(keys[low]) != last:
                    yield from _paths_from(Csr(*map(np.concatenate, zip(*arrays, strict=True))), own, last_only)
                    arrays, own = [], []
                part, last = batch.slice(low, high - low), tuple(keys[low])
                is_edge = part.column("b").is_valid()
                arrays.append([part.filter(is_edge).column(k).to_numpy() for k in ("node", "b", "w")])
                own += part.filter(part.column("b").is_null()).column("node").to_pylist()
        if last is not None:
            yield from _paths_from(Csr(*map(np.concatenate, zip(*arrays, strict=True))), own, last_only)

    rows = dealt.unionByName(held).repartition(32 * parallel, "component", "share").sortWithinPartitions("component", "share")
    return rows.mapInArrow(search, PATHS)


def farthest(paths: DataFrame) -> DataFrame:
    """Per source its farthest node (smallest on ties), distance and hops."""
    best = paths.groupBy("source").agg(F.max(F.struct("dist", (-F.col("node")).alias("k"), "hops")).alias("b"))
    return best.select("source", (-F.col("b.k")).alias("node"), F.col("b.dist").alias("dist"), F.col("b.hops").alias("hops"))


def cascade_delete(edges: DataFrame, fixed: DataFrame, start: DataFrame) -> DataFrame:
    """Edges (tail, head) left after deleting the nodes of ``start`` with all that hangs on them.

    First goes everything that ``start`` reaches along edges and that is not ``fixed`` (sites);
    then, again and again, nodes that are not fixed and have lost all their outgoing edges.
    """
    spark_edges = materialize(edges.select("tail", "head"), "edges")
    gone = materialize(start.select("node").distinct(), "gone")
    front = gone
    while front.limit(1).count():
        step = spark_edges.join(front.withColumnRenamed("node", "tail"), "tail").select(F.col("head").alias("node")).distinct()
        front = materialize(step.join(fixed.select("node"), "node", "left_anti").join(gone, "node", "left_anti"), "gone")
        gone = gone.unionByName(front)
    off = lambda e, g: e.join(g.withColumnRenamed("node", "tail"), "tail", "left_anti").join(g.withColumnRenamed("node", "head"), "head", "left_anti")
    left = materialize(off(spark_edges, gone).select("tail", "head"), "edges")
    had = spark_edges.select(F.col("tail").alias("node")).distinct()
    while True:
        dead = left.select(F.col("head").alias("node")).distinct().join(left.select(F.col("tail").alias("node")), "node", "left_anti").join(had, "node", "left_semi").join(fixed.select("node"), "node", "left_anti")
        dead = materialize(dead, "gone")
        if not dead.limit(1).count():
            return left
        left = materialize(off(left, dead).select("tail", "head"), "edges")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    n_out = edges.groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    n_in = edges.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return nodes.select("node").distinct().join(n_in, "node", "left").join(n_out, "node", "left").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, fixed) less the intermediate ones (not fixed) that no edge touches."""
    touched = edges.select(F.explode(F.array("tail", "head")).alias("node")).distinct().withColumn("touched", F.lit(True))
    return nodes.join(touched, "node", "left").filter("fixed OR touched").drop("touched")


def leaf_edges(edges: DataFrame) -> DataFrame:
    """Edges whose head is never a tail."""
    return edges.join(edges.select(F.col("tail").alias("head")).distinct(), "head", "left_anti").select(edges.columns)


def density_clusters(points: DataFrame, radius_m: float = 50.0, key: str = "site_id") -> DataFrame:
    """(key, cluster): points chained by steps of at most ``radius_m``; cluster: its smallest key.

    Pairs are sought in bins of the radius: an equi-join with the 3 by 3 bins around.  Bins
    of longitude are as wide as the radius is at the far edge of the next band of latitude, so
    each band has its own; near the poles a band is one bin.  Points without a place stand alone.
    """
    lat_bin = radius_m / 111_000.0
    width = lambda i: lat_bin / F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(i * lat_bin), F.abs((i + 1) * lat_bin)) + lat_bin)))
    bin_of = lambda lng, i: F.floor(F.pmod(lng + 180, F.lit(360.0)) / width(i))
    count = lambda i: F.floor(F.lit(360.0) / width(i))  # noqa: E731  the last, narrower bin joins the one before
    placed = points.select(F.col(key).alias("node"), "lat", "lng", F.floor(F.col("lat") / lat_bin).alias("i"))
    bins = placed.withColumn("j", F.least(bin_of(F.col("lng"), F.col("i")), F.greatest(count(F.col("i")) - 1, F.lit(0))))
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asked = placed.withColumn("d", shift).withColumn("i", F.col("i") + F.col("d.di"))
    base = F.least(bin_of(F.col("lng"), F.col("i")), F.greatest(count(F.col("i")) - 1, F.lit(0)))
    asked = asked.withColumn("j", F.pmod(base + F.col("d.dj"), F.greatest(count(F.col("i")), F.lit(1))))
    asked = asked.select(F.col("node").alias("a"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "i", "j")
    met = asked.join(bins, ["i", "j"]).filter((F.col("a") < F.col("node")) & (geo.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat"), F.col("lng")) * 1000 <= radius_m))
    comps = connected_components(met.select("a", F.col("node").alias("b")))
    return points.join(comps, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("cluster"))


def spectral_clusters(dist: np.ndarray, k: int, seed: int = 7, rounds: int = 50) -> np.ndarray:
    """Labels 0..k-1 of a distance matrix: Gaussian affinity, normalised Laplacian, seeded k-means."""
    n = len(dist)
    if n == 0 or k <= 1:
        return np.zeros(n, np.int64)
    k = min(k, n)
    finite = dist[np.isfinite(dist) & (dist > 0)]
    scale = float(np.median(finite)) if len(finite) else 1.0
    affinity = np.where(np.isfinite(dist), np.exp(-np.square(np.where(np.isfinite(dist), dist, 0) / scale)), 0.0)
    half = 1 / np.sqrt(np.maximum(affinity.sum(axis=1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(n) - half[:, None] * affinity * half[None, :])
    x = vectors[:, :k]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = [int(rng.integers(n))]
    while len(centres) < k:  # farthest point next
        centres.append(int(((x[:, None, :] - x[centres][None, :, :]) ** 2).sum(axis=2).min(axis=1).argmax()))
    centre, labels = x[centres], np.zeros(n, np.int64)
    for _ in range(rounds):
        fresh = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        if (fresh == labels).all():
            break
        labels = fresh
        centre = np.stack([x[labels == c].mean(axis=0) if (labels == c).any() else centre[c] for c in range(k)])
    return np.unique(labels, return_inverse=True)[1]
