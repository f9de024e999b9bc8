"""Exact top-k search by inner product with multi-resolution segment statistics.

Each vector is cut into equal segments, at a coarse and at a finer resolution, and each
segment is summed up by its mean and its standard deviation.  For two vectors

    |q - x|^2  >=  sum over segments of  n * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

a lower bound of their distance that rises with the resolution.  As
``q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2``, it is an upper bound of the inner product too.
Candidates whose bound stays below the k-th best score so far are dropped at the coarse
level, then at the finer one; the rest get exact integer scores.

Queries are a stated subset of the rows.  They are written once to the shared folder in
blocks; each task holds some tens of MB of its vectors at a time and streams the blocks past
them, so vectors are never exchanged and no query passes through the driver.  A task
gives k rows per query and group of vectors, and a last step merges those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeplan.llm.binary_output import file_system
from ridgeplan.runtime import new_path

SCALE, BLOCK, CHUNK = 256, 4096, 1024
#: Components of vectors that a task holds at a time (eight bytes each).
HELD = 8_000_000
#: Share of a block that survives from which the next level is computed for the whole block.
DENSE = 0.02
BEST = "query_id long, vec_id long, score long"


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column, and their components floor(256 * x) as float64.

    A row is not usable if it is null, or has a null or non-finite component.  Shorter
    vectors are filled with zeros, which changes no inner product.
    """
    if len(vectors) and not vectors.null_count:
        flat, sizes = vectors.flatten(), vectors.value_lengths().to_numpy()
        if not flat.null_count and sizes.min() == sizes.max() > 0:
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            return good, np.floor(x[good] * SCALE)
    rows, good = [], []
    for k, v in enumerate(vectors.to_pylist()):
        if v is not None and None not in v:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                rows.append(np.floor(x * SCALE))
                good.append(k)
    return np.array(good, np.int64), filled(rows)


def filled(rows: list[np.ndarray]) -> np.ndarray:
    lengths = {len(r) for r in rows}
    if len(lengths) == 1:
        return np.stack(rows)
    out = np.zeros((len(rows), max(lengths, default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * (means, deviations) per segment: the dot product of two is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    means = np.stack([math.sqrt(len(p)) * x[:, p].mean(axis=1) if len(p) else np.zeros(len(x)) for p in parts], axis=1)
    devs = np.stack([math.sqrt(len(p)) * x[:, p].std(axis=1) if len(p) else np.zeros(len(x)) for p in parts], axis=1)
    return np.concatenate([means, devs], axis=1)


def largest_sum(q: np.ndarray, x: np.ndarray) -> float:
    """Above every absolute inner product and partial sum of two blocks."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products; beyond the range of a long they stay at its ends."""
    if largest_sum(q, x) < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in sums], np.int64)


class TopK:
    """The best k (score, vec_id) of each query of a block, as two sorted matrices."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, levels: tuple[int, ...]) -> None:
        self.ids, self.q, self.k, self.levels = ids, q, k, levels
        self.heads = [np.empty((len(ids), 0))] * len(levels)
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found = np.zeros(len(ids), np.int64)
        self.tested = 0

    def add(self, vec_ids: np.ndarray, x: np.ndarray) -> None:
        if not len(vec_ids) or not len(self.ids):
            return
        q, x = widened(self.q, x)
        if q.shape[1] != self.q.shape[1] or not self.heads[0].shape[1]:
            self.q, self.heads = q, [statistics(q, s) for s in self.levels]
        floor = np.where(self.found >= self.k, self.score[:, -1], -np.inf).astype(np.float64)
        slack = 1e-6 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1)
        alive = self.ids[:, None] != vec_ids[None, :]
        for head, segments in zip(self.heads, self.levels, strict=True):
            tail = statistics(x, segments)
            if alive.mean() > DENSE:
                alive &= head @ tail.T + slack >= floor[:, None]
            else:
                i, j = np.nonzero(alive)
                drop = np.einsum("ij,ij->i", head[i], tail[j]) + slack[i, j] < floor[i]
                alive[i[drop], j[drop]] = False
        self.tested += int(alive.sum())
        if alive.mean() > DENSE and largest_sum(q, x) < 2**53:  # whole block: the products are exact in float64
            scores = np.where(alive, q @ x.T, -np.inf)
            if scores.shape[1] > self.k:
                floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(alive & (scores >= floor[:, None]))
            scores = scores[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(alive)
            if not len(i):
                return
            scores = np.concatenate([exact(q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)])
            keep = scores >= floor[i]
            i, j, scores = i[keep], j[keep], scores[keep]
        if not len(i):
            return
        vecs = vec_ids[j]
        rows = np.unique(i)
        held = np.arange(self.k)[None, :] < self.found[rows, None]
        at = np.concatenate([np.broadcast_to(rows[:, None], held.shape)[held], i])
        score = np.concatenate([self.score[rows][held], scores])
        vec = np.concatenate([self.vec[rows][held], vecs])
        order = np.lexsort((vec, ~score, at))  # ~score falls as the score rises, without overflow
        at, score, vec = at[order], score[order], vec[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < self.k
        self.score[at[top], place[top]], self.vec[at[top], place[top]] = score[top], vec[top]
        self.found[rows] = np.minimum(self.k, np.bincount(np.searchsorted(rows, at), minlength=len(rows)))

    def rows(self) -> pa.RecordBatch:
        held = np.arange(self.k)[None, :] < self.found[:, None]
        ids = np.broadcast_to(self.ids[:, None], held.shape)
        return pa.RecordBatch.from_arrays([pa.array(x[held], pa.int64()) for x in (ids, self.vec, self.score)], ["query_id", "vec_id", "score"])


def held_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable vectors (ids, components) in groups of about ``most`` components."""
    ids, parts, size = [], [], 0
    for batch in batches:
        good, x = quantised(batch.column(1))
        if len(good):
            ids.append(batch.column(0).to_numpy(zero_copy_only=False)[good])
            parts.append(x)
            size += x.size
        if size >= most:
            yield np.concatenate(ids), stacked(parts)
            ids, parts, size = [], [], 0
    if ids:
        yield np.concatenate(ids), stacked(parts)


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    d = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in parts])


def query_blocks(folder: str, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable queries (ids, components) from the shared folder, a block at a time."""
    fs, path = file_system(folder)
    for batch in pads.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["vec_id", "embedding"], batch_size=block, batch_readahead=1, fragment_readahead=1):
        good, q = quantised(batch.column(1))
        if len(good):
            yield batch.column(0).to_numpy()[good], q


def top_k(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", levels: tuple[int, ...] = (8, 32), block: int = BLOCK) -> DataFrame:
    """The k best rows by inner product for every row where ``queries`` (on ``id_col``) holds.

    query_id, rank (from 1), vec_id, score; ties to the smaller id; a row is never its own
    result.  Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part.  Fewer candidates than k: all of them.  Each row of a repeated
    id is a candidate of other ids; queries that share an id share one list of k rows.
    The folder of ``spark.checkpoint.dir`` must be open to pyarrow on the executors.
    """
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), queries.alias("is_query"))
    asked = rows.filter("is_query").select("vec_id", "embedding")
    blocks = max(1, math.ceil(asked.count() / block))
    folder = new_path(vectors.sparkSession, "queries")
    asked.repartition(blocks, F.xxhash64("vec_id")).write.option("compression", "zstd").parquet(folder)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vec_ids, x in held_groups(batches, HELD):
            for ids, q in query_blocks(folder, block):
                best = TopK(ids, q, k, levels)
                for low in range(0, len(vec_ids), CHUNK):
                    best.add(vec_ids[low : low + CHUNK], x[low : low + CHUNK])
                yield best.rows()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = rows.select("vec_id", "embedding").mapInArrow(search, BEST).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every row whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {
    "op4_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
