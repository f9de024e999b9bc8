"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios.

Texts are lower-cased; n-grams of 3 to 6 characters (code points) are hashed to 2^20
features, of which a document has or has not each one.  On a bounded sample of labelled rows,

* naive Bayes counts in how many documents of either class a feature is, which gives its
  log-count ratio ``r`` (features are counted on the executors, and the ``n_features``
  whose ratio is largest against its own error are kept);
* logistic regression with an L2 penalty is fitted on the features scaled by ``r``.

Scoring looks at whole texts, one pass without an exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.llm.common import MIX_A, MIX_B, U64, id_and_text, is_held_out
from ridgeplan.runtime import materialize

SIZES, BITS, PAD = (3, 4, 5, 6), 20, "\0" * 6
#: Labelled rows that are used at most (those with the smallest hash of their id), and features kept.
MAX_ROWS, N_FEATURES = 20_000, 4096
SCORES = "doc_id long, score double"


#: Characters that are hashed at a time; longer texts are cut into overlapping pieces of that size.
PIECE = 1 << 20


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The lower-cased texts with the place of their text, about ``PIECE`` characters at a time."""
    owners, parts, size, overlap = [], [], 0, max(SIZES) - 1
    for k, text in enumerate(texts):
        data = (text or "").lower()
        for low in range(0, max(1, len(data)), PIECE):
            part = data[low : low + PIECE + overlap]
            if parts and size + len(part) > PIECE:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def hashed(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the feature of the n-gram at each place: a polynomial of its code points, scrambled."""
    wide, gram = points.astype(np.uint64), None
    for n in range(1, max(SIZES) + 1):
        m = len(wide) - n + 1
        if m <= 0:
            return
        gram = wide + U64(1) if gram is None else gram[:m] * MIX_B + wide[n - 1 :] + U64(1)
        if n in SIZES:
            yield n, (((gram ^ (gram >> U64(32))) * MIX_A) >> U64(64 - BITS)).astype(np.int64)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort is several times faster here than np.unique)."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def present(texts: list[str | None], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs without repeats; ``chosen`` maps features to columns (-1: none)."""
    found = [np.empty(0, np.int64)]
    for owners, parts in pieces(texts):
        ends = np.cumsum(np.fromiter((len(p) + len(PAD) for p in parts), np.int64, len(parts)))
        owner, pairs = np.array(owners), []
        for n, feature in hashed(np.frombuffer(PAD.join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")):
            place = np.arange(len(feature))
            if chosen is not None:
                feature = chosen[feature]
                place = np.flatnonzero(feature >= 0)
                feature = feature[place]
            at = np.searchsorted(ends, place, side="right")
            inside = place + n <= ends[at] - len(PAD)  # n-grams of one text only
            pairs.append((owner[at[inside]] << BITS) | feature[inside])
        found.append(distinct(np.concatenate(pairs)) if pairs else found[0])
    got = distinct(np.concatenate(found)) if len(found) > 2 else found[-1]
    return got >> BITS, got & ((1 << BITS) - 1)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    f, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, stack = g.copy(), []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            d -= a * y
            stack.append(a)
        if steps:
            s, y = steps[-1]
            d *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(stack), strict=True):
            d += s * (a - y @ d / (s @ y))
        t, slope = 1.0 if steps else 1.0 / max(1.0, float(np.abs(g).sum())), float(d @ g)
        while True:
            new = x - t * d
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - x, g_new - g
        done = f - f_new < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        if done:
            break
    return x


@dataclass
class ToxicityModel:
    """``weight[feature]`` is already scaled by the feature's ratio; sparse: most are zero."""

    chosen: np.ndarray  # features kept, ascending
    weight: np.ndarray
    bias: float

    def columns(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int64)
        out[self.chosen] = np.arange(len(self.chosen))
        return out

    def score(self, texts: list[str | None], columns: np.ndarray | None = None) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.chosen):
            doc, column = present(texts, self.columns() if columns is None else columns)
            z += np.bincount(doc, self.weight[column], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(doc: np.ndarray, column: np.ndarray, y: np.ndarray, ratio: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (scaled by ratio) and bias of the penalised logistic regression."""
    x = ratio[column]
    n, k = len(y), len(ratio)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(doc, w[:k][column] * x, n) + w[k]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        value = np.logaddexp(0, np.where(y == 1, -z, z)).sum() + penalty / 2 * (w[:k] @ w[:k])
        e = p - y
        return float(value), np.append(np.bincount(column, e[doc] * x, k) + penalty * w[:k], e.sum())

    start = np.zeros(k + 1)
    start[k] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    w = minimise(loss, start)
    return w[:k] * ratio, float(w[k])


def labelled(docs: DataFrame, labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """text and y of at most ``max_rows`` labelled rows that are not held out (a table of its own).

    An id with several labels has the smallest one; of several rows under one id that with
    the smallest hash of its text is used, so that the bound holds for any table.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(target).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    picked = known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the picked rows are bounded by max_rows, so this side can be broadcast
    found = id_and_text(docs).join(F.broadcast(picked), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(one.select("text", "y"), "labelled")


def train(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", max_rows: int = MAX_ROWS, n_features: int = N_FEATURES, penalty: float = 1.0) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows.  Without any: score 0.5; with one class only: its smoothed share."""
    sample = labelled(docs, labels, target, max_rows)
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log((pos + 1) / (neg + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y, texts = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            for low in range(0, len(texts), 64):  # all features of a few texts at a time
                doc, feature = present(texts[low : low + 64])
                for c in (0, 1):
                    totals[c] += np.bincount(feature[y[low + doc] == c], minlength=1 << BITS)
        seen = np.nonzero(totals.sum(axis=0))[0]  # the least count holds for the sum over tasks only
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, totals[1][part], totals[0][part])], ["feature", "p", "q"])

    counts = sample.mapInArrow(count, "feature long, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = (F.col("p") + 1) / (pos + 2), (F.col("q") + 1) / (neg + 2)
    ratio = F.log(p / q)
    error = F.sqrt((1 - p) / (F.col("p") + 1) + (1 - q) / (F.col("q") + 1))
    kept = counts.filter("p + q >= 8").select("feature", ratio.alias("r"), (F.abs(ratio) / error).alias("z")).orderBy(F.desc("z"), "feature").limit(n_features).toPandas()
    kept = kept.sort_values("feature")
    model = ToxicityModel(kept["feature"].to_numpy(np.int64), kept["r"].to_numpy(float), 0.0)
    columns = model.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = columns()
        for batch in batches:
            doc, column = present(batch.column(0).to_pylist(), lookup)
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            has = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(column, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), has], ["y", "has"])

    table = sample.mapInArrow(look, "y int, has array<int>").toArrow()  # at most max_rows rows
    has = table.column("has").combine_chunks()
    doc = np.repeat(np.arange(len(has)), has.value_lengths().to_numpy(zero_copy_only=False))
    weight, bias = fit_linear(doc, has.flatten().to_numpy(), table.column("y").to_numpy().astype(float), model.weight, penalty)
    return ToxicityModel(model.chosen, weight, bias)


_LOOKUP: dict[int, np.ndarray] = {}


def _lookup(model: ToxicityModel) -> np.ndarray:
    key = zlib.crc32(model.chosen.tobytes())
    if key not in _LOOKUP:
        _LOOKUP.clear()
        _LOOKUP[key] = model.columns()
    return _LOOKUP[key]


def score_documents(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts get the bias alone."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist(), _lookup(model)), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(score, SCORES)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``.

    Null and empty texts have the model's bias as their score, like any text without a
    known n-gram; repeated rows stay or go together.
    """
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(place).to_pylist(), _lookup(model)) < threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) over all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = score_documents(docs, train(docs, labels))
    return scores.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
