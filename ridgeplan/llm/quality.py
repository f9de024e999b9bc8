"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text becomes a vector of statistics (sizes, shares of character kinds, repetition of
words and lines, compressibility).  Values are binned by quantiles of a bounded labelled
sample, trees are grown on histograms of the gradients of the logistic loss, and all trees
are flattened into arrays (feature, bin, children, value), so that a batch of documents
walks down every tree at once with numpy.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.llm.common import id_and_text, is_held_out, utf8
from ridgeplan.llm.toxicity import labelled

FEATURES = (
    "chars", "words", "lines", "mean_word", "long_word", "short_words", "distinct_words", "top_word", "same_neighbour", "distinct_pairs", "letters", "digits", "spaces",
    "upper", "punctuation", "pipes", "symbols", "other", "symbol_words", "ended_lines", "distinct_lines", "mean_line", "capital_lines", "compressed", "byte_entropy", "sentence_words", "max_run", "numbers",
)
MAX_ROWS, N_BINS = 40_000, 64


def _kinds() -> np.ndarray:
    kind = np.full(256, 7)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?'\"()-", "|", "#$%&*@^~_=+<>[]{}\\/`")):
        kind[[ord(c) for c in chars]] = k
    kind[128:] = 0  # bytes of letters of other scripts
    return kind


_KIND = _kinds()


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; an empty one gives zeros."""
    data = utf8(text or "")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(data), len(words)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, histogram, 8) / n
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = histogram[histogram > 0] / n
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    sentence = sum(w[-1:] in b".!?" for w in words)
    symbol_words = sum(1 for w, c in counts.items() for _ in range(c) if _KIND[w[-1]] in (5, 6))
    numbers = sum(c for w, c in counts.items() if w.isdigit())
    edges = np.flatnonzero(np.diff(np.frombuffer(data, np.uint8)))
    run = int(np.diff(np.concatenate([[-1], edges, [n - 1]])).max())
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), lengths.mean(), float(np.log1p(lengths.max())), (lengths <= 3).mean(), len(counts) / m, max(counts.values()) / m, same / m, pairs / m,
        *kinds[[0, 1, 2, 3, 4, 5, 6, 7]], symbol_words / m, ends / len(lines), len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x[:1].isupper() for x in lines) / len(lines),
        len(zlib.compress(data, 1)) / n, float(-(share * np.log2(share)).sum()), m / (sentence + 1), float(np.log1p(run)), numbers / m,
    ]


@dataclass
class Trees:
    """Flattened boosted trees; a leaf points to itself."""

    edges: list[np.ndarray]  # per feature: upper edges of its bins
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray  # bins up to this one go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if len(self.roots) and len(x):
            b, rows = self.binned(x), np.arange(len(x))
            for root in self.roots:
                node = np.full(len(x), root)
                for _ in range(self.depth):
                    node = np.where(b[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
                z += self.value[node]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, depth: int = 4, rate: float = 0.1, penalty: float = 5.0, least: int = 20, n_bins: int = N_BINS) -> Trees:
    """Boosted trees for y in {0, 1}; level by level, best split by histogram gain."""
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins)[1:-1])) if len(y) else np.empty(0) for k in range(x.shape[1])]
    trees = Trees(edges, np.empty(0, np.int64), *(np.empty(0, np.int64) for _ in range(4)), np.empty(0), bias, depth)
    if len(y) < 2 * least or y.min() == y.max():
        return trees
    b = trees.binned(x)
    n, m = b.shape
    flat = b + np.arange(m) * n_bins  # place of each value in a row of histograms
    z, nodes, roots = np.full(n, bias), [], []

    def node(value: float) -> int:
        nodes.append([0, n_bins, len(nodes), len(nodes), value])
        return len(nodes) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        root = node(0.0)
        roots.append(root)
        level = [(root, np.arange(n))]
        for _ in range(depth):
            below = []
            for at, rows in level:
                where = flat[rows].ravel()
                g, h, c = (np.bincount(where, np.repeat(v, m) if v is not None else None, m * n_bins).reshape(m, n_bins).cumsum(axis=1) for v in (grad[rows], hess[rows], None))
                gt, ht = g[0, -1], h[0, -1]
                gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
                gain[(c < least) | (len(rows) - c < least)] = -np.inf
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                k, cut = divmod(best, n_bins)
                to_left = b[rows, k] <= cut
                sides = (rows[to_left], rows[~to_left])
                kids = [node(-rate * grad[s].sum() / (hess[s].sum() + penalty)) for s in sides]
                nodes[at][:4] = [k, cut, *kids]
                below += zip(kids, sides, strict=True)
            level = below
        part = Trees(edges, np.array([root]), *_flat(nodes), 0.0, depth)
        walk = np.full(n, root)
        for _ in range(depth):
            walk = np.where(b[np.arange(n), part.feature[walk]] <= part.limit[walk], part.left[walk], part.right[walk])
        z += part.value[walk]
    return Trees(edges, np.array(roots), *_flat(nodes), bias, depth)


def _flat(nodes: list[list]) -> tuple[np.ndarray, ...]:
    columns = list(zip(*nodes, strict=True))
    return (*(np.array(c, np.int64) for c in columns[:4]), np.array(columns[4], float))


def feature_table(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = MAX_ROWS, **growing) -> Trees:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    Their statistics are made on the executors; only those numbers come to the driver.
    Without labels, or with one class only: the smoothed share of the class.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(feature_table(batch.column(0).to_pylist())), pa.list_(pa.float64()))], ["y", "x"])

    table = labelled(docs, labels, target, max_rows).mapInArrow(look, "y int, x array<double>").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if table.num_rows else np.empty((0, len(FEATURES)))
    return grow(x, table.column("y").to_numpy().astype(float), **growing)


def score_documents(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts have zero statistics."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(feature_table(batch.column(1).to_pylist())), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(score, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) over all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = score_documents(docs, train(docs, labels))
    return scores.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
