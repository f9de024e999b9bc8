"""Best-fit packing of documents into fixed-length sequences by large-item matching.

Only the histogram of piece lengths decides a packing, and it has at most ``capacity``
entries however large the corpus is.  So the plan is made on counts (one *bin type* stands
for any number of equal bins) and every piece then finds its place from its rank among
the pieces of its length:

1. pieces above a third of the capacity: at most two share a bin.  From the longest
   down, each is matched with the longest such partner that still fits;
2. the others, from the longest down, go to the bin whose gap they fill best; a new bin is
   opened only when no gap is large enough.

Ranks are two-level (place among equals within an input partition, plus the number of
equals in the partitions before), so that no group of equal lengths meets in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeplan.llm.common import id_and_text
from ridgeplan.llm.tokens import encoder
from ridgeplan.runtime import materialize

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin types as (number of bins, [(piece length, copies in each bin), ...])."""
    left = {z: c for z, c in counts.items() if c > 0}
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    gaps: dict[int, list[int]] = {}  # gap -> types that have it
    open_gaps: list[int] = []  # the gaps in use, ascending

    def add(n: int, content: list[tuple[int, int]]) -> None:
        gap = capacity - sum(z * k for z, k in content)
        bins.append((n, content))
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append(len(bins) - 1)

    large = sorted(z for z in left if 3 * z > capacity)
    while large:
        z = large[-1]
        k = bisect.bisect_right(large, capacity - z)
        if k == 0:
            add(left.pop(large.pop()), [(z, 1)])
            continue
        y = large[k - 1]
        if y == z:
            pairs, odd = divmod(left.pop(large.pop()), 2)
            if pairs:
                add(pairs, [(z, 2)])
            if odd:  # the last of its kind takes the next longest partner
                smaller = large[-1] if large else None
                if smaller is None:
                    add(1, [(z, 1)])
                else:
                    add(1, [(z, 1), (smaller, 1)])
                    left[smaller] -= 1
                    if not left[smaller]:
                        large.pop()
            continue
        n = min(left[z], left[y])
        add(n, [(z, 1), (y, 1)])
        for x in (z, y):
            left[x] -= n
            if not left[x]:
                large.remove(x)
                del left[x]
    for z in sorted((z for z in left if 3 * z <= capacity), reverse=True):
        c = left[z]
        while c:
            at = bisect.bisect_left(open_gaps, z)
            if at == len(open_gaps):  # no gap: open bins full of this length
                each = capacity // z
                n, rest = divmod(c, each)
                if n:
                    add(n, [(z, each)])
                if rest:
                    add(1, [(z, rest)])
                break
            gap = open_gaps[at]
            kind = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            n, content = bins[kind]
            each = gap // z  # best fit stays with a bin until its gap is too small
            used, rest = divmod(c, each)
            bins[kind] = (0, content)
            if used >= n:
                add(n, [*content, (z, each)])
                c -= n * each
                continue
            if used:
                add(used, [*content, (z, each)])
            if rest:
                add(1, [*content, (z, rest)])
            if n - used - (rest > 0):
                add(n - used - (rest > 0), content)
            c = 0
    return [(n, content) for n, content in bins if n]


class Slots:
    """Where the r-th piece of each length goes: arrays sorted by (length, first rank)."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]], order: int = 1 << 44) -> None:
        rows, sequence, ranks = [], 0, Counter()
        for n, content in bins:
            offset = 0
            for z, copies in content:
                rows.append((z, ranks[z], sequence, offset, copies))
                ranks[z] += n * copies
                offset += z * copies
            sequence += n
        self.order = order
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = table[:, 0] * order + table[:, 1]
        self.rank, self.sequence, self.offset, self.copies = table[:, 1], table[:, 2], table[:, 3], table[:, 4]
        self.n_bins = sequence

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length * self.order + rank, side="right") - 1
        bin_no, copy = np.divmod(rank - self.rank[k], self.copies[k])
        return self.sequence[k] + bin_no, self.offset[k] + copy * length


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; a remainder comes first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """All pieces of all documents, with their place among equal lengths of the input partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, seen, part = encoder(tokenizer).ids, np.array([end_id], "<u4"), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([ids_of(text or ""), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id`` (null or empty text: the end id alone).
    Only documents longer than ``capacity`` are cut.  Repeated rows are packed as often as
    they occur.  Empty input: no rows.  Sequences are gapless from offset 0.
    """
    found = materialize(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    # one row per length and input partition
    counts = materialize(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = Slots(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = found.join(offsets, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("local_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = slots.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
