"""Token counts by a two-tier look-up of pre-token lengths.

A word-level BPE encodes each pre-token by itself, so a text has as many tokens as its
pre-tokens have together.  Tier one is a compact table of the corpus's frequent
pre-tokens and their lengths, broadcast to all tasks; tier two is a cache in each Python
worker, filled by the library for what the table misses.  No pre-token is shuffled: the
frequent ones are found by a mergeable heavy-hitter summary (one bounded summary per
task, merged in a tree), over every whole text.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeplan.llm.common import id_and_text
from ridgeplan.runtime import materialize

#: Fixed value: the pre-token pattern of the word-level vocabulary (on lower-cased text).
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters for which normalisation is more than lower-casing, or Unicode versions may differ.
_UNUSUAL = regex.compile(r"[^\x09\x0A\x0D\x20-\x7E\xA0-ɏ‐-‧€]")
#: Pre-tokens in the broadcast table, at most (about 12 bytes each).
TABLE_SIZE = 1 << 16
#: Longest pre-token that is remembered.
LONGEST = 64
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def merged(counts: Counter, table_size: int) -> Counter:
    """The summary's heaviest entries; ties by text, so that the result is the same each time."""
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:table_size]))


def packed(counts: Counter) -> bytes:
    return zlib.compress(json.dumps([list(counts), list(counts.values())], ensure_ascii=False).encode(), 1)


def unpacked(blob: bytes) -> Counter:
    return Counter(dict(zip(*json.loads(zlib.decompress(blob)), strict=True)))


class TwoTier:
    """Counts tokens of texts; ``frequent`` is tier one."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_size: int = 500_000) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"] for x in json.load(file)["added_tokens"]]
        self.lengths = _Lengths(self.library, frequent or {}, cache_size)

    def plain(self, text: str) -> bool:
        return not (_UNUSUAL.search(text) or any(x in text for x in self.special))

    def count(self, text: str) -> int:
        if not self.plain(text):
            return len(self.library.encode(text, add_special_tokens=False))
        return sum(map(self.lengths.__getitem__, WORD_PATTERN.findall(text.lower())))


class _Lengths(dict):
    """pre-token -> number of tokens: the frequent ones for good, others up to ``room`` more."""

    def __init__(self, library: Tokenizer, frequent: dict[str, int], room: int) -> None:
        super().__init__(frequent)
        self.library, self.frequent, self.room = library, frequent, room

    def __missing__(self, pretoken: str) -> int:
        n = len(self.library.encode(pretoken, add_special_tokens=False))
        if len(pretoken) <= LONGEST:
            if len(self) >= len(self.frequent) + self.room:
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n


_COUNTERS: dict[tuple[str, int], TwoTier] = {}


def frequent_lengths(docs: DataFrame, path: str, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of about the ``table_size`` most frequent pre-tokens of all texts.

    Each task keeps a counter of at most eight times that many entries (then it drops the
    rarer part); summaries meet in groups, then in one last merge of a bounded number of
    rows.  What is left out costs time only, never a wrong count.
    """
    spark = docs.sparkSession

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(WORD_PATTERN.findall(text.lower()))
                    if len(counts) > 8 * table_size:
                        counts = merged(counts, 4 * table_size)
        if counts:
            short = Counter({w: n for w, n in counts.items() if len(w) <= LONGEST})
            yield pa.RecordBatch.from_arrays([pa.array([packed(merged(short, table_size))], pa.binary())], ["summary"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for blob in frame["summary"]:
            counts.update(unpacked(blob))
            if len(counts) > 8 * table_size:
                counts = merged(counts, 4 * table_size)
        return pd.DataFrame({"summary": [packed(merged(counts, table_size))]})

    level = materialize(docs.select("text").mapInArrow(summarise, "summary binary"), "pretoken-summaries")
    n = level.count()
    while n > 1:  # each round merges about sixteen summaries into one
        groups = max(1, math.ceil(n / 16))
        # the ids count up from a power of two in each partition, so their hash is dealt out
        salted = level.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        level = materialize(salted.groupBy("g").applyInPandas(merge, "summary binary"), "pretoken-summaries")
        n = min(groups, n - 1)
    rows = level.collect()
    library = Tokenizer.from_file(path)
    return {w: len(library.encode(w, add_special_tokens=False)) for row in rows for w in unpacked(row.summary)}


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every whole text; null: empty, 0 and 0.

    ``path`` is the vocabulary's file, readable on every executor.  Repeated rows give
    repeated results.  Texts with special strings or unusual characters are encoded
    whole by the library.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = rows.sparkSession.sparkContext.broadcast(packed(Counter(frequent_lengths(rows, path, table_size))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, zlib.crc32(table.value))
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = TwoTier(path, dict(unpacked(table.value)))
        two_tier = _COUNTERS[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([two_tier.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, COUNTS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit over all documents."""
    import public_tokenizers

    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
