"""Benchmark decontamination with one Aho-Corasick automaton.

All windows of ten consecutive words of the benchmark items (lower-cased, words only)
become patterns of a single automaton over word numbers: each word of the benchmark is
written as a fixed number of symbols, every other word as as many blanks.  Each document is
normalised once into its words, written likewise, scanned once, and each match is mapped back through
the place of its words to the original text.

The automaton is made once per worker from the broadcast items and takes about 150 times
their bytes.  The benchmark is a fixed test set whose size is checked
(``max_benchmark_bytes``).  One of more than ``part_bytes`` is cut into parts; then a task
holds ``CHUNK_BYTES`` of documents and scans them with one part's automaton after another,
so that a worker never holds more than one automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.llm.common import id_and_text, utf8

#: What is a word, and what is lower-cased (A-Z only).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same on UTF-8 bytes: other characters than words become spaces, A-Z become lower case.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 10
#: Benchmark text of one automaton.
PART_BYTES = 768 << 10
#: Text that a task holds while the parts of a large benchmark pass over it.
CHUNK_BYTES = 32 << 20

HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def lower_ascii(text: str) -> str:
    return utf8(text).lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, as UTF-8."""
    return utf8(text or "").translate(AS_WORDS).split()


#: Each digit of a word's number has its own 256 symbols, from here on.
SYMBOLS, BASE = 0x4E00, 256


class Windows:
    """The automaton of a set of items; ``scan`` gives the hit words of a text."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        vocabulary = sorted({word for _, words in items for word in words})
        self.digits = 1
        while BASE**self.digits < len(vocabulary):
            self.digits += 1
        digit = lambda k, d: chr(SYMBOLS + d * BASE + k // BASE**d % BASE)
        self.code = {word: "".join(digit(k, d) for d in range(self.digits)) for k, word in enumerate(vocabulary)}
        patterns: dict[str, tuple[int, set]] = {}
        for item_id, words in items:
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                patterns.setdefault("".join(map(self.code.__getitem__, part)), (len(part), set()))[1].add(None if item_id is None else str(item_id))
        self.automaton = ahocorasick.Automaton()
        for pattern, (n, ids) in patterns.items():
            self.automaton.add_word(pattern, (n, tuple(ids)))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, np.ndarray, set]:
        """Number of words, flags of hit words, items with occurring windows."""
        words = words_of(text)
        if not words or self.empty:
            return len(words), np.zeros(0, bool), set()
        items: set = set()
        marks = None
        for last, (n, ids) in self.automaton.iter("".join(map(self.code.get, words, repeat(" " * self.digits)))):
            if marks is None:
                marks = np.zeros(len(words) + 1, np.int64)
            stop = last // self.digits + 1
            marks[stop - n] += 1
            marks[stop] -= 1
            items.update(ids)
        return len(words), np.zeros(0, bool) if marks is None else np.cumsum(marks[:-1]) > 0, items


def char_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Character ranges of the runs of hit words in the original text."""
    spans, open_at, last = [], -1, 0
    for k, match in enumerate(WORD.finditer(lower_ascii(text))):
        if hit[k]:
            if open_at < 0:
                open_at = match.start()
            last = match.end()
        elif open_at >= 0:
            spans.append({"start": open_at, "end": last})
            open_at = -1
    if open_at >= 0:
        spans.append({"start": open_at, "end": last})
    return spans


def benchmark_parts(items: list[tuple[object, str | None]], window: int, most: int) -> list[list[tuple[object, list[bytes]]]]:
    """The items' words in parts of about ``most`` bytes; a longer item is cut so that each of its windows is in a part."""
    parts, size = [[]], 0
    for item_id, text in items:
        words = words_of(text)
        total = sum(len(word) + 1 for word in words)
        n = len(words) if total <= most else max(window, len(words) * most // total)
        step = max(1, n - window + 1)
        for k in range(0, max(1, len(words) - window + 1), step):
            piece = words[k : k + n]
            weight = total * len(piece) // max(1, len(words))
            if parts[-1] and size + weight > most:
                parts.append([])
                size = 0
            parts[-1].append((item_id, piece))
            size += weight
    return parts


_AUTOMATON: dict[str, Windows] = {}


def worker_automaton(part: list[tuple[object, list[bytes]]], window: int) -> Windows:
    """The worker's automaton of a benchmark of one part."""
    key = hashlib.sha256(repr((part, window)).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _AUTOMATON:
        _AUTOMATON.clear()
        _AUTOMATON[key] = Windows(part, window)
    return _AUTOMATON[key]


def chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan_batches(batches: Iterable[pa.RecordBatch], place: int, items: list[tuple[object, str | None]], window: int, part_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, set[str]]]]]:
    """Each batch with the scans of its texts (column ``place``)."""
    parts = benchmark_parts(items, window, part_bytes)
    if len(parts) == 1:
        found = worker_automaton(parts[0], window)
        for batch in batches:
            yield batch, [found.scan(text or "") for text in batch.column(place).to_pylist()]
        return
    for held in chunks(batches, CHUNK_BYTES):
        scans: list[list[tuple[int, np.ndarray, set[str]]]] = [[] for _ in held]
        for part in parts:
            found = Windows(part, window)
            for batch, scanned in zip(held, scans, strict=True):
                new = [found.scan(text or "") for text in batch.column(place).to_pylist()]
                scanned[:] = [merged(x, y) for x, y in zip(scanned, new, strict=True)] if scanned else new
        yield from zip(held, scans, strict=True)


def merged(x: tuple[int, np.ndarray, set[str]], y: tuple[int, np.ndarray, set[str]]) -> tuple[int, np.ndarray, set[str]]:
    """The scans of one text by two parts as one."""
    if not len(y[1]):
        return x
    return x[0], x[1] | y[1] if len(x[1]) else y[1], x[2] | y[2]


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", max_benchmark_bytes: int = 64 << 20) -> list[tuple[object, str | None]]:
    """The test items on the driver, after their total size was checked."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {total} bytes; call the operator for parts of at most {max_benchmark_bytes}")
    return sorted(((r.item_id, r.text) for r in rows.collect()), key=repr)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, with_spans: bool = True) -> DataFrame:
    """Per document: n_words, n_hit, the items that occur, and their character spans.

    Null or empty text has no words.  An item of fewer words than a window, but not
    none, is one window.  Items without an id hit like others and are listed as one null at the end.  Repeated rows give repeated results.  An empty benchmark hits
    nothing.  One pass over the documents, no exchange.
    """
    items = benchmark_items(benchmark, item_col, item_text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scans in scan_batches(batches, 1, items, window, part_bytes):
            out: tuple[list, ...] = ([], [], [], [])
            for text, (n, hit, ids) in zip(batch.column(1).to_pylist(), scans, strict=True):
                for column, value in zip(out, (n, int(hit.sum()), sorted(ids, key=lambda x: (x is None, x)), char_spans(text, hit) if with_spans and len(hit) else []), strict=True):
                    column.append(value)
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(span))], ["doc_id", "n_words", "n_hit", "items", "spans"])

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(scan, HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window of the benchmark occurs.

    Null and empty texts have no words and stay; repeated rows stay or go together.
    """
    items, place = benchmark_items(benchmark), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scans in scan_batches(batches, place, items, window, part_bytes):
            yield batch.filter(pa.array([not ids for _, _, ids in scans], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated over all documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = contamination(docs, benchmark, with_spans=False)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = {
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + 9], ' ') AS p FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row_no, n, k, array_to_string(w[k : k + n - 1], ' ') AS p FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k)),
m AS (SELECT dw.row_no, dw.k, dw.n, bw.item_id FROM dw JOIN bw USING (n, p)),
hit AS (SELECT row_no, count(DISTINCT i) AS n_hit FROM (SELECT row_no, unnest(generate_series(k, k + n - 1)) AS i FROM (SELECT DISTINCT row_no, k, n FROM m)) GROUP BY row_no),
its AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_no, item_id FROM m) GROUP BY row_no)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_no) LEFT JOIN its USING (row_no)
""",
}
