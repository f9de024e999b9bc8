"""Secret scans: fixed patterns plus sliding-window Shannon entropy.

Base spans come from three patterns (assignments, access keys, hex runs).  The entropy
scan then takes candidate strings (runs of token characters), slides a window over each
and keeps the window's character counts incrementally: adding one character and dropping
another changes the sum of ``c * log2(c)`` by two table look-ups.  Windows whose entropy
reaches the threshold of the candidate's class, or in a run of hexadecimals that of ``hex``, become
a span of kind ``entropy``, unless the allow-list knows the candidate or a filler is near.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.llm.common import id_and_text

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Runs that are judged as hexadecimals inside candidates of other classes.
HEX_RUN = re.compile(r"[0-9A-F]{20,}|[0-9a-f]{20,}")
#: class -> entropy (bits per character) from which a window is a secret.
THRESHOLDS = {"hex": 3.0, "lower": 3.5, "upper": 3.5, "mixed": 3.75}
#: Candidates that are no secrets: numbers, UUIDs, dates, snake and kebab words (with up to four digits
#: at the end, or numbers between them), paths, examples.
ALLOW = tuple(re.compile(p) for p in (
    r"[0-9_=+/-]+", r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", r"[0-9A-F]{8}-(?:[0-9A-F]{4}-){3}[0-9A-F]{12}",
    r"[_/-]*(?:[a-z]+\d{0,4}|\d+)(?:[_/-]+(?:[a-z]+\d{0,4}|\d+))*[_/-]*", r"[_/-]*(?:[A-Z]+\d{0,4}|\d+)(?:[_/-]+(?:[A-Z]+\d{0,4}|\d+))*[_/-]*",
    r"(?:[A-Za-z]+[_/-])*[A-Za-z]+=*", r"(?:/?[A-Za-z]+\d{0,4})(?:/[A-Za-z]+\d{0,4})*",
))
#: Marks of examples and fillers; they silence the characters up to ``AROUND`` before and after them, not a whole blob.
FILLER, AROUND = re.compile(r"EXAMPLE|example|xxxx|XXXX|0000000000"), 40
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

SECRETS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def char_class(candidate: str) -> str | None:
    """``hex``, ``lower``, ``upper`` or ``mixed`` (digits with letters of one case or both), or None: words and numbers."""
    digit = any(c.isdigit() for c in candidate)
    lower, upper = any("a" <= c <= "z" for c in candidate), any("A" <= c <= "Z" for c in candidate)
    if not digit or not (lower or upper):
        return None
    if not (lower and upper) and all(c in "0123456789abcdefABCDEF" for c in candidate):
        return "hex"
    return "mixed" if lower and upper else "lower" if lower else "upper"


def candidate_spans(candidate: str, kind: str) -> list[tuple[int, int]]:
    """Spans by the candidate's class, and those in its runs of hexadecimals that are in none of them."""
    spans = entropy_spans(candidate, THRESHOLDS[kind])
    if kind == "hex":
        return spans
    starts, more = [start for start, _ in spans], []
    for m in HEX_RUN.finditer(candidate):
        for start, end in entropy_spans(m.group(), THRESHOLDS["hex"]) if char_class(m.group()) == "hex" else ():
            start, end = start + m.start(), end + m.start()
            before = bisect.bisect_right(starts, start)
            if not before or spans[before - 1][1] < end:
                more.append((start, end))
    return spans + more


def live_spans(candidate: str, kind: str) -> list[tuple[int, int]]:
    """The candidate's spans outside the neighbourhood of fillers."""
    out, at = [], 0
    for low, high in [(f.start() - AROUND, f.end() + AROUND) for f in FILLER.finditer(candidate)] + [(len(candidate), 0)]:
        out += [(s + at, e + at) for s, e in candidate_spans(candidate[at : max(at, low)], kind)]
        at = max(at, high)
    return out


def entropy_spans(candidate: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of the windows whose Shannon entropy is at least ``threshold``."""
    counts: dict[str, int] = {}
    total, spans, log_w = 0.0, [], math.log2(window)
    for k, c in enumerate(candidate):
        n = counts.get(c, 0)
        total += _CLOG[n + 1] - _CLOG[n] if n < window else 0.0
        counts[c] = n + 1
        if k >= window:
            gone = candidate[k - window]
            m = counts[gone]
            total -= _CLOG[m] - _CLOG[m - 1] if m <= window else 0.0
            counts[gone] = m - 1
        if k >= window - 1 and log_w - total / window >= threshold - 1e-9:
            start = k - window + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((start, k + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the three base kinds."""
    found = []
    folded = text.lower()
    if any(word in folded for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def all_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW) -> list[tuple[int, int, int]]:
    """Base and entropy spans by start, then kind; an entropy span inside a base span is left out."""
    found = sorted(base_spans(text))
    starts, reach = [start for start, _, _ in found], list(accumulate((end for _, _, end in found), max))  # furthest end so far
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        kind = char_class(candidate)
        if kind is None or any(p.fullmatch(candidate) for p in allow):
            continue
        for start, end in live_spans(candidate, kind):
            start, end = start + m.start(), end + m.start()
            before = bisect.bisect_right(starts, start)
            if not before or reach[before - 1] < end:
                found.append((start, 3, end))
    return sorted(found)


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """Per document the spans (kind, start, end) in code points; null or empty text: none.

    ``allow`` adds patterns to the allow-list of the entropy scan.  Repeated rows give
    repeated results.  One pass, no exchange.
    """
    patterns = ALLOW + tuple(re.compile(p) for p in allow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(text or "", patterns)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, SECRETS)


def redacted(text: str, patterns: tuple[re.Pattern, ...] = ALLOW) -> str:
    """The text with every span (overlapping ones together) replaced by a mark."""
    out, at = [], 0
    for start, kind, end in all_spans(text, patterns):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, texts redacted; ``length_col`` follows where it exists."""
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if length is not None:
                old = batch.column(length).to_pylist()
                columns[length] = pa.array([n if t is None else len(t) for t, n in zip(texts, old, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_entropy) over all documents."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
