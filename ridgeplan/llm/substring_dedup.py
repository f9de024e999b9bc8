"""Substring dedup with prefix-partitioned, sparse suffix trees.

A *window* is ``DEPTH`` consecutive words of one document; the words of every window whose
word sequence starts anywhere else too are covered.  A repeated window is an internal
node of depth ``DEPTH`` or more in the suffix tree of the corpus, so only the part of the
tree at that depth matters, and most suffixes never reach it:

1. **Sampled suffixes.**  Each window is represented by one of its positions, the one
   whose ``SEED``-word prefix has the smallest hash (leftmost on ties).  That choice
   depends on the window's words only, so equal windows choose alike, and about one
   position in fourteen is chosen at all.
2. **Prefix counts.**  Positions whose ``SEED``-word prefix is chosen only once in the
   corpus are leaves above ``SEED``; they are dropped.
3. **Prefix partition.**  The suffixes of the windows behind the other positions are
   dealt out by prefix: the ``SEED`` words at the chosen position, and for prefixes that are
   chosen at least ``FREQUENT`` times all ``DEPTH`` words of the suffix, so that no group
   outgrows memory.  Equal stretches, and equal rows, inside a chunk are combined before
   they are sent.
4. **Subtrees.**  In each group the nodes at depth 1, 2, 4 ... and ``DEPTH`` are named level by
   level: a node is a pair of nodes of half its depth.  Suffixes with the same name at ``DEPTH``
   are below one internal node and cover their words.  This compares the words themselves
   (as numbers of a group's vocabulary), so no hash decides a result.

Intermediate tables hold packed arrays by part.  The only thing that comes to the driver is
the list of over-frequent prefixes: longs, at most ``MOST_PREFIXES`` of them, as the bound
rises with the corpus beyond ``FREQUENT * MOST_PREFIXES`` positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.llm.common import U64, id_and_text, mix, runs, utf8, window_hashes, word_hashes
from ridgeplan.runtime import materialize

DEPTH, SEED = 35, 8
#: A prefix is over-frequent from this many chosen positions on; so many of them at most are kept in a list.
FREQUENT, MOST_PREFIXES = 4096, 2_000_000
CHUNK_WORDS = 2_000_000
#: Words of whole groups that are named at once.
PART = 400_000
PLACE = U64((1 << 28) - 1)

PACKED = "p int, kind int, a binary, b binary, c binary, d binary, e binary"
NAMES = "abcde"
PACKED_ARROW = pa.schema([("p", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in NAMES]])
#: kinds of packed rows: those that still need a meeting, and those that are only passed on
MEET, PASS = 0, 1


def words_of(text: str | None) -> list[bytes]:
    return utf8(text or "").split()


def chosen(hashes: np.ndarray, depth: int = DEPTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hash of each position, and for each window the position that represents it."""
    prefix = window_hashes(hashes, seed)
    least = (prefix & ~PLACE) | np.arange(len(prefix), dtype=U64)
    have, want = 1, depth - seed + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return prefix, (least & PLACE).astype(np.int64)


def pack(kind: int, part: np.ndarray, columns: list[np.ndarray], parts: int, texts: list[bytes] | None = None) -> Iterator[dict]:
    """Rows packed by part; ``texts`` goes to d (lengths) and e (bytes)."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cuts)):
        low, high = cuts[p], cuts[p + 1]
        row = {"p": int(p), "kind": kind} | {name: c[low:high].tobytes() for name, c in zip(NAMES, columns, strict=False)}
        if texts is not None:
            own = [texts[k] for k in order[low:high]]
            row |= {"d": np.fromiter(map(len, own), np.int32, len(own)).tobytes(), "e": b"".join(own)}
        yield row


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(U64)) % U64(parts)).astype(np.int64)


def passing(columns: list[np.ndarray], parts: int) -> Iterator[dict]:
    """What needs no meeting: one row per chunk, whose part its first entry chooses."""
    if len(columns[0]):
        part = int(parts_of(columns[0][:1] ^ columns[1][:1] ^ columns[2][:1], parts)[0])
        yield {"p": part, "kind": PASS} | {name: c.tobytes() for name, c in zip(NAMES, columns, strict=False)}


class Positions:
    """Step 2, sending side: the chosen positions of one chunk.  Equal rows count, but are held once."""

    def __init__(self, parts: int) -> None:
        self.parts, self.words = parts, 0
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.copies: dict[tuple[int, int], int] = {}

    def add(self, uid: tuple[int, int], words: list[bytes]) -> None:
        self.words += len(words)
        if len(words) < DEPTH:
            return
        if uid in self.copies:
            self.copies[uid] += 1
            return
        prefix, at = chosen(word_hashes().of(words))
        at = at[np.append(True, at[1:] != at[:-1])]
        self.keys.append(prefix[at])
        self.places.append(at)
        self.copies[uid] = 1

    def rows(self) -> Iterator[dict]:
        if not self.keys:
            return
        key, place, sizes = np.concatenate(self.keys), np.concatenate(self.places), [len(k) for k in self.keys]
        uid = np.repeat(np.array(list(self.copies), np.int64), sizes, axis=0)
        weight = np.repeat(np.array(list(self.copies.values()), np.int64), sizes)
        order = np.argsort(key, kind="stable")
        key, place, uid = key[order], place[order], uid[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(weight[order], first)
        again = np.repeat(n > 1, np.diff(np.append(first, len(key))))  # live already: these only pass
        passed = [uid[again, 0], uid[again, 1], place[again]]
        yield from passing(passed, self.parts)
        heads = first[n == 1]
        yield from pack(MEET, parts_of(key[heads], self.parts), [key[heads], uid[heads, 0], uid[heads, 1], place[heads]], self.parts)
        heads, none = first[n > 1], np.zeros(int((n > 1).sum()), np.int64)
        yield from pack(MEET, parts_of(key[heads], self.parts), [key[heads], none, none, -n[n > 1]], self.parts)


LIVE = "doc_id long, text_hash long, place long, n long"


def meet_positions(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Step 2, meeting side: places with a prefix that is chosen again; n > 0 rows: (key, n) of frequent prefixes."""
    out = [np.empty((0, 3), np.int64)]
    key, met = [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
    for kind, *blobs in zip(*(rows.column(c).to_pylist() for c in ("kind", *NAMES[:4])), strict=True):
        columns = [np.frombuffer(x, np.int64) for x in blobs if x is not None]
        if kind == PASS:
            out.append(np.stack(columns, axis=1))
        else:
            key.append(columns[0])
            met.append(np.stack(columns[1:], axis=1))
    keys, where = np.concatenate(key), np.concatenate(met)
    order = np.argsort(keys, kind="stable")
    keys, where = keys[order], where[order]
    frequent = np.empty((0, 2), np.int64)
    if len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat(np.where(where[:, 2] < 0, -where[:, 2], 1), first)
        size = np.diff(np.append(first, len(keys)))
        out.append(where[np.repeat(n > 1, size) & (where[:, 2] >= 0)])
        often = n >= FREQUENT
        frequent = np.stack([keys[first][often], n[often]], axis=1)
    live = np.concatenate(out)
    columns = [np.concatenate([live[:, 0], frequent[:, 0]]), np.concatenate([live[:, 1], np.zeros(len(frequent), np.int64)]), np.concatenate([live[:, 2], np.zeros(len(frequent), np.int64)]), np.concatenate([np.zeros(len(live), np.int64), frequent[:, 1]])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_hash", "place", "n"])


class Stretches:
    """Step 3, sending side: the stretches of words behind the live positions of one chunk.

    A stretch holds the suffixes of consecutive windows that one position represents:
    ``n`` starts, each followed by ``DEPTH`` words.
    """

    def __init__(self, parts: int, frequent: np.ndarray) -> None:
        self.parts, self.frequent, self.words = parts, frequent, 0
        self.seen: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        self.uids: dict[tuple[int, int], bool] = {}  # whether the row came again

    def add(self, uid: tuple[int, int], words: list[bytes], live: np.ndarray) -> None:
        self.words += len(words)
        if uid in self.uids:
            self.uids[uid] = True
            return
        self.uids[uid] = False
        prefix, at = chosen(word_hashes().of(words))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        after = np.append(first[1:], len(at))
        kept = np.isin(at[first], live)
        first, after = first[kept], after[kept]
        keys = prefix[at[first]]
        often = np.isin(keys, self.frequent)
        for low, high, key, split in zip(first.tolist(), after.tolist(), keys.tolist(), often.tolist(), strict=True):
            if split:  # the prefix is all of the suffix
                for s in range(low, high):
                    text = b" ".join(words[s : s + DEPTH])
                    self.seen.setdefault((xxhash.xxh3_64_intdigest(text), text), []).append((*uid, s, 1))
            else:
                self.seen.setdefault((key, b" ".join(words[low : high - 1 + DEPTH])), []).append((*uid, low, high - low))

    def rows(self) -> Iterator[dict]:
        if not self.seen:
            return
        again = [len(places) > 1 or self.uids[places[0][:2]] for places in self.seen.values()]
        covered = np.array([(d, h, s, s + n - 1 + DEPTH) for places, more in zip(self.seen.values(), again, strict=True) if more for d, h, s, n in places], np.int64).reshape(-1, 4)
        yield from passing(list(covered.T), self.parts)
        key = np.array([k for k, _ in self.seen], U64).view(np.int64)
        uid_s_n = np.array([(*places[0][:3], -places[0][3] if more else places[0][3]) for places, more in zip(self.seen.values(), again, strict=True)], np.int64)
        # packed with the place in two columns: key, then (doc_id, text_hash, start, n) row by row
        order = np.argsort(parts_of(key, self.parts), kind="stable")
        part, texts = parts_of(key, self.parts)[order], [t for _, t in self.seen]
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[p] : cuts[p + 1]]
            own = [texts[k] for k in at]
            yield {"p": int(p), "kind": MEET, "a": key[at].tobytes(), "b": uid_s_n[at].tobytes(), "d": np.fromiter(map(len, own), np.int64, len(own)).tobytes(), "e": b"".join(own)}


def deep_nodes(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each place the name of its node at ``depth``: equal names for equal runs of ``depth`` words.

    ``words`` are numbers of words.  A node of depth 2d is a pair of nodes of depth d; pairs are
    numbered by sorting, so names are exact.
    """
    name, have = words.astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        pair = name[: len(name) - step] * (int(name.max(initial=0)) + 1) + name[step:]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        name = np.empty(len(pair), np.int64)
        name[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])[: len(pair)])
        have += step
    return name


COVER = "doc_id long, text_hash long, start long, stop long"


def covered_by(stretches: list[tuple[np.ndarray, bytes]]) -> np.ndarray:
    """Ranges of words under internal nodes of whole groups: (doc_id, text_hash, start, stop)."""
    numbers: dict[bytes, int] = {}
    split = [text.split(b" ") for _, text in stretches]
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for own in split for w in own), np.int64, sum(map(len, split)))
    base = np.concatenate([[0], np.cumsum([len(own) for own in split])[:-1]])
    place = np.stack([p for p, _ in stretches])
    n = np.abs(place[:, 3])
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    name = deep_nodes(flat)[base[owner] + inside]
    met = np.bincount(name, np.where(place[owner, 3] < 0, 2, 1))[name] > 1
    owner, inside = owner[met], inside[met]
    if not len(owner):
        return np.empty((0, 4), np.int64)
    # starts of one stretch that are at most DEPTH apart make one range
    cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (inside[1:] > inside[:-1] + DEPTH)))
    last = np.append(cut[1:], len(owner)) - 1
    at = place[owner[cut]]
    return np.stack([at[:, 0], at[:, 1], at[:, 2] + inside[cut], at[:, 2] + inside[last] + DEPTH], axis=1)


def meet_stretches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Step 4: the covered ranges of words that the subtrees of one part give."""
    out = [np.empty((0, 4), np.int64)]
    keys, places, texts = [np.empty(0, np.int64)], [np.empty((0, 4), np.int64)], []
    for kind, a, b, c, d, e in zip(*(rows.column(x).to_pylist() for x in ("kind", *NAMES)), strict=True):
        if kind == PASS:
            out.append(np.stack([np.frombuffer(x, np.int64) for x in (a, b, c, d)], axis=1))
            continue
        ends = np.cumsum(np.frombuffer(d, np.int64)).tolist()
        keys.append(np.frombuffer(a, np.int64))
        places.append(np.frombuffer(b, np.int64).reshape(-1, 4))
        texts += [e[low:high] for low, high in zip([0, *ends], ends, strict=False)]
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
    held: list[tuple[np.ndarray, bytes]] = []
    words = 0
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False):
        if high - low == 1 and place[order[low], 3] > 0:
            continue  # one stretch, met once; equal windows never share the position that represents them
        for k in order[low:high].tolist():
            held.append((place[k], texts[k]))
            words += int(abs(place[k, 3])) + DEPTH - 1
        if words >= PART:
            out.append(covered_by(held))
            held, words = [], 0
    if held:
        out.append(covered_by(held))
    cover = np.concatenate(out)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cover.T], ["doc_id", "text_hash", "start", "stop"])


def _batches(rows: Iterator[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), PACKED_ARROW)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, stop): ranges of words covered by repeated windows; they may overlap.

    ``docs`` has uid columns doc_id and text_hash (not null) and text.
    """
    spark = docs.sparkSession
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def send_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Positions(parts)
        for batch in batches:
            for doc_id, text_hash, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                chunk.add((doc_id, text_hash), words_of(text))
                if chunk.words >= CHUNK_WORDS:
                    yield _batches(chunk.rows())
                    chunk = Positions(parts)
        yield _batches(chunk.rows())

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "p"):
            yield from meet_positions(rows)

    sent = docs.select("doc_id", "text_hash", "text").mapInArrow(send_positions, PACKED)
    live = materialize(sent.repartition("p").sortWithinPartitions("p").mapInArrow(positions, LIVE), "positions")
    # prefixes of at least total / MOST_PREFIXES positions are at most MOST_PREFIXES
    total = live.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = live.filter((F.col("n") > 0) & (F.col("n") * MOST_PREFIXES >= total)).select("doc_id").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(rows.column(0).to_numpy().view(U64)))

    by_doc = live.filter("n = 0").groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))

    def send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Stretches(parts, frequent.value)
        for batch in batches:
            for doc_id, text_hash, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                chunk.add((doc_id, text_hash), words_of(text), np.array(places, np.int64))
                if chunk.words >= CHUNK_WORDS // 4:
                    yield _batches(chunk.rows())
                    chunk = Stretches(parts, frequent.value)
        yield _batches(chunk.rows())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "p"):
            yield from meet_stretches(rows)

    joined = docs.select("doc_id", "text_hash", "text").join(materialize(by_doc, "live").hint("merge"), ["doc_id", "text_hash"])
    sent = joined.mapInArrow(send_stretches, PACKED)
    return materialize(sent.repartition("p").sortWithinPartitions("p").mapInArrow(stretches, COVER), "ranges")


DEDUPED = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, the kept words joined by single spaces, their sha256.

    Words are runs without ASCII white space.  All windows are judged on the input.  Null
    and empty texts have no words; texts shorter than a window keep all words.  Rows that
    repeat an id are documents of their own; equal rows repeat each other.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.col("doc_id").cast("long"))
    rows = rows.select(F.coalesce("row_id", F.lit(0)).alias("doc_id"), F.xxhash64("text", F.col("row_id").isNull()).alias("text_hash"), "row_id", "text")
    ranges = repeated_ranges(rows)
    # equal ranges of equal rows meet in each task before they are exchanged
    cover = materialize(ranges.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "cover")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row_id, text, ranges in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, n = words_of(text), 0
                if ranges:
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, [r["start"] for r in ranges], 1)
                    np.add.at(marks, [r["stop"] for r in ranges], -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    n = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                else:
                    kept = b" ".join(words)
                out.append((row_id, len(words), n, kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return rows.join(cover.hint("merge"), ["doc_id", "text_hash"], "left").select("row_id", "text", "ranges").mapInArrow(cut, DEDUPED)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT row_no, k, md5(array_to_string(w[k : k + 34], ' ')) AS g FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 34)) AS k)),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT row_no, unnest(generate_series(k, k + 34)) AS i FROM s JOIN r USING (g)),
a AS (SELECT row_no, count(*) AS n, list(i) AS gone FROM c GROUP BY row_no),
u AS (SELECT row_no, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
k AS (SELECT u.row_no, string_agg(x, ' ' ORDER BY i) AS kept FROM u LEFT JOIN c USING (row_no, i) WHERE c.i IS NULL GROUP BY u.row_no)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (row_no) LEFT JOIN k USING (row_no)
""",
}
