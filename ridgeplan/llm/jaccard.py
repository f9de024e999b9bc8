"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two sets with ``a`` and ``b`` shingles and Jaccard similarity of at least ``p/q`` differ in at
most ``h(a + b) = floor((q - p) * (a + b) / (q + p))`` shingles.  The universe of shingles is
hashed into ``m`` segments, ``m`` being fixed by the size band of the larger set.  Among
any ``h + 1`` units of allocation, where a segment compared for equality is one unit and
a segment compared within one deletion is two, at least one must agree.

* Every set is indexed under the subsets of its first ``k`` segments (``k`` covers all that
  any larger partner chooses from) and, for one reserve segment, under its one-deletion neighbourhood too.
* A set in the role of the larger one asks with the ``h(2a) + 1`` cheapest units only of those
  that it chooses from, under all of which its partners are indexed: the
  cost of a segment is its expected number of equal subsets, which falls with its size;
  empty segments are left out first, the reserve segment at two units fills the gap.
* Buckets without an asking row are dropped.  The other buckets give candidate pairs with
  the bucket's first set; equal subsets inside a task are combined before the exchange.
* Candidates are verified exactly on the whole texts.  Verified links make components.
  In a bucket whose sets are not all in one component, pairs between components of which the
  larger set asks there come next (any link is such a pair of some bucket): all that sizes and sketches leave, or, where those are very many, first just as many
  as could join the components and then, with the components that those made, all that
  are left, so no link between different components is lost.

Sets are the nodes: documents with equal sets are one node from the start, however
many they are, and never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeplan.llm.common import MIX_A, MIX_B, U64, id_and_text, mix, runs, utf8, window_hashes, word_hashes
from ridgeplan.operators.graph import connected_components, join_counted
from ridgeplan.runtime import materialize

#: Words of text that a task gathers before it combines equal subsets.
CHUNK_WORDS = 1_000_000
LOW = U64(1)


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den."""

    num: int = 85
    den: int = 100

    def differ(self, total: int) -> int:
        """Most shingles in which two linked sets with ``total`` shingles together differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, n: int) -> int:
        """Size of the largest possible partner of a set of n."""
        return self.den * n // self.num

    def choice(self, n: int) -> int:
        """Segments that a set of n chooses from when it asks: those that it may need, and some more."""
        need = self.differ(n + self.largest(n)) + 1
        return need + (need > 1) * (1 + need // 12)

    def units(self, n: int) -> int:
        """Segments under which a set of n is indexed: all that its largest partner, so each larger one, chooses from."""
        return self.choice(self.largest(n))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exact test of two sorted arrays of distinct shingles."""
        small, large = sorted((len(a), len(b)))
        if small == 0 or self.den * small < self.num * large:
            return False
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        return self.den * common >= self.num * (small + large - common)


def band_sizes(growth: float = 1.5) -> Iterator[int]:
    """Numbers of segments of the size bands."""
    m = 2
    while True:
        yield m
        m = max(m + 1, math.ceil(m * growth))


_BANDS = [m for m, _ in zip(band_sizes(), range(64), strict=False)]


def bands(n: int, t: Threshold) -> tuple[int, ...]:
    """Segment counts of the bands in which a set of n may meet a partner: its own first."""
    own, top = (next(m for m in _BANDS if m > t.units(x)) for x in (n, t.largest(n)))
    return tuple(m for m in _BANDS if own <= m <= top)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words give none."""
    if not words:
        return np.empty(0, U64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U64)
    found = np.sort(window_hashes(word_hashes().of(words), size))
    return found[np.append(True, found[1:] != found[:-1])]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return utf8(text or "").lower().split()


def node_of(found: np.ndarray) -> int:
    """64-bit identity of a set (signed)."""
    with np.errstate(over="ignore"):
        total = mix(found ^ MIX_A).sum(dtype=U64) ^ mix(np.array([len(found)], U64) * MIX_B)
    return int(mix(total)[0].astype(np.int64))


def signatures(found: np.ndarray, t: Threshold, frequency: np.ndarray) -> np.ndarray:
    """Subset signatures of one set; the lowest bit tells whether the set also asks with it.

    ``frequency`` estimates in how many sets each shingle is.  Any choice of units to ask
    with is exact; it decides only how many candidates are met.
    """
    n, out = len(found), []
    k, among, need = t.units(n), t.choice(n), t.differ(2 * n) + 1
    scrambled = mix(found)
    for place, m in enumerate(bands(n, t)):
        segment = (found % U64(m)).astype(np.int64)
        sizes = np.bincount(segment, minlength=m)
        with np.errstate(over="ignore"):
            order = np.argsort(segment, kind="stable")
            at = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[U64(0)], np.cumsum(scrambled[order], dtype=U64)])
            subset = sums[at[1:]] - sums[at[:-1]]
            salt = (np.arange(m, dtype=U64) + U64(m << 20)) * MIX_A
            sig = mix(subset ^ salt) & ~LOW
            reserve = m - 1
            ask = np.zeros(m, bool)
            two = False
            if place == 0:  # only in its own band a set is the larger one
                # equal subsets are at most as many as the rarest shingle; a small subset may be equal by chance
                cost = np.full(m, np.inf)
                np.minimum.at(cost, segment, frequency.astype(float))
                cheap = np.lexsort((-sizes[:among], cost[:among]))[:need]
                lacking = int((cost[cheap] > max(2.0, cost[reserve] * (sizes[reserve] + 1))).sum())
                if lacking:
                    two = lacking > 1
                    cheap = cheap[: need - min(lacking, 1 + two)]
                    ask[reserve] = True
                ask[cheap] = True
            out.append(sig[:k] | ask[:k].astype(U64))
            own = scrambled[segment == reserve]
            fewer = mix((subset[reserve] - own) ^ salt[reserve]) & ~LOW
            out += [sig[reserve:] | U64(ask[reserve]), fewer | U64(two)]
    return np.concatenate(out)


def bucketed(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in buckets of two nodes or more with an asking row: (key, node, first node), distinct."""
    return asked_buckets(sig, node)[:3]


def asked_buckets(sig: np.ndarray, node: np.ndarray, unasked: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, first node, whether the node asks), the buckets that :func:`bucketed` gives and, if wanted, those without an asking row."""
    empty = np.empty(0, np.int64)
    key = sig >> LOW
    order = np.argsort(key)
    key, ask, node = key[order], (sig[order] & LOW).astype(bool), node[order]
    if len(key) < 2:
        return empty.astype(U64), empty, empty, empty.astype(bool)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    live = np.repeat((size > 1) & (unasked | np.logical_or.reduceat(ask, first)), size)
    key, node, ask = key[live], node[live], ask[live]
    order = np.lexsort((~ask, node, key))
    key, node, ask = key[order], node[order], ask[order]
    if not len(key):
        return key, node, node, ask
    fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node, ask = key[fresh], node[fresh], ask[fresh]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    head, live = np.repeat(node[first], size), np.repeat(size > 1, size)
    return key[live], node[live], head[live], ask[live]


def frequencies(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of a chunk: in how many of the chunk's sets each of its shingles is."""
    everything = np.concatenate(sets)
    order = np.argsort(everything)
    ranked = everything[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.diff(np.append(first, len(ranked)))
    out = np.empty(len(everything), np.int64)
    out[order] = np.repeat(size, size)
    return np.split(out, np.cumsum([len(s) for s in sets])[:-1])


#: What tasks exchange: packed arrays by part.  DOC: doc_id, node, set size; SUBSET: signature,
#: node; LOCAL: signature, node, first node of a bucket that was combined within a chunk.
INDEX = "p int, kind int, a binary, b binary, c binary"
DOC, SUBSET, LOCAL = 0, 1, 2
#: What comes back: DOC rows as above, PAIR rows (two nodes) and MEMBER rows (bucket, node, 1 if the node asks).
FOUND = "kind int, x long, y long, z long"
PAIR, MEMBER = 1, 2


def record(kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> pa.RecordBatch:
    z = np.zeros(len(x), np.int64) if z is None else z
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind), pa.int32()), *[pa.array(c.astype(np.int64), pa.int64()) for c in (x, y, z)]], ["kind", "x", "y", "z"])


def by_part(kind: int, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[dict]:
    """The columns' rows, packed by the part of their key."""
    part = (keys % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cuts)):
        yield {"p": int(p), "kind": kind} | {name: c[cuts[p] : cuts[p + 1]].tobytes() for name, c in zip("abc", columns, strict=False)}


def index_chunk(ids: list[int], sets: list[np.ndarray], t: Threshold, parts: int) -> Iterator[dict]:
    """What one chunk of documents sends; equal subsets are combined to their smallest node, of those that ask if any does."""
    nodes = np.array([node_of(s) if len(s) else 0 for s in sets], np.int64)
    keys = mix(np.array(ids, np.int64).astype(U64))
    yield from by_part(DOC, keys, [np.array(ids, np.int64), nodes, np.array([len(s) for s in sets], np.int64)], parts)
    distinct = {int(n): s for n, s in zip(nodes, sets, strict=True) if len(s)}
    if not distinct:
        return
    found = [signatures(s, t, f) for s, f in zip(distinct.values(), frequencies(list(distinct.values())), strict=True)]
    sig, node = np.concatenate(found), np.repeat(np.fromiter(distinct, np.int64, len(distinct)), [len(x) for x in found])
    key, member, head, ask = asked_buckets(sig, node, unasked=True)
    yield from by_part(LOCAL, key, [key << LOW | ask.astype(U64), member, head], parts)
    order = np.lexsort((node, ~sig & LOW, sig >> LOW))
    sig, node = sig[order], node[order]
    first = np.flatnonzero(np.append(True, (sig[1:] >> LOW) != (sig[:-1] >> LOW)))
    yield from by_part(SUBSET, sig[first] >> LOW, [sig[first], node[first]], parts)


def join_part(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Documents, candidate pairs and bucket members of one part."""
    got: dict[int, list[list[np.ndarray]]] = {DOC: [], SUBSET: [], LOCAL: []}
    for kind, *blobs in zip(*(rows.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True):
        got[kind].append([np.frombuffer(x or b"", np.int64) for x in blobs])
    columns = {kind: [np.concatenate(c) for c in zip(*x, strict=True)] if x else [np.empty(0, np.int64)] * 3 for kind, x in got.items()}
    yield record(DOC, *columns[DOC])
    sig, node, _ = columns[SUBSET]
    sig = sig.view(U64)
    key, member, head, ask = asked_buckets(sig, node)
    asked = np.sort(sig[(sig & LOW).astype(bool)] >> LOW)
    local_sig, local_member, local_head = columns[LOCAL]
    local_key, local_ask = local_sig.view(U64) >> LOW, (local_sig & 1).astype(bool)
    live = np.isin(local_key, asked)
    pairs = np.unique(np.concatenate([np.stack([head, member], axis=1), np.stack([local_head, local_member], axis=1)[live]]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield record(PAIR, pairs[:, 0], pairs[:, 1])
    yield record(MEMBER, *wide_buckets(np.concatenate([key, local_key[live]]), np.concatenate([member, local_member[live]]), np.concatenate([ask, local_ask[live]])))


def wide_buckets(key: np.ndarray, node: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, node, asks) of the buckets of three nodes and more, named by their nodes, each set of nodes once.

    Buckets of two are one pair, which is tried anyway.  A node asks if it does in any bucket of these nodes.
    """
    order = np.lexsort((~ask, node, key))
    key, node, ask = key[order], node[order], ask[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
    key, node, ask = key[fresh], node[fresh], ask[fresh]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(first, len(key)))
    if not (size > 2).any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    with np.errstate(over="ignore"):
        name = mix(np.add.reduceat(mix(node.astype(U64) ^ MIX_A), first) + size.astype(U64) * MIX_B)
    live = np.repeat(size > 2, size)
    name, node, ask = np.repeat(name, size)[live].view(np.int64), node[live], ask[live]
    order = np.lexsort((~ask, node, name))
    name, node, ask = name[order], node[order], ask[order]
    fresh = np.append(True, (name[1:] != name[:-1]) | (node[1:] != node[:-1]))
    return name[fresh], node[fresh], ask[fresh]


PARITY_WORDS = 16
SETS = "node long, n int, text string, parity binary"


def parity(found: np.ndarray) -> bytes:
    """1024 bits; each shingle flips one.  Two sets differ in at least as many shingles as bits."""
    bits = np.bincount((mix(found) >> U64(54)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def forest(a: np.ndarray, b: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Positions of edges (a, b), in order, that join all trees that the edges can join.

    Edges are looked at ``step`` at a time; those inside a tree fall out before any is walked.
    """
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root, kept = np.arange(len(names)), []
    for low in range(0, len(x), step):
        while (root[root] != root).any():
            root = root[root]
        for k in (low + np.flatnonzero(root[x[low : low + step]] != root[y[low : low + step]])).tolist():
            u, v = int(x[k]), int(y[k])
            while root[u] != u:
                u = int(root[u])
            while root[v] != v:
                v = int(root[v])
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append(k)
        if len(kept) == len(names) - 1:
            break
    return np.array(kept, np.int64)


#: Pairs that a tile gives at once, as a multiple of its nodes; beyond that first those that may join components.
PAIRS_PER_NODE = 1
#: Pairs that are looked at together.
LOOK_PAIRS = 1 << 17
TILED = "a long, b long, more boolean"


def whole_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut so that every tile is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        change = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        if held and held[-1].column("tile")[-1].as_py() != tile[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(change[-1]) if len(change) else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def pairs_of_rows(low: int, high: int, begin: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each of the rows from ``low`` with those from its ``begin`` to its ``end``: any two (side 2), or one of side 0 with one of side 1."""
    after = (end - begin)[low:high]  # rows of the tile that each one is tried with
    i = np.repeat(np.arange(low, high), after)
    j = np.repeat(begin[low:high], after) + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    met = (side[i] == 2) | (side[i] != side[j])
    return (i, j) if met.all() else (i[met], j[met])


def sketches_near(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Bits in which sketches differ, and whether sizes and sketches leave a link possible."""
    apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)
    sizes = (t.den * n_a >= t.num * n_b) & (t.den * n_b >= t.num * n_a)
    return apart, sizes & (apart <= (t.den - t.num) * (n_a + n_b) // (t.den + t.num))


def candidate_tiles(tables: Iterable[pa.Table], t: Threshold, all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each tile that size and parity do not rule out and of which the larger set asks (either of equal ones).

    Rows without a column ``ask`` all ask.  Where few of a tile's rows ask, only these are tried with the others.
    A tile with more of them than nodes gives, unless ``all_pairs``, just enough to join all
    components that they could join, those with the nearest sketches, which most likely
    link and which other tiles of the same nodes choose too, and a row (bucket, 0, true) that
    says that there are more.  Small tiles are looked at many at a time, a large one some of its rows at a time.
    """
    for table in tables:
        tile, key, node, comp, n, side = (table.column(c).to_numpy().astype(np.int64) for c in ("tile", "key", "node", "component", "n", "side"))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), U64).reshape(-1, PARITY_WORDS)
        ask = leads = np.ones(len(tile), bool)
        if "ask" in table.column_names:  # rows that lead pairs come first in their tile
            ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((~(ask & (side != 1)), tile))
            tile, key, node, comp, n, side, bits, ask = (x[order] for x in (tile, key, node, comp, n, side, bits, ask))
            leads = ask & (side != 1)
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        size = np.diff(np.append(first, len(tile)))
        small, large, of = t.den * n, t.num * n, np.repeat(np.arange(len(first)), size)
        end, begin = np.repeat(first + size, size), np.arange(len(tile)) + 1
        if not leads.all():
            others = first + np.add.reduceat(leads.astype(np.int64), first)
            begin = np.where(side == 0, np.repeat(others, size), begin)
            end = np.where(leads, end, begin)
        rank = np.unique(comp, return_inverse=True)[1] + of * len(comp)  # components of one tile are its own

        def thinned(i: np.ndarray, j: np.ndarray, apart: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of tiles that are cut a forest of the nearest; that of a part's forest and the rest is that of all."""
            many, few = np.flatnonzero(cut[of[i]]), np.flatnonzero(~cut[of[i]])
            order = many[np.lexsort((node[i[many]] + node[j[many]], np.minimum(node[i[many]], node[j[many]]), apart[many]))]
            kept = np.concatenate([few, order[forest(rank[i[order]], rank[j[order]])]])
            return i[kept], j[kept], apart[kept]

        def given(i: np.ndarray, j: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if len(a) or len(more):
                columns = [pa.array(np.append(a, more)), pa.array(np.append(b, np.zeros(len(more), np.int64))), pa.array(np.arange(len(a) + len(more)) >= len(a))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "more"])

        work, low = np.cumsum(end - begin), 0
        found, held = np.zeros(len(first), np.int64), [(np.empty(0, np.int64),) * 3]
        while low < len(tile):  # rows with about LOOK_PAIRS pairs
            high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + LOOK_PAIRS, side="right")))
            i, j = pairs_of_rows(low, high, begin, end, side)
            near = (comp[i] != comp[j]) & (small[i] >= large[j]) & (small[j] >= large[i]) & (ask[j] | (n[i] >= n[j]))
            i, j = i[near], j[near]
            apart, kept = sketches_near(bits[i], bits[j], n[i], n[j], t)
            i, j, apart = i[kept], j[kept], apart[kept]
            low = high
            if all_pairs:
                yield from given(i, j, key[:0])
                continue
            found += np.bincount(of[i], minlength=len(first))
            held.append((i, j, apart))
            if low == len(tile) or sum(len(x[0]) for x in held) > LOOK_PAIRS:
                i, j, apart = (np.concatenate(c) for c in zip(*held, strict=True))
                cut = found > PAIRS_PER_NODE * size
                held = [thinned(i, j, apart, cut) if cut.any() else (i, j, apart)]
        if not all_pairs:
            yield from given(*held[-1][:2], key[first[found > PAIRS_PER_NODE * size]])


class JaccardJoin:
    """Links between documents whose shingle sets have a Jaccard similarity of num / den or more."""

    def __init__(self, size: int = 4, num: int = 85, den: int = 100, chunk_words: int = CHUNK_WORDS, tile: int = 8192) -> None:
        self.size, self.t, self.chunk_words, self.tile = size, Threshold(num, den), chunk_words, tile

    def found(self, docs: DataFrame) -> DataFrame:
        """DOC, PAIR and MEMBER rows (a table of its own)."""
        spark, t, size, chunk = docs.sparkSession, self.t, self.size, self.chunk_words
        parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
        schema = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, sets, words = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = words_of(text)
                    ids.append(doc_id)
                    sets.append(shingles(own, size))
                    words += len(own)
                    if words >= chunk:
                        yield pa.RecordBatch.from_pylist(list(index_chunk(ids, sets, t, parts)), schema)
                        ids, sets, words = [], [], 0
            if ids:
                yield pa.RecordBatch.from_pylist(list(index_chunk(ids, sets, t, parts)), schema)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in runs(batches, "p"):
                yield from join_part(rows)

        sent = docs.filter("doc_id IS NOT NULL").mapInArrow(send, INDEX)
        return materialize(sent.repartition("p").sortWithinPartitions("p").mapInArrow(meet, FOUND), "jaccard")

    def texts(self, docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
        """One text for each node that has a candidate."""
        size = self.size
        rows = found.filter(F.col("kind") == DOC).select(F.col("x").alias("doc_id"), F.col("y").alias("node"))
        nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        wanted = materialize(join_counted(rows, nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "wanted")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = shingles(words_of(text), size)
                    if len(own) and node_of(own) == node:  # an id may stand on several rows
                        out.append({"node": node, "n": len(own), "text": text, "parity": parity(own)})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("n", pa.int32()), ("text", pa.string()), ("parity", pa.binary())]))

        picked = join_counted(docs, wanted, "doc_id").select("node", "text").mapInArrow(look, SETS)
        return materialize(picked.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "text", "parity")]), "texts")

    def possible(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches leave, so that texts travel for these only."""
        t = self.t
        a, b = (texts.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}")) for k in "ab")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(-1, PARITY_WORDS) for c in ("parity_a", "parity_b")]
                kept = sketches_near(*bits, *(batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")), t)[1]
                yield batch.select(["a", "b"]).filter(pa.array(kept))

        both = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
        return materialize(both.mapInArrow(test, "a long, b long"), "possible")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that are links, by exact comparison of their sets."""
        t, size = self.t, self.size
        a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, np.empty(0, U64)
            for batch in batches:
                keep = []
                for first, text, other in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                    if first != last:
                        last, held = first, shingles(words_of(text), size)
                    keep.append(t.links(held, shingles(words_of(other), size)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b")
        return materialize(both.mapInArrow(test, "a long, b long"), "links")

    def open_pairs(self, members: DataFrame, comps: DataFrame, texts: DataFrame, all_pairs: bool) -> tuple[DataFrame, DataFrame]:
        """TILED rows for buckets that hold several components, and the members of those buckets."""
        t, tile = self.t, self.tile
        placed = materialize(join_counted(members, comps, "node", "left").select("key", "node", "ask", F.coalesce("component", "node").alias("component")), "members")
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), F.count_if("ask").alias("asks")).filter("low < high")
        groups = lambda n: F.when(F.col("size") <= tile, 0).otherwise(F.ceil(n / tile)).cast("int")  # noqa: E731  0, 0: the bucket is one tile
        mixed = materialize(mixed.select("key", groups(F.col("asks")).alias("asking"), groups(F.col("size") - F.col("asks")).alias("quiet")), "mixed")
        held = materialize(join_counted(placed, mixed, "key"), "mixed-members")
        # a group of asking rows meets itself, every later one and every group of quiet rows, which do not meet
        upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
        met = lambda c, quiet: F.transform(upto(c), lambda k: F.struct(F.lit(quiet).alias("quiet"), k.alias("group")))
        rows = held.withColumn("own", F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("ask"), F.col("asking")).otherwise(F.col("quiet")), F.lit(1))).cast("int"))
        rows = rows.join(texts.select("node", "n", "parity").hint("merge"), "node")
        whole = F.array(F.struct(F.lit(False).alias("quiet"), F.lit(0).alias("group")))
        others = F.when(F.col("asking") + F.col("quiet") == 0, whole).when(F.col("ask"), F.concat(met("asking", False), met("quiet", True))).otherwise(met("asking", True))
        rows = rows.withColumn("other", F.explode(others)).withColumn("group", F.col("other.group"))
        crossed = F.col("other.quiet")
        low, high = (F.when(crossed, F.when(F.col("ask"), F.col(a)).otherwise(F.col(b))).otherwise(f("own", "group")) for a, b, f in (("own", "group", F.least), ("group", "own", F.greatest)))
        tiles = rows.select(
            F.xxhash64("key", crossed, low, high).alias("tile"),
            F.when(crossed, F.when(F.col("ask"), 0).otherwise(1)).when(F.col("own") == F.col("group"), 2).when(F.col("own") < F.col("group"), 0).otherwise(1).alias("side"), "key", "node", "component", "n", "ask", "parity",
        )
        out = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda batches: candidate_tiles(whole_tiles(batches), t, all_pairs), TILED)
        return materialize(out, "tiles"), held.select("key", "node", "ask")

    def components(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

        Null and empty texts have no shingles and link with nothing; a row without an id
        has no component and links with nothing; rows that repeat an id are compared
        each by its own text and share the smallest component found for the id's set.
        """
        docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
        found = self.found(docs)
        pairs = materialize(found.filter(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
        members = found.filter(F.col("kind") == MEMBER).groupBy(F.col("x").alias("key"), F.col("y").alias("node")).agg((F.max("z") > 0).alias("ask"))
        texts = self.texts(docs, found, pairs)
        pairs = self.possible(pairs, texts)
        links = self.verified(pairs, texts)
        comps = connected_components(links)
        for all_pairs in (False, True):  # then, where a tile gave only as few pairs as might do, all that are still open
            tiles, members = self.open_pairs(members, comps, texts, all_pairs)
            again = materialize(tiles.filter("NOT more").select("a", "b").distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
            if again.limit(1).count():
                links, pairs = links.unionByName(self.verified(again, texts)), pairs.unionByName(again)
                comps = connected_components(links)
            cut = materialize(tiles.filter("more").select(F.col("a").alias("key")).distinct(), "cut")
            if not cut.limit(1).count():
                break
            members = join_counted(members, cut, "key")
        rows = found.filter(F.col("kind") == DOC).select(F.col("x").alias("doc_id"), F.col("y").alias("node"), F.col("z").alias("n_shingles"))
        placed = materialize(join_counted(rows, comps, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component")), "placed")
        first = materialize(placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("first")), "first")
        linked = placed.join(first.hint("merge"), "component", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
        size = self.size

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [len(shingles(words_of(x), size)) for x in batch.column(0).to_pylist()]
                nothing = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, pa.array(n, pa.int64()), nothing], ["doc_id", "n_shingles", "component_id"])

        return linked.unionByName(docs.filter("doc_id IS NULL").select("text").mapInArrow(count, "doc_id long, n_shingles long, component_id long"))


def one_of_each(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its component.

    Rows without an id stay; of rows that repeat an id all stay or none.
    """
    groups = JaccardJoin(size, num, den).components(docs)
    lost = materialize(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "lost")
    return docs.join(lost.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id over all documents: 4-word shingles, 85 in 100."""
    return JaccardJoin().components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 3))) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
""",
}
