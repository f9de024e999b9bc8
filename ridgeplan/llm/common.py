"""Shared pieces of the text operators: columns, words, hashes and crc folds."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers for mixing 64-bit hashes (golden ratio and two primes of xxHash).
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def is_held_out(id_col: Column) -> Column:
    """Rows on which no classifier may learn: crc32 of the id's text, mod 4, is 2."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (so that sums and low bits are usable)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * MIX_B
        x = (x ^ (x >> U64(29))) * MIX_C
        return x ^ (x >> U64(32))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered per worker up to ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_WORD_HASHES: WordHashes | None = None


def word_hashes() -> WordHashes:
    """The worker's own cache."""
    global _WORD_HASHES
    if _WORD_HASHES is None:
        _WORD_HASHES = WordHashes()
    return _WORD_HASHES


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` values of a 64-bit array, by doubling (order counts)."""
    if len(words) < n:
        return np.empty(0, U64)
    have, out = 1, mix(words + MIX_A)
    with np.errstate(over="ignore"):
        while have < n:
            step = min(have, n - have)
            out = mix(out[: len(out) - step] * MIX_A + out[step:])
            have += step
    return out


def utf8(text: str) -> bytes:
    """UTF-8 bytes of a text as Arrow gave it."""
    return text.encode("utf-8", "surrogatepass")


def runs(batches, *keys: str):
    """Rows of sorted Arrow batches as one pyarrow Table per run of equal keys (across batches)."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[low] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held)
