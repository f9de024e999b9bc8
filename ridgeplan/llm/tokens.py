"""Token ids of a public byte-level BPE vocabulary, as the `tokenizers` library gives them.

The vocabulary's JSON file is read once per worker.  Ordinary texts are encoded by a
byte-pair encoder built from that same vocabulary (ranks are the ids of a byte-level
vocabulary, in merge order), which gives the same ids several times faster; texts with
special strings or with characters outside Latin scripts go to the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which Unicode versions of the two encoders may differ, and control characters.
_UNUSUAL = regex.compile(r"[^\x09\x0A\x0D\x20-\x7E\xA0-ɏ‐-‧€]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelEncoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        alphabet, skip = byte_alphabet(), set(self.special)
        ranks = {bytes(alphabet[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in skip}
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text) or any(x in text for x in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]
