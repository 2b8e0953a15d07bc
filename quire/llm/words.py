"""Values of words, by 64-bit hash: 16 bytes a word and its count, where a dict of strings takes ten times as much.

Any number of words is taken, so none has to be left out of a large vocabulary. Two of ten million words have one hash with a probability
of 3 in a million, which is neglected.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import xxhash

#: Words that are held together with what was found for them.
HELD = 200_000
_NEW = object()


def key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Words:
    """Read like a dict. keys: a hash of each word; values: an array with a value for each, or a matrix with a row."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys = array("Q", keys[order].astype(np.uint64).tobytes())
        self.values = values[order] if values.ndim > 1 else array("q", values[order].astype(np.int64).tobytes())
        self.held: dict = {}

    def get(self, word: str, default=None):  # noqa: ANN001, ANN201
        x = self.held.get(word, _NEW)
        if x is _NEW:
            if len(self.held) >= HELD:
                self.held.clear()
            h = key(word)
            i = bisect_left(self.keys, h)
            x = self.held[word] = self.values[i] if i < len(self.keys) and self.keys[i] == h else None
        return default if x is None else x

    def __getitem__(self, word: str):  # noqa: ANN204
        x = self.get(word)
        if x is None:
            raise KeyError(word)
        return x

    def __len__(self) -> int:
        return len(self.keys)
