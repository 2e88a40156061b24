"""Words of whole texts as 64-bit hashes, in numpy, inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def fold(columns: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash from several columns of hashes; their order counts."""
    start = (seed * int(_M1) + int(_PRIME)) % (1 << 64)
    out = np.full(len(columns[0]), start, np.uint64)
    for c in columns:
        out = out * _PRIME + c
    return mix(out)


class WordHashes(dict):
    """Hash of a word, kept for the words met so far (at most ``most`` of them)."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of a text's words: A-Z lower-cased, split at ASCII white space."""
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word windows; a shorter text is one window
    of its own length; no words, no windows."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return fold([words[i:i + 1] for i in range(n)], seed=n)
    return np.unique(fold([words[i:n - size + 1 + i] for i in range(size)]))
