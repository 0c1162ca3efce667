"""Whole Arrow batches of texts as arrays of code points, with rolling hashes over them.

The texts of a slice lie behind each other in one array, so numpy works on a million characters at a time and not
text by text. Slices end at text borders; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_CHARS = 1_000_000
_U = np.uint64


class Slice:
    """Texts of one slice: ``ids`` (numpy), ``cp`` (their code points), ``begin`` and ``end`` of each text in ``cp``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, cp: np.ndarray, bounds: np.ndarray):
        self.ids, self.rows, self.cp, self.begin, self.end = ids, rows, cp, bounds[:-1], bounds[1:]

    def owner(self) -> np.ndarray:
        """Index of the text that each code point belongs to."""
        return np.repeat(np.arange(len(self.begin), dtype=np.int32), self.end - self.begin)


def slices(ids: pa.Array, texts: pa.Array, size: int = SLICE_CHARS) -> Iterator[Slice]:
    """Cut a batch into slices. Null texts count as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ids_np = ids.to_numpy(zero_copy_only=False)
    lengths = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    i, n = 0, len(lengths)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + size, side="right")) - 1)
        joined = "".join(texts.slice(i, j - i).to_pylist())
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield Slice(ids_np[i:j], np.arange(i, j), cp, total[i : j + 1] - total[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@cache
def _base(seed: int) -> tuple[int, int]:
    m = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64) | 1
    return m, pow(m, -1, 1 << 64)


class Rolling:
    """Polynomial hash modulo 2^64 of any stretch of a sequence, from prefix sums; equal stretches have equal hashes."""

    def __init__(self, values: np.ndarray, seed: int = 1):
        m, inverse = _base(seed)
        n = len(values)
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, m, dtype=np.uint64)]))
        self.undo = np.cumprod(np.concatenate([[_U(1)], np.full(n, inverse, dtype=np.uint64)]))
        v = mix(values.astype(np.uint64) + _U(seed))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * powers[:n])])

    def all(self, width: int) -> np.ndarray:
        """Hash of the stretch of ``width`` from each position."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.undo[: len(self.sums) - width])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [begin, end)."""
        return mix((self.sums[end] - self.sums[begin]) * self.undo[begin] + (end - begin).astype(np.uint64))


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, is letter or digit) of every code point. A character with a longer lower case keeps its first."""
    chars = [chr(c) for c in range(0x110000)]
    lower = np.fromiter((ord(c.lower()[0]) for c in chars), np.uint32, len(chars))
    return lower, np.fromiter((c.isalnum() for c in chars), bool, len(chars))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])
