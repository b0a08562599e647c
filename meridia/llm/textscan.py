"""Vectorised word hashing over the bytes of Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial
in randomly mapped bytes modulo 2^64, finalised with multiply-xorshift mixing; two lanes with
different multipliers give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; longer words fall back to a loop over pieces.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Lane:
    """One 64-bit polynomial hash of words; ``fold`` reads A-Z as a-z."""

    def __init__(self, seed: int, fold: bool = False):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.base = U((int(rng.integers(1, 1 << 61)) << 3) | 3)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self._powers = self._unpowers = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) >= n:
            return
        m = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            self._powers = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, self.base)]), dtype=np.uint64)
            self._unpowers = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, self.inverse)]), dtype=np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[starts[i]:ends[i]]; the spans ascend and don't overlap."""
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(starts):
                lo = starts[i]
                k = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
                hi = ends[k - 1]
                n = int(hi - lo)
                self._grow(n + 1)
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(self.table[data[lo:hi]] * self._powers[:n], out=sums[1:])
                s, e = starts[i:k] - lo, ends[i:k] - lo
                out[i:k] = mix((sums[e] - sums[s]) * self._unpowers[s] + (e - s).astype(np.uint64) * U(0x9E3779B97F4A7C15))
                i = k
        return out


def ngrams(h: np.ndarray, n: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of n consecutive values, by doubling; shorter input gives none."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total, have, block, size = None, 0, h, 1
        power = U(multiplier | 1)
        rest = n
        while rest:
            if rest & 1:
                if total is None:
                    total, have = block, size
                else:
                    m = len(h) - (have + size) + 1
                    total = total[:m] * power + block[have : have + m]
                    have += size
            rest >>= 1
            if rest:
                m = len(block) - size
                block = block[:m] * power + block[size : size + m]
                size *= 2
                power = power * power
        return mix(total[: len(h) - n + 1])


class Words:
    """The words of a slice of documents, flat: the batch's rows, the bytes (one space behind each
    document), each word's span, each document's first word and where its bytes start."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, edges: np.ndarray):
        self.rows, self.data, self.starts, self.ends, self.first, self.edges = rows, data, starts, ends, first, edges

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(texts: pa.Array, step: int = 1 << 19) -> Iterator[Words]:
    """Words of the batch's texts in slices of about ``step`` bytes; a null text is empty."""
    n = len(texts)
    if not n:
        return
    big = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if big else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    null = np.asarray(texts.is_null()) if texts.null_count else np.zeros(n, dtype=bool)
    lengths = np.where(null, 0, np.diff(offsets))
    i = 0
    while i < n:
        k = max(i + 1, i + int(np.searchsorted(np.cumsum(lengths[i:]), step, "right")))
        k = min(k, n)
        # one space between documents keeps their words apart
        size = lengths[i:k]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.full(int(at[-1]), 0x20, dtype=np.uint8)
        if not null[i:k].any():
            src = data[offsets[i] : offsets[k]]
            keep = np.ones(len(flat), dtype=bool)
            keep[at[1:] - 1] = False
            flat[keep] = src
        else:
            for j in range(i, k):
                if size[j - i]:
                    flat[at[j - i] : at[j - i] + size[j - i]] = data[offsets[j] : offsets[j + 1]]
        space = IS_SPACE[flat]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(flat) and not space[0]:
            turns = np.concatenate([[0], turns])
        starts, ends = turns[0::2], turns[1::2]
        yield Words(np.arange(i, k), flat, starts, ends, np.searchsorted(starts, at), at)
        i = k
