"""Vectorised word and shingle hashing over whole texts (numpy, no per-word Python).

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased.  A word's
hash is a polynomial over its UTF-8 bytes, taken from one prefix sum over the whole batch,
so the cost is a few array passes per byte whatever the texts look like.  All arithmetic
is modulo 2**64; ``SEED`` values are fixed so that every executor and every rerun agrees.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_COEF = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers = {"n": 0, "up": None, "down": None}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix style); other seeds give other orders."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n, grown on demand."""
    if _powers["n"] < n + 1:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(size, _P, dtype=np.uint64), np.full(size, _P_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            _powers.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words before each text (len + 1 values)."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    space = _IS_SPACE[data]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    last = word
    last[:-1] &= space[1:]
    stops = np.flatnonzero(last) + 1
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
        hashes = mix((prefix[stops] - prefix[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    offsets[1:] = np.searchsorted(starts, ends)
    return hashes, offsets


def batches(texts: list[str | None], limit: int = 300_000) -> list[range]:
    """Consecutive index ranges of about ``limit`` characters each (a longer text stands alone)."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            out.append(range(begin, i))
            begin, size = i, 0
        size += n
    if begin < len(texts):
        out.append(range(begin, len(texts)))
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is several times faster here than hashing."""
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(texts: list[str | None], width: int = 5):
    """Yields one sorted array of distinct uint64 shingle hashes per text.

    Fewer words than ``width`` give the whole sequence as one shingle; no words or a null
    text give an empty array.
    """
    for part in batches(texts):
        hashes, offsets = word_hashes([texts[i] or "" for i in part])
        n = len(hashes)
        rolled = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(width, n)):
                rolled[: n - j] += mix(hashes[j:], j + 1) * _COEF[j % 5]
            rolled = mix(rolled, 99)
            for k in range(len(part)):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if b - a >= width:
                    yield distinct(rolled[a : b - width + 1])
                elif b > a:
                    total = np.uint64((b - a) * 0x1D8E4E27C47D124F & _MASK)
                    for j, h in enumerate(hashes[a:b]):
                        total += mix(np.array([h]), j + 1)[0] * _COEF[j % 5]
                    yield mix(np.array([total], dtype=np.uint64), 99)
                else:
                    yield np.empty(0, dtype=np.uint64)
