"""Word shingles of whole texts as 64-bit hashes, for many documents at once.

Words are runs of bytes other than space and 0x09-0x0D after A-Z became a-z. A set holds the
distinct shingles of ``WIDTH`` consecutive words; a text with fewer words has its whole sequence
as its one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        base, inverse = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _POWERS[:n], _INVERSES[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: the word as a polynomial, moved to exponent 0, mixed with its length."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\n".join(coded)
    words, start = word_hashes(joined)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    cuts = np.searchsorted(start, np.cumsum(sizes) - sizes)
    cuts = np.append(cuts, len(words)).tolist()
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    place = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)  # unrelated factors: no sum of some equals a sum of others
    for k in range(width):
        total += words[k : k + len(total)] * place[k]
    total = mixed(total)
    out = []
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mixed(whole * np.uint64(0x2545F4914F6CDD1D) ^ w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
