"""NumPy kernels over the bytes of one text: word hashes, shingle sets, minimizers."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            step = np.full(size, base, _U)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of (a[j] + 1) * base^j for j < i, modulo 2^64."""
    h = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * powers(len(a) + 1)[0][: len(a)], out=h[1:])
    return h


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position-free hashes of the byte ranges [lo, hi) from prefix hashes."""
    return mix(((h[hi] - h[lo]) * powers(len(h))[1][lo]) ^ ((hi - lo).astype(_U) * _U(0xD6E8FEB86659FD93)))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each maximal run of bytes other than space and \\t..\\r."""
    a = np.frombuffer(text, np.uint8)
    if not len(a):
        return np.zeros(0, _U)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[a], [True])).view(np.int8)))
    return range_hash(prefix_hash(a), edge[0::2], edge[1::2])


_STEP = np.array([0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xD1342543DE82EF95, 0xC6A4A7935BD1E995, 0xA0761D6478BD642F], _U)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    With fewer words, the whole sequence is one shingle; without words the set is empty.
    """
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = min(width, len(w))
    if not n:
        return w
    out = np.full(len(w) - n + 1, n, _U)
    for j in range(n):
        out = (out ^ (out >> _U(29))) * _STEP[j % 5] + w[j : len(w) - n + 1 + j]
    return np.unique(mix(out))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    return x
