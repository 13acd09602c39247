"""Rolling k-gram hashes and winnowed anchors of one text, in numpy.

Everything works on code points, so positions are Unicode characters.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown by doubling and kept per worker."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit; polynomial hashes have weak low bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class RollingHash:
    """Hash of any substring in O(1) after one prefix sum."""

    def __init__(self, text: str):
        c = code_points(text)
        self.n = len(c)
        up, self._down = _powers(self.n + 1)
        self._sum = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sum[1:])

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])

    def all_windows(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.empty(0, dtype=np.uint64)
        m = self.n - k + 1
        return mix((self._sum[k:] - self._sum[:m]) * self._down[:m])


def _sliding(a: np.ndarray, w: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over every window of w values, by block-wise prefix and suffix scans."""
    n = len(a)
    pad = (-n) % w
    b = np.concatenate([a, np.full(pad, fill, dtype=a.dtype)]).reshape(-1, w)
    left = op.accumulate(b, axis=1).ravel()
    right = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some window of w; a text shorter than a window has none."""
    if len(hashes) < w:
        return np.empty(0, dtype=np.int64)
    least = _sliding(hashes, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    zero = np.zeros(w - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([zero, least, zero]), w, np.maximum, np.uint64(0))
    return np.flatnonzero(best == hashes)


def digest64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
