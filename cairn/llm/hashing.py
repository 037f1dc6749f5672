"""Vectorised 64-bit hashes of all windows of a sequence, and window minima."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = _U(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)
_LOW = mix(np.arange(1 << 16, dtype=np.uint64))


def code_points(text: str) -> np.ndarray:
    """The text's characters as numbers; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `window_hash` gets the hash of any stretch; `values` are uint64 already mixed."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _up(len(values)), out=out[1:])
    return out


def text_prefix(codes: np.ndarray) -> np.ndarray:
    small = _LOW[codes & np.uint32(0xFFFF)]
    if len(codes) and codes.max() >= 1 << 16:
        small = np.where(codes >= 1 << 16, mix(codes.astype(np.uint64)), small)
    return prefix_hash(small)


def window_hash(prefix: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the stretches [start, start + width); equal stretches have equal hashes."""
    return mix((prefix[starts + width] - prefix[starts]) * _down(len(prefix))[starts])


def all_windows(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every stretch of `width` values."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:-width]) * _down(n))


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) over each window of `width` values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = fold(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return fold(x[:-rest], x[rest:]) if rest else x


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of values that are the least of some window of `width` successive values.

    Every window holds a chosen position with its least value, so two sequences that share a window choose the same
    value in it. Of equal values close together only as many are kept as that needs. Sequences shorter than `width`
    choose nothing.
    """
    if len(h) < width:
        return np.zeros(0, np.int64)
    lows = _slide(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, h.dtype), lows, np.zeros(width - 1, h.dtype)])
    at = np.flatnonzero(h == _slide(padded, width, np.maximum))
    if len(at) > 1 and (h[at[1:]] == h[at[:-1]]).any():
        keep, last = [], {}
        following = {}
        values = h[at].tolist()
        nxt = [None] * len(at)
        for i in range(len(at) - 1, -1, -1):
            nxt[i] = following.get(values[i])
            following[values[i]] = int(at[i])
        for i, p in enumerate(at.tolist()):
            prev = last.get(values[i])
            if prev is None or nxt[i] is None or nxt[i] - prev > width:
                keep.append(p)
                last[values[i]] = p
        at = np.array(keep, np.int64)
    return at
