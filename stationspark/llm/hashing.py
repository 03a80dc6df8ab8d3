"""Hashes and comparisons of many spans of one byte array at once.

``span_hashes`` are polynomials over bytes, from one running sum: fast for spans of any length, but different spans can be made
to have one hash, so who uses them compares the spans as well (``equal_spans``). ``short_hashes`` take up to 16 bytes as two
numbers and mix them.
"""

from __future__ import annotations

import numpy as np

#: Bytes for which powers are kept; those of longer arrays are made when asked for.
KEPT = 1 << 20
_ODD = 0xD1342543DE82EF95
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A number for each byte.
VALUES = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)
_kept: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    out = _kept.get(name)
    if out is None or len(out) < n:
        out = np.full(max(n, 1 << 16) if n > KEPT else 1 << max(16, (n - 1).bit_length()), base % 2**64, np.uint64)
        out[0] = 1
        out = np.cumprod(out)
        if n <= KEPT:
            _kept[name] = out
    return out[:n]


def forget() -> None:
    _kept.clear()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """A hash for each span [start, end) of the bytes ``data``, the same wherever a span stands. ``values``: a number for each byte."""
    n = len(data) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * _powers("power", _ODD, n)[:-1], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * _powers("inverse", pow(_ODD, -1, 2**64), n)[start] + (end - start).astype(np.uint64) * _STEP)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span that two numbers hold.
SHORT = 16


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, places past the end as zeros."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def _ends(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each span, and its last eight where it is longer: spans of up to 16 bytes whole."""
    at = _words(data)
    return at[start] & _MASKS[np.minimum(size, 8)], np.where(size > 8, at[start + np.maximum(size, 8) - 8], np.uint64(0))


def short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span of at most 16 bytes; those of longer spans mean nothing."""
    size = end - start
    first, last = _ends(data, start, size)
    return mixed(mixed(first + size.astype(np.uint64) * _STEP) * np.uint64(_ODD) + last)


def equal_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of the span of ``other`` at ``at``, ``size`` of them."""
    (a, b), (c, d) = _ends(data, start, size), _ends(other, at, size)
    out = (a == c) & (b == d)
    long = np.flatnonzero(out & (size > SHORT))
    if len(long):
        same = data[gathered(start[long], size[long])] == other[gathered(at[long], size[long])]
        out[long] = np.logical_and.reduceat(same, np.cumsum(size[long]) - size[long])
    return out


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans one after the other: start, start + 1, ... of each, ``size`` of them."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))
