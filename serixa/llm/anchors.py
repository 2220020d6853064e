"""Content-defined anchors: the sampled suffix starts of the suffix-array operator.

A window is a string of `span` bytes.  Its anchor is the leftmost of its
`gram`-byte substrings whose mixed hash is smallest, so equal windows have their
anchor at the same offset, whatever stands around them.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                table = np.full(size, factor, dtype=np.uint64)
                table[0] = 1
                _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each `gram`-byte substring of data."""
    n = len(data)
    if n < gram:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        out = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each run of `width` values.

    Block-wise prefix and suffix minima: a fixed number of vector operations for
    any width.  The low 32 bits give way to the position, which breaks ties.
    """
    n = len(values)
    count = n - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-n // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keys[:n] = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    tiles = keys.reshape(blocks, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window start, last window start, gram hash) of each anchor.

    Every window start lies in the range of exactly one anchor.  Texts shorter
    than a window have none.
    """
    if len(data) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    hashes = gram_hashes(data, gram)
    at = sliding_argmin(hashes, span - gram + 1)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    position = at[starts]
    last = np.append(starts[1:], len(at)) - 1
    return position, starts, last, hashes[position]
