"""Word shingles of a text as 64-bit hashes, whole texts at a time, with numpy.

Words are runs of bytes other than blank and U+0009 to U+000D, A-Z lower-cased. A text's set holds
its distinct five-word shingles; with fewer words, the whole sequence as one; without words, none.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 2**64), _U)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd multipliers, one per place in a shingle. Unrelated to each other: places in arithmetic
#: progression would give equal sums to different orders of repeated words.
_PLACES = mix(np.arange(1, SHINGLE + 1, dtype=_U)) | _U(1)


def _block_hashes(a: np.ndarray) -> np.ndarray:
    white = _WHITE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True]))))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash per word, in order. ``data``: UTF-8."""
    a = np.frombuffer(data.lower(), np.uint8)  # of bytes: A-Z only
    if len(a) <= _BLOCK:
        return _block_hashes(a)
    out, at = [], 0
    while at < len(a):
        end = min(len(a), at + _BLOCK)
        while end < len(a):  # cut at white space, further on if a word fills the block
            gap = np.flatnonzero(_WHITE[a[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(len(a), end + _BLOCK)
        out.append(_block_hashes(a[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes(data)
    n = len(w)
    if n == 0:
        return w
    if n < SHINGLE:  # apart from any five-word shingle
        h = np.full(1, 0xA5A5A5A5 + n, _U)
        for k in range(n):
            h += w[k : k + 1] * _PLACES[k]
        return mix(h)
    h = np.zeros(n - SHINGLE + 1, _U)
    for k in range(SHINGLE):
        h += w[k : n - SHINGLE + 1 + k] * _PLACES[k]
    return np.unique(mix(h))
