"""Words, word hashes and n-gram hashes of many texts at once, by numpy over their UTF-8 bytes.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (and the end) the number of words before it."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[:-1] += word
    edge[1:] -= word
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    both = np.unique(cuts[word[cuts - 1] & word[cuts]]) if len(cuts) else cuts  # a word that ends where the next row's first begins
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time, and by blake2b from 64 bytes on. Another seed gives independent hashes."""
    lens = ends - starts
    out = mix(lens.astype(np.uint64) + (_C ^ np.uint64(seed)))
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1))
    sel = None
    for k in range(0, _LONG, 8):
        keep = lens > k if sel is None else lens[sel] > k
        if keep.all():
            keep_idx = sel
        else:
            keep_idx = np.flatnonzero(keep) if sel is None else sel[keep]
            if not len(keep_idx):
                break
        s, n = (starts, lens) if keep_idx is None else (starts[keep_idx], lens[keep_idx])
        piece = eights[s + k].view(np.uint64)[:, 0] & _MASKS[np.minimum(n - k, 8)]
        if keep_idx is None:
            out = mix((out ^ piece) * _C + np.uint64(k))
        else:
            out[keep_idx] = mix((out[keep_idx] ^ piece) * _C + np.uint64(k))
        sel = keep_idx
    for i in np.flatnonzero(lens > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for at, base in ((0, _BASE), (1, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps)
    return _POWERS


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for every i; those that cross a row's end are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


def whole_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each row's whole word sequence; ``first`` as of ``word_spans``."""
    power, inverse = _powers(max(1, len(words) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])
    lens = np.diff(first).astype(np.uint64)
    return mix((sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]] + lens * _C)


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i of the grams of k words that lie in one row, and the row of each."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return first[:-1][rows] + (np.arange(len(rows)) - begin[rows]), rows


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of x[i : i + k] for every i, by doubling."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    have, y = 1, x
    while 2 * have <= k:
        y = np.minimum(y[:-have], y[have:])
        have *= 2
    return np.minimum(y[:n], y[k - have : k - have + n])
