"""Words and shingles of many texts at once: the words are found and hashed by numpy over one byte buffer.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A hash is 64 bits wide, so two
different shingles of one pair of texts collide with a chance below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that one numpy pass works on.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives an empty one."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _hash_buffer(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer that ends with a space."""
    gap = _SPACE[joined]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    pw, inverse = _power_tables(len(joined))
    total = np.empty(len(joined) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER[joined] + np.uint64(1)) * pw[: len(joined)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP), starts


def _cuts(text: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes that end between words (a longer word stays whole)."""
    begin = 0
    while len(text) - begin > PIECE:
        end = begin + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of `texts` in order, and for each text the number of its words."""
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
        found = np.concatenate([_hash_buffer(np.frombuffer(p + b" ", np.uint8))[0] for p in _cuts(texts[0])])
        return found, np.array([len(found)])
    h, starts = _hash_buffer(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    bounds = np.cumsum(np.array([0] + [len(t) + 1 for t in texts]))
    return h, np.diff(np.searchsorted(starts, bounds))


def shingles(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one run, no words give none."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(len(h), width)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _STEP + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The shingle set of each text, over bounded pieces of the list."""
    for begin, end in slices(texts):
        h, counts = word_hashes(texts[begin:end])
        stops = np.cumsum(counts)
        for n, e in zip(counts.tolist(), stops.tolist(), strict=True):
            yield shingles(h[e - n : e], width)
