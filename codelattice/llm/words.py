"""Word hashes of whole Arrow batches, without a Python step for each word.

A batch is cut into pieces of about PIECE bytes at document borders, so memory follows the piece and
the longest single text. In a piece, words are runs of bytes that are no white space; all are hashed
side by side, eight bytes a step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks of the first 0 to 8 bytes.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: From so many bytes on, a span is hashed by BLAKE2b.
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans of up to 7 bytes have hashes of their own.

    Eight bytes at a time are joined to the state by xor, multiplied by an odd number out of the seed, and mixed. Two given
    spans collide for one seed in about 2**64; who knows the seed can make spans that collide, so where nothing compares
    the bytes, the seed has to come from corpus_key() or the like.
    """
    n, eight, own = ends - starts, eights(data), np.array([seed], np.uint64)
    first, next_ = (mix(own + x)[0] | np.uint64(1) for x in (_ODD, _ODD2))
    h = eight[starts] & _MASK[np.minimum(n, 8)]
    h = mix(((h | (np.where(n < 8, n, 0).astype(np.uint64) << np.uint64(56))) ^ own) * first)
    wide = np.flatnonzero((n >= 8) & (n < LONG))
    todo, at = wide[n[wide] > 8], 8
    while len(todo):
        h[todo] = mix((h[todo] ^ (eight[starts[todo] + at] & _MASK[np.minimum(n[todo] - at, 8)])) * next_)
        at += 8
        todo = todo[n[todo] > at]
    h[wide] = mix(h[wide] + n[wide].astype(np.uint64) * _ODD2)
    for i in np.flatnonzero(n >= LONG):
        h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(seed).to_bytes(8, "little")).digest(), "<u8")[0]
    return h


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from each pair of places are equal."""
    same, x, y = np.ones(len(n), bool), eights(a), eights(b)
    todo, at = np.flatnonzero((n > 0) & (n < LONG)), 0
    while len(todo):
        same[todo] &= ((x[a_starts[todo] + at] ^ y[b_starts[todo] + at]) & _MASK[np.minimum(n[todo] - at, 8)]) == 0
        at += 8
        todo = todo[n[todo] > at]
    for i in np.flatnonzero(n >= LONG):
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n[i]], b[b_starts[i] : b_starts[i] + n[i]])
    return same


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets of the documents in them); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, its end, for each document the place of its first word, and one more).

    With lower, A-Z count as a-z.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    blank = _BLANK[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = True
    before[1:] = blank
    border = before.copy()
    border[offsets] = True
    inked = ~blank
    starts = np.flatnonzero(inked & border[:-1])
    ends = np.flatnonzero(inked & np.concatenate([border[1:-1] | blank[1:], [True]])) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return hash_spans(data, starts, ends, seed), starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; len(h) - k + 1 of them (none if there are fewer words).

    Runs of 1, 2, 4, ... words are joined as the bits of k ask.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, run, size = np.zeros(len(h), np.uint64), 0, h, 1
    while done < k:
        if k & size:
            own = run[done : len(run)]
            out = mix(out[: len(own)] * _ODD + own)
            done += size
        if 2 * size <= k:
            run = mix(mix(run[: len(run) - size]) + run[size:])
        size *= 2
    return mix(out[: len(h) - k + 1] + np.uint64(k))


def shingles(h: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all documents, places of each document's first one, and one more).

    A document of fewer than k words, but one at least, has its whole sequence as its only shingle.
    """
    counts = np.diff(firsts)
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(firsts[:-1] - at[:-1], size) + np.arange(at[-1])
    out = np.empty(at[-1], np.uint64)
    g = grams(h, k)
    full = np.repeat(counts >= k, size)
    out[full] = g[first[full]]
    for d in np.flatnonzero((counts < k) & (counts > 0)):
        short = np.array([counts[d]], np.uint64)
        for x in h[firsts[d] : firsts[d + 1]]:
            short = mix(short) + x
        out[at[d]] = mix(short)[0]
    return out, at
