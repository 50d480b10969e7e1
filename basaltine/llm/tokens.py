"""Vectorised words and hashes of Arrow text columns.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 never
uses those bytes inside a character, so bytes and code points agree on them.
All functions work on a bounded chunk of a batch: temporaries are a few dozen
bytes for every byte of text, whatever the size of the batch. Hashes choose what
is compared or counted together; callers that must be exact compare the words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bits of the first k bytes of a little-endian lane.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_SIZE, _GRAM = U64(0xA0761D6478BD642F), U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text stands alone."""
    data, offs = buffers(texts)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of a chunk: byte ranges, number per text and 64-bit hashes."""

    __slots__ = ("counts", "data", "ends", "first", "starts", "text")

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        inside = _WORD[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        starts, ends = at[0::2], at[1::2]
        # A word that runs over the border of two texts is two words.
        cuts = offs[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        if len(cuts):
            cuts = cuts[inside[cuts] & inside[cuts - 1]]
            if len(cuts):
                starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offs)
        self.first[-1:] = len(starts)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offs) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word: its bytes, eight at a time, are mixed in one after the other, so no two words collide by their form."""
        size = self.ends - self.starts
        h = mix(size.astype(U64) * _SIZE + U64(seed))
        if not len(h):
            return h
        # The eight bytes from each position on, without a copy of them.
        lanes = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        h = mix(h ^ lanes[self.starts] & _HEAD[np.minimum(size, 8)])
        at, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(at):
            h[at] = mix(h[at] ^ lanes[self.starts[at] + k] & _HEAD[np.minimum(size[at] - k, 8)])
            k += 8
            at = at[size[at] > k]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            word = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(word, "little")
        return h

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of each run of n words of one text, at the run's first word. The hash at position i is that of words i..i+n-1; positions run over all but each text's last n-1 words."""
        total = len(hashes)
        if total < n:
            return np.empty(0, np.int64), np.empty(0, U64)
        at = np.flatnonzero(self.text[: total - n + 1] == self.text[n - 1 :])
        return at, gram_hashes(hashes, n)[at]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the n-word shingles, in text order, with repeats; a text of fewer words has the whole sequence as one, a text without words none."""
        hashes = self.hashes()
        at, grams = self.grams(hashes, n)
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if not len(short):
            return self.text[at], grams
        whole = mix(self.counts[short].astype(U64) * _SIZE)
        for k in range(int(self.counts[short].max())):
            more = self.counts[short] > k
            whole[more] = mix(whole[more] ^ hashes[self.first[short[more]] + k])
        text = np.concatenate([self.text[at], short])
        order = np.argsort(text, kind="stable")
        return text[order], np.concatenate([grams, whole])[order]


def words_of(words: Words) -> pa.Array:
    """The words themselves, as bytes."""
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words.data[_WORD[words.data]]))])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive values: runs of doubled length are joined, then those that make up n."""
    size, doubled, out, have = 1, hashes, None, 0
    while True:
        if n & size:
            out, have = (doubled, size) if out is None else (joined(out, doubled, have), have + size)
        if size * 2 > n:
            return mix(out + U64(n))
        doubled = joined(doubled, doubled, size)
        size *= 2


def joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``left``, each of ``size`` values, followed by the run of ``right`` that begins after it."""
    n = max(0, min(len(left), len(right) - size))
    return mix(left[:n] * _GRAM ^ right[size : size + n])


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def give_back() -> None:
    """Free memory that a Python worker holds after a task, so that the next stage finds it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of other systems
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
