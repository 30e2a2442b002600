"""Words of whole texts as numpy arrays, a bounded piece of an Arrow batch at a time.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z where
``fold`` is set. No Python object is made per word: word borders come from byte
masks, and a word's 64-bit hash from its 8-byte lanes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20  # of text handled at once; a longer text is handled alone

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Folds A-Z and makes ASCII punctuation and control bytes part of the gaps between words.
PLAIN = _FOLD.copy()
PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANE = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Of the texts of one piece: data (bytes, folded or not), and for each word
    its first byte, the byte after its last, and its hash; words of text i are
    splits[i] to splits[i + 1], and its bytes begin at at[i]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    splits: np.ndarray
    at: np.ndarray
    _hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.splits)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    @property
    def text_of(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.splits) - 1), self.counts)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of data."""
    length = (end - start).astype(np.int64)
    h = mix((length.astype(np.uint64) + np.uint64(1)) * _M1)
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))  # the 8 bytes from each byte on
    live, off = np.arange(len(start)), 0
    while len(live):
        left = length[live] - off
        x = lanes[start[live] + off] & _LANE[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ (x * _M1 + np.uint64(off + 1)))
        off += 8
        live = live[left > 8]
    return h


def words(texts: pa.Array, table: np.ndarray = _FOLD) -> Words:
    """Of an Arrow array of strings, each byte through ``table``; null is the empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    data = table[data]
    n = len(data)
    letter = ~_SPACE[data]
    first, last = letter.copy(), letter.copy()
    if n:
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        inner = at[(at > 0) & (at < n)]
        first[inner] = letter[inner]
        last[inner - 1] = letter[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, at), at)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum(sizes) // limit
    borders = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(borders, borders[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values, at its first; the last size - 1 have none."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _M1 + h[j : len(h) - size + 1 + j]
    return mix(out)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``size`` words inside one text; a text with
    fewer words has its whole sequence as one, one without words has none."""
    n = w.counts
    every = runs(w.hash, size)
    inside = np.ones(len(w.hash), bool)
    for j in range(1, size):  # the last size - 1 words of a text begin no run
        inside[np.maximum(w.splits[1:] - j, w.splits[:-1])[n > 0]] = False
    inside = inside[: len(every)]
    found, text = every[inside], w.text_of[: len(every)][inside]
    for m in range(1, size):
        if len(short := np.flatnonzero(n == m)):
            found = np.concatenate([found, runs(w.hash, m)[w.splits[:-1][short]]])
            text = np.concatenate([text, short])
    return found, text


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow lists of the given lengths, one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))
