"""Words of a batch of texts and hashes of runs of words, as arrays.

The texts' bytes stay one array. A word's hash is the sum of a mixed value of each (byte, place in the word), taken from
running sums, so all words are hashed at once; unlike a polynomial modulo 2 ** 64 it has no structure that long words of
two letters could meet. A run's hash is a polynomial over its words' hashes; runs are short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers: of a byte's place, of a word's place in a run, and of the second run hash.
BYTE_R, RUN_R, RUN_R2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes of text that are handled at once.
PIECE = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but letters; bytes from 0x80 on belong to letters beyond ASCII.
NON_LETTER = np.ones(256, bool)
NON_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base % (1 << 64), U64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Mixed values of the first places of a word; later places are mixed when they come.
PLACES = 64
_MIXED = mix64(np.arange(1, 256 * PLACES + 1, dtype=U64) * U64(BYTE_R))


def word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words that stand one after another in ``letters``."""
    ends = np.cumsum(sizes)
    places = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
    code = places * 256 + letters
    late = code >= len(_MIXED)
    value = _MIXED[np.where(late, 0, code)]
    if late.any():
        value[late] = mix64((code[late].astype(U64) + U64(1)) * U64(BYTE_R))
    sums = np.zeros(len(letters) + 1, U64)
    np.cumsum(value, out=sums[1:])
    return mix64(sums[ends] - sums[ends - sizes] + sizes.astype(U64) * U64(RUN_R2))


class Words(NamedTuple):
    """``starts`` and ``ends`` in the bytes, ``ids`` the hashes; text i has the words bounds[i] ... bounds[i + 1] - 1."""

    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


class Bytes:
    """Hashes any slices of the bytes by running sums, for features that may collide: a polynomial."""

    def __init__(self, data: np.ndarray):
        self.data = data

    @cached_property
    def sums(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * powers(BYTE_R, len(self.data)), out=sums[1:])
        return sums

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = powers(pow(BYTE_R, -1, 1 << 64), len(self.data) + 1)
        raw = (self.sums[ends] - self.sums[starts]) * back[starts]
        return mix64(raw + (ends - starts).astype(U64) * U64(RUN_R2))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = BLANK) -> tuple[Words, Bytes]:
    """The words of all texts; ``offsets`` cuts ``data`` into texts, and no word reaches over a cut."""
    if lower:
        data = LOWER[data]
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(starts, ends, word_hashes(data[inside], ends - starts), np.searchsorted(starts, offsets)), Bytes(data)


def runs(w: Words, k: int, base: int = RUN_R) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all runs of ``k`` words within a text; a place is the index of the first word."""
    n = len(w.ids)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    last = np.repeat(w.bounds[1:], w.counts)  # end of the text, for each word
    places = np.flatnonzero(np.arange(n) + k <= last)
    sums = np.zeros(n + 1, U64)
    np.cumsum(w.ids * powers(base, n), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return places, mix64((sums[places + k] - sums[places]) * back[places] + U64(k))


def text_of_word(w: Words, places: np.ndarray) -> np.ndarray:
    """Index of the text in which each place lies."""
    return np.searchsorted(w.bounds, places, side="right") - 1


def pieces(batch: pa.RecordBatch, column: str, piece: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows with about ``piece`` bytes of text, at least one row each, with the texts' bytes and
    offsets. Null texts are empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as a column of bytes."""
    size = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds.astype(np.int64) * size)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def signed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return hashes.astype(U64).view(np.int64)
