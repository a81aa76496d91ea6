"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, lower-cased. Latin-1 signs
(U+0080-U+00BF), general punctuation (U+2000-U+206F) and ideographic space and stops (U+3000-U+3002) separate words.
Lower-casing maps one character to one, so positions in the lower-cased text are positions in the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Cache(dict):
    """A dictionary that travels empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full((n // (1 << 18) + 1 << 18) + 1, base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the len + 1 bounds of each within them. Null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8, bounds[-1] - bounds[0], bounds[0]), bounds - bounds[0]


_process = _Cache()


def trim() -> None:
    """Give memory that is no longer used back to the system."""
    if "libc" not in _process:
        try:
            _process["libc"] = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _process["libc"] = lambda _: None
    pa.default_memory_pool().release_unused()
    _process["libc"](0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, one row at least; a text is never cut.

    After the last one, what the ranges took goes back to the system: many workers, also idle ones, share an executor's memory.
    """
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
    trim()


@dataclass
class Words:
    """Words of some texts. offsets[i]:offsets[i+1] are those of text i; starts and ends are places in data."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        value = (self.sums[ends] - self.sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts]
        return mix(value + (ends - starts).astype(np.uint64))

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.spans(self.starts, self.ends)
        return self._hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def char_place(self, places: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Character positions within their texts of byte places."""
        if not hasattr(self, "_chars"):
            self._chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return self._chars[places] - self._chars[self.bounds[texts]]


def _separators(data: np.ndarray) -> np.ndarray:
    word = _IS_WORD[data]
    for lead, second, size in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        at = at[at + size <= len(data)]
        if second:
            at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
        if lead == 0xE2:
            at = at[(data[at + 1] == 0x80) | (data[at + 2] <= 0xAF)]
        if lead == 0xE3:
            at = at[data[at + 2] <= 0x82]
        for k in range(size):
            word[at + k] = False
    return word


_IS_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True
_IS_WORD[0x80:] = True


def split(texts: pa.Array, lower: bool = True) -> Words:
    if lower:
        texts = pc.utf8_lower(texts)
    data, bounds = raw(texts)
    n = len(data)
    word = _separators(data)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), dtype=np.uint64, out=sums[1:])
    return Words(data, bounds, starts, stops, np.searchsorted(starts, bounds), sums)


def hash_each(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each byte string."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(values) + 1, values.offset * 4).astype(np.int64) if len(values) else np.zeros(1, np.int64)
    n = int(bounds[-1] - bounds[0])
    if not n:
        return np.zeros(len(values), np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8, n, bounds[0]).astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), dtype=np.uint64, out=sums[1:])
    bounds = bounds - bounds[0]
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) * _power(_INVERSE, n + 1)[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def word_hash(word: str) -> int:
    """The hash that split() gives the word."""
    return int(split(pa.array([word])).hashes[0])
