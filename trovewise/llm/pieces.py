"""Vectorised splitting of texts into the pieces that byte-level BPE merges within.

The pattern is the public one of 50k byte-level vocabularies: the contractions 's 't 're 've 'm 'll 'd, runs of
letters, of digits and of other signs with an optional space before them, and runs of white space, of which the last
character is left to what follows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import words

_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _DIGIT, _SIGN, _SPACE = range(4)
_kept = words._Cache()


def _classes() -> np.ndarray:
    if "classes" not in _kept:
        table = np.full(0x110000, _SIGN, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = _LETTER if kind == "L" else _DIGIT
        table[_SPACES] = _SPACE
        _kept["classes"] = table
    return _kept["classes"]


@dataclass
class Pieces:
    """Pieces of some texts: edges[k]:edges[k+1] is piece k in data; offsets[i]:offsets[i+1] are those of text i."""

    data: np.ndarray
    edges: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def cut(self, seam: np.ndarray) -> Pieces:
        """These pieces, cut further between bytes a and b where seam[a * 256 + b]."""
        if len(self.data) < 2:
            return self
        more = np.flatnonzero(seam[self.data[:-1].astype(np.int32) * 256 + self.data[1:]]) + 1
        start = np.zeros(len(self.data) + 1, bool)
        start[self.edges] = start[more] = True
        edges = np.flatnonzero(start)
        return Pieces(self.data, edges, np.searchsorted(edges, self.edges[self.offsets]))

    def distinct(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different pieces, which of them each piece is, and how often each occurs."""
        whole = pa.Array.from_buffers(pa.large_binary(), len(self.edges) - 1, [None, pa.py_buffer(self.edges.astype(np.int64)), pa.py_buffer(self.data)])
        coded = whole.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, which, np.bincount(which, minlength=len(coded.dictionary))


def split(texts: pa.Array) -> Pieces:
    """Null is the empty text, which has no pieces."""
    data, bounds = words.raw(texts)
    data = np.ascontiguousarray(data)
    if not len(data):
        return Pieces(data, np.zeros(1, np.int64), np.zeros(len(bounds), np.int64))
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    n = len(kind)
    firsts = np.searchsorted(heads, bounds[:-1][np.diff(bounds) > 0])
    first = np.zeros(n + 1, bool)
    first[firsts] = first[n] = True
    space = kind == _SPACE
    start = np.ones(n, bool)
    # A sign continues what is of its kind before it, or the blank before it.
    start[1:] = (kind[1:] != kind[:-1]) & (code[:-1] != 32)
    start[1:] |= space[1:] & ~space[:-1]
    # Of a run of spaces, the last begins a piece if a text goes on after it.
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    start[space & last] = True
    within = space.copy()
    within[0] = False
    within[1:] &= space[:-1] & ~last[1:]
    start[within] = False
    start |= first[:-1]
    quotes = np.flatnonzero((code == 39) & start)
    if len(quotes):
        ends = np.append(firsts[1:], n)[np.searchsorted(firsts, quotes, "right") - 1]
        for q, end in zip(quotes.tolist(), ends.tolist()):
            after = "".join(map(chr, code[q + 1 : min(end, q + 3)]))
            size = 1 if after[:1] in ("s", "t", "m", "d") else 2 if after in ("re", "ve", "ll") else 0
            if size:
                start[q + 1 : q + 1 + size] = False
                if q + 1 + size < end:
                    start[q + 1 + size] = True
    places = np.flatnonzero(start)
    edges = np.append(heads[places], len(data))
    return Pieces(data, edges, np.searchsorted(edges[:-1], bounds))
