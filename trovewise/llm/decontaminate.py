"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item. Each document's words are streamed through it, which gives, at
every word, the longest run ending there that some item contains. A run is contaminated if it has at least
`max_words` words, or at least `least_words` words and `coverage` of an item that contains it. Contaminated runs are
cut out, from the first character of their first word to the last of their last. Words that cannot belong to a run
of `least_words` words, because a pair of neighbours occurs in no item, are passed over without streaming.

The items go to the executors as a broadcast of bounded size: beyond `automaton_words` words they are split by item
into several automata, whose runs are united. No item is cut, so the result is the same.

Defined cases: a null text stays null, an empty one empty; null, empty and repeated items add nothing; an item of
fewer than `least_words` words is never matched; no items, no change. Repeated rows are treated alike. Every other
column of the documents passes through, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import batches, fresh

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


class Automaton:
    """A generalised suffix automaton over integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.shortest = [-1], [0], [1 << 60]

    def _state(self, length: int, link: int, follow: dict[int, int], shortest: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.shortest.append(shortest)
        return len(self.next) - 1

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
        new = self._state(self.length[last] + 1, 0, {}, 1 << 60)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return new

    def _clone(self, p: int, q: int, symbol: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 1 << 60)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def build(self, items: list[list[int]], least: int, coverage: float) -> Automaton:
        """Adds the items; then full[s] is the longest suffix of state s's runs that covers enough of an item."""
        for item in items:
            last = 0
            for symbol in item:
                last = self._extend(last, symbol)
        for item in items:
            at = 0
            for symbol in item:
                at = self.next[at][symbol]
                self.shortest[at] = min(self.shortest[at], len(item))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            self.shortest[self.link[s]] = min(self.shortest[self.link[s]], self.shortest[s])
        self.full = [0] * len(self.next)
        for s in order:
            n = self.length[s]
            self.full[s] = n if n >= least and n >= coverage * self.shortest[s] else self.full[self.link[s]]
        return self

    def runs(self, symbols: list[int], limit: int, least: int, coverage: float) -> list[tuple[int, int]]:
        """The contaminated runs of the symbols, united, as [first, last + 1)."""
        state = length = 0
        out: list[tuple[int, int]] = []
        for i, x in enumerate(symbols):
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(x, 0)
            length = length + 1 if state else 0
            if length < least:
                continue
            size = length if length >= limit or length >= coverage * self.shortest[state] else self.full[self.link[state]]
            if size:
                first = i + 1 - size
                while out and out[-1][1] >= first:
                    first = min(first, out.pop()[0])
                out.append((first, i + 1))
        return out


def _items(benchmark: DataFrame, text: str, least: int, limit: int) -> Iterator[list[list[int]]]:
    """The distinct items' word hashes, in parts of about limit words."""
    part, size = [], 0
    for row in benchmark.select(F.col(text).alias("text")).filter("text is not null").distinct().toLocalIterator():
        own = words.split(pa.array([row.text])).hashes.tolist()
        if len(own) < least:
            continue
        if part and size + len(own) > limit:
            yield part
            part, size = [], 0
        part.append(own)
        size += len(own)
    if part:
        yield part


def _model(items: list[list[int]], least: int, coverage: float) -> dict:
    """The automaton and the hashes of its pairs of neighbours; symbols are numbered for dense dictionaries."""
    h = np.array([x for i in items for x in i], np.uint64)
    last = np.cumsum([len(i) for i in items]) - 1
    pairs = np.unique(np.delete(words.mix(h[:-1] * _PAIR + h[1:]), last[:-1]))
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[pairs >> np.uint64(64 - _FILTER_BITS)] = True
    return {"automaton": Automaton().build(items, least, coverage), "pairs": pairs, "seen": np.packbits(seen)}


def _scanner(shared: list, text: str, limit: int, least: int, coverage: float, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [x.value for x in shared]
        tables = [np.unpackbits(m["seen"]).view(bool) for m in models]
        for batch in batches:
            for a, b in words.chunks(batch.column(text)):
                part = batch.slice(a, b - a)
                w = words.split(part.column(text))
                h, of = w.hashes, w.text_of_word()
                found: dict[int, list[tuple[int, int]]] = {}
                pair = words.mix(h[:-1] * _PAIR + h[1:]) if len(h) > 1 else h[:0]
                for m, table in zip(models, tables):
                    at = np.flatnonzero(table[pair >> np.uint64(64 - _FILTER_BITS)])
                    at = at[of[at] == of[at + 1]]
                    at = at[m["pairs"][np.minimum(np.searchsorted(m["pairs"], pair[at]), len(m["pairs"]) - 1)] == pair[at]]
                    edge = np.flatnonzero(np.diff(at, prepend=-9) != 1)
                    # A text's last pair and the next text's first are not neighbours: a pair across texts was removed.
                    for x, y in zip(at[edge], np.append(edge[1:], len(at)) - edge):
                        if y + 1 >= least:
                            for p, q in m["automaton"].runs(h[x : x + y + 1].tolist(), limit, least, coverage):
                                found.setdefault(int(of[x]), []).append((int(x) + p, int(x) + q))
                texts = part.column(text)
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                changed: dict[int, str] = {}
                for i, runs in sorted(found.items()):
                    united: list[list[int]] = []
                    for p, q in sorted(runs):
                        if united and p <= united[-1][1]:
                            united[-1][1] = max(q, united[-1][1])
                        else:
                            united.append([p, q])
                    rows = np.full(len(united), i)
                    begins = w.char_place(w.starts[[p for p, _ in united]], rows)
                    ends = w.char_place(w.ends[[q - 1 for _, q in united]], rows)
                    spans[i] = [{"start": int(s), "end": int(e), "words": q - p} for s, e, (p, q) in zip(begins, ends, united)]
                    whole, out, done = texts[i].as_py(), [], 0
                    for s, e in zip(begins, ends):
                        out.append(whole[done:s])
                        done = e
                    changed[i] = "".join(out) + whole[done:]
                columns = list(part.columns)
                if changed and cut:
                    values = texts.to_pylist()
                    for i, value in changed.items():
                        values[i] = value
                    columns[part.schema.get_field_index(text)] = pa.array(values, texts.type)
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return run


_SPANS = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "end", "words")]))


def _scan(docs: DataFrame, benchmark: DataFrame, spans: str, text: str, item_text: str, max_words: int, coverage: float, least_words: int, automaton_words: int) -> DataFrame:
    """docs with the runs cut out, and the array of the runs in one more column."""
    sc = docs.sparkSession.sparkContext
    batches(docs.sparkSession)
    shared = [sc.broadcast(_model(part, least_words, coverage)) for part in _items(benchmark, item_text, least_words, automaton_words)]
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, _SPANS)])
    if not shared:
        return docs.withColumn(spans, F.array().cast(_SPANS))
    plain = docs.toDF(*[str(k) for k in range(len(docs.columns))])
    place = str(docs.columns.index(text))
    out = T.StructType([T.StructField(str(k), f.dataType) for k, f in enumerate(schema)])
    return plain.mapInArrow(_scanner(shared, place, max_words, least_words, coverage, True), out).toDF(*schema.names)


def contamination(docs: DataFrame, benchmark: DataFrame, max_words: int = 8, coverage: float = 0.8, least_words: int = 4, automaton_words: int = 1_000_000) -> DataFrame:
    """(doc_id, text, contaminated, words_removed, spans) of every document; spans are character offsets in the text before.

    One narrow pass over the documents: nothing is shuffled.
    """
    found = _scan(docs.select("doc_id", "text"), benchmark, "spans", "text", "text", max_words, coverage, least_words, automaton_words)
    return found.select("doc_id", "text", (F.size("spans") > 0).alias("contaminated"), F.aggregate("spans", F.lit(0), lambda n, s: n + s["words"]).alias("words_removed"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = 8, coverage: float = 0.8, least_words: int = 4, automaton_words: int = 1_000_000) -> DataFrame:
    """docs with the contaminated runs cut out of text, and n_chars, where it is a column, set for changed texts."""
    (spans,) = fresh(docs, "tw_spans")
    out = _scan(docs, benchmark, spans, "text", "text", max_words, coverage, least_words, automaton_words)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(spans)
