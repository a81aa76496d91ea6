"""Perplexity under a class-based bigram model with Brown classes.

All documents and all words are counted. The `head` most frequent words are assigned to `classes` classes by exchange
clustering, which moves one word at a time to the class that raises the likelihood of the corpus most, until few move
or `sweeps` are over; meanwhile all rarer words are one class more, the ends of documents another. Then each rarer word
joins, by one such step against the class pairs of the head, the class that its own neighbours make likeliest (rarer
neighbours stand as the one class there). A word's probability is that of its class after the class before it, counted
over the final classes of all words with `alpha` added to each count, times its share of its class.

`vocabulary`, if given, bounds the model: so many most frequent words are exchanged, all others remain one class, of
which every different word, and one never seen, has an equal share.

What reaches the driver is bounded by the head, not by the corpus: counts of pairs of its numbers, and of pairs of
classes. The rarer words stay distributed: texts become rows of word numbers by chunk, the neighbours of a rare word
shuffle to it once for each chunk that has it, and its class and count shuffle back.

Defined cases: null and wordless texts have no words, the log probability of their end, and null perplexity; texts of
any length are scored whole; repeated rows count as often as they occur. An empty table gives no rows. Ties in
frequency are settled by hash, ties between classes by number. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import batches, written


#: Texts of so many bytes share the rows of their rare words.
UNIT_BYTES = 1 << 24


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, count: np.ndarray, n_words: int, classes: int, sweeps: int) -> np.ndarray:
    """Classes of the words 0 .. n_words - 1 and, beyond `classes`, one for each further symbol, from counts of pairs."""
    n = int(max(left.max(initial=-1), right.max(initial=-1), n_words + 1)) + 1
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(n - n_words)])
    total = classes + n - n_words
    follows, precedes = _by(left, right, count, n), _by(right, left, count, n)
    pairs = np.zeros((total, total))
    np.add.at(pairs, (of[left], of[right]), count)
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            k = of[w]
            a, b = follows[0][follows[2][w] : follows[2][w + 1]], follows[1][follows[2][w] : follows[2][w + 1]]
            c, d = precedes[0][precedes[2][w] : precedes[2][w + 1]], precedes[1][precedes[2][w] : precedes[2][w + 1]]
            self_ = b[a == w].sum()
            row = np.bincount(of[a], b, total)
            column = np.bincount(of[c], d, total)
            row[k] -= self_
            column[k] -= self_
            pairs[k] -= row
            pairs[:, k] -= column
            pairs[k, k] -= self_
            gain = _gain(pairs, row, column, self_, classes)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = int(k)
            pairs[best] += row
            pairs[:, best] += column
            pairs[best, best] += self_
            of[w] = best
            moved += best != k
        if moved <= n_words // 100:
            break
    return of


def _by(key: np.ndarray, other: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return other[order], count[order].astype(float), np.searchsorted(key[order], np.arange(n + 1))


def _gain(pairs: np.ndarray, row: np.ndarray, column: np.ndarray, self_: float, classes: int) -> np.ndarray:
    """What the likelihood gains if a word with these counts by class joins each of the classes."""
    own = np.arange(classes)
    r, c = np.flatnonzero(row), np.flatnonzero(column)
    x, y = pairs[:classes][:, r], pairs[c][:, :classes]
    gain = (_xlogx(x + row[r]) - _xlogx(x)).sum(1) + (_xlogx(y + column[c][:, None]) - _xlogx(y)).sum(0)
    diagonal = pairs[own, own]
    gain -= _xlogx(diagonal + row[:classes]) - _xlogx(diagonal) + _xlogx(diagonal + column[:classes]) - _xlogx(diagonal)
    gain += _xlogx(diagonal + row[:classes] + column[:classes] + self_) - _xlogx(diagonal)
    # The totals of each class with what its words have before and after this one, wherever that goes.
    out, into = pairs[:classes].sum(1) + column[:classes], pairs[:, :classes].sum(0) + row[:classes]
    n_out, n_into = row.sum() + self_, column.sum() + self_
    return gain - (_xlogx(out + n_out) - _xlogx(out)) - (_xlogx(into + n_into) - _xlogx(into))


def _gains(pairs: np.ndarray, row: np.ndarray, column: np.ndarray, classes: int) -> np.ndarray:
    """_gain of many words that pairs lacks, a row of row, column and the result for each; every word has both neighbours."""
    gain = np.zeros((len(row), classes))
    for n, to in ((row, pairs[:classes].T), (column, pairs[:, :classes])):
        word, c = np.nonzero(n)
        known, at = np.unique(np.stack([c, n[word, c]]), axis=1, return_inverse=True)
        x = to[known[0].astype(int)]
        gain += np.add.reduceat((_xlogx(x + known[1][:, None]) - _xlogx(x))[at.ravel()], np.searchsorted(word, np.arange(len(n))))
    r, c, d = row[:, :classes], column[:, :classes], pairs[np.arange(classes), np.arange(classes)]
    both = np.nonzero((r > 0) & (c > 0))
    r_, c_, d_ = r[both], c[both], d[both[1]]
    gain[both] += _xlogx(d_ + r_ + c_) - _xlogx(d_ + r_) - _xlogx(d_ + c_) + _xlogx(d_)
    out, into = pairs[:classes].sum(1) + c, pairs[:, :classes].sum(0) + r
    return gain - (_xlogx(out + row.sum(1, keepdims=True)) - _xlogx(out)) - (_xlogx(into + column.sum(1, keepdims=True)) - _xlogx(into))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in words.chunks(batch.column(0)):
            known, n = np.unique(words.split(batch.column(0).slice(a, b - a)).hashes, return_counts=True)
            yield pa.record_batch({"word": pa.array(known.view(np.int64)), "n": pa.array(n)})


def _stream(w: words.Words, known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, each text preceded by the end sign and the last followed by one; and where they begin."""
    rare, end = len(known), len(known) + 1
    number = np.full(len(w.hashes), rare)
    if len(known):
        at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
        number = np.where(known[at] == w.hashes, ids[at], rare)
    return np.append(np.insert(number, w.offsets[:-1], end), end), w.offsets[:-1] + np.arange(len(w.counts))


def _pair_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        base = len(known) + 2
        for batch in batches:
            for a, b in words.chunks(batch.column(0)):
                s, _ = _stream(words.split(batch.column(0).slice(a, b - a)), known, ids)
                pair, n = np.unique(s[:-1] * base + s[1:], return_counts=True)
                yield pa.record_batch({"pair": pa.array(pair), "n": pa.array(n)})

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's pairs and counts as two byte strings."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        yield pa.record_batch({"pair": pa.array([np.concatenate([p for p, _ in parts]).tobytes()], pa.binary()), "n": pa.array([np.concatenate([n for _, n in parts]).tobytes()], pa.binary())})


def _head(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], float)


def _exchanged(pairs: DataFrame, n_words: int, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the numbers, and counts of pairs of classes, from parts of the counts of pairs of numbers."""
    whole = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    blobs = [(np.frombuffer(r.pair, np.int64), np.frombuffer(r.n, np.int64)) for r in whole.mapInArrow(_joined, "pair binary, n binary").toLocalIterator()]
    pair = np.concatenate([p for p, _ in blobs]) if blobs else np.zeros(0, np.int64)
    count = np.concatenate([n for _, n in blobs]) if blobs else np.zeros(0, np.int64)
    at = np.argsort(pair)
    left, right, count = pair[at] // (n_words + 2), pair[at] % (n_words + 2), count[at]
    of = exchange(left, right, count, n_words, min(classes, max(1, n_words)), sweeps)
    n_classes = int(of.max()) + 1
    moves = np.zeros((n_classes, n_classes))
    np.add.at(moves, (of[left], of[right]), count)
    return of, moves


def _smoothed(moves: np.ndarray, alpha: float) -> np.ndarray:
    return np.log(moves + alpha) - np.log(moves.sum(1, keepdims=True) + alpha * len(moves))


def model(docs: DataFrame, vocabulary: int = 4096, classes: int = 64, sweeps: int = 8, alpha: float = 0.1) -> dict:
    """The model of a corpus bounded to a vocabulary: known hashes and their numbers, classes, log transitions between classes, log shares of words."""
    spark = docs.sparkSession
    text = docs.select("text")
    counts = written(text.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    kinds = counts.count()
    hashes, n = _head(counts, vocabulary)
    n_words = len(hashes)
    ids = np.argsort(hashes)
    known = hashes[ids]
    of, moves = _exchanged(text.mapInArrow(_pair_counts(spark.sparkContext.broadcast((known, ids))), "pair long, n long"), n_words, classes, sweeps)
    size = np.bincount(of[:n_words], n, len(moves))
    share = np.concatenate([np.log(n / size[of[:n_words]]) if n_words else n, [-np.log(kinds - n_words + 1)], [0.0]])
    return {"known": known, "ids": ids, "of": of, "moves": _smoothed(moves, alpha), "share": share}


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in words.chunks(batch.column("text")):
                w = words.split(batch.column("text").slice(a, b - a))
                s, starts = _stream(w, m["known"], m["ids"])
                c = m["of"][s]
                each = m["moves"][c[:-1], c[1:]] + m["share"][s[1:]]
                log = np.add.reduceat(each, starts)
                yield _rows(batch.column("doc_id").slice(a, b - a), w.counts, log)

    return run


def _encoded(shared):
    """Rows of whole chunks: ids and places of the texts, the stream of numbers, those from head + 2 on standing for the chunk's rare words, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        rare, end = len(known), len(known) + 1
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for x, y in words.chunks(batch.column("text"), UNIT_BYTES):
                texts = batch.column("text").slice(x, y - x)
                streams, places, hashes, at = [], [], [], 0
                for a, b in words.chunks(texts):
                    w = words.split(texts.slice(a, b - a))
                    s, starts = _stream(w, known, ids)
                    hashes.append(w.hashes[s[s != end] == rare])
                    streams.append(s[:-1].astype(np.int32))
                    places.append(starts + at)
                    at += len(s) - 1
                s = np.append(np.concatenate(streams), np.int32(end))
                tail, local = np.unique(np.concatenate(hashes), return_inverse=True)
                s[s == rare] = local + end + 1
                each = pa.ListArray.from_arrays(pa.array([0, y - x], pa.int32()), batch.column("doc_id").slice(x, y - x))
                blobs = [pa.array([k.tobytes()], pa.binary()) for k in (np.concatenate(places).astype(np.int64), s, tail)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), each, *blobs], ["chunk", "ids", "starts", "stream", "tail"])
                chunk += 1

    return run


def _stream_pairs(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("stream"):
                s = np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
                s[s > n_words + 1] = n_words
                pair, n = np.unique(s[:-1] * (n_words + 2) + s[1:], return_counts=True)
                yield pa.record_batch({"pair": pa.array(pair), "n": pa.array(n)})

    return run


def _around(shared):
    """For each chunk and rare word of it the classes before and after its tokens, as pairs of numbers of the least type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        first, kind = len(of), np.min_scalar_type(int(of.max()))
        for batch in batches:
            for chunk, x, t in zip(batch.column("chunk").to_pylist(), batch.column("stream"), batch.column("tail")):
                s, tail = np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(t.as_buffer(), np.int64)
                if not len(tail):
                    continue
                c = of[np.where(s < first, s, first - 2)].astype(kind)
                at = np.flatnonzero(s >= first)
                local = s[at] - first
                at = at[np.argsort(local, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(tail)))]) * 2 * c.itemsize
                around = np.stack([c[at - 1], c[at + 1]], 1).tobytes()
                near = pa.Array.from_buffers(pa.binary(), len(tail), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(around)])
                yield pa.record_batch({"word": pa.array(tail), "chunk": pa.array(np.full(len(tail), chunk, np.int64)), "local": pa.array(np.arange(len(tail), dtype=np.int32)), "around": near})

    return run


def _chosen(shared):
    """Class and count of each rare word, for every chunk that has it; rows come in the order of words."""

    def placed(table: pa.Table, pairs: np.ndarray, classes: int) -> pa.RecordBatch:
        word = table.column("word").to_numpy()
        of = np.cumsum(np.append(False, word[1:] != word[:-1]))
        near = table.column("around").combine_chunks().cast(pa.large_binary())
        _, bounds, data = near.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(near) + 1, near.offset * 8)
        kind = np.min_scalar_type(len(pairs) - 1)
        sides = np.frombuffer(data, kind, (bounds[-1] - bounds[0]) // kind.itemsize, bounds[0]).astype(np.int64)
        token = np.repeat(of, np.diff(bounds) // (2 * kind.itemsize)) * len(pairs)
        shape = int(of[-1]) + 1, len(pairs)
        column, row = (np.bincount(token + sides[k::2], minlength=shape[0] * shape[1]).reshape(shape).astype(float) for k in (0, 1))
        best = np.argmax(_gains(pairs, row, column, classes), 1)
        return pa.record_batch({"chunk": table.column("chunk").combine_chunks(), "local": table.column("local").combine_chunks(), "class": pa.array(best[of].astype(np.int32)), "n": pa.array(row.sum(1)[of].astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, classes = shared.value
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            word = batch.column(0).to_numpy()
            last = int(np.searchsorted(word, word[-1]))
            if held and held[-1].column(0)[-1].as_py() == word[0] and last == 0:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch.slice(0, last)])
            if len(table):
                yield placed(table, pairs, classes)
            held = [batch.slice(last)]
        if held:
            yield placed(pa.Table.from_batches(held), pairs, classes)

    return run


def _classed(shared):
    """A chunk's stream of classes, and of each of its texts the sum of the logarithms of its words' counts."""

    def run(texts: pa.Table, rare: pa.Table) -> pa.Table:
        of, log = shared.value
        if not len(texts):
            return texts.select(["ids", "starts", "stream"]).append_column("own", pa.array([], pa.binary()))
        local = rare.column("local").to_numpy()
        of, log = np.append(of, np.zeros(len(local), of.dtype)), np.append(log, np.zeros(len(local)))
        of[len(of) - len(local) + local] = rare.column("class").to_numpy()
        log[len(log) - len(local) + local] = np.log(rare.column("n").to_numpy())
        s = np.frombuffer(texts.column("stream")[0].as_buffer(), np.int32)
        starts = np.frombuffer(texts.column("starts")[0].as_buffer(), np.int64)
        own = np.add.reduceat(log[s[1:]], starts)
        return pa.table({"ids": texts.column("ids"), "starts": texts.column("starts"), "stream": pa.array([of[s].astype(np.uint16).tobytes()], pa.binary()), "own": pa.array([own.tobytes()], pa.binary())})

    return run


def _class_pairs(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total * total, np.int64)
        for batch in batches:
            for x in batch.column("stream"):
                c = np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64)
                n += np.bincount(c[:-1] * total + c[1:], minlength=total * total)
        pair = np.flatnonzero(n)
        yield pa.record_batch({"pair": pa.array(pair), "n": pa.array(n[pair])})

    return run


def _rows(ids: pa.Array, n_words: np.ndarray, log: np.ndarray) -> pa.RecordBatch:
    with np.errstate(over="ignore"):
        return pa.record_batch({"doc_id": ids, "n_words": pa.array(n_words.astype(np.int64)), "log_prob": pa.array(log), "perplexity": pa.array(np.exp(-log / (n_words + 1)), mask=n_words == 0)})


def _summed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = shared.value
        for batch in batches:
            for k in range(len(batch)):
                c = np.frombuffer(batch.column("stream")[k].as_buffer(), np.uint16)
                starts = np.frombuffer(batch.column("starts")[k].as_buffer(), np.int64)
                own = np.frombuffer(batch.column("own")[k].as_buffer(), np.float64)
                yield _rows(batch.column("ids")[k].values, np.diff(np.append(starts, len(c) - 1)) - 1, np.add.reduceat(each[c[:-1], c[1:]], starts) + own)

    return run


def classed(docs: DataFrame, classes: int = 64, sweeps: int = 8, head: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """Every word's class: rows by chunk (ids, starts, stream of classes, own log counts), and the counts of pairs of classes; the last class is the ends'."""
    share = docs.sparkSession.sparkContext.broadcast
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = docs.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    hashes, n = _head(counts, head)
    n_words = len(hashes)
    ids = np.argsort(hashes)
    streams = written(docs.select("doc_id", "text").mapInArrow(_encoded(share((hashes[ids], ids))), f"chunk long, ids array<{kind}>, starts binary, stream binary, tail binary"), "streams")
    of, pairs = _exchanged(streams.select("stream").mapInArrow(_stream_pairs(n_words), "pair long, n long"), n_words, classes, sweeps)
    classes = min(classes, max(1, n_words))
    near = streams.select("chunk", "stream", "tail").mapInArrow(_around(share(of)), "word long, chunk long, local int, around binary")
    rare = near.repartition("word").sortWithinPartitions("word").mapInArrow(_chosen(share((pairs, classes))), "chunk long, local int, class int, n long")
    final = np.append(of[:n_words], [classes, classes])
    log = np.append(np.log(n), [0.0, 0.0])
    texts = streams.select("chunk", "ids", "starts", "stream").groupBy("chunk")
    out = written(texts.cogroup(rare.groupBy("chunk")).applyInArrow(_classed(share((final, log))), f"ids array<{kind}>, starts binary, stream binary, own binary"), "classes")
    moves = np.zeros((classes + 1) ** 2)
    for r in out.select("stream").mapInArrow(_class_pairs(classes + 1), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        moves[r.pair] = r.n
    return out, moves.reshape(classes + 1, classes + 1)


def perplexity(docs: DataFrame, vocabulary: int | None = None, classes: int = 64, sweeps: int = 8, alpha: float = 0.1, head: int = 4096) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document under the model of all of them, of every word unless vocabulary bounds them."""
    batches(docs.sparkSession, 4000, "16m")  # a chunk is no larger than a batch, and rare words move once for each chunk
    share = docs.sparkSession.sparkContext.broadcast
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, log_prob double, perplexity double"
    if vocabulary is not None:
        return docs.select("doc_id", "text").mapInArrow(_scored(share(model(docs, vocabulary, classes, sweeps, alpha))), out)
    rows, moves = classed(docs, classes, sweeps, head)
    size = np.append(moves.sum(0)[:-1], 1.0)
    return rows.mapInArrow(_summed(share(_smoothed(moves, alpha) - np.log(np.maximum(size, 1.0)))), out)
