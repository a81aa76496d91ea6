"""Line deduplication with two Bloom filters, of line hashes seen once and seen twice.

Every task fills the two filters over its documents; they are merged block by block, a bit that two tasks saw once
becoming twice-seen. Only lines that the twice-seen filter suspects are shuffled, by their SHA-256, which stands for
the text, to confirm the repeat and to choose the first occurrence: least doc_id (null first), then row, then line. All
other occurrences are removed. A filter that is too full only suspects more lines; the result is the same at any size.

The filter has `bits` bits a line, up to `max_bits`, which bounds what is broadcast (256 MB by default). Beyond that
many lines, more of them are suspected, at worst all: then 32 bytes and three numbers of each line move.

Defined cases: a line is what newlines separate, compared without spaces, tabs and carriage returns at its ends;
blank lines are never repeats. A null text stays null, an empty one empty; a text of which every line goes becomes
empty. Rows equal in doc_id and text are one document, and each of them gets its text. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import batches, fresh, release, row_key, written

HASHES, BLOCK_BYTES, BROADCAST_BYTES = 4, 1 << 13, 1 << 26


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line that is not blank: text, number in it, first and last + 1 byte without blanks at the ends, hash."""
    data, bounds = words.raw(texts)
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    text = np.searchsorted(np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, bounds)) + 1)]), np.arange(len(starts)), "right") - 1
    first = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, bounds)) + 1)])[:-1]
    number = np.arange(len(starts)) - first[text]
    all_breaks = np.append(breaks, n)
    ends = np.minimum(all_breaks[np.minimum(np.searchsorted(breaks, starts), len(breaks))], bounds[text + 1])
    blank = np.zeros(256, bool)
    blank[[32, 9, 13]] = True
    starts = starts.copy()
    while len(at := np.flatnonzero((starts < ends) & blank[data[np.minimum(starts, max(n - 1, 0))]] if n else [])):
        starts[at] += 1
    while len(at := np.flatnonzero((starts < ends) & blank[data[ends - 1]] if n else [])):
        ends[at] -= 1
    have = starts < ends
    text, number, starts, ends = text[have], number[have], starts[have], ends[have]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * words._power(words._BASE, n), dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * words._power(words._INVERSE, n + 1)[starts]
    return text, number, starts, ends, words.mix(value + (ends - starts).astype(np.uint64))


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES bit places of each hash, by double hashing; size is a power of two."""
    step = words.mix(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(size - 1) for k in range(HASHES)], 1).astype(np.int64)


def _within(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(1)


def _add(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places.ravel() >> 3, (np.uint8(1) << (places.ravel() & 7).astype(np.uint8)))


def _fill(size: int):
    """One row for each block that the task's lines touched: the once-seen and twice-seen bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for batch in batches:
            texts = batch.column("text")
            for a, b in words.chunks(texts):
                hashes, counts = np.unique(_lines(texts.slice(a, b - a))[4], return_counts=True)
                places = _places(hashes, size)
                _add(twice, places[(counts > 1) | _within(once, places)])
                _add(once, places)
        used = np.flatnonzero(once.reshape(-1, BLOCK_BYTES).any(1))
        for k in range(0, len(used), 256):
            some = used[k : k + 256]
            yield pa.record_batch({"block": pa.array(some.astype(np.int32)), "once": pa.array([once[i * BLOCK_BYTES : (i + 1) * BLOCK_BYTES].tobytes() for i in some], pa.binary()), "twice": pa.array([twice[i * BLOCK_BYTES : (i + 1) * BLOCK_BYTES].tobytes() for i in some], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive in order: a bit is twice-seen if a task saw it twice or two tasks saw it once."""
    block, once, twice = None, None, None
    done: list[tuple[int, bytes]] = []
    for batch in batches:
        for b, o, t in zip(batch["block"].to_pylist(), batch["once"].to_pylist(), batch["twice"].to_pylist()):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            if b != block:
                if block is not None:
                    done.append((block, twice.tobytes()))
                block, once, twice = b, o, t
            else:
                twice = twice | t | (once & o)
                once = once | o
    if block is not None:
        done.append((block, twice.tobytes()))
    yield pa.record_batch({"block": pa.array([b for b, _ in done], pa.int32()), "twice": pa.array([t for _, t in done], pa.binary())})


def _suspects(shared):
    """The lines that the twice-seen filter suspects, each by the SHA-256 of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in words.chunks(texts):
                part = texts.slice(a, b - a)
                text, number, starts, ends, hashes = _lines(part)
                at = np.flatnonzero(_within(twice, _places(hashes, len(twice) * 8)))
                raw = memoryview(words.raw(part)[0])
                digests = b"".join(hashlib.sha256(raw[s:e]).digest() for s, e in zip(starts[at].tolist(), ends[at].tolist()))
                rows = pa.array(a + text[at])
                yield pa.record_batch({"uid": batch.column("uid").take(rows), "doc_id": batch.column("doc_id").take(rows), "line_no": pa.array(number[at].astype(np.int32)), "line": pa.Array.from_buffers(pa.binary(32), len(at), [None, pa.py_buffer(digests)]).cast(pa.binary())})

    return run


def _suspected(shared, place: str):
    """One more column: whether any line of the text is suspected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            for a, b in words.chunks(batch.column(place)):
                part = batch.slice(a, b - a)
                text, _, _, _, hashes = _lines(part.column(place))
                own = np.zeros(b - a, bool)
                own[text[_within(twice, _places(hashes, len(twice) * 8))]] = True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], [str(k) for k in range(len(part.columns) + 1)])

    return run


def repeated_lines(docs: DataFrame, bits: int = 16, max_bits: int = 1 << 31) -> tuple[DataFrame, Broadcast]:
    """(uid, line_nos): the lines of each document that occur before; and the twice-seen filter."""
    spark = docs.sparkSession
    batches(spark)
    own = docs.select(row_key().alias("uid"), "doc_id", "text")
    lines = docs.select(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first().n or 0
    size = 1 << 20
    while size < min(max_bits, bits * lines):
        size *= 2
    parts = own.select("text").mapInArrow(_fill(size), "block int, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, twice binary")
    twice = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():
        twice[row.block * BLOCK_BYTES : (row.block + 1) * BLOCK_BYTES] = np.frombuffer(row.twice, np.uint8)
    shared = spark.sparkContext.broadcast(twice)
    suspects = own.mapInArrow(_suspects(shared), f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, line_no int, line binary")
    suspects = written(suspects, "suspects")
    first = suspects.groupBy("line").agg(F.min(F.struct("doc_id", "uid", "line_no")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = suspects.join(first, "line").filter((F.col("uid") != F.col("first.uid")) | (F.col("line_no") != F.col("first.line_no")))
    found = written(later.groupBy("uid").agg(F.collect_set("line_no").alias("line_nos")), "repeated")
    release(suspects)
    return found, shared


def _removed(docs: DataFrame, gone: str, broadcast_bytes: int, **how) -> DataFrame:
    """docs and a column of the numbers of the lines to remove, null where there are none.

    While the list of these is no larger than broadcast_bytes it is broadcast and no text moves. Beyond, the texts that
    have a suspected line move once, to join it.
    """
    drop, shared = repeated_lines(docs, **how)
    key, name, mark = fresh(docs.withColumn(gone, F.lit(0)), "tw_key", "tw_uid", "tw_suspected")
    size = drop.agg(F.count("*") * 48 + F.coalesce(F.sum(F.size("line_nos")), F.lit(0)) * 8).first()[0]
    drop = drop.select(F.col("uid").alias(name), F.col("line_nos").alias(gone))
    columns = [*(F.col(f"`{c}`") for c in docs.columns), F.col(gone)]
    if size <= broadcast_bytes:
        return docs.withColumn(key, row_key()).join(F.broadcast(drop), F.col(key) == F.col(name), "left").select(*columns)
    plain = docs.toDF(*[str(k) for k in range(len(docs.columns))])
    schema = T.StructType([T.StructField(str(k), f.dataType) for k, f in enumerate([*docs.schema, T.StructField(mark, T.BooleanType())])])
    marked = plain.mapInArrow(_suspected(shared, str(docs.columns.index("text"))), schema).toDF(*docs.columns, mark)
    moved = marked.filter(mark).withColumn(key, row_key()).join(drop, F.col(key) == F.col(name), "left").select(*columns)
    return marked.filter(~F.col(mark)).withColumn(gone, F.lit(None).cast("array<int>")).select(*columns).union(moved)


def _kept(gone: str):
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def deduplicate_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **how) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every document, after removing the lines that occur before."""
    out = _removed(docs.select("doc_id", "text"), "tw_gone", broadcast_bytes, **how)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", _kept("tw_gone").alias("text"), lines.cast("long").alias("n_lines"), F.coalesce(F.size("tw_gone"), F.lit(0)).cast("long").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **how) -> DataFrame:
    """docs with the repeats removed from text; a document that is left without any but had some is dropped.

    n_chars, where it is a column, is set for changed texts.
    """
    (gone,) = fresh(docs, "tw_gone")
    out = _removed(docs, gone, broadcast_bytes, **how)
    text, kind = _kept(gone), docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    out = out.withColumn("text", text)
    if kind is not None:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.filter(F.col(gone).isNull() | F.col("text").rlike("\\S")).drop(gone)


ORACLE = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, n, line, trim(line, ' ' || chr(9) || chr(13)) AS key FROM split
), ranked AS (
  SELECT doc_id, n, line, key = '' OR row_number() OVER (PARTITION BY key ORDER BY doc_id, n) = 1 AS stays FROM lines
), back AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY n) FILTER (stays) AS text, count(*) AS n_lines,
         count(*) FILTER (NOT stays) AS n_removed
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(b.text, '') END AS text,
       coalesce(b.n_lines, 0)::BIGINT AS n_lines, coalesce(b.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN back b ON b.doc_id = d.doc_id
"""
