"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts become byte-level BPE ids, each document closed by the end token. A document longer than a row is cut into full
rows and a rest; nothing is dropped or truncated. Within a buffer of about `buffer_tokens` ids of a partition, segments
go, longest first, to the row whose remaining capacity is the least that suffices; a segment tree over capacities
finds it. Nothing is shuffled, memory is bounded by the buffer, and a lost task repeats exactly.

A packed row has its ids, padded with the end token; cu_seqlens, the cumulative segment lengths from 0; position_ids,
which restart at every segment (and at the padding); and of every segment the doc_id, a key of its document's row, and
the part number, from which unpack() restores the documents, also those of equal doc_id. Keys and which segments share
a row hang on how the table is partitioned; the segments and their ids don't.

Defined cases: a null text has no segment; an empty one has the end token alone; a null doc_id stays null. Repeated
rows are packed as often as they occur. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, words
from .bpe import VOCABULARY, gather, read_ranks


class Capacities:
    """A segment tree over the capacities 0..limit of open rows; a node tells whether any row below it is open."""

    def __init__(self, limit: int) -> None:
        self.size = 1 << limit.bit_length()
        self.open = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.size
        while at and not self.open[at]:
            self.open[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The capacity and number of an open row of the least capacity that suffices."""
        at, tree = least + self.size, self.open
        while not tree[at]:
            while at & 1:
                at >>= 1
                if not at:
                    return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.size:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            while at and not (at < self.size and (tree[2 * at] or tree[2 * at + 1])):
                tree[at] = 0
                at >>= 1
        return capacity, row


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The row of each segment; segments are placed longest first, of equal ones the earlier first."""
    tree, rows = Capacities(length), np.empty(len(sizes), np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size) if size < length else None
        if found:
            capacity, rows[i] = found
        else:
            capacity, rows[i] = length, used
            used += 1
        if capacity > size:
            tree.put(capacity - size, int(rows[i]))
    return rows


class Tokens:
    """Ids of texts; each different piece is encoded once, while at most `kept` are remembered."""

    def __init__(self, vocabulary: str, kept: int = 400_000) -> None:
        import tiktoken

        ranks = read_ranks(vocabulary)
        self.coder = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kept, self.known = kept, {}
        self.values, self.used, self.bounds = np.empty(1 << 20, np.int32), 0, [0]

    def _add(self, new: list[bytes]) -> None:
        coded = [self.coder.encode_ordinary(x.decode()) for x in new]
        sizes = [len(c) for c in coded]
        flat = np.fromiter((i for c in coded for i in c), np.int32, sum(sizes))
        while self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.empty(len(self.values), np.int32)])
        self.values[self.used : self.used + len(flat)] = flat
        at = self.used
        for piece, size in zip(new, sizes):
            self.known[piece] = len(self.bounds) - 1
            at += size
            self.bounds.append(at)
        self.used += len(flat)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and their len + 1 offsets."""
        if len(self.known) > self.kept:
            self.known, self.used, self.bounds = {}, 0, [0]
        p = pieces.split(texts)
        own, which, _ = p.distinct()
        own = own.to_pylist()
        self._add([x for x in own if x not in self.known])
        at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        bounds = np.array(self.bounds)
        sizes = np.diff(bounds)[at] if len(at) else np.zeros(0, np.int64)
        size = sizes[which]
        flat = gather(self.values, bounds[at][which], size) if len(which) else np.zeros(0, np.int32)
        return flat, np.concatenate([[0], np.cumsum(size)])[p.offsets]


def _rows(ids: np.ndarray, sizes: np.ndarray, docs: pa.Array, length: int, end: int, first: int, key: int) -> Iterator[pa.RecordBatch]:
    """Packs documents given by their ids, one after the other, and sizes; their keys count from key."""
    cuts = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), cuts)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    size = np.minimum(sizes[doc] - part * length, length)
    start = (np.cumsum(sizes) - sizes)[doc] + part * length
    row = best_fit(size, length)
    order = np.lexsort((np.arange(len(row)), row))
    row, doc, part, size, start = row[order], doc[order], part[order], size[order], start[order]
    edges = np.searchsorted(row, np.arange(row[-1] + 2))
    for a in range(0, len(edges) - 1, 256):
        b = min(a + 256, len(edges) - 1)
        x, y = edges[a], edges[b]
        own, n = size[x:y], b - a
        before = np.cumsum(own) - own
        within = before - np.repeat(before[edges[a:b] - x], np.diff(edges[a : b + 1]))
        ends = within + own
        matrix, places = np.full((n, length), end, np.int32), np.empty((n, length), np.int32)
        total = ends[edges[a + 1 : b + 1] - x - 1]
        places[:] = np.arange(length) - total[:, None]
        line, column = np.repeat(row[x:y] - a, own), gather(np.arange(length), within, own)
        matrix[line, column] = gather(ids, start[x:y], own)
        places[line, column] = gather(np.arange(length), np.zeros(y - x, np.int64), own)
        lengths = np.insert(ends, edges[a:b] - x, 0).astype(np.int32)
        offsets = pa.array((edges[a : b + 1] - x).astype(np.int32))
        wide = pa.array(np.arange(0, n * length + 1, length, dtype=np.int32))
        yield pa.record_batch(
            {
                "row_id": pa.array(first + np.arange(a, b)),
                "ids": pa.ListArray.from_arrays(wide, pa.array(matrix.ravel())),
                "cu_seqlens": pa.ListArray.from_arrays(pa.array((edges[a : b + 1] - x + np.arange(n + 1)).astype(np.int32)), pa.array(lengths)),
                "position_ids": pa.ListArray.from_arrays(wide, pa.array(places.ravel())),
                "doc_ids": pa.ListArray.from_arrays(offsets, docs.take(pa.array(doc[x:y]))),
                "doc_keys": pa.ListArray.from_arrays(offsets, pa.array(key + doc[x:y])),
                "parts": pa.ListArray.from_arrays(offsets, pa.array(part[x:y].astype(np.int32))),
            }
        )


def _packer(vocabulary: str, length: int, buffer_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        base, used, read = TaskContext.get().partitionId() << 36, 0, 0
        ids, sizes, docs, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used, held, read
            for out in _rows(np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(docs), length, tokens.end, base + used, base + read):
                used += out.num_rows
                yield out
            read += sum(map(len, docs))
            ids.clear(), sizes.clear(), docs.clear()
            held = 0

        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())
            for a, b in words.chunks(batch.column("text")):
                flat, bounds = tokens.of(batch.column("text").slice(a, b - a))
                ids.append(np.insert(flat, bounds[1:], tokens.end))
                sizes.append(np.diff(bounds) + 1)
                docs.append(batch.column("doc_id").slice(a, b - a))
                held += len(ids[-1])
                if held >= buffer_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, buffer_tokens: int = 1 << 23) -> DataFrame:
    """(row_id, ids, cu_seqlens, position_ids, doc_ids, doc_keys, parts) of every packed row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row_id long, ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<{kind}>, doc_keys array<long>, parts array<int>"
    return docs.select("doc_id", "text").mapInArrow(_packer(vocabulary, length, buffer_tokens), schema)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document, without its end token; rows of equal or null doc_id are told apart by their keys."""
    parts = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_keys", "parts")).alias("at", "s"))
    size = F.get("cu_seqlens", F.col("at") + 1) - F.get("cu_seqlens", F.col("at"))
    parts = parts.select("s.doc_ids", "s.doc_keys", F.col("s.parts").alias("part"), F.slice("ids", F.get("cu_seqlens", F.col("at")) + 1, size).alias("ids"))
    whole = parts.groupBy("doc_keys").agg(F.first("doc_ids").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("all"))
    return whole.select("doc_id", F.flatten("all.ids").alias("ids")).select("doc_id", F.slice("ids", F.lit(1), F.size("ids") - 1).alias("ids"))


def as_binary(packed: DataFrame, wide: bool = False) -> DataFrame:
    """(row_id, ids) with ids as little-endian integers of 2 bytes, or 4 if wide, for token files; an id that doesn't fit is an error."""
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(kind).max):
                raise ValueError("ids that 2 bytes can't hold: ask for wide")
            flat = flat.astype(kind).tobytes()
            ends = (np.asarray(lists.offsets) - lists.offsets[0].as_py()) * np.dtype(kind).itemsize
            yield pa.record_batch({"row_id": batch.column("row_id"), "ids": pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    return packed.select("row_id", "ids").mapInArrow(run, "row_id long, ids binary")
