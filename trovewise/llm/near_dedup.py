"""Near-duplicate groups by an exact set similarity join.

A document is the set of its word 3-grams (all its words as one gram if it has fewer than three). Two are linked if the
Jaccard similarity of their sets reaches the threshold, and groups are the connected components of all links: no link
between documents of two groups is left out, and none is made that an exact comparison has not confirmed.

1. A document that has a partner shares with others at least the threshold's part of its grams. Grams are counted by
   ranges of their hashes, 4 bytes a gram, and the documents that share too few are done.
2. Of the others, documents of equal sets are one. A prefix of each set, in any one order of all grams, holds a gram of
   the prefix of every partner. The order has the grams first that the fewest of them have, which ranges of hashes count
   again and send back, 6 bytes a gram; grams that only one has make no list.
3. The documents of a prefix gram are a list, equal lists count once. While a list of more than `leaf` documents has
   several groups, each is compared with one other, the centre of its block of about `block` groups of the list, and
   those that are confirmed merge. So a group of near copies takes a multiple of its size, not its square.
4. All pairs of documents of different groups that remain in any list are compared, a few of any two groups first.

A pair is compared by marks of its grams first, which show that most pairs can't reach the threshold. A similarity is a
quotient of doubles, so that of 55 grams of 100 reaches 0.55; bounds are lower by SLACK than their products with it.

Defined cases: identical rows count once; a null or wordless text is a group of its own; documents with equal sets are
one group without comparing; a null doc_id is an id like any other and comes last in its group; of equal doc_ids with
different texts each is a document. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import batches, fresh, release, row_key, rows, written

GRAM, BITS, SLACK = 3, 2048, 1 - 1e-12


def grams(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word 3-grams, with repeats, and their offsets by text."""
    h, n = w.hashes, w.counts
    sizes = np.where(n >= GRAM, n - GRAM + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - w.offsets[:-1], sizes)
    out = h[places]
    size = np.repeat(np.minimum(n, GRAM), sizes)
    for k in range(1, GRAM):
        more = size > k
        out[more] = words.mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[places[more] + k])
    return out, offsets


def gram_sets(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different 3-grams in order of their hashes, and their offsets by text."""
    all_, offsets = grams(w)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((all_, text))
    all_, text = all_[order], text[order]
    own = np.ones(len(all_), bool)
    own[1:] = (all_[1:] != all_[:-1]) | (text[1:] != text[:-1])
    return all_[own], np.searchsorted(text[own], np.arange(len(offsets)))


def _parcel(ranges: int, chunk: int, about: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A row for each range of hashes, with the low halves of its grams and how many each document has, and one for about."""
    part = ((sets >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(ranges + 1))
    low, text = sets[order].astype(np.uint32), text[order]
    some = np.flatnonzero(np.diff(edges))
    counts = [np.bincount(text[edges[k] : edges[k + 1]], minlength=len(sizes)).astype(np.uint32).tobytes() for k in some]
    return pa.record_batch(
        {
            "part": pa.array(np.append(some, chunk % ranges).astype(np.int32)),
            "chunk": pa.array(np.full(len(some) + 1, chunk)),
            "counts": pa.array([*counts, None], pa.binary()),
            "grams": pa.array([*(low[edges[k] : edges[k + 1]].tobytes() for k in some), about.tobytes()], pa.binary()),
        }
    )


def _parcels(ranges: int):
    """Of each chunk of texts the low halves of its grams' hashes by range of the high ones, and once what is to be known of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            uids = batch.column("uid").to_numpy()
            for a, b in words.chunks(texts):
                sets, offsets = gram_sets(words.split(texts.slice(a, b - a)))
                sizes = np.diff(offsets)
                have = np.flatnonzero(sizes)
                if not len(have):
                    continue
                chunk += 1
                whole = words.mix(np.add.reduceat(words.mix(sets), offsets[:-1][have]) + sizes[have].astype(np.uint64))
                about = np.stack([uids[a:b][have], whole.view(np.int64), sizes[have]])
                yield _parcel(ranges, chunk, about, sets, sizes[have])

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 10_000) -> Iterator[pa.Table]:
    """Tables of all rows of some keys; rows arrive in order of the key, though batches may cut them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(x.num_rows for x in rest) < rows or (rest[0].column(key)[0] == batch.column(key)[-1]):
            continue
        table = pa.Table.from_batches(rest)
        keys = table[key].to_numpy()
        cut = len(keys) - int((keys == keys[-1]).sum())
        yield table.slice(0, cut)
        rest = table.slice(cut).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each parcel, how many grams of each document occur in another one; a range of hashes is in memory at a time."""
    for table in _runs(batches, "part", 1):
        about = table.filter(table["counts"].is_null())
        if about.num_rows:
            yield from about.select(["chunk", "grams"]).append_column("about", pa.array(np.ones(about.num_rows, bool))).to_batches()
        table = table.filter(table["counts"].is_valid())
        part = table["part"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
        for x, y in zip(edges[:-1], edges[1:]):
            own = table.slice(x, y - x)
            counts = [np.frombuffer(c, np.uint32) for c in own["counts"].to_pylist()]
            grams_ = np.concatenate([np.frombuffer(g, np.uint32) for g in own["grams"].to_pylist()])
            slot = np.repeat(np.arange(sum(map(len, counts))), np.concatenate(counts))
            order = np.argsort(grams_)
            again = np.diff(grams_[order]) == 0
            twice = np.append(again, False) | np.append(False, again)
            many = np.bincount(slot[order[twice]], minlength=sum(map(len, counts))).astype(np.uint32)
            ends = np.cumsum([len(c) for c in counts])
            yield pa.record_batch({"chunk": own["chunk"].combine_chunks(), "grams": pa.array([many[e - len(c) : e].tobytes() for e, c in zip(ends, counts)], pa.binary()), "about": pa.array(np.zeros(len(counts), bool))})
        words.trim()


def _suspects(threshold: float):
    """(uid, whole, suspect) of each document with words: a hash of its set, and whether it shares enough to have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "chunk"):
            about, total = {}, {}
            for chunk, data, is_about in zip(*(table[k].to_pylist() for k in ("chunk", "grams", "about"))):
                if is_about:
                    about[chunk] = np.frombuffer(data, np.int64).reshape(3, -1)
                else:
                    total[chunk] = total.get(chunk, 0) + np.frombuffer(data, np.uint32).astype(np.int64)
            for chunk, (uid, whole, size) in about.items():
                yield pa.record_batch({"uid": pa.array(uid), "whole": pa.array(whole), "suspect": pa.array(total[chunk] >= threshold * size * SLACK)})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in words.chunks(texts):
            own, offsets = gram_sets(words.split(texts.slice(a, b - a)))
            marks = np.zeros((b - a, BITS), bool)
            marks[np.repeat(np.arange(b - a), np.diff(offsets)), (own % np.uint64(BITS)).astype(np.int64)] = True
            yield pa.record_batch(
                {
                    "uid": batch.column("uid").slice(a, b - a),
                    "grams": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(own.view(np.int64))),
                    "marks": pa.array([m.tobytes() for m in np.packbits(marks, 1)], pa.binary()),
                }
            )


def _possible(threshold: float):
    """The pairs that may reach the threshold: a mark that only one set has is a gram that only it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BITS // 8) for k in ("x", "y"))
            m, n = (batch.column(k).to_numpy().astype(np.int64) for k in ("m", "n"))
            most = np.minimum(m - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(most >= threshold * (m + n - most) * SLACK))

    return run


def _set_parcels(ranges: int):
    """As _parcels, of sets of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("grams")
            sizes = np.diff(np.asarray(lists.offsets))
            chunk += 1
            yield _parcel(ranges, chunk, np.stack([batch.column("uid").to_numpy(), sizes]), lists.flatten().to_numpy().view(np.uint64), sizes)
            words.trim()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each parcel with how often each of its grams occurs in all; a range of hashes is in memory at a time."""
    for table in _runs(batches, "part", 1):
        about = table.filter(table["counts"].is_null())
        if about.num_rows:
            yield from about.append_column("often", pa.nulls(about.num_rows, pa.binary())).to_batches()
        table = table.filter(table["counts"].is_valid())
        part = table["part"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
        for x, y in zip(edges[:-1], edges[1:]):
            own = table.slice(x, y - x)
            each = [np.frombuffer(g, np.uint32) for g in own["grams"].to_pylist()]
            grams_ = np.concatenate(each)
            order = np.argsort(grams_)
            sorted_ = grams_[order]
            sizes = np.diff(np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_)))
            often = np.empty(len(grams_), np.uint16)
            often[order] = np.repeat(np.minimum(sizes, 65_535), sizes)
            ends = np.cumsum([len(g) for g in each])
            yield from own.append_column("often", pa.array([often[e - len(g) : e].tobytes() for e, g in zip(ends, each)], pa.binary())).combine_chunks().to_batches()
        words.trim()


def _prefixes(threshold: float):
    """(gram, uid) of as many grams of each set, the rarest first, as must hold one that any partner has there too.

    A gram is its range and the low half of its hash. If two agree in that, they count and are listed as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "chunk", 1):
            chunks: dict[int, list] = {}
            for row in zip(*(table[k].to_pylist() for k in ("chunk", "part", "counts", "grams", "often"))):
                chunks.setdefault(row[0], []).append(row[1:])
            for rows in chunks.values():
                uids, sizes = np.frombuffer(next(r[2] for r in rows if r[1] is None), np.int64).reshape(2, -1)
                rows = [r for r in rows if r[1] is not None]
                text = np.concatenate([np.repeat(np.arange(len(sizes)), np.frombuffer(r[1], np.uint32)) for r in rows])
                gram = np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.int64) | r[0] << 32 for r in rows])
                often = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])
                order = np.lexsort((gram, often, text))
                first = np.repeat(np.cumsum(sizes) - sizes, sizes)
                held = np.repeat(sizes - np.ceil(threshold * sizes * SLACK).astype(np.int64) + 1, sizes)
                keep = order[np.arange(len(order)) - first < held]
                keep = keep[often[keep] > 1]
                for x in range(0, len(keep), 200_000):
                    some = keep[x : x + 200_000]
                    yield pa.record_batch({"gram": pa.array(gram[some]), "uid": pa.array(uids[text[some]])})
            words.trim()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each gram that has several; rows arrive in order of gram and uid."""
    for table in _runs(batches, "gram"):
        gram, uid = table["gram"].to_numpy(), table["uid"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
        many = np.diff(edges) > 1
        if many.any():
            kept = np.repeat(many, np.diff(edges))
            ends = np.concatenate([[0], np.cumsum(np.diff(edges)[many])]).astype(np.int32)
            yield pa.record_batch({"uids": pa.ListArray.from_arrays(pa.array(ends), pa.array(uid[kept]))})


def _beside(sets: DataFrame, pairs: DataFrame, broadcast_rows: int, *columns: Column) -> DataFrame:
    """Pairs of a written table with columns of both sets: x, m of a and y, n of b.

    While there are at most broadcast_rows pairs they are broadcast, so that only sets of b move to those of a.
    """
    few = rows(pairs) <= broadcast_rows
    pairs, by_a = pairs.select("a", "b"), pairs.select("a").distinct()
    if few:
        pairs, by_a = F.broadcast(pairs), F.broadcast(by_a)
    right = sets.select(F.col("uid").alias("b"), *(c.alias(k) for c, k in zip(columns, "yn"))).join(pairs, "b")
    return right.join(sets.select(F.col("uid").alias("a"), *(c.alias(k) for c, k in zip(columns, "xm"))).join(by_a, "a", "left_semi"), "a")


def _likely(sets: DataFrame, pairs: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """Those of the pairs that may reach the threshold by their marks; no others can."""
    marks = _beside(sets, pairs, broadcast_rows, F.col("marks"), F.size("grams")).select("a", "b", "x", "y", "m", "n")
    return written(marks.mapInArrow(_possible(threshold), "a long, b long"), "likely")


def _exact(sets: DataFrame, pairs: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """Those of the pairs whose gram sets reach the threshold."""
    common = F.size(F.array_intersect("x", "y"))
    reach = common / (F.size("x") + F.size("y") - common) >= threshold
    return written(_beside(sets, pairs, broadcast_rows, F.col("grams")).filter(reach).select("a", "b"), "contracted")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As components(), of all edges in one task: roots hook on to the least root beside them, then every path is cut short."""
    each = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not each:
        return
    ids, place = np.unique(np.concatenate([k for pair in zip(*each) for k in pair]), return_inverse=True)
    x, y = np.split(place, 2)
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        least = np.minimum(p, q)
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        while ((after := root[root]) != root).any():
            root = after
    for k in range(0, len(ids), 200_000):
        yield pa.record_batch({"uid": pa.array(ids[k : k + 200_000]), "root": pa.array(ids[root[k : k + 200_000]])})
    words.trim()


def components(edges: DataFrame, together: bool = False) -> DataFrame:
    """(uid, root): the least vertex of each vertex's component, by minimum labels with pointer jumping.

    together: one task has all edges in memory, and the driver one execution, not two in every round, whose plans it keeps.
    Otherwise every round is a written table, so lineage doesn't grow; rounds are logarithmic in the longest shortest path.
    """
    if together:
        return written(edges.select("a", "b").coalesce(1).mapInArrow(_roots, "uid long, root long"), "label")
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("uid"), F.least("a", "m").alias("root"))
    label = written(label, "label")
    while True:
        reach = both.join(label.select(F.col("uid").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = label.join(reach.withColumnRenamed("a", "uid"), "uid").select("uid", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = lower.select(F.col("uid").alias("root"), F.col("root").alias("next"))
        after = written(lower.join(jump, "root").select("uid", "was", F.least("root", "next").alias("root")), "label")
        release(label)
        if after.filter("root <> was").isEmpty():
            release(both)
            return after.select("uid", "root")
        label = after


def _rooted(entries: DataFrame, known: DataFrame | None) -> DataFrame:
    """(list, uid, root) of the lists that have documents of several groups."""
    if known is None:
        return entries.withColumn("root", F.col("uid"))
    rooted = entries.join(known, "uid", "left").select("list", "uid", F.coalesce("root", "uid").alias("root"))
    several = rooted.groupBy("list").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select("list")
    return rooted.join(several, "list")


def near_duplicates(docs: DataFrame, threshold: float = 0.5, leaf: int = 2, block: int = 400, broadcast_rows: int = 1_000_000, together: int = 1_000_000) -> DataFrame:
    """(doc_id, uid, group_id, group_size, links, keep) for each distinct (doc_id, text): group_id is the least doc_id of
    its group, whose first row alone is kept; links counts the comparisons that confirmed it in its group, not all pairs.

    The shuffles move 4 bytes a gram, and of documents that share enough grams with others 10 bytes a gram, 16 bytes a gram
    of the prefix that others have too, and the sets of pairs to compare. Texts never move. Components of up to `together`
    links are found in one task, of more by rounds of joins, with the same result.
    """
    spark = docs.sparkSession
    own = docs.select(row_key().alias("uid"), "doc_id", "text")
    batches(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parcels = own.select("uid", "text").mapInArrow(_parcels(ranges), "part int, chunk long, counts binary, grams binary")
    shared = parcels.repartitionById(ranges, F.col("part")).sortWithinPartitions("part").mapInArrow(_shared, "chunk long, grams binary, about boolean")
    shared = shared.repartition(ranges, "chunk").sortWithinPartitions("chunk")
    every = written(shared.mapInArrow(_suspects(threshold), "uid long, whole long, suspect boolean"), "documents")
    first = written(every.groupBy("whole").agg(F.min("uid").alias("rep"), F.max("suspect").alias("suspect"), F.count("*").alias("n"), F.count_distinct("uid").alias("different")), "first")
    same = every.select("uid", "whole").join(first, "whole").filter("uid <> rep").select(F.col("rep").alias("a"), F.col("uid").alias("b")).distinct()
    edges = written(same, "edges")
    n_edges = rows(edges)
    known = components(edges, n_edges <= together) if n_edges else None
    suspects = first.filter("suspect").select(F.col("rep").alias("uid"))
    if suspects.count() <= broadcast_rows:
        suspects = F.broadcast(suspects)
    sets = own.select("uid", "text").join(suspects, "uid", "left_semi").mapInArrow(_sets, "uid long, grams array<long>, marks binary")
    if not first.filter("n > different").isEmpty():
        sets = sets.dropDuplicates(["uid"])
    sets = written(sets, "sets")
    parcels = sets.select("uid", "grams").mapInArrow(_set_parcels(ranges), "part int, chunk long, counts binary, grams binary")
    counted = parcels.repartitionById(ranges, F.col("part")).sortWithinPartitions("part").mapInArrow(_counted, "part int, chunk long, counts binary, grams binary, often binary")
    prefixes = counted.repartition(ranges, "chunk").sortWithinPartitions("chunk").mapInArrow(_prefixes(threshold), "gram long, uid long")
    lists = prefixes.repartition(ranges, "gram").sortWithinPartitions("gram", "uid").mapInArrow(_lists, "uids array<long>").distinct()
    entries = written(lists.withColumn("list", F.monotonically_increasing_id()).select("list", F.explode("uids").alias("uid")), "entries")
    tried, rounds = None, 0
    while True:
        rounds += 1
        groups = _rooted(entries, known).groupBy("list", "root").agg(F.min("uid").alias("uid"))
        sizes = groups.groupBy("list").count().filter(F.col("count") > (leaf if rounds == 1 else 1))
        number = F.pmod(F.xxhash64("root", F.lit(rounds)), F.ceil(F.col("count") / block))
        groups = written(groups.join(sizes, "list").select("list", number.alias("block"), "root", "uid"), "groups")
        centres = groups.groupBy("list", "block").agg(F.min(F.struct("root", "uid")).alias("centre"))
        star = groups.join(centres, ["list", "block"]).filter("root <> centre.root").groupBy("root", F.col("centre.root").alias("other")).agg(F.count("*").alias("n"), F.min(F.struct(F.col("centre.uid").alias("p"), F.col("uid").alias("q"))).alias("pair"))
        star = star.select("root", "n", "other", F.least("pair.p", "pair.q").alias("a"), F.greatest("pair.p", "pair.q").alias("b"))
        if tried is not None:
            star = star.join(tried, ["a", "b"], "left_anti")
        pairs = written(star.groupBy("root").agg(F.max_by(F.struct("a", "b"), F.struct("n", "other")).alias("pair")).select("pair.a", "pair.b").distinct(), "proposed")
        release(groups)
        n = rows(pairs)
        if not n:
            break
        more = _exact(sets, _likely(sets, pairs, threshold, broadcast_rows), threshold, broadcast_rows)
        tried = pairs if tried is None else tried.union(pairs)
        confirmed = rows(more)
        if confirmed:
            edges, n_edges = edges.union(more), n_edges + confirmed
            known = components(edges, n_edges <= together)
        if confirmed * 10 < n:
            break
    rooted = _rooted(entries, known).groupBy("list", "root").agg(F.collect_list("uid").alias("uids"))
    left, right = rooted.select("list", F.col("root").alias("p"), F.col("uids").alias("x")), rooted.select("list", F.col("root").alias("q"), F.col("uids").alias("y"))
    cross = left.join(right, "list").filter("p < q").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if tried is not None:
        cross = cross.join(tried, ["a", "b"], "left_anti")
    cross = written(cross, "cross")
    rest = _likely(sets, cross, threshold, broadcast_rows)
    for last in (False, True):
        if known is not None:
            for k in ("a", "b"):
                rest = rest.join(known.select(F.col("uid").alias(k), F.col("root").alias(f"{k}_root")), k, "left")
            roots = [F.coalesce(f"{k}_root", k) for k in ("a", "b")]
            rest = rest.select("a", "b", F.least(*roots).alias("p"), F.greatest(*roots).alias("q")).filter("p <> q")
        else:
            rest = rest.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"))
        rest = written(rest, "compared")
        some = rest
        if not last:
            # Up to two pairs of any two groups come first, which mostly settle the others.
            some = written(rest.groupBy("p", "q", F.pmod(F.xxhash64("a", "b"), F.lit(2))).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b"), "some")
        if not rows(some):
            break
        more = _exact(sets, some, threshold, broadcast_rows)
        if rows(more):
            edges, n_edges = edges.union(more), n_edges + rows(more)
            known = components(edges, n_edges <= together)
        rest = rest.select("a", "b").join(some, ["a", "b"], "left_anti")
    if known is None:
        known = edges.select(F.col("a").alias("uid"), F.col("b").alias("root"))
    links = edges.distinct().select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("links"))
    every = own.select("uid", "doc_id").dropDuplicates(["uid"]).join(known.join(links, "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    groups = every.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    return every.join(groups, "root").select("doc_id", "uid", F.col("first.d").alias("group_id"), "group_size", F.coalesce("links", F.lit(0)).alias("links"), (F.col("uid") == F.col("first.u")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; identical rows count once. All columns stay.

    The keys of the rows to drop, and of those that are repeated, are broadcast while there are at most broadcast_rows;
    then only repeated rows move. Beyond that, rows move once to be joined with them.
    """
    key, name, gone = fresh(docs, "tw_key", "tw_drop", "tw_gone")
    dropped = near_duplicates(docs, broadcast_rows=broadcast_rows, **how).filter(~F.col("keep")).select("uid", F.lit(True).alias("gone"))
    repeated = docs.select(row_key().alias("uid")).groupBy("uid").count().filter("count > 1").select("uid", F.lit(False).alias("gone"))
    marks = written(dropped.union(repeated).groupBy(F.col("uid").alias(name)).agg(F.max("gone").alias(gone)), "marks")
    if rows(marks) <= broadcast_rows:
        marks = F.broadcast(marks)
    marked = docs.withColumn(key, row_key()).join(marks, F.col(key) == F.col(name), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.filter(F.col(gone).isNull()).select(*columns)
    return once.union(marked.filter(~F.col(gone)).dropDuplicates([key]).select(*columns))
