"""A batch of queries answered document by document.

The postings of the queries' terms are brought together by document (or by ranges of documents), which moves each posting
once, however many queries name its term. A worker then meets whole documents, some hits at a time, and keeps for
every query only what its answer needs: sums of a million hits, the best of its partition, or counts. So neither what is
moved nor what is held grows with the number of queries times that of documents.

The queries themselves are collected and sent to every worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Hits that a worker holds at once, if a document has no more.
HITS = 1 << 20
EPSILON = 1e-9


@dataclass
class Asked:
    """The batch by entries (query, term), in the order of terms: a term's entries begin at starts, and are degree many."""

    starts: np.ndarray
    degree: np.ndarray
    q: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    columns: dict[str, np.ndarray]

    def by_query(self, name: str) -> np.ndarray:
        """A column that is the same for all entries of a query."""
        out = np.zeros(len(self.sizes))
        out[self.q] = self.columns[name]
        return out


class Hits:
    """The hits (posting, entry) of some whole documents; groups are pairs of a document and a query."""

    def __init__(self, asked: Asked, table: dict[str, np.ndarray]):
        ids, no = table["doc_id"], table["no"]
        first = np.append(True, ids[1:] != ids[:-1])
        degree = asked.degree[no]
        ends = np.cumsum(degree)
        self.asked, self.table, self.docs = asked, table, ids[first]
        self.row = np.repeat(np.arange(len(ids)), degree)
        self.entry = np.arange(len(self.row)) + np.repeat(asked.starts[no] - ends + degree, degree)
        self.q, self.doc = asked.q[self.entry], (np.cumsum(first) - 1)[self.row]
        n = len(asked.sizes)
        keys = self.doc * n + self.q
        if len(self.docs) * n > 4 * len(keys):
            keys, self.group = np.unique(keys, return_inverse=True)
        else:
            keys, self.group = np.arange(len(self.docs) * n), keys
        self.group_doc, self.group_q = keys // n, keys % n

    def of(self, name: str) -> np.ndarray:
        """A column of the postings or of the queries, by hit."""
        return self.table[name][self.row] if name in self.table else self.asked.columns[name][self.entry]

    def sums(self, values: np.ndarray | None = None, only: np.ndarray | None = None) -> np.ndarray:
        """By group the sum of values, or the number of hits."""
        group = self.group if only is None else self.group[only]
        return np.bincount(group, values if values is None or only is None else values[only], len(self.group_q))

    def scores(self, kept: np.ndarray | None = None) -> np.ndarray:
        """By group the weighted score, of the groups kept only: what others have isn't summed."""
        only = None if kept is None else kept[self.group]
        return self.sums(self.of("score") * self.of("weight"), only)

    def covered(self, width: int) -> np.ndarray:
        """By hit, whether every term of its query occurs in its range of documents; the ranges must be whole."""
        _, own = np.unique(np.floor_divide(self.docs, width), return_inverse=True)
        n, m = len(self.asked.q), len(self.asked.sizes)
        keys = np.unique(own[self.doc] * n + self.entry)
        found = np.bincount(keys // n * m + self.asked.q[keys % n], minlength=(own.max() + 1) * m)
        place = own[self.doc] * m + self.q
        return found[place] == self.asked.sizes[self.q]

    def live(self, width: int) -> np.ndarray:
        """By hit, whether the maxima of its range of documents reach its query's threshold; the ranges must be whole."""
        ranges, own = np.unique(np.floor_divide(self.docs, width), return_inverse=True)
        n = len(self.asked.q)
        keys, at = np.unique(own[self.doc] * n + self.entry, return_inverse=True)
        most = np.zeros(len(keys))
        np.maximum.at(most, at, self.of("score"))
        place = keys // n * len(self.asked.sizes) + self.asked.q[keys % n]
        bound = np.bincount(place, most * self.asked.columns["weight"][keys % n], len(ranges) * len(self.asked.sizes))
        reached = bound >= np.tile(self.asked.by_query("theta"), len(ranges)) - EPSILON
        return reached[own[self.doc] * len(self.asked.sizes) + self.q]


def _whole(batches: Iterable[pa.RecordBatch], asked: Asked) -> Iterator[Hits]:
    """The hits of whole units, about HITS of them at a time; rows come by unit."""
    held: list[dict[str, np.ndarray]] = []
    waiting = 0

    def cut(last: bool) -> tuple[list[tuple[int, int]], Callable]:
        table = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        unit = table["unit"]
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        before = np.append(0, np.cumsum(asked.degree[table["no"]]))
        bounds, stop = [0], len(unit) if last else starts[-1]
        for s in [*starts[1:], len(unit)]:
            if s <= stop and (s == stop or before[s] - before[bounds[-1]] >= HITS):
                bounds.append(s)
        return [x for x in zip(bounds, bounds[1:]) if x[0] < x[1]], lambda a, b: {c: v[a:b] for c, v in table.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        waiting += int(asked.degree[held[-1]["no"]].sum())
        if waiting >= HITS:
            spans, part = cut(False)
            for a, b in spans:
                yield Hits(asked, part(a, b))
            held = [part(spans[-1][1] if spans else 0, None)]
            waiting = int(asked.degree[held[0]["no"]].sum())
    if held:
        spans, part = cut(True)
        for a, b in spans:
            yield Hits(asked, part(a, b))


def answer(queries: DataFrame, postings: DataFrame, job: Callable[[Asked, Iterator[Hits]], Iterator[dict]], kinds: dict, columns: tuple[str, ...] = ("weight",), values: tuple[str, ...] = ("score",), unit: Column | None = None) -> DataFrame:
    """(qid, *kinds) of what job finds in each partition; columns are of queries, values of postings, unit keeps documents together."""
    spark = postings.sparkSession
    rows = queries.select("qid", "term", *columns).collect()
    names, terms = {}, {}
    for r in rows:
        names.setdefault(r["qid"], len(names))
    for t in sorted({r["term"] for r in rows if r["term"] is not None}):
        terms[t] = len(terms)
    sizes, places = np.zeros(len(names), int), []
    for r in rows:
        places.append(sizes[names[r["qid"]]])
        sizes[names[r["qid"]]] += 1
    entries = sorted((terms[r["term"]], names[r["qid"]], i) for i, r in enumerate(rows) if r["term"] is not None)
    no, q, at = np.array([e[0] for e in entries], int), np.array([e[1] for e in entries], int), np.array([places[e[2]] for e in entries], int)
    degree = np.bincount(no, minlength=len(terms))
    asked = Asked(np.cumsum(degree) - degree, degree, q, at, sizes, {c: np.array([rows[e[2]][c] for e in entries], float) for c in columns})
    numbered = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, no int"))
    own = postings.select("term", "doc_id", *values).join(numbered, "term").select((F.col("doc_id") if unit is None else unit).alias("unit"), "doc_id", "no", *values)
    kind = postings.schema["doc_id"].dataType
    schema = StructType([StructField("q", IntegerType()), *[StructField(c, kind if k is None else k) for c, k in kinds.items()]])
    to = pa.schema([("q", pa.int32()), *[(c, _ARROW[k.typeName()]) for c, k in kinds.items() if k is not None]])

    def run(batches):
        for found in job(asked, _whole(batches, asked)):
            if len(found["q"]):
                arrays = [pa.array(found[c], to.field(c).type if c in to.names else None) for c in schema.names]
                for b in pa.Table.from_arrays(arrays, names=schema.names).to_batches(max_chunksize=100_000):
                    yield b

    found = own.repartition("unit").sortWithinPartitions("unit", "doc_id", "no").mapInArrow(run, schema)
    qid = spark.createDataFrame([(i, x) for x, i in names.items()], StructType([StructField("q", IntegerType()), StructField("qid", queries.schema["qid"].dataType)]))
    return found.join(F.broadcast(qid), "q").select("qid", *kinds)


_ARROW = {"double": pa.float64(), "long": pa.int64(), "integer": pa.int32()}


def best(k: int, keep: Callable[[Hits], np.ndarray | None] = lambda h: None):
    """job: the k best scores above 0 of each query, of the groups that keep lets pass."""

    def job(asked: Asked, blocks: Iterator[Hits]) -> Iterator[dict]:
        least = np.zeros(len(asked.sizes))
        held: list[tuple] = []
        n, room = 0, 4 * k * len(asked.sizes) + HITS // 4

        def shrink() -> list[tuple]:
            q, doc, score = (np.concatenate([h[i] for h in held]) for i in range(3))
            rounded = np.round(score, 9)
            by_doc = np.argsort(doc, kind="stable")
            order = by_doc[np.lexsort((-rounded[by_doc], q[by_doc]))]
            own = q[order]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
            full = order[rank == k - 1]
            least[q[full]] = rounded[full]
            order = order[rank < k]
            return [(q[order], doc[order], score[order])]

        for h in blocks:
            kept = keep(h)
            score = h.scores(kept)
            good = np.flatnonzero((score > 0) & (np.round(score, 9) >= least[h.group_q]) & (True if kept is None else kept))
            held.append((h.group_q[good], h.docs[h.group_doc[good]], score[good]))
            n += len(good)
            if n > room:
                held = shrink()
                n = len(held[0][0])
        if n:
            q, doc, score = shrink()[0]
            yield {"q": q, "doc_id": doc, "score": score}

    return job


def all_terms(h: Hits) -> np.ndarray:
    """By group, whether the document has every term of the query."""
    return h.sums() == h.asked.sizes[h.group_q]


def every(scored: bool):
    """job: the documents with all terms, with their scores if asked."""

    def job(asked, blocks):
        for h in blocks:
            kept = all_terms(h)
            found = {"q": h.group_q[kept], "doc_id": h.docs[h.group_doc[kept]]}
            yield found | ({"score": h.scores(kept)[kept]} if scored else {})

    return job


def totals(count: Callable[[Hits], dict[str, np.ndarray]], names: tuple[str, ...]):
    """job: sums by query of what count gives by query for each block."""

    def job(asked, blocks):
        sums = {c: np.zeros(len(asked.sizes), np.int64) for c in names}
        for h in blocks:
            for c, x in count(h).items():
                sums[c] += x.astype(np.int64)
        yield {"q": np.arange(len(asked.sizes))} | sums

    return job


def per_query(h: Hits, groups: np.ndarray) -> np.ndarray:
    """By query the sum over groups."""
    return np.bincount(h.group_q, groups, len(h.asked.sizes))


def _grids(h: Hits, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the scores of its terms, by place in the query, in the documents that have any; absent ones are -inf."""
    order = np.argsort(h.q, kind="stable")
    starts = np.searchsorted(h.q[order], np.arange(len(h.asked.sizes) + 1))
    at = (h.asked.columns["bit"].astype(int) if "bit" in h.asked.columns else h.asked.at)[h.entry]
    for q in np.flatnonzero(np.diff(starts)):
        own = order[starts[q] : starts[q + 1]]
        _, column = np.unique(h.doc[own], return_inverse=True)
        grid = np.full((h.asked.sizes[q], column.max() + 1), -np.inf)
        grid[at[own], column] = values[own]
        yield int(q), grid


def common(pairs: bool):
    """job: by query and pair of places in it (twice the same: a single term; without pairs -1: all terms) how many documents have both, and the best sum."""

    def job(asked, blocks):
        counts: dict[int, np.ndarray] = {}
        most: dict[int, np.ndarray] = {}
        if not pairs:
            n, top = np.zeros(len(asked.sizes), np.int64), np.full(len(asked.sizes), -np.inf)
            for h in blocks:
                kept = all_terms(h)
                n += np.bincount(h.group_q[kept], minlength=len(n))
                np.maximum.at(top, h.group_q[kept], h.scores(kept)[kept])
            some = np.flatnonzero(n)
            yield {"q": some, "a": np.full(len(some), -1), "b": np.full(len(some), -1), "length": n[some], "max_score": top[some]}
            return
        for h in blocks:
            for q, grid in _grids(h, h.of("score")):
                m = len(grid)
                if q not in counts:
                    counts[q], most[q] = np.zeros((m, m), np.int64), np.full((m, m), -np.inf)
                there = np.isfinite(grid)
                for i in range(m):
                    own = np.flatnonzero(there[i])
                    if len(own):
                        rest = grid[i:, own]
                        counts[q][i, i:] += np.isfinite(rest).sum(1)
                        sums = rest + grid[i, own]
                        sums[0] = rest[0]
                        most[q][i, i:] = np.maximum(most[q][i, i:], sums.max(1))
        for q, n in counts.items():
            a, b = np.nonzero(n)
            yield {"q": np.full(len(a), q), "a": a, "b": b, "length": n[a, b], "max_score": most[q][a, b]}

    return job


def best_of_pairs(k: int):
    """job: of each pair of a query's terms (by their places) the k best sums of a document that exceed the query's theta; a document may have one of both only."""

    def job(asked, blocks):
        theta = asked.by_query("theta")
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for h in blocks:
            for q, grid in _grids(h, h.of("score") * h.of("weight")):
                absent = np.isneginf(grid)
                grid[absent] = 0.0
                most = grid.max(1)
                for i in range(len(grid)):
                    js = i + 1 + np.flatnonzero(most[i] + most[i + 1 :] > theta[q])
                    for j in js:
                        sums = grid[i] + grid[j]
                        if theta[q] < 0:
                            sums[absent[i] & absent[j]] = -np.inf
                        # Held full, a pair needs no sums below its k-th.
                        own = held.get((q, i, j))
                        sums = sums[sums > (theta[q] if own is None or len(own) < k else own[-1])]
                        if len(sums):
                            own = sums if own is None else np.append(own, sums)
                            held[q, i, j] = -np.sort(-own)[:k]
        if held:
            n = [len(x) for x in held.values()]
            q, a, b = (np.repeat([key[i] for key in held], n) for i in range(3))
            yield {"q": q, "a": a, "b": b, "score": np.concatenate(list(held.values()))}

    return job
