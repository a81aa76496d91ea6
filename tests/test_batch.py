"""Findings of round 3: what queries move and hold follows the postings, not the hits or the tables of terms and documents."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovewise.functions.text import Analyzer
from trovewise.operators import batch, reorder, search
from trovewise.operators import index as ix
from trovewise.plans import queries as plans
from trovewise.sources import indexes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def some(spark):
    """8 documents with the same two words, asked for by many queries."""
    docs = spark.createDataFrame([(i, "a b " + "c " * i) for i in range(8)], "doc_id long, text string")
    index = ix.build(docs)
    topics = spark.createDataFrame([(q, p, t, 1.0) for q in range(50) for p, t in enumerate("abc")], "qid long, pos long, term string, weight double")
    return topics, ix.scored(index).cache()


def test_inverting_moves_nothing(spark):
    forward = spark.createDataFrame([(0, ["b", "a", "b"]), (1, []), (2, None), (3, ["a"])], "doc_id long, terms array<string>")
    assert "Exchange" not in plan_of(ix.invert(forward))
    assert sorted(map(tuple, ix.invert(forward).collect())) == [("a", 0, 1, 3), ("a", 3, 1, 1), ("b", 0, 2, 3)]
    assert [tuple(r) for r in ix.counted(forward).select("doc_id", "doc_len").orderBy("doc_id").collect()] == [(0, 3), (1, 0), (2, 0), (3, 1)]


def test_counting_holds_some_documents_at_a_time(monkeypatch):
    monkeypatch.setattr(ix, "TOKENS", 3)
    texts = [["a"] * 5, [], ["b", "a"], ["c"], ["a", "c"]]
    whole = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([len(t) for t in texts]), pa.array(texts)], names=["doc_id", "doc_len", "terms"])
    parts = list(ix._count([whole.slice(1), whole.slice(0, 1)]))
    assert len(parts) == 3
    got = {r["doc_id"]: dict(zip(r["terms"], r["tfs"])) for p in parts for r in p.to_pylist()}
    assert got == {0: {"a": 5}, 1: {}, 2: {"a": 1, "b": 1}, 3: {"c": 1}, 4: {"a": 1, "c": 1}}


def test_texts_are_lowered_and_cleaned_as_tokens_are(spark):
    texts = ["The U.S.A.!? lol's x.y z's. A.b.", "İstanbul Kelvin IS K", "ÉTÉ ÜBER", "Zoë's e.g. 3.5.6", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(plans.text.ENGLISH), F.lit(0)), lambda t: F.when(F.contains(t, F.lit(".")), F.replace(t, F.lit("."), F.lit(""))).otherwise(F.split_part(t, F.lit("'"), F.lit(1))))
    want = F.transform(raw(F.col("text")), lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = df.select("doc_id", Analyzer()(F.col("text")).alias("got"), want.alias("want")).collect()
    assert all(r.got == r.want for r in rows)
    counted = {r.doc_id: (r.doc_len, dict(zip(r.terms, r.tfs))) for r in ix.counted_documents(df).collect()}
    assert counted == {r.doc_id: (len(r.want), dict(Counter(r.want))) for r in rows}
    assert {r.doc_id: r.doc_len for r in ix.counted_documents(df, Analyzer(stopwords=("zo",))).collect()}[3] == len(rows[3].want) - 1


def test_an_index_is_stored_without_checkpoints_or_bounds(spark, tmp_path, monkeypatch):
    for module in (ix, indexes):
        monkeypatch.setattr(module, "checkpointed", lambda df: pytest.fail("a copy of the postings was written"))
    spark.createDataFrame([(0, "a b a"), (1, "b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = plans.stored(spark, str(tmp_path))
    index = indexes.load(spark, path)
    assert sorted(map(tuple, index.postings.collect())) == [("a", 0, 2, 3), ("b", 0, 1, 3), ("b", 1, 1, 1)]
    assert sorted(map(tuple, index.terms.collect())) == [("a", 1, 2), ("b", 2, 2)] and index.docs.count() == 3
    assert indexes.load_bounds(spark, path) == {}


def test_comparing_like_tables_moves_digests_only(spark):
    rows = [("a", 0, 1, 1), ("a", 0, 1, 1), ("b", 1, 2, 2)]
    of = lambda rows: spark.createDataFrame(rows, "term string, doc_id long, tf long, doc_len long")
    assert indexes.differing(of(rows), of(rows[::-1])).isEmpty()
    assert sorted(map(tuple, indexes.differing(of(rows), of([*rows[1:], ("c", 1, 2, 2)])).collect())) == [rows[0], ("c", 1, 2, 2)]
    assert indexes.differing(of(rows), of(rows + rows)).count() == 3
    assert sorted(map(tuple, indexes.differing(of([]), of(rows)).collect())) == rows


def test_gaps_are_read_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(reorder, "PART", 4)
    postings = spark.createDataFrame([("a", 1), ("a", 9), ("a", 3), ("b", 0)], "term string, doc_id long")
    found = reorder.log_gap(postings)
    assert "Join" not in plan_of(found)
    assert found.first().log_gap == pytest.approx(np.mean(np.log2([2, 2, 6, 1])))


@pytest.mark.parametrize("name", ["boolean_and", "or_count", "scored_and", "ranked_or", "ranked_and", "wand", "maxscore", "block_max_wand", "block_max_maxscore", "block_max_ranked_and", "by_range", "exact_thresholds", "pruned"])
def test_hits_of_queries_are_not_moved(some, name):
    topics, postings = some
    found = getattr(search, name)(topics, postings)
    found.collect()
    stack, moved = [found._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            stack.append(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            moved.append(node.metrics().apply("shuffleRecordsWritten").value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    # 50 queries have 50 times as many hits as there are postings; of answers at most the best 10 are moved.
    assert moved and all(rows <= 10 * 50 for rows in moved) and postings.count() * 50 > 1000


def _asked(entries, n, **columns):
    no, q, at = (np.array([e[i] for e in entries]) for i in range(3))
    degree = np.bincount(no)
    sizes = np.bincount(q, minlength=n)
    return batch.Asked(np.cumsum(degree) - degree, degree, q, at, sizes, {c: np.array(v, float) for c, v in columns.items()})


@pytest.mark.parametrize("hits", [1, 4, 1000])
def test_blocks_hold_whole_documents(monkeypatch, hits):
    monkeypatch.setattr(batch, "HITS", hits)
    rng = np.random.default_rng(3)
    asked = _asked([(0, 0, 0), (0, 1, 0), (1, 0, 1), (2, 1, 1)], 2, weight=[1, 1, 1, 1], theta=[0, 0, 0, 0])
    rows = [(d, d, t, float(rng.integers(1, 9))) for d in range(40) for t in range(3) if rng.random() < 0.7]
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["unit", "doc_id", "no", "score"])
    blocks = lambda: batch._whole(table.to_batches(max_chunksize=7), asked)
    assert sorted(d for h in blocks() for d in h.docs) == sorted({r[0] for r in rows})
    score = {(q, d): sum(s for d2, _, t, s in rows if d2 == d and t in ts) for q, ts in enumerate([(0, 1), (0, 2)]) for d in range(40)}
    found = next(batch.best(5)(asked, blocks()))
    got = sorted(zip(found["q"].tolist(), (-found["score"]).tolist(), found["doc_id"].tolist()))
    assert got == [x for q in range(2) for x in sorted((q, -s, d) for (q2, d), s in score.items() if q2 == q and s > 0)[:5]]
    both = list(batch.common(True)(asked, blocks()))
    have = {(d, t) for d, _, t, _ in rows}
    want = {(0, 0, 1): sum((d, 0) in have and (d, 1) in have for d in range(40)), (1, 0, 1): sum((d, 0) in have and (d, 2) in have for d in range(40))}
    pairs = {(q, a, b): n for q, a, b, n in (x for part in both for x in zip(*[part[c].tolist() for c in ("q", "a", "b", "length")]))}
    assert {k: pairs[k] for k in want} == want
    sums = next(batch.best_of_pairs(3)(asked, blocks()))
    for q in range(2):
        assert sorted((s for q2, s in zip(sums["q"], sums["score"]) if q2 == q), reverse=True) == sorted((s for (q2, _), s in score.items() if q2 == q), reverse=True)[:3]


def _cut_as_before(scores, penalty, eps1=0.01, eps2=0.4):
    """Round 2's loop over one list."""
    n, total = len(scores), np.concatenate([[0.0], np.cumsum(scores)])
    limits, cost = [], penalty
    while cost < penalty / eps1:
        limits.append(cost)
        cost *= 1 + eps2
    limits.append(cost)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    ends, most = [0] * len(limits), [0.0] * len(limits)
    for i in range(n):
        for w, limit in enumerate(limits):
            if ends[w] <= i:
                ends[w], most[w] = i, 0.0
            elif i and scores[i - 1] >= most[w]:
                most[w] = scores[i : ends[w]].max()
            while ends[w] < n:
                top = max(most[w], scores[ends[w]])
                if ends[w] > i and (ends[w] + 1 - i) * top - (total[ends[w] + 1] - total[i]) + penalty > limit:
                    break
                most[w], ends[w] = top, ends[w] + 1
            price = best[i] + (ends[w] - i) * most[w] - (total[ends[w]] - total[i]) + penalty
            if price < best[ends[w]]:
                best[ends[w]], back[ends[w]] = price, i
            if ends[w] == n:
                break
    edges, at = [], n
    while at:
        edges.append((int(back[at]), int(at)))
        at = back[at]
    return edges[::-1]


def test_lists_are_cut_alike_and_without_a_call_for_each(spark):
    rng = np.random.default_rng(5)
    lists = {f"t{i:02}": np.round(rng.gamma(1, 3, int(n)), 3) for i, n in enumerate([1, 1, 2, 5, 40, 300, 1500, 1])}
    rows = [(t, 3 * d, float(s)) for t, own in lists.items() for d, s in enumerate(own)]
    found = ix.variable_blocks(spark.createDataFrame(rows, "term string, doc_id long, score double"), 4.0)
    plan = plan_of(found)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = []
    for t, own in lists.items():
        edges = _cut_as_before(own, 4.0)
        want += [(t, k, 3 * a, 3 * (edges[k + 1][0] if k + 1 < len(edges) else len(own)) - (1 if k + 1 < len(edges) else 3), b - a, own[a:b].max()) for k, (a, b) in enumerate(edges)]
    assert sorted(map(tuple, found.collect())) == want


def _bisect_as_before(docs, depth, iterations):
    """Round 2's recursion, whose every node was as wide as the collection's terms."""
    n_terms = max((int(d.max()) for d in docs if len(d)), default=-1) + 1

    def split(own, level):
        if level == 0 or len(own) < 2:
            return np.sort(own)
        own, half = np.sort(own), len(own) // 2
        left, right = own[:half].copy(), own[half:].copy()
        logs = np.log2(max(1, len(left))), np.log2(max(1, len(right)))
        degrees = lambda side: np.bincount(np.concatenate([docs[i] for i in side]).astype(int), minlength=n_terms).astype(float)
        for _ in range(iterations):
            a, b = degrees(left), degrees(right)
            now = reorder._expected(logs, a, b)
            to_right, to_left = now - reorder._expected(logs, np.maximum(a - 1, 0), b + 1), now - reorder._expected(logs, a + 1, np.maximum(b - 1, 0))
            gain_left, gain_right = (np.round([to[docs[i]].sum() for i in side], 6) for to, side in ((to_right, left), (to_left, right)))
            i, j = np.argsort(-gain_left, kind="stable"), np.argsort(-gain_right, kind="stable")
            pairs = gain_left[i[: len(right)]] + gain_right[j[: len(left)]]
            n = int(np.argmax(np.append(pairs <= 0, True)))
            if n == 0:
                break
            i, j = i[:n], j[:n]
            left[i], right[j] = right[j], left[i]
            left.sort(), right.sort()
        return np.concatenate([split(left, level - 1), split(right, level - 1)])

    return split(np.arange(len(docs)), depth)


def test_bisection_finds_the_order_of_before_at_a_cost_of_its_postings():
    rng = np.random.default_rng(8)
    docs = [np.unique(rng.integers(0, 400, rng.integers(0, 30))) for _ in range(301)]
    sizes, terms = np.array([len(d) for d in docs]), np.concatenate(docs)
    assert reorder.bisect(sizes, terms, 5, 20).tolist() == _bisect_as_before(docs, 5, 20).tolist()
    assert reorder.bisect(np.zeros(3, int), np.zeros(0, int), 2, 5).tolist() == [0, 1, 2]
    # Numbers of terms do not matter: arrays as wide as the largest would take 8 TB.
    assert reorder.bisect(sizes, terms * 10**12, 5, 20).tolist() == reorder.bisect(sizes, terms, 5, 20).tolist()


def test_no_task_numbers_a_whole_shard(spark):
    from trovewise.operators import shards

    rows = [(s, f"t{i}") for s in (0, 2) for i in range(50 + s)]
    found = shards.lexicons(spark.createDataFrame(rows + rows, "shard_id long, term string"))
    assert "PARTITION BY shard_id" not in plan_of(found) and "windowspecdefinition(shard_id" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(s, t, i) for s in (0, 2) for i, t in enumerate(sorted(f"t{i}" for i in range(50 + s)))]
