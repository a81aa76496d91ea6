import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trovewise.functions.text import Analyzer
from trovewise.operators import index as ix
from trovewise.operators import lookup, queries, reorder, sampling, search, shards
from trovewise.plans import strategy

WORDS = [[int(c) for c in digits] for digits in ("20390", "503426745", "518988", "859", "86966543106")]


@pytest.fixture(scope="module")
def tiny(spark):
    return ix.build(spark.createDataFrame([(i, " ".join(map(str, w))) for i, w in enumerate(WORDS)], "doc_id long, text string"))


@pytest.fixture(scope="module")
def made(spark):
    """A collection, queries and scored postings, all cached."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 60)))) for i in range(400)]
    index = ix.build(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = [(q, " ".join(rng.sample(words, 4)) + " unknown w1") for q in range(12)]
    topics = queries.known(queries.weighted(queries.parse(spark.createDataFrame(asked, "qid long, query string"), qid="qid")), index).cache()
    return index, topics, ix.scored(index).cache(), dict(docs)


def test_inversion(tiny):
    post = {(r.term, r.doc_id): r.tf for r in tiny.postings.collect()}
    assert {d: post["0", d] for d in (0, 1, 4)} == {0: 2, 1: 1, 4: 1}
    assert {k[1]: v for k, v in post.items() if k[0] == "8"} == {2: 3, 3: 1, 4: 1}
    assert {k[1]: v for k, v in post.items() if k[0] == "6"} == {1: 1, 4: 4}
    assert [r.doc_len for r in tiny.docs.orderBy("doc_id").collect()] == [5, 9, 6, 3, 11]


def test_empty_documents_count(spark):
    index = ix.build(spark.createDataFrame([(0, "a b"), (1, ""), (2, None)], "doc_id long, text string"))
    assert tuple(index.stats.first()) == (3, 2, pytest.approx(2 / 3))


def test_empty_collection(spark):
    index = ix.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.postings.isEmpty() and index.stats.first().n_docs == 0


def test_merge_sums_shared_documents(spark):
    forward = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "doc_id long, terms array<string>")
    merged = ix.merge_postings([ix.invert(forward), ix.invert(forward.filter("doc_id = 0"))])
    assert sorted(map(tuple, merged.collect())) == [("a", 0, 2, 4), ("a", 1, 1, 1), ("b", 0, 2, 4)]


def test_dense_ids(spark):
    rows = ix.dense_ids(spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("k")), ["k"], "n").collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] == sorted(f"k{i}" for i in range(1000))
    assert sorted(r.n for r in rows) == list(range(1000))


def test_intersections_of_subsets(spark, tiny):
    own = spark.createDataFrame([(0, 0, "6", 1.0), (0, 1, "1", 1.0), (0, 2, "5", 1.0)], "qid long, pos long, term string, weight double")
    found = {int(r.mask): r.length for r in search.intersections(own, ix.scored(tiny)).collect()}
    have = {b: {d for d, w in enumerate(WORDS) if t in w} for b, t in enumerate((6, 1, 5))}
    for mask in range(1, 8):
        common = set.intersection(*[have[b] for b in range(3) if mask >> b & 1])
        assert found.get(mask, 0) == len(common)


STRATEGIES = [search.term_at_a_time, search.wand, search.maxscore, search.block_max_wand, search.block_max_maxscore, search.by_range, strategy.search]


def rows(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("plan", STRATEGIES, ids=lambda p: p.__name__)
def test_strategies_agree_with_the_exhaustive_plan(made, plan):
    _, topics, postings, _ = made
    assert rows(plan(topics, postings, k=5)) == rows(search.ranked_or(topics, postings, 5))


def test_blocks_of_varying_size_agree(made):
    _, topics, postings, _ = made
    blocks = ix.variable_blocks(postings, 1.0)
    assert rows(search.block_max_wand(topics, postings, 5, blocks)) == rows(search.ranked_or(topics, postings, 5))
    every = postings.join(blocks.withColumnRenamed("max_score", "most"), "term").filter(F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))
    assert every.count() == postings.count() and every.filter("score > most + 1e-12").isEmpty()


def test_ranked_and_against_brute_force(made):
    index, topics, postings, docs = made
    assert rows(search.ranked_and(topics, postings, 5)) == rows(search.block_max_ranked_and(topics, postings, 5))
    want = {}
    for r in topics.collect():
        want.setdefault(r.qid, set()).add(r.term)
    have = {d: set(t.split()) for d, t in docs.items()}
    got = {(r.qid, r.doc_id) for r in search.boolean_and(topics, postings).collect()}
    assert got == {(q, d) for q, ts in want.items() for d, own in have.items() if ts <= own}
    assert {r.qid: r.n for r in search.or_count(topics, postings).collect()} == {q: sum(bool(ts & own) for own in have.values()) for q, ts in want.items()}


def test_thresholds(made):
    _, topics, postings, _ = made
    exact = {r.qid: r.threshold for r in search.exact_thresholds(topics, postings, 5).collect()}
    for terms in (1, 2, 3):
        below = {r.qid: r.threshold for r in search.estimated_thresholds(topics, postings, 5, terms).collect()}
        assert all(below[q] <= exact[q] + 1e-9 for q in exact)
    limits = topics.select("qid").distinct().withColumn("threshold", F.lit(1e9))
    assert rows(search.safe_top(topics, postings, limits, 5)) == rows(search.ranked_or(topics, postings, 5))


def test_fixed_blocks_bound_scores(made):
    _, _, postings, _ = made
    blocks = ix.fixed_blocks(postings, 7)
    assert blocks.agg(F.sum("n")).first()[0] == postings.count()
    inside = postings.join(blocks.withColumnRenamed("max_score", "most"), "term").filter(F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))
    assert inside.count() == postings.count() and inside.filter("score > most").isEmpty()


def test_term_features(spark):
    scores = spark.createDataFrame([("1", 0, 2.0), ("1", 1, 1.0), ("1", 2, 5.0)], "term string, doc_id long, score double")
    r = ix.term_features(scores).first()
    assert (r.df, r["mean"], r.variance) == (3, pytest.approx(8 / 3), pytest.approx(2.8888889))


def test_queries(spark, made):
    index = made[0]
    parsed = queries.parse(spark.createDataFrame([("17:w1 w2 w1 nothing",)], "query string"))
    got = {r.term: (r.pos, r.weight) for r in queries.known(queries.weighted(parsed), index).collect()}
    assert got == {"w1": (0, 2.0), "w2": (1, 1.0)} and parsed.first().qid == "17"
    assert {r.weight for r in queries.weighted(parsed, "unweighted").collect()} == {1.0}
    assert queries.weighted(parsed, "keep").count() == 4
    assert queries.of_size(queries.weighted(parsed), 4).isEmpty() and queries.of_size(queries.weighted(parsed), 1, 3).count() == 3
    ids = queries.mapped(parsed, spark.createDataFrame([("w1", 5), ("w2", 3)], "term string, term_id long"), with_id=True).first().ids
    assert ids == "17:5\t3\t5"
    assert [r.term_id for r in queries.parse_ids(spark.createDataFrame([("1:4 5",)], "query string")).collect()] == [4, 5]
    with pytest.raises(ValueError):
        queries.weighted(parsed, "other")


def test_reordering(made):
    index, topics, postings, _ = made
    mapping = reorder.at_random(index.docs, 3)
    assert sorted(r.new for r in mapping.collect()) == list(range(400))
    after = reorder.apply(index, mapping)
    assert after.postings.count() == index.postings.count()
    before = {(r.qid, r["rank"]): round(r.score, 6) for r in search.ranked_or(topics, postings).collect()}
    assert {(r.qid, r["rank"]): round(r.score, 6) for r in search.ranked_or(topics, ix.scored(after)).collect()} == before


def test_variable_blocks_query_covers_every_posting(spark, tmp_path):
    from trovewise.plans.queries import QUERIES

    spark.createDataFrame([(i, t) for i, t in enumerate(["asked other", "other rest", "rest rest lone"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "asked")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    covered = QUERIES["block_max_variable"](spark, str(tmp_path)).groupBy("term").agg(F.sum("n").alias("n")).collect()
    assert {r.term: r.n for r in covered} == {"asked": 1, "other": 2, "rest": 2, "lone": 1}


@pytest.mark.parametrize("leaf", [1000, 8])
def test_bisection_orders_clusters(spark, leaf):
    rng = random.Random(1)
    groups = [[f"g{g}t{i}" for i in range(12)] for g in range(2)]
    docs = [(i, " ".join(rng.sample(groups[rng.randrange(2)], 8))) for i in range(24)]
    index = ix.build(spark.createDataFrame(docs, "doc_id long, text string"))
    mapping = reorder.graph_bisection(index, depth=2, iterations=8, leaf_docs=leaf)
    assert sorted((r.new for r in mapping.collect())) == list(range(24)) and mapping.select("old").distinct().count() == 24
    gap = lambda x: reorder.log_gap(x.postings).first().log_gap
    assert gap(reorder.apply(index, mapping)) < gap(index)


def test_shards(spark, made):
    index, topics, postings, _ = made
    parts = shards.at_random(index.docs, 3)
    assert sorted(r["count"] for r in parts.groupBy("shard_id").count().collect()) == [132, 134, 134]
    lists = spark.createDataFrame([("a", 2), ("a", 1), ("b", 2)], "title string, shard_id int")
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, title string")
    assert sorted(map(tuple, shards.by_lists(docs, lists).collect())) == [(0, 1), (1, 2), (2, 0)]
    local = shards.local_lexicon(index.postings, parts)
    for _, own in itertools.groupby(sorted((r.shard_id, r.term, r.term_id) for r in local.collect()), key=lambda x: x[0]):
        numbers = [x[2] for x in own]
        assert numbers == list(range(len(numbers)))
    sizes = parts.groupBy("shard_id").agg(F.count("*").alias("n_docs"))
    scored = shards.scores(topics, ix.term_features(postings), index.stats, shards.features(postings, parts), sizes, 10)
    assert scored.count() == 3 * topics.select("qid").distinct().count()
    nothing = spark.createDataFrame([(99, "no such term")], "qid long, term string")
    assert {r.score for r in shards.scores(nothing, ix.term_features(postings), index.stats, shards.features(postings, parts), sizes).collect()} == {0.0}


def test_upper_gamma():
    assert shards.upper_gamma([1.0, 1.0, 2.0], [0.5, 5.0, 3.0]) == pytest.approx([math.exp(-0.5), math.exp(-5), math.exp(-3) * 4], abs=1e-12)


def test_samples(made):
    index = made[0]
    df = {r.term: r.df for r in index.terms.collect()}
    after = sampling.postings(index, 0.3)
    assert {r.term: r.df for r in after.terms.collect()} == {t: math.ceil(n * 0.3) for t, n in df.items()}
    some = sampling.documents(index, 0.25)
    assert some.postings.select("doc_id").distinct().count() <= 100 and some.docs.count() == 400
    assert {r.term for r in sampling.emptied(index, some).collect()} == set(df) - {r.term for r in some.terms.collect()}


def test_lookup(spark):
    table = lookup.build(spark.createDataFrame([("b",), ("a",)], "value string"))
    assert sorted(map(tuple, table.collect())) == [(0, "a"), (1, "b")]
    lookup.check_sorted(table)
    with pytest.raises(ValueError):
        lookup.check_sorted(spark.createDataFrame([(0, "b"), (1, "a")], "idx long, value string"))
    with pytest.raises(ValueError):
        lookup.build(spark.createDataFrame([("a",), ("a",)], "value string"))
    assert lookup.find(table, spark.createDataFrame([("b",), ("z",)], "value string")).orderBy("value").collect()[1].idx is None
    assert lookup.between(table, 0, count=1).count() == 1 and lookup.at(table, 1).first().value == "b"


def test_bisection_is_alike_over_the_cluster_and_in_a_task(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(3)) for _ in range(rng.randrange(12)))) for i in range(64)]
    index = ix.build(spark.createDataFrame(docs, "doc_id long, text string"))
    orders = [{r.old: r.new for r in reorder.graph_bisection(index, depth=2, iterations=4, least_df=2, leaf_docs=leaf).collect()} for leaf in (10, 1000)]
    assert orders[0] == orders[1] and sorted(orders[0].values()) == list(range(64))


def test_stored_bounds_answer_alike(spark, tmp_path):
    from trovewise.plans import tools
    from trovewise.sources import indexes

    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for i in range(300)], "doc_id long, text string")
    indexes.save_collection(docs, str(tmp_path / "ix"))
    assert indexes.load_bounds(spark, str(tmp_path / "ix")) == {}
    indexes.save_bounds(spark, str(tmp_path / "ix"), k=20)
    assert indexes.load_bounds(spark, str(tmp_path / "ix"), k=30) == {}
    lines = spark.createDataFrame([("1:a b",), ("2:c",), ("3:nothing",)], "query string")
    found = [sorted(tuple(r) for r in tools.answer(spark, str(tmp_path / "ix"), lines, Analyzer(), name).selectExpr("qid", "doc_id", "round(score, 6)", "rank").collect()) for name in ("ranked_or", "wand", "maxscore", "block_max_wand")]
    assert len(found[0]) == 20 and all(f == found[0] for f in found)


def test_long_lists_are_cut_by_ranges_alike(spark, made, monkeypatch):
    index, _, postings, _ = made
    rows = lambda df: sorted(map(tuple, df.collect()))
    blocks, gap = rows(ix.fixed_blocks(postings, 7)), reorder.log_gap(index.postings).first().log_gap
    monkeypatch.setattr(ix, "PART", 16)
    monkeypatch.setattr(reorder, "PART", 16)
    assert rows(ix.fixed_blocks(postings, 7)) == blocks
    assert math.isclose(reorder.log_gap(index.postings).first().log_gap, gap)
