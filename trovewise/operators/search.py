"""Boolean and ranked retrieval for whole batches of queries in one plan.

There are four answers: all documents with every term, how many have any, and the top k by summed score of either.
The strategies (wand, maxscore, block maxima, term at a time, ranges) give the same answers as the exhaustive plan;
they leave out sums that bounds show to be idle. Bounds need scores that are never negative. A top k has only scores
above 0 and is ordered by score and document.

queries are rows (qid, term, weight), each term once; postings are scored (term, doc_id, score). Only postings of the
queries' terms are read on, and are moved once, to where their documents are answered for the whole batch (batch).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from . import batch
from .batch import EPSILON
from .index import RANGE, kth_scores, score_bounds, with_block_maxima


def matches(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, term, doc_id, score): scored postings of the queries' terms, by weight."""
    own = queries.select("qid", "term", "weight").join(postings.select("term", "doc_id", "score"), "term")
    return own.select("qid", "term", "doc_id", (F.col("score") * F.col("weight")).alias("score"))


def summed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))


def top(results: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best with a score above 0."""
    by = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = results.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _sizes(queries: DataFrame) -> DataFrame:
    return queries.groupBy("qid").agg(F.count("*").alias("n_terms"))


def _best(queries: DataFrame, postings: DataFrame, k: int, keep=lambda h: None, **how) -> DataFrame:
    return top(batch.answer(queries, postings, batch.best(k, keep), {"doc_id": None, "score": DoubleType()}, **how), k)


def boolean_and(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, doc_id) of the documents with all terms of the query."""
    return batch.answer(queries, postings, batch.every(False), {"doc_id": None}, (), ())


def scored_and(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of the documents with all terms."""
    return batch.answer(queries, postings, batch.every(True), {"doc_id": None, "score": DoubleType()})


def _totals(queries: DataFrame, postings: DataFrame, count, names: tuple[str, ...], **how) -> DataFrame:
    found = batch.answer(queries, postings, batch.totals(count, names), dict.fromkeys(names, LongType()), **how)
    return found.groupBy("qid").agg(*[F.sum(c).alias(c) for c in names]).filter(F.col(names[0]) > 0)


def or_count(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, n): how many documents have any of the terms."""
    return _totals(queries, postings, lambda h: {"n": batch.per_query(h, h.sums() > 0)}, ("n",), columns=(), values=())


def and_or_counts(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, n_or, n_and): how many documents have any, and all, of the terms."""
    count = lambda h: {"n_or": batch.per_query(h, h.sums() > 0), "n_and": batch.per_query(h, batch.all_terms(h))}
    return _totals(queries, postings, count, ("n_or", "n_and"), columns=(), values=())


def ranked_or(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    return _best(queries, postings, k)


def ranked_and(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    return _best(queries, postings, k, batch.all_terms)


def term_at_a_time(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """Accumulates scores by document, of some documents at a time; the accumulators hold no document that no term has."""
    return _best(queries, postings, k)


def thresholds(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """(qid, theta): the best k-th score of a single term, which the k-th of the query can't be below."""
    return queries.join(bounds, "term").groupBy("qid").agg(F.max(F.col("weight") * F.col("kth_score")).alias("theta"))


def _reaches(bound: Column) -> Column:
    return bound >= F.col("theta") - EPSILON


def _bounded(queries: DataFrame, postings: DataFrame, bounds: DataFrame | None, k: int) -> DataFrame:
    """queries with most, essential and theta; terms without postings are left out."""
    own = queries.join(score_bounds(postings, k) if bounds is None else bounds, "term")
    marked = own.withColumn("most", F.col("weight") * F.col("max_score")).withColumn("theta", F.max(F.col("weight") * F.col("kth_score")).over(Window.partitionBy("qid")))
    running = F.sum("most").over(Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("running", running).select("qid", "term", "weight", "most", "theta", _reaches(F.col("running")).cast("double").alias("essential"))


_BOUNDED = ("weight", "most", "theta", "essential")


def _could(h: batch.Hits) -> np.ndarray:
    """By group, whether the sum of its bounds reaches the threshold."""
    return (h.sums() > 0) & (h.sums(h.of("most")) >= h.asked.by_query("theta")[h.group_q] - EPSILON)


def wand(queries: DataFrame, postings: DataFrame, k: int = 10, bounds: DataFrame | None = None) -> DataFrame:
    """Scores only documents whose terms' list maxima reach the threshold."""
    return _best(_bounded(queries, postings, bounds, k), postings, k, _could, columns=_BOUNDED)


def _range(width: int) -> Column:
    return F.floor(F.col("doc_id") / width).cast("bigint")


def pruned(queries: DataFrame, postings: DataFrame, bounds: DataFrame | None = None, width: int = RANGE, k: int = 10) -> DataFrame:
    """(qid, postings, wand, maxscore, ranges): how many of a query's postings there are, and are left by list bounds, by essential lists and by live ranges."""

    def count(h):
        by = lambda some: np.bincount(h.q[some], minlength=len(h.asked.sizes))
        return {"postings": by(slice(None)), "wand": by(_could(h)[h.group]), "maxscore": by(h.of("essential") > 0), "ranges": by(h.live(width))}

    return _totals(_bounded(queries, postings, bounds, k), postings, count, ("postings", "wand", "maxscore", "ranges"), columns=_BOUNDED, unit=_range(width))


def essential(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """(qid, term, weight, essential): terms by list maximum; those whose maxima together stay below the threshold aren't essential."""
    own = queries.join(bounds, "term").withColumn("most", F.col("weight") * F.col("max_score")).join(thresholds(queries, bounds), "qid")
    running = F.sum("most").over(Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("running", running).select("qid", "term", "weight", _reaches(F.col("running")).alias("essential"))


def maxscore(queries: DataFrame, postings: DataFrame, k: int = 10, bounds: DataFrame | None = None) -> DataFrame:
    """Takes documents of essential lists only, and adds what the other lists have for them."""
    return _best(_bounded(queries, postings, bounds, k), postings, k, lambda h: h.sums(h.of("essential")) > 0, columns=_BOUNDED)


def live_ranges(queries: DataFrame, maxima: DataFrame, limit: DataFrame) -> DataFrame:
    """(qid, range_id) of the ranges of document ids whose maxima reach the query's threshold."""
    sums = queries.join(maxima, "term").groupBy("qid", "range_id").agg(F.sum(F.col("weight") * F.col("max_score")).alias("most"))
    return sums.join(limit, "qid").filter(_reaches(F.col("most"))).select("qid", "range_id")


def block_max_wand(queries: DataFrame, postings: DataFrame, k: int = 10, blocks: DataFrame | None = None, bounds: DataFrame | None = None, width: int = RANGE, size: int = 128) -> DataFrame:
    """Scores documents of live ranges whose blocks' maxima reach the threshold; blocks may be of fixed or varying size.

    Each posting takes its block's maximum along. Without blocks they are runs of so many postings, cut where parts of
    the document ids end.
    """
    if blocks is None:
        capped = with_block_maxima(postings.select("term", "doc_id", "score"), size).withColumnRenamed("block_max", "cap")
    else:
        # A posting's block is found by the ranges that the block spans, so that the join is on equal values.
        spans = blocks.select("term", "first_doc", "last_doc", F.col("max_score").alias("cap")).withColumn("range_id", F.explode(F.sequence(F.floor(F.col("first_doc") / width).cast("bigint"), F.floor(F.col("last_doc") / width).cast("bigint"))))
        capped = postings.withColumn("range_id", _range(width)).join(spans, ["term", "range_id"]).filter(F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))

    def keep(h):
        bound = h.sums(h.of("cap") * h.of("weight"), h.live(width))
        return (h.sums() > 0) & (bound >= h.asked.by_query("theta")[h.group_q] - EPSILON)

    return _best(_bounded(queries, postings, bounds, k), capped, k, keep, columns=_BOUNDED, values=("score", "cap"), unit=_range(width))


def block_max_maxscore(queries: DataFrame, postings: DataFrame, k: int = 10, bounds: DataFrame | None = None, width: int = RANGE) -> DataFrame:
    """maxscore over live ranges of documents."""
    keep = lambda h: h.sums((h.of("essential") > 0) & h.live(width)) > 0
    return _best(_bounded(queries, postings, bounds, k), postings, k, keep, columns=_BOUNDED, unit=_range(width))


def block_max_ranked_and(queries: DataFrame, postings: DataFrame, k: int = 10, width: int = RANGE) -> DataFrame:
    """Leaves out ranges of documents in which not every term occurs."""
    keep = lambda h: h.sums(None, h.covered(width)) == h.asked.sizes[h.group_q]
    return _best(queries, postings, k, keep, unit=_range(width))


def by_range(queries: DataFrame, postings: DataFrame, k: int = 10, width: int = RANGE) -> DataFrame:
    """The top k of ranges of document ids, then the top k of those: no query's documents meet in one task."""
    return _best(queries, postings, k, unit=_range(width))


def exact_thresholds(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """(qid, threshold): the k-th score, 0 where there are fewer results."""
    best = ranked_or(queries, postings, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("threshold"))
    return queries.select("qid").distinct().join(best, "qid", "left").select("qid", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def estimated_thresholds(queries: DataFrame, postings: DataFrame, k: int = 10, terms: int = 1) -> DataFrame:
    """(qid, threshold): the best k-th score of any of the query's terms or, for 2 or 3 terms, pairs or triples of them; 0 if none has k."""
    single = queries.join(kth_scores(postings, k), "term").groupBy("qid").agg(F.max(F.col("weight") * F.col("kth_score")).alias("threshold"))
    found = single
    if terms > 1:
        # Of pairs only sums above the best single term can raise the threshold.
        limited = queries.select("qid", "term", "weight").join(single, "qid", "left").withColumn("theta", F.coalesce("threshold", F.lit(float("-inf"))))
        sums = batch.answer(limited, postings, batch.best_of_pairs(k), {"a": IntegerType(), "b": IntegerType(), "score": DoubleType()}, ("weight", "theta"))
        found = found.unionByName(_kth(sums, ["qid", "a", "b"], k))
    if terms > 2:
        names, own = queries.select("qid", "term"), queries.select("qid", F.array("term").alias("of"))
        for _ in range(2):
            own = own.join(names, "qid").filter(F.col("term") > F.element_at("of", -1)).select("qid", F.concat("of", F.array("term")).alias("of"))
        parts = own.withColumn("term", F.explode("of")).join(matches(queries, postings), ["qid", "term"]).groupBy("qid", "of", "doc_id").agg(F.sum("score").alias("score"))
        found = found.unionByName(_kth(parts, ["qid", "of"], k))
    kth = found.groupBy("qid").agg(F.max("threshold").alias("threshold"))
    return queries.select("qid").distinct().join(kth, "qid", "left").select("qid", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def _kth(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(qid, threshold): the k-th score of each of the keys that has so many."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))
    return scores.withColumn("at", at).filter(F.col("at") == k).select("qid", F.col("score").alias("threshold"))


def above(results: DataFrame, limits: DataFrame) -> DataFrame:
    """Results that reach a given threshold (qid, threshold); where it is 0, those above 0."""
    return results.join(limits, "qid").filter((F.col("score") > 0) & (F.col("score") >= F.col("threshold"))).drop("threshold")


def safe_top(queries: DataFrame, postings: DataFrame, limits: DataFrame, k: int = 10) -> DataFrame:
    """The top k with given thresholds; queries for which they leave fewer than k are answered again without."""
    every = summed(matches(queries, postings))
    first = top(above(every, limits), k)
    short = queries.select("qid").distinct().join(first.groupBy("qid").count().filter(F.col("count") >= k), "qid", "left_anti")
    return first.join(short, "qid", "left_anti").unionByName(top(every.join(short, "qid", "left_semi"), k))


def intersections(queries: DataFrame, postings: DataFrame, most_terms: int | None = None, whole: bool = False) -> DataFrame:
    """(qid, mask, length, max_score) of every set of at most so many terms of a query, without weights; empty ones are left out.

    Bit p of the mask is the term at position p; whole asks for the set of all terms only. Single terms, pairs and the
    whole are counted document by document; larger sets are as many as a power of the query's length, and joined.
    """
    if whole or most_terms in (1, 2):
        return _common(queries, postings, most_terms, whole)
    own = queries.select("qid", "term").withColumn("bit", F.row_number().over(Window.partitionBy("qid").orderBy("term")) - 1) if "pos" not in queries.columns else queries.select("qid", "term", (F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1).alias("bit"))
    sets = own.select("qid", F.array("bit").alias("bits"), F.col("bit").alias("last"))
    grown, size = sets, 1
    longest = own.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    while size < min(most_terms or longest, longest):
        size += 1
        grown = grown.join(own.select("qid", "bit"), "qid").filter(F.col("bit") > F.col("last")).select("qid", F.concat("bits", F.array("bit")).alias("bits"), F.col("bit").alias("last"))
        sets = sets.unionByName(grown)
    sets = sets.select("qid", "bits", F.size("bits").alias("size"))
    terms = sets.withColumn("bit", F.explode("bits")).join(own, ["qid", "bit"])
    hits = terms.join(postings.select("term", "doc_id", "score"), "term").groupBy("qid", "bits", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.first("size").alias("size"))
    found = hits.filter("n = size").groupBy("qid", "bits").agg(F.count("*").alias("length"), F.max("score").alias("max_score"))
    return _sets(found)


def _sets(found: DataFrame) -> DataFrame:
    mask = F.aggregate(F.transform("bits", lambda b: F.pow(F.lit(2.0), b)), F.lit(0.0), lambda a, x: a + x).cast("decimal(38,0)")
    return found.select("qid", F.array_join(F.transform("bits", lambda b: b.cast("string")), ",").alias("terms"), mask.alias("mask"), "length", "max_score")


def _common(queries: DataFrame, postings: DataFrame, most_terms: int | None, whole: bool) -> DataFrame:
    """intersections of single terms and pairs, or of all terms."""
    by = "pos" if "pos" in queries.columns else "term"
    own = queries.select("qid", "term", (F.row_number().over(Window.partitionBy("qid").orderBy(by)) - 1).cast("double").alias("bit"), F.lit(1.0).alias("weight"))
    kinds = {"a": IntegerType(), "b": IntegerType(), "length": LongType(), "max_score": DoubleType()}
    found = batch.answer(own, postings, batch.common(not whole), kinds, ("weight", "bit"))
    if most_terms == 1:
        found = found.filter("a = b")
    sums = found.groupBy("qid", "a", "b").agg(F.sum("length").alias("length"), F.max("max_score").alias("max_score"))
    if whole:
        every = own.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list("bit")), lambda b: b.cast("int")).alias("bits"))
        return _sets(sums.join(every, "qid"))
    return _sets(sums.withColumn("bits", F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))))
