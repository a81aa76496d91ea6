"""Collections in shards: partitioning, shard-local lexicons, and the ranking of shards for a query.

A shard is a column, so that every operator over an index runs for all shards in one job by adding shard_id to its keys.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import dense_ids
from .reorder import mixed


def at_random(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, shard_id): documents in the order of a hash, cut into equal parts."""
    ordered = dense_ids(docs.select("doc_id", mixed("doc_id", seed).alias("at")), ["at", "doc_id"], "place")
    total = docs.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shards)).alias("size"))
    return ordered.crossJoin(F.broadcast(total)).select("doc_id", F.floor(F.col("place") / F.col("size")).cast("bigint").alias("shard_id"))


def by_lists(docs: DataFrame, lists: DataFrame, title: str = "title") -> DataFrame:
    """(doc_id, shard_id) from lists (title, shard_id); the first shard that lists a document has it, shard 0 if none."""
    first = lists.groupBy(title).agg(F.min("shard_id").cast("bigint").alias("shard_id"))
    return docs.join(first, title, "left").select("doc_id", F.coalesce("shard_id", F.lit(0)).cast("bigint").alias("shard_id"))


def local_lexicon(postings: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard_id, term, term_id): the terms of each shard, numbered in order within it."""
    return lexicons(postings.join(shards, "doc_id").select("shard_id", "term"))


def lexicons(terms: DataFrame) -> DataFrame:
    """(shard_id, term, term_id) of rows (shard_id, term): numbered over all shards and from each one's first, so no task holds a shard's terms."""
    placed = dense_ids(terms.select("shard_id", "term").distinct(), ["shard_id", "term"], "place")
    first = placed.groupBy("shard_id").agg(F.min("place").alias("first"))
    return placed.join(first, "shard_id").select("shard_id", "term", (F.col("place") - F.col("first")).alias("term_id"))


def local_ids(shards: DataFrame) -> DataFrame:
    """(doc_id, shard_id, local_id): documents numbered in order within their shard."""
    return shards.withColumn("local_id", (F.row_number().over(Window.partitionBy("shard_id").orderBy("doc_id")) - 1).cast("bigint"))


def features(postings: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard_id, term, mean, variance, df) of the scores of each term in each shard."""
    return postings.join(shards, "doc_id").groupBy("shard_id", "term").agg(F.avg("score").alias("mean"), F.var_pop("score").alias("variance"), F.count("*").alias("df"))


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularized upper incomplete gamma function, by series below a + 1 and by a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    log_gamma = np.vectorize(math.lgamma)
    some = x > 0
    if not some.any():
        return out
    front = np.exp(np.clip(a * np.log(np.where(some, x, 1)) - x - log_gamma(a), -700, 700))
    term = total = 1 / a
    for n in range(1, 2000):
        term = term * x / (a + n)
        total = total + term
        if np.all(np.abs(term) <= 1e-15 * np.abs(total)):
            break
    low = 1 - front * total
    b = x + 1 - a
    c, d = np.full(a.shape, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    return np.clip(np.where(some, np.where(x < a + 1, low, front * h), 1.0), 0.0, 1.0)


def _above(score: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """The share of scores above one, for gamma distributions of such mean and variance; without variance all or none."""
    varied = (variance > 1e-12) & (mean > 0)
    safe_mean, safe_var = np.where(varied, mean, 1.0), np.where(varied, variance, 1.0)
    return np.where(varied, upper_gamma(safe_mean**2 / safe_var, np.maximum(score, 0) * safe_mean / safe_var), (mean > score).astype(float))


def _cutoff(wanted: np.ndarray, all_: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """The score that so many of all_ documents exceed, 0 where there are not so many."""
    low, high = np.zeros(len(mean)), mean + 60 * np.sqrt(np.maximum(variance, 0)) + 1e-9
    share = np.where(all_ > 0, wanted / np.maximum(all_, 1e-300), 2.0)
    for _ in range(80):
        middle = (low + high) / 2
        more = _above(middle, mean, variance) > share
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return np.where(share >= 1, 0.0, high)


def _query_features(queries: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: mean and variance of a query's score, and how many documents are likely to have all its terms."""
    own = queries.select("qid", "term").join(found, "term")
    none = F.exp(F.sum(F.log1p(-F.least(F.col("df") / F.col("n_docs"), F.lit(1 - 1e-12)))))
    any_ = F.first("n_docs") * (1 - none)
    sums = own.groupBy(*keys).agg(F.sum("mean").alias("mean"), F.sum("variance").alias("variance"), any_.alias("any"), F.sum(F.log("df")).alias("log_df"), F.count("*").alias("n"))
    return sums.withColumn("all", F.col("any") * F.exp(F.col("log_df") - F.col("n") * F.log("any"))).select(*keys, "mean", "variance", "all")


def thresholds(queries: DataFrame, found: DataFrame, n_docs: DataFrame, k: int = 10) -> DataFrame:
    """(qid, cutoff): the score of rank k that gamma distributions of the terms' scores give; found is (term, mean, variance, df), n_docs one row."""
    own = _query_features(queries, found.crossJoin(F.broadcast(n_docs.select("n_docs"))), ["qid"])

    @F.pandas_udf("double")
    def cutoff(mean: pd.Series, variance: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series(_cutoff(np.full(len(mean), float(k)), every.to_numpy(), mean.to_numpy(), variance.to_numpy()))

    return own.select("qid", cutoff("mean", "variance", "all").alias("cutoff"))


def scores(queries: DataFrame, whole: DataFrame, n_docs: DataFrame, parts: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """(qid, shard_id, score, rank): how many of the best k documents each shard is likely to hold.

    whole (term, mean, variance, df) is of the collection, parts the same by shard_id, sizes (shard_id, n_docs). A
    query without any known term scores 0 in every shard.
    """
    limit = thresholds(queries, whole, n_docs, k)
    own = _query_features(queries, parts.join(sizes, "shard_id"), ["qid", "shard_id"]).join(limit, "qid")

    @F.pandas_udf("double")
    def above(cutoff: pd.Series, mean: pd.Series, variance: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series(every.to_numpy() * _above(cutoff.to_numpy(), mean.to_numpy(), variance.to_numpy()))

    raw = own.select("qid", "shard_id", above("cutoff", "mean", "variance", "all").alias("raw"))
    every = queries.select("qid").distinct().crossJoin(sizes.select("shard_id")).join(raw, ["qid", "shard_id"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    total = F.sum("raw").over(Window.partitionBy("qid"))
    score = F.when(total > 0, F.col("raw") / total * k).otherwise(F.lit(0.0))
    scored = every.select("qid", "shard_id", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "shard_id")).cast("bigint"))
