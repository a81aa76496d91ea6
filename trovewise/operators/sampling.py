"""Samples of an index by hashes, which repeat exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index, dense_ids
from .reorder import mixed


def postings(index: Index, rate: float, seed: int = 0) -> Index:
    """The part `rate` of every term's postings, rounded up."""
    at = F.row_number().over(Window.partitionBy("term").orderBy(mixed("doc_id", seed), "doc_id"))
    own = index.postings.withColumn("at", at).withColumn("n", F.count("*").over(Window.partitionBy("term")))
    return index.with_postings(own.filter(F.col("at") <= F.ceil(F.col("n") * F.lit(rate))).drop("at", "n"))


def documents(index: Index, rate: float, seed: int = 0) -> Index:
    """The postings of the part `rate` of the documents, rounded up; documents keep their sizes."""
    chosen = sampled_ids(index.docs, rate, seed)
    return index.with_postings(index.postings.join(chosen, "doc_id", "left_semi").select(*index.postings.columns))


def sampled_ids(docs: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    ordered = dense_ids(docs.select("doc_id", mixed("doc_id", seed).alias("at")), ["at", "doc_id"], "place")
    wanted = docs.agg(F.ceil(F.count("*") * F.lit(rate)).alias("wanted"))
    return ordered.crossJoin(F.broadcast(wanted)).filter(F.col("place") < F.col("wanted")).select("doc_id")


def emptied(before: Index, after: Index) -> DataFrame:
    """(term): the terms of which a sample has no posting left."""
    return before.terms.select("term").join(after.terms.select("term"), "term", "left_anti")
