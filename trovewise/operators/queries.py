"""Queries: parsing, weights, filters, mapping to ids. A query is rows (qid, pos, term, weight) by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, split_query
from .index import Index
from .search import and_or_counts


def parse(lines: DataFrame, analyzer: Analyzer = Analyzer(), query: str = "query", qid: str | None = None) -> DataFrame:
    """(qid, pos, term) of query texts. Without a column for it, qid is what stands before the first colon."""
    if qid is None:
        name, rest = split_query(F.col(query))
        lines = lines.select(name.alias("qid"), rest.alias("rest"))
    else:
        lines = lines.select(F.col(qid).alias("qid"), F.col(query).alias("rest"))
    return lines.select("qid", F.posexplode(analyzer(F.col("rest"))).alias("pos", "term"))


def parse_ids(lines: DataFrame, query: str = "query") -> DataFrame:
    """(qid, pos, term_id) of queries that are numbers between white space."""
    name, rest = split_query(F.col(query))
    own = F.regexp_extract_all(rest, F.lit(r"[0-9]+"), F.lit(0))
    return lines.select(name.alias("qid"), F.posexplode(own).alias("pos", "t")).select("qid", "pos", F.col("t").cast("bigint").alias("term_id"))


def weighted(parsed: DataFrame, policy: str = "count") -> DataFrame:
    """(qid, pos, term, weight), each term once a query at its first position.

    The policy count gives it the number of its occurrences as weight, unweighted 1; keep leaves repeats, each of
    weight 1; sort is count with positions by the term's order.
    """
    if policy == "keep":
        return parsed.withColumn("weight", F.lit(1.0))
    weight = F.lit(1.0) if policy == "unweighted" else F.count("*").cast("double")
    own = parsed.groupBy("qid", "term").agg(F.min("pos").cast("bigint").alias("pos"), weight.alias("weight"))
    if policy == "sort":
        own = own.withColumn("pos", (F.row_number().over(Window.partitionBy("qid").orderBy("term")) - 1).cast("bigint"))
    elif policy not in ("count", "unweighted"):
        raise ValueError(f"unknown policy: {policy}")
    return own.select("qid", "pos", "term", "weight")


def known(queries: DataFrame, index: Index) -> DataFrame:
    """queries without the terms that the index lacks."""
    return queries.join(index.terms.select("term"), "term", "left_semi").select(*queries.columns)


def of_size(queries: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """The queries with so many different terms."""
    sizes = queries.groupBy("qid").agg(F.count_distinct("term").alias("n")).filter(F.col("n") >= least)
    return queries.join(sizes if most is None else sizes.filter(F.col("n") <= most), "qid", "left_semi").select(*queries.columns)


def mapped(parsed: DataFrame, lexicon: DataFrame, separator: str = "\t", with_id: bool = False) -> DataFrame:
    """(qid, ids): each query as its known terms' ids in order, joined; with its id and a colon before them if asked."""
    own = parsed.join(lexicon, "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term_id"))).alias("all"))
    ids = F.array_join(F.transform("all", lambda x: x["term_id"].cast("string")), separator)
    return own.select("qid", (F.concat(F.col("qid").cast("string"), F.lit(":"), ids) if with_id else ids).alias("ids"))


def stemmed(lines: DataFrame, stemmer: str = "porter2", query: str = "query", qid: str = "qid") -> DataFrame:
    """(qid, stems): each query as the stems of its words, joined by spaces."""
    tokens = Analyzer(filters=("lowercase", stemmer))(F.col(query))
    return lines.select(F.col(qid).alias("qid"), F.array_join(tokens, " ").alias("stems"))


def selective(queries: DataFrame, index: Index, most: float = 0.005) -> DataFrame:
    """(qid, n_and, n_or): queries of whose documents with any term less than so large a part has all."""
    counts = and_or_counts(queries.select("qid", "term").distinct(), index.postings).select("qid", "n_and", "n_or")
    return counts.filter(F.col("n_and") < most * F.col("n_or"))


def posting_counts(queries: DataFrame, index: Index, total: bool = False) -> DataFrame:
    """(qid, pos, term, df) of the known terms, or (qid, postings), their sum."""
    own = queries.join(index.terms, "term")
    return own.groupBy("qid").agg(F.sum("df").alias("postings")) if total else own.select("qid", "pos", "term", "df")


def query_max_scores(queries: DataFrame, maxima: DataFrame) -> DataFrame:
    """(qid, pos, term, max_score) of the known terms."""
    return queries.join(maxima, "term").select("qid", "pos", "term", "max_score")
