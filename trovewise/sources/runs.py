"""Runs in the exchange format of evaluation campaigns, and files of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(results: DataFrame, run: str = "run", names: DataFrame | None = None) -> DataFrame:
    """(line): query, Q0, document, rank from 1, score and run, for results (qid, doc_id, score, rank); names (doc_id, title) give titles."""
    if names is not None:
        results = results.join(names.select("doc_id", "title"), "doc_id").drop("doc_id").withColumnRenamed("title", "doc_id")
    shown = F.format_string("%.4f", F.round("score", 4))
    return results.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), shown, F.lit(run)).alias("line"))


def write(results: DataFrame, path: str, run: str = "run", names: DataFrame | None = None) -> None:
    results = results.repartitionByRange("qid").sortWithinPartitions("qid", "rank")
    lines(results, run, names).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc, rank, score, run)."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).select(parts[0].alias("qid"), parts[2].alias("doc"), parts[3].cast("bigint").alias("rank"), parts[4].cast("double").alias("score"), parts[5].alias("run"))


def read_thresholds(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(qid, threshold) from a file of one number a line, in the order of the queries' ids; there must be as many."""
    found = [float(r.value) for r in spark.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("value")).collect() if r.value]
    ids = [r.qid for r in queries.select("qid").distinct().orderBy("qid").collect()]
    if len(found) != len(ids):
        raise ValueError(f"{len(found)} thresholds for {len(ids)} queries")
    kind = queries.schema["qid"].dataType.simpleString()
    return spark.createDataFrame(list(zip(ids, found)), f"qid {kind}, threshold double")
