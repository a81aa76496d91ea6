"""Indexes on disk: Parquet, sorted so that row groups prune by term, with a JSON note of how they were made."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..operators import index as ix
from ..storage import checkpointed

#: Encodings of posting lists that callers may name; they are a matter of Parquet's here: the codec that compresses pages.
ENCODINGS = {
    "block_interpolative": "zstd", "block_maskedvbyte": "snappy", "block_optpfor": "zstd", "block_qmx": "snappy", "block_simdbp": "snappy", "block_simple16": "zstd", "block_simple8b": "zstd", "block_streamvbyte": "snappy",
    "block_varintg8iu": "snappy", "block_varintgb": "snappy", "ef": "zstd", "single": "zstd", "pefuniform": "zstd", "pefopt": "zstd",
}


#: Parts of a table whose digests are compared.
BUCKETS = 1 << 12


def temporary(folder: str) -> str:
    return f"{folder}/index-{uuid.uuid4().hex}"


def save(index: ix.Index, path: str, encoding: str = "block_simdbp", quantize_bits: int | None = None, scorer: str | None = None, check: bool = False) -> None:
    """Writes postings, docs, terms and stats under a path.

    Postings are range-partitioned and sorted by term and document, so a query reads the row groups of its terms.
    With quantize_bits they have the column value, the quantised score of a scorer. check reads all back and compares.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding: {encoding}")
    if quantize_bits and not scorer:
        raise ValueError("quantising needs a scorer")
    spark, postings = index.docs.sparkSession, index.postings
    if quantize_bits:
        postings = ix.quantize(ix.scored(index, scorer), quantize_bits).select("term", "doc_id", "tf", "doc_len", "value")
    ordered = postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    ordered.write.option("compression", ENCODINGS[encoding]).parquet(f"{path}/postings")
    index.docs.write.parquet(f"{path}/docs")
    # Counted from what is written: there a term's postings are together, so that little of them is moved.
    terms = ix.term_stats(spark.read.parquet(f"{path}/postings"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    index.stats.write.parquet(f"{path}/stats")
    note = {"encoding": encoding, "quantize_bits": quantize_bits, "scorer": scorer}
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(f"{path}/about")
    if check and not differing(postings, load(spark, path).postings).isEmpty():
        raise ValueError("what was written differs from the index")


def save_counts(docs: DataFrame, path: str, analyzer: Analyzer = Analyzer(), doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes each document's counted terms under a path."""
    ix.counted_documents(ix.spread(docs), analyzer, doc_id, text).write.parquet(f"{path}/forward")


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/forward")


def save_collection(docs: DataFrame, path: str, analyzer: Analyzer = Analyzer(), doc_id: str = "doc_id", text: str = "text", **how) -> None:
    """Analyses a collection once: writes each document's counted terms under a path, and inverts what was written."""
    save_counts(docs, path, analyzer, doc_id, text)
    save(ix.from_counts(load_counts(docs.sparkSession, path)), path, **how)


def save_bounds(spark: SparkSession, path: str, scorer: str = "bm25", k: int = 1000, block_size: int | None = 64, penalty: float | None = None) -> None:
    """Writes list bounds, block maxima and range maxima of a scorer beside an index; exactly one of block_size and penalty is given."""
    if (block_size is None) == (penalty is None):
        raise ValueError("exactly one of block_size and penalty")
    scored = checkpointed(ix.scored(load(spark, path), scorer))
    blocks = ix.fixed_blocks(scored, block_size) if block_size is not None else ix.variable_blocks(scored, penalty)
    for name, table in {"bounds": ix.score_bounds(scored, k), "blocks": blocks, "ranges": ix.range_maxima(scored)}.items():
        table.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{scorer}/{name}")
    spark.createDataFrame([(json.dumps({"k": k, "block_size": block_size, "penalty": penalty}),)], "value string").coalesce(1).write.text(f"{path}/{scorer}/about")


def load_bounds(spark: SparkSession, path: str, scorer: str = "bm25", k: int = 10) -> dict[str, DataFrame]:
    """The stored bounds, blocks and ranges of a scorer; none where they were not made, or for fewer results than k."""
    try:
        note = json.loads(spark.read.text(f"{path}/{scorer}/about").first().value)
    except AnalysisException:
        return {}
    return {name: spark.read.parquet(f"{path}/{scorer}/{name}") for name in ("bounds", "blocks", "ranges")} if note["k"] >= k else {}


def load(spark: SparkSession, path: str) -> ix.Index:
    return ix.Index(*[spark.read.parquet(f"{path}/{part}") for part in ("postings", "docs", "terms", "stats")])


def about(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/about").first().value)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, counting repeats.

    Rows are compared exactly within buckets whose digests differ: the number of their rows and three sums of hashes, of 93
    bits together. So tables that are alike are read and not moved.
    """
    columns = a.columns
    b = b.select(*columns)
    bucket = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)))
    digest = lambda df, name: bucket(df).groupBy("bucket").agg(F.count("*").alias("n"), *[F.expr(f"sum(CAST(pmod(xxhash64({seed}, {', '.join(f'`{c}`' for c in columns)}), {1 << 31}) AS BIGINT))").alias(f"s{seed}") for seed in (1, 2, 3)]).withColumn("of", F.lit(name))
    every = digest(a, "a").unionByName(digest(b, "b"))
    unlike = every.groupBy("bucket").agg(F.count("*").alias("sides"), *[F.count_distinct(c).alias(c) for c in ("n", "s1", "s2", "s3")]).filter("sides < 2 OR n > 1 OR s1 > 1 OR s2 > 1 OR s3 > 1").select("bucket")
    some = lambda df: bucket(df).join(F.broadcast(unlike), "bucket", "left_semi").select(*columns)
    return some(a).exceptAll(some(b)).unionByName(some(b).exceptAll(some(a)))


def size_stats(spark: SparkSession, path: str) -> dict[str, float]:
    """Bytes of the postings on disk and bits a posting."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/postings")
    size, n = files.agg(F.sum("length")).first()[0] or 0, spark.read.parquet(f"{path}/postings").count()
    return {"bytes": size, "postings": n, "bits_per_posting": 8 * size / n if n else 0.0}
