"""Documents that keep arriving: every micro-batch is inverted and appended to a table of postings.

This is an extension: indexes are otherwise built of whole collections. Batches are written by number and overwrite
what an earlier try of the same batch left, so a repeated batch does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Analyzer
from ..operators import index as ix

SCHEMA = "doc_id long, text string"


def start(documents: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = Analyzer()) -> StreamingQuery:
    """Begins to index a stream of (doc_id, text) into path; it ends when what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        forward = ix.forward_index(batch, analyzer)
        ix.invert(forward).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        ix.doc_sizes(forward).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index(spark: SparkSession, path: str) -> ix.Index:
    """The index of all batches so far; of a document that came twice, the later batch counts."""
    docs = spark.read.parquet(f"{path}/docs")
    last = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    own = docs.join(last, ["doc_id", "batch"]).select("doc_id", "doc_len")
    postings = spark.read.parquet(f"{path}/postings").join(last, ["doc_id", "batch"]).select("term", "doc_id", "tf", "doc_len")
    return ix.Index(postings, own, ix.term_stats(postings), ix.collection_stats(own))
