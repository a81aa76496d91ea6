"""Documents to training tokens in five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the
shared folder and reads again as the next one's docs. All stages but the last return the columns of documents.

1. toxicity: documents that the conditional random field rejects go.
2. line_dedup: lines that occur before are cut out; a document of which nothing is left goes.
3. near_dedup: one document of each group of near copies stays, that of the least doc_id.
4. decontaminate: benchmark passages are cut out; their documents stay.
5. bpe: text is what its token ids decode to; tokens and n_tokens are added.

Defined cases: null, empty and wordless texts are not toxic, have no lines that repeat, are each a group of their own and
stay as they are; a null text has null tokens, an empty one none. Rows equal in doc_id and text count once from stage 3
on; of equal doc_ids with different texts each is a document. Texts of any length are handled whole. Other columns pass
through, n_chars follows changed texts, and tokens or n_tokens that are taken get a leading underscore. An empty table
gives an empty one. What the stages write on the way is deleted when the next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trovewise.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from trovewise.llm.shared import release, settled


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.add_tokens(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", with_tokens),
]

#: SQL expresses neither the trained field nor the merges; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if k:
            release(before)
    return docs
