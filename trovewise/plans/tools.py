"""Whole jobs by name: index a collection, add scoring metadata, answer queries; and the command line over them.

    python -m trovewise index --format jsonl collection.jsonl index
    python -m trovewise query index topics.txt run
    python -m trovewise stats index
"""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import Analyzer
from ..operators import index as ix
from ..operators import queries, search
from ..sources import collections, indexes, runs
from . import strategy

ALGORITHMS = {
    "ranked_or": search.ranked_or, "ranked_and": search.ranked_and, "ranked_or_taat": search.term_at_a_time, "ranked_or_taat_lazy": search.term_at_a_time, "wand": search.wand, "maxscore": search.maxscore,
    "block_max_wand": search.block_max_wand, "block_max_maxscore": search.block_max_maxscore, "block_max_ranked_and": search.block_max_ranked_and, "range": search.by_range, "auto": strategy.search,
}
DEFAULT = Analyzer(filters=("lowercase", "porter2"))


def index_collection(spark: SparkSession, source: str, path: str, format: str = "plaintext", analyzer: Analyzer = DEFAULT, encoding: str = "block_simdbp", check: bool = False) -> ix.Index:
    """Reads a collection, writes its documents and its index under a path, and returns the index."""
    docs = collections.read(spark, source, format)
    docs.select("doc_id", "title", "url").write.parquet(f"{path}/titles")
    indexes.save_collection(docs, path, analyzer, text="content", encoding=encoding, check=check)
    return indexes.load(spark, path)


add_metadata = indexes.save_bounds


def answer(spark: SparkSession, path: str, lines: DataFrame, analyzer: Analyzer = DEFAULT, algorithm: str = "block_max_wand", scorer: str = "bm25", k: int = 10, weighted: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank) for lines (query)."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}; known: {', '.join(ALGORITHMS)}")
    own = indexes.load(spark, path)
    topics = queries.known(queries.weighted(queries.parse(lines, analyzer), "count" if weighted else "unweighted"), own)
    run = ALGORITHMS[algorithm]
    wanted = set(inspect.signature(run).parameters)
    stored = {name: table for name, table in indexes.load_bounds(spark, path, scorer, k).items() if name in wanted}
    return run(topics, ix.scored(ix.of_terms(own, topics), scorer), k=k, **stored)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trovewise")
    tools = parser.add_subparsers(dest="tool", required=True)
    own = tools.add_parser("index")
    own.add_argument("source"), own.add_argument("path")
    own.add_argument("--format", default="plaintext", choices=sorted(collections.FORMATS))
    own.add_argument("--encoding", default="block_simdbp", choices=sorted(indexes.ENCODINGS))
    own.add_argument("--check", action="store_true")
    own = tools.add_parser("query")
    own.add_argument("path"), own.add_argument("queries"), own.add_argument("out")
    own.add_argument("--algorithm", default="block_max_wand", choices=sorted(ALGORITHMS))
    own.add_argument("--scorer", default="bm25")
    own.add_argument("-k", type=int, default=10)
    own.add_argument("--weighted", action="store_true")
    own.add_argument("--run", default="trovewise")
    own = tools.add_parser("stats")
    own.add_argument("path")
    for own in tools.choices.values():
        own.add_argument("--tokenizer", default="english")
        own.add_argument("--filters", default="lowercase,porter2")
        own.add_argument("--html", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("trovewise").getOrCreate()
    analyzer = Analyzer(a.tokenizer, tuple(x for x in a.filters.split(",") if x), strip_html=a.html)
    if a.tool == "index":
        index_collection(spark, a.source, a.path, a.format, analyzer, a.encoding, a.check)
    elif a.tool == "query":
        found = answer(spark, a.path, spark.read.text(a.queries).withColumnRenamed("value", "query"), analyzer, a.algorithm, a.scorer, a.k, a.weighted)
        runs.write(found, a.out, a.run, spark.read.parquet(f"{a.path}/titles"))
    else:
        print(json.dumps(indexes.load(spark, a.path).stats.first().asDict() | indexes.size_stats(spark, a.path) | indexes.about(spark, a.path)))


if __name__ == "__main__":
    main()
