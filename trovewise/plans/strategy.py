"""The choice of a retrieval strategy, and timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import search as retrieval


def choose(bounds: DataFrame, queries: DataFrame, worthwhile: float = 0.5) -> str:
    """maxscore where essential lists hold less than such a part of the queries' postings, else the exhaustive plan.

    bounds is (term, max_score, kth_score, df); one aggregate over the query terms decides.
    """
    marked = retrieval.essential(queries, bounds).join(bounds.select("term", "df"), "term")
    row = marked.agg(F.sum(F.when(F.col("essential"), F.col("df"))).alias("some"), F.sum("df").alias("every")).first()
    return "maxscore" if (row.every or 0) and (row.some or 0) < worthwhile * row.every else "ranked_or"


def search(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """The top k by the chosen strategy; scores must never be negative."""
    bounds = ix.score_bounds(postings, k).join(postings.groupBy("term").agg(F.count("*").alias("df")), "term")
    bounds = bounds.join(queries.select("term").distinct(), "term", "left_semi")
    return retrieval.maxscore(queries, postings, k, bounds) if choose(bounds, queries) == "maxscore" else retrieval.ranked_or(queries, postings, k)


def timed(run: Callable[[], DataFrame], runs: int = 3) -> list[float]:
    """Seconds of several runs after one that isn't counted; results go nowhere."""
    out = []
    for at in range(runs + 1):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if at:
            out.append(time.perf_counter() - began)
    return out


def summary(times: list[list[float]]) -> dict[str, dict[str, float]]:
    """Mean and percentiles over queries, for every run by itself (none) and for the least, mean, median and most of each query's runs."""
    ways = {"none": lambda t: t, "min": lambda t: [min(t)], "mean": lambda t: [sum(t) / len(t)], "median": lambda t: [sorted(t)[len(t) // 2]], "max": lambda t: [max(t)]}
    out = {}
    for name, way in ways.items():
        own = sorted(x for t in times for x in way(t))
        out[name] = {"mean": sum(own) / len(own)} | {f"q{p}": own[min(len(own) - 1, p * len(own) // 100)] for p in (50, 90, 95, 99)}
    return out
