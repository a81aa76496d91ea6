"""Lexicons and lookup tables: numbered payloads (idx, value), found by number or by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import dense_ids


def build(values: DataFrame, value: str = "value", ordered: bool = True, position: str | None = None) -> DataFrame:
    """(idx, value). Ordered tables number values in byte order, others by their position; values must differ."""
    repeated = values.groupBy(value).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"value occurs twice: {repeated[0][0]!r}")
    if ordered:
        return dense_ids(values.select(F.col(value).alias("value")), ["value"], "idx").select("idx", "value")
    return dense_ids(values.select(F.col(value).alias("value"), F.col(position).alias("position")), ["position"], "idx").select("idx", "value")


def check_sorted(table: DataFrame) -> None:
    """Raises ValueError unless the values of (idx, value) strictly increase; every row is compared with the next by a join."""
    following = table.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("next"))
    if not table.join(following, "idx").filter(F.col("next") <= F.col("value")).isEmpty():
        raise ValueError("values are not sorted")


def at(table: DataFrame, idx: int) -> DataFrame:
    return table.filter(F.col("idx") == idx)


def between(table: DataFrame, first: int = 0, last: int | None = None, count: int | None = None) -> DataFrame:
    """Rows from a number on, to a last one inclusive, or so many."""
    last = first + count - 1 if count is not None else last
    own = table.filter(F.col("idx") >= first)
    return own if last is None else own.filter(F.col("idx") <= last)


def find(table: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """values with idx, null where the table lacks one."""
    return values.join(table.select(F.col("value").alias(value), "idx"), value, "left")


def named(ids: DataFrame, table: DataFrame, idx: str = "idx") -> DataFrame:
    """ids with value, null where the table has none."""
    return ids.join(table.select(F.col("idx").alias(idx), "value"), idx, "left")
