"""Scores of a term in a document, and their quantisation, as Column expressions in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facts:
    """What a scorer may look at: counts of the posting, its document, its term and the collection."""

    tf: Column
    doc_len: Column
    df: Column
    cf: Column
    n_docs: Column
    coll_len: Column
    avg_len: Column


def facts(**names: str) -> Facts:
    return Facts(**{k: F.col(names.get(k, k)).cast("double") for k in Facts.__dataclass_fields__})


def bm25(x: Facts, b: float = 0.4, k1: float = 0.9) -> Column:
    idf = F.greatest(F.lit(1e-6), F.log((x.n_docs - x.df + 0.5) / (x.df + 0.5)))
    return idf * (1 + k1) * (x.tf / (x.tf + k1 * (1 - b + b * x.doc_len / x.avg_len)))


def qld(x: Facts, mu: float = 1000.0) -> Column:
    return F.greatest(F.lit(0.0), F.log(mu / (x.doc_len + mu)) + F.log1p(x.tf * x.coll_len / (mu * x.cf)))


def pl2(x: Facts, c: float = 1.0) -> Column:
    tfn = x.tf * F.log2(1 + c * x.avg_len / x.doc_len)
    rare, e = x.cf / x.n_docs, math.log(0.5)
    return (tfn * F.log2(1 / rare) + rare * e + 0.5 * F.log2(2 * math.pi * tfn) + tfn * (F.log2(tfn) - e)) / (tfn + 1)


def dph(x: Facts) -> Column:
    """Undefined, hence null, for a document of nothing but the term."""
    p = x.tf / x.doc_len
    score = F.pow(1 - p, 2) / (x.tf + 1) * (x.tf * F.log2(x.tf * x.avg_len / x.doc_len * (x.n_docs / x.cf)) + 0.5 * F.log2(2 * math.pi * x.tf * (1 - p)))
    return F.when(x.tf < x.doc_len, score)


def quantized(x: Facts) -> Column:
    """The stored value is the score."""
    return x.tf


SCORERS: dict[str, Callable[..., Column]] = {"bm25": bm25, "qld": qld, "pl2": pl2, "dph": dph, "quantized": quantized}
#: Scorers that never give less than 0, for which sums of maxima are bounds.
BOUNDED = {"bm25", "qld", "quantized"}


def scorer(name: str, **parameters: float) -> Callable[[Facts], Column]:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer: {name}; known: {', '.join(SCORERS)}")
    return lambda x: SCORERS[name](x, **parameters)


def quantize(score: Column, most: Column, bits: int = 8) -> Column:
    """A whole number from 1 to 2^bits - 1 in proportion to score, which is from 0 to most.

    Rounded to 9 places before it is cut, so that scores that differ by the order of sums are cut alike.
    """
    if not 2 <= bits <= 32:
        raise ValueError("bits must be from 2 to 32")
    return (F.floor(F.round(F.least(score, most) / most * (2.0**bits - 2), 9)) + 1).cast("bigint")


def dequantize(value: Column, most: Column, bits: int = 8) -> Column:
    return (value + 1) / (2.0**bits) * most
