"""Exact order statistics and quantile keys without sorting a column in one task.

A rank is found by narrowing its interval of values: each round counts the values of
every open interval in 1,024 bins, with each bin's smallest and largest value, and
keeps the bin that holds the rank. A bin of one distinct value ends the search. One
pass a round serves all ranks, and ties and skewed values only make it shorter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Quantile keys have ten bins.
TENTHS = tuple(k / 10 for k in range(1, 10))


def _finite(column: str) -> Column:
    v = F.col(column).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some places (from 0) of the sorted column; nulls and values that aren't finite take no part.

    What reaches the driver is at most 1,024 counts an open interval a round; there is one interval a rank at most.
    """
    values = df.select(_finite(column).alias("v")).where("v is not null")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    # interval: (smallest, largest, values before it, ranks in it)
    open_ = [(low, high, 0, sorted(set(ranks)))] if ranks and low is not None else []
    while open_:
        for a, b, _, own in open_:
            if a == b:
                found.update(dict.fromkeys(own, a))
        open_ = [x for x in open_ if x[0] != x[1]]
        if not open_:
            break
        where, bin_ = F, F
        for k, (a, b, _, _) in enumerate(open_):
            inside = F.col("v").between(a, b)
            # halves keep the width of the widest intervals finite; a difference of zero leaves only the two ends
            share = (F.col("v") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) if b / 2 - a / 2 > 0 else F.lit(0.0)
            where = where.when(inside, k)
            bin_ = bin_.when(inside & (F.col("v") == b), BINS - 1).when(inside, F.least(F.floor(share * (BINS - 1)), F.lit(BINS - 2)).cast("int"))
        counted = values.select("v", where.alias("k"), bin_.alias("bin")).where("k is not null").groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        narrowed = []
        for k, (_, _, before, own) in enumerate(open_):
            left, at = list(own), before
            for r in sorted((x for x in counted if x.k == k), key=lambda x: x.bin):
                here = [x for x in left if x < at + r.n]
                if here:
                    narrowed.append((r.a, r.b, at, here))
                    left = left[len(here) :]
                at += r.n
        open_ = narrowed
    return found


def quantile_edges(df: DataFrame, column: str, shares: tuple[float, ...] = TENTHS) -> list[float]:
    """Quantiles with linear interpolation between the two neighbours, in the order of ``shares``; none of an empty column."""
    n = df.where(_finite(column).isNotNull()).count()
    if not n:
        return []
    places = [(n - 1) * q for q in shares]
    values = order_statistics(df, column, [x for p in places for x in (math.floor(p), min(math.floor(p) + 1, n - 1))])
    edges = []
    for p in places:
        a, b, t = values[math.floor(p)], values[min(math.floor(p) + 1, n - 1)], p - math.floor(p)
        edges.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return edges


def quantile_keys(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the decile of a value as ``q0`` to ``q9``: how many edges are at most the value. Missing and not finite values are ``None``."""
    edges = quantile_edges(df, column)
    at = sum((F.when(_finite(column) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(name, F.when(_finite(column).isNull(), "None").otherwise(F.concat(F.lit("q"), at.cast("string"))))


def stratum_keys(df: DataFrame, column: str, name: str) -> DataFrame:
    """Strata of any column: vectors as they are (a missing one is all zeros, of width 0 the empty text), floating values by decile, others as text.

    Vectors of several widths are an error.
    """
    kind = dict(df.dtypes)[column]
    if kind.startswith("array"):
        widths = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.size(column).alias("w")).distinct().limit(3).collect()]
        if len(widths) > 1:
            raise ValueError(f"vectors have several widths: {sorted(widths)}")
        if widths and widths[0] > 0:
            return df.withColumn(name, F.coalesce(F.col(column), F.array_repeat(F.lit(0), widths[0]).cast(kind)).cast("string"))
        return df.withColumn(name, F.coalesce(F.array_join(F.col(column).cast("array<string>"), ","), F.lit("None")))
    if kind in ("double", "float") and not df.where(F.col(column).isNotNull()).limit(1).isEmpty():
        return quantile_keys(df, column, name)
    return df.withColumn(name, F.coalesce(F.col(column).cast("string"), F.lit("None")))
