"""Exact quantiles of many columns without a sort: the interval around each rank is narrowed by counts until one value is left."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint

#: Buckets that an interval is cut into in each pass.
BUCKETS = 1024


def exact(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles at `shares` (0 to 1), interpolated between the two values next to the rank.

    Nulls, NaN and infinite values are left out; a column without others has None. Each pass counts the values of the
    intervals that still hold more than one value, by BUCKETS even parts whose own least and greatest values bound the
    next interval, so no rounding moves a rank. What is shuffled and what reaches the driver are counts: at most
    BUCKETS rows for each column and share and pass; passes are few, as each divides an interval by BUCKETS.
    """
    number = lambda c: F.col(c).cast("double")
    one = [F.struct(F.lit(k).alias("c"), F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c)).alias("v")) for k, c in enumerate(columns)]
    if not one:
        return {}
    values = checkpoint(df.select(F.explode(F.array(*one)).alias("x")).select("x.*").where("v is not null"))
    ends = {r.c: (r.n, r.lo, r.hi) for r in values.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    # A rank within an interval: (column, least, greatest) -> ranks, counted from the interval's start.
    todo: dict[tuple[int, float, float], list[tuple[tuple[int, int], int]]] = {}
    at: dict[tuple[int, int], float] = {}
    for c, (n, lo, hi) in ends.items():
        ranks = {f((n - 1) * s) for s in shares for f in (floor, ceil)}
        todo[c, lo, hi] = [((c, k), k) for k in ranks]
    while todo:
        for key in [k for k in todo if k[1] == k[2]]:
            at |= {name: key[1] for name, _ in todo.pop(key)}
        if not todo:
            break
        spans = df.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(todo)], "i int, c int, lo double, hi double")
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        met = values.join(F.broadcast(spans), "c").where("v between lo and hi").groupBy("i", part.alias("part"))
        counted: dict[int, list] = {}
        for r in met.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "part").collect():
            counted.setdefault(r.i, []).append(r)
        narrower: dict[tuple[int, float, float], list[tuple[tuple[int, int], int]]] = {}
        for i, (key, ranks) in enumerate(todo.items()):
            for name, k in ranks:
                for r in counted[i]:
                    if k < r.n:
                        narrower.setdefault((key[0], r.lo, r.hi), []).append((name, k))
                        break
                    k -= r.n
        todo = narrower

    def quantile(c: int, share: float) -> float | None:
        if c not in ends:
            return None
        rank = (ends[c][0] - 1) * share
        low, high = floor(rank), ceil(rank)
        return at[c, low] if low == high else (high - rank) * at[c, low] + (rank - low) * at[c, high]

    return {name: [quantile(c, s) for s in shares] for c, name in enumerate(columns)}
