"""Exact ranks, running totals and quantiles without sorting any whole group in one task.

Rows are range-partitioned by the sort key; each slice is sorted alone and shifted by the totals of
the slices before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.session import cut


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the md5 of the key, the same in every run and every engine."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def running_total(df: DataFrame, weight: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before`` and ``upto``: the totals of ``weight`` up to and without / with the row, inside ``by``."""
    sliced = cut(df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()))
    sums = sliced.groupBy(*by, "_slice").agg(F.sum(weight).alias("_w"))
    line = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select(*by, "_slice", F.coalesce(F.sum("_w").over(line), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        sliced.join(shift, [*by, "_slice"])
        .withColumn("upto", F.sum(weight).over(inside) + F.col("_shift"))
        .withColumn("before", F.col("upto") - F.col(weight))
        .drop("_slice", "_shift")
    )


def dense_rank(df: DataFrame, order: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: how many distinct values of ``order`` inside ``by`` are less than the row's, from 0 on."""
    distinct = df.select(*by, *order).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return df.join(running_total(distinct, "_one", order, by).select(*by, *order, F.col("before").alias(name)), [*by, *order])


def average_rank(df: DataFrame, col: str) -> DataFrame:
    """``(col, rank)``: the mean rank of each value among all rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, "_n", [col]).select(col, (F.col("before") + (F.col("_n") + 1) / 2).alias("rank"))


def group_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation -> ``(by, q array<double>)`` in the order of ``probs``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, "_n", [col], by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("total"))
    placed = ranked.join(sizes, list(by))
    picks = []
    for i, p in enumerate(probs):
        spot = (F.col("total") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            picks.append(F.max(F.when((F.col("before") <= pos) & (pos < F.col("upto")), F.col(col))).alias(f"_{tag}{i}"))
    out = placed.groupBy(*by).agg(F.first("total").alias("total"), *picks)
    qs = []
    for i, p in enumerate(probs):
        spot = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        qs.append(lo + (hi - lo) * (spot - F.floor(spot)))
    return out.select(*by, F.array(*qs).alias("q"))
