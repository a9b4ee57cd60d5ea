"""Reproducible splits and weighted draws. Order comes from a hash of the key, never from partition layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.operators.ranks import running_total, unit_hash
from lineweave.session import cut


def stratified_split(df: DataFrame, group: str, key: str, frac: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: in each group the first round(n * frac) keys in hash order are ``val``, at least one and never all."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(df.withColumns({"_h": unit_hash(F.col(key), seed=seed), "_one": F.lit(1).cast("bigint")}), "_one", ["_h", key], [group])
    want = F.when((F.col("_n") < 2) | F.lit(frac <= 0.0), 0).otherwise(
        F.least(F.greatest(F.bround(F.col("_n") * F.lit(float(frac))).cast("long"), F.lit(1)), F.col("_n") - 1))
    return ranked.join(n, group).withColumn("part", F.when(F.col("upto") <= want, "val").otherwise("train")).select(*df.columns, "part")


def split_by_source(df: DataFrame, source: str, frac: float, seed: int = 0) -> DataFrame:
    """Adds ``part`` so that no source lies in two parts."""
    sources = df.select(source).distinct().withColumn("_all", F.lit(1))
    parts = stratified_split(sources, "_all", source, frac, seed).select(source, "part")
    return df.join(parts, source)


def leaks(parts: DataFrame, source: str) -> DataFrame:
    """Sources that occur in more than one part."""
    return parts.groupBy(source).agg(F.countDistinct("part").alias("n")).where("n > 1")


def balance_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``weight``: the product of 1 / group size over the given columns."""
    out = df
    for i, c in enumerate(columns):
        out = out.join(df.groupBy(c).agg(F.count(F.lit(1)).alias(f"_n{i}")), c)
    w = F.lit(1.0)
    for i, _ in enumerate(columns):
        w = w / F.col(f"_n{i}")
    return out.select(*df.columns, w.alias("weight"))


def weighted_resample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement -> the rows drawn, with ``draw``.

    Rows start at their running weight, draws are points, and each draw takes the last row that starts at or before it.
    Both lie on one line, cut into slices; a slice hands its last row on, so neither a heavy row nor a crowd of draws
    meets in one task."""
    cum = cut(running_total(df.where(F.col(weight) > 0), weight, [key]))
    total = float(cum.agg(F.max("upto")).first()[0] or 0.0)
    row = F.struct(*df.columns)
    starts = cum.select(F.col("before").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("draw"), row.alias("_row"))
    draws = df.sparkSession.range(n).select((unit_hash(F.col("id"), seed=seed) * total).alias("_at"), F.lit(1).alias("_kind"), F.col("id").alias("draw"))
    line = starts.unionByName(draws, allowMissingColumns=True)
    sliced = cut(line.repartitionByRange("_at", "_kind").withColumn("_slice", F.spark_partition_id()))
    ends = sliced.groupBy("_slice").agg(F.max_by(F.col("_row"), F.when(F.col("_kind") == 0, F.col("_at"))).alias("_end"))
    handed = ends.select("_slice", F.last("_end", ignorenulls=True).over(W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_handed"))
    inside = F.last("_row", ignorenulls=True).over(W.partitionBy("_slice").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    met = sliced.withColumn("_own", inside).where("_kind = 1").join(handed, "_slice").withColumn("_hit", F.coalesce("_own", "_handed"))
    return met.select("draw", *[F.col(f"_hit.{c}").alias(c) for c in df.columns])
