"""Class fractions by scene and their correction for known confusion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.operators.metrics import interval, ratio
from lineweave.operators.ranks import average_rank

TYX = ("T", "Y", "X")


def normalized_confusion(cells: DataFrame, classes: Sequence[str] = TYX) -> DataFrame:
    """``(true_label, pred_label, p)`` with p = P(pred | true) over ``classes`` only; all cells are there."""
    grid = [(t, p) for t in classes for p in classes]
    full = cells.sparkSession.createDataFrame(grid, "true_label string, pred_label string").join(
        cells, ["true_label", "pred_label"], "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy("true_label"))
    return full.select("true_label", "pred_label", ratio(F.col("n"), total).alias("p"))


def matrix_of(normalized: DataFrame, classes: Sequence[str] = TYX) -> np.ndarray:
    """C[i, j] = P(pred i | true j) as 9 numbers on the driver."""
    cells = {(r["pred_label"], r["true_label"]): r["p"] for r in normalized.limit(len(classes) ** 2).collect()}
    return np.array([[cells[(i, j)] for j in classes] for i in classes])


def determinant(normalized: DataFrame, classes: Sequence[str] = TYX) -> DataFrame:
    """One row with the determinant of the 3 x 3 confusion."""
    at = {(i, j): F.max(F.when((F.col("pred_label") == i) & (F.col("true_label") == j), F.col("p")))
          for i in classes for j in classes}
    (a, b, c), (d, e, f), (g, h, i) = [[at[(r, k)] for k in classes] for r in classes]
    return normalized.agg((a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)).alias("det"))


def condition_number(c: np.ndarray) -> float:
    return float(np.linalg.cond(c))


def calibrated_fractions(df: DataFrame, observed: Sequence[str], c: np.ndarray, out: Sequence[str]) -> DataFrame:
    """Undo a 3 x 3 confusion on observed class shares.

    The plain inverse is used where it stays in the simplex. Otherwise the constrained least-squares optimum
    lies on an edge, so the best of the three clamped edge projections is the answer."""
    inv = np.linalg.inv(c)
    q = [F.col(k) for k in observed]
    free = [sum((float(inv[i, j]) * q[j] for j in range(3)), start=F.lit(0.0)) for i in range(3)]
    inside = F.array_min(F.array(*free)) >= -1e-10
    edges = [_edge(q, c, i, j) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.array_min(F.array(*edges))
    raw = F.when(inside, F.array(*[F.greatest(v, F.lit(0.0)) for v in free])).otherwise(best["p"])
    total = F.aggregate("_p", F.lit(0.0), lambda acc, v: acc + v)
    return (
        df.withColumn("_p", raw).withColumn("_t", total)
        .withColumns({name: F.get("_p", F.lit(i)) / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t"))
                      for i, name in enumerate(out)})
        .drop("_p", "_t")
    )


def _edge(q: Sequence[Column], c: np.ndarray, i: int, j: int) -> Column:
    """Residual and shares of the best mix of classes i and j."""
    span = c[:, i] - c[:, j]
    den = float(span @ span)
    num = sum(((q[k] - float(c[k, j])) * float(span[k]) for k in range(3)), start=F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den)) if den > 0 else F.lit(0.5)
    share = [F.lit(0.0)] * 3
    share[i], share[j] = t, 1.0 - t
    diff = [sum((float(c[k, m]) * share[m] for m in (i, j)), start=F.lit(0.0)) - q[k] for k in range(3)]
    res = sum((d * d for d in diff), start=F.lit(0.0))
    return F.struct(res.alias("res"), F.array(*share).alias("p"))


def scene_fractions(df: DataFrame, label: str, by: Sequence[str], scenes: DataFrame | None = None) -> DataFrame:
    """Class counts and fT = T / (T + Y + X) of each scene, with the scene's position."""
    c = {k: F.count_if(F.col(label) == k).alias(f"n_{k}") for k in "TYXN"}
    out = df.groupBy(*by).agg(*c.values())
    out = out.withColumn("f_t", ratio(F.col("n_T"), F.col("n_T") + F.col("n_Y") + F.col("n_X")))
    return out if scenes is None else out.join(scenes, list(by), "left")


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho as one row; ties share their mean rank."""
    rx = average_rank(df, x).withColumnRenamed("rank", "_rx")
    ry = average_rank(df, y).withColumnRenamed("rank", "_ry")
    return df.select(x, y).join(rx, x).join(ry, y).agg(F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def min_sample_size(estimates: DataFrame, by: Sequence[str], tolerance: float = 0.10) -> DataFrame:
    """First ``n`` whose 95% interval of ``est`` stays within ``truth`` +- tolerance; NULL if none does."""
    iv = interval(estimates, [*by, "n", "truth"], "est")
    ok = (F.col("lo") >= F.col("truth") - tolerance) & (F.col("hi") <= F.col("truth") + tolerance)
    return iv.groupBy(*by).agg(F.min(F.when(ok, F.col("n"))).alias("min_n"))


def distinguishable(estimates: DataFrame, scenario: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` at which the 95% intervals of two scenarios do not overlap."""
    iv = interval(estimates.where(F.col(scenario).isin(a, b)), [*by, "n", scenario], "est")
    side = {k: F.max(F.when(F.col(scenario) == s, F.col(v))) for k, (s, v) in
            {"alo": (a, "lo"), "ahi": (a, "hi"), "blo": (b, "lo"), "bhi": (b, "hi")}.items()}
    wide = iv.groupBy(*by, "n").agg(*[v.alias(k) for k, v in side.items()])
    apart = ~((F.col("alo") < F.col("bhi")) & (F.col("blo") < F.col("ahi")))
    return wide.groupBy(*by).agg(F.min(F.when(apart, F.col("n"))).alias("min_n"))


LIKENESS_EDGES = tuple(i / 10 for i in range(10))


def likeness_histogram(df: DataFrame, col: str = "t_likeness") -> DataFrame:
    """Ten bins of width 0.1 (the last one takes 1.0) with their counts; empty bins are kept."""
    bins = df.sparkSession.createDataFrame([(i,) for i in range(10)], "bin int")
    at = sum(((F.col(col) >= e).cast("int") for e in LIKENESS_EDGES), start=F.lit(-1))
    n = df.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "bin", "left").fillna(0)


def likeness_summary(df: DataFrame, col: str = "t_likeness") -> DataFrame:
    """Mean (the soft T share), median and population standard deviation as one row."""
    stats = df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std")).withColumn("_k", F.lit(1))
    mid = interval(df.withColumn("_k", F.lit(1)), ["_k"], col).select("_k", "median")
    return stats.join(mid, "_k").drop("_k").withColumn("soft_t", F.col("mean")).withColumn("soft_y", 1.0 - F.col("mean"))
