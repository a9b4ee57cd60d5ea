"""Scores of a foreground probability against a mask.

Input rows are the listed pixels ``(tile_id, y, x, p, truth, valid)`` with 0/1 flags; a pixel that is not listed has
p = 0, is no truth and is valid. Distance tolerance is a window maximum over the kernel, so every threshold of a
sweep is read off the same two columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.operators import components as C
from lineweave.operators import pixels as P

THRESHOLDS = tuple(round(0.20 + 0.05 * i, 2) for i in range(13))
EPS = 1e-6


def _total(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0))


def with_tolerance(df: DataFrame, tol: int = 2, key: str = "tile_id") -> DataFrame:
    """Adds ``near_truth`` (valid truth within ``tol``) and ``near_p`` (greatest valid probability within ``tol``)."""
    kernel = P.ellipse(2 * tol + 1)
    wide = P.banded(df, tol, key)
    g = F.when((F.col("truth") == 1) & (F.col("valid") == 1), 1).otherwise(0)
    p = F.when(F.col("valid") == 1, F.col("p"))
    near = [F.max(g).over(P.frame(dy, k, key)) for dy, k in kernel.items()]
    top = [F.max(p).over(P.frame(dy, k, key)) for dy, k in kernel.items()]
    out = wide.withColumn("near_truth", F.greatest(*near) if len(near) > 1 else near[0]).withColumn(
        "near_p", F.greatest(*top) if len(top) > 1 else top[0])
    return out.where("_own").drop("_band", "_own", "_line")


def threshold_counts(df: DataFrame, thresholds: Sequence[float], tol: int = 2, by: Sequence[str] = (), penalize_oob: bool = True,
                     key: str = "tile_id") -> DataFrame:
    """Additive counts of each threshold: ``(by, t, hit_pred, n_pred, hit_truth, n_truth, inter, oob)``."""
    rich = with_tolerance(df, tol, key)
    ok, g = F.col("valid") == 1, (F.col("truth") == 1) & (F.col("valid") == 1)
    rows = []
    for t in thresholds:
        on = F.col("p") >= t
        counted = on if penalize_oob else on & ok
        rows.append(F.struct(
            F.lit(float(t)).alias("t"), _total(counted & (F.col("near_truth") == 1)).alias("hit_pred"), _total(counted).alias("n_pred"),
            _total(g & (F.col("near_p") >= t)).alias("hit_truth"), _total(g).alias("n_truth"), _total(on & g).alias("inter"),
            _total(on & ~ok).alias("oob"), _total(on).alias("n_on")))
    return rich.groupBy(*by).agg(F.array(*rows).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def scores(counts: DataFrame) -> DataFrame:
    """Tolerant precision, recall and F1, and Dice, from the additive counts."""
    p = F.col("hit_pred") / F.greatest(F.col("n_pred"), F.lit(1))
    r = F.col("hit_truth") / F.greatest(F.col("n_truth"), F.lit(1))
    return counts.withColumns({"precision": p, "recall": r}).withColumns({
        "f1": 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)),
        "dice": (2.0 * F.col("inter") + EPS) / (F.col("n_pred") + F.col("n_truth") + EPS),
    })


def tolerant_f1(df: DataFrame, threshold: float, tol: int = 2, by: Sequence[str] = (), penalize_oob: bool = True) -> DataFrame:
    return scores(threshold_counts(df, [threshold], tol, by, penalize_oob)).select(*by, "precision", "recall", "f1", "dice")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, tol: int = 2, penalize_oob: bool = True) -> DataFrame:
    """Scores of each threshold with the winner marked: best F1, then best Dice, then the first one."""
    table = scores(threshold_counts(df, thresholds, tol, penalize_oob=penalize_oob))
    best = F.max(F.struct(F.round("f1", 10).alias("f"), F.col("dice"), (-F.col("t")).alias("t"))).over(W.partitionBy(F.lit(1)))
    return table.withColumn("best", F.col("t") == -best["t"])      # one row for each threshold


def group_threshold_search(df: DataFrame, group: str, thresholds: Sequence[float], invalid_area: DataFrame, tol: int = 2,
                           guardrail: float = 0.0025, penalize_oob: bool = True) -> DataFrame:
    """Best choice of one threshold per group.

    Counts add over groups, so the pixels are read once; the product of choices is built from the tiny count table.
    ``invalid_area`` is one row ``(n)`` with the number of no-data pixels. At most 9 thresholds."""
    if len(thresholds) > 9:
        raise ValueError("more than 9 thresholds")
    cells = threshold_counts(df, thresholds, tol, [group], penalize_oob)
    sums = ["hit_pred", "n_pred", "hit_truth", "n_truth", "inter", "oob"]
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    n = len(thresholds)
    names = sorted(r[0] for r in cells.select(group).distinct().collect())      # one row for each group; the search has n ** groups choices
    if n ** len(names) >= 1 << 62:
        raise ValueError(f"{n} thresholds for {len(names)} groups are too many choices")
    # Choice number c picks for the i-th group the threshold at digit i of c in base n.
    digit = F.array(*[F.struct(F.lit(g).alias(group), F.expr(f"cast(pmod(c div {n ** i}L, {n}) as int)").alias("d")) for i, g in enumerate(names)])
    combos = df.sparkSession.range(n ** len(names) if names else 0).select(F.col("id").alias("c"))
    combos = combos.select("c", F.explode(digit).alias("s")).select("c", f"s.{group}", F.get(ts, F.col("s.d")).alias("t")) if names else cells.select(F.lit(0).cast("bigint").alias("c"), group, "t").where("false")
    picked = combos.join(cells, [group, "t"]).groupBy("c").agg(
        *[F.sum(s).alias(s) for s in sums], F.array_sort(F.collect_list(F.struct(group, "t"))).alias("choice"))
    area = invalid_area.select(F.col("n").alias("_area"), F.lit(1).alias("_k"))
    ok = scores(picked).withColumn("_k", F.lit(1)).join(area, "_k").where(F.col("oob") / F.greatest(F.col("_area"), F.lit(1)) <= guardrail)
    best = ok.agg(F.max(F.struct(F.round("f1", 10).alias("f"), F.col("dice"), (-F.col("c")).alias("c"), F.col("choice"), F.col("f1"))).alias("b"))
    return best.select("b.choice", "b.f1", "b.dice").where("choice IS NOT NULL")


def soft_scores(df: DataFrame, area: DataFrame) -> DataFrame:
    """Soft Dice, mean probability and truth share over the valid part; ``area`` is one row ``(n_valid)``."""
    ok = F.col("valid") == 1
    sums = df.agg(F.sum(F.when(ok, F.col("p") * F.col("truth")).otherwise(0.0)).alias("i"), F.sum(F.when(ok, F.col("p")).otherwise(0.0)).alias("p"),
                  F.sum(F.when(ok, F.col("truth")).otherwise(0)).alias("g")).withColumn("_k", F.lit(1))
    j = sums.join(area.withColumn("_k", F.lit(1)), "_k")
    n = F.greatest(F.col("n_valid"), F.lit(1))
    return j.select(((2.0 * F.col("i") + EPS) / (F.col("p") + F.col("g") + EPS)).alias("soft_dice"), (F.col("p") / n).alias("mean_prob"),
                    (F.col("g") / n).alias("fg_ratio"))


def oob_stats(df: DataFrame, threshold: float, invalid_area: DataFrame) -> DataFrame:
    on, bad = F.col("p") >= threshold, F.col("valid") == 0
    sums = df.agg(_total(on & bad).alias("oob_pixels"), _total(on).alias("_on")).withColumn("_k", F.lit(1))
    j = sums.join(invalid_area.select(F.col("n").alias("_area"), F.lit(1).alias("_k")), "_k")
    return j.select("oob_pixels", (F.col("oob_pixels") / F.greatest(F.col("_area"), F.lit(1))).alias("oob_ratio"),
                    (F.col("oob_pixels") / F.greatest(F.col("_on"), F.lit(1))).alias("oob_fraction"))


def pixel_class_weight(counts: DataFrame, by: Sequence[str] = (), multiplier: float = 0.35, low: float = 1.0, cap: float = 40.0,
                       overrides: dict[str, float] | None = None) -> DataFrame:
    """Weight of a foreground pixel from ``(by, pos, neg)``: neg / pos, scaled and clamped, or a fixed override."""
    sums = counts.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    raw = F.when(F.col("pos") > 0, F.try_divide("neg", "pos")).otherwise(1.0)
    adj = F.when(F.col("pos") > 0, F.least(F.greatest(F.lit(low), raw * multiplier), F.lit(cap))).otherwise(1.0)
    out = sums.withColumns({"raw_weight": raw, "weight": adj,
                            "fg_ratio": F.when(F.col("pos") > 0, F.try_divide(F.col("pos"), F.col("pos") + F.col("neg"))).otherwise(0.0)})
    for name, value in (overrides or {}).items():
        out = out.withColumn("weight", F.when(F.col(by[0]) == name, float(value)).otherwise(F.col("weight")))
    return out


def combined_weight(group: Column, family: Column, mode: str = "group") -> Column:
    """One weight from the group's and the family's: the named one, their mean, or the larger."""
    both = {"group": group, "family": family, "mean": (group + family) * 0.5, "max": F.greatest(group, family)}
    return F.coalesce(both[mode], group, family)


def topology_metrics(pred: DataFrame, truth: DataFrame, dims: DataFrame, tol: int = 2, key: str = "tile_id") -> DataFrame:
    """Mean over tiles of the component ratio, the skeleton length ratio and the share of truth endpoints reached."""
    def per_tile(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    def groups(df: DataFrame) -> DataFrame:
        return C.components(df, key=key).select(key, "comp_id").distinct()

    ps, ts = C.morph_skeleton(pred, dims, key), C.morph_skeleton(truth, dims, key)
    ends = P.endpoints(ts, key)
    reached = P.mask_intersect(ends, P.dilate(ps, P.ellipse(2 * tol + 1), dims, key), key)
    parts = [per_tile(groups(pred), "pc"), per_tile(groups(truth), "tc"), per_tile(ps, "pl"), per_tile(ts, "tl"), per_tile(ends, "e"), per_tile(reached, "r")]
    t = dims.select(key)
    for part in parts:
        t = t.join(part, key, "left")
    t = t.fillna(0)

    def share(num: str, den: str, empty: str) -> Column:
        return F.when(F.col(den) > 0, F.try_divide(num, den)).otherwise((F.col(empty) == 0).cast("double"))

    return t.agg(F.avg(share("pc", "tc", "pc")).alias("cc_ratio"), F.avg(share("pl", "tl", "pl")).alias("len_ratio"),
                 F.avg(share("r", "e", "pl")).alias("bridge_rate"))
