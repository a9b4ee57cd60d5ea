"""Match reports, confusion tables and class metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.operators.ranks import group_quantiles, unit_hash

CLASSES = ("N", "T", "X", "Y")
MISSED, NO_GT = "MISSED", "NO_GT"


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0.0 where there is nothing to divide by."""
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def match_report(matches: DataFrame, truth: DataFrame, pred: DataFrame, by: Sequence[str], label: str = "pred_label",
                 gt_id: str = "gt_id", pred_id: str = "id") -> DataFrame:
    """One row for each matched pair, missed truth and unmatched prediction."""
    t = truth.select(*by, gt_id, "true_label", F.col("x").cast("double").alias("gt_x"), F.col("y").cast("double").alias("gt_y"))
    p = pred.select(*by, F.col(pred_id).alias("pred_id"), F.col(label).alias("pred_label"),
                    F.col("x").cast("double").alias("pred_x"), F.col("y").cast("double").alias("pred_y"))
    full = t.join(matches, [*by, gt_id], "left").join(p, [*by, "pred_id"], "full")
    hit, lost = F.col("distance").isNotNull(), F.col(gt_id).isNotNull()
    return full.select(
        *by,
        F.when(lost, F.upper(F.trim("true_label"))).otherwise(NO_GT).alias("true_label"),
        F.when(F.col("pred_id").isNotNull(), F.upper(F.trim("pred_label"))).otherwise(MISSED).alias("pred_label"),
        F.when(hit, "MATCHED").when(lost, "MISSED_DETECTION").otherwise("UNMATCHED_PREDICTION").alias("status"),
        "distance", "gt_x", "gt_y", "pred_x", "pred_y",
    )


def confusion(report: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Counts of true (rows, with NO_GT) by predicted (columns, with MISSED); every row and column is there."""
    spark = report.sparkSession
    rows = spark.createDataFrame([(c,) for c in (*classes, NO_GT)], "true_label string")
    counts = report.groupBy("true_label").pivot("pred_label", [*classes, MISSED]).agg(F.count(F.lit(1)))
    return rows.join(counts, "true_label", "left").fillna(0)


def confusion_cells(report: DataFrame) -> DataFrame:
    return report.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(report: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each class, from the cells of the confusion table."""
    cells = confusion_cells(report)
    names = report.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    roles = cells.select("n", F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), (F.col("true_label") == F.col("pred_label")).alias("tp"),
                 F.lit(False).alias("fp"), (F.col("true_label") != F.col("pred_label")).alias("fn")),
        F.struct(F.col("pred_label").alias("label"), F.lit(False).alias("tp"),
                 (F.col("true_label") != F.col("pred_label")).alias("fp"), F.lit(False).alias("fn")),
    )).alias("r")).select("n", "r.*")
    sums = roles.groupBy("label").agg(*[F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")])
    full = names.join(sums, "label", "left").fillna(0)
    return full.withColumns(f1_of(F.col("tp"), F.col("fp"), F.col("fn")))


def detection_metrics(matches: DataFrame, truth: DataFrame, pred: DataFrame, by: Sequence[str], label: str = "pred_label",
                      classes: Sequence[str] = ("T", "X", "Y"), gt_id: str = "gt_id", pred_id: str = "id") -> DataFrame:
    """Per class: truth, prediction and hit counts, precision, recall, F1; ``macro_f1`` over classes that occur."""
    names = truth.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    hits = (
        matches.join(truth.select(*by, gt_id, "true_label"), [*by, gt_id])
        .join(pred.select(*by, F.col(pred_id).alias("pred_id"), F.col(label).alias("_p")), [*by, "pred_id"])
        .where(F.col("true_label") == F.col("_p")).groupBy(F.col("_p").alias("label")).agg(F.count(F.lit(1)).alias("tp"))
    )
    n_gt = truth.groupBy(F.col("true_label").alias("label")).agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = pred.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    table = names.join(n_gt, "label", "left").join(n_pred, "label", "left").join(hits, "label", "left").fillna(0)
    table = table.withColumns(f1_of(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")))
    macro = F.coalesce(F.avg(F.when(F.col("n_gt") > 0, F.col("f1"))).over(W.partitionBy(F.lit(1))), F.lit(0.0))
    return table.withColumn("macro_f1", macro)     # one row for each class: a constant-size window


def classification_report(report: DataFrame, classes: Sequence[str] = ("T", "Y", "X", "N")) -> DataFrame:
    """One row: accuracy, macro and weighted F1, and the F1 of each class."""
    per = class_metrics(report, classes).withColumn("support", F.col("tp") + F.col("fn"))
    known = F.sum("support")
    return per.agg(
        ratio(F.sum("tp"), known).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), known).alias("weighted_f1"),
        *[F.max(F.when(F.col("label") == c, F.col("f1"))).alias(f"{c}_f1") for c in classes],
    )


def compare_models(reports: dict[str, DataFrame], classes: Sequence[str] = ("T", "Y", "X", "N")) -> DataFrame:
    """One metric row for each model, best macro F1 first."""
    rows = [classification_report(df, classes).withColumn("model", F.lit(name)) for name, df in reports.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.desc("macro_f1"), "model")


def match_summary(report: DataFrame, by: Sequence[str]) -> DataFrame:
    s = F.col("status")
    matched, missed, extra = (F.count_if(s == v) for v in ("MATCHED", "MISSED_DETECTION", "UNMATCHED_PREDICTION"))
    return report.groupBy(*by).agg((matched + missed).alias("n_gt"), (matched + extra).alias("n_pred"), matched.alias("n_matched"),
                                   missed.alias("n_missed"), extra.alias("n_unmatched"))


def count_by_type(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(c,) for c in labels], "label string")
    n = df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "label", "left").fillna(0)


def balanced_weights(df: DataFrame, col: str = "label", power: float = 1.0) -> DataFrame:
    """``(label, weight)``: inverse class frequency with mean 1 over the classes, optionally softened by a power."""
    counts = df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))                 # one row for each class
    raw = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    w = counts.withColumn("_r", raw).withColumn("weight", F.col("_r") / F.avg("_r").over(every))
    if power != 1.0:
        w = w.withColumn("_s", F.pow("weight", F.lit(float(power)))).withColumn("weight", F.col("_s") / F.avg("_s").over(every))
    return w.select("label", "weight")


def sample_weights(df: DataFrame, mode: str = "none", weight: str = "weight", label: str = "label", non_n: float = 1.0,
                   factors: dict[str, float] | None = None, class_weights: DataFrame | None = None) -> DataFrame:
    """Adds ``sample_weight``: the manifest weight or 1, times the non-N factor, class factors and class weights."""
    if mode not in ("none", "manifest", "non_n_focus", "manifest_non_n"):
        raise ValueError(f"unsupported weight mode: {mode}")
    w = F.col(weight) if mode.startswith("manifest") else F.lit(1.0)
    if mode.endswith(("focus", "non_n")):
        w = w * F.when(F.col(label) != "N", float(non_n)).otherwise(1.0)
    for name, factor in (factors or {}).items():
        if factor > 0:
            w = w * F.when(F.col(label) == name, float(factor)).otherwise(1.0)
    if class_weights is None:
        return df.withColumn("sample_weight", w)
    extra = class_weights.select(F.col("label").alias(label), F.col("weight").alias("_cw"))
    return df.join(extra, label, "left").withColumn("sample_weight", w * F.coalesce("_cw", F.lit(1.0))).drop("_cw")


#: Cumulative probabilities of a Poisson variable with mean 1, up to the last one a 32-bit number in [0, 1) can reach.
POISSON_1 = tuple(round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), 11) for k in range(13))


def bootstrap_ci(report: DataFrame, key: Sequence[str], b: int = 200, seed: int = 0,
                 classes: Sequence[str] = ("T", "Y", "X", "N")) -> DataFrame:
    """95% interval of each class's F1 over ``b`` Poisson resamples -> ``(label, median, lo, hi)``."""
    u = unit_hash(*[F.col(k) for k in key], F.col("b"), seed=seed)
    times = sum(((u >= c).cast("int") for c in POISSON_1), start=F.lit(0))
    drawn = report.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b)))).withColumn("k", times)
    cells = drawn.groupBy("b", "true_label", "pred_label").agg(F.sum("k").alias("n"))
    parts = []
    for c in classes:
        t, p = F.col("true_label") == c, F.col("pred_label") == c
        tp, fp, fn = (F.sum(F.when(m, F.col("n")).otherwise(0)) for m in (t & p, ~t & p, t & ~p))
        parts.append(F.struct(F.lit(c).alias("label"), f1_of(tp, fp, fn)["f1"].alias("f1")))
    scores = cells.groupBy("b").agg(F.array(*parts).alias("s")).select("b", F.explode("s").alias("s")).select("b", "s.*")
    return interval(scores, ["label"], "f1")


def interval(df: DataFrame, by: Sequence[str], col: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Median and percentile interval of ``col`` in each group."""
    q = group_quantiles(df, by, col, [0.5, lo, hi])
    return q.select(*by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("median", "lo", "hi"))])


def reject_counters(df: DataFrame, reason: str, stages: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows end at each stage of a funnel."""
    cols = [F.count_if(F.col(reason) == s).alias(s) for s in stages]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("considered"), *cols)
