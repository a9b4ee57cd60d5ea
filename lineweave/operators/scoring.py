"""All heads on every row in one pass, then votes, geometry, filters and decisions across rows.

A scorer is any function from a batch of rows to class probabilities. A row that no scorer can read is data, not a failed
task: it leaves with the label ERROR and goes through the same votes and filters as the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import votes as V
from lineweave.operators import arbitration as A
from lineweave.session import cut

ERROR = "ERROR"
Scorer = Callable[[pd.DataFrame], np.ndarray]


@dataclass(frozen=True)
class Scoring:
    """How labels follow from heads. A radius of 0 turns its step off."""

    label_head: str = "ensemble"            # ensemble | meta | <head> | <head>_cascade
    settings: A.Settings = A.Settings()
    cluster_radius: float = 0.0
    mixed_radius: float = 0.0
    nms_radius: float = 0.0
    meta_min_confidence: float = 0.0


def _checked(fn: Scorer, rows: pd.DataFrame, classes: int) -> np.ndarray:
    p = np.asarray(fn(rows), dtype=float)
    if p.shape != (len(rows), classes):
        raise ValueError(f"a scorer gave {p.shape} for {len(rows)} rows of {classes} classes")
    return p


def _score(head: str, fn: Scorer, rows: pd.DataFrame, classes: int, probs: np.ndarray, errors: list[str | None]) -> None:
    """One head on a batch. What fails is halved until the rows that fail stand alone; the other rows are scored in parts."""
    def part(lo: int, hi: int, fails: bool = False) -> bool:
        if not fails:
            try:
                probs[lo:hi] = _checked(fn, rows.iloc[lo:hi], classes)
                return True
            except Exception as exc:  # noqa: BLE001 - whatever a scorer raises marks rows, it never ends the job
                if hi - lo == 1:
                    errors[lo] = errors[lo] or f"{head}: {type(exc).__name__}"
                    return False
        mid = (lo + hi) // 2
        fine = part(lo, mid)
        part(mid, hi, fine and hi - mid > 1)      # of two halves one fails; it is not asked if that must be this one
        return False

    part(0, len(rows))


def _batch(rows: pd.DataFrame, scorers: Mapping[str, Scorer], classes: Sequence[str]) -> tuple[dict[str, np.ndarray], list[str | None]]:
    """Probabilities of each head, and what went wrong in each row."""
    n = len(rows)
    probs = {h: np.full((n, len(classes)), np.nan) for h in scorers}
    errors: list[str | None] = [None] * n
    for head, fn in scorers.items():
        _score(head, fn, rows, len(classes), probs[head], errors)
        for i in np.flatnonzero(~np.isfinite(probs[head]).all(axis=1)):
            errors[i] = errors[i] or f"{head}: not finite"
    return probs, errors


def score_heads(df: DataFrame, scorers: Mapping[str, Scorer], classes: Sequence[str] = V.CLASSES) -> DataFrame:
    """Adds ``{head}_prob_{class}``, ``{head}_pred`` and ``score_error`` in one pass over the rows, without a shuffle.

    The prediction is the most probable class, of equals the first. Where any head fails, or gives a number that is not
    finite, all predictions are ERROR, all probabilities null, and ``score_error`` names the first head that failed.
    Columns of these names in ``df`` are replaced."""
    made = [f"{h}_prob_{c}" for h in scorers for c in classes]
    kept = [c for c in df.columns if c not in {*made, *(f"{h}_pred" for h in scorers), "score_error"}]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"`{c}` double" for c in made), "score_error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            probs, errors = _batch(rows, scorers, classes)
            bad = np.array([e is not None for e in errors])
            cols = {}
            for h in scorers:
                p = np.where(bad[:, None], np.nan, probs[h])
                cols |= {f"{h}_prob_{c}": p[:, k] for k, c in enumerate(classes)}
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame(cols), pd.DataFrame({"score_error": pd.Series(errors, dtype=object)})], axis=1)

    scored = base.mapInPandas(run, schema)
    failed = F.col("score_error").isNotNull()
    scored = scored.withColumns({c: F.when(~failed, F.col(f"`{c}`")) for c in made})
    preds = {f"{h}_pred": F.when(failed, ERROR).otherwise(V.choose_label({c: F.col(f"{h}_prob_{c}") for c in classes}, "enabled", classes)["label"]) for h in scorers}
    return scored.withColumns(preds)


def score_rows(df: DataFrame, scorers: Mapping[str, Scorer], cfg: Scoring = Scoring(), by: Sequence[str] = ("source_image",), meta: Scorer | None = None) -> DataFrame:
    """Rows with features, geometry and proposal columns -> the rows with every head's answer and the label in ``consensus``.

    ``scorers`` holds the voting heads ``cnn, mlp, svm, xgb`` and may hold others, which only count as ``label_head``.
    ``meta`` reads the scored rows and gives probabilities; it decides alone if it is the label head, else only where it is
    sure enough. A failed row has no geometry, agreement 0 and the label ERROR in every mode; no step relabels it, and
    it stays unless an output filter names it."""
    cascade = cfg.label_head.endswith("_cascade")
    head = cfg.label_head.removesuffix("_cascade")
    alone = head not in ("ensemble", "meta")
    missing = [h for h in V.HEADS if h not in scorers]
    if missing or (alone and head not in scorers) or (head == "meta" and meta is None):
        raise ValueError(f"no scorer for {missing or head}")
    # Written once, so that no later step runs the scorers again.
    x = cut(score_heads(df, scorers))
    failed = F.col("score_error").isNotNull()
    geometry = {"geometry_label": F.lit("Unknown"), "branch_count": F.lit(0)}
    gone = {c: F.when(~failed, F.col(c)).otherwise(geometry.get(c)) for c in ("geometry_label", "branch_count", "min_gap_deg", "max_gap_deg")}
    x = cut(V.prob_summary(A.with_votes(x.withColumns(gone))))
    x = A.synthesis_filter(x, cfg.settings.x_mode)
    if meta is not None:
        # A meta model that fails takes the row with it, as any other head does.
        x = score_heads(cut(x).withColumnRenamed("score_error", "_before"), {"meta": meta}).withColumn("score_error", F.coalesce("_before", "score_error")).drop("_before")
    x = cut(_failed_again(x))
    if alone:
        x = A.label_by_head(x, head, cascade, cfg.settings)
    elif head == "ensemble":
        x = A.ty_arbitrate(x, cfg.settings)
    x = _failed_again(x)
    if meta is not None:
        x = A.meta_override(x, cfg.settings.x_mode, cfg.meta_min_confidence, force=head == "meta")
    x = _failed_again(A.cluster_arbitrate(cut(x), cfg.cluster_radius, by, cfg.settings.x_mode))
    if head == "ensemble" and (cfg.mixed_radius > 0 or cfg.nms_radius > 0):
        x = A.same_label_nms(A.mixed_cluster_arbitrate(x, cfg.mixed_radius, by, cfg.settings), cfg.nms_radius, by)
    return A.output_filters(x, cfg.settings)


def _failed_again(df: DataFrame) -> DataFrame:
    """Failed rows keep ERROR, whatever the step before made of them."""
    failed = F.col("score_error").isNotNull()
    put = {"consensus": F.lit(ERROR), "raw_consensus": F.lit(ERROR), "agreement": F.lit(0), "raw_agreement": F.lit(0), "raw_x_votes": F.lit(0)}
    return df.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in put.items()})
