"""Queries that score rows with all heads at once and carry failed rows through to the end."""

from __future__ import annotations

import numpy as np

from lineweave.functions import votes as V
from lineweave.operators import arbitration as A
from lineweave.operators import scoring as S
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, with_fx
from lineweave.plans.points import nms_sql
from lineweave.plans.voting import CFG, GATE_THR, LADDER, TY

HEADS = V.HEADS


def _scorer(head: str, shift: int):
    """Probabilities from the numbers of the row; some rows cannot be read, and one head gives no number for some."""
    def run(rows):
        at, agreement, count = (rows[c].to_numpy() for c in ("id", "agreement", "branch_count"))
        if head == "svm" and (at % 41 == 0).any():
            raise ValueError("unreadable row")
        p = np.stack([((at * (3 + 2 * shift) + agreement * 7 + count * (5 + 4 * k) * 3) % 64) / 64.0 for k in range(4)], axis=1)
        if head == "xgb":
            p[at % 53 == 0, 1] = np.nan
        return p

    return run


SCORERS = {h: _scorer(h, i) for i, h in enumerate(HEADS)}
_PROBS = ", ".join(f"(id * {3 + 2 * i} + agreement * 7 + branch_count * {(5 + 4 * k) * 3}) % 64 / 64.0 AS {h}_prob_{c}" for i, h in enumerate(HEADS) for k, c in enumerate(V.CLASSES))
_MADE = ", ".join(f"{h}_prob_{c}" for h in HEADS for c in V.CLASSES)
_PREDS = ", ".join(f"CASE WHEN bad THEN 'ERROR' ELSE ['N', 'T', 'X', 'Y'][list_position([{', '.join(f'{h}_prob_{c}' for c in V.CLASSES)}], greatest({', '.join(f'{h}_prob_{c}' for c in V.CLASSES)}))] END AS {h}_pred"
                   for h in HEADS)
#: ``scored``: the rows of the fixture as the heads above answer them; a failed row has no geometry.
SCORED = with_fx("fx_rows", recursive=True).replace("fx_rows AS", "given AS") + f""",
heads AS MATERIALIZED (SELECT * EXCLUDE ({_MADE}, cnn_pred, mlp_pred, svm_pred, xgb_pred), id % 41 = 0 OR id % 53 = 0 AS bad, {_PROBS} FROM given),
fx_rows AS MATERIALIZED (SELECT * REPLACE (CASE WHEN bad THEN 'Unknown' ELSE geometry_label END AS geometry_label, CASE WHEN bad THEN 0 ELSE branch_count END AS branch_count,
  CASE WHEN bad THEN NULL ELSE min_gap_deg END AS min_gap_deg, CASE WHEN bad THEN NULL ELSE max_gap_deg END AS max_gap_deg), {_PREDS} FROM heads)"""


@query("score_heads", SCORED + " SELECT id, cnn_pred, mlp_pred, svm_pred, xgb_pred, CASE WHEN id % 41 = 0 THEN 'svm: ValueError' WHEN id % 53 = 0 THEN 'xgb: not finite' END AS score_error, CASE WHEN NOT bad THEN round(svm_prob_T, 6) END AS svm_prob_T FROM fx_rows")
def score_heads(spark, sf):
    """Four heads in one pass; rows that one of them cannot read are errors in all."""
    return S.score_heads(derived(spark, sf, "fx_rows", dealt=True), SCORERS).select("id", *[f"{h}_pred" for h in HEADS], "score_error", "svm_prob_T")


@query("score_rows", SCORED + f""", {LADDER},
lab AS MATERIALIZED (SELECT * EXCLUDE (c1, c2, c3, c4, c5, c6) REPLACE (CASE WHEN bad THEN 'ERROR' ELSE consensus END AS consensus, CASE WHEN bad THEN 0 ELSE agreement END AS agreement) FROM f7),
{TY.replace('cnn_pred AS c0 FROM fx_rows', 'consensus AS c0 FROM lab').replace('AS consensus FROM t2', 'AS label FROM t2').replace('t3 AS (', 't3 AS MATERIALIZED (')},
sub AS MATERIALIZED (SELECT *, scene_id || ':' || label AS grp FROM t3 WHERE label IN ('T', 'X', 'Y')), {nms_sql('sub', '-agreement, -proposal_score, id', '<= 1600', by='grp')},
kept AS (SELECT * FROM t3 WHERE label NOT IN ('T', 'X', 'Y') UNION ALL SELECT t3.* FROM t3 JOIN (SELECT id FROM pts WHERE rk NOT IN (SELECT lose FROM dropped)) k ON k.id = t3.id)
SELECT id, label AS consensus, agreement, CASE WHEN bad THEN 'ERROR' ELSE raw END AS raw_consensus FROM kept WHERE label <> 'N' AND NOT (virt AND label = 'T' AND agreement < 3) AND NOT (virt AND border_flag)""")
def score_rows(spark, sf):
    """Votes, geometry, arbitration, suppression and filters over all rows; failed ones stay as ERROR."""
    cfg = S.Scoring(settings=CFG, nms_radius=40.0)
    return S.score_rows(derived(spark, sf, "fx_rows", dealt=True), SCORERS, cfg, ["scene_id"]).select("id", "consensus", "agreement", "raw_consensus")


@query("score_rows_cascade", SCORED + f""", g AS (SELECT *, least(1.0, mlp_prob_T + mlp_prob_X + mlp_prob_Y) AS pos, {GATE_THR} AS thr FROM fx_rows),
k AS (SELECT *, CASE WHEN CASE WHEN mlp_prob_T + mlp_prob_X + mlp_prob_Y > 0 THEN pos ELSE 1 - mlp_prob_N END < thr THEN 'N' WHEN mlp_prob_T >= mlp_prob_Y THEN 'T' ELSE 'Y' END AS kind,
  CASE WHEN branch_count <> 3 OR min_gap_deg IS NULL OR max_gap_deg IS NULL THEN '' WHEN max_gap_deg BETWEEN 155 AND 205 AND min_gap_deg BETWEEN 75 AND 95 THEN 'T' WHEN min_gap_deg >= 100 THEN 'Y' ELSE '' END AS gv FROM g)
SELECT id, CASE WHEN bad THEN 'ERROR' WHEN kind <> 'N' AND gv <> '' THEN gv ELSE kind END AS consensus FROM k""")
def score_rows_cascade(spark, sf):
    """One head alone, gate first and type second."""
    cfg = S.Scoring("mlp_cascade", A.Settings())
    return S.score_rows(derived(spark, sf, "fx_rows", dealt=True), SCORERS, cfg, ["scene_id"]).select("id", "consensus")
