"""Queries on match reports: confusion, class metrics, intervals, class fractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import scalars as X
from lineweave.operators import calibration as K
from lineweave.operators import metrics as M
from lineweave.operators import spatial as S
from lineweave.plans.catalog import query
from lineweave.plans.columns import num_sql
from lineweave.plans.derived import derived, with_fx
from lineweave.plans.points import MATCH_RADIUS, MATCH_SQL

BY = ["scene_id"]
HASH = "CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0"

REPORT = with_fx("fx_truth", "fx_detections", recursive=True) + ", " + MATCH_SQL + """,
report AS (
  SELECT scene_id, t.true_label, p.xgb_pred AS pred_label, 'MATCHED' AS status, m.distance, t.x AS gt_x, t.y AS gt_y, p.x AS pred_x, p.y AS pred_y
  FROM matched m JOIN fx_truth t USING (scene_id, gt_id) JOIN fx_detections p ON p.id = m.pred_id AND p.scene_id = m.scene_id
  UNION ALL SELECT scene_id, true_label, 'MISSED', 'MISSED_DETECTION', NULL, x, y, NULL, NULL FROM fx_truth
   WHERE gt_id NOT IN (SELECT gt_id FROM matched)
  UNION ALL SELECT scene_id, 'NO_GT', xgb_pred, 'UNMATCHED_PREDICTION', NULL, NULL, NULL, x, y FROM fx_detections
   WHERE id NOT IN (SELECT pred_id FROM matched))"""

PER_CLASS = """per AS (SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
        CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM (SELECT c.label, count(*) FILTER (WHERE true_label = c.label AND pred_label = c.label) AS tp,
               count(*) FILTER (WHERE true_label <> c.label AND pred_label = c.label) AS fp,
               count(*) FILTER (WHERE true_label = c.label AND pred_label <> c.label) AS fn
        FROM report CROSS JOIN (VALUES ('N'), ('T'), ('X'), ('Y')) c(label) GROUP BY 1))"""


def matched(spark, sf):
    t, p = derived(spark, sf, "fx_truth"), derived(spark, sf, "fx_detections")
    return S.greedy_match(t, p, MATCH_RADIUS, BY), t, p


def report(spark, sf):
    m, t, p = matched(spark, sf)
    return M.match_report(m, t, p, BY, label="xgb_pred")


@query("match_report", REPORT + """ SELECT scene_id, true_label, pred_label, status, round(distance, 6) AS distance, CAST(gt_x AS DOUBLE) AS gt_x,
 CAST(gt_y AS DOUBLE) AS gt_y, CAST(pred_x AS DOUBLE) AS pred_x, CAST(pred_y AS DOUBLE) AS pred_y FROM report""")
def match_report(spark, sf):
    return report(spark, sf).withColumn("distance", F.round("distance", 6))


@query("confusion", REPORT + """ SELECT r.true_label, """ + ", ".join(
    f"count(*) FILTER (WHERE pred_label = '{c}') AS \"{c}\"" for c in (*M.CLASSES, M.MISSED)) + """
FROM (VALUES ('N'), ('T'), ('X'), ('Y'), ('NO_GT')) r(true_label) LEFT JOIN report USING (true_label) GROUP BY 1""")
def confusion(spark, sf):
    return M.confusion(report(spark, sf))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("class_metrics", REPORT + f", {PER_CLASS} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per")
def class_metrics(spark, sf):
    return _rounded(M.class_metrics(report(spark, sf)), "precision", "recall", "f1")


@query("detection_metrics", REPORT + """, hit AS (SELECT true_label AS label, count(*) AS tp FROM report WHERE status = 'MATCHED' AND true_label = pred_label GROUP BY 1),
g AS (SELECT true_label AS label, count(*) AS n_gt FROM fx_truth GROUP BY 1), p AS (SELECT xgb_pred AS label, count(*) AS n_pred FROM fx_detections GROUP BY 1),
j AS (SELECT g.label, n_gt, n_pred, coalesce(tp, 0) AS tp FROM g JOIN p USING (label) LEFT JOIN hit USING (label) WHERE g.label <> 'N')
SELECT label, n_gt, n_pred, tp, round(tp / n_pred, 6) AS precision, round(tp / n_gt, 6) AS recall, round(2 * tp / (n_gt + n_pred), 6) AS f1,
       round(avg(2 * tp / (n_gt + n_pred)) OVER (), 6) AS macro_f1 FROM j""")
def detection_metrics(spark, sf):
    m, t, p = matched(spark, sf)
    out = M.detection_metrics(m, t, p, BY, label="xgb_pred")
    return _rounded(out, "precision", "recall", "f1", "macro_f1")


@query("classification_report", REPORT + f""", {PER_CLASS}
SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1,
 round(max(f1) FILTER (WHERE label = 'T'), 6) AS "T_f1", round(max(f1) FILTER (WHERE label = 'Y'), 6) AS "Y_f1",
 round(max(f1) FILTER (WHERE label = 'X'), 6) AS "X_f1", round(max(f1) FILTER (WHERE label = 'N'), 6) AS "N_f1" FROM per""")
def classification_report(spark, sf):
    out = M.classification_report(report(spark, sf))
    return _rounded(out, *out.columns)


def _compare_sql(heads):
    parts = [f"""SELECT '{h}' AS model, c.label, count(*) FILTER (WHERE xgb_pred = c.label AND {h}_pred = c.label) AS tp,
  count(*) FILTER (WHERE xgb_pred <> c.label AND {h}_pred = c.label) AS fp, count(*) FILTER (WHERE xgb_pred = c.label AND {h}_pred <> c.label) AS fn
  FROM fx_detections CROSS JOIN (VALUES ('N'), ('T'), ('X'), ('Y')) c(label) GROUP BY 1, 2""" for h in heads]
    return f""", roles AS ({' UNION ALL '.join(parts)}), f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM roles)
SELECT model, round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(tp + fn), 6) AS accuracy FROM f GROUP BY model"""


@query("compare_models", with_fx("fx_detections") + _compare_sql(("cnn", "mlp", "svm")))
def compare_models(spark, sf):
    """Three heads against the fourth one taken as the truth."""
    d = derived(spark, sf, "fx_detections")
    out = M.compare_models({h: d.select(F.col("xgb_pred").alias("true_label"), F.col(f"{h}_pred").alias("pred_label")) for h in ("cnn", "mlp", "svm")})
    return _rounded(out.select("model", "macro_f1", "accuracy"), "macro_f1", "accuracy")


@query("match_summary", REPORT + """ SELECT scene_id, count(*) FILTER (WHERE status <> 'UNMATCHED_PREDICTION') AS n_gt,
 count(*) FILTER (WHERE status <> 'MISSED_DETECTION') AS n_pred, count(*) FILTER (WHERE status = 'MATCHED') AS n_matched,
 count(*) FILTER (WHERE status = 'MISSED_DETECTION') AS n_missed, count(*) FILTER (WHERE status = 'UNMATCHED_PREDICTION') AS n_unmatched
FROM report GROUP BY scene_id""")
def match_summary(spark, sf):
    return M.match_summary(report(spark, sf), BY)


@query("count_by_type", with_fx("fx_raw") + """ SELECT c.label, count(r.id) AS n FROM (VALUES ('T'), ('Y'), ('X'), ('Z')) c(label)
LEFT JOIN fx_raw r ON upper(trim(r.label)) = c.label GROUP BY 1""")
def count_by_type(spark, sf):
    return M.count_by_type(derived(spark, sf, "fx_raw").withColumn("label", X.norm_label("label")), "label", ["T", "Y", "X", "Z"])


WEIGHTS = """c AS (SELECT true_label AS label, count(*) AS n FROM fx_truth GROUP BY 1), r AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS w FROM c),
m AS (SELECT label, w / avg(w) OVER () AS w FROM r), cw AS (SELECT label, sqrt(w) / avg(sqrt(w)) OVER () AS weight FROM m)"""


@query("balanced_weights", with_fx("fx_truth") + f", {WEIGHTS} SELECT label, round(weight, 6) AS weight FROM cw")
def balanced_weights(spark, sf):
    return _rounded(M.balanced_weights(derived(spark, sf, "fx_truth"), "true_label", power=0.5), "weight")


@query("sample_weights", with_fx("fx_raw", "fx_truth") + f""", {WEIGHTS},
b AS (SELECT id, upper(trim(label)) AS label, CASE WHEN {num_sql('num_text')} > 0 THEN {num_sql('num_text')} ELSE 1.0 END AS w FROM fx_raw)
SELECT id, round(w * CASE WHEN label <> 'N' THEN 1.5 ELSE 1 END * CASE label WHEN 'X' THEN 3 WHEN 'T' THEN 2 ELSE 1 END * coalesce(weight, 1), 5) AS sample_weight
FROM b LEFT JOIN cw USING (label)""")
def sample_weights(spark, sf):
    rows = derived(spark, sf, "fx_raw").select("id", X.norm_label("label").alias("label"), X.positive_weight("num_text").alias("weight"))
    cw = M.balanced_weights(derived(spark, sf, "fx_truth"), "true_label", power=0.5)
    out = M.sample_weights(rows, "manifest_non_n", non_n=1.5, factors={"X": 3.0, "T": 2.0}, class_weights=cw)
    return out.select("id", F.round("sample_weight", 5).alias("sample_weight"))


NORM = """cells AS (SELECT true_label, pred_label, count(*) AS n FROM report GROUP BY 1, 2),
nc AS (SELECT t.c AS true_label, p.c AS pred_label, coalesce(n, 0) AS n FROM (VALUES ('T'), ('Y'), ('X')) t(c) CROSS JOIN (VALUES ('T'), ('Y'), ('X')) p(c)
  LEFT JOIN cells ON cells.true_label = t.c AND cells.pred_label = p.c),
cm AS (SELECT true_label, pred_label, n / sum(n) OVER (PARTITION BY true_label) AS p FROM nc),
mx AS (SELECT """ + ", ".join(f"max(p) FILTER (WHERE pred_label = '{i}' AND true_label = '{j}') AS c{i}{j}" for i in "TYX" for j in "TYX") + """ FROM cm),
md AS (SELECT *, "cTT" * ("cYY" * "cXX" - "cYX" * "cXY") - "cTY" * ("cYT" * "cXX" - "cYX" * "cXT") + "cTX" * ("cYT" * "cXY" - "cYY" * "cXT") AS det FROM mx)"""


@query("normalized_confusion", REPORT + f", {NORM} SELECT true_label, pred_label, round(p, 6) AS p FROM cm")
def normalized_confusion(spark, sf):
    return _rounded(K.normalized_confusion(M.confusion_cells(report(spark, sf))), "p")


@query("confusion_determinant", REPORT + f", {NORM} SELECT round(det, 6) AS det FROM md")
def confusion_determinant(spark, sf):
    return _rounded(K.determinant(K.normalized_confusion(M.confusion_cells(report(spark, sf)))), "det")


# Class shares that differ by scene: a scene-dependent part of the rows is called T.
SHIFTED = "CASE WHEN (id * 7 + scene_id * 13) % 11 > scene_id % 11 THEN xgb_pred ELSE 'T' END"
SHARES = f"""sh AS (SELECT scene_id, count(*) FILTER (WHERE xgb_pred = 'T') / count(*) AS q1, count(*) FILTER (WHERE xgb_pred = 'Y') / count(*) AS q2,
  count(*) FILTER (WHERE xgb_pred = 'X') / count(*) AS q3 FROM (SELECT * EXCLUDE (xgb_pred), {SHIFTED} AS xgb_pred FROM fx_detections) WHERE xgb_pred <> 'N' GROUP BY 1)"""


def _face(i, j):
    """Clamped projection on the edge between classes i and j (columns of the confusion), as SQL."""
    d = [f"({r}{i} - {r}{j})" for r in "abc"]
    den = " + ".join(f"{v} * {v}" for v in d)
    num = " + ".join(f"(q{k + 1} - {r}{j}) * {d[k]}" for k, r in enumerate("abc"))
    return f"greatest(0.0, least(1.0, ({num}) / ({den})))"


@query("calibrated_fractions", REPORT + f""", {NORM}, {SHARES},
j AS (SELECT sh.*, "cTT" a1, "cTY" a2, "cTX" a3, "cYT" b1, "cYY" b2, "cYX" b3, "cXT" c1, "cXY" c2, "cXX" c3, det FROM sh CROSS JOIN md),
f AS (SELECT *, ((b2 * c3 - b3 * c2) * q1 - (a2 * c3 - a3 * c2) * q2 + (a2 * b3 - a3 * b2) * q3) / det AS p1,
  (-(b1 * c3 - b3 * c1) * q1 + (a1 * c3 - a3 * c1) * q2 - (a1 * b3 - a3 * b1) * q3) / det AS p2,
  ((b1 * c2 - b2 * c1) * q1 - (a1 * c2 - a2 * c1) * q2 + (a1 * b2 - a2 * b1) * q3) / det AS p3,
  {_face(1, 2)} AS t12, {_face(1, 3)} AS t13, {_face(2, 3)} AS t23 FROM j),
faces AS (SELECT scene_id, 1 AS k, t12 AS e1, 1 - t12 AS e2, 0.0 AS e3, * EXCLUDE (scene_id) FROM f UNION ALL
  SELECT scene_id, 2, t13, 0.0, 1 - t13, * EXCLUDE (scene_id) FROM f UNION ALL SELECT scene_id, 3, 0.0, t23, 1 - t23, * EXCLUDE (scene_id) FROM f),
res AS (SELECT *, (a1 * e1 + a2 * e2 + a3 * e3 - q1) ** 2 + (b1 * e1 + b2 * e2 + b3 * e3 - q2) ** 2 + (c1 * e1 + c2 * e2 + c3 * e3 - q3) ** 2 AS r FROM faces),
best AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY r, k) = 1),
o AS (SELECT scene_id, CASE WHEN least(p1, p2, p3) >= -1e-10 THEN greatest(p1, 0) ELSE e1 END AS f1, CASE WHEN least(p1, p2, p3) >= -1e-10 THEN greatest(p2, 0) ELSE e2 END AS f2,
  CASE WHEN least(p1, p2, p3) >= -1e-10 THEN greatest(p3, 0) ELSE e3 END AS f3 FROM best)
SELECT scene_id, round(f1 / (f1 + f2 + f3), 5) AS cal_t, round(f2 / (f1 + f2 + f3), 5) AS cal_y, round(f3 / (f1 + f2 + f3), 5) AS cal_x FROM o""")
def calibrated_fractions(spark, sf):
    c = K.matrix_of(K.normalized_confusion(M.confusion_cells(report(spark, sf))))
    d = derived(spark, sf, "fx_detections").withColumn("xgb_pred", F.expr(SHIFTED)).where("xgb_pred <> 'N'")
    n = F.count(F.lit(1))
    q = d.groupBy("scene_id").agg(*[(F.count_if(F.col("xgb_pred") == k) / n).alias(f"q{k}") for k in "TYX"])
    out = K.calibrated_fractions(q, ["qT", "qY", "qX"], c, ["cal_t", "cal_y", "cal_x"])
    return out.select("scene_id", *[F.round(k, 5).alias(k) for k in ("cal_t", "cal_y", "cal_x")])


@query("interval", with_fx("fx_detections") + """ SELECT cnn_pred, round(median(score), 6) AS median, round(quantile_cont(score, 0.025), 6) AS lo,
 round(quantile_cont(score, 0.975), 6) AS hi FROM fx_detections GROUP BY cnn_pred""")
def interval(spark, sf):
    return _rounded(M.interval(derived(spark, sf, "fx_detections"), ["cnn_pred"], "score"), "median", "lo", "hi")


# Estimates of a class share by scenario and sample size, from the detection scores.
EST = """est AS (SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS scenario, [25, 50, 100, 200, 500, 1000, 2000][1 + scene_id % 7] AS n,
  CASE WHEN id % 2 = 0 THEN 0.6 ELSE 0.1 END::DOUBLE AS truth,
  CASE WHEN id % 2 = 0 THEN 0.6 ELSE 0.1 END + (score - 0.5) * 2 / sqrt([25, 50, 100, 200, 500, 1000, 2000][1 + scene_id % 7]) AS est FROM fx_detections),
iv AS (SELECT scenario, n, truth, quantile_cont(est, 0.025) AS lo, quantile_cont(est, 0.975) AS hi FROM est GROUP BY 1, 2, 3)"""


def _estimates(spark, sf):
    sizes = F.array(*[F.lit(n) for n in (25, 50, 100, 200, 500, 1000, 2000)])
    even = F.col("id") % 2 == 0
    d = derived(spark, sf, "fx_detections").select(
        F.when(even, "a").otherwise("b").alias("scenario"), F.get(sizes, F.col("scene_id") % 7).alias("n"),
        F.when(even, 0.6).otherwise(0.1).alias("truth"), "score")
    return d.withColumn("est", F.col("truth") + (F.col("score") - 0.5) * 2 / F.sqrt("n"))


@query("min_sample_size", with_fx("fx_detections") + f""", {EST}
SELECT scenario, min(n) FILTER (WHERE lo >= truth - 0.1 AND hi <= truth + 0.1) AS min_n FROM iv GROUP BY 1""")
def min_sample_size(spark, sf):
    return K.min_sample_size(_estimates(spark, sf), ["scenario"])


@query("distinguishable", with_fx("fx_detections") + f""", {EST}
SELECT min(a.n) AS min_n FROM iv a JOIN iv b ON a.n = b.n AND a.scenario = 'a' AND b.scenario = 'b' WHERE NOT (a.lo < b.hi AND b.lo < a.hi)""")
def distinguishable(spark, sf):
    return K.distinguishable(_estimates(spark, sf), "scenario", "a", "b")


POISSON = " + ".join(f"(u >= {c})::INT" for c in M.POISSON_1)


@query("bootstrap_ci", with_fx("fx_detections") + f""", dr AS (SELECT *, {HASH.format(key="id || '|' || b || '|7'")} AS u FROM fx_detections, range(1, 21) t(b)),
w AS (SELECT b, xgb_pred AS t, cnn_pred AS p, {POISSON} AS k FROM dr),
r AS (SELECT b, c.label, sum(k) FILTER (WHERE t = c.label AND p = c.label) AS tp, sum(k) FILTER (WHERE t = c.label OR p = c.label) AS un
  FROM w CROSS JOIN (VALUES ('T'), ('Y'), ('X'), ('N')) c(label) GROUP BY 1, 2),
f AS (SELECT b, label, coalesce(2 * tp / (tp + un), 0.0) AS f1 FROM r)
SELECT label, round(median(f1), 6) AS median, round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi FROM f GROUP BY label""")
def bootstrap_ci(spark, sf):
    d = derived(spark, sf, "fx_detections").select("id", F.col("xgb_pred").alias("true_label"), F.col("cnn_pred").alias("pred_label"))
    return _rounded(M.bootstrap_ci(d, ["id"], b=20, seed=7), "median", "lo", "hi")


THINNED = "CASE WHEN (id * 7 + scene_id) % 5 > scene_id % 3 THEN mlp_pred ELSE 'N' END"
FRACTIONS = f"""fr AS (SELECT scene_id, count(*) FILTER (WHERE mlp_pred = 'T') AS "n_T", count(*) FILTER (WHERE mlp_pred = 'Y') AS "n_Y",
 count(*) FILTER (WHERE mlp_pred = 'X') AS "n_X", count(*) FILTER (WHERE mlp_pred = 'N') AS "n_N" FROM (SELECT * EXCLUDE (mlp_pred), {THINNED} AS mlp_pred FROM fx_detections) GROUP BY 1),
fs AS (SELECT fr.*, CASE WHEN "n_T" + "n_Y" + "n_X" > 0 THEN "n_T" / ("n_T" + "n_Y" + "n_X") ELSE 0.0 END AS f_t, center_lat FROM fr LEFT JOIN fx_scenes USING (scene_id))"""


def _fractions(spark, sf):
    d = derived(spark, sf, "fx_detections").withColumn("mlp_pred", F.expr(THINNED))
    return K.scene_fractions(d, "mlp_pred", BY, derived(spark, sf, "fx_scenes"))


@query("scene_fractions", with_fx("fx_detections", "fx_scenes") + f', {FRACTIONS} SELECT scene_id, "n_T", "n_Y", "n_X", "n_N", round(f_t, 6) AS f_t, center_lat FROM fs')
def scene_fractions(spark, sf):
    return _rounded(_fractions(spark, sf), "f_t")


@query("rank_correlation", with_fx("fx_detections", "fx_scenes") + f""", {FRACTIONS},
r AS (SELECT rank() OVER (ORDER BY f_t) + (count(*) OVER (PARTITION BY f_t) - 1) / 2 AS rx,
             rank() OVER (ORDER BY center_lat) + (count(*) OVER (PARTITION BY center_lat) - 1) / 2 AS ry FROM fs)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""")
def rank_correlation(spark, sf):
    return _rounded(K.rank_correlation(_fractions(spark, sf), "f_t", "center_lat"), "rho")


@query("likeness_histogram", with_fx("fx_detections") + """ SELECT CAST(b.i AS INT) AS bin, count(d.id) AS n FROM range(0, 10) b(i)
LEFT JOIN fx_detections d ON least(9, floor(least(1.0, score) * 10)) = b.i GROUP BY 1""")
def likeness_histogram(spark, sf):
    d = derived(spark, sf, "fx_detections").withColumn("t_likeness", F.least(F.lit(1.0), F.col("score")))
    return K.likeness_histogram(d)


@query("likeness_summary", with_fx("fx_detections") + """ SELECT round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std,
 round(avg(score), 6) AS soft_t, round(1 - avg(score), 6) AS soft_y FROM fx_detections""")
def likeness_summary(spark, sf):
    return _rounded(K.likeness_summary(derived(spark, sf, "fx_detections"), "score"), "mean", "median", "std", "soft_t", "soft_y")


@query("reject_counters", with_fx("fx_rows") + """, w AS (SELECT scene_id, CASE WHEN min_gap_deg IS NULL THEN 'no_gap' WHEN min_gap_deg < 20 THEN 'narrow'
  WHEN branch_count <> 3 THEN 'branches' ELSE 'accepted' END AS why FROM fx_rows)
SELECT scene_id, count(*) AS considered, count(*) FILTER (WHERE why = 'no_gap') AS no_gap, count(*) FILTER (WHERE why = 'narrow') AS narrow,
 count(*) FILTER (WHERE why = 'branches') AS branches, count(*) FILTER (WHERE why = 'accepted') AS accepted FROM w GROUP BY 1""")
def reject_counters(spark, sf):
    why = F.when(F.col("min_gap_deg").isNull(), "no_gap").when(F.col("min_gap_deg") < 20, "narrow").when(
        F.col("branch_count") != 3, "branches").otherwise("accepted")
    return M.reject_counters(derived(spark, sf, "fx_rows").withColumn("why", why), "why", ["no_gap", "narrow", "branches", "accepted"], BY)
