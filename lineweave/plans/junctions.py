"""Queries on arms round nodes and the label rules built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import arms as A
from lineweave.operators import pixels as P
from lineweave.operators import spatial as S  # noqa: F401
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, with_fx
from lineweave.plans.network import DETS, PTS, SNAP, _dets, _points
from lineweave.plans.raster import comp_sql
from lineweave.session import cut

# Small annuli suit the dense derived pixels.
RULES = A.Rules(inner=2, outer=5, min_pixels=2, min_span=1.0)
RPX = with_fx("fx_pixels", recursive=True)
ARMS = f"""{PTS}, ring AS (SELECT p.id || ':' || p.tile_id AS tile_id, f.y, f.x, (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) AS d2, f.y - p.y AS dy, f.x - p.x AS dx
  FROM pts p JOIN fx_pixels f ON f.tile_id = p.tile_id AND f.y BETWEEN p.y - 5 AND p.y + 5 AND f.x BETWEEN p.x - 5 AND p.x + 5
  WHERE (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) BETWEEN 5 AND 25),
{comp_sql("ring", "c")},
arm AS (SELECT tile_id AS pid, comp_id, count(*) AS area, sqrt(max(d2)) - sqrt(min(d2)) AS span, max(d2) >= 12.25 AS far, avg(dx) AS mx, avg(dy) AS my FROM c GROUP BY 1, 2),
ok AS (SELECT *, mx / sqrt(mx * mx + my * my) AS ux, my / sqrt(mx * mx + my * my) AS uy FROM arm WHERE area >= 2 AND span >= 1.0 AND far AND sqrt(mx * mx + my * my) > 1e-6)"""


@query("ring_arms", RPX + f", {ARMS} SELECT p.id || ':' || p.tile_id AS pid, CAST(count(ok.area) AS INT) AS n_arms, coalesce(sum(area), 0) AS area, round(coalesce(sum(ux), 0.0), 4) + 0 AS ux, round(coalesce(sum(uy), 0.0), 4) + 0 AS uy FROM pts p LEFT JOIN ok ON ok.pid = p.id || ':' || p.tile_id GROUP BY 1")
def ring_arms(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    out = A.ring_arms(px, _points(px), [5], RULES)
    arms = out.select(F.concat_ws(":", F.col("id").cast("string"), F.col("tile_id").cast("string")).alias("pid"), F.size("arms").alias("n_arms"), F.explode_outer("arms").alias("a"))
    return arms.groupBy("pid", "n_arms").agg(*[(F.round(F.coalesce(F.sum(f"a.{c}"), F.lit(0)), 4) + 0).alias(c) for c in ("area", "ux", "uy")])


@query("local_geometry", RPX + f""", {ARMS}, n AS (SELECT pid, count(*) AS n FROM ok GROUP BY 1),
ang AS (SELECT a.pid, list_sort(list(degrees(acos(greatest(-1.0, least(1.0, a.ux * b.ux + a.uy * b.uy)))))) AS g FROM ok a JOIN ok b ON a.pid = b.pid AND a.comp_id < b.comp_id GROUP BY 1),
tri AS (SELECT n.pid, n.n, g[1] AS a0, g[2] AS a1, g[3] AS a2 FROM n LEFT JOIN ang USING (pid)),
f AS (SELECT *, abs(a2 - 180) + 0.7 * (abs(a0 - 90) + abs(a1 - 90)) AS t, abs(a0 - 120) + abs(a1 - 120) + abs(a2 - 120) AS v, a2 >= 150 AND a1 <= 124 AND a0 <= 124 AS gd FROM tri)
SELECT p.id, p.tile_id, CAST(coalesce(f.n, 0) AS INT) AS arm_count, CASE WHEN f.n >= 4 THEN 'X' WHEN f.n = 3 THEN CASE WHEN gd AND t <= v + 6 THEN 'T' ELSE 'Y' END ELSE '' END AS label,
 round(CASE WHEN f.n >= 4 THEN 1.0 WHEN f.n = 3 THEN 1 / (1 + CASE WHEN gd AND t <= v + 6 THEN t ELSE v END) ELSE 0.0 END, 5) AS score
FROM pts p LEFT JOIN f ON f.pid = p.id || ':' || p.tile_id""")
def local_geometry(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    g = A.local_geometry(px, _points(px), rules=RULES)
    return g.select("id", "tile_id", "arm_count", "label", F.round("score", 5).alias("score"))


for _mode in ("robust", "robust_vote"):
    def _run(spark, sf, mode=_mode):
        px = cut(derived(spark, sf, "fx_pixels"))
        rules = A.Rules(inner=2, outer=5, min_pixels=2, min_span=1.0, mode=mode, vote_offsets=(0, 2))
        g = A.local_geometry(px, _points(px), rules=rules)
        return g.select("id", "tile_id", "arm_count", "label", F.round("score", 5).alias("score"), "sx", "sy")

    query("jitter_refine" if _mode == "robust" else "jitter_vote")(_run)


@query("best_centers")
def best_centers(spark, sf):
    from lineweave.operators.components import components

    px = cut(derived(spark, sf, "fx_pixels"))
    return A.best_centers(px, cut(components(P.branch_pixels(px))), RULES)


@query("best_centers_many")
def best_centers_many(spark, sf):
    from lineweave.operators.components import components

    px = cut(derived(spark, sf, "fx_pixels"))
    return A.best_centers(px, cut(components(P.branch_pixels(px))), RULES, max_centers=2)


@query("graph_detect")
def graph_detect(spark, sf):
    return A.graph_detect(cut(derived(spark, sf, "fx_pixels")), RULES).drop("cluster_source_kinds")


def _corrected(fn, **kw):
    def run(spark, sf):
        px = cut(derived(spark, sf, "fx_pixels"))
        return fn(_dets(spark, sf), px, rules=RULES, **kw).select("tile_id", "id", "label", "x", "y")

    return run


def read_sql(outers: tuple[int, ...], inner: int = 2) -> str:
    """``g``: what the arms round the pixel nearest to each detection say, at each outer radius."""
    radii = ", ".join(f"({o})" for o in outers)
    return PDR + f""", {DETS}, {SNAP.format(src="dets", r=2)}, oo(outer_) AS (VALUES {radii}), pl AS (SELECT DISTINCT tile_id, x, y FROM snap),
ring AS (SELECT p.tile_id || ':' || p.y || ':' || p.x || ':' || outer_ AS tile_id, outer_, f.y, f.x, f.y - p.y AS dy, f.x - p.x AS dx,
  (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) AS d2 FROM pl p CROSS JOIN oo JOIN fx_pixels f ON f.tile_id = p.tile_id
    AND f.y BETWEEN p.y - outer_ AND p.y + outer_ AND f.x BETWEEN p.x - outer_ AND p.x + outer_
  WHERE (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) > {inner * inner} AND (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) <= outer_ * outer_),
{comp_sql("ring", "c")},
arm AS (SELECT tile_id AS pid, comp_id, count(*) AS area, sqrt(max(d2)) - sqrt(min(d2)) AS span, sqrt(max(d2)) >= {inner} + 0.5 * (any_value(outer_) - {inner}) AS far,
  avg(dx) AS mx, avg(dy) AS my FROM c GROUP BY 1, 2),
ok AS MATERIALIZED (SELECT *, mx / sqrt(mx * mx + my * my) AS ux, my / sqrt(mx * mx + my * my) AS uy FROM arm WHERE area >= 2 AND span >= 1.0 AND far AND sqrt(mx * mx + my * my) > 1e-6),
n AS (SELECT pid, count(*) AS n FROM ok GROUP BY 1),
ang AS (SELECT a.pid, list_sort(list(degrees(acos(greatest(-1.0, least(1.0, a.ux * b.ux + a.uy * b.uy)))))) AS g FROM ok a JOIN ok b ON a.pid = b.pid AND a.comp_id < b.comp_id GROUP BY 1),
tri AS (SELECT n.pid, n.n, g[1] AS a0, g[2] AS a1, g[3] AS a2 FROM n LEFT JOIN ang USING (pid)),
er AS (SELECT *, abs(a2 - 180) + 0.7 * (abs(a0 - 90) + abs(a1 - 90)) AS t, abs(a0 - 120) + abs(a1 - 120) + abs(a2 - 120) AS v, a2 >= 150 AND a1 <= 124 AND a0 <= 124 AS gd FROM tri),
g AS MATERIALIZED (SELECT s.tile_id, s.id, s.x AS sx, s.y AS sy, outer_, coalesce(er.n, 0) AS arms,
  CASE WHEN er.n >= 4 THEN 'X' WHEN er.n = 3 THEN CASE WHEN gd AND t <= v + 6 THEN 'T' ELSE 'Y' END ELSE '' END AS seen,
  CASE WHEN er.n >= 4 THEN false WHEN er.n = 3 THEN abs(t - v) <= 6 ELSE true END AS unsure
  FROM snap s CROSS JOIN oo LEFT JOIN er ON er.pid = s.tile_id || ':' || s.y || ':' || s.x || ':' || outer_)"""


PDR = with_fx("fx_pixels", "fx_detections", recursive=True)
VOTES = """, w AS (SELECT tile_id, id, count(*) FILTER (WHERE seen = 'T' AND arms = 3 {sure}) AS t, count(*) FILTER (WHERE seen = 'Y' AND arms = 3 {sure}) AS v,
  count(*) FILTER (WHERE arms >= 4) AS four FROM g GROUP BY 1, 2)
SELECT d.tile_id, d.id, CASE WHEN d.label IN ({asked}) AND {won} THEN CASE WHEN w.t > w.v THEN 'T' ELSE 'Y' END ELSE d.label END AS label, d.x, d.y
FROM dets d LEFT JOIN w USING (tile_id, id)"""

query("local_recheck", read_sql((5,)) + """ SELECT d.tile_id, d.id, CASE WHEN d.label IN ('T', 'Y') AND g.seen IN ('T', 'Y') THEN g.seen ELSE d.label END AS label,
  CASE WHEN d.label IN ('T', 'Y') THEN coalesce(g.sx, d.x) ELSE d.x END AS x, CASE WHEN d.label IN ('T', 'Y') THEN coalesce(g.sy, d.y) ELSE d.y END AS y
FROM dets d LEFT JOIN g USING (tile_id, id)""")(_corrected(A.local_recheck, y_to_t=True))
query("multiradius_vote", read_sql((4, 5, 6)) + VOTES.format(sure="AND NOT unsure", asked="'T', 'Y'", won="greatest(w.t, w.v) >= 2 AND abs(w.t - w.v) >= 1"))(
    _corrected(A.multiradius_vote, outers=(4, 5, 6)))
query("x_consistency", read_sql((4, 5, 6)) + VOTES.format(sure="", asked="'X'", won="w.four <= 1 AND greatest(w.t, w.v) >= 2"))(
    _corrected(A.x_consistency, outers=(4, 5, 6)))
query("validate_detections", read_sql((5,)) + """ SELECT d.tile_id, d.id, CASE WHEN g.seen <> '' AND NOT g.unsure THEN g.seen ELSE d.label END AS label, g.sx AS x, g.sy AS y
FROM dets d JOIN g USING (tile_id, id) WHERE g.arms >= 3""")(_corrected(A.validate_detections))


# A small made-up tree over the evidence columns; real trees come as model files of the same layout.
TREE = {"feature_names": ["pred_code", "arm_count_29", "err_t_29"], "children_left": [1, -1, 3, -1, -1], "children_right": [2, -1, 4, -1, -1],
        "feature": [1, -2, 2, -2, -2], "threshold": [2.5, 0, 60.0, 0, 0], "value": [[9, 9, 9], [2, 12, 1], [9, 5, 9], [14, 2, 1], [1, 3, 11]], "classes": ["T", "Y", "X"]}
EV = """ev AS (SELECT id, cnn_pred AS label, id % 2 = 0 AS local_ambiguous,
  CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((id + scene_id) % 6 AS DOUBLE) END AS arm_count_29, CAST((id * 3) % 5 AS DOUBLE) AS arm_count_45, CAST((id * 7) % 6 AS DOUBLE) AS arm_count_61,
  mlp_pred AS label_29, svm_pred AS label_45, svm_pred AS label_61, min_gap_deg AS err_t_29, max_gap_deg / 3 AS err_y_29, min_gap_deg / 2 AS err_t_45, max_gap_deg / 4 AS err_y_45,
  min_gap_deg / 3 AS err_t_61, max_gap_deg / 5 AS err_y_61 FROM fx_detections),"""
RULE_SQL = EV + """
tr AS (SELECT *, CASE WHEN coalesce(arm_count_29, -999) <= 2.5 THEN 1 WHEN coalesce(err_t_29, -999) <= 60 THEN 3 ELSE 4 END AS tree_leaf FROM ev),
td AS (SELECT *, CASE tree_leaf WHEN 1 THEN 'Y' WHEN 3 THEN 'T' ELSE 'X' END AS dec0, CASE tree_leaf WHEN 1 THEN 10 / 15 WHEN 3 THEN 12 / 17 ELSE 8 / 15 END AS margin,
  list_filter([arm_count_29, arm_count_45, arm_count_61], lambda v: v IS NOT NULL) AS n FROM tr),
vt AS (SELECT id, v, count(*) AS c FROM (SELECT id, unnest([label_29, label_45, label_61]) AS v FROM ev) WHERE v IN ('T', 'X', 'Y') GROUP BY 1, 2),
mj AS (SELECT id, arg_max(v, c * 100 + ascii(v)) AS major, max(c) AS votes FROM vt GROUP BY 1),
s AS (SELECT td.*, len(list_filter(n, lambda v: v = 3)) AS eq3, len(list_filter(n, lambda v: v >= 4)) AS ge4, coalesce(major, '') AS major, coalesce(votes, 0) AS votes,
  coalesce((arm_count_29 = 3 AND err_t_29 + 2 < err_y_29)::INT, 0) + (arm_count_45 = 3 AND err_t_45 + 2 < err_y_45)::INT + (arm_count_61 = 3 AND err_t_61 + 2 < err_y_61)::INT AS tv,
  coalesce((arm_count_29 = 3 AND err_y_29 + 2 < err_t_29)::INT, 0) + (arm_count_45 = 3 AND err_y_45 + 2 < err_t_45)::INT + (arm_count_61 = 3 AND err_y_61 + 2 < err_t_61)::INT AS yv
  FROM td LEFT JOIN mj USING (id)),
w AS (SELECT *, CASE WHEN label <> 'X' OR dec0 <> 'X' OR ge4 >= 2 OR eq3 < 2 THEN '' WHEN major IN ('T', 'Y') AND votes >= 2 THEN major WHEN tv > yv THEN 'T' WHEN yv > tv THEN 'Y' ELSE '' END AS weak FROM s),
d AS (SELECT *, CASE WHEN weak <> '' THEN weak ELSE dec0 END AS decision FROM w),
g AS (SELECT *, CASE WHEN label NOT IN ('T', 'Y', 'X') THEN 'old_type_not_tyx' WHEN decision = label THEN 'no_change' WHEN len(n) = 0 THEN 'no_multiradius_features' WHEN margin < 0.35 THEN 'low_margin'
  WHEN votes < 2 AND NOT (decision = 'X' AND ge4 >= 2) THEN 'weak_multiradius_vote' WHEN votes >= 2 AND major <> decision THEN 'vote_disagrees_with_decision'
  WHEN decision IN ('T', 'Y') AND eq3 < 2 THEN 'needs_three_arm_stability' WHEN decision = 'X' AND ge4 < 2 THEN 'needs_four_arm_stability'
  WHEN label = 'X' AND ge4 > 1 THEN 'x_to_ty_conflicted_by_4arm' WHEN decision = 'X' AND eq3 > 1 AND ge4 < 3 THEN 'ty_to_x_conflicted_by_3arm'
  WHEN local_ambiguous AND margin < 0.5 THEN 'local_ambiguous_low_margin' ELSE 'pass' END AS gate_reason FROM d)"""


def _evidence_rows(spark, sf):
    d = derived(spark, sf, "fx_detections")
    lo, hi, i = F.col("min_gap_deg"), F.col("max_gap_deg"), F.col("id")
    return d.select("id", F.col("cnn_pred").alias("label"), (i % 2 == 0).alias("local_ambiguous"),
                    F.when(i % 7 != 0, ((i + F.col("scene_id")) % 6).cast("double")).alias("arm_count_29"), ((i * 3) % 5).cast("double").alias("arm_count_45"),
                    ((i * 7) % 6).cast("double").alias("arm_count_61"), F.col("mlp_pred").alias("label_29"), F.col("svm_pred").alias("label_45"), F.col("svm_pred").alias("label_61"),
                    lo.alias("err_t_29"), (hi / 3).alias("err_y_29"), (lo / 2).alias("err_t_45"), (hi / 4).alias("err_y_45"), (lo / 3).alias("err_t_61"), (hi / 5).alias("err_y_61"))


@query("score_tree", with_fx("fx_detections") + f", {RULE_SQL} SELECT id, tree_leaf, dec0 AS tree_decision, round(margin, 6) AS tree_margin FROM td")
def score_tree(spark, sf):
    return A.score_tree(_evidence_rows(spark, sf), TREE).select("id", "tree_leaf", "tree_decision", F.round("tree_margin", 6).alias("tree_margin"))


@query("multiradius_evidence", with_fx("fx_detections") + f""", {RULE_SQL} SELECT id, len(n) AS valid_radii, eq3 AS support_eq3, ge4 AS support_ge4, major AS majority_label,
 votes AS majority_votes, CASE WHEN tv > yv THEN 'T' WHEN yv > tv THEN 'Y' ELSE '' END AS error_vote FROM s""")
def multiradius_evidence(spark, sf):
    return A.multiradius_evidence(_evidence_rows(spark, sf)).select("id", "valid_radii", "support_eq3", "support_ge4", "majority_label", "majority_votes", "error_vote")


@query("structural_relabel", with_fx("fx_detections") + f", {RULE_SQL} SELECT id, decision, gate_reason, CASE WHEN gate_reason IN ('pass', 'no_change') THEN decision ELSE label END AS label FROM g")
def structural_relabel(spark, sf):
    return A.structural_relabel(_evidence_rows(spark, sf), TREE).select("id", "decision", "gate_reason", "label")


def _two_sources(spark, sf):
    d = _dets(spark, sf).select("tile_id", "id", "x", "y", "label", F.col("p_t").alias("score"))
    return cut(d.where("id % 2 = 0")), cut(d.where("id % 2 = 1"))


SRC = """dets AS (SELECT CAST(floor(scene_id / 10) AS INT) AS tile_id, id, x % 192 AS x, y % 192 AS y, cnn_pred AS label, score FROM fx_detections WHERE cnn_pred <> 'N'),
gr AS (SELECT * FROM dets WHERE id % 2 = 0), te AS (SELECT * FROM dets WHERE id % 2 = 1),
un AS (SELECT *, tile_id || ':' || label AS tl FROM gr UNION ALL SELECT *, tile_id || ':' || label FROM te WHERE NOT EXISTS (
  SELECT 1 FROM gr WHERE gr.tile_id = te.tile_id AND (gr.x - te.x) * (gr.x - te.x) + (gr.y - te.y) * (gr.y - te.y) <= 4)),"""


@query("fuse_simple", with_fx("fx_detections", recursive=True) + f""", {SRC} {__import__('lineweave.plans.points', fromlist=['clusters_sql']).clusters_sql('un', '<= 4', by='tl')}
SELECT tile_id, label, max(score) AS score, count(*) AS cluster_size FROM un JOIN cl USING (id) GROUP BY tile_id, label, cluster_id""")
def fuse_simple(spark, sf):
    from lineweave.operators import fusion

    g, t = (df.where("label <> 'N'").withColumn("source_kind", F.lit(k)) for df, k in zip(_two_sources(spark, sf), ("graph", "template")))
    return fusion.fuse_simple(g, t, 2.0).select("tile_id", "label", "score", "cluster_size")


@query("fuse_sources")
def fuse_sources(spark, sf):
    from lineweave.operators import fusion

    g, t = _two_sources(spark, sf)
    out = fusion.fuse_sources(g, t, cut(derived(spark, sf, "fx_pixels")), 3.0, RULES)
    return out.select("tile_id", "x", "y", "label", "score", "source_kind", "fusion_reason", "cluster_size")


def _features_sql(radii: tuple[int, ...]) -> str:
    names = ("a0", "a1", "a2", "opp_gap", "area_cv", "span_cv", "area_ratio", "span_ratio", "third_area_frac", "third_span_frac", "opp_balance", "opp_area_ratio", "opp_span_ratio")
    wide = ", ".join(
        f"max(arms) FILTER (WHERE outer_ = {r}) AS arm_count_{r}, max(nullif(seen, '')) FILTER (WHERE outer_ = {r}) AS label_{r}, "
        + ", ".join(f"round(max({n}) FILTER (WHERE outer_ = {r} AND arms = 3), 5) AS {n}_{r}" for n in ("err_t", "err_y", *names)) for r in radii)
    back = ", ".join(f"f.{n}_{r}" for r in radii for n in ("arm_count", "label", "err_t", "err_y", *names))
    return read_sql(radii) + f""", th AS (SELECT pid, list(area ORDER BY comp_id) AS ar, list(span ORDER BY comp_id) AS sp, list(ux ORDER BY comp_id) AS ux, list(uy ORDER BY comp_id) AS uy
  FROM ok GROUP BY 1 HAVING count(*) = 3),
pa AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, ux[1] * ux[2] + uy[1] * uy[2])))) AS p12, degrees(acos(greatest(-1.0, least(1.0, ux[1] * ux[3] + uy[1] * uy[3])))) AS p13,
  degrees(acos(greatest(-1.0, least(1.0, ux[2] * ux[3] + uy[2] * uy[3])))) AS p23 FROM th),
op AS (SELECT *, CASE WHEN p12 >= p13 AND p12 >= p23 THEN 3 WHEN p13 >= p23 THEN 2 ELSE 1 END AS k FROM pa),
qs AS (SELECT *, CASE WHEN k = 1 THEN 2 ELSE 1 END AS i, CASE WHEN k = 3 THEN 2 ELSE 3 END AS j FROM op),
ft AS (SELECT pid, least(p12, p13, p23) AS a0, p12 + p13 + p23 - least(p12, p13, p23) - greatest(p12, p13, p23) AS a1, greatest(p12, p13, p23) AS a2, 180 - greatest(p12, p13, p23) AS opp_gap,
  list_stddev_pop(ar) / list_avg(ar) AS area_cv, list_stddev_pop(sp) / list_avg(sp) AS span_cv, list_max(ar) / list_min(ar) AS area_ratio, list_max(sp) / list_min(sp) AS span_ratio,
  ar[k] / list_sum(ar) AS third_area_frac, sp[k] / list_sum(sp) AS third_span_frac, abs(ar[i] - ar[j]) / (ar[i] + ar[j]) AS opp_balance,
  (ar[i] + ar[j]) / ar[k] AS opp_area_ratio, (sp[i] + sp[j]) / sp[k] AS opp_span_ratio FROM qs),
f AS (SELECT g.tile_id, g.id, {wide} FROM (SELECT g.*, er.t AS err_t, er.v AS err_y, ft.* FROM g LEFT JOIN er ON er.pid = g.tile_id || ':' || g.sy || ':' || g.sx || ':' || g.outer_
  LEFT JOIN ft ON ft.pid = er.pid) g GROUP BY 1, 2)
SELECT d.tile_id, d.id, d.x, d.y, d.label, {back} FROM dets d LEFT JOIN f USING (tile_id, id)"""


@query("radius_features", _features_sql((4, 5, 6)))
def radius_features(spark, sf):
    from lineweave.operators import fusion

    out = fusion.radius_features(_dets(spark, sf), cut(derived(spark, sf, "fx_pixels")), (4, 5, 6), RULES).drop("p_t")
    return out.withColumns({c: F.round(c, 5) for c, kind in out.dtypes if kind == "double"})


RULE = {"feature_names": ["arm_count_29", "err_t_29"], "children_left": [1, -1, 3, -1, -1], "children_right": [2, -1, 4, -1, -1], "feature": [0, -2, 1, -2, -2],
        "threshold": [2.5, 0, 60.0, 0, 0], "decision": [None, "Y", None, "T", "Y"]}


@query("tree_rule", with_fx("fx_detections") + f", {EV.rstrip(',')}" + """ SELECT id, CASE WHEN label NOT IN ('T', 'Y') OR arm_count_29 IS NULL THEN label WHEN arm_count_29 <= 2.5 THEN 'Y'
 WHEN err_t_29 <= 60 THEN 'T' ELSE 'Y' END AS label FROM ev""")
def tree_rule(spark, sf):
    from lineweave.operators import fusion

    return fusion.tree_rule(_evidence_rows(spark, sf), RULE).select("id", "label")


@query("density_profile", RPX.replace("WITH RECURSIVE", "WITH") + f""", {PTS}, b AS (SELECT tile_id, count(*) FILTER (WHERE deg >= 3) / count(*) AS r FROM deg GROUP BY 1)
SELECT tile_id, CAST(r < 0.04 AS INT) AS low_branch, CASE WHEN r < 0.04 THEN 12 ELSE 5 END AS nms_distance, 13 AS outer_radius, CASE WHEN r < 0.04 THEN 2 ELSE 1 END AS max_centers FROM b""")
def density_profile(spark, sf):
    from lineweave.operators import fusion

    out = fusion.density_profile(P.branch_ratio(derived(spark, sf, "fx_pixels")), threshold=0.04)
    return out.select("tile_id", F.col("low_branch").cast("int").alias("low_branch"), "nms_distance", "outer_radius", "max_centers")


@query("template_scan")
def template_scan(spark, sf):
    """A T, a Y and an X of 9 px against the derived pixels."""
    import numpy as np

    from lineweave.operators import fusion

    t, y, x = np.zeros((9, 9)), np.zeros((9, 9)), np.zeros((9, 9))
    t[4, :], t[4:, 4] = 255, 255
    y[4:, 4] = 255
    for i in range(5):
        y[i, i], y[i, 8 - i] = 255, 255
    x[4, :], x[:, 4] = 255, 255
    out = fusion.template_scan(derived(spark, sf, "fx_pixels"), [("T", t), ("Y", y), ("X", x)], 0.45)
    return out.select("tile_id", "label", "y", "x", F.round("score", 5).alias("score"))


@query("geometric_sweep")
def geometric_sweep(spark, sf):
    """All 72 cells over one reading of the circles; the fourth head of the folded detections is the truth."""
    from lineweave.operators import rings as R
    from lineweave.operators import sweeps as W

    rows = derived(spark, sf, "fx_detections").select(F.floor(F.col("scene_id") / 10).cast("int").alias("tile_id"), "id", (F.col("x") % 192).alias("x"), (F.col("y") % 192).alias("y"),
                                                      F.col("xgb_pred").alias("true_label"), F.col("cnn_pred").alias("pred_label"), "branch_count", "max_gap_deg")
    table = R.collinearity_table(derived(spark, sf, "fx_pixels"), rows.select("tile_id", "id", "x", "y"), (12, 16, 20, 25))
    wide = table.groupBy("tile_id", "id").agg(*[F.max(F.when(F.col("radius") == r, F.col(c))).alias(f"{c}_{r}") for r in (12, 16, 20, 25) for c in ("n_arms", "deviation")])
    return W.geometric_sweep(cut(rows.join(wide, ["tile_id", "id"])))


@query("component_arms")
def component_arms(spark, sf):
    from lineweave.operators.components import components

    px = cut(derived(spark, sf, "fx_pixels"))
    return A.component_arms(px, cut(components(P.branch_pixels(px))), RULES)
