"""Queries on the sparse line scenes, with the radii that real scenes are read with: the detector, its parts and its corrections.

The tiles are 768 px wide, so lines, windows and groups cross the blocks that tasks work on."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import arms as A
from lineweave.operators import components as C
from lineweave.operators import detector as D
from lineweave.operators import paths as T
from lineweave.operators import pixels as P
from lineweave.operators import rings as R
from lineweave.operators import sweeps as W
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, in_order, with_fx
from lineweave.plans.network import _grid_sql, _round_f1, ring_sql
from lineweave.plans.raster import comp_sql
from lineweave.session import cut, shuffled

RULES = A.Rules()
LINES = with_fx("fx_lines", "fx_nodes", recursive=True)
LDEG = """deg AS MATERIALIZED (SELECT p.tile_id, p.y, p.x, CAST(count(q.x) AS INT) AS deg FROM fx_lines p LEFT JOIN fx_lines q
  ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND NOT (q.x = p.x AND q.y = p.y) GROUP BY 1, 2, 3)"""
SHARES = "shares AS (SELECT tile_id, count(*) FILTER (WHERE deg >= 3) / count(*) AS branch_ratio FROM deg GROUP BY 1)"


def reading_sql(places: str, pre: str = "", rules: A.Rules = RULES) -> str:
    """``{pre}rd``: what the arms say at each ``(tile_id, y, x, outer_)`` of ``places``, by ``rules``."""
    p, inner = pre, rules.inner
    return f"""{p}ring AS (SELECT p.tile_id || ':' || p.y || ':' || p.x || ':' || outer_ AS tile_id, outer_, f.y, f.x, f.y - p.y AS dy, f.x - p.x AS dx,
  (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) AS d2 FROM (SELECT DISTINCT tile_id, y, x, outer_ FROM {places}) p JOIN fx_lines f ON f.tile_id = p.tile_id
    AND f.y BETWEEN p.y - outer_ AND p.y + outer_ AND f.x BETWEEN p.x - outer_ AND p.x + outer_
  WHERE (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) > {inner * inner} AND (f.y - p.y) * (f.y - p.y) + (f.x - p.x) * (f.x - p.x) <= outer_ * outer_),
{comp_sql(f"{p}ring", f"{p}cc", pre=p)},
{p}arm AS (SELECT tile_id AS pid, comp_id, count(*) AS area, sqrt(max(d2)) - sqrt(min(d2)) AS span, sqrt(max(d2)) >= {inner} + 0.5 * (any_value(outer_) - {inner}) AS far,
  avg(dx) AS mx, avg(dy) AS my FROM {p}cc GROUP BY 1, 2),
{p}ok AS MATERIALIZED (SELECT *, mx / sqrt(mx * mx + my * my) AS ux, my / sqrt(mx * mx + my * my) AS uy FROM {p}arm
  WHERE area >= {rules.min_pixels} AND span >= {rules.min_span} AND far AND sqrt(mx * mx + my * my) > 1e-6),
{p}n AS (SELECT pid, count(*) AS n FROM {p}ok GROUP BY 1),
{p}ang AS (SELECT a.pid, list_sort(list(degrees(acos(greatest(-1.0, least(1.0, a.ux * b.ux + a.uy * b.uy)))))) AS g FROM {p}ok a JOIN {p}ok b ON a.pid = b.pid AND a.comp_id < b.comp_id GROUP BY 1),
{p}tri AS (SELECT n.pid, n.n, g[1] AS a0, g[2] AS a1, g[3] AS a2 FROM {p}n n LEFT JOIN {p}ang USING (pid)),
{p}er AS (SELECT *, abs(a2 - 180) + 0.7 * (abs(a0 - 90) + abs(a1 - 90)) AS t, abs(a0 - 120) + abs(a1 - 120) + abs(a2 - 120) AS v, a2 >= {rules.t_min_largest} AND a1 <= {rules.t_max_side} AND a0 <= {rules.t_max_side} AS gd FROM {p}tri),
{p}rd AS MATERIALIZED (SELECT s.tile_id, s.y, s.x, s.outer_, coalesce(e.n, 0) AS arms, CASE WHEN e.n >= 4 THEN 'X' WHEN e.n = 3 THEN CASE WHEN gd AND t <= v + {rules.margin} THEN 'T' ELSE 'Y' END ELSE '' END AS seen,
  CASE WHEN e.n >= 4 THEN 0.0 WHEN e.n = 3 THEN CASE WHEN gd AND t <= v + {rules.margin} THEN t ELSE v END END AS err, CASE WHEN e.n = 3 THEN t END AS err_t, CASE WHEN e.n = 3 THEN v END AS err_y,
  CASE WHEN e.n >= 4 THEN false WHEN e.n = 3 THEN abs(t - v) <= {rules.margin} ELSE true END AS unsure,
  CASE WHEN e.n >= 4 THEN 1.0 WHEN e.n = 3 THEN 1 / (1 + CASE WHEN gd AND t <= v + {rules.margin} THEN t ELSE v END) ELSE 0.0 END AS score
  FROM (SELECT DISTINCT tile_id, y, x, outer_ FROM {places}) s LEFT JOIN {p}er e ON e.pid = s.tile_id || ':' || s.y || ':' || s.x || ':' || s.outer_)"""


def snap_sql(src: str, r: int = RULES.inner) -> str:
    key = "((f.x - d.x) * (f.x - d.x) + (f.y - d.y) * (f.y - d.y)) * 1000000 + f.y * 1000 + f.x"
    return f"""snap AS MATERIALIZED (SELECT d.tile_id, d.id, arg_min(f.x, {key}) AS x, arg_min(f.y, {key}) AS y
  FROM {src} d JOIN fx_lines f ON f.tile_id = d.tile_id AND f.x BETWEEN d.x - {r} AND d.x + {r} AND f.y BETWEEN d.y - {r} AND d.y + {r} GROUP BY 1, 2)"""


def _lines(spark, sf):
    return in_order(derived(spark, sf, "fx_lines"))


def _guesses(spark, sf):
    return cut(derived(spark, sf, "fx_nodes").select("tile_id", "id", "x", "y", "label"))


def best_sql(comps: str, pre: str) -> str:
    """``{pre}best``: the best centre of each group of ``comps(tile_id, y, x, comp_id)``."""
    p = pre
    return f"""{p}tried AS MATERIALIZED (SELECT DISTINCT c.tile_id, c.comp_id, f.y, f.x, {RULES.outer} AS outer_ FROM {comps} c JOIN fx_lines f
  ON f.tile_id = c.tile_id AND abs(f.y - c.y) + abs(f.x - c.x) <= 1 AND f.y BETWEEN c.y - 1 AND c.y + 1 AND f.x BETWEEN c.x - 1 AND c.x + 1), {reading_sql(f"{p}tried", p)},
{p}mid AS (SELECT tile_id, comp_id, avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM {comps} GROUP BY 1, 2),
{p}best AS (SELECT * FROM (SELECT t.tile_id, t.comp_id, m.area, t.x, t.y, r.seen, r.arms, r.score, row_number() OVER (PARTITION BY t.tile_id, t.comp_id
    ORDER BY -r.arms, round(r.err, 9), round(sqrt((t.x - m.cx) * (t.x - m.cx) + (t.y - m.cy) * (t.y - m.cy)), 6), t.y, t.x) AS k
  FROM {p}tried t JOIN {p}rd r USING (tile_id, y, x) JOIN {p}mid m USING (tile_id, comp_id) WHERE r.arms >= 3 AND r.seen <> '') WHERE k = 1)"""


BRANCH = f"{LINES}, {LDEG}, br AS (SELECT tile_id, y, x FROM deg WHERE deg >= 3), {comp_sql('br', 'comps', pre='bb')}"


@query("line_scenes", f"{LINES}, {LDEG} SELECT tile_id, count(*) AS n_pixels, count(*) FILTER (WHERE deg = 1) AS n_endpoints, count(*) FILTER (WHERE deg >= 3) AS n_branch FROM deg GROUP BY 1")
def line_scenes(spark, sf):
    return P.branch_ratio(derived(spark, sf, "fx_lines")).select("tile_id", "n_pixels", "n_endpoints", "n_branch")


# ---------------------------------------------------------------- settings by density

AUTO = D.Detector(mode="graph", auto_scale=True)


@query("detector_settings", f"""{LINES}, {LDEG}, {SHARES}, s AS (SELECT *, CASE WHEN branch_ratio < 0.008 THEN 0 WHEN branch_ratio < 0.02 THEN 1 WHEN branch_ratio < 0.03 THEN 2 ELSE 3 END AS k FROM shares)
SELECT tile_id, round(branch_ratio, 9) AS branch_ratio, CASE WHEN k = 3 THEN 13 ELSE 21 END AS outer, CASE WHEN k = 3 THEN 5 ELSE 12 END AS nms, CASE k WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS centers,
 CASE WHEN k = 3 THEN 0 ELSE 3 END AS bridge, CAST(k < 3 AS INT) AS recovery, CASE k WHEN 0 THEN 3 WHEN 3 THEN 10 ELSE 1 END AS endpoint, CAST(k = 0 AS INT) AS x_consistency,
 CAST(k < 3 AS INT) AS debias, CASE k WHEN 0 THEN 10 WHEN 3 THEN 0 ELSE 12 END AS merge, CAST(k < 2 AS INT) AS corner, CASE WHEN k < 2 THEN 3 ELSE 0 END AS corner_endpoint,
 CAST(CASE WHEN k < 2 THEN 0.05 ELSE -1 END AS DOUBLE) AS corner_score, CAST(k IN (1, 2) AS INT) AS best_fallback FROM s""")
def detector_settings(spark, sf):
    """Settings of each tile by its share of branch pixels, all tiers."""
    out = D.detector_settings(P.branch_ratio(derived(spark, sf, "fx_lines")).select("tile_id", "branch_ratio"), AUTO)
    flags = {c: F.col(c).cast("int") for c in ("recovery", "x_consistency", "debias", "corner", "best_fallback")}
    return out.withColumns({**flags, "branch_ratio": F.round("branch_ratio", 9), "corner_score": F.coalesce("corner_score", F.lit(-1.0))}).drop("min_score")


# ---------------------------------------------------------------- label corrections at their own radii

def _corrected(fn, **kw):
    def run(spark, sf):
        return fn(_guesses(spark, sf), _lines(spark, sf), **kw).select("tile_id", "id", "label", "x", "y")

    return run


def guess_sql(outers: tuple[int, ...], only: str, rules: A.Rules = RULES) -> str:
    radii = ", ".join(f"({o})" for o in outers)
    return f"""{LINES}, dets AS (SELECT tile_id, id, x, y, label FROM fx_nodes), asked AS (SELECT * FROM dets WHERE {only}), {snap_sql('asked', max(2, rules.inner))},
pl AS (SELECT s.tile_id, s.y, s.x, CAST(o AS INT) AS outer_ FROM snap s CROSS JOIN (VALUES {radii}) oo(o)), {reading_sql('pl', rules=rules)}, g AS (SELECT s.id, r.* FROM snap s JOIN rd r USING (tile_id, y, x))"""


VOTES = """, w AS (SELECT tile_id, id, count(*) FILTER (WHERE seen = 'T' AND arms = 3 {sure}) AS t, count(*) FILTER (WHERE seen = 'Y' AND arms = 3 {sure}) AS v, count(*) FILTER (WHERE arms >= 4) AS four
  FROM g GROUP BY 1, 2)"""

query("local_recheck_lines", guess_sql((13,), "label IN ('T', 'Y')") + """ SELECT d.tile_id, d.id, CASE WHEN d.label IN ('T', 'Y') AND g.seen IN ('T', 'Y') THEN g.seen ELSE d.label END AS label,
  coalesce(g.x, d.x) AS x, coalesce(g.y, d.y) AS y FROM dets d LEFT JOIN g USING (tile_id, id)""")(_corrected(A.local_recheck, y_to_t=True))
query("validate_lines", guess_sql((13,), "true") + """ SELECT d.tile_id, d.id, CASE WHEN g.seen <> '' AND NOT g.unsure THEN g.seen ELSE d.label END AS label, g.x, g.y
FROM dets d JOIN g USING (tile_id, id) WHERE g.arms >= 3""")(_corrected(A.validate_detections))
query("multiradius_vote_lines", guess_sql((29, 45, 61), "label IN ('T', 'Y')") + VOTES.format(sure="AND NOT unsure") + """
SELECT d.tile_id, d.id, CASE WHEN greatest(w.t, w.v) >= 2 AND abs(w.t - w.v) >= 1 THEN CASE WHEN w.t > w.v THEN 'T' ELSE 'Y' END ELSE d.label END AS label, d.x, d.y
FROM dets d LEFT JOIN w USING (tile_id, id)""")(_corrected(A.multiradius_vote))
query("x_consistency_lines", guess_sql((15, 19, 23), "label = 'X'") + VOTES.format(sure="") + """
SELECT d.tile_id, d.id, CASE WHEN w.four <= 1 AND greatest(w.t, w.v) >= 2 THEN CASE WHEN w.t > w.v THEN 'T' ELSE 'Y' END ELSE d.label END AS label, d.x, d.y
FROM dets d LEFT JOIN w USING (tile_id, id)""")(_corrected(A.x_consistency))


@query("x_evidence", guess_sql((15, 19, 23), "label = 'X'") + VOTES.format(sure="") + """
SELECT d.tile_id, d.id, CASE WHEN w.four <= 1 AND greatest(w.t, w.v) >= 2 THEN CASE WHEN w.t > w.v THEN 'T' ELSE 'Y' END ELSE d.label END AS label,
 CASE WHEN w.four <= 1 AND greatest(w.t, w.v) >= 2 THEN 'x_consistency' END AS post, w.four AS x_four, w.t + w.v AS x_three,
 CASE WHEN w.t + w.v = 0 THEN '' WHEN w.t > w.v THEN 'T' WHEN w.t IS NOT NULL THEN 'Y' END AS x_major, greatest(w.t, w.v) AS x_votes FROM dets d LEFT JOIN w USING (tile_id, id)""")
def x_evidence(spark, sf):
    """What three circles see round each X, and the label that follows."""
    dets = _guesses(spark, sf).withColumn("post", F.lit(None).cast("string"))
    return D.x_evidence(dets, _lines(spark, sf)).drop("x", "y")


# ---------------------------------------------------------------- centres of components

@query("best_centers_lines", f"{BRANCH}, {best_sql('comps', 'q')} SELECT tile_id, comp_id, x, y, seen AS label, arms AS arm_count, round(score, 6) AS score FROM qbest")
def best_centers_lines(spark, sf):
    px = _lines(spark, sf)
    out = A.best_centers(px, cut(C.components(P.branch_pixels(px))))
    return out.select("tile_id", "comp_id", "x", "y", "label", "arm_count", F.round("score", 6).alias("score"))


def _kernel(r: int, name: str) -> str:
    rows = ", ".join(f"({dy}, {dx})" for dy, k in sorted(P.ellipse(2 * r + 1).items()) for dx in range(-k, k + 1))
    return f"{name}(dy, dx) AS (VALUES {rows})"


def whole_sql(comps: str, pre: str) -> str:
    """``{pre}whole``: each group of ``comps`` read as a whole, by the arms between two dilations of it."""
    p = pre
    return f"""{_kernel(RULES.outer, p + 'ko')}, {_kernel(RULES.inner, p + 'ki')},
{p}reach AS (SELECT DISTINCT c.tile_id AS t, c.comp_id AS c, f.y, f.x FROM {comps} c CROSS JOIN {p}ko k JOIN fx_lines f ON f.tile_id = c.tile_id AND f.y = c.y + k.dy AND f.x = c.x + k.dx),
{p}core AS (SELECT DISTINCT c.tile_id AS t, c.comp_id AS c, c.y + k.dy AS y, c.x + k.dx AS x FROM {comps} c CROSS JOIN {p}ki k),
{p}band AS (SELECT t || ':' || c AS tile_id, t, c, y, x FROM {p}reach ANTI JOIN {p}core USING (t, c, y, x)),
{comp_sql(f"{p}band", f"{p}parts", pre=p + "cut")},
{p}vec AS (SELECT a.t, a.c, a.part, a.vx / sqrt(a.vx * a.vx + a.vy * a.vy) AS ux, a.vy / sqrt(a.vx * a.vx + a.vy * a.vy) AS uy FROM (
  SELECT g.t, g.c, g.comp_id AS part, avg(g.x) - any_value(m.cx) AS vx, avg(g.y) - any_value(m.cy) AS vy FROM {p}parts g
  JOIN (SELECT tile_id, comp_id, avg(x) AS cx, avg(y) AS cy FROM {comps} GROUP BY 1, 2) m ON m.tile_id = g.t AND m.comp_id = g.c GROUP BY 1, 2, 3 HAVING count(*) >= {RULES.min_pixels}) a
  WHERE sqrt(a.vx * a.vx + a.vy * a.vy) >= 1e-6),
{p}wn AS (SELECT t, c, count(*) AS n FROM {p}vec GROUP BY 1, 2),
{p}wa AS (SELECT a.t, a.c, list_sort(list(degrees(acos(greatest(-1.0, least(1.0, a.ux * b.ux + a.uy * b.uy)))))) AS g FROM {p}vec a JOIN {p}vec b ON a.t = b.t AND a.c = b.c AND a.part < b.part GROUP BY 1, 2),
{p}we AS (SELECT t, c, n, abs(g[3] - 180) + 0.7 * (abs(g[1] - 90) + abs(g[2] - 90)) AS et, abs(g[1] - 120) + abs(g[2] - 120) + abs(g[3] - 120) AS ev, g[3] >= 150 AND g[2] <= 124 AND g[1] <= 124 AS gd
  FROM {p}wn LEFT JOIN {p}wa USING (t, c)),
{p}whole AS (SELECT t AS tile_id, c AS comp_id, n AS arms, CASE WHEN n >= 4 THEN 'X' WHEN n = 3 THEN CASE WHEN gd AND et <= ev + 6 THEN 'T' ELSE 'Y' END ELSE '' END AS seen,
  CASE WHEN n >= 4 THEN least(1.0, 0.6 + 0.1 * least(n, 5)) WHEN n = 3 THEN 1 / (1 + CASE WHEN gd AND et <= ev + 6 THEN et ELSE ev END) ELSE 0.0 END AS score FROM {p}we)"""


@query("component_arms_lines", f"{BRANCH}, {whole_sql('comps', 'z')} SELECT tile_id, comp_id, arms AS arm_count, seen AS label, round(score, 6) AS score FROM zwhole WHERE arms >= 3")
def component_arms_lines(spark, sf):
    px = _lines(spark, sf)
    out = A.component_arms(px, cut(C.components(P.branch_pixels(px)))).where("arm_count >= 3")
    return out.select("tile_id", "comp_id", "arm_count", "label", F.round("score", 6).alias("score"))


def center_sql(mode: str) -> str:
    """Read each branch component at its mean, or at the pixel nearest to it; then as a whole where that shows no label."""
    mean = "mean AS (SELECT tile_id, comp_id AS id, CAST(round_even(avg(x), 0) AS INT) AS x, CAST(round_even(avg(y), 0) AS INT) AS y FROM comps GROUP BY 1, 2)"
    spot = "spot AS (SELECT tile_id, id, x, y, 'centroid' AS src FROM mean)" if mode == "centroid" else snap_sql("mean") + """,
spot AS (SELECT m.tile_id, m.id, coalesce(s.x, m.x) AS x, coalesce(s.y, m.y) AS y, CASE WHEN s.x IS NULL THEN 'centroid' ELSE 'centroid_snap' END AS src FROM mean m LEFT JOIN snap s USING (tile_id, id))"""
    return f"""{BRANCH}, {mean}, {spot}, pl AS (SELECT s.tile_id, s.y, s.x, {RULES.outer} AS outer_ FROM spot s JOIN fx_lines USING (tile_id, y, x)), {reading_sql('pl', 'q')},
got AS (SELECT s.tile_id, s.id AS comp_id, s.x, s.y, r.seen, r.arms, r.score, s.src FROM spot s JOIN qrd r USING (tile_id, y, x) WHERE r.seen <> ''),
rest AS (SELECT * FROM comps ANTI JOIN got USING (tile_id, comp_id)), {whole_sql('rest', 'z')}
SELECT tile_id, comp_id, x, y, seen AS label, arms AS arm_count, round(score, 6) AS score, src AS center_source FROM got WHERE arms >= 3
UNION ALL SELECT w.tile_id, w.comp_id, m.x, m.y, w.seen, w.arms, round(w.score, 6), 'component_fallback' FROM zwhole w JOIN mean m ON m.tile_id = w.tile_id AND m.id = w.comp_id WHERE w.arms >= 3 AND w.seen <> ''"""


def _centers(mode: str, **kw):
    def run(spark, sf):
        px = _lines(spark, sf)
        out = D.component_centers(px, cut(C.components(P.branch_pixels(px))), center=mode, **kw)
        return out.select("tile_id", "comp_id", "x", "y", "label", "arm_count", F.round("score", 6).alias("score"), "center_source")

    return run


for _mode in ("centroid", "snap"):
    query(f"centers_{_mode}", center_sql(_mode))(_centers(_mode))
query("centers_best", f"""{BRANCH}, {best_sql('comps', 'q')}, rest AS (SELECT * FROM comps ANTI JOIN qbest USING (tile_id, comp_id)), {whole_sql('rest', 'z')},
mean AS (SELECT tile_id, comp_id, CAST(round_even(avg(x), 0) AS INT) AS x, CAST(round_even(avg(y), 0) AS INT) AS y FROM comps GROUP BY 1, 2)
SELECT tile_id, comp_id, x, y, seen AS label, arms AS arm_count, round(score, 6) AS score, 'best_search' AS center_source FROM qbest
UNION ALL SELECT w.tile_id, w.comp_id, m.x, m.y, w.seen, w.arms, round(w.score, 6), 'component_fallback' FROM zwhole w JOIN mean m USING (tile_id, comp_id) WHERE w.arms >= 3 AND w.seen <> ''""")(_centers("best"))


# ---------------------------------------------------------------- what was missed

SHARP = """sharp AS (SELECT a.tile_id, a.y, a.x FROM (SELECT d.tile_id, d.y, d.x, list(f.y - d.y ORDER BY f.y, f.x) AS ys, list(f.x - d.x ORDER BY f.y, f.x) AS xs FROM deg d JOIN fx_lines f
  ON f.tile_id = d.tile_id AND f.y BETWEEN d.y - 1 AND d.y + 1 AND f.x BETWEEN d.x - 1 AND d.x + 1 AND NOT (f.y = d.y AND f.x = d.x) WHERE d.deg = 2 GROUP BY 1, 2, 3) a
  WHERE degrees(acos(greatest(-1.0, least(1.0, (xs[1] * xs[2] + ys[1] * ys[2]) / (sqrt(xs[1] * xs[1] + ys[1] * ys[1]) * sqrt(xs[2] * xs[2] + ys[2] * ys[2])))))) <= 150)"""
RECOVERY = f"""{BRANCH}, {best_sql('comps', 'q')}, {_kernel(2, 'k2')}, {_kernel(10, 'k10')}, {_kernel(3, 'k3')}, {SHARP},
near_branch AS (SELECT DISTINCT tile_id, y + dy AS y, x + dx AS x FROM br CROSS JOIN k2), near_end AS (SELECT DISTINCT tile_id, y + dy AS y, x + dx AS x FROM deg CROSS JOIN k10 WHERE deg <= 1),
near_end3 AS (SELECT DISTINCT tile_id, y + dy AS y, x + dx AS x FROM deg CROSS JOIN k3 WHERE deg <= 1),
weak AS (SELECT tile_id, y, x FROM deg SEMI JOIN near_branch USING (tile_id, y, x) WHERE deg = 2
  UNION SELECT tile_id, y, x FROM deg SEMI JOIN near_end USING (tile_id, y, x) WHERE deg = 2
  UNION SELECT tile_id, y, x FROM deg SEMI JOIN near_end3 USING (tile_id, y, x) SEMI JOIN sharp USING (tile_id, y, x) WHERE deg = 2),
free AS (SELECT w.*, s.x IS NOT NULL AS corner FROM weak w LEFT JOIN sharp s USING (tile_id, y, x) WHERE NOT EXISTS (
  SELECT 1 FROM qbest b WHERE b.tile_id = w.tile_id AND (b.x - w.x) * (b.x - w.x) + (b.y - w.y) * (b.y - w.y) <= 25)),
{comp_sql('free', 'grp', pre='g')}, fit AS (SELECT tile_id, comp_id, max(corner) AS corner FROM grp GROUP BY 1, 2 HAVING count(*) <= 180), small AS (SELECT grp.* FROM grp SEMI JOIN fit USING (tile_id, comp_id)),
{best_sql('small', 'r')}"""


@query("sparse_recovery", RECOVERY + """ SELECT b.tile_id, b.comp_id, b.x, b.y, b.seen AS label, b.arms AS arm_count, round(b.score, 6) AS score, b.area,
 CASE WHEN f.corner THEN 'sparse_recovery_corner' ELSE 'sparse_recovery' END AS center_source FROM rbest b JOIN fit f USING (tile_id, comp_id) WHERE b.score >= CASE WHEN f.corner THEN 0.05 ELSE 0.12 END""")
def sparse_recovery(spark, sf):
    """Nodes with a broken arm, found again from the ends and corners near them."""
    px = _lines(spark, sf)
    branch = cut(P.branch_pixels(px))
    found = cut(A.best_centers(px, cut(C.components(branch))))
    out = D.sparse_recovery(px, branch, found, corner=True, corner_endpoint=3, corner_score=0.05)
    return out.select("tile_id", "comp_id", "x", "y", "label", "arm_count", F.round("score", 6).alias("score"), "area", "center_source")


# ---------------------------------------------------------------- rules of sparse scenes

BIAS_COLUMNS = {
    "branch_ratio": "CASE scene_id % 4 WHEN 0 THEN 0.004 WHEN 1 THEN 0.015 WHEN 2 THEN 0.05 ELSE NULL END",
    "label": "cnn_pred",
    "source_kind": "CASE id % 7 WHEN 0 THEN 'template' WHEN 1 THEN 'hybrid' ELSE 'graph' END",
    "center_source": "CASE branch_count + agreement WHEN 2 THEN 'component_fallback' WHEN 3 THEN 'sparse_recovery_corner' WHEN 4 THEN 'centroid' WHEN 5 THEN 'sparse_recovery' WHEN 6 THEN 'sparse_recovery_corner' ELSE 'best_search' END",
    "score": "CASE WHEN id % 23 = 0 THEN NULL ELSE CASE WHEN agreement < 2 THEN proposal_score / 400 ELSE proposal_score / 6.0 END END",
    "x_four": "CASE WHEN id % 29 = 0 THEN NULL ELSE CAST((id * 3 + scene_id) % 5 AS INT) END",
    "x_three": "CAST((id * 5 + scene_id) % 4 AS INT)",
    "x_major": "CASE mlp_pred WHEN 'N' THEN NULL WHEN 'X' THEN '' ELSE mlp_pred END",
    "x_votes": "CAST((id + scene_id * 3) % 4 AS INT)",
    "local_ambiguous": "CASE WHEN id % 31 = 0 THEN NULL ELSE svm_pred IN ('T', 'N') END",
    "arm_count": "CAST(3 + (id + scene_id) % 3 AS INT)",
    "area": "CAST(1 + id % 6 AS BIGINT)",
    "arm_count_29": "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(2 + id % 4 AS INT) END",
    "label_29": "xgb_pred",
    "post": "CASE WHEN (id + scene_id) % 2 = 0 THEN 'x_consistency' END",
    "local_err_t": "min_gap_deg",
    "local_err_y": "CASE WHEN svm_pred = 'X' THEN max_gap_deg / 8 ELSE max_gap_deg END",
}
BIAS_SQL = with_fx("fx_rows") + ", b AS (SELECT scene_id, id, " + ", ".join(f"{v} AS {k}" for k, v in BIAS_COLUMNS.items()) + " FROM fx_rows)" + """,
c AS (SELECT *, source_kind IN ('graph', 'hybrid') AS wing, branch_ratio < 0.008 AS ultra, branch_ratio >= 0.008 AS mid, coalesce(x_four, 0) AS four, coalesce(local_ambiguous, true) AS unsure,
  x_major IN ('T', 'Y') AS ty FROM b),
kept AS (SELECT * FROM c WHERE NOT coalesce(source_kind = 'graph' AND center_source = 'component_fallback' AND score < 0.01, false)
  AND NOT coalesce(wing AND label = 'X' AND mid AND four <= 3 AND x_three <= 1 AND center_source = 'sparse_recovery_corner' AND arm_count >= 4 AND area >= 3, false)
  AND NOT coalesce(wing AND label = 'Y' AND mid AND center_source = 'centroid' AND arm_count = 3 AND score < 0.03 AND local_err_y > 120, false)),
v AS (SELECT *, CASE
  WHEN wing AND label = 'X' THEN CASE
    WHEN mid AND four <= 3 AND x_three <= 1 THEN CASE WHEN ty AND x_votes >= 1 THEN {'t': x_major, 'w': 'moderate_weak_x_vote'} ELSE {'t': 'Y', 'w': 'moderate_weak_x'} END
    WHEN four <= 2 AND x_three >= 1 AND ty AND x_votes >= 1 THEN {'t': x_major, 'w': 'three_arm_majority'}
    WHEN four <= 1 AND x_three <= 1 THEN {'t': 'Y', 'w': 'weak_support'}
    WHEN center_source = 'component_fallback' AND four <= 1 THEN {'t': 'Y', 'w': 'weak_fallback'}
    WHEN four <= 1 AND x_votes >= 1 AND ty THEN CASE WHEN x_major = 'T' AND unsure THEN {'t': 'Y', 'w': 'weak_t_vote'} ELSE {'t': x_major, 'w': 'weak_majority'} END
    ELSE {'t': label, 'w': 'keep'} END
  WHEN wing AND label = 'T' THEN CASE
    WHEN mid AND post = 'x_consistency' AND center_source IN ('sparse_recovery_corner', 'sparse_recovery') AND arm_count >= 4 THEN {'t': 'Y', 'w': 'moderate_x_t'}
    WHEN mid AND center_source = 'centroid' AND arm_count = 3 AND score < 0.02 THEN {'t': 'Y', 'w': 'moderate_low_score_t'}
    WHEN (arm_count_29 IS NULL OR arm_count_29 <> 3 OR label_29 NOT IN ('T', 'Y')) AND (unsure OR center_source = 'component_fallback' OR local_err_t IS NULL OR local_err_y IS NULL OR coalesce(local_err_y + 2 < local_err_t, false))
      AND NOT coalesce(center_source = 'sparse_recovery_corner' AND score >= 0.9 AND NOT unsure, false) THEN {'t': 'Y', 'w': 'weak_t'}
    ELSE {'t': label, 'w': 'keep'} END
  WHEN wing AND label = 'Y' AND ultra AND post = 'x_consistency' AND arm_count >= 4 THEN {'t': 'T', 'w': 'very_sparse_x_y'}
  WHEN wing AND label = 'Y' AND ultra AND center_source = 'sparse_recovery_corner' AND arm_count = 3 AND score <= 0.08 AND local_err_t <= 100 AND local_err_y <= 40 AND NOT unsure THEN {'t': 'T', 'w': 'very_sparse_corner_y'}
  ELSE {'t': label, 'w': 'keep'} END AS d FROM kept)
SELECT id, scene_id, CASE WHEN d.t IN ('T', 'Y', 'X') THEN d.t ELSE label END AS label, d.w AS bias_reason, CASE WHEN d.t IN ('T', 'Y', 'X') AND d.t <> label THEN 'sparse_bias' ELSE post END AS post FROM v"""


@query("sparse_bias_relabel", BIAS_SQL)
def sparse_bias_relabel(spark, sf):
    """Drops and new labels in scenes of three densities and of none."""
    rows = derived(spark, sf, "fx_rows").selectExpr("scene_id", "id", *[f"{v} AS {k}" for k, v in BIAS_COLUMNS.items()])
    return D.sparse_bias_relabel(rows).select("id", "scene_id", "label", "bias_reason", "post")


# Guesses that the rule asks for: Y rows with three votes for a T, in tiles that count as very sparse.
SNAPPED = f"""{LINES}, d AS (SELECT tile_id, id, x, y, CASE WHEN label = 'N' THEN 'Y' ELSE label END AS label, CASE WHEN id % 5 = 4 THEN 0.02 ELSE 0.004 END AS branch_ratio FROM fx_nodes),
asked AS (SELECT * FROM d WHERE label = 'Y' AND branch_ratio < 0.008), spots AS (SELECT DISTINCT a.tile_id, a.x AS px, a.y AS py, f.x, f.y, {RULES.outer} AS outer_
  FROM asked a JOIN fx_lines f ON f.tile_id = a.tile_id AND f.x BETWEEN a.x - 8 AND a.x + 8 AND f.y BETWEEN a.y - 8 AND a.y + 8), {reading_sql('spots')},
tee AS (SELECT s.*, row_number() OVER (PARTITION BY s.tile_id, s.px, s.py ORDER BY r.score DESC, r.err_t, (s.x - s.px) * (s.x - s.px) + (s.y - s.py) * (s.y - s.py), s.y, s.x) AS k
  FROM spots s JOIN rd r USING (tile_id, y, x) WHERE r.seen = 'T' AND r.arms >= 3)
SELECT d.tile_id, d.id, CASE WHEN t.x IS NULL THEN d.label ELSE 'T' END AS label, coalesce(t.x, d.x) AS x, coalesce(t.y, d.y) AS y, CASE WHEN t.x IS NOT NULL THEN 'sparse_t_snap' END AS post
FROM d LEFT JOIN tee t ON t.tile_id = d.tile_id AND t.px = d.x AND t.py = d.y AND t.k = 1 AND d.label = 'Y' AND d.branch_ratio < 0.008"""


@query("sparse_t_snap", SNAPPED)
def sparse_t_snap(spark, sf):
    g = _guesses(spark, sf)
    dets = g.selectExpr("tile_id", "id", "x", "y", "CASE WHEN label = 'N' THEN 'Y' ELSE label END AS label", "'graph' AS source_kind",
                        "CASE WHEN id % 5 = 4 THEN 0.02D ELSE 0.004D END AS branch_ratio", "'T' AS x_major", "3 AS x_votes", "3 AS x_three", "0 AS x_four", "cast(null as string) AS post")
    return D.sparse_t_snap(dets, _lines(spark, sf)).select("tile_id", "id", "label", "x", "y", "post")


# ---------------------------------------------------------------- the whole detector

FINDS_ALL = D.Detector(mode="graph", auto_scale=True, base=D.Tier(recovery=True), low_endpoint=10)
PLANTED = f"""{LINES}, {LDEG}, {SHARES} SELECT n.tile_id, n.id, CASE WHEN n.kind = 3 THEN 0 ELSE 1 END AS n_found,
 CASE WHEN n.kind = 3 THEN NULL WHEN n.planted = 'X' AND s.branch_ratio BETWEEN 0.008 AND 0.03 THEN 'Y' ELSE n.planted END AS label, 0 AS n_stray FROM fx_nodes n JOIN shares s USING (tile_id)"""


def _planted(cfg: D.Detector):
    """For each planted node how many detections lie within 3 px, their label, and how many detections of its tile lie at no node."""
    def run(spark, sf):
        found = cut(D.detect(_lines(spark, sf), cfg).select("tile_id", F.col("id").alias("det"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("label").alias("got")))
        nodes = derived(spark, sf, "fx_nodes").select("tile_id", "id", "kind", "cx", "cy")
        near = (F.abs(F.col("dx") - F.col("cx")) <= 3) & (F.abs(F.col("dy") - F.col("cy")) <= 3)
        hits = nodes.join(found, "tile_id", "left").where(near | F.col("det").isNull()).groupBy("tile_id", "id").agg(F.count("det").cast("int").alias("n_found"), F.max("got").alias("label"))
        stray = found.join(nodes, "tile_id").groupBy("tile_id", "det").agg(F.max(near & (F.col("kind") != 3)).alias("ok")).groupBy("tile_id").agg(F.count_if(~F.col("ok")).cast("int").alias("n_stray"))
        out = nodes.select("tile_id", "id").join(hits, ["tile_id", "id"], "left").join(stray, "tile_id", "left")
        return out.select("tile_id", "id", F.coalesce("n_found", F.lit(0)).alias("n_found"), "label", F.coalesce("n_stray", F.lit(0)).alias("n_stray"))

    return run


query("detect", PLANTED)(_planted(FINDS_ALL))


# ---------------------------------------------------------------- circles at all seven radii

LRING = ring_sql(R.FEATURE_RADII, 64).replace("fx_pixels", "fx_lines")


@query("collinearity_features_lines", f"{LINES}, pts AS (SELECT tile_id, id, x, y FROM fx_nodes), {LRING} SELECT tile_id, id, " + ", ".join(
    f"round(coalesce(max(deviation) FILTER (WHERE radius = {r}), 90.0), 4) AS r{r}" for r in R.FEATURE_RADII) + ", CAST(max(n_arms) AS INT) AS n_arms FROM col GROUP BY 1, 2")
def collinearity_features_lines(spark, sf):
    out = R.collinearity_features(_lines(spark, sf), _guesses(spark, sf))
    return out.withColumns({f"r{r}": F.round(f"r{r}", 4) for r in R.FEATURE_RADII})


# ---------------------------------------------------------------- walks at their own lengths

LNB = f"""{LINES}, {LDEG}, nb AS MATERIALIZED (SELECT p.tile_id, p.y, p.x, q.y AS ny, q.x AS nx, q.deg AS ndeg FROM deg p JOIN deg q
  ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND NOT (q.x = p.x AND q.y = p.y))"""
# Walks that leave the crowd round their start by the farthest pixel, and stop at a fork more than 6 px out.
COORDS = """w(tile_id, id, b, sy, sx, cy, cx, n, path) AS (
  SELECT s.tile_id, s.id, (nb.ny - s.y + 1) * 3 + nb.nx - s.x + 1, s.y, s.x, nb.ny, nb.nx, 1, [s.y * 1000 + s.x, nb.ny * 1000 + nb.nx] FROM snap s JOIN nb USING (tile_id, y, x)
  UNION ALL
  SELECT tile_id, id, b, sy, sx, ny, nx, n + 1, list_append(path, ny * 1000 + nx) FROM (
    SELECT w.*, nb.ny, nb.nx, deg.deg AS here, row_number() OVER (PARTITION BY w.tile_id, w.id, w.b ORDER BY (nb.ny - sy) * (nb.ny - sy) + (nb.nx - sx) * (nb.nx - sx) DESC, nb.ny, nb.nx) AS rn,
      count(*) OVER (PARTITION BY w.tile_id, w.id, w.b) AS ahead FROM w JOIN nb ON nb.tile_id = w.tile_id AND nb.y = w.cy AND nb.x = w.cx AND NOT list_contains(w.path, nb.ny * 1000 + nb.nx)
      JOIN deg ON deg.tile_id = w.tile_id AND deg.y = w.cy AND deg.x = w.cx WHERE w.n < 60)
  WHERE rn = 1 AND here > 1 AND NOT ((cy - sy) * (cy - sy) + (cx - sx) * (cx - sx) > 36 AND (here >= 3 OR ahead > 1))),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY tile_id, id, b ORDER BY n DESC) = 1),
steps AS (SELECT tile_id, id, b, tr.tr, least(n, tr.tr) AS n, path, unnest(path[2:least(n, tr.tr) + 1]) AS p FROM last CROSS JOIN (VALUES (40), (60)) tr(tr)),
mom AS (SELECT tile_id, id, b, tr, any_value(n) AS n, any_value(path[n + 1]) AS e, any_value(path[2]) AS s, var_pop(p % 1000) * count(*) AS sxx, var_pop(p // 1000) * count(*) AS syy,
  covar_pop(p % 1000, p // 1000) * count(*) AS sxy FROM steps GROUP BY 1, 2, 3, 4 HAVING any_value(n) >= 3),
th AS (SELECT *, 0.5 * atan2(2 * sxy, sxx - syy) AS t, sxx + syy AS tot, (sxx + syy) / 2 + sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy) AS major FROM mom),
fit AS (SELECT tile_id, id, b, tr, n, (degrees(t) + CASE WHEN cos(t) * (e % 1000 - s % 1000) + sin(t) * (e // 1000 - s // 1000) >= 0 THEN 0 ELSE 180 END + 360) % 360 AS angle,
  CASE WHEN tot > 1e-12 THEN major / tot ELSE 0 END AS r2 FROM th)"""
PAIRED = """, many AS (SELECT tile_id, id, tr FROM fit GROUP BY 1, 2, 3 HAVING count(*) >= 3),
pc AS (SELECT a.tile_id, a.id, a.tr, greatest(0, 1 - abs(least(abs(a.angle - b.angle) % 360, 360 - abs(a.angle - b.angle) % 360) - 180) / 90) * least(a.r2, b.r2) * least(1, least(a.n, b.n) / 20) AS s
  FROM fit a JOIN fit b ON a.tile_id = b.tile_id AND a.id = b.id AND a.tr = b.tr AND a.b < b.b SEMI JOIN many m ON m.tile_id = a.tile_id AND m.id = a.id AND m.tr = a.tr),
scr AS (SELECT tile_id, id, tr, list_sort(list(round(s, 9)), 'DESC') AS l FROM pc GROUP BY 1, 2, 3)"""
YS = f"dets AS (SELECT * FROM fx_nodes), ys AS (SELECT * FROM dets WHERE label = 'Y'), {snap_sql('ys', 5)}"


def _snapped(spark, sf, px, labels):
    g = _guesses(spark, sf).where(F.col("label").isin(*labels))
    return R.snap_to_pixel(g, px, 5).select("tile_id", "id", F.col("sx").alias("x"), F.col("sy").alias("y"))


@query("fitted_branches_lines", f"{LNB}, {YS}, {COORDS} SELECT tile_id, id, CAST(tr AS INT) AS trace, count(*) AS n, sum(n) AS total, round(sum(r2), 5) AS r2, round(sum(cos(radians(angle))), 4) + 0 AS cx, round(sum(sin(radians(angle))), 4) + 0 AS cy FROM fit GROUP BY 1, 2, 3")
def fitted_branches_lines(spark, sf):
    """Branches fitted over 40 and over 60 px, from one walk."""
    px = _lines(spark, sf)
    f = T.fitted_branches_at(px, _snapped(spark, sf, px, ["Y"]))
    rad = F.radians("angle")
    return f.groupBy("tile_id", "id", "trace").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.round(F.sum("r2"), 5).alias("r2"), (F.round(F.sum(F.cos(rad)), 4) + 0.0).alias("cx"), (F.round(F.sum(F.sin(rad)), 4) + 0.0).alias("cy"))


@query("continuity_override_lines", f"{LNB}, {YS}, {COORDS}{PAIRED} SELECT d.tile_id, d.id, CASE WHEN s.l[1] >= 0.55 AND (s.l[2] < 1e-9 OR s.l[1] >= s.l[2] * 1.3) THEN 'T' ELSE d.label END AS label FROM dets d LEFT JOIN scr s ON s.tile_id = d.tile_id AND s.id = d.id AND s.tr = 60 AND d.label = 'Y'")
def continuity_override_lines(spark, sf):
    return T.continuity_override(_guesses(spark, sf), _lines(spark, sf)).select("tile_id", "id", "label")


def _truth(spark, sf):
    n = derived(spark, sf, "fx_nodes")
    return n.select("tile_id", "id", F.when(F.col("kind") != 3, F.col("planted")).alias("true_label"), F.col("label").alias("pred_label"))


@query("continuity_trace_sweep", f"""{LNB}, {YS}, {COORDS}{PAIRED},
rows_ AS (SELECT CASE WHEN d.kind <> 3 THEN d.planted END AS true_label, d.label AS pred_label, a.l[1] AS b40, coalesce(a.l[2], 0) AS s40, b.l[1] AS b60, coalesce(b.l[2], 0) AS s60
  FROM dets d LEFT JOIN scr a ON a.tile_id = d.tile_id AND a.id = d.id AND a.tr = 40 LEFT JOIN scr b ON b.tile_id = d.tile_id AND b.id = d.id AND b.tr = 60), """
       + _grid_sql(", ".join(f"({t}, {q}, {n})" for t, q, n in W.CONTINUITY_GRID), "threshold, ratio, trace",
                   """CASE WHEN pred_label = 'Y' AND CASE WHEN trace = 40 THEN b40 ELSE b60 END >= threshold AND (CASE WHEN trace = 40 THEN s40 ELSE s60 END < 1e-9
  OR CASE WHEN trace = 40 THEN b40 ELSE b60 END >= CASE WHEN trace = 40 THEN s40 ELSE s60 END * ratio) THEN 'T' ELSE pred_label END""", "rows_"))
def continuity_trace_sweep(spark, sf):
    """All 70 cells over one walk from each Y."""
    px = _lines(spark, sf)
    score = T.continuity_at(px, _snapped(spark, sf, px, ["Y"])).groupBy("tile_id", "id").agg(
        *[F.round(F.max(F.when(F.col("trace") == n, F.col(c))), 9).alias(f"{c}_{n}") for n in (40, 60) for c in ("best", "second")])
    out = W.continuity_trace_sweep(cut(_truth(spark, sf).join(score, ["tile_id", "id"], "left")))
    return _round_f1(out.withColumn("trace", F.col("trace").cast("double")))


TYS = f"dets AS (SELECT * FROM fx_nodes), ty AS (SELECT * FROM dets WHERE label IN ('T', 'Y'))"


def _net_sql(px: str, p: str) -> str:
    """``{p}br``: lengths of ending branches and the number of others for each T and Y guess, on the net ``px``."""
    return f"""{p}dg AS MATERIALIZED (SELECT p.tile_id, p.y, p.x, count(q.x) AS deg FROM {px} p LEFT JOIN {px} q ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1
  AND q.x BETWEEN p.x - 1 AND p.x + 1 AND NOT (q.x = p.x AND q.y = p.y) GROUP BY 1, 2, 3),
{p}nb AS MATERIALIZED (SELECT p.tile_id, p.y, p.x, q.y AS ny, q.x AS nx, q.deg AS ndeg FROM {p}dg p JOIN {p}dg q ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1
  AND q.x BETWEEN p.x - 1 AND p.x + 1 AND NOT (q.x = p.x AND q.y = p.y)),
{snap_sql('ty', 5).replace('snap AS', p + 'snap AS').replace('fx_lines', px)},
{p}w(tile_id, id, b, py, px, cy, cx, d, n, path) AS (
  SELECT s.tile_id, s.id, (nb.ny - s.y + 1) * 3 + nb.nx - s.x + 1, s.y, s.x, nb.ny, nb.nx, nb.ndeg, 1, [s.y * 1000 + s.x, nb.ny * 1000 + nb.nx] FROM {p}snap s JOIN {p}nb nb USING (tile_id, y, x)
  UNION ALL
  SELECT w.tile_id, w.id, w.b, w.cy, w.cx, nb.ny, nb.nx, nb.ndeg, w.n + 1, list_append(w.path, nb.ny * 1000 + nb.nx) FROM {p}w w JOIN {p}nb nb ON nb.tile_id = w.tile_id AND nb.y = w.cy AND nb.x = w.cx
    AND NOT (nb.ny = w.py AND nb.nx = w.px) WHERE w.d = 2 AND w.n < 200 AND NOT list_contains(w.path, nb.ny * 1000 + nb.nx)),
{p}end AS (SELECT *, CASE WHEN n >= 200 THEN 'long' WHEN d >= 3 THEN 'junction' WHEN d <= 1 THEN 'endpoint' ELSE 'loop' END AS why FROM {p}w
  QUALIFY row_number() OVER (PARTITION BY tile_id, id, b ORDER BY n DESC) = 1),
{p}br AS (SELECT tile_id, id, list(n) FILTER (WHERE why = 'endpoint') AS ends, count(*) FILTER (WHERE why IN ('junction', 'long')) AS through, count(*) AS nb FROM {p}end GROUP BY 1, 2)"""


BRIDGED = """prs AS (SELECT * FROM (SELECT e.tile_id, e.y AS y0, e.x AS x0, t.y AS y1, t.x AS x1, greatest(abs(t.x - e.x), abs(t.y - e.y)) AS n, (t.x - e.x) * (t.x - e.x) + (t.y - e.y) * (t.y - e.y) AS d2
  FROM deg e JOIN fx_lines t ON e.deg = 1 AND t.tile_id = e.tile_id AND t.x BETWEEN e.x - 3 AND e.x + 3 AND t.y BETWEEN e.y - 3 AND e.y + 3)
  WHERE n > 1 AND d2 <= 9 QUALIFY row_number() OVER (PARTITION BY tile_id, y0, x0 ORDER BY d2, y1, x1) = 1),
net AS MATERIALIZED (SELECT tile_id, y, x FROM fx_lines UNION SELECT tile_id, CAST(y0 + sign(y1 - y0) * floor((2 * abs(y1 - y0) * i + n) / (2 * n)) AS INT),
  CAST(x0 + sign(x1 - x0) * floor((2 * abs(x1 - x0) * i + n) / (2 * n)) AS INT) FROM prs, LATERAL (SELECT unnest(range(0, n + 1)) AS i))"""


def _rule(n: str, ends: str, through: str, many: str, label: str) -> str:
    dead = f"len(list_filter(coalesce({ends}, []), lambda v: v >= {n}))"
    return f"CASE WHEN {many} >= 2 AND {label} = 'Y' AND {dead} = 1 AND {through} >= 2 THEN 'T' WHEN {many} >= 2 AND {label} = 'T' AND {dead} = 0 AND {through} >= 3 THEN 'Y' ELSE {label} END"


@query("context_correction_lines", f"{LINES}, {LDEG}, {TYS}, {BRIDGED}, {_net_sql('net', 'n')} SELECT d.tile_id, d.id, {_rule('15', 'b.ends', 'b.through', 'b.nb', 'd.label')} AS label FROM dets d LEFT JOIN nbr b USING (tile_id, id)")
def context_correction_lines(spark, sf):
    return T.context_correction(_guesses(spark, sf), _lines(spark, sf)).select("tile_id", "id", "label")


@query("context_bridge_sweep", f"""{LINES}, {LDEG}, {TYS}, {BRIDGED}, {_net_sql('net', 'n')}, {_net_sql('fx_lines', 'o')},
rows_ AS (SELECT CASE WHEN d.kind <> 3 THEN d.planted END AS true_label, d.label AS pred_label, n.ends AS e1, n.through AS t1, n.nb AS n1, o.ends AS e0, o.through AS t0, o.nb AS n0
  FROM dets d LEFT JOIN nbr n USING (tile_id, id) LEFT JOIN obr o USING (tile_id, id)), """
       + _grid_sql(", ".join(f"({n}, {int(b)})" for n, b in W.CONTEXT_GRID), "min_dead_end, bridge",
                   f"CASE WHEN bridge = 1 THEN {_rule('min_dead_end', 'e1', 't1', 'n1', 'pred_label')} ELSE {_rule('min_dead_end', 'e0', 't0', 'n0', 'pred_label')} END", "rows_"))
def context_bridge_sweep(spark, sf):
    """All 12 cells over one walk on the net as it is and one on the net with its gaps bridged."""
    px = _lines(spark, sf)
    rows = _truth(spark, sf)
    for name, net in (("on", in_order(T.bridge_gaps(px, 3))), ("off", px)):
        ends = T.branch_ends(net, _snapped(spark, sf, net, ["T", "Y"]))
        rows = rows.join(shuffled(ends.withColumnsRenamed({c: f"{c}_{name}" for c in ("ends", "through", "n_branches")})), ["tile_id", "id"], "left")
    out = W.context_bridge_sweep(cut(rows))
    return _round_f1(out.withColumns({"min_dead_end": F.col("min_dead_end").cast("double"), "bridge": F.col("bridge").cast("int").cast("double")}))


# ---------------------------------------------------------------- a rule tree on the features of the circles

FRULES = A.Rules(inner=10, min_span=1.0, t_min_largest=140.0, t_max_side=148.0, margin=20.0)
#: A small tree over the columns of ``radius_features``; real ones come as model files of the same layout.
FEATURE_TREE = {"feature_names": ["arm_count_29", "err_t_29", "err_y_45"], "children_left": [1, -1, 3, -1, 5, -1, -1], "children_right": [2, -1, 4, -1, 6, -1, -1],
                "feature": [0, -2, 1, -2, 2, -2, -2], "threshold": [2.5, 0, 60.0, 0, 80.0, 0, 0], "decision": [None, "Y", None, "T", None, "Y", "T"]}


@query("feature_rule_relabel", guess_sql((29, 45), "true", FRULES) + """, f AS (SELECT tile_id, id, max(arms) FILTER (WHERE outer_ = 29) AS n29, max(err_t) FILTER (WHERE outer_ = 29) AS t29,
  max(err_y) FILTER (WHERE outer_ = 45) AS y45 FROM g GROUP BY 1, 2)
SELECT d.tile_id, d.id, CASE WHEN d.label NOT IN ('T', 'Y') OR n29 IS NULL THEN d.label WHEN n29 <= 2.5 THEN 'Y' WHEN t29 IS NULL THEN d.label WHEN t29 <= 60 THEN 'T' WHEN y45 IS NULL THEN d.label
  WHEN y45 <= 80 THEN 'Y' ELSE 'T' END AS label FROM dets d LEFT JOIN f USING (tile_id, id)""")
def feature_rule_relabel(spark, sf):
    """Features read at three radii, then the tree: one plan."""
    from lineweave.operators import fusion

    rich = fusion.radius_features(_guesses(spark, sf), _lines(spark, sf))
    return fusion.tree_rule(rich, FEATURE_TREE).select("tile_id", "id", "label")
