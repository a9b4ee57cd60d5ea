"""Queries on what points see around them: rings, arms, traces, bridges, and the corrections built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import pixels as P
from lineweave.operators import rings as R
from lineweave.operators import sweeps as W
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, with_fx
from lineweave.plans.raster import DEG
from lineweave.session import cut

PIX = with_fx("fx_pixels")
PTS = f"{DEG}, pts AS (SELECT tile_id, CAST(y AS BIGINT) * {P.PITCH} + x AS id, x, y FROM deg WHERE deg >= 3)"


def _points(px):
    return cut(P.branch_pixels(px).select("tile_id", P.line_key().alias("id"), "x", "y"))


def ring_sql(radii, floor: int, pts: str = "pts") -> str:
    """Lit samples by walking every sample of every circle; ``arc`` holds the runs, closed over the zero angle."""
    rows = ", ".join(f"({r}, {R.samples(r, floor)})" for r in radii)
    return f"""rad(radius, n) AS (VALUES {rows}),
smp AS (SELECT p.tile_id, p.id, radius, n, s.i, CAST(round_even(p.y + radius * sin(s.i * 2 * pi() / n), 0) AS INT) AS sy,
  CAST(round_even(p.x + radius * cos(s.i * 2 * pi() / n), 0) AS INT) AS sx FROM {pts} p CROSS JOIN rad CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS i) s),
lit AS (SELECT s.*, f.x IS NOT NULL AS on_ FROM smp s LEFT JOIN fx_pixels f ON f.tile_id = s.tile_id AND f.y = s.sy AND f.x = s.sx),
edge AS (SELECT *, coalesce(lag(on_) OVER w, last_value(on_) OVER (PARTITION BY tile_id, id, radius ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev,
  coalesce(lead(on_) OVER w, first_value(on_) OVER (PARTITION BY tile_id, id, radius ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt
  FROM lit WINDOW w AS (PARTITION BY tile_id, id, radius ORDER BY i)),
st AS (SELECT tile_id, id, radius, n, i, row_number() OVER (PARTITION BY tile_id, id, radius ORDER BY i) AS k FROM edge WHERE on_ AND NOT prev),
en AS (SELECT tile_id, id, radius, i, row_number() OVER (PARTITION BY tile_id, id, radius ORDER BY i) AS k, count(*) OVER (PARTITION BY tile_id, id, radius) AS m FROM edge WHERE on_ AND NOT nxt),
turn AS (SELECT st.tile_id, st.id, st.radius, max(st.i) > max(en.i) AS wraps FROM st JOIN en USING (tile_id, id, radius) GROUP BY 1, 2, 3),
arc AS (SELECT st.tile_id, st.id, st.radius, st.n, st.i AS a, CASE WHEN en.i < st.i THEN en.i + st.n ELSE en.i END AS b
  FROM st JOIN turn USING (tile_id, id, radius) JOIN en ON en.tile_id = st.tile_id AND en.id = st.id AND en.radius = st.radius
   AND en.k = CASE WHEN turn.wraps THEN CASE WHEN st.k = en.m THEN 1 ELSE st.k + 1 END ELSE st.k END),
arm AS (SELECT *, (a + b) / 2.0 / n * 360.0 AS ang FROM arc),
pair AS (SELECT a.tile_id, a.id, a.radius, min(abs(least(abs(a.ang - b.ang) % 360.0, 360.0 - abs(a.ang - b.ang) % 360.0) - 180.0)) AS dev
  FROM arm a JOIN arm b ON a.tile_id = b.tile_id AND a.id = b.id AND a.radius = b.radius AND a.a < b.a GROUP BY 1, 2, 3),
col AS (SELECT p.tile_id, p.id, rad.radius, count(arm.a) AS n_arms, round(sum(arm.ang), 4) AS total,
  CASE WHEN count(arm.a) >= 3 THEN max(pair.dev) ELSE 90.0 END AS deviation FROM {pts} p CROSS JOIN rad
  LEFT JOIN arm ON arm.tile_id = p.tile_id AND arm.id = p.id AND arm.radius = rad.radius
  LEFT JOIN pair ON pair.tile_id = p.tile_id AND pair.id = p.id AND pair.radius = rad.radius GROUP BY 1, 2, 3)"""


@query("crossing_number", PIX + f", {PTS}, {ring_sql((8, 12), 32)}, c AS (SELECT tile_id, id, radius, count(*) AS n FROM st GROUP BY 1, 2, 3)"
       + " SELECT p.tile_id, p.id, rad.radius, CAST(coalesce(c.n, 0) AS INT) AS crossings FROM pts p CROSS JOIN rad LEFT JOIN c ON c.tile_id = p.tile_id AND c.id = p.id AND c.radius = rad.radius")
def crossing_number(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return R.crossing_number(px, _points(px))


@query("ring_angles", PIX + f", {PTS}, {ring_sql((5, 9, 16), 64)} SELECT tile_id, id, radius, CAST(n_arms AS INT) AS n_arms, total FROM col")
def ring_angles(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    out = R.ring_angles(px, _points(px), (5, 9, 16))
    total = F.aggregate("arms", F.lit(0.0), lambda a, v: a + v)
    return out.select("tile_id", "id", "radius", F.size("arms").alias("n_arms"), F.when(F.size("arms") > 0, F.round(total, 4)).alias("total"))


@query("collinearity_table", PIX + f", {PTS}, {ring_sql((5, 9), 64)} SELECT tile_id, id, radius, CAST(n_arms AS INT) AS n_arms, round(deviation, 4) AS deviation FROM col")
def collinearity_table(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    out = R.collinearity_table(px, _points(px), (5, 9))
    return out.select("tile_id", "id", "radius", "n_arms", F.round("deviation", 4).alias("deviation"))


@query("collinearity_features", PIX + f", {PTS}, {ring_sql((12, 16, 20), 64)} SELECT tile_id, id, " + ", ".join(
    f"round(coalesce(max(deviation) FILTER (WHERE radius = {r}), 90.0), 4) AS r{r}" for r in R.FEATURE_RADII) + ", CAST(max(n_arms) AS INT) AS n_arms FROM col GROUP BY 1, 2")
def collinearity_features(spark, sf):
    """With a window of half size 24, so that the larger circles leave it."""
    px = derived(spark, sf, "fx_pixels")
    out = R.collinearity_features(px, _points(px), half_size=24)
    return out.withColumns({f"r{r}": F.round(f"r{r}", 4) for r in R.FEATURE_RADII})


# Ten scenes share a pixel tile; places are folded into its side.
def _dets(spark, sf):
    d = derived(spark, sf, "fx_detections")
    return d.select(F.floor(F.col("scene_id") / 10).cast("int").alias("tile_id"), "id", (F.col("x") % 192).alias("x"), (F.col("y") % 192).alias("y"),
                    F.col("cnn_pred").alias("label"), F.col("score").alias("p_t"))


DETS = "dets AS (SELECT CAST(floor(scene_id / 10) AS INT) AS tile_id, id, x % 192 AS x, y % 192 AS y, cnn_pred AS label, score AS p_t FROM fx_detections)"
SNAP = """snap AS (SELECT d.tile_id, d.id, arg_min(f.x, ((f.x - d.x) * (f.x - d.x) + (f.y - d.y) * (f.y - d.y)) * 1000000 + f.y * 1000 + f.x) AS x,
  arg_min(f.y, ((f.x - d.x) * (f.x - d.x) + (f.y - d.y) * (f.y - d.y)) * 1000000 + f.y * 1000 + f.x) AS y
  FROM {src} d JOIN fx_pixels f ON f.tile_id = d.tile_id AND f.x BETWEEN d.x - {r} AND d.x + {r} AND f.y BETWEEN d.y - {r} AND d.y + {r} GROUP BY 1, 2)"""
PD = with_fx("fx_pixels", "fx_detections")


@query("snap_to_pixel", PD + f", {DETS}, {SNAP.format(src='dets', r=3)} SELECT tile_id, id, x AS sx, y AS sy FROM snap")
def snap_to_pixel(spark, sf):
    return R.snap_to_pixel(_dets(spark, sf), derived(spark, sf, "fx_pixels"), 3)


FIRST = "first AS (SELECT tile_id, id, arg_min(deviation, {rank}) AS deviation FROM col WHERE n_arms = 3 GROUP BY 1, 2)"


@query("collinearity_override", PD + f", {DETS}, ys AS (SELECT * FROM dets WHERE label = 'Y' AND p_t >= 0.3), {ring_sql((5, 6, 4), 64, 'ys')}, "
       + FIRST.format(rank="CASE radius WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 3 END")
       + " SELECT d.tile_id, d.id, CASE WHEN f.deviation <= 35.0 THEN 'T' ELSE d.label END AS label FROM dets d LEFT JOIN first f ON f.tile_id = d.tile_id AND f.id = d.id")
def collinearity_override(spark, sf):
    out = R.collinearity_override(_dets(spark, sf), derived(spark, sf, "fx_pixels"), 35.0, (5, 6, 4), min_p_t=0.3)
    return out.select("tile_id", "id", "label")


LIKE = f"""{DETS}, ty AS (SELECT * FROM dets WHERE label IN ('T', 'Y')), {SNAP.format(src='ty', r=5)}, {ring_sql((4, 5, 6), 64, 'snap')},
lk AS (SELECT tile_id, id, median(greatest(0.0, least(1.0, 1 - deviation / 60.0))) AS t FROM col WHERE n_arms = 3 GROUP BY 1, 2)"""


@query("t_likeness", PD + f", {LIKE} SELECT d.tile_id, d.id, CASE WHEN d.label IN ('T', 'Y') THEN round(coalesce(lk.t, 0.5), 6) END AS t_likeness FROM dets d LEFT JOIN lk ON lk.tile_id = d.tile_id AND lk.id = d.id")
def t_likeness(spark, sf):
    out = R.t_likeness(_dets(spark, sf), derived(spark, sf, "fx_pixels"), (4, 5, 6))
    return out.select("tile_id", "id", F.round("t_likeness", 6).alias("t_likeness"))


def _grid_sql(values: str, params: str, label: str, src: str) -> str:
    """F1 of each class for each grid cell, by running the whole label rule once per cell."""
    return f"""lab AS (SELECT {params}, true_label, CASE WHEN pred_label IS NOT NULL THEN {label} END AS nl FROM {src} CROSS JOIN (VALUES {values}) g({params})),
role AS (SELECT {params}, c.c, count(*) FILTER (WHERE true_label = c.c AND nl = c.c) AS tp, count(*) FILTER (WHERE true_label = c.c) AS ng, count(*) FILTER (WHERE nl = c.c) AS np
  FROM lab CROSS JOIN (VALUES ('T'), ('X'), ('Y')) c(c) GROUP BY ALL),
sc AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (ng + np) ELSE 0.0 END AS f1 FROM role)
SELECT {', '.join(f'CAST({p} AS DOUBLE) AS {p}' for p in params.split(', '))}, round(avg(f1) FILTER (WHERE ng > 0), 6) AS macro_f1, round(max(f1) FILTER (WHERE c = 'T'), 6) AS t_f1,
 round(max(f1) FILTER (WHERE c = 'X'), 6) AS x_f1, round(max(f1) FILTER (WHERE c = 'Y'), 6) AS y_f1 FROM sc GROUP BY {params}"""


def _round_f1(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("f1")})


# Sweep rows: the fourth head is the truth; geometry comes from the detection columns.
SWEEP_ROWS = """rows_ AS (SELECT CASE WHEN id % 9 = 0 THEN NULL ELSE xgb_pred END AS true_label, CASE WHEN id % 10 = 0 THEN NULL ELSE cnn_pred END AS pred_label,
  min_gap_deg / 3 AS deviation, score AS p_t, max_gap_deg / 240 AS t_likeness, score AS best, min_gap_deg / 300 AS second, branch_count AS through,
  [id % 60, scene_id % 40] AS ends FROM fx_detections)"""


def _sweep_rows(spark, sf):
    return derived(spark, sf, "fx_detections").select(
        F.when(F.col("id") % 9 != 0, F.col("xgb_pred")).alias("true_label"), F.when(F.col("id") % 10 != 0, F.col("cnn_pred")).alias("pred_label"),
        (F.col("min_gap_deg") / 3).alias("deviation"), F.col("score").alias("p_t"), (F.col("max_gap_deg") / 240).alias("t_likeness"), F.col("score").alias("best"),
        (F.col("min_gap_deg") / 300).alias("second"), F.col("branch_count").alias("through"), F.array(F.col("id") % 60, (F.col("scene_id") % 40).cast("long")).alias("ends"))


FD = with_fx("fx_detections")


@query("override_sweep", FD + f", {SWEEP_ROWS}, " + _grid_sql(", ".join(f"({d}, {p})" for d, p in W.OVERRIDE_GRID), "max_deviation, min_p_t",
       "CASE WHEN pred_label = 'Y' AND deviation <= max_deviation AND p_t >= min_p_t THEN 'T' ELSE pred_label END", "rows_"))
def override_sweep(spark, sf):
    return _round_f1(W.override_sweep(_sweep_rows(spark, sf)))


@query("likeness_sweep", FD + f", {SWEEP_ROWS}, " + _grid_sql(", ".join(f"({t})" for t in W.LIKENESS_GRID), "threshold",
       "CASE WHEN pred_label IN ('T', 'Y') THEN CASE WHEN t_likeness >= threshold THEN 'T' ELSE 'Y' END ELSE pred_label END", "rows_"))
def likeness_sweep(spark, sf):
    return _round_f1(W.likeness_sweep(_sweep_rows(spark, sf)))


CONT_GRID = [(t, q) for t in (0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8) for q in (1.0, 1.2, 1.3, 1.5, 2.0)]


@query("continuity_sweep", FD + f", {SWEEP_ROWS}, " + _grid_sql(", ".join(f"({t}, {q})" for t, q in CONT_GRID), "threshold, ratio",
       "CASE WHEN pred_label = 'Y' AND best >= threshold AND (second < 1e-9 OR best >= second * ratio) THEN 'T' ELSE pred_label END", "rows_"))
def continuity_sweep(spark, sf):
    return _round_f1(W.continuity_sweep(_sweep_rows(spark, sf), CONT_GRID))


@query("context_sweep", FD + f", {SWEEP_ROWS}, " + _grid_sql(", ".join(f"({n})" for n in (5, 10, 15, 20, 30, 50)), "min_dead_end",
       """CASE WHEN pred_label = 'Y' AND len(list_filter(ends, lambda v: v >= min_dead_end)) = 1 AND through >= 2 THEN 'T'
            WHEN pred_label = 'T' AND len(list_filter(ends, lambda v: v >= min_dead_end)) = 0 AND through >= 3 THEN 'Y' ELSE pred_label END""", "rows_"))
def context_sweep(spark, sf):
    return _round_f1(W.context_sweep(_sweep_rows(spark, sf), (5, 10, 15, 20, 30, 50))).withColumn("min_dead_end", F.col("min_dead_end").cast("double"))


@query("best_of_sweep", FD + f", {SWEEP_ROWS}, " + _grid_sql(", ".join(f"({t})" for t in W.LIKENESS_GRID), "threshold",
       "CASE WHEN pred_label IN ('T', 'Y') THEN CASE WHEN t_likeness >= threshold THEN 'T' ELSE 'Y' END ELSE pred_label END", "rows_")
       + " ORDER BY avg(f1) FILTER (WHERE ng > 0) DESC, threshold LIMIT 1")
def best_of_sweep(spark, sf):
    return _round_f1(W.best_of(W.likeness_sweep(_sweep_rows(spark, sf))))
