"""Queries on gray tiles and probability maps: tiling, stretch, segmentation scores, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import segmentation as G
from lineweave.operators import tiling as J
from lineweave.plans.catalog import query
from lineweave.plans.columns import FLAT
from lineweave.plans.derived import derived, table, with_fx
from lineweave.plans.raster import _offsets, tiles
from lineweave.operators import pixels as P
from lineweave.session import cut

SIZE, OVERLAP = 64, 16          # 192 px images in tiles of 64 with stride 48
STRIDE = SIZE - OVERLAP
ANCHORS = "(VALUES (0), (48), (96), (128))"
TILED = f"""t AS (SELECT tile_id AS parent_id, ax.a AS x0, ay.a AS y0, CAST(y - ay.a AS INT) AS y, CAST(x - ax.a AS INT) AS x, v FROM fx_gray
  JOIN {ANCHORS} ay(a) ON y >= ay.a AND y < ay.a + 64 JOIN {ANCHORS} ax(a) ON x >= ax.a AND x < ax.a + 64)"""


def _gray(spark, sf):
    return derived(spark, sf, "fx_gray").withColumnRenamed("tile_id", "parent_id")


def _dims(px):
    return px.select("parent_id").distinct().select("parent_id", F.lit(192).alias("width"), F.lit(192).alias("height"))


@query("tile_anchors", """SELECT l_orderkey % 4000 AS len, sum(a.i) AS total, count(a.i) AS n FROM (SELECT DISTINCT l_orderkey % 4000 AS l_orderkey FROM lineitem) l
 LEFT JOIN LATERAL (SELECT DISTINCT i FROM (SELECT unnest(range(0, CAST(l_orderkey % 4000 - 767 AS BIGINT), 640)) AS i
   UNION ALL SELECT l_orderkey % 4000 - 768 WHERE l_orderkey % 4000 >= 768)) a ON TRUE GROUP BY 1""")
def tile_anchors(spark, sf):
    n = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 4000).cast("int").alias("len")).distinct()
    a = n.withColumn("a", J.tile_anchors("len", 768, 640))
    return a.select("len", F.when(F.size("a") > 0, F.aggregate("a", F.lit(0), lambda s, v: s + v)).alias("total"), F.size("a").alias("n"))


@query("tile_pixels", with_fx("fx_gray") + f", {TILED} SELECT parent_id, x0, y0, y, x, v FROM t")
def tile_pixels(spark, sf):
    px = _gray(spark, sf)
    return J.tile_pixels(px, _dims(px), SIZE, OVERLAP)


META = f"""grid AS (SELECT p.parent_id, ax.a AS x0, ay.a AS y0 FROM (SELECT DISTINCT tile_id AS parent_id FROM fx_gray) p CROSS JOIN {ANCHORS} ax(a) CROSS JOIN {ANCHORS} ay(a)),
meta AS (SELECT g.parent_id, g.x0, g.y0, count(*) FILTER (WHERE t.v > 3) / 4096 AS r FROM grid g LEFT JOIN t USING (parent_id, x0, y0) GROUP BY 1, 2, 3)"""


@query("gate_tiles", with_fx("fx_gray") + f""", {TILED}, {META}
SELECT printf('hirise_%s__y%05d_x%05d_s%d', CAST(parent_id AS STRING), y0, x0, 64) AS key, parent_id, x0, y0, x0 + 64 AS x1, y0 + 64 AS y1, 64 AS width, 64 AS height,
 round_even(r, 4) AS valid_ratio, CAST(r >= 0.1 AS INT) AS kept, round(degrees((5000 - (y0 + 32.5) * 0.25) / 3396190.0), 6) AS center_lat,
 round(180 + degrees((1000 + (x0 + 32.5) * 0.25) / (3396190.0 * cos(radians(15.0)))), 6) AS center_lon FROM meta""")
def gate_tiles(spark, sf):
    px = _gray(spark, sf)
    dims = _dims(px)
    out = J.gate_tiles(J.tile_pixels(px, dims, SIZE, OVERLAP), dims, SIZE, OVERLAP, 0.10, affine=(0.25, 0.0, 1000.0, 0.0, -0.25, 5000.0), wkt=FLAT)
    return out.withColumn("kept", F.col("kept").cast("int")).drop("center_easting", "center_northing")


@query("tile_summary", with_fx("fx_gray") + f""", {TILED}, {META}
SELECT parent_id, count(*) AS total_windows, count(*) FILTER (WHERE r >= 0.1) AS kept_tiles, count(*) FILTER (WHERE r < 0.1) AS dropped_tiles FROM meta GROUP BY 1""")
def tile_summary(spark, sf):
    px = _gray(spark, sf)
    dims = _dims(px)
    return J.tile_summary(J.gate_tiles(J.tile_pixels(px, dims, SIZE, OVERLAP), dims, SIZE, OVERLAP, 0.10))


@query("stretch", with_fx("fx_gray") + """, q AS (SELECT tile_id, quantile_cont(v, 0.01) AS p, quantile_cont(v, 0.99) AS q FROM fx_gray WHERE v > 3 GROUP BY 1)
SELECT tile_id, y, x, v, CASE WHEN v > 3 THEN CAST(round_even((greatest(p, least(q, v)) - p) / (q - p) * 255.0, 0) AS INT) ELSE 0 END AS v8 FROM fx_gray JOIN q USING (tile_id)""")
def stretch(spark, sf):
    return J.stretch(derived(spark, sf, "fx_gray"), ["tile_id"])


@query("stretch_p2_p98", with_fx("fx_gray") + """, q AS (SELECT tile_id, quantile_cont(v, 0.02) AS p, quantile_cont(v, 0.98) AS q FROM fx_gray GROUP BY 1)
SELECT tile_id, y, x, v, CAST(floor((greatest(p, least(q, v)) - p) / (q - p) * 255.0) AS INT) AS v8 FROM fx_gray JOIN q USING (tile_id)""")
def stretch_p2_p98(spark, sf):
    return J.stretch(derived(spark, sf, "fx_gray"), ["tile_id"], 0.02, 0.98, skip_no_data=False, floor=True)


# Probability against the bright pixels as truth; gray levels up to 3 are no-data.
SEG = """seg AS (SELECT p.tile_id, p.y, p.x, p.p_milli / 1000.0 AS p, CAST(g.v > 150 AS INT) AS truth, CAST(g.v > 12 AS INT) AS valid
  FROM fx_prob p JOIN fx_gray g USING (tile_id, y, x)),"""
SEGK = SEG + _offsets(P.ellipse(5)) + """,
nt AS (SELECT s.tile_id, s.y, s.x, any_value(s.p) AS p, any_value(s.truth) AS truth, any_value(s.valid) AS valid,
   coalesce(max(o.truth * o.valid), 0) AS near_truth, max(o.p) FILTER (WHERE o.valid = 1) AS near_p
  FROM seg s CROSS JOIN k LEFT JOIN seg o ON o.tile_id = s.tile_id AND o.y = s.y + k.dy AND o.x = s.x + k.dx GROUP BY 1, 2, 3)"""


def _seg(spark, sf):
    p = derived(spark, sf, "fx_prob").select("tile_id", "y", "x", (F.col("p_milli") / 1000.0).alias("p"))
    g = derived(spark, sf, "fx_gray").select("tile_id", "y", "x", (F.col("v") > 150).cast("int").alias("truth"), (F.col("v") > 12).cast("int").alias("valid"))
    return p.join(g, ["tile_id", "y", "x"])


def _cells(ts, by=""):
    vals = ", ".join(f"({t})" for t in ts)
    return f"""cells AS (SELECT {by} v.t, count(*) FILTER (WHERE p >= v.t AND near_truth = 1) AS hit_pred, count(*) FILTER (WHERE p >= v.t) AS n_pred,
  count(*) FILTER (WHERE truth = 1 AND valid = 1 AND near_p >= v.t) AS hit_truth, count(*) FILTER (WHERE truth = 1 AND valid = 1) AS n_truth,
  count(*) FILTER (WHERE p >= v.t AND truth = 1 AND valid = 1) AS inter, count(*) FILTER (WHERE p >= v.t AND valid = 0) AS oob FROM nt CROSS JOIN (VALUES {vals}) v(t) GROUP BY ALL)"""


SCORE = """s1 AS (SELECT *, hit_pred / greatest(n_pred, 1) AS precision, hit_truth / greatest(n_truth, 1) AS recall, (2.0 * inter + 1e-6) / (n_pred + n_truth + 1e-6) AS dice FROM {src}),
s2 AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-8) AS f1 FROM s1)"""


@query("tolerant_f1", with_fx("fx_prob", "fx_gray") + f", {SEGK}, {_cells([0.5], 'tile_id,')}, {SCORE.format(src='cells')}"
       + " SELECT tile_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(dice, 6) AS dice FROM s2")
def tolerant_f1(spark, sf):
    out = G.tolerant_f1(_seg(spark, sf), 0.5, 2, ["tile_id"])
    return out.select("tile_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "dice")])


@query("threshold_sweep", with_fx("fx_prob", "fx_gray") + f", {SEGK}, {_cells(G.THRESHOLDS)}, {SCORE.format(src='cells')}"
       + """ SELECT CAST(t AS DOUBLE) AS t, round(f1, 6) AS f1, round(dice, 6) AS dice, oob,
 CAST(row_number() OVER (ORDER BY round(f1, 10) DESC, dice DESC, t) = 1 AS INT) AS best FROM s2""")
def threshold_sweep(spark, sf):
    out = G.threshold_sweep(_seg(spark, sf))
    return out.select("t", F.round("f1", 6).alias("f1"), F.round("dice", 6).alias("dice"), "oob", F.col("best").cast("int").alias("best"))


@query("group_threshold_search", with_fx("fx_prob", "fx_gray") + f""", {SEGK}, gnt AS (SELECT * EXCLUDE (tile_id), CAST(tile_id % 2 AS STRING) AS grp FROM nt),
{_cells([0.3, 0.5, 0.7], 'grp,').replace('FROM nt', 'FROM gnt')},
combo AS (SELECT a.t AS ta, b.t AS tb, """ + ", ".join(f"a.{c} + b.{c} AS {c}" for c in ("hit_pred", "n_pred", "hit_truth", "n_truth", "inter", "oob"))
       + f""" FROM cells a JOIN cells b ON a.grp = '0' AND b.grp = '1'), {SCORE.format(src='combo')}
SELECT CAST(ta AS DOUBLE) AS t0, CAST(tb AS DOUBLE) AS t1, round(f1, 6) AS f1, round(dice, 6) AS dice FROM s2
WHERE oob / (SELECT count(*) FROM seg WHERE valid = 0) <= 0.75 ORDER BY round(f1, 10) DESC, dice DESC LIMIT 1""")
def group_threshold_search(spark, sf):
    seg = cut(_seg(spark, sf).withColumn("grp", (F.col("tile_id") % 2).cast("string")))
    out = G.group_threshold_search(seg, "grp", [0.3, 0.5, 0.7], seg.where("valid = 0").agg(F.count(F.lit(1)).alias("n")), guardrail=0.75)
    return out.select(F.col("choice")[0]["t"].alias("t0"), F.col("choice")[1]["t"].alias("t1"), F.round("f1", 6).alias("f1"), F.round("dice", 6).alias("dice"))


@query("soft_scores", with_fx("fx_prob", "fx_gray") + f""", {SEG} s AS (SELECT sum(p * truth * valid) AS i, sum(p * valid) AS p, sum(truth * valid) AS g,
 count(*) FILTER (WHERE valid = 1) AS n FROM seg)
SELECT round((2 * i + 1e-6) / (p + g + 1e-6), 6) AS soft_dice, round(p / n, 6) AS mean_prob, round(g / n, 6) AS fg_ratio FROM s""")
def soft_scores(spark, sf):
    seg = _seg(spark, sf)
    out = G.soft_scores(seg, seg.agg(F.count_if(F.col("valid") == 1).alias("n_valid")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("oob_stats", with_fx("fx_prob", "fx_gray") + f""", {SEG} s AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND valid = 0) AS o, count(*) FILTER (WHERE p >= 0.5) AS n,
 count(*) FILTER (WHERE valid = 0) AS a FROM seg) SELECT o AS oob_pixels, round(o / a, 6) AS oob_ratio, round(o / n, 6) AS oob_fraction FROM s""")
def oob_stats(spark, sf):
    seg = _seg(spark, sf)
    out = G.oob_stats(seg, 0.5, seg.where("valid = 0").agg(F.count(F.lit(1)).alias("n")))
    return out.select("oob_pixels", F.round("oob_ratio", 6).alias("oob_ratio"), F.round("oob_fraction", 6).alias("oob_fraction"))


@query("pixel_class_weight", with_fx("fx_prob", "fx_gray") + f""", {SEG} c AS (SELECT CAST(tile_id % 3 AS STRING) AS grp, sum(truth * valid) AS pos, sum((1 - truth) * valid) AS neg FROM seg GROUP BY 1)
SELECT grp, pos, neg, round(neg / pos, 6) AS raw_weight, round(CASE WHEN grp = '2' THEN 7.5 ELSE least(40, greatest(1, neg / pos * 0.9)) END, 6) AS weight,
 round(pos / (pos + neg), 6) AS fg_ratio FROM c""")
def pixel_class_weight(spark, sf):
    seg = _seg(spark, sf).select((F.col("tile_id") % 3).cast("string").alias("grp"), (F.col("truth") * F.col("valid")).alias("pos"),
                                 ((1 - F.col("truth")) * F.col("valid")).alias("neg"))
    out = G.pixel_class_weight(seg, ["grp"], multiplier=0.9, overrides={"2": 7.5})
    return out.withColumns({c: F.round(c, 6) for c in ("raw_weight", "weight", "fg_ratio")})


@query("topology_metrics")
def topology_metrics(spark, sf):
    seg = cut(_seg(spark, sf))
    return G.topology_metrics(cut(P.dilate(seg.where("p >= 0.5"), P.CROSS3, tiles(seg))), cut(P.dilate(seg.where("truth = 1"), P.CROSS3, tiles(seg))), tiles(seg))
