"""Queries on row-wise expressions: text cleaning, names, bounds, angles, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import scalars as X
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, with_fx

NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def num_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), {NUM}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def angle_sql(a: str, b: str) -> str:
    d = f"(abs({a} - {b}) % 360.0)"
    return f"least({d}, 360.0 - {d})"


@query("norm_label", with_fx("fx_raw") + " SELECT id, upper(trim(label)) AS label FROM fx_raw")
def norm_label(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.norm_label("label").alias("label"))


@query("safe_double", with_fx("fx_raw") + f" SELECT id, coalesce({num_sql('num_text')}, -1.0) AS v FROM fx_raw")
def safe_double(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.safe_double("num_text", -1.0).alias("v"))


@query("parse_flag", with_fx("fx_raw") + f"""
SELECT id, CASE WHEN lower(trim(flag_text)) IN ('1', 'true', 't', 'yes', 'y') THEN 1
                WHEN lower(trim(flag_text)) IN ('0', 'false', 'f', 'no', 'n', '') THEN 0
                WHEN coalesce({num_sql('flag_text')}, 0) > 0 THEN 1 ELSE 0 END AS flag FROM fx_raw""")
def parse_flag(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.parse_flag("flag_text").cast("int").alias("flag"))


@query("str_default", with_fx("fx_raw") + " SELECT id, coalesce(nullif(trim(type_text), ''), 'UNK') AS v FROM fx_raw")
def str_default(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.str_default("type_text").alias("v"))


@query("positive_weight", with_fx("fx_raw") + f"""
SELECT id, CASE WHEN {num_sql('num_text')} > 0 THEN {num_sql('num_text')} ELSE 1.0 END AS w FROM fx_raw""")
def positive_weight(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.positive_weight("num_text").alias("w"))


@query("proposal_origin", with_fx("fx_raw") + """
SELECT id,
  CASE WHEN trim(src_text) <> '' THEN trim(src_text)
       WHEN trim(type_text) LIKE 'virtual_gap%' THEN 'virtual_bridge'
       WHEN trim(type_text) <> '' THEN 'base_topology'
       WHEN contains(stem, '_gap') THEN 'virtual_bridge' ELSE 'base_topology' END AS proposal_source,
  CASE WHEN trim(src_text) <> '' OR trim(type_text) <> '' THEN trim(type_text)
       WHEN contains(stem, '_gap') THEN 'virtual_gap_legacy_filename' ELSE 'base_junction_legacy' END AS proposal_type
FROM fx_raw""")
def proposal_origin(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.proposal_origin("src_text", "type_text", "stem").alias("o")).select("id", "o.*")


@query("name_group_family", with_fx("fx_raw") + r"""
SELECT stem, CASE WHEN stem LIKE 'ESP\_%' ESCAPE '\' THEN 'ESP' WHEN stem LIKE 'tile\_y%' ESCAPE '\' THEN 'tile_grid'
                  WHEN stem LIKE 'tile\_%' ESCAPE '\' THEN 'tile_numeric' ELSE 'other' END AS grp,
       CASE WHEN stem LIKE 'hirise\_%' ESCAPE '\' OR stem LIKE 'ESP\_%' ESCAPE '\' THEN split_part(stem, '__', 1)
            WHEN stem LIKE 'tile\_y%' ESCAPE '\' THEN 'tile_grid' WHEN stem LIKE 'tile\_%' ESCAPE '\' THEN 'tile_numeric'
            ELSE 'other' END AS family, count(*) AS n
FROM fx_raw GROUP BY 1, 2, 3""")
def name_group_family(spark, sf):
    return derived(spark, sf, "fx_raw").groupBy(
        "stem", X.group_of_key("stem").alias("grp"), X.family_of_key("stem").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("input_mode", with_fx("fx_raw") + """
SELECT id, CASE WHEN contains(lower(stem), '_skel') THEN 'skeleton' ELSE 'mask' END AS mode FROM fx_raw""")
def input_mode(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", X.input_mode("stem", "*.png").alias("mode"))


@query("border_flag", with_fx("fx_raw") + """
SELECT id, CAST(x < 8 OR y < 8 OR x >= 760 OR y >= 760 AS INT) AS border FROM fx_raw""")
def border_flag(spark, sf):
    size = F.lit(768)
    return derived(spark, sf, "fx_raw").select("id", X.border_flag("x", "y", size, size).cast("int").alias("border"))


@query("clip_and_bounds", with_fx("fx_raw") + """
SELECT scene_id, sum(greatest(0, least(767, CAST(round_even(x / 2.0, 0) AS INT)))) AS sx,
       count(*) FILTER (WHERE x < 0 OR x >= 768 OR y < 0 OR y >= 768) AS n_oob, count(*) AS n
FROM fx_raw GROUP BY scene_id""")
def clip_and_bounds(spark, sf):
    size = F.lit(768)
    return derived(spark, sf, "fx_raw").groupBy("scene_id").agg(
        F.sum(X.clip_to(F.col("x") / 2.0, size)).alias("sx"),
        F.count_if(X.out_of_bounds("x", "y", size, size)).alias("n_oob"), F.count(F.lit(1)).alias("n"))


@query("tile_key", with_fx("fx_raw") + """
SELECT id, printf('hirise_%s__y%05d_x%05d_s%d', stem, scene_id * 640, n_arms * 640, 768) AS key FROM fx_raw""")
def tile_key(spark, sf):
    return derived(spark, sf, "fx_raw").select(
        "id", X.tile_key("stem", F.col("n_arms") * 640, F.col("scene_id") * 640, F.lit(768)).alias("key"))


@query("angle_diff", with_fx("fx_raw") + f"""
SELECT id, round({angle_sql('ang_a', 'ang_b')}, 4) AS d FROM fx_raw""")
def angle_diff(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", F.round(X.angle_diff("ang_a", "ang_b"), 4).alias("d"))


@query("vector_angle", with_fx("fx_raw") + """, v AS (SELECT id, sqrt(len_a * len_a + len_b * len_b) * sqrt(ang_a * ang_a + 100.0) AS n,
   len_a * 10.0 - len_b * ang_a AS d FROM fx_raw)
SELECT id, round(CASE WHEN n <= 1e-6 THEN 180.0 ELSE degrees(acos(greatest(-1.0, least(1.0, d / n)))) END, 4) AS a FROM v""")
def vector_angle(spark, sf):
    return derived(spark, sf, "fx_raw").select(
        "id", F.round(X.vector_angle("len_a", F.col("len_b"), F.lit(10.0), -F.col("ang_a")), 4).alias("a"))


# Sorted directions s0 <= s1 <= s2 and their three gaps, once in SQL for the queries below.
GAPS = """s AS (SELECT id, n_arms, len_a, len_b, ang_a, ang_b, ang_c, least(ang_a, ang_b, ang_c) AS s0, greatest(ang_a, ang_b, ang_c) AS s2,
   ang_a + ang_b + ang_c - least(ang_a, ang_b, ang_c) - greatest(ang_a, ang_b, ang_c) AS s1 FROM fx_raw),
g AS (SELECT *, s1 - s0 AS g0, s2 - s1 AS g1, s0 + 360.0 - s2 AS g2 FROM s),
q AS (SELECT *, least(g0, g1, g2) AS lo, greatest(g0, g1, g2) AS hi, 360.0 - least(g0, g1, g2) - greatest(g0, g1, g2) AS mid FROM g)"""


def _gaps(spark, sf):
    d = derived(spark, sf, "fx_raw")
    g = d.withColumn("gaps", F.array_sort(X.circular_gaps(F.array("ang_a", "ang_b", "ang_c"))))
    return g.withColumn("lo", F.get("gaps", F.lit(0))).withColumn("mid", F.get("gaps", F.lit(1))).withColumn("hi", F.get("gaps", F.lit(2)))


@query("circular_gaps", with_fx("fx_raw") + f", {GAPS} SELECT id, round(lo, 4) AS lo, round(mid, 4) AS mid, round(hi, 4) AS hi FROM q")
def circular_gaps(spark, sf):
    return _gaps(spark, sf).select("id", *[F.round(c, 4).alias(c) for c in ("lo", "mid", "hi")])


def _rmse(t):
    return f"sqrt(((lo - {t[0]}) * (lo - {t[0]}) + (mid - {t[1]}) * (mid - {t[1]}) + (hi - {t[2]}) * (hi - {t[2]})) / 3.0)"


@query("likeness", with_fx("fx_raw") + f""", {GAPS}, r AS (SELECT id, {_rmse((90, 90, 180))} AS t,
  least({_rmse((120, 120, 120))}, {_rmse((100, 130, 130))}) AS y FROM q)
SELECT id, round(t, 4) AS t_gap_rmse, round(y, 4) AS y_gap_rmse, round(exp(-t / 25), 6) AS t_likeness,
       round(exp(-y / 25), 6) AS y_likeness FROM r""")
def likeness(spark, sf):
    out = _gaps(spark, sf).select("id", X.likeness("lo", "mid", "hi").alias("l")).select("id", "l.*")
    return out.select("id", F.round("t_gap_rmse", 4).alias("t_gap_rmse"), F.round("y_gap_rmse", 4).alias("y_gap_rmse"),
                      F.round("t_likeness", 6).alias("t_likeness"), F.round("y_likeness", 6).alias("y_likeness"))


@query("geometry_label", with_fx("fx_detections") + """
SELECT id, CASE WHEN branch_count <> 3 THEN 'Unknown' WHEN max_gap_deg BETWEEN 150 AND 210 AND min_gap_deg >= 35 THEN 'T'
                WHEN max_gap_deg >= 150 AND min_gap_deg < 35 THEN 'Y_arrowhead' ELSE 'Y_balanced' END AS label FROM fx_detections""")
def geometry_label(spark, sf):
    return derived(spark, sf, "fx_detections").select("id", X.geometry_label("branch_count", "min_gap_deg", "max_gap_deg").alias("label"))


@query("collinearity", with_fx("fx_raw") + f"""
SELECT id, round(least(abs({angle_sql('ang_a', 'ang_b')} - 180), abs({angle_sql('ang_a', 'ang_c')} - 180),
                       abs({angle_sql('ang_b', 'ang_c')} - 180)), 4) AS dev FROM fx_raw""")
def collinearity(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", F.round(X.collinearity(F.array("ang_a", "ang_b", "ang_c")), 4).alias("dev"))


@query("merge_directions", with_fx("fx_raw") + f""", m AS (
  SELECT id, CASE WHEN len_a >= len_b THEN ang_a ELSE ang_b END AS p, CASE WHEN len_a >= len_b THEN ang_b ELSE ang_a END AS q,
         greatest(len_a, len_b) AS lp, ang_c AS c FROM fx_raw),
k AS (SELECT *, {angle_sql('p', 'q')} >= 20 AS keep_q FROM m),
k2 AS (SELECT *, {angle_sql('p', 'c')} >= 20 AND NOT (keep_q AND {angle_sql('q', 'c')} < 20) AS keep_c FROM k)
SELECT id, 1 + keep_q::INT + keep_c::INT AS n_kept,
       round(p + CASE WHEN keep_q THEN q ELSE 0 END + CASE WHEN keep_c THEN c ELSE 0 END, 4) AS total FROM k2""")
def merge_directions(spark, sf):
    arms = F.array(*[F.struct(F.col(a).alias("angle"), F.col(n).alias("length")) for a, n in
                     (("ang_a", "len_a"), ("ang_b", "len_b"))], F.struct(F.col("ang_c").alias("angle"), F.lit(0.5).alias("length")))
    d = derived(spark, sf, "fx_raw").select("id", X.merge_directions(arms).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, s: acc + s["angle"])
    return d.select("id", F.size("m").alias("n_kept"), F.round(total, 4).alias("total"))


ARM = {"legacy": ("e_t", "e_y", "guard"), "symmetric": ("e_t", "e_y", "guard AND e_t <= e_y + 6.0"),
       "robust": ("r_t", "r_y", "guard AND r_t <= r_y + 6.0")}
ARM_SQL = """v AS (SELECT id, [ang_a / 2.0, ang_b / 2.0, ang_c / 2.0] AS a FROM fx_raw),
w AS (SELECT id, list_sort(a)[1] AS a0, list_sort(a)[2] AS a1, list_sort(a)[3] AS a2 FROM v),
e AS (SELECT *, a2 >= 150.0 AND a1 <= 124.0 AND a0 <= 124.0 AS guard,
  abs(a2 - 180.0) + 0.7 * (abs(a0 - 90.0) + abs(a1 - 90.0)) AS e_t,
  abs(a0 - 120.0) + abs(a1 - 120.0) + abs(a2 - 120.0) AS e_y,
  abs(a2 - 180.0) + 0.75 * (abs(a0 - 90.0) + abs(a1 - 90.0)) + 1.3 * greatest(0.0, 150.0 - a2)
    + 1.1 * (greatest(0.0, a0 - 124.0) + greatest(0.0, a1 - 124.0)) + 0.2 * abs(a0 - a1) AS r_t,
  abs(a0 - 120.0) + abs(a1 - 120.0) + abs(a2 - 120.0) + 0.25 * (a2 - a0) + 0.2 * abs(0.5 * (a0 + a1) - 120.0) AS r_y FROM w)"""
for _mode, (_t, _y, _pick) in ARM.items():
    def _run(spark, sf, mode=_mode):
        half = F.array(*[F.col(c) / 2.0 for c in ("ang_a", "ang_b", "ang_c")])
        out = derived(spark, sf, "fx_raw").select("id", X.three_arm_label(half, mode).alias("t"))
        return out.select("id", "t.label", F.round("t.err", 4).alias("err"), F.col("t.ambiguous").cast("int").alias("ambiguous"))

    _amb = "0" if _mode == "legacy" else f"(abs({_t} - {_y}) <= 6.0)::INT"
    query(f"three_arm_label_{_mode}", with_fx("fx_raw") + f""", {ARM_SQL}
SELECT id, CASE WHEN {_pick} THEN 'T' ELSE 'Y' END AS label, round(CASE WHEN {_pick} THEN {_t} ELSE {_y} END, 4) AS err,
       {_amb} AS ambiguous FROM e""")(_run)


@query("safe_ratio", with_fx("fx_raw") + """
SELECT id, round(CASE WHEN n_arms <> 0 THEN len_a / n_arms ELSE 0.0 END, 6) AS ratio FROM fx_raw""")
def safe_ratio(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", F.round(X.safe_ratio("len_a", "n_arms"), 6).alias("ratio"))


@query("proposal_score", with_fx("fx_raw") + """
SELECT id, round(2.5 / (1 + len_a) + 2 * greatest(0, cos(radians(ang_a))) + 1.5 / (1 + n_arms) + 1, 6) AS score FROM fx_raw""")
def proposal_score(spark, sf):
    return derived(spark, sf, "fx_raw").select("id", F.round(X.proposal_score("len_a", "ang_a", "n_arms"), 6).alias("score"))


@query("pair_continuity", with_fx("fx_raw") + f"""
SELECT id, round(greatest(0, 1 - abs({angle_sql('ang_a', 'ang_b')} - 180) / 90) * least(ang_c / 361.7, 0.9173)
             * least(1, least(len_a, len_b) / 20), 6) AS score FROM fx_raw""")
def pair_continuity(spark, sf):
    score = X.pair_continuity("ang_a", F.col("ang_c") / 361.7, "len_a", "ang_b", F.lit(0.9173), "len_b")
    return derived(spark, sf, "fx_raw").select("id", F.round(score, 6).alias("score"))


@query("center_weight", with_fx("fx_pixels") + """
SELECT tile_id, round(sum(exp(-((x - 96) * (x - 96) + (y - 96) * (y - 96)) / (2 * 40.0 * 40.0))), 4) AS w
FROM fx_pixels GROUP BY tile_id""")
def center_weight(spark, sf):
    return derived(spark, sf, "fx_pixels").groupBy("tile_id").agg(F.round(F.sum(X.center_weight("x", "y")), 4).alias("w"))


POLAR = 'PROJCS["Polar_Stereographic Body",SPHEROID["Body_localRadius",3376200,0]]'
FLAT = 'PROJCS["Equirectangular Body",SPHEROID["Body",3396190.0,0],PARAMETER["latitude_of_origin",15.0],PARAMETER["central_meridian",180.0]]'


@query("projected_to_latlon", with_fx("fx_raw") + """, p AS (SELECT id, n_arms, x * 100.0 AS e, y * 100.0 AS n FROM fx_raw)
SELECT id, round(CASE WHEN n_arms % 2 = 0 THEN CASE WHEN e = 0 AND n = 0 THEN 90 ELSE 90 - 2 * degrees(atan(sqrt(e * e + n * n) / (2 * 3376200.0))) END
                      ELSE degrees(n / 3396190.0) END, 6) AS lat,
       round(CASE WHEN n_arms % 2 = 0 THEN CASE WHEN e = 0 AND n = 0 THEN 0 ELSE degrees(atan2(e, -n)) END
                  ELSE 180 + degrees(e / (3396190.0 * cos(radians(15.0)))) END, 6) AS lon FROM p""")
def projected_to_latlon(spark, sf):
    d = derived(spark, sf, "fx_raw").withColumn("wkt", F.when(F.col("n_arms") % 2 == 0, POLAR).otherwise(FLAT))
    p = d.select("id", X.projected_to_latlon(F.col("x") * 100.0, F.col("y") * 100.0, "wkt").alias("p"))
    return p.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("tile_center", with_fx("fx_raw") + """
SELECT id, CAST(1000.0 + (x + 384.5) * 0.25 AS DOUBLE) AS easting, CAST(5000.0 - (y + 384.5) * 0.25 AS DOUBLE) AS northing FROM fx_raw""")
def tile_center(spark, sf):
    return derived(spark, sf, "fx_raw").select(
        "id", X.tile_center("x", "y", 768, (0.25, 0.0, 1000.0, 0.0, -0.25, 5000.0)).alias("c")).select("id", "c.*")
