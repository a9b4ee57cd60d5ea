"""Queries on point tables: radius joins, suppression, clusters, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import spatial as S
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, with_fx

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
MATCH_RADIUS = 15.0


@query("radius_join", with_fx("fx_truth", "fx_detections") + f"""
SELECT a.scene_id, a.gt_id, b.id AS pred_id, CAST({D2} AS DOUBLE) AS d2
FROM fx_truth a JOIN fx_detections b ON a.scene_id = b.scene_id AND {D2} <= 225""")
def radius_join(spark, sf):
    t, p = derived(spark, sf, "fx_truth"), derived(spark, sf, "fx_detections")
    out = S.radius_join(t.select("scene_id", "gt_id", "x", "y"), p.select("scene_id", "id", "x", "y"),
                        MATCH_RADIUS, ["scene_id"])
    return out.select("scene_id", F.col("gt_id_a").alias("gt_id"), F.col("id_b").alias("pred_id"), "d2")


@query("radius_semi_join", with_fx("fx_truth", "fx_detections") + f"""
SELECT b.scene_id, b.id, b.x, b.y FROM fx_detections b WHERE EXISTS (
  SELECT 1 FROM fx_truth a WHERE a.scene_id = b.scene_id AND {D2} < 64)""")
def radius_semi_join(spark, sf):
    p = derived(spark, sf, "fx_detections").select("scene_id", "id", "x", "y")
    return S.radius_semi_join(p, derived(spark, sf, "fx_truth"), 8.0, ["scene_id"], inclusive=False)


@query("radius_anti_join", with_fx("fx_truth", "fx_detections") + f"""
SELECT b.scene_id, b.id, b.x, b.y FROM fx_detections b WHERE NOT EXISTS (
  SELECT 1 FROM fx_truth a WHERE a.scene_id = b.scene_id AND {D2} <= 25)""")
def radius_anti_join(spark, sf):
    p = derived(spark, sf, "fx_detections").select("scene_id", "id", "x", "y")
    return S.radius_anti_join(p, derived(spark, sf, "fx_truth"), 5.0, ["scene_id"])


def nms_sql(points: str, rank: str, within: str, by: str = "scene_id") -> str:
    """Rounds of 'keep what no undecided neighbour outranks' as a recursive query.

    ``r`` holds every point with its state: 0 undecided, 1 kept, 2 dropped."""
    return f"""pts AS (SELECT *, row_number() OVER (ORDER BY {rank}) AS rk FROM {points}),
edge AS (SELECT a.rk AS win, b.rk AS lose FROM pts a JOIN pts b
         ON a.{by} = b.{by} AND a.rk < b.rk AND {D2} {within}),
r(win, lose, step) AS (
  SELECT win, lose, 0 FROM edge
  UNION ALL
  SELECT win, lose, step + 1 FROM (
    SELECT win, lose, step,
           max(free) OVER (PARTITION BY lose) AS lose_hit,
           win IN (SELECT l2.lose FROM r l2 WHERE l2.win NOT IN (SELECT l3.lose FROM r l3)) AS win_hit
    FROM (SELECT win, lose, step, CASE WHEN win NOT IN (SELECT l1.lose FROM r l1) THEN 1 ELSE 0 END AS free FROM r))
  WHERE lose_hit = 0 AND NOT win_hit),
dropped AS (
  SELECT DISTINCT a.lose FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.lose = a.win AND b.step = a.step))"""


@query("nms", with_fx("fx_detections", recursive=True) + ", " + nms_sql("fx_detections", "-score, y, x, id", "< 400") + """
SELECT scene_id, id, x, y, score FROM pts WHERE rk NOT IN (SELECT lose FROM dropped)""")
def nms(spark, sf):
    p = derived(spark, sf, "fx_detections").select("scene_id", "id", "x", "y", "score")
    kept = S.nms(p, 20.0, ["scene_id"], [-F.col("score"), F.col("y"), F.col("x")])
    return kept


def clusters_sql(points: str, within: str, by: str = "scene_id") -> str:
    """Least reachable id of each point."""
    return f"""link AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM {points} a JOIN {points} b
                ON a.{by} = b.{by} AND a.id <> b.id AND {D2} {within}),
reach(id, root) AS (SELECT id, id FROM {points} UNION SELECT l.v, r.root FROM reach r JOIN link l ON l.u = r.id WHERE r.root < l.v),
cl AS MATERIALIZED (SELECT id, min(root) AS cluster_id FROM reach GROUP BY id)"""


@query("radius_clusters", with_fx("fx_detections", recursive=True) + ", " + clusters_sql("fx_detections", "<= 400") + """
SELECT d.scene_id, d.id, cl.cluster_id FROM fx_detections d JOIN cl USING (id)""")
def radius_clusters(spark, sf):
    p = derived(spark, sf, "fx_detections").select("scene_id", "id", "x", "y")
    return S.radius_clusters(p, 20.0, ["scene_id"]).select("scene_id", "id", "cluster_id")


@query("cluster_numbers", with_fx("fx_detections", recursive=True) + ", " + clusters_sql("fx_detections", "<= 400") + """
SELECT d.scene_id, d.id, dense_rank() OVER (PARTITION BY d.scene_id ORDER BY cl.cluster_id) - 1 AS cluster_number FROM fx_detections d JOIN cl USING (id)""")
def cluster_numbers(spark, sf):
    """Running number of each group in its scene."""
    p = derived(spark, sf, "fx_detections").select("scene_id", "id", "x", "y")
    return S.cluster_numbers(S.radius_clusters(p, 20.0, ["scene_id"]), ["scene_id"]).select("scene_id", "id", "cluster_number")


MATCH_SQL = f"""cand AS (
  SELECT a.scene_id, a.gt_id, b.id AS pred_id, {D2} AS d2
  FROM fx_truth a JOIN fx_detections b ON a.scene_id = b.scene_id AND {D2} <= 225),
m(scene_id, gt_id, pred_id, d2, hit) AS (
  SELECT scene_id, gt_id, pred_id, d2, 0 FROM cand
  UNION ALL
  SELECT scene_id, gt_id, pred_id, d2, hit2 FROM (
    SELECT *, max(hit2) OVER (PARTITION BY gt_id) AS g, max(hit2) OVER (PARTITION BY pred_id) AS p FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY gt_id ORDER BY d2, gt_id, pred_id) = 1
                      AND row_number() OVER (PARTITION BY pred_id ORDER BY d2, gt_id, pred_id) = 1
                     THEN 1 ELSE 0 END AS hit2 FROM m WHERE hit = 0))
  WHERE hit2 = 1 OR (g = 0 AND p = 0)),
matched AS (SELECT scene_id, gt_id, pred_id, sqrt(d2) AS distance FROM m WHERE hit = 1)"""


@query("greedy_match", with_fx("fx_truth", "fx_detections", recursive=True) + ", " + MATCH_SQL + """
SELECT scene_id, gt_id, pred_id, round(distance, 6) AS distance FROM matched""")
def greedy_match(spark, sf):
    t, p = derived(spark, sf, "fx_truth"), derived(spark, sf, "fx_detections")
    out = S.greedy_match(t, p, MATCH_RADIUS, ["scene_id"])
    return out.withColumn("distance", F.round("distance", 6))
