"""Queries on walks along lines: local geometry, thinning, bridging, continuity, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import paths as T
from lineweave.operators import pixels as P
from lineweave.operators.spatial import radius_join
from lineweave.plans.catalog import query
from lineweave.plans.derived import derived, in_order, with_fx
from lineweave.plans.network import PTS, SWEEP_ROWS, _dets, _points  # noqa: F401
from lineweave.plans.raster import DEG, tiles
from lineweave.session import cut

RPX = with_fx("fx_pixels", recursive=True)
NB = f"""{PTS}, nb AS (SELECT p.tile_id, p.y, p.x, q.y AS ny, q.x AS nx, q.y - p.y AS dy, q.x - p.x AS dx, q.deg AS ndeg
  FROM fx_pixels p JOIN deg q ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND NOT (q.x = p.x AND q.y = p.y))"""
# Straightest-next walks, one row for each step; the last row of a walker is its end.
STRAIGHT = NB + """, w(tile_id, id, sy, sx, b, py, px, cy, cx, n, path, fin) AS (
  SELECT s.tile_id, s.id, s.y, s.x, (nb.dy + 1) * 3 + nb.dx + 1, s.y, s.x, nb.ny, nb.nx, 1, [s.y * 1000 + s.x, nb.ny * 1000 + nb.nx], false
  FROM pts s JOIN nb USING (tile_id, y, x)
  UNION ALL
  SELECT tile_id, id, sy, sx, b, cy, cx, ny, nx, n + 1, list_append(path, ny * 1000 + nx), ndeg >= 3 FROM (
    SELECT w.*, nb.ny, nb.nx, nb.ndeg, row_number() OVER (PARTITION BY w.tile_id, w.id, w.b ORDER BY
      round(((w.cy - w.py) * nb.dy + (w.cx - w.px) * nb.dx) / (sqrt((w.cy - w.py) * (w.cy - w.py) + (w.cx - w.px) * (w.cx - w.px)) * sqrt(nb.dy * nb.dy + nb.dx * nb.dx)), 9) DESC,
      nb.dy, nb.dx) AS rn
    FROM w JOIN nb ON nb.tile_id = w.tile_id AND nb.y = w.cy AND nb.x = w.cx AND NOT (nb.ny = w.py AND nb.nx = w.px) WHERE w.n < 6 AND NOT w.fin)
  WHERE rn = 1 AND NOT list_contains(path, ny * 1000 + nx)),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY tile_id, id, b ORDER BY n DESC) = 1)"""


@query("branch_vectors", RPX + f", {STRAIGHT}"
       + """ SELECT tile_id, id, CAST(count(*) AS INT) AS n, round(sum(sqrt((cy - sy) * (cy - sy) + (cx - sx) * (cx - sx))), 4) AS total_length,
 round(sum(cx - sx), 3) AS vx, round(sum(cy - sy), 3) AS vy FROM last GROUP BY 1, 2""")
def branch_vectors(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    v = T.branch_vectors(px, _points(px))
    rad = F.aggregate("branches", F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, b: F.struct(
        (s["l"] + b["length"]).alias("l"), (s["x"] + b["length"] * F.cos(F.radians(b["angle"]))).alias("x"), (s["y"] + b["length"] * F.sin(F.radians(b["angle"]))).alias("y")))
    out = v.select("tile_id", "id", F.size("branches").alias("n"), rad.alias("r"))
    return out.select("tile_id", "id", "n", F.round("r.l", 4).alias("total_length"), (F.round("r.x", 3) + 0.0).alias("vx"), (F.round("r.y", 3) + 0.0).alias("vy"))


TERM = NB.replace("q.deg AS ndeg", "q.deg AS ndeg") + """, w(tile_id, id, b, py, px, cy, cx, d, n, path) AS (
  SELECT s.tile_id, s.id, (nb.dy + 1) * 3 + nb.dx + 1, s.y, s.x, nb.ny, nb.nx, nb.ndeg, 1, [s.y * 1000 + s.x, nb.ny * 1000 + nb.nx] FROM pts s JOIN nb USING (tile_id, y, x)
  UNION ALL
  SELECT w.tile_id, w.id, w.b, w.cy, w.cx, nb.ny, nb.nx, nb.ndeg, w.n + 1, list_append(w.path, nb.ny * 1000 + nb.nx)
  FROM w JOIN nb ON nb.tile_id = w.tile_id AND nb.y = w.cy AND nb.x = w.cx AND NOT (nb.ny = w.py AND nb.nx = w.px)
  WHERE w.d = 2 AND w.n < 30 AND NOT list_contains(w.path, nb.ny * 1000 + nb.nx)),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY tile_id, id, b ORDER BY n DESC) = 1)"""


@query("branch_termini", RPX + f", {TERM}" + """ SELECT tile_id, id, CASE WHEN n >= 30 THEN 'long' WHEN d >= 3 THEN 'junction' WHEN d <= 1 THEN 'endpoint' ELSE 'loop' END AS terminus,
 count(*) AS n, sum(n) AS total FROM last GROUP BY 1, 2, 3""")
def branch_termini(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    t = T.branch_termini(px, _points(px), 30)
    return t.groupBy("tile_id", "id", "terminus").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))


@query("local_junction")
def local_junction(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    out = T.local_junction(px, _points(px))
    return out.select("tile_id", "id", "branch_count", "premerge_branch_count", F.round("min_gap_deg", 4).alias("min_gap_deg"),
                      F.round("max_gap_deg", 4).alias("max_gap_deg"), "geometry_label")


@query("geometry_features")
def geometry_features(spark, sf):
    px = cut(derived(spark, sf, "fx_pixels"))
    return T.geometry_features(px, _points(px))


@query("thin")
def thin(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return T.thin(P.dilate(px, P.SQUARE3, tiles(px)))


@query("prune_spurs")
def prune_spurs(spark, sf):
    return T.prune_spurs(derived(spark, sf, "fx_pixels"))


# Pairs: every line end and every other pixel 2 to 4 px away.
PAIRS = f"""{DEG}, prs AS (SELECT e.tile_id, CAST(e.y AS BIGINT) * 1000000000 + e.x * 1000000 + t.y * 1000 + t.x AS id, e.x AS x0, e.y AS y0, t.x AS x1, t.y AS y1,
  greatest(abs(t.x - e.x), abs(t.y - e.y)) AS n, CAST((t.x - e.x) * (t.x - e.x) + (t.y - e.y) * (t.y - e.y) AS DOUBLE) AS d2
  FROM deg e JOIN fx_pixels t ON e.deg = 1 AND t.tile_id = e.tile_id AND t.x BETWEEN e.x - 4 AND e.x + 4 AND t.y BETWEEN e.y - 4 AND e.y + 4
  WHERE greatest(abs(t.x - e.x), abs(t.y - e.y)) > 1 AND (t.x - e.x) * (t.x - e.x) + (t.y - e.y) * (t.y - e.y) <= 16)"""
LINE = """ln AS (SELECT id, tile_id, CAST(y0 + sign(y1 - y0) * floor((2 * abs(y1 - y0) * i + n) / (2 * n)) AS INT) AS y, CAST(x0 + sign(x1 - x0) * floor((2 * abs(x1 - x0) * i + n) / (2 * n)) AS INT) AS x
  FROM prs, LATERAL (SELECT unnest(range(0, n + 1)) AS i))"""


def _pairs(px):
    near = radius_join(px, P.endpoints(px), 4.0, ["tile_id"]).where("greatest(abs(x_a - x_b), abs(y_a - y_b)) > 1")
    out = near.select("tile_id", (F.col("y_b").cast("long") * 1000000000 + F.col("x_b") * 1000000 + F.col("y_a") * 1000 + F.col("x_a")).alias("id"),
                      F.col("x_b").alias("x0"), F.col("y_b").alias("y0"), F.col("x_a").alias("x1"), F.col("y_a").alias("y1"))
    return cut(out)


@query("line_fill_fraction", with_fx("fx_pixels") + f""", {PAIRS}, s AS (SELECT id, tile_id, CAST(round_even(y0 + (y1 - y0) * i / n, 0) AS INT) AS y,
  CAST(round_even(x0 + (x1 - x0) * i / n, 0) AS INT) AS x FROM prs, LATERAL (SELECT unnest(range(0, n + 1)) AS i))
SELECT s.tile_id, s.id, round(avg(CASE WHEN f.x IS NULL THEN 0 ELSE 1 END), 6) AS fill FROM s LEFT JOIN fx_pixels f USING (tile_id, y, x) GROUP BY 1, 2""")
def line_fill_fraction(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return T.line_fill_fraction(px, _pairs(px)).select("tile_id", "id", F.round("fill", 6).alias("fill"))


@query("corridor_contacts", with_fx("fx_pixels") + f""", {PAIRS}, {LINE},
hit AS (SELECT DISTINCT p.tile_id, p.id, f.y, f.x FROM prs p JOIN ln USING (tile_id, id) JOIN fx_pixels f ON f.tile_id = p.tile_id
  AND f.y BETWEEN ln.y - 2 AND ln.y + 2 AND f.x BETWEEN ln.x - 2 AND ln.x + 2
  WHERE NOT (abs(f.x - x0) <= 2 AND abs(f.y - y0) <= 2) AND NOT (abs(f.x - x1) <= 2 AND abs(f.y - y1) <= 2)),
c AS (SELECT tile_id, id, count(*) AS n FROM hit h WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.tile_id = h.tile_id AND ln.id = h.id AND ln.y = h.y AND ln.x = h.x) GROUP BY 1, 2)
SELECT p.tile_id, p.id, coalesce(c.n, 0) AS contacts FROM prs p LEFT JOIN c USING (tile_id, id)""")
def corridor_contacts(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return T.corridor_contacts(px, _pairs(px)).select("tile_id", "id", "contacts")


@query("bridge_gaps", with_fx("fx_pixels") + f""", {PAIRS.replace("prs AS", "all_ AS")},
prs AS (SELECT * FROM all_ WHERE d2 <= 9 QUALIFY row_number() OVER (PARTITION BY tile_id, y0, x0 ORDER BY d2, y1, x1) = 1), {LINE}
SELECT tile_id, y, x FROM fx_pixels UNION SELECT tile_id, y, x FROM ln""")
def bridge_gaps(spark, sf):
    return T.bridge_gaps(derived(spark, sf, "fx_pixels"), 3)


@query("endpoint_directions", with_fx("fx_pixels") + f""", {DEG} SELECT e.tile_id, e.x, e.y, round((e.x - q.x) / sqrt((e.x - q.x) * (e.x - q.x) + (e.y - q.y) * (e.y - q.y)), 6) AS ux,
 round((e.y - q.y) / sqrt((e.x - q.x) * (e.x - q.x) + (e.y - q.y) * (e.y - q.y)), 6) AS uy FROM deg e JOIN fx_pixels q ON e.deg = 1 AND q.tile_id = e.tile_id
 AND q.x BETWEEN e.x - 1 AND e.x + 1 AND q.y BETWEEN e.y - 1 AND e.y + 1 AND NOT (q.x = e.x AND q.y = e.y)""")
def endpoint_directions(spark, sf):
    e = T.endpoint_directions(derived(spark, sf, "fx_pixels"))
    return e.select("tile_id", "x", "y", (F.round("ux", 6) + 0.0).alias("ux"), (F.round("uy", 6) + 0.0).alias("uy"))


@query("link_endpoints")
def link_endpoints(spark, sf):
    return T.link_endpoints(derived(spark, sf, "fx_pixels"))


@query("tangents")
def tangents(spark, sf):
    t = T.tangents(derived(spark, sf, "fx_pixels"))
    return t.select("tile_id", "x", "y", F.size("path_x").alias("n"), F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


def _bridges(spark, sf):
    px = in_order(derived(spark, sf, "fx_pixels"))
    return px, T.virtual_bridges(px, tiles(px))


@query("virtual_bridges")
def virtual_bridges(spark, sf):
    return _bridges(spark, sf)[1].drop("id")


@query("bridge_funnel")
def bridge_funnel(spark, sf):
    """How many candidates each stage settles, for each tile."""
    return _bridges(spark, sf)[1].groupBy("tile_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("accepted_bridges")
def accepted_bridges(spark, sf):
    return T.accepted_bridges(cut(_bridges(spark, sf)[1])).drop("id")


@query("proposal_streams")
def proposal_streams(spark, sf):
    """Base and virtual proposals of each tile, virtual ones near a base node removed."""
    from lineweave.operators.components import base_proposals, junction_nodes

    px, bridges = _bridges(spark, sf)
    base = cut(base_proposals(junction_nodes(px, tiles(px), k=4), tiles(px)))
    return T.proposals(base, T.accepted_bridges(cut(bridges)))


@query("fitted_branches")
def fitted_branches(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return T.fitted_branches(px, _points(px), 20).select("tile_id", "id", F.round("angle", 4).alias("angle"), F.round("r2", 6).alias("r2"), "length")


@query("continuity_override")
def continuity_override(spark, sf):
    px = cut(derived(spark, sf, "fx_pixels"))
    return T.continuity_override(_dets(spark, sf), px, 0.05, 1.3, 20).select("tile_id", "id", "label")


@query("context_correction")
def context_correction(spark, sf):
    px = cut(derived(spark, sf, "fx_pixels"))
    return T.context_correction(_dets(spark, sf), px, min_dead_end=2).select("tile_id", "id", "label")
