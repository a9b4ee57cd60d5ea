"""Queries on pixel tables: neighbourhood, morphology, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import components as C
from lineweave.operators import pixels as P
from lineweave.plans.catalog import query
from lineweave.plans.derived import TILE_SIDE, derived, with_fx
from lineweave.session import cut

DEG = """deg AS (
  SELECT p.tile_id, p.y, p.x, CAST(count(q.x) AS INT) AS deg
  FROM fx_pixels p LEFT JOIN fx_pixels q
    ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1
   AND NOT (q.x = p.x AND q.y = p.y)
  GROUP BY 1, 2, 3)"""


def tiles(px, side: int = TILE_SIDE):
    """Bounds of the derived tiles, written: one row for each tile, of a size that Spark then knows."""
    return cut(px.select("tile_id").distinct().select("tile_id", F.lit(side).alias("width"), F.lit(side).alias("height")))


@query("degree_map", with_fx("fx_pixels") + f", {DEG} SELECT tile_id, y, x, deg FROM deg")
def degree_map(spark, sf):
    return P.degree_map(derived(spark, sf, "fx_pixels"))


@query("neighbour_offsets", with_fx("fx_pixels") + """
SELECT p.tile_id, p.y, p.x, CAST(count(q.x) AS INT) AS deg,
       coalesce(string_agg((q.y - p.y) || ':' || (q.x - p.x), ' ' ORDER BY q.y, q.x), '') AS scan
FROM fx_pixels p LEFT JOIN fx_pixels q
  ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1
 AND NOT (q.x = p.x AND q.y = p.y)
GROUP BY 1, 2, 3""")
def neighbour_offsets(spark, sf):
    d = P.degree_map(derived(spark, sf, "fx_pixels"), neighbours=True)
    text = F.transform("nbrs", lambda o: F.concat_ws(":", o["dy"].cast("string"), o["dx"].cast("string")))
    return d.select("tile_id", "y", "x", "deg", F.array_join(text, " ").alias("scan"))


@query("endpoints", with_fx("fx_pixels") + f", {DEG} SELECT tile_id, y, x FROM deg WHERE deg = 1")
def endpoints(spark, sf):
    return P.endpoints(derived(spark, sf, "fx_pixels"))


@query("branch_pixels", with_fx("fx_pixels") + f", {DEG} SELECT tile_id, y, x FROM deg WHERE deg >= 3")
def branch_pixels(spark, sf):
    return P.branch_pixels(derived(spark, sf, "fx_pixels"))


@query("branch_ratio", with_fx("fx_pixels") + f""", {DEG}
SELECT tile_id, count(*) AS n_pixels, count(*) FILTER (WHERE deg = 1) AS n_endpoints,
       count(*) FILTER (WHERE deg >= 3) AS n_branch,
       count(*) FILTER (WHERE deg >= 3) / count(*) AS branch_ratio
FROM deg GROUP BY tile_id""")
def branch_ratio(spark, sf):
    return P.branch_ratio(derived(spark, sf, "fx_pixels"))


def _offsets(kernel) -> str:
    rows = ", ".join(f"({dy}, {dx})" for dy, k in sorted(kernel.items()) for dx in range(-k, k + 1))
    return f"k(dy, dx) AS (VALUES {rows})"


def _dilate_sql(src: str, kernel) -> str:
    return f"""{_offsets(kernel)}, d AS (
  SELECT DISTINCT s.tile_id, CAST(s.y + k.dy AS INT) AS y, CAST(s.x + k.dx AS INT) AS x FROM {src} s CROSS JOIN k
  WHERE s.y + k.dy BETWEEN 0 AND {TILE_SIDE - 1} AND s.x + k.dx BETWEEN 0 AND {TILE_SIDE - 1})"""


def _erode_sql(src: str, kernel, out: str, outside: bool = False) -> str:
    """Erosion as 'all kernel offsets present'; ``outside`` counts offsets off the tile as present."""
    n = sum(2 * k + 1 for k in kernel.values())
    off = f"""count(*) FILTER (WHERE s.y + k.dy NOT BETWEEN 0 AND {TILE_SIDE - 1}
                OR s.x + k.dx NOT BETWEEN 0 AND {TILE_SIDE - 1})""" if outside else "0"
    return f"""{out} AS (SELECT s.tile_id, s.y, s.x FROM {src} s CROSS JOIN k
  LEFT JOIN {src} t ON t.tile_id = s.tile_id AND t.y = s.y + k.dy AND t.x = s.x + k.dx
  GROUP BY 1, 2, 3 HAVING count(t.x) + {off} = {n})"""


for _name, _kernel in {"dilate_square": P.SQUARE3, "dilate_disk": P.disk(3), "dilate_ellipse": P.ellipse(5)}.items():
    def _run(spark, sf, kernel=_kernel):
        px = derived(spark, sf, "fx_pixels")
        return P.dilate(px, kernel, tiles(px))

    query(_name, with_fx("fx_pixels") + ", " + _dilate_sql("fx_pixels", _kernel) + " SELECT tile_id, y, x FROM d")(_run)


@query("erode_cross", with_fx("fx_pixels") + f""", wide AS (
  SELECT DISTINCT tile_id, y, x + d AS x FROM fx_pixels, (VALUES (-2), (-1), (0), (1), (2)) v(d)),
{_offsets(P.CROSS3)}, {_erode_sql("wide", P.CROSS3, "e")} SELECT tile_id, y, x FROM e""")
def erode_cross(spark, sf):
    """Erosion of the pixels widened by two columns, so that something is left."""
    wide = P.dilate(derived(spark, sf, "fx_pixels"), {0: 2})
    return P.erode(wide, P.CROSS3)


@query("open_close", with_fx("fx_pixels") + ", " + _dilate_sql("fx_pixels", P.SQUARE3) + ", "
       + _erode_sql("d", P.SQUARE3, "closed", outside=True) + ", "
       + _erode_sql("closed", P.SQUARE3, "e", outside=True) + f""", o AS (
  SELECT DISTINCT e.tile_id, e.y + k.dy AS y, e.x + k.dx AS x FROM e CROSS JOIN k
  WHERE e.y + k.dy BETWEEN 0 AND {TILE_SIDE - 1} AND e.x + k.dx BETWEEN 0 AND {TILE_SIDE - 1})
SELECT tile_id, y, x FROM o""")
def open_close(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    dims = tiles(px)
    return P.open_(P.close_(px, P.SQUARE3, dims=dims), P.SQUARE3, dims=dims)


@query("mask_sets", with_fx("fx_pixels", "fx_gray") + """, b AS (SELECT tile_id, y, x FROM fx_gray WHERE v > 127)
SELECT tile_id, sum(u) AS n_union, sum(i) AS n_both, sum(m) AS n_minus FROM (
  SELECT tile_id, 1 AS u, 0 AS i, 0 AS m FROM (SELECT tile_id, y, x FROM b UNION SELECT tile_id, x, y FROM fx_pixels)
  UNION ALL SELECT tile_id, 0, 1, 0 FROM (SELECT tile_id, y, x FROM b INTERSECT SELECT tile_id, x, y FROM fx_pixels)
  UNION ALL SELECT tile_id, 0, 0, 1 FROM (SELECT tile_id, y, x FROM b EXCEPT SELECT tile_id, x, y FROM fx_pixels))
GROUP BY tile_id""")
def mask_sets(spark, sf):
    """Union, intersection and difference of the bright pixels and the transposed mask."""
    a = derived(spark, sf, "fx_gray").where("v > 127").select("tile_id", "y", "x")
    b = derived(spark, sf, "fx_pixels").select("tile_id", F.col("x").alias("y"), F.col("y").alias("x"))

    def flag(df, u, i, m):
        return df.select("tile_id", F.lit(u).alias("u"), F.lit(i).alias("i"), F.lit(m).alias("m"))

    parts = flag(P.mask_union(a, b), 1, 0, 0).unionByName(flag(P.mask_intersect(a, b), 0, 1, 0)).unionByName(
        flag(P.mask_minus(a, b), 0, 0, 1))
    return parts.groupBy("tile_id").agg(F.sum("u").alias("n_union"), F.sum("i").alias("n_both"), F.sum("m").alias("n_minus"))


@query("corner_pixels", with_fx("fx_pixels") + """, n AS (
  SELECT p.tile_id, p.y, p.x, q.y - p.y AS dy, q.x - p.x AS dx
  FROM fx_pixels p JOIN fx_pixels q ON q.tile_id = p.tile_id AND q.y BETWEEN p.y - 1 AND p.y + 1
   AND q.x BETWEEN p.x - 1 AND p.x + 1 AND NOT (q.x = p.x AND q.y = p.y)),
two AS (SELECT tile_id, y, x, list(dy ORDER BY dy, dx) AS dys, list(dx ORDER BY dy, dx) AS dxs
        FROM n GROUP BY 1, 2, 3 HAVING count(*) = 2),
a AS (SELECT tile_id, y, x, degrees(acos(greatest(-1.0, least(1.0,
        (dys[1] * dys[2] + dxs[1] * dxs[2])
        / (sqrt(dys[1] * dys[1] + dxs[1] * dxs[1]) * sqrt(dys[2] * dys[2] + dxs[2] * dxs[2])))))) AS angle FROM two)
SELECT tile_id, y, x, round(angle, 4) AS angle_deg FROM a WHERE angle <= 150.0""")
def corner_pixels(spark, sf):
    return P.corner_pixels(derived(spark, sf, "fx_pixels")).withColumn("angle_deg", F.round("angle_deg", 4))


@query("auto_polarity", with_fx("fx_gray") + """, s AS (
  SELECT tile_id, count(*) FILTER (WHERE v < 100) <= count(*) FILTER (WHERE v > 155) AS dark FROM fx_gray GROUP BY 1)
SELECT g.tile_id, g.y, g.x, g.v FROM fx_gray g JOIN s USING (tile_id)
WHERE CASE WHEN s.dark THEN g.v < 100 ELSE g.v > 155 END""")
def auto_polarity(spark, sf):
    return P.auto_polarity(derived(spark, sf, "fx_gray"), threshold=100)


def comp_sql(src: str, out: str, diagonal: bool = True, pre: str = "") -> str:
    """Least reachable row-major position of each pixel. ``pre`` keeps the helper names apart."""
    near = ("b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1" if diagonal
            else "abs(b.y - a.y) + abs(b.x - a.x) = 1")
    return f"""{pre}k AS (SELECT *, CAST(y AS BIGINT) * {P.PITCH} + x AS pos FROM {src}),
{pre}e AS (SELECT a.tile_id, a.pos AS u, b.pos AS v FROM {pre}k a JOIN {pre}k b ON a.tile_id = b.tile_id AND a.pos <> b.pos AND {near}),
{pre}r(tile_id, pos, root) AS (SELECT tile_id, pos, pos FROM {pre}k
  UNION SELECT e.tile_id, e.v, r.root FROM {pre}r r JOIN {pre}e e ON e.tile_id = r.tile_id AND e.u = r.pos WHERE r.root < e.v),
{out} AS (SELECT {pre}k.*, m.comp_id FROM {pre}k JOIN (SELECT tile_id, pos, min(root) AS comp_id FROM {pre}r GROUP BY 1, 2) m USING (tile_id, pos))"""


RPX = with_fx("fx_pixels", recursive=True)


@query("components", RPX + ", " + comp_sql("fx_pixels", "c") + " SELECT tile_id, y, x, comp_id FROM c")
def components(spark, sf):
    return C.components(derived(spark, sf, "fx_pixels"))


@query("components_four", RPX + ", " + comp_sql("fx_pixels", "c", diagonal=False) + " SELECT tile_id, y, x, comp_id FROM c")
def components_four(spark, sf):
    return C.components(derived(spark, sf, "fx_pixels"), diagonal=False)


STATS = """SELECT tile_id, comp_id, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x0, max(x) AS x1,
 min(y) AS y0, max(y) AS y1 FROM c GROUP BY 1, 2"""


@query("component_stats", RPX + ", " + comp_sql("fx_pixels", "c") + " " + STATS)
def component_stats(spark, sf):
    out = C.component_stats(C.components(derived(spark, sf, "fx_pixels")))
    return out.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query("hysteresis", with_fx("fx_prob", recursive=True) + ", lo AS (SELECT * FROM fx_prob WHERE p_milli > 400), " + comp_sql("lo", "c") + """
SELECT tile_id, y, x FROM c WHERE (tile_id, comp_id) IN (SELECT (tile_id, comp_id) FROM c WHERE p_milli > 900)""")
def hysteresis(spark, sf):
    prob = derived(spark, sf, "fx_prob").withColumn("p", F.col("p_milli") / 1000.0)
    return C.hysteresis(prob, 0.4, 0.9)


@query("valid_region", with_fx("fx_gray", recursive=True) + ", lo AS (SELECT * FROM fx_gray WHERE v <= 150), " + comp_sql("lo", "c") + f""",
bad AS (SELECT tile_id, y, x FROM c WHERE (tile_id, comp_id) IN (SELECT (tile_id, comp_id) FROM c WHERE y IN (0, 191) OR x IN (0, 191))),
{_offsets(P.ellipse(3)).replace("k(dy", "kk(dy")} SELECT DISTINCT tile_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM bad CROSS JOIN kk
WHERE y + dy BETWEEN 0 AND 191 AND x + dx BETWEEN 0 AND 191""")
def valid_region(spark, sf):
    gray = derived(spark, sf, "fx_gray")
    return C.valid_region(gray, tiles(gray), 150, pad=1)


@query("fill_holes", RPX + f""", {_offsets({-1: 1, 0: 1, 1: 1}).replace("k(dy", "kk(dy")},
fat AS (SELECT DISTINCT tile_id, y + dy AS y, x + dx AS x FROM fx_pixels CROSS JOIN kk),
bg AS (SELECT t.tile_id, CAST(gy.y AS INT) AS y, CAST(gx.x AS INT) AS x FROM (SELECT DISTINCT tile_id FROM fat) t, range(-2, 194) gy(y), range(-2, 194) gx(x)
  WHERE NOT EXISTS (SELECT 1 FROM fat WHERE fat.tile_id = t.tile_id AND fat.y = gy.y AND fat.x = gx.x)),
free AS (SELECT tile_id, y, x FROM bg WHERE y IN (-2, 193) OR x IN (-2, 193)
  UNION SELECT b.tile_id, b.y, b.x FROM free f JOIN bg b ON b.tile_id = f.tile_id AND abs(b.y - f.y) + abs(b.x - f.x) = 1)
SELECT tile_id, y, x FROM fat UNION ALL (SELECT tile_id, y, x FROM bg EXCEPT SELECT tile_id, y, x FROM free)""")
def fill_holes(spark, sf):
    """Holes of the pixels grown by one."""
    return C.fill_holes(cut(P.dilate(derived(spark, sf, "fx_pixels"), P.SQUARE3)))


def nodes_sql(least: int, out: str = "nodes") -> str:
    """Node places from pixels with at least ``least`` neighbours.

    Two grown disks are one group when some of their pixels touch, which depends on the offset of their centres alone."""
    disk = [(dy, dx) for dy, k in P.disk(6).items() for dx in range(-k, k + 1)]
    touch = sorted({(a + c, b + d) for a, b in disk for c, d in ((v + s, w + t) for v, w in disk for s in (-1, 0, 1) for t in (-1, 0, 1))})
    return f"""{DEG}, br AS MATERIALIZED (SELECT tile_id, y, x, CAST(y AS BIGINT) * {P.PITCH} + x AS pos FROM deg WHERE deg >= {least}),
tt(dy, dx) AS (VALUES {", ".join(map(str, touch))}), dk(dy, dx) AS (VALUES {", ".join(map(str, disk))}),
be AS MATERIALIZED (SELECT a.tile_id, a.pos AS u, b.pos AS v FROM br a JOIN br b ON a.tile_id = b.tile_id AND a.pos <> b.pos AND abs(a.y - b.y) <= 13
  JOIN tt ON tt.dy = b.y - a.y AND tt.dx = b.x - a.x),
bq(tile_id, pos, root) AS (SELECT tile_id, pos, pos FROM br UNION SELECT e.tile_id, e.v, q.root FROM bq q JOIN be e ON e.tile_id = q.tile_id AND e.u = q.pos WHERE q.root < e.v),
bm AS (SELECT tile_id, pos, min(root) AS comp FROM bq GROUP BY 1, 2),
cell AS (SELECT DISTINCT br.tile_id, bm.comp, br.y + dk.dy AS y, br.x + dk.dx AS x FROM br JOIN bm USING (tile_id, pos) CROSS JOIN dk
  WHERE br.y + dk.dy BETWEEN 0 AND {TILE_SIDE - 1} AND br.x + dk.dx BETWEEN 0 AND {TILE_SIDE - 1}),
spot AS MATERIALIZED (SELECT tile_id, tile_id || ':' || comp AS id, avg(x) AS x, avg(y) AS y FROM cell GROUP BY tile_id, comp),
near_ AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM spot a JOIN spot b ON a.tile_id = b.tile_id AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144),
nq(id, root) AS (SELECT id, id FROM spot UNION SELECT n.v, q.root FROM nq q JOIN near_ n ON n.u = q.id WHERE q.root < n.v),
{out} AS (SELECT tile_id, avg(x) AS x, avg(y) AS y, count(*) AS size FROM spot JOIN (SELECT id, min(root) AS root FROM nq GROUP BY id) USING (id) GROUP BY tile_id, root)"""


@query("junction_nodes", RPX + f", {nodes_sql(3)} SELECT tile_id, round(x, 6) AS x, round(y, 6) AS y, size FROM nodes")
def junction_nodes(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return C.junction_nodes(px, tiles(px)).withColumns({c: F.round(c, 6) for c in "xy"})


@query("base_proposals", RPX + f""", {nodes_sql(4)}, at_ AS (SELECT tile_id, greatest(0, least(CAST(round_even(x, 0) AS INT), {TILE_SIDE - 1})) AS node_x,
  greatest(0, least(CAST(round_even(y, 0) AS INT), {TILE_SIDE - 1})) AS node_y FROM nodes)
SELECT tile_id, node_x, node_y, 'base_topology' AS proposal_source, 'base_junction' AS proposal_type, CAST(1 AS DOUBLE) AS proposal_score,
  CAST(node_x < 8 OR node_y < 8 OR node_x >= {TILE_SIDE - 8} OR node_y >= {TILE_SIDE - 8} AS INT) AS border_flag FROM at_""")
def base_proposals(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return C.base_proposals(C.junction_nodes(px, tiles(px), k=3), tiles(px))


@query("topology_gate", with_fx("fx_pixels", "fx_detections") + f""", {DEG}, {_offsets(P.ellipse(5))},
m AS (SELECT DISTINCT tile_id, y + dy AS y, x + dx AS x FROM deg CROSS JOIN k WHERE deg >= 3)
SELECT id, CAST(floor(d.scene_id / 10) AS INT) AS tile_id, d.x % 192 AS x, d.y % 192 AS y FROM fx_detections d
WHERE EXISTS (SELECT 1 FROM m WHERE m.tile_id = CAST(floor(d.scene_id / 10) AS INT) AND m.y = d.y % 192 AND m.x = d.x % 192)""")
def topology_gate(spark, sf):
    d = derived(spark, sf, "fx_detections").select(
        "id", F.floor(F.col("scene_id") / 10).cast("int").alias("tile_id"), (F.col("x") % 192).alias("x"), (F.col("y") % 192).alias("y"))
    return C.topology_gate(derived(spark, sf, "fx_pixels"), d, 2)


SKELETON_LEVELS = 8      # more than any blob of the derived pixels has


def _skeleton_sql(levels: int = SKELETON_LEVELS) -> str:
    text = _dilate_sql("fx_pixels", P.CROSS3) + ", e0 AS MATERIALIZED (SELECT tile_id, y, x FROM d)"
    for i in range(levels):
        text += ", " + _erode_sql(f"e{i}", P.CROSS3, f"e{i + 1}", outside=True).replace(" AS (", " AS MATERIALIZED (", 1)
        text += f""", o{i} AS (SELECT tile_id, y, x FROM e{i} EXCEPT SELECT e.tile_id, CAST(e.y + k.dy AS INT), CAST(e.x + k.dx AS INT) FROM e{i + 1} e CROSS JOIN k)"""
    return text + " " + " UNION ".join(f"SELECT tile_id, y, x FROM o{i}" for i in range(levels))


@query("morph_skeleton", with_fx("fx_pixels") + ", " + _skeleton_sql())
def morph_skeleton(spark, sf):
    px = derived(spark, sf, "fx_pixels")
    return C.morph_skeleton(P.dilate(px, P.CROSS3, tiles(px)), tiles(px))
