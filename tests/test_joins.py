"""Tables of pixels are joined by key, never sent whole through the driver, and components are read without dark pixels."""

import random

import pytest
from pyspark.sql import functions as F

from lineweave.operators import arms as A
from lineweave.operators import components as C
from lineweave.operators import pixels as P
from lineweave.operators import rings as R
from lineweave.operators import spatial as S
from lineweave.session import cut, shuffled
from tests.shapes import frame, noise


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture(scope="module")
def px(spark):
    return cut(frame(spark, {"a": noise(0.3, 1), "b": noise(0.2, 2)}).select(F.when(F.col("tile_id") == "a", 0).otherwise(1).alias("tile_id"), "y", "x"))


def test_pixel_joins_are_not_broadcast(spark, px):
    grown = P.dilate(px, P.CROSS3)
    points = px.where("x % 7 = 0").withColumn("id", P.line_key())
    for df in (P.mask_minus(grown, px), P.mask_intersect(px, grown), S.radius_join(px, points.select("tile_id", "x", "y"), 3.0, ["tile_id"]),
               S.radius_anti_join(px, points, 3.0, ["tile_id"]), R.snap_to_pixel(points, px, 2), C.topology_gate(px, points, 2)):
        assert broadcasts(df) == 0


def test_readings_of_components_are_not_broadcast(spark, px):
    comps = cut(C.components(P.branch_pixels(px)))
    assert broadcasts(A.best_centers(px, comps, A.Rules(inner=2, outer=5))) == 0
    # The labels of the few groups that cross a block may be looked up by broadcast; pixels and places may not.
    assert broadcasts(A.component_arms(px, comps, A.Rules(inner=2, outer=5))) == 0


def test_skeleton_lies_in_the_mask(spark, px):
    dims = px.select("tile_id").distinct().select("tile_id", F.lit(40).alias("width"), F.lit(40).alias("height"))
    out = C.morph_skeleton(P.dilate(px, P.CROSS3, dims), dims)
    assert broadcasts(out) == 0
    full = {(r["y"], r["x"]) for r in out.where("tile_id = 0").collect()}
    grown = {(r["y"], r["x"]) for r in P.dilate(px, P.CROSS3, dims).where("tile_id = 0").collect()}
    assert full and full <= grown


def test_component_arms_like_two_dilations(spark, px):
    """The intervals give the band that two whole dilations give, for pixels given twice as well."""
    rules = A.Rules(inner=2, outer=5, min_pixels=1)
    comps = cut(C.components(P.branch_pixels(px)))
    got = {(r["tile_id"], r["comp_id"]): (r["arm_count"], round(r["x"], 6), round(r["y"], 6)) for r in A.component_arms(px.unionAll(px), comps, rules).collect()}
    lit, groups = {}, {}
    for r in px.collect():
        lit.setdefault(r["tile_id"], set()).add((r["y"], r["x"]))
    for r in comps.collect():
        groups.setdefault((r["tile_id"], r["comp_id"]), set()).add((r["y"], r["x"]))

    def grown(at, kernel):
        return {(y + dy, x + d) for y, x in at for dy, k in kernel.items() for d in range(-k, k + 1)}

    assert set(got) == set(groups)
    for (tile, comp), at in groups.items():
        band = (grown(at, P.ellipse(11)) - grown(at, P.ellipse(5))) & lit[tile]
        left, arms = set(band), []
        while left:
            stack, part = [left.pop()], []
            while stack:
                y, x = stack.pop()
                part.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                stack += near
            arms.append(part)
        cy, cx = sum(y for y, _ in at) / len(at), sum(x for _, x in at) / len(at)
        n = sum(((sum(x for _, x in p) / len(p) - cx) ** 2 + (sum(y for y, _ in p) / len(p) - cy) ** 2) ** 0.5 >= 1e-6 for p in arms)
        assert got[tile, comp] == (n, round(cx, 6), round(cy, 6))


def test_shuffled_keeps_rows(spark):
    rng = random.Random(3)
    a = spark.createDataFrame([(rng.randrange(9), i) for i in range(50)], "k int, v int")
    assert sorted(a.join(shuffled(a.select("k").distinct()), "k").collect()) == sorted(a.collect())


def test_many_small_tiles_are_labelled_together(spark):
    """As many calls as batches, not as blocks; a block may go over several batches, and a tile may have no name."""
    from tests.shapes import groups

    tiles = {None if t == 0 else f"t{t}": {(y - 3, x - 3) for y, x in noise(0.4, t, 9)} for t in range(300)}
    tiles["wide"] = {(y, x * 200) for y, x in noise(0.5, 7, 20)} | {(y, x) for y, x in noise(0.45, 8, 90)}
    rows = spark.createDataFrame([(t, y, x) for t, at in tiles.items() for y, x in at], "tile_id string, y int, x int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {}
        for r in C.components(rows).collect():
            got.setdefault((r["tile_id"], r["comp_id"]), set()).add((r["y"], r["x"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(t, min(y * P.PITCH + x for y, x in g)): set(g) for t, at in tiles.items() if t for g in groups(at)}
    assert {k: v for k, v in got.items() if k[0]} == {k: v for k, v in want.items()}
    assert set().union(*[v for k, v in got.items() if k[0] is None]) == tiles[None]


def test_components_run_no_call_for_each_block(spark, px):
    from lineweave.operators import components

    seen = []
    real = components.cut
    try:
        components.cut = lambda df: seen.append(df._jdf.queryExecution().analyzed().toString()) or real(df)
        C.components(px)
    finally:
        components.cut = real
    assert not any("FlatMapGroupsInPandas" in plan for plan in seen)


def test_windows_are_dealt_out_once_for_gradients(spark):
    """One shuffle of pixels; the gradients, cells and blocks of a window stay where it is."""
    from lineweave.operators import patches as W

    rows = cut(spark.createDataFrame([(p, y, x) for p in range(20) for y, x in noise(0.2, p, 24)], "patch_id long, y int, x int"))
    out = W.hog_features(rows, 24)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.select("patch_id").distinct().count() == 20


def test_pixels_without_a_place_keep_their_labels(spark):
    rows = spark.createDataFrame([(0, None, 1), (0, None, 2), (0, None, 9), (0, 4, None), (0, 7, None), (0, 5, 5), (0, 6, 6)], "tile_id int, y int, x int")
    got = sorted((r["y"] is None, r["x"] is None, r["y"] or 0, r["x"] or 0, r["comp_id"]) for r in C.components(rows).collect())
    least = -(1 << 63)
    assert got == [(False, False, 5, 5, 5 * P.PITCH + 5), (False, False, 6, 6, 5 * P.PITCH + 5), (False, True, 4, 0, least), (False, True, 7, 0, least),
                   (True, False, 0, 1, 1), (True, False, 0, 2, 1), (True, False, 0, 9, 9)]


def cut_plans(module, run):
    """The plans of all tables that ``run`` cuts in ``module``, and of what it returns."""
    plans, real = [], module.cut
    try:
        module.cut = lambda df: plans.append(df) or real(df)
        plans.append(run())
    finally:
        module.cut = real
    return plans


def test_rounds_of_groups_are_not_broadcast(spark, px):
    """Suppression, clusters and the graph step: each round is joined by key."""
    from lineweave.operators import graph

    at = px.withColumns({"id": P.line_key(), "label": F.lit("T"), "score": F.rand(5), "source_kind": F.lit("graph")})
    at = cut(at)
    edges = cut(at.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    plans = [*cut_plans(graph, lambda: graph.components(edges)), *cut_plans(S, lambda: S.nms(at, 2.0, ["tile_id"], [F.col("score")])),
             *cut_plans(S, lambda: S.cluster_nms(at, 1.5, ["tile_id"], respect_label=False))]
    assert len(plans) > 6 and not any(broadcasts(df) for df in plans)


def test_snapped_centres_are_not_broadcast(spark, px):
    from lineweave.operators import detector as D

    comps = cut(C.components(P.branch_pixels(px)))
    for mode in ("centroid", "snap"):
        assert not any(broadcasts(df) for df in cut_plans(D, lambda: D.component_centers(px, comps, A.Rules(inner=2, outer=5), center=mode)))


def test_branches_of_points_are_not_broadcast(spark, px):
    from lineweave.operators import paths as T

    points = cut(P.branch_pixels(px).withColumn("id", P.line_key()))
    assert broadcasts(T.local_junction(px, points)) == 0
