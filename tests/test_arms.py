from lineweave.operators import arms as A
from lineweave.operators import components as C
from lineweave.operators import fusion
from lineweave.operators import pixels as P
from tests import shapes as S

TILES = {"cross": S.cross(), "tee": S.tee(), "wye": {(20 + i, 20) for i in range(20)} | {(20 - i // 2, 20 - i) for i in range(20)} | {(20 - i // 2, 20 + i) for i in range(20)}}


def test_labels_of_ideal_nodes(spark):
    px = S.frame(spark, TILES)
    pts = spark.createDataFrame([(t, 1, 20, 20) for t in TILES], "tile_id string, id long, x int, y int")
    for mode in ("legacy", "symmetric", "robust", "robust_vote"):
        got = {r["tile_id"]: r["label"] for r in A.local_geometry(px, pts, rules=A.Rules(mode=mode)).collect()}
        assert got == {"cross": "X", "tee": "T", "wye": "Y"}, mode


def test_whole_component_reading(spark):
    px = S.frame(spark, TILES).cache()
    comps = C.components(P.branch_pixels(px))
    got = {r["tile_id"]: (r["label"], r["arm_count"]) for r in A.component_arms(px, comps).collect()}
    assert got["cross"] == ("X", 4) and got["tee"] == ("T", 3) and got["wye"] == ("Y", 3)


def test_detector_finds_each_node_once(spark):
    px = S.frame(spark, TILES)
    got = {r["tile_id"]: (r["label"], r["x"], r["y"]) for r in A.graph_detect(px).collect()}
    assert {t: v[0] for t, v in got.items()} == {"cross": "X", "tee": "T", "wye": "Y"}
    assert all(abs(x - 20) <= 2 and abs(y - 20) <= 2 for _, x, y in got.values())


def test_fusion_lets_the_arms_decide(spark):
    px = S.frame(spark, TILES)
    cols = "tile_id string, id long, x int, y int, label string, score double"
    graph = spark.createDataFrame([("tee", 1, 20, 20, "Y", 0.9), ("cross", 2, 20, 20, "X", 0.5)], cols)
    template = spark.createDataFrame([("tee", 1, 21, 20, "T", 0.2), ("cross", 2, 21, 20, "X", 0.7), ("cross", 3, 5, 5, "T", 0.4)], cols)
    got = {(r["tile_id"], r["x"], r["y"]): (r["label"], r["fusion_reason"]) for r in fusion.fuse_sources(graph, template, px, 5.0).collect()}
    assert got[("tee", 20, 20)] == ("T", "local_geometry_arbitration")
    assert sorted(v[0] for k, v in got.items() if k[0] == "cross") == ["T", "X"]


def test_template_scan_finds_the_shape(spark):
    import numpy as np

    t = np.zeros((9, 9))
    t[4, :], t[:, 4] = 255, 255
    hits = fusion.template_scan(S.frame(spark, {"cross": S.cross()}), [("X", t)], 0.95).collect()
    assert [(r["label"], r["x"], r["y"]) for r in hits] == [("X", 20, 20)]
