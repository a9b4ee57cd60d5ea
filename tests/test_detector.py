"""The detector against its stages wired by hand, planted nodes, crowded places and rows that cannot be scored."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import arms as A
from lineweave.operators import detector as D
from lineweave.operators import pixels as P
from lineweave.operators import scoring as S
from lineweave.operators import spatial
from lineweave.operators.arbitration import Settings
from lineweave.session import cut


def ray(cx, cy, angle, length, start=0):
    return {(cy + round(k * math.sin(math.radians(angle))), cx + round(k * math.cos(math.radians(angle)))) for k in range(start, length)}


def scene(spark, *nodes, tile=0):
    """Each node is (x, y, angles, length); an angle can come with a first step."""
    px = set()
    for x, y, angles, length in nodes:
        px |= {(y, x)}
        for a in angles:
            a, start = a if isinstance(a, tuple) else (a, 0)
            px |= ray(x, y, a, length, start)
    return cut(spark.createDataFrame([(tile, y, x) for y, x in sorted(px)], "tile_id int, y int, x int"))


T_, Y_, X_ = (0, 90, 180), (270, 30, 150), (0, 90, 180, 270)


@pytest.fixture(scope="module")
def net(spark):
    dense = scene(spark, (60, 60, T_, 25), (160, 60, Y_, 25), (60, 160, X_, 25))
    sparse = scene(spark, (200, 200, T_, 190), (600, 200, (0, 180), 190), (200, 600, (0, 180), 190), (600, 600, (0, 180, (90, 2)), 190), tile=1)
    return cut(dense.unionByName(sparse))


def found(df):
    return sorted((r["tile_id"], r["x"], r["y"], r["label"]) for r in df.collect())


def test_tiers_cover_every_share_once():
    for cfg in (D.Detector(auto_scale=True), D.Detector(auto_scale=True, sparse_ratio=0.015), D.Detector(auto_scale=True, sparse_ratio=0.005), D.Detector()):
        every = D.tiers(cfg)
        assert every[0].lo == 0.0 and every[-1].hi == float("inf")
        assert all(a.hi == b.lo for a, b in zip(every, every[1:]))


def test_planted_nodes_are_found(spark, net):
    out = found(D.detect(net, D.Detector(mode="graph", base=D.Tier(recovery=True))))
    want = [(0, 60, 60, "T"), (0, 60, 160, "X"), (0, 160, 60, "Y"), (1, 200, 200, "T"), (1, 600, 600, "T")]
    assert [(t, label) for t, _, _, label in out] == [(t, label) for t, _, _, label in want]
    assert all(abs(a[1] - b[1]) <= 2 and abs(a[2] - b[2]) <= 2 for a, b in zip(out, want))
    without = found(D.detect(net, D.Detector(mode="graph")))
    assert len(without) == 4          # the broken stem shows no branch pixel


@pytest.mark.parametrize("flags", [
    {"t_to_y": True, "base": D.Tier(x_consistency=True, merge=20)},
])
def test_same_as_stages_by_hand(spark, net, flags):
    cfg = replace(D.Detector(mode="graph"), **flags)
    dets = D._full(cut(D.graph_detections(net, cfg, cfg.base)), "tile_id")
    if cfg.t_to_y or cfg.y_to_t:
        dets = A.local_recheck(dets.drop("local_ambiguous"), net, cfg.t_to_y, cfg.y_to_t)
    if cfg.vote:
        dets = A.multiradius_vote(cut(dets), net)
    if cfg.base.x_consistency:
        dets = D.x_evidence(cut(dets), net)
    if cfg.base.merge:
        dets = spatial.cluster_nms(cut(dets.select("tile_id", "id", "x", "y", "label", "score", "source_kind")), float(cfg.base.merge), ["tile_id"], respect_label=False)
    assert found(D.detect(net, cfg)) == found(dets)


def test_tiles_of_all_densities_in_one_call(spark, net):
    ratios = {r["tile_id"]: r["branch_ratio"] for r in P.branch_ratio(net).collect()}
    assert ratios[1] < 0.03 < ratios[0]
    rows = D.detect(net, D.Detector(mode="graph", auto_scale=True, low_endpoint=10)).collect()
    assert {(r["tile_id"], r["label"]) for r in rows} == {(0, "T"), (0, "Y"), (0, "X"), (1, "T")}
    assert sum(r["tile_id"] == 1 for r in rows) == 2


def test_hybrid_and_template_modes(spark):
    px = scene(spark, (60, 60, T_, 25))
    t = np.zeros((9, 9))
    t[4, :], t[4:, 4] = 255, 255
    for mode, aware in (("hybrid", True), ("hybrid", False)):
        out = found(D.detect(px, D.Detector(mode=mode, match=0.5, conflict_aware=aware, vote=False), [("T", t)]))
        assert [r[3] for r in out] == ["T"] and abs(out[0][1] - 60) <= 2 and abs(out[0][2] - 60) <= 2


def test_asks_for_what_it_needs(spark, net):
    with pytest.raises(ValueError, match="templates"):
        D.detect(net, D.Detector(mode="hybrid"))
    with pytest.raises(ValueError, match="mode"):
        D.detect(net, D.Detector(mode="other"))


def test_no_pixels(spark):
    none = spark.createDataFrame([], "tile_id int, y int, x int")
    assert D.detect(none, D.Detector(mode="graph", auto_scale=True)).count() == 0
    assert D.detect(none, D.Detector(mode="graph")).count() == 0


def test_crowded_place_is_searched_once(spark):
    px = scene(spark, (60, 60, T_, 25))
    rows = spark.range(10_000).selectExpr("0 AS tile_id", "id", "63 AS x", "60 AS y", "'Y' AS label", "'graph' AS source_kind", "0.004D AS branch_ratio", "'T' AS x_major", "3 AS x_votes",
                                          "3 AS x_three", "0 AS x_four", "cast(null as string) AS post")
    out = D.sparse_t_snap(rows, px)
    assert [(r["x"], r["y"], r["label"], r["n"]) for r in out.groupBy("x", "y", "label").agg(F.count(F.lit(1)).alias("n")).collect()] == [(60, 60, "T", 10_000)]


def test_centre_modes_agree_on_clean_nodes(spark, net):
    from lineweave.operators import components as C

    comps = cut(C.components(P.branch_pixels(net)))
    for mode in D.CENTERS:
        rows = D.component_centers(net, comps, center=mode).collect()
        assert sorted(r["label"] for r in rows) == ["T", "T", "X", "Y"]
    whole = A.component_arms(net, comps).collect()
    assert sorted(r["label"] for r in whole) == ["T", "T", "X", "Y"]


# ---------------------------------------------------------------- rows that cannot be scored

def scored_rows(spark, n=20):
    return spark.range(n).selectExpr("id", "'a' AS source_image", "cast(id * 50 as int) AS x", "0 AS y", "'base_topology' AS proposal_source", "'base_junction' AS proposal_type", "false AS border_flag",
                                     "cast(null as double) AS proposal_score", "'T' AS geometry_label", "3 AS branch_count", "90D AS min_gap_deg", "180D AS max_gap_deg", "'old' AS score_error")


def sure_of(k, bad=()):
    def run(rows):
        if rows["id"].isin(bad).any():
            raise RuntimeError("cannot be read")
        p = np.full((len(rows), 4), 0.1)
        p[:, k] = 0.7
        return p

    return run


def test_a_failed_row_is_an_error_and_stays(spark):
    heads = {h: sure_of(1, bad=(7,) if h == "svm" else ()) for h in ("cnn", "mlp", "svm", "xgb")}
    for cfg in (S.Scoring(), S.Scoring("mlp"), S.Scoring("xgb_cascade"), S.Scoring(settings=Settings(positive_only=True), nms_radius=5.0, cluster_radius=5.0, mixed_radius=5.0)):
        rows = {r["id"]: r for r in S.score_rows(scored_rows(spark), heads, cfg).collect()}
        assert len(rows) == 20 and rows[7]["consensus"] == "ERROR" and rows[7]["agreement"] == 0 and rows[7]["cnn_pred"] == "ERROR" and rows[7]["cnn_prob_T"] is None
        assert rows[7]["score_error"] == "svm: RuntimeError" and rows[7]["min_gap_deg"] is None
        assert {r["consensus"] for i, r in rows.items() if i != 7} == {"T"}


def test_meta_model_decides_and_may_fail(spark):
    heads = {h: sure_of(1) for h in ("cnn", "mlp", "svm", "xgb")}
    rows = {r["id"]: r for r in S.score_rows(scored_rows(spark), heads, S.Scoring("meta"), meta=sure_of(3, bad=(2,))).collect()}
    assert rows[2]["consensus"] == "ERROR" and rows[3]["consensus"] == "Y"


def test_wrong_shapes_and_missing_heads(spark):
    heads = {h: sure_of(1) for h in ("cnn", "mlp", "svm", "xgb")}
    out = S.score_heads(scored_rows(spark, 3), {"cnn": lambda rows: np.zeros((len(rows), 3))}).collect()
    assert {r["score_error"] for r in out} == {"cnn: ValueError"}
    with pytest.raises(ValueError, match="no scorer"):
        S.score_rows(scored_rows(spark), {"cnn": heads["cnn"]})
    with pytest.raises(ValueError, match="no scorer"):
        S.score_rows(scored_rows(spark), heads, S.Scoring("meta"))
    assert S.score_heads(scored_rows(spark, 0), heads).count() == 0
