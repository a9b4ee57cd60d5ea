"""How much work the operators hand on: what is written, read again or sent for each row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.functions import scalars as X
from lineweave.operators import arbitration, arms, components, fusion, paths, rings, sweeps


def _pixels(spark, places, tile=0):
    return spark.createDataFrame([(tile, int(y), int(x)) for y, x in places], "tile_id int, y int, x int")


def _noise(seed=3, n=260, side=48):
    at = np.random.default_rng(seed).choice(side * side, n, replace=False)
    return sorted((int(i) // side, int(i) % side) for i in at)


def _orders(spark, path):
    spark.createDataFrame([(100 * (i // 3) + i % 3, i * 5, 1000.0 + i) for i in range(12)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return str(path)


# F28, F36
@pytest.mark.parametrize("name", ["detection_json", "annotation_json"])
def test_each_scene_is_a_file_of_one_folder(spark, tmp_path, monkeypatch, name):
    from lineweave.plans import files

    to, sf = tmp_path / "out", _orders(spark, tmp_path)
    monkeypatch.setattr(files, "_folder", lambda spark: str(to))
    rows = getattr(files, name)(spark, sf).collect()
    assert len(rows) == (12 if name == "detection_json" else sum((100 * (i // 3) + i % 3) % 3 != 0 for i in range(12)))
    assert len([p for p in to.iterdir() if p.name.startswith("part-") and p.stat().st_size]) == 4
    assert not [p for p in to.iterdir() if p.is_dir()]


# F33
def test_arms_are_compared_where_they_are_read(spark):
    px = _pixels(spark, _noise(n=900))
    points = _pixels(spark, [(y, x) for y in range(0, 48, 3) for x in range(0, 48, 3)] + [(500, 500)]).withColumn("id", F.monotonically_increasing_id())
    a = F.col("arms")
    plain = rings.ring_angles(px, points, (5, 9, 16)).select("tile_id", "id", "radius", F.size(a).alias("n_arms"), X.collinearity(a).alias("deviation"),
                                                            F.when(F.size(a) >= 3, F.array_max(X.circular_gaps(a))).alias("max_gap"))
    table = rings.collinearity_table(px, points, (5, 9, 16))
    assert table.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(repr, table.collect())) == sorted(map(repr, plain.collect()))
    assert "lit#" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_a_whole_and_a_wrapping_circle_are_one_arc():
    on = np.zeros((3, 64), dtype=bool)
    on[0], on[1, :3], on[1, -3:] = True, True, True
    assert rings._compare_arms(on)["n_arms"].tolist() == [1, 1, 0]


def test_geometric_sweep_counts_rows_before_cells(spark, monkeypatch):
    seen = []
    whole = sweeps.label_sweep
    monkeypatch.setattr(sweeps, "label_sweep", lambda rows, *a, **k: seen.append(rows.count()) or whole(rows, *a, **k))
    cols = [c for i, r in enumerate((12, 16, 20, 25)) for c in (f"cast({3 + i % 2} as int) as n_arms_{r}", f"cast(id % 7 * 10 as double) as deviation_{r}")]
    rows = spark.range(4000).selectExpr("case id % 4 when 0 then 'T' when 1 then 'X' when 2 then 'Y' end as true_label", "case when id % 9 > 0 then 'T' end as pred_label",
                                        "cast(2 + id % 3 as int) as branch_count", "cast(130 + id % 30 as double) as max_gap_deg", *cols)
    out = sweeps.geometric_sweep(rows).collect()
    assert len(out) == 72 and seen[0] < 1000


# F31, F34
def test_points_without_a_pixel_are_not_read(spark):
    cross = [(50, x) for x in range(40, 61)] + [(y, 50) for y in range(40, 50)]
    dets = spark.createDataFrame([(0, 1, 50, 50, "Y"), (0, 2, 300, 300, "Y")], "tile_id int, id long, x int, y int, label string")
    px, rules = _pixels(spark, cross), arms.Rules(inner=2, outer=5, min_span=1.0)
    assert arms._readings(px, dets, [4, 5, 6], rules, None, "tile_id").count() == 3
    out = arms.multiradius_vote(dets, px, outers=(4, 5, 6), rules=rules)
    assert {r["id"]: r["label"] for r in out.collect()} == {1: "T", 2: "Y"}


# F35
def test_long_lines_are_read_by_pieces(spark, monkeypatch):
    sent = []
    whole = paths.by_block
    monkeypatch.setattr(paths, "by_block", lambda px, points, *a, **k: sent.append(points.count()) or whole(px, points, *a, **k))
    lit = set(_noise(n=1200))
    lines = [(1, 0, 0, 47, 31), (2, 40, 3, 2, 45), (3, 5, 5, 5, 5), (4, -3, 10, 60, 11), (5, 0, 0, 47, 47)]
    pairs = spark.createDataFrame([(0, *v) for v in lines] + [(0, 6, None, 1, 2, 3)], "tile_id int, id long, x0 int, y0 int, x1 int, y1 int")
    got = {r["id"]: r["fill"] for r in paths.line_fill_fraction(_pixels(spark, sorted(lit)), pairs).collect()}
    want = {}
    for id_, x0, y0, x1, y1 in lines:
        n = max(abs(x1 - x0), abs(y1 - y0))
        hits = [(round(y0 + (y1 - y0) * i / max(n, 1)), round(x0 + (x1 - x0) * i / max(n, 1))) in lit for i in range(n + 1)]
        want[id_] = sum(hits) / len(hits)
    assert got == want and sent == [2 + 2 + 1 + 2 + 2]


# F37
def test_cluster_answer_is_joined_once(spark):
    rows = spark.createDataFrame([(1, i, float(x), 0.0, p, 0.1, q, 0.1, "T", 2) for i, x, p, q in ((1, 0, 0.2, 0.7), (2, 5, 0.3, 0.9), (3, 200, 0.9, 0.1), (4, 203, 0.9, None))],
                                 "scene_id int, id long, x double, y double, avg_prob_N double, avg_prob_X double, avg_prob_T double, avg_prob_Y double, consensus string, agreement int")
    out = arbitration.cluster_arbitrate(rows, 30.0, ["scene_id"])
    assert {r["id"]: (r["cluster_label"], r["consensus"]) for r in out.collect()} == {1: ("T", "N"), 2: ("T", "T"), 3: ("N", "N"), 4: ("N", "N")}
    assert {r["id"] for r in out.where("agreement > 0").collect()} == {2, 3}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 8


# F38
def test_spurs_are_followed_in_a_block():
    wide, lit = 12, bytearray(144)
    for at in (26, 27, 28, 17, 41, 30):     # three pixels to a fork; one pixel alone
        lit[at] = 1
    assert paths._spur(lit, wide, 26, 12) == [26, 27]
    assert paths._spur(lit, wide, 26, 2) == [] and paths._spur(lit, wide, 30, 12) == []


# F42
def test_templates_of_one_shape_share_the_image(monkeypatch):
    img, made, whole = np.zeros((40, 40)), [], np.fft.rfft2
    for y, x in _noise(n=300, side=40):
        img[y, x] = 255.0
    bank = [np.eye(7), np.fliplr(np.eye(7)), np.eye(5)]
    alone = [fusion._ncc(img, t, {}) for t in bank]
    monkeypatch.setattr(np.fft, "rfft2", lambda *a, **k: made.append(1) or whole(*a, **k))
    seen = {}
    assert all((fusion._ncc(img, t, seen) == a).all() for t, a in zip(bank, alone, strict=True))
    assert len(made) == 2 * 4 + 3


# F43, F44
def test_settled_lines_are_thinned_once(spark, monkeypatch):
    runs, whole = [], paths.by_block
    monkeypatch.setattr(paths, "by_block", lambda *a, **k: runs.append(1) or whole(*a, **k))
    bar = _pixels(spark, [(y, x) for y in range(10, 13) for x in range(100)])
    thin = {(r["y"], r["x"]) for r in paths.thin(bar).collect()}
    assert {y for y, _ in thin} == {11} and len(runs) == 1
    runs.clear()
    again = {(r["y"], r["x"]) for r in paths.thin(bar, rounds=1).collect()}
    assert again == thin and len(runs) == 2


# F45
def test_holes_inside_blocks_need_no_graph(spark, monkeypatch):
    ring = [(y, x) for y in range(10, 15) for x in range(10, 15) if y in (10, 14) or x in (10, 14)]
    monkeypatch.setattr(components.graph, "components", lambda links: pytest.fail("no group crosses a block"))
    assert components.fill_holes(_pixels(spark, ring)).count() == 25
