import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import calibration as K
from lineweave.operators import graph
from lineweave.operators import ranks as R
from lineweave.operators import sampling
from lineweave.operators import spatial as S
from tests.shapes import greedy_keep


@pytest.fixture(scope="module")
def points(spark):
    """One scene; a third of the rows sit on a single place."""
    rng = random.Random(5)
    rows = [(1, i, *((7, 7) if i % 3 == 0 else (rng.randrange(60), rng.randrange(60))), rng.randrange(12)) for i in range(240)]
    return rows, spark.createDataFrame(rows, "scene long, id long, x int, y int, score int").cache()


@pytest.mark.parametrize("inclusive", [True, False])
def test_nms(points, inclusive):
    rows, df = points
    want = {p[0][1] for p in greedy_keep([((-r[4], r[1]), r[2], r[3]) for r in rows], 6.0, inclusive)}
    assert {r["id"] for r in S.nms(df, 6.0, ["scene"], [-F.col("score")], inclusive).collect()} == want


def test_clusters(points):
    rows, df = points
    comp = {r[1]: r[1] for r in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in rows:
        for b in rows:
            if a[1] < b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 3.0:
                u, v = sorted((find(a[1]), find(b[1])))
                comp[v] = u
    assert {r["id"]: r["cluster_id"] for r in S.radius_clusters(df, 3.0, ["scene"]).collect()} == {i: find(i) for i in comp}


def test_greedy_match_with_a_hot_place(spark, points):
    rows, df = points
    rng = random.Random(9)
    truth = [(1, 1000 + i, *((7, 7) if i % 4 == 0 else (rng.randrange(60), rng.randrange(60)))) for i in range(160)]
    t = spark.createDataFrame(truth, "scene long, gt_id long, x int, y int")
    got = [(r["gt_id"], r["pred_id"], r["distance"]) for r in S.greedy_match(t, df, 8.0, ["scene"]).collect()]
    first_t, first_p = {}, {}
    for r in truth:
        first_t[r[2:4]] = min(first_t.get(r[2:4], 10**9), r[1])
    for r in rows:
        first_p[r[2:4]] = min(first_p.get(r[2:4], 10**9), r[1])
    cand = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), first_t[a[2:4]], first_p[b[2:4]], a[1], b[1]) for a in truth for b in rows if math.hypot(a[2] - b[2], a[3] - b[3]) <= 8.0)
    used_t, used_p, want = set(), set(), set()
    for d, _, _, a, b in cand:
        if a not in used_t and b not in used_p:
            used_t.add(a)
            used_p.add(b)
            want.add((a, b, round(d, 9)))
    assert {(a, b, round(d, 9)) for a, b, d in got} == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1001 + i) for i in range(200)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert {got[i] for i in range(301)} == {0}
    assert {got[1000 + i] for i in range(201)} == {1000}


def test_quantiles_with_one_heavy_group(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", rng.choice([0.5, rng.random()])) for i in range(500)]
    out = {r["g"]: r["q"] for r in R.group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.025, 0.5, 0.975, 1.0]).collect()}
    for g in "ab":
        assert np.allclose(out[g], np.percentile([v for k, v in rows if k == g], [0, 2.5, 50, 97.5, 100]))


def test_calibration_matches_a_fine_grid(spark):
    c = np.array([[0.6, 0.2, 0.1], [0.3, 0.7, 0.3], [0.1, 0.1, 0.6]])
    qs = [(0.9, 0.05, 0.05), (0.1, 0.1, 0.8), (0.3, 0.5, 0.2), (0.0, 1.0, 0.0)]
    grid = np.array([(i, j, 100 - i - j) for i in range(101) for j in range(101 - i)]) / 100
    out = K.calibrated_fractions(spark.createDataFrame(qs, "a double, b double, c double"), ["a", "b", "c"], c, ["p", "q", "r"]).collect()
    for row in out:
        q, p = np.array([row["a"], row["b"], row["c"]]), np.array([row["p"], row["q"], row["r"]])
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()
        assert ((c @ p - q) ** 2).sum() <= ((grid @ c.T - q) ** 2).sum(1).min() + 1e-9


def test_split_has_no_leak(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 17).alias("src"))
    parts = sampling.split_by_source(rows, "src", 0.3, seed=2).cache()
    assert sampling.leaks(parts, "src").count() == 0
    assert parts.where("part = 'val'").select("src").distinct().count() == 5


def test_no_radius_join_plan_is_a_nested_loop(points):
    _, df = points
    plan = S.radius_join(df, df, 5.0, ["scene"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
