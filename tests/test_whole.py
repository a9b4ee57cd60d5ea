"""Queries run the whole of their job: all radii, all rows, all proposals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lineweave.llm import pii
from lineweave.llm.boosting import BoostedTrees, fit_folds
from lineweave.operators import detector as D
from lineweave.operators import pixels as P
from lineweave.operators import scoring
from lineweave.operators.pixels import PITCH
from lineweave.plans import QUERIES
from lineweave.plans.derived import derived
from lineweave.session import cut


def test_geometry_features_reads_the_large_circles_and_long_arms(spark, tmp_path):
    """A T whose arms are 90 px long; keys are solved from the fixture's formula for the wanted places."""
    place = {(96, x) for x in range(6, 187)} | {(y, 96) for y in range(96, 187)}
    rows = [(0, 55 * y % 192, 31 * x % 192, 0) for y, x in sorted(place)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.asDict() for r in QUERIES["geometry_features"](spark, str(tmp_path)).collect()]
    middle = next(r for r in got if r["id"] == 96 * PITCH + 96)
    assert middle["geometry_collinearity_r60"] < 5 and middle["geometry_collinearity_r80"] < 5
    assert max(r["geometry_collinearity_r80"] for r in got) < 90


def test_rows_that_fail_do_not_send_the_others_one_by_one():
    rows, sizes = pd.DataFrame({"id": range(4100)}), []

    def head(part):
        sizes.append(len(part))
        if (part["id"] % 41 == 0).any():
            raise ValueError
        return np.stack([part["id"], part["id"] * 2.0], axis=1)

    probs, errors = scoring._batch(rows, {"svm": head}, "NT")
    assert [i for i, e in enumerate(errors) if e] == list(range(0, 4100, 41)) and {e for e in errors if e} == {"svm: ValueError"}
    fine = rows["id"] % 41 != 0
    assert (probs["svm"][fine, 1] == rows["id"][fine] * 2).all() and np.isnan(probs["svm"][~fine]).all()
    assert len(sizes) < 1600
    sizes.clear()
    assert all(scoring._batch(pd.DataFrame({"id": [0] * 64}), {"svm": head}, "NT")[1]) and len(sizes) < 128


def test_rows_to_be_scored_are_dealt_out(spark, tmp_path):
    orders = spark.range(500).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey", "1D AS o_totalprice").coalesce(1)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = derived(spark, str(tmp_path), "fx_rows", dealt=True)
    assert rows.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    assert sorted(map(str, rows.collect())) == sorted(map(str, derived(spark, str(tmp_path), "fx_rows").collect()))


def test_folds_in_passes_learn_what_one_array_teaches(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (1500, 3)).astype(float)
    y = ((x[:, 0] > 5) & (x[:, 1] > 3)).astype(int)
    rows = spark.createDataFrame([(i % 3, int(v), [*map(float, r)]) for i, (r, v) in enumerate(zip(x, y))], "fold int, y int, x array<float>")
    trees, judged = fit_folds(rows, 3, trees=6)
    assert np.allclose(trees.predict(x), BoostedTrees(trees=6).fit(x, y).predict(x), atol=1e-4)
    got = judged.agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"), F.sum(F.when(F.col("p") >= 0.5, F.col("positive"))).alias("right")).first()
    assert (got["n"], got["positive"]) == (1500, y.sum()) and got["right"] > 0.95 * y.sum()


def test_all_proposals_teach(spark, monkeypatch):
    """More of one kind and label than any sample of 20,000 had room for."""
    seen = []
    monkeypatch.setattr(pii, "fit_folds", lambda *a: seen.append(fit_folds(*a, trees=2)) or seen[-1])
    pii.train(spark.range(4000).selectExpr("concat('word', id, '@example', id, '.org') AS text"))
    assert seen[0][1].where("kind = 'email'").agg(F.sum("n")).first()[0] == 4000


def test_weak_pixels_are_found_across_blocks_in_one_pass(spark):
    """A broken line with a corner lies over the edge of two blocks; each test is made over again here."""
    place = {(40, x) for x in range(990, 1060) if x != 1030} | {(y, 1010) for y in range(30, 41)} | {(y, 1059) for y in range(40, 52)}
    px = cut(spark.createDataFrame([(0, y, x) for y, x in sorted(place)], "tile_id int, y int, x int"))
    branch = cut(P.branch_pixels(px))
    deg = {(y, x): sum((y + dy, x + dx) in place for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - 1 for y, x in place}
    fork, ends = {p for p in place if deg[p] >= 3}, {p for p in place if deg[p] <= 1}

    def near(p, seeds, r):
        return any((p[0] + dy, p[1] + dx) in seeds for dy, k in P.ellipse(2 * r + 1).items() for dx in range(-k, k + 1))

    def sharp(p):
        a, b = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (p[0] + dy, p[1] + dx) in place]
        return math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / math.hypot(*a) / math.hypot(*b))))) <= 150.0

    want = set()
    for p in place - fork:
        corner = deg[p] == 2 and sharp(p)
        if (deg[p] >= 2 and near(p, fork, 2)) or (deg[p] == 2 and near(p, ends, 10)) or (corner and near(p, ends, 12)):
            want.add((*p, corner))
    weak = D.weak_pixels(px, branch, corner=True, corner_endpoint=12)
    assert {(r["y"], r["x"], r["corner"]) for r in weak.collect()} == want and any(c for *_, c in want)
    plan = weak._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "SortMergeJoin" not in plan and "Window" not in plan
