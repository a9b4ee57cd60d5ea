"""Tables made of few bytes of file are made by many tasks."""

from pyspark.sql import functions as F

from lineweave.plans.derived import derived


def test_lines_are_drawn_by_many_tasks(spark, tmp_path):
    """One small file was read by one task, which then made all pixels and held those it had met."""
    orders = spark.range(3000).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("o_orderkey"), F.lit(1).alias("o_custkey"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    px = derived(spark, str(tmp_path), "fx_lines")
    plan = px._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("REPARTITION_BY_NUM")
    assert px.count() == px.distinct().count() > 10_000


def test_pixels_are_written_in_order(spark):
    """Every file of a cut table of pixels goes through tiles and rows once, with all rows in it, copies and empty places too."""
    import random

    from pyspark.sql import functions as F

    from lineweave.plans.derived import in_order

    rng = random.Random(2)
    rows = [(rng.choice([None, 0, 1, 2]), rng.choice([None, *range(30)]), rng.randrange(30)) for _ in range(500)]
    px = in_order(spark.createDataFrame(rows, "tile_id int, y int, x int").repartition(3))
    got = px.select(F.input_file_name().alias("f"), "tile_id", "y", "x").collect()
    assert sorted((str(r["tile_id"]), str(r["y"]), r["x"]) for r in got) == sorted((str(t), str(y), x) for t, y, x in rows)
    files = {}
    for r in got:
        files.setdefault(r["f"], []).append(tuple(-1 if v is None else v for v in (r["tile_id"], r["y"], r["x"])))
    assert all(at == sorted(at) for at in files.values())
