"""Queries on intake rows and on feature tables: cleaning, naming, splits, resampling, classifiers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lineweave.operators import metrics as E
from lineweave.operators import models as M
from lineweave.operators import sampling as S
from lineweave.plans.catalog import query
from lineweave.plans.columns import num_sql
from lineweave.plans.derived import derived, table, with_fx
from lineweave.sources import readers as R

RAW = with_fx("fx_raw")


@query("clean_predictions", RAW + f""", c AS (SELECT id, upper(trim(label)) AS consensus, {num_sql('num_text')} AS node_x, y AS node_y FROM fx_raw)
SELECT id, consensus, node_x, CAST(node_y AS DOUBLE) AS node_y FROM c WHERE node_x IS NOT NULL""")
def clean_predictions(spark, sf):
    raw = derived(spark, sf, "fx_raw").select("id", F.col("scene_id").cast("string").alias("source_image"), F.col("num_text").alias("node_x"),
                                              F.col("y").cast("string").alias("node_y"), F.col("label").alias("consensus"), F.lit("2").alias("agreement"))
    return R.clean_predictions(raw).where("NOT bad").select("id", "consensus", "node_x", "node_y")


@query("count_dropped", RAW + f" SELECT count(*) FILTER (WHERE {num_sql('num_text')} IS NULL) AS dropped, count(*) AS total FROM fx_raw")
def count_dropped(spark, sf):
    return R.count_dropped(derived(spark, sf, "fx_raw").select(F.col("stem").alias("source_image"), F.col("num_text").alias("node_x"), F.col("y").alias("node_y"),
                                                               F.col("label").alias("consensus"), F.lit(1).alias("agreement")))


@query("load_split", RAW + f""" SELECT id, upper(trim(label)) AS label, CASE WHEN {num_sql('num_text')} > 0 THEN {num_sql('num_text')} ELSE 1.0 END AS weight,
 {num_sql('num_text')} AS anchor_x FROM fx_raw WHERE split = 'val'""")
def load_split(spark, sf):
    raw = derived(spark, sf, "fx_raw").withColumns({"sample_weight": F.col("num_text"), "local_x": F.col("num_text"), "local_y": F.col("y").cast("string")})
    return R.load_split(raw, "val").select("id", "label", "weight", "anchor_x")


@query("has_anchor", RAW + f" SELECT CAST(bool_or({num_sql('num_text')} IS NOT NULL) AS INT) AS has_anchor FROM fx_raw")
def has_anchor(spark, sf):
    raw = derived(spark, sf, "fx_raw").select(F.col("num_text").alias("local_x"), F.col("y").cast("string").alias("local_y"))
    return R.has_anchor(raw).select(F.col("has_anchor").cast("int").alias("has_anchor"))


@query("rescale_points", with_fx("fx_truth") + """
SELECT gt_id, CASE WHEN scene_id % 3 = 0 THEN x ELSE x * 768 / 1024 END AS x, CASE WHEN scene_id % 3 = 0 THEN y ELSE y * 768 / 512 END AS y FROM fx_truth""")
def rescale_points(spark, sf):
    t = derived(spark, sf, "fx_truth")
    same = F.col("scene_id") % 3 == 0
    t = t.withColumns({"slot_width": F.when(same, 768).otherwise(1024), "slot_height": F.when(same, 768).otherwise(512)})
    sizes = t.select("scene_id").distinct().withColumns({"width": F.lit(768), "height": F.lit(768)})
    return R.rescale_points(t, sizes, "scene_id").select("gt_id", "x", "y")


@query("patch_key", RAW + """, k AS (SELECT id, stem || '_x' || CAST(n_arms AS STRING) || '_y' || CAST(scene_id % 7 AS STRING) AS b FROM fx_raw),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) - 1 AS n FROM k) SELECT id, b || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.png' AS patch_filename FROM r""")
def patch_key(spark, sf):
    rows = derived(spark, sf, "fx_raw").select("id", "stem", F.col("n_arms").alias("node_x"), (F.col("scene_id") % 7).alias("node_y"))
    return R.patch_key(rows).select("id", "patch_filename")


@query("remap_task", with_fx("fx_truth") + """ SELECT 'gate' AS task, CASE WHEN true_label = 'N' THEN 'N' ELSE 'P' END AS label, count(*) AS n FROM fx_truth GROUP BY 2
UNION ALL SELECT 'type', true_label, count(*) FROM fx_truth WHERE true_label <> 'N' GROUP BY 2""")
def remap_task(spark, sf):
    rows = derived(spark, sf, "fx_truth").select(F.col("true_label").alias("label"))
    parts = [R.remap_task(rows, t).groupBy(F.lit(t).alias("task"), "label").agg(F.count(F.lit(1)).alias("n")) for t in ("gate", "type")]
    return parts[0].unionByName(parts[1])


@query("fill_meta_features", with_fx("fx_rows") + """
SELECT id, coalesce(min_gap_deg, 0) AS min_gap_deg, 'UNK' AS note, CASE WHEN id % 5 = 0 THEN CAST(cnn_pred = 'T' AS INT) ELSE cnn_prob_T END AS cnn_prob_T FROM fx_rows""")
def fill_meta_features(spark, sf):
    rows = derived(spark, sf, "fx_rows").withColumns({"note": F.lit("  "), "cnn_prob_T": F.when(F.col("id") % 5 != 0, F.col("cnn_prob_T"))})
    return R.fill_meta_features(rows, ["min_gap_deg"], ["note"]).select("id", "min_gap_deg", "note", "cnn_prob_T")


@query("detections_to_proposals", RAW + """
SELECT least(x, 767) AS node_x, least(y, 767) AS node_y, 'detector_junction_graph_' || CASE WHEN trim(label) = '' THEN 'UNK' ELSE upper(trim(label)) END AS proposal_type,
 CAST(x < 8 OR y < 8 OR least(x, 767) >= 760 OR least(y, 767) >= 760 AS INT) AS border_flag, count(*) AS n FROM fx_raw WHERE x >= 0 AND y >= 0 GROUP BY ALL""")
def detections_to_proposals(spark, sf):
    d = derived(spark, sf, "fx_raw").select(F.col("scene_id").alias("tile_id"), "x", "y", "label", F.lit(None).cast("string").alias("source_kind"), F.lit(None).cast("double").alias("score"))
    dims = d.select("tile_id").distinct().withColumns({"width": F.lit(768), "height": F.lit(768)})
    return R.detections_to_proposals(d, dims).groupBy("node_x", "node_y", "proposal_type", "border_flag").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_image_names", RAW + """, img AS (SELECT DISTINCT stem || CAST(scene_id % 5 AS STRING) AS s FROM fx_raw),
f AS (SELECT DISTINCT scene_id % 5 AS k, stem FROM fx_raw)
SELECT '/labels/' || stem || CAST(k AS STRING) || '.json' AS file, stem || CAST(k AS STRING) || '.png' AS source_image FROM f""")
def resolve_image_names(spark, sf):
    raw = derived(spark, sf, "fx_raw")
    name = F.concat("stem", (F.col("scene_id") % 5).cast("string"))
    images = raw.select(F.concat(name, F.lit(".png")).alias("source_image")).distinct()
    labels = raw.select(F.concat(F.lit("/labels/"), name, F.lit(".json")).alias("file"), F.lit(None).cast("string").alias("image_path")).distinct()
    return R.resolve_image_names(labels, images)


H = "CAST(('0x' || substr(md5({k} || '|{s}'), 1, 8)) AS BIGINT) / 4294967296.0"


@query("stratified_split", RAW + f""", h AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY {H.format(k='id', s=5)}, id) AS k, count(*) OVER (PARTITION BY split) AS n FROM fx_raw)
SELECT id, CASE WHEN k <= least(greatest(round_even(n * 0.15, 0), 1), n - 1) THEN 'val' ELSE 'train' END AS part FROM h""")
def stratified_split(spark, sf):
    return S.stratified_split(derived(spark, sf, "fx_raw").select("id", "split"), "split", "id", 0.15, seed=5).select("id", "part")


@query("split_by_source", RAW + f""", s AS (SELECT scene_id, row_number() OVER (ORDER BY {H.format(k='scene_id', s=5)}, scene_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT scene_id FROM fx_raw))
SELECT id, CASE WHEN k <= least(greatest(round_even(n * 0.2, 0), 1), n - 1) THEN 'val' ELSE 'train' END AS part FROM fx_raw JOIN s USING (scene_id)""")
def split_by_source(spark, sf):
    return S.split_by_source(derived(spark, sf, "fx_raw").select("id", "scene_id"), "scene_id", 0.2, seed=5).select("id", "part")


@query("balance_weights", RAW + """, a AS (SELECT *, count(*) OVER (PARTITION BY split) AS n1, count(*) OVER (PARTITION BY stem) AS n2 FROM fx_raw)
SELECT id, round(1e6 / n1 / n2, 6) AS weight FROM a""")
def balance_weights(spark, sf):
    out = S.balance_weights(derived(spark, sf, "fx_raw").select("id", "split", "stem"), ["split", "stem"])
    return out.select("id", F.round(F.col("weight") * 1e6, 6).alias("weight"))


@query("weighted_resample", RAW + f""", c AS (SELECT id, sum(CAST(len_a AS BIGINT)) OVER (ORDER BY id) AS upto, CAST(len_a AS BIGINT) AS w FROM fx_raw),
d AS (SELECT i AS draw, {H.format(k='i', s=3)} * (SELECT max(upto) FROM c) AS u FROM range(0, 5000) r(i))
SELECT draw, id FROM d JOIN c ON u >= upto - w AND u < upto""")
def weighted_resample(spark, sf):
    rows = derived(spark, sf, "fx_raw").select("id", F.col("len_a").cast("long").alias("w"))
    return S.weighted_resample(rows, "w", "id", 5000, seed=3).select("draw", "id")


# ---------------------------------------------------------------- classifiers on the embedding rows

CLASSES = ("N", "T", "X", "Y")
N_FEATURES = 64


def _features(spark, sf):
    e = table(spark, sf, "embeddings")
    vec = [c for c, t in e.dtypes if t.startswith("array")][0]
    names = F.array(*[F.lit(c) for c in CLASSES])
    rows = e.select("vec_id", F.get(names, F.pmod(F.col("label"), F.lit(4)).cast("int")).alias("label"), *[F.col(vec)[i].cast("double").alias(f"f{i}") for i in range(N_FEATURES)])
    rows = M.label_index(M.assemble(rows, [f"f{i}" for i in range(N_FEATURES)]), CLASSES)
    return rows.withColumns({"weight": F.lit(1.0), "is_val": F.col("vec_id") % 10 == 0, "is_test": F.col("vec_id") % 10 == 1})


def _score(model, rows, name):
    scored = model.transform(rows.where("is_test"))
    return E.classification_report(scored.select(F.col("label").alias("true_label"), F.col(f"{name}_pred").alias("pred_label")), CLASSES).withColumn("model", F.lit(name))


def _fit(name, rows):
    train = rows.where("NOT is_val AND NOT is_test")
    if name == "rf":
        return M.train_rf(train, CLASSES, trees=20, depth=6)
    if name == "xgb":
        return M.train_boosted(rows.where("NOT is_test"), CLASSES, "is_val", rounds=5, depth=3)
    if name == "svm":
        return M.train_svm(train, CLASSES, "vec_id", folds=3, iters=10)
    return M.train_mlp(train, CLASSES, N_FEATURES, (32, 16), iters=30)


for _name in ("rf", "xgb", "svm", "mlp"):
    def _run(spark, sf, name=_name):
        rows = _features(spark, sf).cache()
        return _score(_fit(name, rows), rows, name)

    query(f"train_{_name}")(_run)


@query("stack")
def stack(spark, sf):
    """Two base models on half of the training rows, a meta model on the other half, scored on the test rows."""
    rows = _features(spark, sf).cache()
    feats = [f"f{i}" for i in range(8)]
    first, second = rows.where("vec_id % 2 = 0 AND NOT is_test"), rows.where("vec_id % 2 = 1 AND NOT is_test")
    base = [M.train_rf(first, CLASSES, trees=10, depth=5), M.train_boosted(first, CLASSES, "is_val", rounds=3, depth=3)]
    held = second.withColumn("is_val", F.col("vec_id") % 7 == 0)
    meta = M.stack_train(held, base, CLASSES, feats, "is_val", rounds=3)
    return M.stack_score(rows.where("is_test"), base, meta, feats).select("vec_id", "label", "confidence", *[f"meta_prob_{c}" for c in CLASSES])


@query("cascade")
def cascade(spark, sf):
    """A gate model (N or not) times a type model."""
    rows = _features(spark, sf).drop("label_idx").cache()
    train = rows.where("NOT is_test")
    gate = M.train_rf(M.label_index(R.remap_task(train, "gate"), ("N", "P")), ("N", "P"), trees=10, depth=5)
    kind = M.train_rf(M.label_index(R.remap_task(train, "type"), ("T", "X", "Y")), ("T", "X", "Y"), trees=10, depth=5)
    out = M.cascade_score(rows.where("is_test"), gate, replace(kind, name="type"))
    return out.select("vec_id", *[f"cascade_prob_{c}" for c in CLASSES])
