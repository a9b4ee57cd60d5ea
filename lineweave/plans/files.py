"""Queries that write derived rows through a sink and read them back, and queries on file names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lineweave.plans.catalog import query
from lineweave.plans.derived import TILE_SIDE, derived, with_fx
from lineweave.session import checkpoint_root
from lineweave.sources import readers as R
from lineweave.sources import writers as W


def _folder(spark) -> str:
    """A new folder that every executor reaches."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _write_each(docs, to) -> None:
    """One file for each row, all in one folder: a folder for each file must be made, moved and listed too."""
    docs.write.option("maxRecordsPerFile", 1).json(to)


def _manifest_rows(spark, sf):
    return derived(spark, sf, "fx_rows").select(
        F.concat(F.lit("p"), F.col("id"), F.lit(".png")).alias("patch_filename"), F.concat(F.lit("s"), F.col("scene_id")).alias("source_image"),
        F.col("x").alias("node_x"), F.col("y").alias("node_y"), "proposal_source", "proposal_type", F.col("border_flag").cast("int").alias("border_flag"),
        F.col("cnn_pred").alias("consensus"), "agreement")


NAMED = "'p' || id || '.png' AS patch_filename, 's' || scene_id AS source_image"


@query("manifest_file", with_fx("fx_rows") + f""" SELECT {NAMED}, CAST(x AS VARCHAR) AS node_x, CAST(y AS VARCHAR) AS node_y, proposal_source, proposal_type,
  CAST(CAST(border_flag AS INT) AS VARCHAR) AS border_flag FROM fx_rows""")
def manifest_file(spark, sf):
    to = _folder(spark)
    W.write_manifest(_manifest_rows(spark, sf), to)
    back = R.read_manifest(spark, to, ("patch_filename", "source_image"))
    return back.select("patch_filename", "source_image", "node_x", "node_y", "proposal_source", "proposal_type", "border_flag")


@query("predictions_file", with_fx("fx_rows") + """ SELECT 's' || scene_id AS source_image, CAST(x AS DOUBLE) AS node_x, CAST(y AS DOUBLE) AS node_y, cnn_pred AS consensus,
  CAST(agreement AS DOUBLE) AS agreement FROM fx_rows""")
def predictions_file(spark, sf):
    to = _folder(spark)
    W.write_predictions(_manifest_rows(spark, sf), to)
    return R.read_predictions(spark, to).select("source_image", "node_x", "node_y", "consensus", "agreement")


@query("detection_documents", with_fx("fx_detections") + """ SELECT 's' || scene_id AS stem, CAST(count(*) AS INT) AS n, CAST(sum(x) AS BIGINT) AS sum_x,
  count(*) FILTER (WHERE cnn_pred = 'T') AS n_t, count(*) FILTER (WHERE cnn_pred = 'N') AS n_n FROM fx_detections GROUP BY scene_id""")
def detection_documents(spark, sf):
    to = _folder(spark)
    d = derived(spark, sf, "fx_detections").select(F.concat(F.lit("s"), F.col("scene_id")).alias("stem"), F.col("cnn_pred").alias("label"), "x", "y")
    W.write_detections_json(d, to, "stem", {"radius": 5})
    back = spark.read.schema("stem string, counts map<string, bigint>, detections array<struct<label string, x double, y double>>").json(to)
    total = F.aggregate("detections", F.lit(0.0), lambda t, p: t + p["x"]).cast("bigint")
    return back.select("stem", F.size("detections").alias("n"), total.alias("sum_x"), *[F.coalesce(F.col("counts")[k], F.lit(0)).alias(f"n_{k.lower()}") for k in "TN"])


@query("detection_json", with_fx("fx_detections") + " SELECT cnn_pred AS label, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, score AS prob FROM fx_detections")
def detection_json(spark, sf):
    """One file for each scene, read by the detection reader."""
    to = _folder(spark)
    item = F.struct(F.col("cnn_pred").alias("type"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.create_map(F.col("cnn_pred"), "score").alias("probs"))
    _write_each(derived(spark, sf, "fx_detections").groupBy("scene_id").agg(F.collect_list(item).alias("detections")).select("detections"), to)
    return R.read_detection_json(spark, to).select("label", "x", "y", F.col("probs")[F.col("label")].alias("prob"))


@query("annotation_json", with_fx("fx_truth") + """ SELECT 'a/s' || scene_id || '.png' AS image_path, 768 AS slot_width, true_label,
  CAST(x AS DOUBLE) + CASE WHEN gt_id % 2 = 0 THEN 2.0 ELSE 0.0 END AS x, CAST(y AS DOUBLE) + CASE WHEN gt_id % 2 = 0 THEN 3.0 ELSE 0.0 END AS y FROM fx_truth""")
def annotation_json(spark, sf):
    """Boxes and keypoints in turn; one file for each scene."""
    to = _folder(spark)
    x, y, even = F.col("x").cast("double"), F.col("y").cast("double"), F.col("gt_id") % 2 == 0
    box = F.when(even, F.struct(x.alias("x"), y.alias("y"), F.lit(4.0).alias("w"), F.lit(6.0).alias("h")))
    item = F.struct(F.col("true_label").alias("name"), box.alias("bounding_box"), F.when(~even, F.struct(x.alias("x"), y.alias("y"))).alias("keypoint"))
    slots = F.struct(F.array(F.struct(F.lit(768).alias("width"), F.lit(768).alias("height"))).alias("slots"))
    docs = derived(spark, sf, "fx_truth").groupBy("scene_id").agg(F.collect_list(item).alias("annotations"))
    _write_each(docs.select(F.concat(F.lit("a/s"), F.col("scene_id"), F.lit(".png")).alias("imagePath"), slots.alias("item"), "annotations"), to)
    return R.read_annotations(spark, to).select("image_path", "slot_width", "true_label", "x", "y")


@query("split_file", with_fx("fx_raw") + " SELECT CAST(id AS VARCHAR) AS key, split AS part FROM fx_raw")
def split_file(spark, sf):
    to = _folder(spark)
    parts = derived(spark, sf, "fx_raw").select(F.col("id").cast("string").alias("key"), F.col("split").alias("part"))
    W.write_split(parts, to)
    return R.read_split_file(spark, to, parts)


@query("tile_metadata_file", with_fx("fx_pixels") + f""" SELECT 't' || tile_id || '_x0_y0' AS key, CAST(tile_id % 3 AS INT) AS parent_id, '{TILE_SIDE}' AS width,
  CAST(count(*) AS VARCHAR) AS x1 FROM fx_pixels GROUP BY tile_id""")
def tile_metadata_file(spark, sf):
    to = _folder(spark)
    tiles = derived(spark, sf, "fx_pixels").groupBy("tile_id").agg(F.count(F.lit(1)).alias("x1")).select(
        F.concat(F.lit("t"), F.col("tile_id"), F.lit("_x0_y0")).alias("key"), (F.col("tile_id") % 3).cast("int").alias("parent_id"), F.lit(TILE_SIDE).alias("width"), "x1")
    W.write_tile_metadata(tiles, to)
    return spark.read.csv(to, header=True, inferSchema=False).select("key", F.col("parent_id").cast("int").alias("parent_id"), "width", "x1")


@query("match_details_file", with_fx("fx_truth") + """ SELECT 's' || scene_id AS source_image, true_label, CASE WHEN gt_id % 4 = 0 THEN 'missed' ELSE 'matched' END AS status,
  CAST(x AS VARCHAR) AS gt_x, CAST(y AS VARCHAR) AS gt_y FROM fx_truth""")
def match_details_file(spark, sf):
    to = _folder(spark)
    rows = derived(spark, sf, "fx_truth").select(
        F.concat(F.lit("s"), F.col("scene_id")).alias("source_image"), "true_label", F.when(F.col("gt_id") % 4 == 0, "missed").otherwise("matched").alias("status"),
        F.col("x").alias("gt_x"), F.col("y").alias("gt_y"))
    W.write_match_details(rows, to)
    return spark.read.csv(to, header=True, inferSchema=False).select("source_image", "true_label", "status", "gt_x", "gt_y")


@query("pair_files", with_fx("fx_raw") + """ SELECT '/i/N' || id || '.png' AS image_path, 'N' || id || '.png' AS name,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN '/m/n' || id || '.png' ELSE '/m/n' || id || '_trace.png' END AS mask_path FROM fx_raw""")
def pair_files(spark, sf):
    raw = derived(spark, sf, "fx_raw").select("id")
    images = raw.select(F.expr("'/i/N' || id || '.png' AS path"), F.expr("'N' || id || '.png' AS name"), F.expr("'N' || id AS stem"))
    masks = raw.where("id % 5 > 0").withColumn("stem", F.expr("'n' || id || CASE WHEN id % 5 < 3 THEN '' ELSE '_trace' END"))
    return R.pair_files(images, masks.select("stem", F.expr("'/m/' || stem || '.png' AS path")))


@query("template_names", with_fx("fx_detections") + """ SELECT label, source_type, CAST(20 + id % 7 AS INT) AS size, CAST(id % 90 AS INT) AS spread, CAST(id % 360 AS INT) AS rotation,
  CASE WHEN id % 3 = 0 THEN CAST(id % 255 AS INT) ELSE 0 END AS gray FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'Y' WHEN 2 THEN 'X' ELSE 'T' END AS source_type,
  CASE id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'Y' WHEN 2 THEN 'X' ELSE 'T' END AS label FROM fx_detections WHERE id % 11 > 0)""")
def template_names(spark, sf):
    kind = "CASE WHEN id % 11 = 0 THEN 'Q' ELSE CASE id % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'Y' WHEN 2 THEN 'X' ELSE 'T' END END"
    files = derived(spark, sf, "fx_detections").select("id", F.expr(f"{kind} || '_s' || (20 + id % 7) || '_a' || (id % 90) || '_r' || (id % 360) AS stem")).select(
        "stem", F.expr("'/t/' || CASE WHEN id % 3 = 0 THEN 'gray_' || (id % 255) ELSE 'plain' END || '/' || stem || '.png' AS path"))
    return R.parse_template_names(files).drop("path")


@query("resolved_config", with_fx("fx_detections") + " SELECT max(score) AS threshold, 512 AS size, 1 AS pad FROM fx_detections")
def resolved_config(spark, sf):
    saved = derived(spark, sf, "fx_detections").agg(F.max("score").alias("threshold"))
    return R.resolve_config({"threshold": "auto", "size": 512}, saved, {"threshold": 0.5, "size": 768, "pad": 1})


@query("unexpected_labels", with_fx("fx_raw") + " SELECT DISTINCT upper(trim(label)) AS label FROM fx_raw WHERE upper(trim(label)) NOT IN ('T', 'Y')")
def unexpected_labels(spark, sf):
    return R.unexpected_labels(derived(spark, sf, "fx_raw").select(F.upper(F.trim("label")).alias("label")), ("T", "Y"))
