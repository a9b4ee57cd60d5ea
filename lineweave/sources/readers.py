"""Readers: images, manifests, predictions, annotation and detection files, names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineweave.functions import scalars as X
from lineweave.schemas import IMAGE_SUFFIXES, PREDICTION_MINIMUM
from lineweave.sources import rasters
from lineweave.session import is_empty, require_columns


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, name, stem, size)`` of the image files of a directory; file contents are never read."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", F.col("length").alias("size"))
    named = files.select("path", file_name(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"), "size")
    if glob:
        return named
    return named.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*IMAGE_SUFFIXES))


OWN_SUFFIXES = ("png", "tif", "tiff")


def _suffix(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def _decoded(spark: SparkSession, path: str, glob: str) -> list[tuple[DataFrame, Callable]]:
    """The image files of a folder by reader: ours for PNG and TIFF, whose 16-bit values it keeps, Spark's for the others."""
    found = {r["s"] for r in list_images(spark, path, glob).select(_suffix(F.col("name")).alias("s")).distinct().collect()} & set(IMAGE_SUFFIXES)
    parts = []
    if found & set(OWN_SUFFIXES):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
        parts.append((files.where(_suffix(F.col("path")).isin(*OWN_SUFFIXES)), lambda r: rasters.decode(r.content)))
    if found - set(OWN_SUFFIXES):
        images = spark.read.format("image").option("pathGlobFilter", glob).load(path).select(F.col("image.origin").alias("path"), "image.*").drop("origin")
        parts.append((images.where(_suffix(F.col("path")).isin(*sorted(found - set(OWN_SUFFIXES)))), _from_image_source))
    return parts


def _from_image_source(r) -> np.ndarray:
    if r.nChannels not in (1, 3, 4):
        raise ValueError("unreadable image")
    pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
    return rasters.gray(pixels if r.nChannels == 1 else pixels[..., 2::-1])        # the source stores blue, green, red


def _per_image(spark: SparkSession, path: str, glob: str, columns: str, rows: Callable[[np.ndarray], dict]) -> DataFrame:
    outs = []
    for files, read in _decoded(spark, path, glob):
        def run(batches, read=read):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    try:
                        values = read(r)
                    except ValueError as why:
                        raise ValueError(f"cannot read image {r.path}: {why}") from why
                    name = r.path.rsplit("/", 1)[-1]
                    yield pd.DataFrame({"tile_id": name.rsplit(".", 1)[0], **rows(values)})

        outs.append(files.mapInPandas(run, f"tile_id string, {columns}"))
    if not outs:
        return spark.createDataFrame([], f"tile_id string, {columns}")
    return reduce(DataFrame.unionByName, outs)


def read_pixels(spark: SparkSession, path: str, threshold: int | None = None, glob: str = "*") -> DataFrame:
    """``(tile_id, y, x, v)`` of every pixel; with ``threshold`` only brighter ones are made into rows.

    Colours become gray values, 16-bit values stay whole, and an image that cannot be read is an error."""
    def rows(values: np.ndarray) -> dict:
        y, x = np.nonzero(values > threshold) if threshold is not None else np.indices(values.shape).reshape(2, -1)
        return {"y": y.astype("int32"), "x": x.astype("int32"), "v": values[y, x].astype("int32")}

    return _per_image(spark, path, glob, "y int, x int, v int", rows)


def image_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return _per_image(spark, path, glob, "width int, height int", lambda v: {"width": [v.shape[1]], "height": [v.shape[0]]})


def read_manifest(spark: SparkSession, path: str, required: Sequence[str] = ("relpath", "label", "split")) -> DataFrame:
    """A CSV with all cells as text; required columns must be there."""
    return require_columns(spark.read.csv(path, header=True, inferSchema=False), required)


def load_split(manifest: DataFrame, split: str, label: str = "label", weight: str = "sample_weight") -> DataFrame:
    """Rows of one split with clean label, weight and anchor; an empty split is an error."""
    rows = manifest.where(F.lower(F.trim("split")) == split)
    if is_empty(rows):
        raise ValueError(f"no rows in split {split}")
    w = X.positive_weight(weight) if weight in manifest.columns else F.lit(1.0)
    return with_anchor(rows).withColumns({label: X.norm_label(label), "weight": w})


def with_anchor(rows: DataFrame) -> DataFrame:
    """``anchor_x, anchor_y``: the local place if both parts are finite numbers, else NULL."""
    if not {"local_x", "local_y"} <= set(rows.columns):
        return rows.withColumns({"anchor_x": F.lit(None).cast("double"), "anchor_y": F.lit(None).cast("double")})
    x, y = X.finite_double("local_x"), X.finite_double("local_y")
    both = x.isNotNull() & y.isNotNull()
    return rows.withColumns({"anchor_x": F.when(both, x), "anchor_y": F.when(both, y)})


def has_anchor(rows: DataFrame) -> DataFrame:
    """One row: does any row carry an anchor?"""
    return with_anchor(rows).agg(F.coalesce(F.bool_or(F.col("anchor_x").isNotNull()), F.lit(False)).alias("has_anchor"))


def clean_predictions(raw: DataFrame) -> DataFrame:
    """Typed prediction rows; ``bad`` marks rows without a usable place or label."""
    require_columns(raw, PREDICTION_MINIMUM)
    out = raw.withColumns({"consensus": X.norm_label("consensus"), **{c: X.finite_double(c) for c in ("node_x", "node_y", "agreement")}})
    return out.withColumn("bad", F.col("node_x").isNull() | F.col("node_y").isNull() | F.col("source_image").isNull() | F.col("consensus").isNull())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return clean_predictions(spark.read.csv(path, header=True, inferSchema=False)).where("NOT bad").drop("bad")


def count_dropped(raw: DataFrame) -> DataFrame:
    return clean_predictions(raw).agg(F.count_if("bad").alias("dropped"), F.count(F.lit(1)).alias("total"))


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in "xywh"])
ANNOTATION = T.StructType([
    T.StructField("imagePath", T.StringType()),
    T.StructField("item", T.StructType([T.StructField("slots", T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])))])),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("bounding_box", _BOX), T.StructField("keypoint", _XY), T.StructField("point", _XY),
        T.StructField("polygon", T.StructType([T.StructField("path", T.ArrayType(_XY))]))])))])


def read_annotations(spark: SparkSession, path: str, classes: Sequence[str] = ("N", "T", "X", "Y")) -> DataFrame:
    """``(file, image_path, slot_width, slot_height, true_label, x, y)``: box centre, else keypoint, point, first polygon vertex."""
    files = spark.read.schema(ANNOTATION).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    rows = files.select("file", F.col("imagePath").alias("image_path"), F.get("item.slots", F.lit(0)).alias("s"), F.explode("annotations").alias("a"))
    box = F.struct((F.col("a.bounding_box.x") + F.col("a.bounding_box.w") / 2.0).alias("x"), (F.col("a.bounding_box.y") + F.col("a.bounding_box.h") / 2.0).alias("y"))
    vertex = F.get("a.polygon.path", F.lit(0))
    spots = [F.when(s["x"].isNotNull() & s["y"].isNotNull(), s) for s in (box, F.col("a.keypoint"), F.col("a.point"), vertex)]
    out = rows.select("file", "image_path", F.col("s.width").alias("slot_width"), F.col("s.height").alias("slot_height"),
                      X.norm_label("a.name").alias("true_label"), F.coalesce(*spots).alias("p"))
    return out.where(F.col("true_label").isin(*classes) & F.col("p").isNotNull()).select("file", "image_path", "slot_width", "slot_height", "true_label", "p.x", "p.y")


def _json_files(spark: SparkSession, path: str, schema: str, size: Column, key: Column) -> DataFrame:
    """One row for each file of a folder, also for empty and malformed ones."""
    # Scans pass over files of no length, so the names come from Spark's own file index.
    names = spark.read.format("binaryFile").load(path).inputFiles()
    one_form = F.regexp_replace("path", "^([a-z]+):/+", "$1:/")
    listed = spark.createDataFrame([(n,) for n in names], "path string").select(one_form.alias("path"))
    parsed = spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True).select(
        F.col("_metadata.file_path").alias("path"), size.alias("n"), F.col("_corrupt_record").isNotNull().alias("bad"))
    parsed = parsed.withColumn("path", one_form)
    out = listed.join(parsed.groupBy("path").agg(F.sum("n").alias("n"), F.max("bad").alias("bad")), "path", "left")
    return out.select(key.alias("file"), F.coalesce("n", F.lit(0)).cast("int").alias("n_rows"), F.coalesce("bad", F.lit(True)).alias("corrupt"))


def annotation_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n_rows, corrupt)``: an image without annotations is there with 0 rows; an empty or broken file is corrupt."""
    return _json_files(spark, path, "annotations array<string>", F.greatest(F.size(F.coalesce("annotations", F.array())), F.lit(0)), F.col("path"))


def detection_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n_rows, corrupt)`` by stem, like ``read_detection_json``, with the files that hold no detection."""
    return _json_files(spark, path, "detections array<string>", F.greatest(F.size(F.coalesce("detections", F.array())), F.lit(0)),
                       F.regexp_replace(stem(F.col("path")), "_predictions$", ""))


def read_detection_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``{"detections": [...]}`` files keyed by file stem (without ``_predictions``)."""
    schema = "detections array<struct<type string, x double, y double, probs map<string, double>>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    key = F.regexp_replace(stem(F.col("_metadata.file_path")), "_predictions$", "")
    return files.select(key.alias("stem"), F.explode("detections").alias("d")).select("stem", F.col("d.type").alias("label"), "d.x", "d.y", "d.probs")


def pair_files(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Each image with its mask: same lower-case stem, else stem + ``_trace``; ``mask_path`` is NULL where there is none."""
    m = masks.groupBy(F.lower("stem").alias("k")).agg(F.min("path").alias("mask_path"))
    asked = images.where(~F.lower("name").contains("_trace")).select(
        "path", "name", F.posexplode(F.array(F.lower("stem"), F.concat(F.lower("stem"), F.lit("_trace")))).alias("rank", "k"))
    best = asked.join(m, "k", "left").groupBy("path", "name").agg(F.min(F.when(F.col("mask_path").isNotNull(), F.struct("rank", "mask_path"))).alias("b"))
    return best.select(F.col("path").alias("image_path"), "name", F.col("b.mask_path").alias("mask_path"))


TEMPLATE_NAME = r"^([A-Za-z]+)_s(\d+)_a(\d+)_r(\d+)$"      # fixed value: type, size, spread, rotation


def parse_template_names(files: DataFrame, pattern: str = TEMPLATE_NAME, allowed: Sequence[str] = ("T", "Y", "X"), legacy_v: bool = True) -> DataFrame:
    """``(label, source_type, size, spread, rotation, gray, path)`` from file names; ``pattern`` has four groups."""
    raw = F.upper(F.regexp_extract("stem", pattern, 1))
    parent = F.element_at(F.split("path", "/"), -2)
    gray = F.coalesce(F.when(parent.startswith("gray_"), F.regexp_extract(parent, r"^gray_(\d+)$", 1).try_cast("int")), F.lit(0))
    named = files.withColumn("source_type", raw).where("source_type <> ''").withColumn(
        "label", F.when(F.lit(legacy_v) & (F.col("source_type") == "V"), "T").otherwise(F.col("source_type")))
    return named.where(F.col("label").isin(*allowed)).select(
        "label", "source_type", *[F.regexp_extract("stem", pattern, i).cast("int").alias(n) for i, n in ((2, "size"), (3, "spread"), (4, "rotation"))],
        gray.alias("gray"), "path")


def resolve_config(args: dict, config: DataFrame, defaults: dict) -> DataFrame:
    """One row of settings: the argument, unless it is ``"auto"``; then the value of the config file; then the default."""
    def cell(name: str) -> Column:
        given = args.get(name, "auto")
        if given != "auto":
            return F.lit(given)
        saved = F.col(name) if name in config.columns else F.lit(None)
        return F.coalesce(saved, F.lit(defaults[name]))

    if len(config.limit(2).collect()) > 1:
        raise ValueError("more than one row of settings")
    return config.select(*[cell(n).alias(n) for n in defaults])


def read_split_file(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``(key, part)`` of a saved split; an error names how many of its keys are unknown."""
    saved = spark.read.schema("key string, part string").json(path)
    missing = saved.join(keys.select("key"), "key", "left_anti").count()
    if missing:
        raise ValueError(f"split file names {missing} unknown keys")
    return saved


def unexpected_labels(rows: DataFrame, expected: Sequence[str], label: str = "label") -> DataFrame:
    return rows.select(label).distinct().where(~F.col(label).isin(*expected))


# ---------------------------------------------------------------- which image does a label file belong to

def candidate_names(path: Column, image_path: Column) -> Column:
    """Possible image names of a label file, best first, without repeats."""
    base, given = stem(path), F.when(F.length(F.trim(image_path)) > 0, image_path)
    names = F.array(
        file_name(given), F.concat(stem(given), F.lit(".png")), F.concat(base, F.lit(".png")),
        F.when(base.endswith("__gt_kp"), F.concat(F.replace(base, F.lit("__gt_kp"), F.lit("_skel")), F.lit(".png"))),
        F.when(base.endswith("_gt"), F.concat(F.regexp_replace(base, "_gt$", ""), F.lit(".png"))))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull()))


def resolve_image_names(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``(file, source_image)``: exact name, else the only image of that stem, else the only image whose stem contains it.

    ``labels(file, image_path)``, ``images(source_image)``. The containment tier runs only on files that the
    equi-joins left open, and joins on substrings of the asked lengths instead of pairing all files with all images."""
    asked = labels.select("file", F.posexplode(candidate_names(F.col("file"), F.col("image_path"))).alias("rank", "name"))
    asked = asked.withColumn("s", stem(F.col("name")))
    pool = images.select("source_image").distinct().withColumn("s", stem(F.col("source_image")))
    exact = asked.join(pool.select(F.col("source_image").alias("name"), F.col("source_image")), "name").select("file", F.lit(0).alias("tier"), "rank", "source_image")
    single = pool.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("source_image").alias("source_image")).where("n = 1")
    by_stem = asked.join(single, "s").select("file", F.lit(1).alias("tier"), "rank", "source_image")
    close = exact.unionByName(by_stem)
    open_ = asked.join(close.select("file").distinct(), "file", "left_anti")
    # A stem contains s iff it holds s at some offset: explode the pool's substrings of the asked lengths and equi-join.
    lengths = open_.agg(F.coalesce(F.collect_set(F.length("s")), F.array().cast("array<int>")).alias("ls"))
    parts = pool.select("source_image", "s", F.lit(1).alias("_k")).join(lengths.withColumn("_k", F.lit(1)), "_k").select(
        "source_image", "s", F.explode("ls").alias("l")).where("l > 0 AND l <= length(s)").select(
        "source_image", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - F.col("l") + 1), lambda i: F.substring("s", i, F.col("l"))))).alias("s"))
    found = open_.join(parts, "s").groupBy("file", "rank").agg(F.countDistinct("source_image").alias("n"), F.min("source_image").alias("source_image")).where("n = 1")
    every = close.unionByName(found.select("file", F.lit(2).alias("tier"), "rank", "source_image"))
    return every.groupBy("file").agg(F.min(F.struct("tier", "rank", "source_image")).alias("b")).select("file", F.col("b.source_image").alias("source_image"))


def rescale_points(points: DataFrame, sizes: DataFrame, by: str = "source_image") -> DataFrame:
    """Scale label coordinates from the label canvas (``slot_width, slot_height``) to the image size where the two differ."""
    j = points.join(sizes.select(by, "width", "height"), by, "left")
    off = (F.col("slot_width") > 0) & (F.col("slot_height") > 0) & ((F.col("slot_width") != F.col("width")) | (F.col("slot_height") != F.col("height")))
    return j.withColumns({"x": F.when(off, F.col("x") * F.try_divide("width", "slot_width")).otherwise(F.col("x")),
                          "y": F.when(off, F.col("y") * F.try_divide("height", "slot_height")).otherwise(F.col("y"))}).drop("width", "height")


def patch_key(rows: DataFrame, stem_col: str = "stem", x: str = "node_x", y: str = "node_y", order: str = "id") -> DataFrame:
    """Adds ``patch_filename``; repeats of a name get ``_1``, ``_2`` ... in id order."""
    from lineweave.operators.ranks import running_total

    base = F.format_string("%s_x%d_y%d", F.col(stem_col), F.col(x), F.col(y))
    numbered = running_total(rows.withColumns({"_base": base, "_one": F.lit(1).cast("bigint")}), "_one", [order], ["_base"])
    suffix = F.when(F.col("before") > 0, F.concat(F.lit("_"), F.col("before").cast("string"))).otherwise("")
    return numbered.withColumn("patch_filename", F.concat("_base", suffix, F.lit(".png"))).drop("_base", "_one", "before", "upto")


# ---------------------------------------------------------------- task labels and meta columns

def remap_task(rows: DataFrame, task: str, label: str = "label") -> DataFrame:
    """``multiclass`` keeps labels, ``gate`` maps every non-N class to P, ``type`` drops N."""
    if task == "multiclass":
        return rows
    if task == "gate":
        return rows.withColumn(label, F.when(F.col(label) == "N", "N").otherwise("P"))
    if task == "type":
        return rows.where(F.col(label) != "N")
    raise ValueError(f"unsupported task: {task}")


def fill_meta_features(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], heads: Sequence[str] = ("cnn", "mlp", "svm", "xgb"),
                       classes: Sequence[str] = ("N", "T", "X", "Y")) -> DataFrame:
    """Defaults for the meta model: 0 for numbers, UNK for words, and 1 for the predicted class where a probability is missing."""
    probs = {f"{h}_prob_{c}": F.coalesce(X.finite_double(f"{h}_prob_{c}"), (F.coalesce(F.col(f"{h}_pred"), F.lit("UNK")) == c).cast("double")) for h in heads for c in classes}
    return rows.withColumns({**{c: X.safe_double(c) for c in numeric}, **{c: X.str_default(c) for c in categorical}, **probs})


def detections_to_proposals(dets: DataFrame, dims: DataFrame, margin: int = 8, key: str = "tile_id") -> DataFrame:
    """Detections as proposal rows: negative places dropped, the others clipped; type ``detector_junction_{source}_{label}``."""
    d = dets.where("x >= 0 AND y >= 0").join(dims, key)
    size = {"x": F.col("width"), "y": F.col("height")}
    placed = d.withColumns({f"node_{c}": F.least(F.floor(F.col(c)).cast("int"), size[c] - 1) for c in "xy"})
    kind = F.format_string("detector_junction_%s_%s", F.lower(F.trim(F.coalesce("source_kind", F.lit("graph")))), X.str_default(F.upper(F.trim("label"))))
    return placed.select(key, "node_x", "node_y", F.lit("base_topology").alias("proposal_source"), kind.alias("proposal_type"),
                         F.coalesce("score", F.lit(1.0)).alias("proposal_score"),
                         X.border_flag("node_x", "node_y", "width", "height", margin).cast("int").alias("border_flag"))
