import json
import struct
import zlib

import pytest

from lineweave.sources import readers as R
from lineweave.sources import writers as W


def png(rows):
    def chunk(tag, data):
        body = tag + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_read_pixels(spark, tmp_path):
    rows = [[(7 * y + 31 * x) % 256 for x in range(9)] for y in range(5)]
    (tmp_path / "tile_1.png").write_bytes(png(rows))
    got = {(r["y"], r["x"]): r["v"] for r in R.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(y, x): rows[y][x] for y in range(5) for x in range(9)}
    assert R.read_pixels(spark, str(tmp_path), threshold=100).count() == sum(v > 100 for r in rows for v in r)
    assert [(r["tile_id"], r["width"], r["height"]) for r in R.image_sizes(spark, str(tmp_path)).collect()] == [("tile_1", 9, 5)]
    (tmp_path / "notes.txt").write_text("x")
    assert [r["stem"] for r in R.list_images(spark, str(tmp_path)).collect()] == ["tile_1"]


def test_annotations_take_the_first_usable_place(spark, tmp_path):
    doc = {"imagePath": "a/b.png", "item": {"slots": [{"width": 100, "height": 80}]}, "annotations": [
        {"name": " t ", "bounding_box": {"x": 10, "y": 20, "w": 4, "h": 6}}, {"name": "Y", "keypoint": {"x": 1.5, "y": 2.5}}, {"name": "X", "point": {"x": 3, "y": 4}},
        {"name": "N", "polygon": {"path": [{"x": 8, "y": 9}, {"x": 0, "y": 0}]}}, {"name": "other", "point": {"x": 1, "y": 1}}, {"name": "T"}]}
    (tmp_path / "b__gt_kp.json").write_text(json.dumps(doc))
    got = sorted((r["true_label"], r["x"], r["y"], r["slot_width"]) for r in R.read_annotations(spark, str(tmp_path)).collect())
    assert got == [("N", 8.0, 9.0, 100), ("T", 12.0, 23.0, 100), ("X", 3.0, 4.0, 100), ("Y", 1.5, 2.5, 100)]


def test_detection_files_round_trip(spark, tmp_path):
    (tmp_path / "s1_predictions.json").write_text(json.dumps({"detections": [{"type": "T", "x": 1, "y": 2, "probs": {"T": 0.5}}, {"type": "Y", "x": 3, "y": 4}]}))
    d = R.read_detection_json(spark, str(tmp_path))
    assert sorted((r["stem"], r["label"], r["x"]) for r in d.collect()) == [("s1", "T", 1.0), ("s1", "Y", 3.0)]
    W.write_detections_json(d.drop("probs"), str(tmp_path / "out"), "stem", {"radius": 5})
    back = spark.read.json(str(tmp_path / "out")).collect()[0]
    assert back["counts"].asDict() == {"T": 1, "Y": 1} and len(back["detections"]) == 2


def test_manifest_and_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", "1", "2", " t", "3"), ("a.png", "bad", "2", "Y", "3")], "source_image string, node_x string, node_y string, consensus string, agreement string")
    W.write_predictions(rows, str(tmp_path / "p"))
    back = R.read_predictions(spark, str(tmp_path / "p"))
    assert [(r["consensus"], r["node_x"]) for r in back.collect()] == [("T", 1.0)] and len(back.columns) == 73 - 1
    W.write_manifest(rows, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="missing required columns"):
        R.read_manifest(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="no rows in split"):
        R.load_split(rows.selectExpr("*", "'train' as split", "consensus as label"), "val")


def test_split_file(spark, tmp_path):
    parts = spark.createDataFrame([("a", "train"), ("b", "val")], "key string, part string")
    W.write_split(parts, str(tmp_path / "s"))
    assert R.read_split_file(spark, str(tmp_path / "s"), parts).count() == 2
    with pytest.raises(ValueError, match="1 unknown"):
        R.read_split_file(spark, str(tmp_path / "s"), parts.where("key = 'a'"))


def test_pairs_and_names(spark):
    images = spark.createDataFrame([("/i/A.png", "A.png", "A"), ("/i/b.png", "b.png", "b"), ("/i/c.png", "c.png", "c"), ("/i/b_trace.png", "b_trace.png", "b_trace")], "path string, name string, stem string")
    masks = spark.createDataFrame([("/m/a.png", "a"), ("/m/b_trace.png", "b_trace")], "path string, stem string")
    assert {r["name"]: r["mask_path"] for r in R.pair_files(images, masks).collect()} == {"A.png": "/m/a.png", "b.png": "/m/b_trace.png", "c.png": None}
    files = spark.createDataFrame([("/t/gray_40/V_s20_a30_r5.png", "V_s20_a30_r5"), ("/t/x/Q_s1_a1_r1.png", "Q_s1_a1_r1")], "path string, stem string")
    got = R.parse_template_names(files).collect()
    assert [(r["label"], r["source_type"], r["size"], r["spread"], r["rotation"], r["gray"]) for r in got] == [("T", "V", 20, 30, 5, 40)]


def test_image_names_by_tier(spark):
    labels = spark.createDataFrame([("/l/one.json", "x/exact.png"), ("/l/two.json", None), ("/l/thr.json", None), ("/l/amb.json", None), ("/l/k__gt_kp.json", None)], "file string, image_path string")
    images = spark.createDataFrame([("exact.png",), ("two.jpg",), ("big_thr_1.png",), ("amb_1.png",), ("amb_2.png",), ("k_skel.png",)], "source_image string")
    got = {r["file"]: r["source_image"] for r in R.resolve_image_names(labels, images).collect()}
    assert got == {"/l/one.json": "exact.png", "/l/two.json": "two.jpg", "/l/thr.json": "big_thr_1.png", "/l/k__gt_kp.json": "k_skel.png"}


def test_config(spark):
    config = spark.createDataFrame([(0.4,)], "threshold double")
    row = R.resolve_config({"threshold": "auto", "size": 512}, config, {"threshold": 0.5, "size": 768, "pad": 1}).first()
    assert (row["threshold"], row["size"], row["pad"]) == (0.4, 512, 1)
