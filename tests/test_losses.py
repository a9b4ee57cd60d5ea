"""Nothing is lost or changed without a word: images, blocks, matches, searches, proposals, spurs."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import components as C
from lineweave.operators import fusion, paths, segmentation, spatial
from lineweave.operators.metrics import POISSON_1
from lineweave.sources import rasters
from lineweave.sources import readers as R


def png(values, bits=8, colour=0, kinds=(0,)):
    """Rows of samples as a PNG; ``kinds`` are the row filters, used in turn."""
    def chunk(tag, data):
        body = tag + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    a = np.asarray(values, ">u2" if bits == 16 else "u1")
    h, w = a.shape[:2]
    step = (a.shape[2] if a.ndim == 3 else 1) * bits // 8
    rows = np.frombuffer(a.tobytes(), np.uint8).reshape(h, -1).astype(int)
    raw = b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        row, up = rows[y], rows[y - 1] if y else np.zeros_like(rows[0])
        left = np.concatenate([np.zeros(step, int), row[:-step]])
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        near = left + up - corner
        far = np.abs(np.stack([near - left, near - up, near - corner]))
        best = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        guess = [0 * row, left, up, (left + up) // 2, best][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)
    return rasters.PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(values):
    a = np.asarray(values, "<u2")
    tags = [(256, 3, a.shape[1]), (257, 3, a.shape[0]), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, a.shape[0]), (279, 4, a.nbytes)]
    body = a.tobytes()
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4


def test_colour_and_deep_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    colour, deep = rng.integers(0, 256, (6, 5, 3)), rng.integers(0, 60000, (7, 4))
    (tmp_path / "rgb.png").write_bytes(png(colour, colour=2, kinds=(0, 1, 2, 3, 4)))
    (tmp_path / "rgba.png").write_bytes(png(np.dstack([colour, colour[..., :1]]), colour=6, kinds=(4, 3, 1)))
    (tmp_path / "deep.png").write_bytes(png(deep, bits=16, kinds=(4, 2, 1, 3)))
    (tmp_path / "deep2.tif").write_bytes(tiff(deep))
    got = {}
    for r in R.read_pixels(spark, str(tmp_path)).collect():
        got.setdefault(r["tile_id"], {})[r["y"], r["x"]] = r["v"]
    want = (19595 * colour[..., 0] + 38470 * colour[..., 1] + 7471 * colour[..., 2] + 32768) >> 16
    for name, a in (("rgb", want), ("rgba", want), ("deep", deep), ("deep2", deep)):
        assert got[name] == {(y, x): int(a[y, x]) for y in range(a.shape[0]) for x in range(a.shape[1])}, name
    assert R.read_pixels(spark, str(tmp_path), threshold=30000).count() == 2 * (deep > 30000).sum()


def test_broken_images_are_errors(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[1, 2], [3, 4]])[:-30])
    with pytest.raises(Exception, match="cannot read image"):
        R.read_pixels(spark, str(tmp_path)).collect()


def test_files_without_rows_are_listed(spark, tmp_path):
    for name, text in {"a": json.dumps({"detections": [{"type": "T", "x": 1, "y": 2}]}), "b_predictions": '{"detections": []}', "c": '{"detections": [', "d": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(tuple(r) for r in R.detection_files(spark, str(tmp_path)).collect()) == [("a", 1, False), ("b", 0, False), ("c", 0, True), ("d", 0, True)]


def test_two_rows_of_settings_are_an_error(spark):
    with pytest.raises(ValueError, match="more than one row"):
        R.resolve_config({}, spark.range(2).withColumnRenamed("id", "radius"), {"radius": 3})


def lines(side, seed, n):
    """A sparse network of straight and bent lines."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        y, x, dy, dx = rng.randrange(side), rng.randrange(side), rng.choice([-1, 0, 1]), rng.choice([-1, 1])
        for _ in range(rng.randrange(5, side)):
            out.add((y, x))
            if rng.random() < 0.05:
                dy = rng.choice([-1, 0, 1])
            y, x = y + dy, x + dx
            if not (0 <= y < side and 0 <= x < side):
                break
        for _ in range(3):
            y, x = rng.choice(sorted(out))
            for k in range(rng.randrange(1, 16)):
                out.add((y + k, x + 1 + k % 2))
    return out


def frame(spark, tiles):
    return spark.createDataFrame([(t, y, x) for t, px in tiles.items() for y, x in px], "tile_id string, y int, x int")


def pruned(px, min_len, passes):
    """One end after the other, in row order, on the whole tile."""
    px = set(px)

    def near(p):
        return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in px]

    for _ in range(passes):
        size = len(px)
        for end in sorted(p for p in px if len(near(p)) == 1):
            walked, last, at, kept = [], None, end, True
            while end in px and len(walked) < min_len - 1:
                nxt = [q for q in near(at) if q != last]
                if len(nxt) != 1:
                    break
                walked.append(at)
                last, at = at, nxt[0]
                if len(near(at)) != 2:
                    kept = len(near(at)) < 2
                    break
            if not kept:
                px -= set(walked)
        if len(px) == size:
            break
    return px


@pytest.mark.parametrize("min_len", [4, 12])
def test_spurs_over_many_blocks(spark, monkeypatch, min_len):
    monkeypatch.setattr(paths, "BLOCK", 32)
    rng = random.Random(3)
    tiles = {"lines": lines(260, 1, 14), "noise": {(rng.randrange(150), rng.randrange(150)) for _ in range(3000)}}
    got = {}
    for r in paths.prune_spurs(frame(spark, tiles), min_len).collect():
        got.setdefault(r["tile_id"], set()).add((r["y"], r["x"]))
    for t, px in tiles.items():
        assert got[t] == pruned(px, min_len, 8), t


def test_thin_is_the_same_for_wide_halos(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK", 48)
    thick = {(y + a, x + b) for y, x in lines(160, 5, 6) for a in range(3) for b in range(3)}
    px = frame(spark, {"t": thick}).cache()
    results = [{(r["y"], r["x"]) for r in paths.thin(px, rounds=n).collect()} for n in (2, 16, 40)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 100


def test_a_template_wider_than_half_a_block(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK", 64)
    rng = np.random.default_rng(2)
    art = (rng.random((51, 51)) < 0.3) * 255.0
    spots = [(3, 5), (70, 60), (130, 140)]
    px = {(y + int(a), x + int(b)) for y, x in spots for a, b in zip(*np.nonzero(art), strict=True)}
    got = {(r["y"], r["x"]) for r in fusion.template_scan(frame(spark, {"t": px}), [("a", art)], 0.99).collect()}
    assert got == {(y + 25, x + 25) for y, x in spots}


def test_wide_images_keep_their_rows_apart(spark):
    far = (1 << 20) + 5
    got = C.components(frame(spark, {"t": {(0, far), (1, 5), (1, 6)}})).collect()
    assert len({r["comp_id"] for r in got}) == 2


def test_matching_of_hashed_ids_at_one_place(spark):
    truth = spark.range(300).select(F.lit(1).alias("s"), F.xxhash64("id").alias("gt_id"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))
    preds = spark.range(200).select(F.lit(1).alias("s"), F.xxhash64(F.lit(9), "id").alias("id"), F.lit(6.0).alias("x"), F.lit(5.0).alias("y"))
    got = spatial.greedy_match(truth, preds, 3.0, ["s"]).collect()
    g = sorted(r["gt_id"] for r in truth.collect())[:200]
    p = sorted(r["id"] for r in preds.collect())
    assert sorted((r["gt_id"], r["pred_id"]) for r in got) == sorted(zip(g, p, strict=True))


def test_search_over_many_groups(spark):
    rows = [(f"g{g:02}", "t", 0, x, 0.1 + 0.8 * (x % 2), x % 2, 1) for g in range(12) for x in range(4)]
    df = spark.createDataFrame(rows, "g string, tile_id string, y int, x int, p double, truth int, valid int")
    area = spark.createDataFrame([(0,)], "n long")
    best = segmentation.group_threshold_search(df, "g", (0.5, 0.95), area, tol=0).collect()[0]
    assert best["f1"] == pytest.approx(1.0) and [c["t"] for c in best["choice"]] == [0.5] * 12


def test_exact_copies_are_one_proposal(spark):
    row = ("t", 5, 5, "base_topology", "x", 0.5, 0, 5, 5)
    df = spark.createDataFrame([row, row], "tile_id string, node_x int, node_y int, proposal_source string, proposal_type string, proposal_score double, border_flag int, x int, y int")
    assert paths.merge_by_priority(df, 6.0).count() == 1


def test_poisson_table_goes_on():
    assert POISSON_1[:2] == (0.36787944117, 0.73575888234) and POISSON_1[-1] > 1 - 2.0**-32 and len(POISSON_1) >= 12
