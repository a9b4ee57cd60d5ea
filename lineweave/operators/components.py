"""Connected pixel groups, and the operators built on them.

Pixels are labelled inside blocks of fixed size first (a block never exceeds BLOCK x BLOCK pixels, however
large the image); only label pairs that meet at block edges go through the distributed graph step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.operators import graph
from lineweave.operators import pixels as P
from lineweave.session import cut, is_empty, shuffled

BLOCK = 256


def label_pixels(y: np.ndarray, x: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Least row-major position of each pixel's group inside one block."""
    at = y.astype(np.int64) * P.PITCH + x
    order = np.argsort(at, kind="stable")
    s = at[order]
    steps = (1, P.PITCH - 1, P.PITCH, P.PITCH + 1) if diagonal else (1, P.PITCH)
    heads, tails = [], []
    for step in steps:
        pos = np.searchsorted(s, s + step)
        ok = (pos < len(s)) & (s[np.minimum(pos, len(s) - 1)] == s + step)
        heads.append(np.flatnonzero(ok))
        tails.append(pos[ok])
    out = np.empty(len(s), dtype=np.int64)
    out[order] = s[_roots(len(s), np.concatenate(heads), np.concatenate(tails))]
    return out


def _label_gaps(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The same for row gaps of one block; gaps of adjacent rows are linked where they share a column."""
    at = y.astype(np.int64) * P.PITCH + lo
    order = np.argsort(at, kind="stable")
    s, ys, los, his = at[order], y[order], lo[order], hi[order]
    heads, tails = [], []
    for dy in (-1, 1):
        pos = np.searchsorted(s, s + dy * P.PITCH, side="right") - 1
        near = np.maximum(pos, 0)
        ok = (pos >= 0) & (ys[near] == ys + dy) & (his[near] >= los)
        heads.append(np.flatnonzero(ok))
        tails.append(pos[ok])
    out = np.empty(len(s), dtype=np.int64)
    out[order] = s[_roots(len(s), np.concatenate(heads), np.concatenate(tails))]
    return out


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least index of each node's group, by hooking larger roots to smaller ones and jumping pointers."""
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        live = ru != rv
        u, v, ru, rv = u[live], v[live], ru[live], rv[live]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _block_number(batch: pa.RecordBatch, key: str) -> np.ndarray:
    """0, 1, ... for each run of rows of one block; a null key is a key."""
    codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    parts = [codes, *[batch.column(c).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) for c in ("_by", "_bx")]]
    fresh = np.zeros(len(codes), dtype=np.int64)
    for part in parts:
        fresh[1:] |= part[1:] != part[:-1]
    return fresh.cumsum()


def _same_block(a: pa.RecordBatch, b: pa.RecordBatch, key: str) -> bool:
    """Whether the last row of one batch and the first of the next lie in one block."""
    return all(a.column(c)[-1].as_py() == b.column(c)[0].as_py() for c in (key, "_by", "_bx"))


def _labelled(batches: list[pa.RecordBatch], key: str, diagonal: bool) -> Iterator[pa.RecordBatch]:
    """Label many blocks in one go: each is moved to rows of its own, out of reach of the next.

    A null row counts as row 0 of a block of its own; all pixels without a column share the least label there is."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    if not whole.num_rows:
        return
    block = _block_number(whole.to_batches()[0], key)
    y, x, by, bx = (whole.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("y", "x", "_by", "_bx"))
    up, left = by * BLOCK - block * (BLOCK + 4), bx * BLOCK
    lab = label_pixels(y - up, x - left, diagonal)
    lab = (lab // P.PITCH + up) * P.PITCH + lab % P.PITCH + left
    lab[whole.column("x").is_null().to_numpy()] = np.iinfo(np.int64).min
    yield from whole.select([key, "y", "x"]).append_column("lab", pa.array(lab)).to_batches()


def components(px: DataFrame, diagonal: bool = True, key: str = "tile_id") -> DataFrame:
    """Adds ``comp_id``: the row-major position of the first pixel of the group (8- or 4-connected)."""
    blocks = px.select(key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.floor(F.col("y") / BLOCK).alias("_by"), F.floor(F.col("x") / BLOCK).alias("_bx"))
    kind = px.schema[key].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks come one after another; the last one of a batch may go on in the next.
        waiting = []
        for batch in batches:
            block = _block_number(batch, key)
            last = int(np.searchsorted(block, block[-1])) if len(block) else 0
            if waiting and len(block) and (last > 0 or not _same_block(waiting[-1], batch, key)):
                first = 0 if not _same_block(waiting[-1], batch, key) else int(np.searchsorted(block, block[0], "right"))
                yield from _labelled([*waiting, batch.slice(0, first)], key, diagonal)
                if last > first:
                    yield from _labelled([batch.slice(first, last - first)], key, diagonal)
                waiting = []
            elif not waiting and last > 0:
                yield from _labelled([batch.slice(0, last)], key, diagonal)
            if len(block):
                waiting.append(batch.slice(last))
        if waiting:
            yield from _labelled(waiting, key, diagonal)

    dealt = blocks.repartition(key, "_by", "_bx").sortWithinPartitions(key, "_by", "_bx")
    labelled = cut(dealt.mapInArrow(label, f"{key} {kind}, y int, x int, lab long"))
    edge = (F.pmod("y", F.lit(BLOCK)).isin(0, BLOCK - 1)) | (F.pmod("x", F.lit(BLOCK)).isin(0, BLOCK - 1))
    rim = P.banded(labelled.where(edge), 1, key)
    if diagonal:
        windows = [P.frame(0, 1, key, lo=1), P.frame(1, 1, key)]
    else:
        windows = [P.frame(0, 1, key, lo=1), P.frame(1, 0, key)]
    near = F.concat(*[F.collect_list("lab").over(w) for w in windows])
    node = F.struct(F.col(key), F.col("lab"))
    pairs = (
        rim.withColumn("_near", near).where("_own").select(key, "lab", F.explode("_near").alias("other")).where("lab <> other")
        .distinct().select(node.alias("u"), F.struct(F.col(key), F.col("other").alias("lab")).alias("v"))
    )
    pairs = cut(pairs)
    base = px.join(shuffled(labelled), [key, "y", "x"]) if set(px.columns) - {key, "y", "x"} else labelled
    if is_empty(pairs):
        return base.select(*px.columns, F.col("lab").alias("comp_id"))
    merged = graph.components(pairs).select(F.col(f"node.{key}").alias(key), F.col("node.lab").alias("lab"), F.col("comp.lab").alias("_c"))
    return base.join(shuffled(merged), [key, "lab"], "left").select(*px.columns, F.coalesce("_c", "lab").alias("comp_id"))


def component_stats(labelled: DataFrame, key: str = "tile_id") -> DataFrame:
    """Area, centroid and bounds of each group."""
    return labelled.groupBy(key, "comp_id").agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"))


def keep_groups(labelled: DataFrame, seed: Column, key: str = "tile_id") -> DataFrame:
    """Pixels of the groups that hold at least one pixel for which ``seed`` is true."""
    good = labelled.where(seed).select(key, "comp_id").distinct()
    return labelled.join(shuffled(good), [key, "comp_id"], "left_semi")


def hysteresis(prob: DataFrame, low: float, high: float, key: str = "tile_id") -> DataFrame:
    """Pixels above ``low`` whose group holds a pixel above ``high``."""
    labelled = components(prob.where(F.col("p") > low), key=key)
    return keep_groups(labelled, F.col("p") > high, key).select(key, "y", "x")


def valid_region(gray: DataFrame, dims: DataFrame, threshold: int, border_only: bool = True, pad: int = 0,
                 key: str = "tile_id") -> DataFrame:
    """The no-data pixels: values up to ``threshold`` in groups that touch the tile edge, grown by ``pad`` steps."""
    low = gray.where(F.col("v") <= threshold).select(key, "y", "x")
    if border_only:
        labelled = components(low, key=key).join(dims, key)
        rim = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)
        low = keep_groups(labelled, rim, key).select(key, "y", "x")
    for _ in range(pad):
        low = P.dilate(low, P.ellipse(3), dims, key)
    return low


def fill_holes(px: DataFrame, key: str = "tile_id") -> DataFrame:
    """Add the background pixels that no 4-connected background path joins to the outside.

    Only the gaps between foreground pixels of one row can be holes, so gaps are labelled, not background
    pixels: inside blocks first, then across block edges. A group is open, and no hole, if one of its gaps meets
    the part of a neighbouring row that lies beyond that row's outermost pixels."""
    row = W.partitionBy(key, "y").orderBy("x")
    kind = px.schema[key].dataType.simpleString()
    reach = px.groupBy(key, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    up, down = ((reach.select(key, (F.col("y") + d).alias("y"), F.col("x0").alias(f"x0{d}"), F.col("x1").alias(f"x1{d}"))) for d in (-1, 1))
    gaps = (
        px.select(key, "y", "x", F.lead("x").over(row).alias("nx")).where("nx > x + 1")
        .select(key, "y", (F.col("x") + 1).alias("lo"), (F.col("nx") - 1).alias("hi"))
        .join(shuffled(up), [key, "y"], "left").join(shuffled(down), [key, "y"], "left")
    )
    beyond = F.lit(False)
    for d in (-1, 1):
        beyond = beyond | F.col(f"x0{d}").isNull() | (F.col("lo") < F.col(f"x0{d}")) | (F.col("hi") > F.col(f"x1{d}"))
    pieces = (
        gaps.withColumn("open", beyond)
        .withColumn("_bx", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
        .select(key, "y", F.greatest(F.col("lo"), F.col("_bx") * BLOCK).cast("int").alias("lo"),
                F.least(F.col("hi"), F.col("_bx") * BLOCK + BLOCK - 1).cast("int").alias("hi"), "open",
                F.floor(F.col("y") / BLOCK).alias("_by"), "_bx")
    )

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[key, "y", "lo", "hi"]].copy()
        lab = _label_gaps(pdf["y"].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy())
        at, group = np.unique(lab, return_inverse=True)
        out["open"] = (np.bincount(group, pdf["open"].to_numpy(float), len(at)) > 0)[group]
        out["lab"] = lab
        return out

    labelled = cut(pieces.groupBy(key, "_by", "_bx").applyInPandas(label, f"{key} {kind}, y int, lo int, hi int, open boolean, lab long"))
    node = F.struct(F.col(key), F.col("lab"))
    side = W.partitionBy(key, "y").orderBy("lo")
    across = (
        labelled.where((F.pmod("lo", F.lit(BLOCK)) == 0) | (F.pmod("hi", F.lit(BLOCK)) == BLOCK - 1))
        .select(node.alias("u"), "hi", F.lead(node).over(side).alias("v"), F.lead("lo").over(side).alias("next_lo"))
        .where("next_lo = hi + 1").select("u", "v")
    )
    # Rows on both sides of a block edge: each gap start looks up the gap of the other row that covers it.
    top = labelled.where(F.pmod("y", F.lit(BLOCK)) == BLOCK - 1).withColumn("edge", F.col("y"))
    bottom = labelled.where(F.pmod("y", F.lit(BLOCK)) == 0).withColumn("edge", F.col("y") - 1)
    rim = top.unionByName(bottom)
    last = {d: F.last(F.when(F.col("y") - F.col("edge") == d, F.struct(node.alias("n"), F.col("hi").alias("end"))), ignorenulls=True).over(
        W.partitionBy(key, "edge").orderBy("lo").rangeBetween(W.unboundedPreceding, W.currentRow)) for d in (0, 1)}
    down_links = (
        rim.withColumn("_0", last[0]).withColumn("_1", last[1])
        .withColumn("_o", F.when(F.col("y") == F.col("edge"), F.col("_1")).otherwise(F.col("_0")))
        .where("_o.end >= lo").select(node.alias("u"), F.col("_o.n").alias("v"))
    )
    links = cut(across.unionByName(down_links))
    holes = labelled.where("NOT open")      # of its block
    if not is_empty(links):
        # Open groups go on over block edges; groups without a link are settled in their block.
        groups = graph.components(links).join(shuffled(labelled.select(node.alias("node"), "open").distinct()), "node")
        reached = groups.join(shuffled(groups.where("open").select("comp").distinct()), "comp", "left_semi")
        holes = holes.join(shuffled(reached.select(f"node.{key}", "node.lab")), [key, "lab"], "left_anti")
    return px.select(key, "y", "x").unionByName(holes.select(key, "y", F.explode(F.sequence("lo", "hi")).alias("x")))


def morph_skeleton(px: DataFrame, dims: DataFrame, key: str = "tile_id") -> DataFrame:
    """Residues of opening by a cross, collected over repeated erosion."""
    work, dims = cut(px.select(key, "y", "x")), cut(dims.select(key, "width", "height"))      # read in every round
    parts = []
    while not is_empty(work):
        eroded = cut(P.erode(work, P.CROSS3, key, dims))
        parts.append(cut(P.mask_minus(work, P.dilate(eroded, P.CROSS3, dims, key), key)))
        work = eroded
    out = parts[0] if parts else work
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def merge_close(points: DataFrame, r: float, by: list[str]) -> DataFrame:
    """Replace points linked by steps of at most ``r`` by their mean -> ``(by, x, y, size)``."""
    from lineweave.operators.spatial import radius_clusters

    groups = radius_clusters(points, r, by)
    return groups.groupBy(*by, "cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("size")).drop("cluster_id")


def junction_nodes(px: DataFrame, dims: DataFrame, k: int = 2, key: str = "tile_id") -> DataFrame:
    """Node positions: pixels with more than ``k`` neighbours, grown by a disk of 6, one centroid for each group,
    and groups whose centroids lie within 12 px merged."""
    grown = P.dilate(P.branch_pixels(px, k + 1, key), P.disk(6), dims, key)
    spots = component_stats(components(grown, key=key), key)
    return merge_close(spots.select(key, F.col("comp_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), 12.0, [key])


def base_proposals(nodes: DataFrame, dims: DataFrame, margin: int = 8, key: str = "tile_id") -> DataFrame:
    from lineweave.functions import scalars as X

    placed = nodes.join(dims, key)
    n = placed.select(key, X.clip_to("x", F.col("width")).alias("node_x"), X.clip_to("y", F.col("height")).alias("node_y"), "width", "height")
    return n.select(key, "node_x", "node_y", F.lit("base_topology").alias("proposal_source"), F.lit("base_junction").alias("proposal_type"),
                    F.lit(1.0).alias("proposal_score"),
                    X.border_flag("node_x", "node_y", "width", "height", margin).cast("int").alias("border_flag"))


def topology_gate(px: DataFrame, points: DataFrame, r: int, key: str = "tile_id") -> DataFrame:
    """Points within a branch mask grown by the ellipse kernel of radius ``r``."""
    mask = P.dilate(P.branch_pixels(px, 3, key), P.ellipse(2 * r + 1), None, key)
    spot = points.withColumn("_x", F.bround("x").cast("int")).withColumn("_y", F.bround("y").cast("int"))
    return spot.join(shuffled(mask.withColumnsRenamed({"x": "_x", "y": "_y"})), [key, "_y", "_x"], "left_semi").select(*points.columns)
