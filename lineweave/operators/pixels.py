"""Neighbourhood and morphology operators on sparse pixel tables ``(tile_id, y, x)``.

Pixels are put in row-major order inside horizontal bands, each with a halo of its neighbours' rows.
A run of neighbours in row y+k is then one RANGE frame of that order, so any row-convex kernel is a few
frames of a single window: one shuffle, no explosion of offsets and no join back."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.session import shuffled

PITCH = 1 << 31          # row pitch of the row-major key; no 32-bit column reaches the next row
BAND = 128               # rows per band

# A kernel is {dy: k}: the offsets (dy, -k..k).
SQUARE3 = {-1: 1, 0: 1, 1: 1}
CROSS3 = {-1: 0, 0: 1, 1: 0}


def square(side: int) -> dict[int, int]:
    h = side // 2
    return {dy: h for dy in range(-h, h + 1)}


def disk(r: int) -> dict[int, int]:
    """Offsets with dx^2 + dy^2 <= r^2."""
    return {dy: math.isqrt(r * r - dy * dy) for dy in range(-r, r + 1)}


def ellipse(side: int) -> dict[int, int]:
    """The rounded-ellipse kernel of the common image library: half width round(h*sqrt(1-(dy/h)^2))."""
    h = side // 2
    if h == 0:
        return {0: 0}
    return {dy: round(h * math.sqrt(1.0 - dy * dy / (h * h))) for dy in range(-h, h + 1)}


def line_key() -> Column:
    return F.col("y").cast("bigint") * F.lit(PITCH) + F.col("x")


def banded(px: DataFrame, halo: int, key: str = "tile_id", band: int = BAND) -> DataFrame:
    """Add ``_band``, ``_own`` and ``_line``; rows near a band edge are copied to the next band."""
    first = F.floor((F.col("y") - F.lit(halo)) / F.lit(band))
    last = F.floor((F.col("y") + F.lit(halo)) / F.lit(band))
    return (
        px.withColumn("_band", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_band") == F.floor(F.col("y") / F.lit(band)))
        .withColumn("_line", line_key())
    )


def frame(dy: int, k: int, key: str = "tile_id", lo: int | None = None):
    start = -k if lo is None else lo
    return W.partitionBy(key, "_band").orderBy("_line").rangeBetween(dy * PITCH + start, dy * PITCH + k)


def _trim(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_band", "_own", "_line")


def degree_map(px: DataFrame, neighbours: bool = False, key: str = "tile_id") -> DataFrame:
    """Adds ``deg``, the number of 8-neighbours, and on request ``nbrs``, their offsets in scan order."""
    wide = banded(px, 1, key)
    n = sum((F.count(F.lit(1)).over(frame(dy, 1, key)) for dy in (-1, 0, 1)), start=F.lit(-1))
    out = wide.withColumn("deg", n.cast("int"))
    if neighbours:
        around = [F.collect_list(F.col("_line")).over(frame(dy, 1, key)) for dy in (-1, 0, 1)]
        diff = F.transform(F.concat(*around), lambda v: v - F.col("_line"))
        out = out.withColumn("nbrs", F.transform(F.filter(diff, lambda v: v != 0), _offset))
    return _trim(out)


def _offset(v: Column) -> Column:
    dy = F.floor((v + F.lit(PITCH // 2)) / F.lit(PITCH)).cast("int")
    return F.struct(dy.alias("dy"), (v - dy * F.lit(PITCH)).cast("int").alias("dx"))


def endpoints(px: DataFrame, key: str = "tile_id") -> DataFrame:
    return degree_map(px, key=key).where("deg = 1").drop("deg")


def branch_pixels(px: DataFrame, k: int = 3, key: str = "tile_id") -> DataFrame:
    return degree_map(px, key=key).where(F.col("deg") >= k).drop("deg")


def erode(px: DataFrame, kernel: dict[int, int] = SQUARE3, key: str = "tile_id", dims: DataFrame | None = None) -> DataFrame:
    """Pixels whose whole kernel is foreground.

    Outside the tile counts as background, or as foreground when ``dims(key, width, height)`` is given."""
    reach = max(abs(dy) for dy in kernel)
    wide = banded(px, reach, key)
    if dims is not None:
        wide = wide.join(dims.select(key, "width", "height"), key)
    ok = F.lit(True)
    for dy, k in sorted(kernel.items()):
        n = F.count(F.lit(1)).over(frame(dy, k, key))
        if dims is None:
            ok = ok & (n == 2 * k + 1)
        else:
            width = F.least(F.col("x") + k, F.col("width") - 1) - F.greatest(F.col("x") - k, F.lit(0)) + 1
            row = F.col("y") + dy
            ok = ok & ((row < 0) | (row >= F.col("height")) | (n == width))
    return _trim(wide.withColumn("_ok", ok)).where("_ok").select(*px.columns)


def dilate(px: DataFrame, kernel: dict[int, int] = SQUARE3, dims: DataFrame | None = None,
           key: str = "tile_id") -> DataFrame:
    """Binary dilation -> ``(key, y, x)``, clipped to ``dims`` if given."""
    spans = dilated_spans(px, kernel, [key])
    if dims is not None:
        spans = (
            spans.join(dims.select(key, "width", "height"), key)
            .where("y >= 0 AND y < height AND hi >= 0 AND lo < width")
            .select(key, "y", F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", F.col("width") - 1).alias("hi"))
        )
    return spans.select(key, "y", F.explode(F.sequence("lo", "hi")).alias("x"))


def dilated_spans(px: DataFrame, kernel: dict[int, int], by: Sequence[str]) -> DataFrame:
    """The dilation as row intervals ``(by, y, lo, hi)``.

    Each pixel sends one interval per kernel row; intervals of a row are merged before they become pixels."""
    rows = px.select(*by, "x", F.explode(F.array(*[
        F.struct((F.col("y") + dy).cast("int").alias("y"), F.lit(k).alias("k")) for dy, k in sorted(kernel.items())
    ])).alias("s")).select(*by, F.col("s.y").alias("y"), (F.col("x") - F.col("s.k")).cast("int").alias("lo"),
                           (F.col("x") + F.col("s.k")).cast("int").alias("hi"))
    return merge_spans(rows, [*by, "y"])


def merge_spans(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of the integer intervals ``[lo, hi]`` of each group; touching intervals join."""
    line = W.partitionBy(*by).orderBy("lo", "hi")
    seen = F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1))
    fresh = (F.col("lo") > F.coalesce(seen, F.col("lo") - 2) + 1).cast("int")
    marked = rows.withColumn("_new", fresh)
    grouped = marked.withColumn("_g", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def open_(px: DataFrame, kernel: dict[int, int] = SQUARE3, iters: int = 1, key: str = "tile_id",
          dims: DataFrame | None = None) -> DataFrame:
    out = px.select(key, "y", "x")
    for _ in range(iters):
        out = erode(out, kernel, key, dims)
    for _ in range(iters):
        out = dilate(out, kernel, dims, key)
    return out


def close_(px: DataFrame, kernel: dict[int, int] = SQUARE3, iters: int = 1, key: str = "tile_id",
           dims: DataFrame | None = None) -> DataFrame:
    out = px.select(key, "y", "x")
    for _ in range(iters):
        out = dilate(out, kernel, dims, key)
    for _ in range(iters):
        out = erode(out, kernel, key, dims)
    return out


# ---------------------------------------------------------------- set operations on masks

def mask_union(a: DataFrame, b: DataFrame, key: str = "tile_id") -> DataFrame:
    cols = [key, "y", "x"]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def mask_intersect(a: DataFrame, b: DataFrame, key: str = "tile_id") -> DataFrame:
    return a.join(shuffled(b.select(key, "y", "x")), [key, "y", "x"], "left_semi")


def mask_minus(a: DataFrame, b: DataFrame, key: str = "tile_id") -> DataFrame:
    return a.join(shuffled(b.select(key, "y", "x")), [key, "y", "x"], "left_anti")


# ---------------------------------------------------------------- local tests on the pixel graph

def corner_pixels(px: DataFrame, max_angle: float = 150.0, key: str = "tile_id") -> DataFrame:
    """Pixels with two neighbours that meet at ``max_angle`` degrees or less."""
    two = degree_map(px, neighbours=True, key=key).where("deg = 2")
    a, b = F.get("nbrs", F.lit(0)), F.get("nbrs", F.lit(1))
    dot = a["dx"] * b["dx"] + a["dy"] * b["dy"]
    norm = F.sqrt((a["dx"] * a["dx"] + a["dy"] * a["dy"]).cast("double")) * F.sqrt(
        (b["dx"] * b["dx"] + b["dy"] * b["dy"]).cast("double"))
    angle = F.degrees(F.acos(F.greatest(F.least(dot / norm, F.lit(1.0)), F.lit(-1.0))))
    return two.withColumn("angle_deg", angle).where(F.col("angle_deg") <= max_angle).drop("deg", "nbrs")


def auto_polarity(px: DataFrame, threshold: int = 127, key: str = "tile_id") -> DataFrame:
    """Foreground of each tile: its dark (v < thr) or its bright (v > 255 - thr) pixels, whichever are fewer."""
    thr = max(1, min(254, int(threshold)))
    dark, bright = F.col("v") < thr, F.col("v") > 255 - thr
    side = px.groupBy(key).agg((F.count_if(dark) <= F.count_if(bright)).alias("_dark"))
    joined = px.where(dark | bright).join(side, key)
    return joined.where((F.col("_dark") & dark) | (~F.col("_dark") & bright)).select(*px.columns)


def branch_ratio(px: DataFrame, key: str = "tile_id") -> DataFrame:
    """Counts of pixels, endpoints and branch pixels of each tile, and the share of branch pixels."""
    return (
        degree_map(px, key=key).groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("deg") == 1).alias("n_endpoints"),
             F.count_if(F.col("deg") >= 3).alias("n_branch"))
        .withColumn("branch_ratio", F.col("n_branch") / F.col("n_pixels"))
    )
