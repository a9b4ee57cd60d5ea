"""Cut large images into overlapping tiles, gate them by valid share, and stretch their gray values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import scalars as X

NO_DATA = 3        # fixed value: gray levels up to 3 carry no data


def tile_anchors(length, size: int, stride: int) -> Column:
    """Regular anchors plus one flush with the far edge; none if the image is smaller than a tile."""
    n = F.col(length) if isinstance(length, str) else length
    last = n - size
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(last >= 0, F.array_distinct(F.concat(regular, F.array(last)))).otherwise(F.array().cast("array<int>"))


def _covering(pos: Column, length: Column, size: int, stride: int) -> Column:
    """Anchors whose tile holds the position: found by arithmetic, so a pixel makes no candidate it does not need."""
    last = length - size
    lo = F.greatest(F.lit(0), F.ceil((pos - size + 1) / stride)).cast("int")
    hi = F.least(F.floor(pos / stride), F.floor(last / stride)).cast("int")
    regular = F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: (k * stride).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    flush = F.when((pos >= last) & (last % stride != 0), F.array(last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(last >= 0, F.concat(regular, flush)).otherwise(F.array().cast("array<int>"))


def tile_pixels(px: DataFrame, dims: DataFrame, size: int = 768, overlap: int = 128, parent: str = "parent_id") -> DataFrame:
    """Copy each pixel to every tile that covers it -> ``(parent, x0, y0, tile y, tile x, ...)``.

    ``dims`` holds ``(parent, width, height)``. One row yields at most a few copies and nothing is shuffled but the join
    with the small table of image sizes."""
    stride = size - overlap
    rest = [c for c in px.columns if c not in (parent, "y", "x")]
    return (
        px.join(dims, parent)
        .withColumn("y0", F.explode(_covering(F.col("y"), F.col("height"), size, stride)))
        .withColumn("x0", F.explode(_covering(F.col("x"), F.col("width"), size, stride)))
        .select(parent, "x0", "y0", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *rest)
    )


def all_tiles(dims: DataFrame, size: int = 768, overlap: int = 128, parent: str = "parent_id") -> DataFrame:
    stride = size - overlap
    return (
        dims.withColumn("y0", F.explode(tile_anchors("height", size, stride)))
        .withColumn("x0", F.explode(tile_anchors("width", size, stride))).select(parent, "x0", "y0")
    )


def gate_tiles(tiled: DataFrame, dims: DataFrame, size: int = 768, overlap: int = 128, min_valid: float = 0.60,
               parent: str = "parent_id", affine: Sequence[float] | None = None, wkt: str | None = None) -> DataFrame:
    """One metadata row for each tile: key, bounds, share of valid pixels, kept or not, and its place on the map."""
    counts = tiled.groupBy(parent, "x0", "y0").agg(F.count_if(F.col("v") > NO_DATA).alias("_valid"))
    share = F.coalesce(F.col("_valid"), F.lit(0)) / F.lit(float(size * size))
    out = (
        all_tiles(dims, size, overlap, parent).join(counts, [parent, "x0", "y0"], "left").withColumn("_share", share)
        .select(X.tile_key(F.col(parent).cast("string"), "x0", "y0", F.lit(size)).alias("key"), parent, "x0", "y0",
                (F.col("x0") + size).alias("x1"), (F.col("y0") + size).alias("y1"), F.lit(size).alias("width"), F.lit(size).alias("height"),
                F.bround("_share", 4).alias("valid_ratio"), (F.col("_share") >= min_valid).alias("kept"))
    )
    if affine is None:
        return out
    at = out.withColumn("_c", X.tile_center("x0", "y0", size, affine)).withColumn(
        "_g", X.projected_to_latlon(F.col("_c.easting"), F.col("_c.northing"), F.lit(wkt)))
    return at.withColumns({
        "center_lat": F.bround("_g.lat", 6), "center_lon": F.bround("_g.lon", 6),
        "center_easting": F.bround("_c.easting", 2), "center_northing": F.bround("_c.northing", 2),
    }).drop("_c", "_g")


def tile_summary(meta: DataFrame, parent: str = "parent_id") -> DataFrame:
    return meta.groupBy(parent).agg(F.count(F.lit(1)).alias("total_windows"), F.count_if("kept").alias("kept_tiles"),
                                    F.count_if(~F.col("kept")).alias("dropped_tiles"))


def stretch(px: DataFrame, key: Sequence[str], lo: float = 0.01, hi: float = 0.99, skip_no_data: bool = True,
            floor: bool = False) -> DataFrame:
    """Adds ``v8``: the gray value stretched between two percentiles of its tile to 0..255.

    Gray levels are counted first, so a tile hands at most one row per level to the percentile."""
    usable = F.col("v") > NO_DATA if skip_no_data else F.lit(True)
    levels = px.where(usable).groupBy(*key, "v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = levels.groupBy(*key).agg(F.percentile("v", F.array(F.lit(lo), F.lit(hi)), F.col("_n")).alias("_q"))
    p, q0 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    q = F.when(q0 <= p, p + 1.0).otherwise(q0)
    scaled = (F.greatest(p, F.least(q, F.col("v"))) - p) / (q - p) * 255.0
    whole = F.floor(scaled) if floor else F.bround(scaled)
    return (
        px.join(cuts, list(key), "left")
        .withColumn("v8", F.when(usable & F.col("_q").isNotNull(), whole).otherwise(0).cast("int")).drop("_q")
    )
