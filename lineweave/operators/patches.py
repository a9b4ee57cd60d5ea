"""Fixed-size windows round points, and the features read from them. A window is a small pixel table keyed by ``patch_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.functions import scalars as X
from lineweave.operators import components as C
from lineweave.operators import pixels as P
from lineweave.operators import rings as R
from lineweave.operators.ranks import unit_hash
from lineweave.operators.spatial import box_join, nms, radius_anti_join

JITTER = (32, 63)      # fixed values: range of the local place of a jittered centre in a 96 px window


def crop_windows(px: DataFrame, centers: DataFrame, size: int, key: str = "tile_id", jitter: tuple[int, int] | None = None, seed: int = 0,
                 scale: int = 1) -> DataFrame:
    """``(patch_id, y, x)`` in window coordinates. The centre lands at ``size // 2`` or, with jitter, at a hashed local place.

    ``scale`` > 1 crops a window that much larger and samples every ``scale``-th pixel (nearest neighbour)."""
    wide = size * scale
    at = local_places(centers, size, jitter, seed).select(key, F.col("id"), "x", "y", "local_x", "local_y")
    near = box_join(px.select(key, "x", "y"), at, -wide, wide, [key])
    y = F.col("y_a") - F.col("y_b") + F.col("local_y_b") * scale
    x = F.col("x_a") - F.col("x_b") + F.col("local_x_b") * scale
    inside = near.select(F.col("id_b").alias("patch_id"), y.alias("y"), x.alias("x")).where(
        f"y >= 0 AND y < {wide} AND x >= 0 AND x < {wide} AND y % {scale} = 0 AND x % {scale} = 0")
    return inside.select("patch_id", (F.col("y") / scale).cast("int").alias("y"), (F.col("x") / scale).cast("int").alias("x"))


def local_places(centers: DataFrame, size: int, jitter: tuple[int, int] | None = None, seed: int = 0) -> DataFrame:
    """Adds ``local_x, local_y``: where the centre sits in its window."""
    if jitter is None:
        return centers.withColumns({"local_x": F.lit(size // 2), "local_y": F.lit(size // 2)})
    span = jitter[1] - jitter[0] + 1
    return centers.withColumns({f"local_{c}": (F.floor(unit_hash(F.col("id"), F.lit(c), seed=seed) * span) + jitter[0]).cast("int") for c in "xy"})


def mask_other_nodes(patches: DataFrame, size: int, r: int = 8) -> DataFrame:
    """Erase disks round every junction cluster of a window but the most central one; branches between them stay."""
    key = "patch_id"
    dims = patches.select(key).distinct().select(key, F.lit(size).alias("width"), F.lit(size).alias("height"))
    grown = P.dilate(P.branch_pixels(patches, 3, key), P.square(5), dims, key)
    spots = C.component_stats(C.components(grown, diagonal=False, key=key), key).select(key, "comp_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    off = F.pow(F.col("x") - size // 2, 2) + F.pow(F.col("y") - size // 2, 2)
    central = spots.groupBy(key).agg(F.min(F.struct(off.alias("o"), "comp_id")).alias("_c"))
    others = spots.join(central, key).where("comp_id <> _c.comp_id").select(key, "x", "y")
    return radius_anti_join(patches.select(key, "x", "y"), others, float(r), [key])


def junction_candidates(px: DataFrame, radii: Sequence[int] = (8, 12), min_crossings: int = 3, nms_distance: float = 20.0,
                        key: str = "tile_id") -> DataFrame:
    """``(key, id, x, y, cn, score)``: branch clusters crossed by at least three lines, best first within ``nms_distance``."""
    spots = C.component_stats(C.components(P.branch_pixels(px, 3, key), key=key), key).select(
        key, F.col("comp_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area")
    cn = R.crossing_number(px, spots, radii, key).groupBy(key, "id").agg(F.max("crossings").alias("cn"))
    strong = spots.join(cn, [key, "id"]).where(F.col("cn") >= min_crossings).withColumn("score", F.col("cn") * F.col("area"))
    return nms(strong, nms_distance, [key], [-F.col("score"), F.col("y"), F.col("x")]).select(key, "id", "x", "y", "cn", "score")


def center_stats(patches: DataFrame, size: int = 96, window: int = 48, ids: DataFrame | None = None) -> DataFrame:
    """Six numbers on the middle of a window: lit share, endpoint share, branch share, groups (up to 10), least and greatest angle gap.

    ``ids(patch_id)`` lists all windows; those without a lit pixel get zeros."""
    key = "patch_id"
    win = max(8, min(window, size))
    lo, mid = (size - win) // 2, (size - 1) * 0.5
    middle = (F.col("y") >= lo) & (F.col("y") < lo + win) & (F.col("x") >= lo) & (F.col("x") < lo + win)
    deg = P.degree_map(patches, key=key)
    r = F.sqrt(F.pow(F.col("x") - mid, 2) + F.pow(F.col("y") - mid, 2))
    angle = F.pmod(F.degrees(F.atan2(F.col("y") - mid, F.col("x") - mid)), F.lit(360.0))
    ringed = (r >= 4.0) & (r <= win * 0.6)
    base = deg.groupBy(key).agg(
        *[(F.count_if(middle & c) / float(win * win)).alias(n) for n, c in
          (("center_fg", F.lit(True)), ("endpoint_frac", F.col("deg") == 1), ("branch_frac", F.col("deg") >= 3))],
        F.count_if(ringed).alias("_n"), F.array_sort(F.collect_set(F.when(ringed, F.bround(angle / 12.0).cast("int")))).alias("_bins"))
    groups = C.components(patches.select(key, "y", "x").where(middle), key=key).groupBy(key).agg(F.countDistinct("comp_id").alias("_g"))
    gaps = F.zip_with("_bins", F.concat(F.slice("_bins", 2, F.size("_bins")), F.slice("_bins", 1, 1)), lambda a, b: F.pmod((b - a) * 12.0, F.lit(360.0)))
    known = (F.col("_n") >= 3) & (F.size("_bins") >= 2)
    out = base.join(groups, key, "left").select(
        key, "center_fg", "endpoint_frac", "branch_frac", (F.least(F.coalesce("_g", F.lit(0)), F.lit(10)) / 10.0).alias("cc_norm"),
        F.when(known, F.array_min(gaps) / 180.0).otherwise(0.0).alias("min_gap"), F.when(known, F.array_max(gaps) / 360.0).otherwise(0.0).alias("max_gap"))
    return out if ids is None else ids.select(key).distinct().join(out, key, "left").fillna(0.0)


def hog_features(patches: DataFrame, size: int = 96, bins: int = 9, cell: int = 8, block: int = 2) -> DataFrame:
    """``(patch_id, pos, value)``: the non-zero oriented-gradient entries, block-normalised (L2-Hys).

    Each lit pixel pushes +-1 into the gradients of its four neighbours, so only places next to lit pixels are touched."""
    key, cells = "patch_id", size // cell
    blocks = cells - block + 1
    push = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(gy)).alias("gy"), F.lit(float(gx)).alias("gx"))
                     for dy, dx, gy, gx in ((0, -1, 0, 1), (0, 1, 0, -1), (-1, 0, 1, 0), (1, 0, -1, 0))])
    # A window is dealt out once, as pixels; all that follows groups inside windows and moves nothing again.
    moved = patches.select(key, "y", "x").repartition(key).select(key, "y", "x", F.explode(push).alias("p")).select(
        key, (F.col("y") + F.col("p.dy")).alias("y"), (F.col("x") + F.col("p.dx")).alias("x"), "p.gy", "p.gx")
    last = size - 1
    # One-sided differences do not exist at the rim: the gradient across an edge row or column is 0.
    kept = moved.where(f"y BETWEEN 0 AND {last} AND x BETWEEN 0 AND {last}").select(
        key, "y", "x", F.when(F.col("y").between(1, last - 1), F.col("gy")).otherwise(0.0).alias("gy"),
        F.when(F.col("x").between(1, last - 1), F.col("gx")).otherwise(0.0).alias("gx"))
    grad = kept.groupBy(key, "y", "x").agg(F.sum("gy").alias("gy"), F.sum("gx").alias("gx")).where("gy <> 0 OR gx <> 0")
    turn = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    hist = grad.groupBy(key, F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"), F.floor(turn / (180.0 / bins)).alias("bin")).agg(
        (F.sum(F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx"))) / float(cell * cell)).alias("v"))
    inside = hist.where(f"cy < {cells} AND cx < {cells}")
    spread = inside.withColumn("by", F.explode(F.sequence(F.greatest(F.col("cy") - block + 1, F.lit(0)), F.least(F.col("cy"), F.lit(blocks - 1))))).withColumn(
        "bx", F.explode(F.sequence(F.greatest(F.col("cx") - block + 1, F.lit(0)), F.least(F.col("cx"), F.lit(blocks - 1)))))
    whole = W.partitionBy(key, "by", "bx")
    v = spread.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(whole) + 1e-10)).withColumn("v", F.least("v", F.lit(0.2)))
    v = v.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(whole) + 1e-10))
    pos = (((F.col("by") * blocks + F.col("bx")) * block + (F.col("cy") - F.col("by"))) * block + (F.col("cx") - F.col("bx"))) * bins + F.col("bin")
    return v.select(key, pos.cast("int").alias("pos"), F.col("v").alias("value"))


def classify_candidates(px: DataFrame, cand: DataFrame, radii: Sequence[int] = (16, 20, 12), col_threshold: float = 41.0,
                        t_min_largest: float = 150.0, trace_len: int = 8, key: str = "tile_id") -> DataFrame:
    """T, Y or X for each candidate from the first three-arm circle and from traced branches. ``px`` should be thinned."""
    from lineweave.operators import paths as T

    at = cand.select(key, "id", F.bround("x").cast("int").alias("x"), F.bround("y").cast("int").alias("y"))
    table = R.collinearity_table(px, at, radii, key)
    rank = F.create_map(*[F.lit(v) for i, r in enumerate(radii) for v in (r, i)])[F.col("radius")]
    seen = table.groupBy(key, "id").agg(F.min(F.when(F.col("n_arms") == 3, F.struct(rank.alias("k"), "deviation"))).alias("_three"),
                                        F.min(F.when(F.col("n_arms") >= 4, rank)).alias("_four"))
    local = T.local_junction(px, at, trace_len, key=key).select(key, "id", "branch_count", "max_gap_deg")
    joined = cand.join(seen, [key, "id"], "left").join(local, [key, "id"], "left").withColumns({
        "deviation": F.col("_three.deviation"), "n_arms": F.when(F.col("_three").isNotNull(), 3).otherwise(F.when(F.col("_four").isNotNull(), 4).otherwise(0))})
    return joined.withColumn("label", geometric_label(F.col("max_gap_deg"), col_threshold, t_min_largest)).drop("_three", "_four")


def geometric_label(max_gap, col_threshold: float, t_min_largest: float):
    straight = F.coalesce((F.col("n_arms") == 3) & (F.col("deviation") <= col_threshold), F.lit(False))
    return (
        F.when((F.col("n_arms") >= 4) | (F.col("branch_count") >= 4), "X")
        .when(F.col("branch_count") == 3, F.when((max_gap >= t_min_largest) | straight, "T").otherwise("Y"))
        .when(straight, "T").otherwise("Y"))
