"""What a point sees on circles around it: crossings, arms and their angles.

A circle is sampled at n = max(floor, 4*pi*r) steps. Places are folded and read from dense blocks of pixels, so a pixel is
sent to the blocks around it once, not to every point in reach; only the numbers of lit samples leave a block."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import scalars as X
from lineweave.operators.spatial import radius_join
from lineweave.session import shuffled

ARM_FLOOR, CROSSING_FLOOR = 64, 32      # fixed values: least sample counts


def samples(r: int, floor: int) -> int:
    return max(floor, int(2 * math.pi * r * 2))


def _read_circles(px: DataFrame, points: DataFrame, radii: Sequence[int], floor: int, read: Callable[[np.ndarray], dict], columns: str, key: str) -> DataFrame:
    """``(key, id, radius)`` with the columns that ``read`` makes of the samples ``(points, n)`` of one circle."""
    from lineweave.operators.paths import by_block      # walks read circles too

    circles = []
    for r in sorted(set(radii)):
        n = samples(r, floor)
        turn = [i * (2 * math.pi / n) for i in range(n)]
        circles.append((r, np.array([r * math.sin(a) for a in turn]), np.array([r * math.cos(a) for a in turn])))

    def run(stack, oy, ox, pts):
        parts = []
        for lo in range(0, len(pts), 2000):
            y, x = (pts[c].to_numpy(float)[lo:lo + 2000] for c in ("y", "x"))
            for r, dy, dx in circles:
                on = stack[0, np.rint(y[:, None] + dy).astype(int) - oy, np.rint(x[:, None] + dx).astype(int) - ox] > 0
                parts.append(pd.DataFrame({"_y": y, "_x": x, "radius": np.int32(r), **read(on)}))
        return pd.concat(parts, ignore_index=True)

    at = points.select(key, "id", F.col("y").cast("double").alias("_y"), F.col("x").cast("double").alias("_x"))
    places = at.select(key, F.col("_y").alias("y"), F.col("_x").alias("x")).distinct()
    seen = by_block(px, places, max(radii) + 1, run, f"_y double, _x double, radius int, {columns}", key)
    return at.join(shuffled(seen), [key, "_y", "_x"]).drop("_y", "_x")


def lit_samples(px: DataFrame, points: DataFrame, radii: Sequence[int], floor: int = ARM_FLOOR, key: str = "tile_id") -> DataFrame:
    """``(key, id, radius, lit)`` with the sorted lit sample numbers of every point and radius, empty arrays included."""
    def read(on: np.ndarray) -> dict:
        rows, at = np.nonzero(on)
        lit = np.split(at.astype(np.int32), np.cumsum(np.bincount(rows, minlength=len(on)))[:-1])
        return {"lit": [v.tolist() for v in lit]}

    return _read_circles(px, points, radii, floor, read, "lit array<int>", key)


def _count_at(radii: Sequence[int], floor: int) -> Column:
    return F.create_map(*[F.lit(v) for r in sorted(set(radii)) for v in (r, samples(r, floor))])[F.col("radius")]


def _starts(lit: Column) -> Column:
    return F.filter(lit, lambda v, k: F.coalesce(v - F.get(lit, k - 1) > 1, F.lit(True)))


def crossing_number(px: DataFrame, points: DataFrame, radii: Sequence[int] = (8, 12), key: str = "tile_id") -> DataFrame:
    """``(key, id, radius, crossings)``: dark-to-lit changes around the circle."""
    rings = lit_samples(px, points, radii, CROSSING_FLOOR, key)
    wraps = (F.get("lit", F.lit(0)) == 0) & (F.element_at("lit", -1) == _count_at(radii, CROSSING_FLOOR) - 1)
    n = F.size(_starts(F.col("lit"))) - F.when(F.size("lit") > 0, wraps.cast("int")).otherwise(0)
    return rings.select(key, "id", "radius", n.alias("crossings"))


def ring_angles(px: DataFrame, points: DataFrame, radii: Sequence[int], key: str = "tile_id") -> DataFrame:
    """``(key, id, radius, arms)``: the middle angle, in degrees, of each lit arc; an arc over the zero angle comes last."""
    rings = lit_samples(px, points, radii, ARM_FLOOR, key).withColumn("_n", _count_at(radii, ARM_FLOOR))
    lit = F.col("lit")
    ends = F.filter(lit, lambda v, k: F.coalesce(F.get(lit, k + 1) - v > 1, F.lit(True)))
    runs = F.zip_with(_starts(lit), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rings = rings.withColumn("_r", runs)
    r, n = F.col("_r"), F.col("_n")
    first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
    joined = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0))), F.array(F.struct(last["a"].alias("a"), (first["b"] + n).alias("b"))))
    wraps = (F.size(r) >= 2) & (first["a"] == 0) & (last["b"] == n - 1)
    arcs = F.when(wraps, joined).otherwise(r)
    return rings.select(key, "id", "radius", F.transform(arcs, lambda s: (s["a"] + s["b"]) / 2.0 / n * 360.0).alias("arms"))


def collinearity_table(px: DataFrame, points: DataFrame, radii: Sequence[int], key: str = "tile_id") -> DataFrame:
    """``(key, id, radius, n_arms, deviation, max_gap)``: the arms of ``ring_angles``, compared where they are read."""
    return _read_circles(px, points, radii, ARM_FLOOR, _compare_arms, "n_arms int, deviation double, max_gap double", key)


def _compare_arms(on: np.ndarray) -> dict:
    """Number of lit arcs of each circle; of three or more the least deviation of two from a straight line and the largest gap."""
    n = on.shape[1]
    whole = on.all(1)
    start, end = on & ~np.roll(on, 1, 1), on & ~np.roll(on, -1, 1)
    start[whole, 0] = end[whole, -1] = True
    count = start.sum(1)
    three = count >= 3
    out = {"n_arms": count.astype("int32"), "deviation": np.full(len(on), 90.0), "max_gap": np.full(len(on), np.nan)}
    if not three.any():
        return out
    start, end, count = start[three], end[three], count[three]
    (rows, a), b = np.nonzero(start), np.nonzero(end)[1]
    first = np.cumsum(count) - count
    turn = (b[first] < a[first])[rows]      # the last arc of these goes on over the zero angle, where it ends first
    k = np.arange(len(rows)) - first[rows]
    last = k == count[rows] - 1
    b = np.where(turn, b[first[rows] + np.where(last, 0, np.minimum(k + 1, count[rows] - 1))] + np.where(last, n, 0), b)
    arms = np.full((len(count), count.max()), np.nan)
    arms[rows, k] = (a + b) / 2.0 / n * 360.0
    best = np.full(len(count), np.inf)
    for i in range(arms.shape[1] - 1):
        d = np.fmod(np.abs(arms[:, i:i + 1] - arms[:, i + 1:]), 360.0)
        best = np.fmin(best, np.fmin.reduce(np.abs(np.minimum(d, 360.0 - d) - 180.0), axis=1))
    turned = np.sort(np.fmod(arms, 360.0), axis=1)
    around = turned[:, 0] + 360.0 - turned[np.arange(len(count)), count - 1]
    out["deviation"][three] = best
    out["max_gap"][three] = np.fmax(np.fmax.reduce(np.diff(turned, axis=1), axis=1), around)
    return out


FEATURE_RADII = (12, 16, 20, 25, 40, 60, 80)


def collinearity_features(px: DataFrame, points: DataFrame, half_size: int = 96, key: str = "tile_id") -> DataFrame:
    """``r12 .. r80`` and ``n_arms`` of each point; a radius that leaves the window of ``half_size`` stays at 90."""
    radii = [r for r in FEATURE_RADII if r < half_size - 1]
    table = collinearity_table(px, points, radii, key)
    cols = [F.coalesce(F.max(F.when(F.col("radius") == r, F.col("deviation"))), F.lit(90.0)).alias(f"r{r}") for r in FEATURE_RADII]
    return table.groupBy(key, "id").agg(*cols, F.max("n_arms").alias("n_arms"))


def snap_to_pixel(points: DataFrame, px: DataFrame, r: int, key: str = "tile_id") -> DataFrame:
    """``(key, id, sx, sy)``: the nearest pixel in the square window; ties go to the upper, then the left one.

    Points with no pixel in reach are left out."""
    at = points.select(key, "id", F.bround("x").cast("int").alias("x"), F.bround("y").cast("int").alias("y"))
    places = at.select(key, "x", "y").distinct()       # a crowded place looks for its pixel once
    near = radius_join(px.select(key, "x", "y"), places, r * math.sqrt(2.0) + 1e-9, [key])
    inside = near.where((F.abs(F.col("x_a") - F.col("x_b")) <= r) & (F.abs(F.col("y_a") - F.col("y_b")) <= r))
    best = inside.groupBy(key, F.col("x_b").alias("x"), F.col("y_b").alias("y")).agg(F.min(F.struct("d2", "y_a", "x_a")).alias("b"))
    return at.join(shuffled(best), [key, "x", "y"]).select(key, "id", F.col("b.x_a").alias("sx"), F.col("b.y_a").alias("sy"))


def first_three_arm(table: DataFrame, radii: Sequence[int], key: str = "tile_id") -> DataFrame:
    """``(key, id, deviation)`` at the first radius, in the given order, that shows exactly three arms."""
    rank = F.create_map(*[F.lit(v) for i, r in enumerate(radii) for v in (r, i)])[F.col("radius")]
    return table.where("n_arms = 3").groupBy(key, "id").agg(F.min(F.struct(rank.alias("k"), "deviation")).alias("b")).select(
        key, "id", F.col("b.deviation").alias("deviation"))


def collinearity_override(preds: DataFrame, px: DataFrame, threshold: float = 35.0, radii: Sequence[int] = (16, 20, 25),
                          min_p_t: float | None = None, key: str = "tile_id") -> DataFrame:
    """Y becomes T where the first three-arm circle shows a straight pair and, if asked, P(T) is high enough."""
    asked = preds.where("label = 'Y'") if min_p_t is None else preds.where((F.col("label") == "Y") & (F.coalesce("p_t", F.lit(0.0)) >= min_p_t))
    at = asked.select(key, "id", F.bround("x").cast("int").alias("x"), F.bround("y").cast("int").alias("y"))
    flip = first_three_arm(collinearity_table(px, at, radii, key), radii, key).where(F.col("deviation") <= threshold).select(key, "id", F.lit("T").alias("_to"))
    return preds.join(flip, [key, "id"], "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def t_likeness(preds: DataFrame, px: DataFrame, radii: Sequence[int] = (12, 16, 20, 25), snap: int = 5, key: str = "tile_id") -> DataFrame:
    """Adds ``t_likeness`` to T and Y rows: median over radii of 1 - deviation / 60, 0.5 where no circle shows three arms."""
    ty = preds.where(F.col("label").isin("T", "Y"))
    at = snap_to_pixel(ty, px, snap, key).select(key, "id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("deviation") / 60.0))
    mid = collinearity_table(px, at, radii, key).where("n_arms = 3").groupBy(key, "id").agg(F.median(score).alias("_m"))
    return preds.join(mid, [key, "id"], "left").withColumn(
        "t_likeness", F.when(F.col("label").isin("T", "Y"), F.coalesce("_m", F.lit(0.5)))).drop("_m")
