"""Arms of a node: groups of lit pixels in an annulus, the angles between them, and the label rules that use them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.functions import scalars as X
from lineweave.operators import components as C
from lineweave.operators import pixels as P
from lineweave.operators import rings as R
from lineweave.operators.paths import _by_place, by_block
from lineweave.operators.spatial import box_join, cluster_nms, nms
from lineweave.session import cut, shuffled


@dataclass(frozen=True)
class Rules:
    """Limits of the arm analysis. Fixed values."""

    inner: int = 6
    outer: int = 13
    min_pixels: int = 2
    min_span: float = 3.0
    bridge: int = 0
    t_min_largest: float = 150.0
    t_max_side: float = 124.0
    margin: float = 6.0
    mode: str = "symmetric"
    jitter: int = 2
    jitter_penalty: float = 1.25
    temperature: float = 18.0
    guard_scale: float = 0.72
    distance_weight: float = 0.35
    vote_offsets: tuple[int, ...] = (0, 4)


ARM = "array<struct<area:int,span:double,ux:double,uy:double>>"


def ring_arms(px: DataFrame, points: DataFrame, outers: Sequence[int], rules: Rules = Rules(), key: str = "tile_id", folded: bool = False) -> DataFrame:
    """``(key, id, outer, arms, n_groups)``: valid arms between the inner and each outer radius.

    A group counts if it is large and long enough and reaches the outer half of the annulus. ``points`` are whole pixels;
    equal places are analysed once, unless they are ``folded`` already."""
    inner, sizes = max(1, rules.inner), sorted({max(rules.inner + 1, int(o)) for o in outers})
    reach = sizes[-1] + 1
    bridge = P.ellipse(2 * rules.bridge + 1) if rules.bridge > 0 else None

    def run(stack, oy, ox, pts):
        parts = [one(stack[0], oy, ox, pts.iloc[i:i + 2000], outer) for i in range(0, len(pts), 2000) for outer in sizes]
        return pd.concat(parts, ignore_index=True)

    def one(block, oy, ox, pts, outer):
        half = outer + 1
        o = np.arange(-half, half + 1)
        y, x = pts["y"].to_numpy() - oy, pts["x"].to_numpy() - ox
        win = block[(y[:, None] + o)[:, :, None], (x[:, None] + o)[:, None, :]]
        if bridge:
            win = _close(win, bridge)
        d2 = o[:, None] ** 2 + o[None, :] ** 2
        b, wy, wx = np.nonzero(win * ((d2 <= outer * outer) & (d2 > inner * inner)))
        dy, dx = wy - half, wx - half
        # Labels of windows do not mix, so they are in the order of windows too.
        _, at, group, area = np.unique(C.label_pixels(wy + b * (2 * half + 4), wx), return_index=True, return_inverse=True, return_counts=True)
        span, far, ux, uy, norm = _shapes(group, area, np.hypot(dy, dx), dy, dx)
        total = np.bincount(b[at], minlength=len(pts))
        ok = (area >= max(1, rules.min_pixels)) & (span >= rules.min_span) & (far >= inner + 0.5 * (outer - inner)) & (norm > 1e-6)
        arms: list[list] = [[] for _ in range(len(pts))]
        for i, *arm in zip(b[at][ok].tolist(), *(v[ok].tolist() for v in (area, span, ux, uy)), strict=True):
            arms[i].append(dict(zip(("area", "span", "ux", "uy"), arm, strict=True)))
        return pd.DataFrame({"id": pts["id"].to_numpy(), "outer": np.int32(outer), "arms": arms, "n_groups": total.astype("int32")})

    def read(places: DataFrame) -> DataFrame:
        return by_block(px, places, reach + 1, run, f"id long, outer int, arms {ARM}, n_groups int", key)

    return read(points.select(key, "id", "x", "y")) if folded else _by_place(points, read, key)


def _shapes(group: np.ndarray, area: np.ndarray, r: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, ...]:
    """Span in radius, largest radius, and the unit vector and distance of the mean of each group of pixels."""
    if not len(area):
        return (np.zeros(0),) * 5
    order, starts = np.argsort(group, kind="stable"), np.cumsum(area) - area
    near, far = np.minimum.reduceat(r[order], starts), np.maximum.reduceat(r[order], starts)
    my, mx = (np.bincount(group, v, len(area)) / area for v in (dy, dx))
    norm = np.hypot(my, mx)
    unit = np.maximum(norm, 1e-300)
    return far - near, far, mx / unit, my / unit, norm


def _close(win: np.ndarray, kernel: dict[int, int]) -> np.ndarray:
    """Closing inside each window; the window edge neither feeds the dilation nor eats into the result."""
    r = max(kernel)
    offsets = [(dy, dx) for dy, k in kernel.items() for dx in range(-k, k + 1)]
    for fill, pick in ((0, np.maximum), (1, np.minimum)):
        pad = np.pad(win, ((0, 0), (r, r), (r, r)), constant_values=fill)
        h, w = win.shape[1:]
        out = pad[:, r:r + h, r:r + w]
        for dy, dx in offsets:
            out = pick(out, pad[:, r + dy:r + dy + h, r + dx:r + dx + w])
        win = out
    return win


def pair_angles(arms: Column) -> Column:
    """Angles between all pairs of unit vectors, in degrees."""
    return F.flatten(F.transform(arms, lambda p, i: F.transform(F.slice(arms, i + 2, F.size(arms)), lambda q: F.degrees(F.acos(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["ux"] * q["ux"] + p["uy"] * q["uy"])))))))


def _judged(df: DataFrame, three: Column, rules: Rules, mode: str | None = None) -> DataFrame:
    """Adds ``_t``, the label of three arms, where ``three`` holds. The angles are a column first, as the label reads them many times."""
    plain = mode or ("robust" if rules.mode.startswith("robust") else rules.mode)
    df = df.withColumn("_s", F.when(three, F.array_sort(pair_angles(F.col("arms")))))
    return df.withColumn("_t", F.when(three, X.three_arm_label("_s", plain, rules.t_min_largest, rules.t_max_side, rules.margin, ordered=True))).drop("_s")


def _snapped(px: DataFrame, points: DataFrame, rules: Rules, snap: int | None, key: str) -> DataFrame:
    r = max(2, rules.inner) if snap is None else snap
    return R.snap_to_pixel(points, px, r, key).select(key, "id", F.col("sx").alias("x"), F.col("sy").alias("y"))


def local_geometry(px: DataFrame, points: DataFrame, outers: Sequence[int] | None = None, rules: Rules = Rules(), snap: int | None = None,
                   key: str = "tile_id", arms: bool = False) -> DataFrame:
    """``(key, id, outer, label, arm_count, score, err, err_t, err_y, ambiguous, sx, sy)``, on request ``arms``; label '' where there is no node.

    Four or more arms are an X. Three arms are T or Y by the angle errors; the robust modes also try the pixels around."""
    outers = [rules.outer] if outers is None else list(outers)
    out = _readings(px, points, outers, rules, snap, key, arms)
    every = points.select(key, "id", F.explode(F.array(*[F.lit(int(max(rules.inner + 1, o))) for o in sorted(set(outers))])).alias("outer"))
    return every.join(shuffled(out.withColumn("score", _score())), [key, "id", "outer"], "left").fillna({"label": "", "arm_count": 0, "score": 0.0, "ambiguous": True})


def _score() -> Column:
    return F.when(F.col("err") == float("inf"), 0.0).otherwise(1.0 / (1.0 + F.greatest(F.lit(0.0), F.col("err"))))


def _readings(px: DataFrame, points: DataFrame, outers: Sequence[int], rules: Rules, snap: int | None, key: str, arms: bool = False, lit: bool = False) -> DataFrame:
    """What ``local_geometry`` reads, for the points with a pixel in reach. ``lit``: the points are distinct pixels."""
    at = points.select(key, "id", "x", "y") if lit else _snapped(px, points, rules, snap, key)
    seen = ring_arms(px, at, outers, rules, key, folded=lit).join(shuffled(at.withColumnsRenamed({"x": "sx", "y": "sy"})), [key, "id"])
    n = F.size("arms")
    judged = _judged(seen, n == 3, rules)
    inf = F.lit(float("inf"))
    out = judged.select(
        key, "id", "outer", F.when(n >= 4, "X").when(n == 3, F.col("_t.label")).otherwise("").alias("label"), n.alias("arm_count"),
        F.when(n >= 4, 0.0).when(n == 3, F.col("_t.err")).otherwise(inf).alias("err"), F.coalesce("_t.err_t", inf).alias("err_t"),
        F.coalesce("_t.err_y", inf).alias("err_y"), F.when(n >= 4, False).otherwise(F.coalesce("_t.ambiguous", F.lit(True))).alias("ambiguous"), "sx", "sy", *(["arms"] if arms else []))
    if rules.mode in ("robust", "robust_vote"):
        out = _with_jitter(px, out, outers, rules, key)
    return out


def jitter_hypotheses(px: DataFrame, bases: DataFrame, outers: Sequence[int], offsets: Sequence[int], rules: Rules, key: str = "tile_id") -> DataFrame:
    """Three-arm readings at every pixel within the jitter of a base place (and at the base), one row each.

    ``bases`` has ``(key, id, x, y, outer)`` with ``outer`` out of ``outers``; ``err`` totals add a penalty for the distance moved."""
    spots = box_join(px.select(key, "x", "y"), bases.select(key, "id", "x", "y", "outer"), -rules.jitter, rules.jitter, [key]).select(
        key, F.col("id_b").alias("base"), F.col("outer_b").alias("base_outer"), F.col("x_a").alias("x"), F.col("y_a").alias("y"), F.sqrt("d2").alias("dist"))
    tried = spots.withColumn("outer", F.explode(F.array(*[(F.col("base_outer") + o).cast("int") for o in sorted(set(offsets))])))
    sizes = [max(rules.inner + 1, int(o)) for o in outers]
    places = tried.select(key, "x", "y").distinct().withColumn("id", P.line_key())
    arms = ring_arms(px, places, [s + o for s in sizes for o in offsets], rules, key)
    joined = _judged(tried.withColumn("id", P.line_key()).join(shuffled(arms), [key, "id", "outer"]).where(F.size("arms") == 3), F.lit(True), rules, "robust")
    far = F.col("dist") * rules.jitter_penalty
    return joined.select(key, F.col("base").alias("id"), F.col("base_outer").alias("outer"), "x", "y", "dist", F.col("_t.t_guard").alias("t_guard"),
                         F.col("_t.err_t").alias("err_t"), F.col("_t.err_y").alias("err_y"), (F.col("_t.err_t") + far).alias("total_t"),
                         (F.col("_t.err_y") + far).alias("total_y"))


def _with_jitter(px: DataFrame, read: DataFrame, outers: Sequence[int], rules: Rules, key: str) -> DataFrame:
    voted = rules.mode == "robust_vote"
    bases = read.where("arm_count = 3").select(key, "id", F.col("sx").alias("x"), F.col("sy").alias("y"), "outer")
    hyp = jitter_hypotheses(px, bases, outers, rules.vote_offsets if voted else (0,), rules, key)
    near = F.lit(1.0) / (F.col("dist") * rules.distance_weight + 1.0)
    t_like = F.exp(-F.col("total_t") / rules.temperature) * F.when(F.col("t_guard"), 1.0).otherwise(rules.guard_scale)
    y_like = F.exp(-F.col("total_y") / rules.temperature)
    best = hyp.groupBy(key, "id", "outer").agg(
        F.min(F.struct("total_t", "dist", "y", "x", "err_t", "t_guard")).alias("t"), F.min(F.struct("total_y", "dist", "y", "x", "err_y")).alias("v"),
        F.sum(near * t_like).alias("vt"), F.sum(near * y_like).alias("vy"))
    ct, cy = F.col("t.total_t"), F.col("v.total_y")
    if voted:
        ct, cy = ct - rules.temperature * F.log(F.col("vt") + 1e-12), cy - rules.temperature * F.log(F.col("vy") + 1e-12)
    is_t = ct <= cy + rules.margin
    if voted:
        is_t = F.col("t.t_guard") & is_t
    settled = best.select(
        key, "id", "outer", F.when(is_t, "T").otherwise("Y").alias("_label"), F.greatest(F.lit(0.0), F.when(is_t, ct).otherwise(cy)).alias("_err"),
        F.col("t.err_t").alias("_err_t"), F.col("v.err_y").alias("_err_y"), (F.abs(ct - cy) <= rules.margin).alias("_ambiguous"),
        F.when(is_t, F.col("t.x")).otherwise(F.col("v.x")).alias("_sx"), F.when(is_t, F.col("t.y")).otherwise(F.col("v.y")).alias("_sy"))
    joined = read.join(shuffled(settled), [key, "id", "outer"], "left")
    return joined.select(key, "id", "outer", "arm_count", *[F.coalesce(f"_{c}", c).alias(c) for c in ("label", "err", "err_t", "err_y", "ambiguous", "sx", "sy")])


def best_centers(px: DataFrame, comps: DataFrame, rules: Rules = Rules(), max_centers: int = 1, separation: float | None = None,
                 key: str = "tile_id") -> DataFrame:
    """Best node places of each branch component: most arms, least error, nearest to the centroid; kept apart by ``separation``.

    ``comps`` are labelled pixels ``(key, y, x, comp_id)``; pixels next to a component are tried too."""
    tried = comps.select(key, "comp_id", F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
                                                             for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])).alias("s")).select(
        key, "comp_id", "s.y", "s.x").distinct().join(shuffled(px.select(key, "y", "x")), [key, "y", "x"], "left_semi")
    tried = cut(tried)
    # Each place is a pixel, so it is its own nearest one.
    places = cut(tried.select(key, "y", "x").distinct().withColumn("id", P.line_key()))
    read = _readings(px, places, [rules.outer], rules, None, key, lit=True).withColumn("score", _score()).where("arm_count >= 3 AND label <> ''")
    mid = comps.groupBy(key, "comp_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    ranked = tried.withColumn("id", P.line_key()).select(key, "comp_id", "id").join(shuffled(read), [key, "id"]).join(shuffled(mid), [key, "comp_id"])
    off = F.round(F.sqrt(F.pow(F.col("sx") - F.col("cx"), 2) + F.pow(F.col("sy") - F.col("cy"), 2)), 6)
    order = [-F.col("arm_count"), F.round("err", 9), off, F.col("sy"), F.col("sx")]
    ranked = ranked.withColumns({"_off": off, "x": F.col("sx"), "y": F.col("sy")})
    rest = ["label", "score", "arm_count", "err", "err_t", "err_y", "ambiguous"]
    if max_centers == 1:
        best = ranked.groupBy(key, "comp_id").agg(F.min(F.struct((-F.col("arm_count")).alias("a"), F.round("err", 9).alias("e"), F.col("_off"), "y", "x", F.struct(*rest).alias("r"))).alias("b"))
        return best.select(key, "comp_id", "b.x", "b.y", "b.r.*")
    one = ranked.groupBy(key, "comp_id", "x", "y").agg(F.min_by(F.struct("id", "_off", "sx", "sy", *rest), F.struct(*order, "id")).alias("b")).select(
        key, "comp_id", "x", "y", "b.*")
    order = [-F.col("arm_count"), F.round("err", 9), F.col("_off"), F.col("sy"), F.col("sx")]
    one = cut(one)
    kept = nms(one, separation or float(rules.inner), [key, "comp_id"], order)
    place = W.partitionBy(key, "comp_id").orderBy(*order)      # a component keeps few places after separation
    return kept.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= max_centers).select(key, "comp_id", "x", "y", *rest)


def graph_detect(px: DataFrame, rules: Rules = Rules(), min_area: int = 1, max_centers: int = 1, nms_distance: float = 5.0, key: str = "tile_id") -> DataFrame:
    """Junctions of a thinned network: branch components, their best centres, and one detection for each place."""
    comps = C.components(P.branch_pixels(px, 3, key), key=key)
    if min_area > 1:
        big = C.component_stats(comps, key).where(F.col("area") >= min_area).select(key, "comp_id")
        comps = comps.join(shuffled(big), [key, "comp_id"], "left_semi")
    found = best_centers(px, comps, rules, max_centers, key=key)
    dets = found.withColumns({"id": F.xxhash64("comp_id", "y", "x"), "source_kind": F.lit("graph")})
    dets = cut(dets.select(key, "id", "x", "y", "label", "score", "arm_count", "source_kind"))
    by_label = cut(cluster_nms(dets, nms_distance, [key]))
    return cluster_nms(by_label.drop("cluster_size", "cluster_source_kinds"), nms_distance, [key], respect_label=False)


# ---------------------------------------------------------------- label corrections

def local_recheck(dets: DataFrame, px: DataFrame, t_to_y: bool = True, y_to_t: bool = False, rules: Rules = Rules(), key: str = "tile_id") -> DataFrame:
    """Re-read T and Y rows from the arms at their place; the place moves to the pixel found."""
    asked = [c for c, on in (("T", t_to_y), ("Y", y_to_t)) if on]
    g = local_geometry(px, dets.where(F.col("label").isin(*asked)).select(key, "id", "x", "y"), rules=rules, key=key).select(
        key, "id", F.col("label").alias("local_label"), F.col("arm_count").alias("local_arm_count"), F.col("ambiguous").alias("local_ambiguous"), "sx", "sy")
    out = dets.join(shuffled(g), [key, "id"], "left")
    label = F.col("label")
    flips = F.lit(False)
    if t_to_y:
        flips = flips | ((label == "T") & (F.col("local_label") == "Y"))
    if y_to_t:
        flips = flips | ((label == "Y") & (F.col("local_label") == "T"))
    return out.withColumns({"label": F.when(F.coalesce(flips, F.lit(False)), F.col("local_label")).otherwise(label),
                            "x": F.coalesce("sx", "x"), "y": F.coalesce("sy", "y")}).drop("sx", "sy")


def _votes(px: DataFrame, dets: DataFrame, outers: Sequence[int], rules: Rules, key: str, firm: bool) -> DataFrame:
    g = _readings(px, dets.select(key, "id", "x", "y"), outers, rules, None, key)      # a point without a pixel has no vote
    use = F.lit(True) if not firm else ~F.col("ambiguous")
    three = (F.col("arm_count") == 3) & use
    return g.groupBy(key, "id").agg(F.count_if((F.col("label") == "T") & three).alias("vote_t"), F.count_if((F.col("label") == "Y") & three).alias("vote_y"),
                                    F.count_if(F.col("arm_count") >= 4).alias("support_four"))


def multiradius_vote(dets: DataFrame, px: DataFrame, outers: Sequence[int] = (29, 45, 61), min_votes: int = 2, lead: int = 1, firm: bool = True,
                     rules: Rules = Rules(), key: str = "tile_id") -> DataFrame:
    """T or Y by the vote of several radii, if enough unambiguous readings agree."""
    v = _votes(px, dets.where(F.col("label").isin("T", "Y")), outers, rules, key, firm)
    t, y = F.col("vote_t"), F.col("vote_y")
    won = (F.greatest(t, y) >= min_votes) & (F.abs(t - y) >= lead)
    return dets.join(shuffled(v), [key, "id"], "left").withColumn("label", F.when(F.coalesce(won, F.lit(False)), F.when(t > y, "T").otherwise("Y")).otherwise(F.col("label"))).drop(
        "vote_t", "vote_y", "support_four")


def x_consistency(dets: DataFrame, px: DataFrame, outers: Sequence[int] = (15, 19, 23), max_four: int = 1, min_three: int = 2, rules: Rules = Rules(),
                  key: str = "tile_id") -> DataFrame:
    """X becomes T or Y where hardly any radius sees four arms and enough see the same three; a tie goes to Y."""
    v = _votes(px, dets.where("label = 'X'"), outers, rules, key, firm=False)
    t, y = F.col("vote_t"), F.col("vote_y")
    won = (F.col("support_four") <= max_four) & (F.greatest(t, y) >= min_three)
    return dets.join(shuffled(v), [key, "id"], "left").withColumn("label", F.when(F.coalesce(won, F.lit(False)), F.when(t > y, "T").otherwise("Y")).otherwise(F.col("label"))).drop(
        "vote_t", "vote_y", "support_four")


def validate_detections(dets: DataFrame, px: DataFrame, rules: Rules = Rules(), key: str = "tile_id") -> DataFrame:
    """Drop rows with fewer than three arms, relabel the unambiguous ones, and move all to the pixel found."""
    g = local_geometry(px, dets.select(key, "id", "x", "y"), rules=rules, key=key).where("arm_count >= 3").select(
        key, "id", F.col("label").alias("_l"), F.col("ambiguous").alias("_a"), "sx", "sy")
    out = dets.join(shuffled(g), [key, "id"])
    return out.withColumns({"label": F.when((F.col("_l") != "") & ~F.col("_a"), F.col("_l")).otherwise(F.col("label")),
                            "x": F.col("sx"), "y": F.col("sy")}).drop("_l", "_a", "sx", "sy")


# ---------------------------------------------------------------- tree rules on multi-radius features

MISSING = -999.0      # fixed value: what the tree reads for a missing feature
RADII = (29, 45, 61)


def score_tree(df: DataFrame, tree: dict, label: str = "label") -> DataFrame:
    """Walk a stored decision tree by nested conditions; adds leaf, decision, top counts, their total and relative lead.

    ``tree`` holds ``feature_names, children_left, children_right, feature, threshold, value, classes``: a model file of
    bounded size. Missing features read as -999, as in the stored rule."""
    code = F.coalesce(*[F.when(F.col(label) == c, float(i)) for i, c in enumerate(("T", "Y", "X"))], F.lit(MISSING))
    names = tree["feature_names"]

    def feature(i: int) -> Column:
        name = names[tree["feature"][i]]
        if name == "pred_code":
            return code
        v = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), MISSING).otherwise(v)

    def down(i: int) -> Column:
        left, right = tree["children_left"][i], tree["children_right"][i]
        if left < 0 and right < 0:
            return F.lit(i)
        return F.when(feature(i) <= float(tree["threshold"][i]), down(left)).otherwise(down(right))

    classes = tree.get("classes", ["T", "Y", "X"])
    rows = []
    for i, counts in enumerate(tree["value"]):
        ordered = sorted(counts, reverse=True)
        total = float(sum(counts))
        lead = (ordered[0] - ordered[1]) / max(1e-6, total) if total > 0 and len(ordered) > 1 else 0.0
        rows.append((i, classes[max(range(len(counts)), key=lambda k: (counts[k], -k))], float(ordered[0]), float(ordered[1]) if len(ordered) > 1 else 0.0, total, float(lead)))
    leaves = df.sparkSession.createDataFrame(rows, "tree_leaf int, tree_decision string, tree_top1 double, tree_top2 double, tree_total double, tree_margin double")
    return df.withColumn("tree_leaf", down(0)).join(leaves, "tree_leaf", "left")


def multiradius_evidence(df: DataFrame) -> DataFrame:
    """Support columns over the three radii: ``arm_count_r``, ``label_r``, ``err_t_r`` and ``err_y_r`` in, counts and majority out."""
    n = F.filter(F.array(*[F.bround(f"arm_count_{r}").cast("int") for r in RADII]), lambda v: v.isNotNull() & (v >= 0))
    labels = [F.upper(F.trim(f"label_{r}")) for r in RADII]
    tally = F.array_max(F.array(*[F.struct(sum((F.coalesce((v == c).cast("int"), F.lit(0)) for v in labels), start=F.lit(0)).alias("n"), F.lit(c).alias("label")) for c in ("T", "X", "Y")]))
    t_votes = y_votes = F.lit(0)
    for r in RADII:
        three = F.bround(f"arm_count_{r}").cast("int") == 3
        t_votes = t_votes + F.coalesce((three & (F.col(f"err_t_{r}") + 2.0 < F.col(f"err_y_{r}"))).cast("int"), F.lit(0))
        y_votes = y_votes + F.coalesce((three & (F.col(f"err_y_{r}") + 2.0 < F.col(f"err_t_{r}"))).cast("int"), F.lit(0))
    return df.withColumns({"_n": n, "_m": tally, "_tv": t_votes, "_yv": y_votes}).withColumns({
        "valid_radii": F.size("_n"), "support_eq3": F.size(F.filter("_n", lambda v: v == 3)), "support_ge4": F.size(F.filter("_n", lambda v: v >= 4)),
        "majority_label": F.when(F.col("_m.n") > 0, F.col("_m.label")).otherwise(""), "majority_votes": F.col("_m.n"),
        "error_vote": F.when(F.col("_tv") > F.col("_yv"), "T").when(F.col("_yv") > F.col("_tv"), "Y").otherwise("")}).drop("_n", "_m", "_tv", "_yv")


def weak_x_override(branch_ratio: Column, threshold: float = 0.03) -> Column:
    """T or Y for an X row with little four-arm support, else ''. Needs the evidence columns."""
    sparse = F.coalesce(branch_ratio < threshold, F.lit(False))
    return (
        F.when((F.col("label") != "X") | (F.col("support_ge4") >= 2) | ((F.col("support_eq3") < 2) & ~sparse), "")
        .when(F.col("majority_label").isin("T", "Y") & (F.col("majority_votes") >= 2), F.col("majority_label"))
        .otherwise(F.col("error_vote")))


def structural_gate(decision: Column, margin: Column, min_margin: float = 0.35) -> Column:
    """Reason why a change of label passes or not; 'pass' and 'no_change' pass."""
    old, four, three = F.col("label"), F.col("support_ge4"), F.col("support_eq3")
    votes, major = F.col("majority_votes"), F.col("majority_label")
    return (
        F.when(~old.isin("T", "Y", "X"), "old_type_not_tyx").when(~decision.isin("T", "Y", "X"), "decision_not_tyx").when(decision == old, "no_change")
        .when(F.col("valid_radii") <= 0, "no_multiradius_features").when(margin < min_margin, "low_margin")
        .when((votes < 2) & ~((decision == "X") & (four >= 2)), "weak_multiradius_vote")
        .when((votes >= 2) & (major != "") & (major != decision), "vote_disagrees_with_decision")
        .when(decision.isin("T", "Y") & (three < 2), "needs_three_arm_stability").when((decision == "X") & (four < 2), "needs_four_arm_stability")
        .when((old == "X") & decision.isin("T", "Y") & (four > 1), "x_to_ty_conflicted_by_4arm")
        .when(old.isin("T", "Y") & (decision == "X") & (three > 1) & (four < 3), "ty_to_x_conflicted_by_3arm")
        .when(F.coalesce("local_ambiguous", F.lit(True)) & (margin < min_margin + 0.15), "local_ambiguous_low_margin").otherwise("pass"))


def structural_relabel(df: DataFrame, tree: dict, min_margin: float = 0.35, branch_ratio: str | None = None) -> DataFrame:
    """Tree decision, weak-X override, gate, relabel; the audit columns stay on the row."""
    rich = multiradius_evidence(score_tree(df, tree))
    sparse = F.col(branch_ratio) if branch_ratio else F.lit(None).cast("double")
    weak = F.when(F.col("tree_decision") == "X", weak_x_override(sparse)).otherwise("")
    rich = rich.withColumn("_weak", weak).withColumn("decision", F.when(F.col("_weak") != "", F.col("_weak")).otherwise(F.col("tree_decision"))).drop("_weak")
    rich = rich.withColumn("gate_reason", structural_gate(F.col("decision"), F.col("tree_margin"), min_margin))
    ok = F.col("gate_reason").isin("pass", "no_change")
    return rich.withColumn("label", F.when(ok, F.col("decision")).otherwise(F.col("label")))


def component_arms(px: DataFrame, comps: DataFrame, rules: Rules = Rules(), key: str = "tile_id") -> DataFrame:
    """Fallback reading of a branch component as a whole -> ``(key, comp_id, x, y, label, score, arm_count)``.

    Arms are the lit groups between two dilations of the component; directions are taken from its centroid. The dilations
    stay row intervals: lit pixels look up the intervals of their row, so no dark pixel is ever made. Lit pixels are then
    keyed by component, so all components are read at once."""
    reach, group = max(rules.outer, rules.inner + 1), [key, "comp_id"]
    cell = F.lit(2 * reach + 1)
    outer = P.dilated_spans(comps, P.ellipse(2 * reach + 1), group).withColumn("_c", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    inner = P.dilated_spans(comps, P.ellipse(2 * max(1, rules.inner) + 1), group)
    place = px.select(key, "y", "x", F.floor(F.col("x") / cell).alias("_c"))
    near = place.join(shuffled(outer), [key, "y", "_c"]).where("x BETWEEN lo AND hi").select(*group, "y", "x").distinct()
    covered = inner.select(*[F.col(c).alias(f"_{c}") for c in (*group, "y")], "lo", "hi")
    same = [F.col(c) == F.col(f"_{c}") for c in (*group, "y")]
    band = near.join(shuffled(covered), reduce(and_, same, F.col("x").between(F.col("lo"), F.col("hi"))), "left_anti")
    name = F.concat_ws(":", F.col(key).cast("string"), F.col("comp_id").cast("string")).alias("_k")
    lit = band.select(name, "y", "x")
    mids = comps.groupBy(*group).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(name, *group, "x", "y")
    arms = C.component_stats(C.components(lit, key="_k"), "_k").where(F.col("area") >= max(1, rules.min_pixels)).select("_k", "comp_id", "area", "cx", "cy")
    vec = arms.withColumnRenamed("comp_id", "arm").join(shuffled(mids), "_k").withColumns({"vx": F.col("cx") - F.col("x"), "vy": F.col("cy") - F.col("y")})
    norm = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    unit = vec.withColumn("_n", norm).where("_n >= 1e-6").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(
        "arm", (F.col("vx") / F.col("_n")).alias("ux"), (F.col("vy") / F.col("_n")).alias("uy")))).alias("arms"))
    read = mids.join(shuffled(unit), "_k", "left").withColumn("arm_count", F.coalesce(F.size("arms"), F.lit(0)))
    read = _judged(read.withColumn("arm_count", F.greatest("arm_count", F.lit(0))), F.col("arm_count") == 3, rules)
    n = F.col("arm_count")
    return read.select(
        key, "comp_id", "x", "y", F.when(n >= 4, "X").when(n == 3, F.col("_t.label")).otherwise("").alias("label"),
        F.when(n >= 4, F.least(F.lit(1.0), 0.6 + 0.1 * F.least(n, F.lit(5)))).when(n == 3, 1.0 / (1.0 + F.greatest(F.lit(0.0), F.col("_t.err")))).otherwise(0.0).alias("score"),
        "arm_count")
