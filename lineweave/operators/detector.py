"""The junction detector in one call: settings by scene density, detectors, fusion, and the label corrections in order.

The settings of a tile follow from its share of branch pixels. That share falls into one of a few tiers, so the plan holds
each stage once for each tier that has tiles, with plain numbers for all radii; tiles never meet on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.operators import arms as A
from lineweave.operators import components as C
from lineweave.operators import fusion
from lineweave.operators import pixels as P
from lineweave.operators import rings as R
from lineweave.operators import walks as K
from lineweave.operators.arms import Rules
from lineweave.operators.paths import link_endpoints, reading_side, thin
from lineweave.operators.spatial import box_join, cluster_nms, radius_anti_join
from lineweave.session import cut, is_empty, shuffled

# Shares of branch pixels at which the settings change.
SPARSE, CORNERS, VERY_SPARSE = 0.03, 0.02, 0.008


@dataclass(frozen=True)
class Tier:
    """Settings of the tiles whose share of branch pixels is at least ``lo`` and less than ``hi``. Fixed values."""

    lo: float = 0.0
    hi: float = float("inf")
    outer: int = 13
    nms: int = 5
    centers: int = 1
    bridge: int = 0
    recovery: bool = False
    endpoint: int = 10
    min_score: float = 0.12
    x_consistency: bool = False
    debias: bool = False
    merge: int = 0
    corner: bool = False
    corner_endpoint: int = 0
    corner_score: float | None = None
    best_fallback: bool = False


@dataclass(frozen=True)
class Detector:
    """What is asked of the detector. The defaults are fixed values."""

    mode: str = "hybrid"
    center: str = "best"
    rules: Rules = Rules()
    branch_degree: int = 3
    min_area: int = 1
    support: int = 2
    max_area: int = 180
    corner_angle: float = 150.0
    base: Tier = Tier()
    repair: bool = False
    match: float = 0.25
    topology_gate: bool = True
    gate_radius: int = 6
    conflict_aware: bool = True
    t_to_y: bool = False
    y_to_t: bool = True
    vote: bool = True
    vote_outers: tuple[int, ...] = (29, 45, 61)
    feature_tree: dict | None = None
    structural_tree: dict | None = None
    x_outers: tuple[int, ...] = (15, 19, 23)
    auto_scale: bool = False
    sparse_ratio: float = SPARSE
    low_outer: int = 21
    low_nms: int = 12
    low_centers: int = 2
    low_bridge: int = 3
    low_recovery: bool = True
    low_endpoint: int = 1
    low_score: float = 0.12
    low_x_consistency: bool = True
    low_merge: int = 14
    low_debias: bool = True
    t_snap: bool = True
    thinned: bool = True


CENTERS, MODES = ("centroid", "snap", "best"), ("template", "graph", "hybrid")


# ---------------------------------------------------------------- settings by density

def tiers(cfg: Detector) -> list[Tier]:
    """The settings of each range of branch shares, sparsest first; one tier for all when nothing is scaled."""
    if not cfg.auto_scale:
        return [cfg.base]
    b = cfg.base
    low = replace(
        b, outer=max(min(b.outer, max(2, cfg.low_outer)), 21), nms=max(b.nms, cfg.low_nms, 12), centers=min(max(b.centers, cfg.low_centers), 2),
        bridge=max(b.bridge, cfg.low_bridge), recovery=cfg.low_recovery, endpoint=max(b.endpoint, cfg.low_endpoint), min_score=max(b.min_score, cfg.low_score),
        x_consistency=cfg.low_x_consistency, debias=cfg.low_debias, merge=max(0, cfg.low_merge))
    ultra = replace(low, centers=max(low.centers, 3), bridge=max(low.bridge, 3), endpoint=max(cfg.low_endpoint, 3), min_score=min(low.min_score, 0.12),
                    merge=min(low.merge, 10), hi=VERY_SPARSE)
    moderate = replace(low, x_consistency=False, bridge=max(3, cfg.low_bridge), endpoint=max(0, cfg.low_endpoint), min_score=max(0.0, cfg.low_score),
                       merge=min(low.merge, 12), best_fallback=True, lo=VERY_SPARSE)
    rows = [(replace(ultra, hi=min(VERY_SPARSE, CORNERS)), True), (replace(moderate, hi=CORNERS), True), (replace(moderate, lo=CORNERS, hi=cfg.sparse_ratio), False)]
    out = []
    for t, corner in rows:
        t = replace(t, hi=min(t.hi, cfg.sparse_ratio))
        if corner:
            t = replace(t, corner=True, corner_score=0.05, corner_endpoint=max(t.endpoint, 3))
        if t.lo < t.hi:
            out.append(t)
    return [*out, replace(b, lo=cfg.sparse_ratio)]


def detector_settings(ratios: DataFrame, cfg: Detector = Detector()) -> DataFrame:
    """``ratios(key, branch_ratio, ...)`` with the settings of each tile as columns; a null ratio gets the last tier."""
    names = [n for n in Tier.__dataclass_fields__ if n not in ("lo", "hi")]
    every = tiers(cfg)

    def value(t: Tier) -> Column:
        return F.struct(*[(F.lit(v).cast("double") if n == "corner_score" else F.lit(v)).alias(n) for n, v in ((n, getattr(t, n)) for n in names)])

    pick = value(every[-1])
    for t in reversed(every[:-1]):
        pick = F.when((F.col("branch_ratio") >= t.lo) & (F.col("branch_ratio") < t.hi), value(t)).otherwise(pick)
    return ratios.withColumn("_s", pick).select("*", *[F.col(f"_s.{n}").alias(n) for n in names]).drop("_s")


# ---------------------------------------------------------------- the detector on the pixel graph

GRAPH = ["label", "score", "arm_count", "local_err_t", "local_err_y", "local_ambiguous", "center_source"]


def _reading(source: Column | str) -> list[Column]:
    return ["label", "score", "arm_count", F.col("err_t").alias("local_err_t"), F.col("err_y").alias("local_err_y"), F.col("ambiguous").alias("local_ambiguous"),
            (source if isinstance(source, Column) else F.lit(source)).alias("center_source")]


def _best(px: DataFrame, comps: DataFrame, mids: DataFrame, rules: Rules, centers: int, apart: float, key: str) -> DataFrame:
    found = A.best_centers(px, comps, rules, centers, apart, key)
    if centers == 1:
        return found.select(key, "comp_id", "x", "y", *_reading("best_search"))
    off = F.round(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)), 6)
    first = W.partitionBy(key, "comp_id").orderBy(F.desc("arm_count"), F.round("err", 9), off, "y", "x")      # few centres for each component
    ranked = found.join(shuffled(mids), [key, "comp_id"]).withColumn("_k", F.row_number().over(first))
    return ranked.select(key, "comp_id", "x", "y", *_reading(F.when(F.col("_k") == 1, "best_search").otherwise("best_search_secondary")))


def component_centers(px: DataFrame, comps: DataFrame, rules: Rules = Rules(), center: str = "best", centers: int = 1, apart: float = 5.0,
                      best_fallback: bool = False, key: str = "tile_id") -> DataFrame:
    """One reading, or several, for each branch component -> ``(key, comp_id, x, y, label, score, arm_count, local_*, center_source)``.

    ``best`` looks for the best places in and next to the component; ``centroid`` reads at its rounded mean; ``snap`` at the
    pixel nearest to that. ``best_fallback`` lets the latter two look for the best place where they see no node. Where
    nothing has a label, the component is read as a whole from its mean. Readings of fewer than three arms are left out."""
    mids = C.component_stats(comps, key).select(key, "comp_id", "cx", "cy")
    if center == "best":
        got = cut(_best(px, comps, mids, rules, centers, apart, key))
    else:
        at = mids.select(key, F.col("comp_id").alias("id"), F.bround("cx").cast("int").alias("x"), F.bround("cy").cast("int").alias("y")).withColumn("_src", F.lit("centroid"))
        if center == "snap":
            near = R.snap_to_pixel(at, px, max(2, rules.inner), key)
            at = at.join(shuffled(near), [key, "id"], "left").select(
                key, "id", F.coalesce("sx", "x").alias("x"), F.coalesce("sy", "y").alias("y"), F.when(F.col("sx").isNotNull(), "centroid_snap").otherwise("centroid").alias("_src"))
        at = cut(at)
        read = A.local_geometry(px, at.select(key, "id", "x", "y"), rules=rules, snap=0, key=key)
        got = at.join(shuffled(read), [key, "id"]).select(key, F.col("id").alias("comp_id"), "x", "y", *_reading(F.col("_src")))
        got = got.fillna({"local_err_t": float("inf"), "local_err_y": float("inf")})
        if best_fallback:
            got = cut(got)
            poor = comps.join(shuffled(got.where("label = '' OR arm_count < 3").select(key, "comp_id")), [key, "comp_id"], "left_semi")
            better = _best(px, poor, mids, rules, 1, apart, key).withColumn("center_source", F.lit("centroid_best_fallback"))
            kept = got.join(shuffled(better.select(key, "comp_id")), [key, "comp_id"], "left_anti")
            got = kept.unionByName(better)
        got = cut(got.where("label <> ''"))
    left = comps.join(shuffled(got.select(key, "comp_id")), [key, "comp_id"], "left_anti")
    whole = A.component_arms(px, left, rules, key).where("label <> ''")
    unsure = [F.lit(None).cast("double").alias("local_err_t"), F.lit(None).cast("double").alias("local_err_y"), F.lit(None).cast("boolean").alias("local_ambiguous")]
    whole = whole.select(key, "comp_id", F.bround("x").cast("int").alias("x"), F.bround("y").cast("int").alias("y"), "label", "score", "arm_count", *unsure,
                         F.lit("component_fallback").alias("center_source"))
    return got.unionByName(whole).where("arm_count >= 3")


def weak_pixels(px: DataFrame, branch: DataFrame, support: int = 2, endpoint: int = 10, corner: bool = False, corner_angle: float = 150.0,
                corner_endpoint: int = 0, key: str = "tile_id") -> DataFrame:
    """``(key, y, x, corner)``: pixels where a node may have been missed: near a branch pixel, near an end, or at a corner.

    All tests are made in one pass over blocks of the pixels."""
    reach = [support, endpoint, corner_endpoint if corner else 0]
    halo = max(0, *reach) + 1
    side = reading_side(halo)
    wide = side + 2 * halo
    kernels = {r: [(dy, dx) for dy, k in P.ellipse(2 * r + 1).items() for dx in range(-k, k + 1)] if r > 0 else [(0, 0)] for r in reach}
    turn = [[math.degrees(math.acos(max(-1.0, min(1.0, (ay * by + ax * bx) / (math.sqrt(ay * ay + ax * ax) * math.sqrt(by * by + bx * bx)))))) for by, bx in zip(K.DY, K.DX)] for ay, ax in zip(K.DY, K.DX)]
    sharp_pair = np.array(turn) <= corner_angle
    # Both masks travel to the blocks around them, as places in the dense block. Blocks start a halo before the image.
    masks = px.select(key, "y", "x", F.lit(0).alias("_m")).unionByName(branch.select(key, "y", "x", F.lit(1).alias("_m")))
    for c in "yx":
        masks = masks.withColumn(f"_b{c}", F.explode(F.sequence(F.floor(F.col(c) / F.lit(side)), F.floor((F.col(c) + 2 * halo) / F.lit(side)))))
    at = [(F.col(c) + 2 * halo - F.col(f"_b{c}") * side).cast("bigint") for c in "yx"]
    masks = masks.select(key, "_by", "_bx", (at[0] * wide + at[1]).alias("_at"), "_m")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # A rim of `halo` lets kernels and neighbours reach over the edge; what lies there belongs to other blocks.
        rim = wide + 2 * halo

        def mask(at: np.ndarray) -> np.ndarray:
            out = np.zeros((rim, rim), bool)
            out[at // wide + halo, at % wide + halo] = True
            return out

        def near(seeds: np.ndarray, r: int) -> np.ndarray:
            out, (sy, sx) = np.zeros((rim, rim), bool), np.nonzero(seeds)
            for dy, dx in kernels[r]:
                out[sy + dy, sx + dx] = True
            return out[y, x]

        at, second = rows["_at"].to_numpy(), rows["_m"].to_numpy() == 1
        lit, forks = mask(at[~second]), mask(at[second])
        y, x = np.nonzero(lit)
        around = lit[y[:, None] + K.DY, x[:, None] + K.DX]
        deg, plain = around.sum(1), ~forks[y, x]
        ends = np.zeros((rim, rim), bool)
        ends[y[deg <= 1], x[deg <= 1]] = True
        two = plain & (deg == 2)
        out = plain & (deg >= 2) & (near(forks, support) if support > 0 else True)
        if endpoint > 0:
            out |= two & near(ends, endpoint)
        sharp = np.zeros(len(y), bool)
        if corner:
            pair = np.flatnonzero(deg == 2)
            if len(pair):
                a = around[pair].argmax(1)
                b = 7 - around[pair, ::-1].argmax(1)
                sharp[pair] = sharp_pair[a, b]
            out |= two & sharp & (near(ends, corner_endpoint) if corner_endpoint > 0 else True)
        own = out & (y >= 2 * halo) & (y < 2 * halo + side) & (x >= 2 * halo) & (x < 2 * halo + side)
        top, left = (int(rows[c].iloc[0]) * side - 3 * halo for c in ("_by", "_bx"))
        return pd.DataFrame({key: rows[key].iloc[0], "y": (y[own] + top).astype(np.int32), "x": (x[own] + left).astype(np.int32), "corner": sharp[own]})

    kinds = {c: px.schema[c].dataType.simpleString() for c in (key, "y", "x")}
    return masks.groupBy(key, "_by", "_bx").applyInPandas(run, f"{key} {kinds[key]}, y {kinds['y']}, x {kinds['x']}, corner boolean")


def sparse_recovery(px: DataFrame, branch: DataFrame, dets: DataFrame, rules: Rules = Rules(), nms: int = 5, support: int = 2, endpoint: int = 10,
                    max_area: int = 180, min_score: float = 0.12, corner: bool = False, corner_angle: float = 150.0, corner_endpoint: int = 0,
                    corner_score: float | None = None, key: str = "tile_id") -> DataFrame:
    """Nodes missed among the weak pixels that lie farther than ``nms`` (2 at least) from every detection.

    One place for each group of at most ``max_area`` weak pixels: the best by the arms, if it scores enough; a group with a
    corner may need less. Columns as in ``component_centers``, and ``area``."""
    weak = weak_pixels(px, branch, support, endpoint, corner, corner_angle, corner_endpoint, key)
    free = cut(radius_anti_join(weak, dets, float(max(2, nms)), [key]))
    groups = cut(C.components(free, key=key))
    facts = groups.groupBy(key, "comp_id").agg(F.count(F.lit(1)).alias("area"), F.max("corner").alias("corner")).where(F.col("area") <= max_area)
    small = groups.join(shuffled(facts.select(key, "comp_id")), [key, "comp_id"], "left_semi").select(key, "y", "x", "comp_id")
    found = A.best_centers(px, small, rules, key=key).join(shuffled(facts), [key, "comp_id"])
    need = F.lit(min_score) if corner_score is None else F.when(F.col("corner"), min(min_score, corner_score)).otherwise(min_score)
    source = F.when(F.col("corner"), "sparse_recovery_corner").otherwise("sparse_recovery")
    good = found.where(F.col("label").isin("T", "Y", "X") & (F.col("arm_count") >= 3) & (F.col("score") >= need))
    return good.select(key, "comp_id", "x", "y", *_reading(source), "area")


def graph_detections(px: DataFrame, cfg: Detector = Detector(), tier: Tier = Tier(), key: str = "tile_id") -> DataFrame:
    """Nodes of a thinned network: centres of branch components, what they missed, one row for each place and label."""
    rules = replace(cfg.rules, outer=tier.outer, bridge=tier.bridge)
    shape = cut(link_endpoints(px, key=key)) if cfg.repair else px
    branch = cut(P.branch_pixels(shape, max(3, cfg.branch_degree), key))
    comps = cut(C.components(branch.select(key, "y", "x"), key=key))
    stats = C.component_stats(comps, key).select(key, "comp_id", "area").where(F.col("area") >= max(1, cfg.min_area))
    if cfg.min_area > 1:
        comps = comps.join(shuffled(stats.select(key, "comp_id")), [key, "comp_id"], "left_semi")
    fallback = tier.best_fallback and tier.recovery
    found = component_centers(px, comps, rules, cfg.center, tier.centers, float(max(1, tier.nms)), fallback, key).join(shuffled(stats), [key, "comp_id"])
    if tier.recovery:
        found = cut(found)
        found = found.unionByName(sparse_recovery(
            px, branch, found, rules, tier.nms, cfg.support, tier.endpoint, cfg.max_area, tier.min_score, tier.corner, cfg.corner_angle, tier.corner_endpoint,
            tier.corner_score, key))
    rows = found.withColumns({"id": F.xxhash64("center_source", "comp_id", "y", "x"), "source_kind": F.lit("graph")})
    rows = cut(rows.select(key, "id", "x", "y", *GRAPH, "area", "source_kind"))
    return cluster_nms(rows, tier.nms, [key]).drop("cluster_size", "cluster_source_kinds")


def template_detections(px: DataFrame, bank: Sequence, cfg: Detector = Detector(), tier: Tier = Tier(), key: str = "tile_id") -> DataFrame:
    """Matches of the template bank: one for each place, near branch pixels only if asked, and with three arms or more."""
    raw = fusion.template_scan(px, bank, cfg.match, key=key)
    raw = cut(raw.withColumns({"id": F.xxhash64("label", "y", "x"), "source_kind": F.lit("template")}))
    one = cut(cluster_nms(raw, tier.nms, [key]).drop("cluster_size", "cluster_source_kinds"))
    one = cluster_nms(one, tier.nms, [key], respect_label=False).drop("cluster_size", "cluster_source_kinds")
    if cfg.topology_gate:
        one = C.topology_gate(px, one, cfg.gate_radius, key)
    return A.validate_detections(one, px, replace(cfg.rules, outer=tier.outer), key)


# ---------------------------------------------------------------- corrections that look at the density

def x_evidence(dets: DataFrame, px: DataFrame, outers: Sequence[int] = (15, 19, 23), max_four: int = 1, min_three: int = 2, rules: Rules = Rules(),
               key: str = "tile_id") -> DataFrame:
    """X rows with what each radius sees: ``x_four, x_three, x_major, x_votes``; weak ones become T or Y, marked in ``post``."""
    g = A.local_geometry(px, dets.where("label = 'X'").select(key, "id", "x", "y"), outers, rules, key=key)
    three = (F.col("arm_count") == 3) & F.col("label").isin("T", "Y")
    votes = g.groupBy(key, "id").agg(F.count_if(F.col("arm_count") >= 4).cast("int").alias("x_four"), F.count_if(three).cast("int").alias("x_three"),
                                     F.count_if(three & (F.col("label") == "T")).cast("int").alias("_t"), F.count_if(three & (F.col("label") == "Y")).cast("int").alias("_y"))
    major = F.when(F.col("x_three") == 0, "").when(F.col("_t") > F.col("_y"), "T").otherwise("Y")
    votes = votes.select(key, "id", "x_four", "x_three", major.alias("x_major"), F.greatest("_t", "_y").alias("x_votes"))
    won = F.coalesce((F.col("label") == "X") & (F.col("x_four") <= max_four) & (F.col("x_votes") >= min_three), F.lit(False))
    out = dets.drop("x_four", "x_three", "x_major", "x_votes").join(shuffled(votes), [key, "id"], "left")
    return out.withColumns({"post": F.when(won, "x_consistency").otherwise(F.col("post")), "label": F.when(won, F.col("x_major")).otherwise(F.col("label"))})


def sparse_bias_relabel(dets: DataFrame, moderate: float = VERY_SPARSE, y_lead: float = 2.0, weak_score: float = 0.01, key: str = "tile_id") -> DataFrame:
    """Drops and relabels weak rows of sparse scenes; ``bias_reason`` tells why a label changed, 'keep' otherwise.

    ``dets`` carries ``branch_ratio`` of its tile and the columns of the detector: ``label, score, source_kind, center_source,
    arm_count, area, local_*, x_*, post, arm_count_29, label_29``. Nulls read as 0 in counts and as ambiguous."""
    def whole(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.coalesce(F.bround(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)).cast("int"), F.lit(0))

    def number(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    label, source, post = F.col("label"), F.coalesce("center_source", F.lit("")), F.coalesce("post", F.lit(""))
    graph = F.lower(F.trim(F.coalesce("source_kind", F.lit(""))))
    score, err_t, err_y = number("score"), number("local_err_t"), number("local_err_y")
    four, three, votes, arm_count, area = (whole(c) for c in ("x_four", "x_three", "x_votes", "arm_count", "area"))
    major = F.upper(F.trim(F.coalesce("x_major", F.lit(""))))
    unsure = F.coalesce("local_ambiguous", F.lit(True))
    ratio = number("branch_ratio")
    ultra, mid = sure(ratio < moderate), sure(ratio >= moderate)
    wing = graph.isin("graph", "hybrid")
    ty = major.isin("T", "Y")
    fallback, corner = source == "component_fallback", source == "sparse_recovery_corner"

    gone = (graph == "graph") & fallback & sure(score < weak_score)
    thin_x = mid & (four <= 3) & (three <= 1)
    gone = gone | (wing & (label == "X") & thin_x & corner & (arm_count >= 4) & (area >= 3))
    gone = gone | (wing & (label == "Y") & mid & (source == "centroid") & (arm_count == 3) & sure(score < 0.03) & sure(err_y > 120.0))

    def to(name: str, why: str) -> Column:
        return F.struct(F.lit(name).alias("to"), F.lit(why).alias("why"))

    to_major = F.struct(major.alias("to"), F.lit("").alias("why"))

    def by_major(why: str) -> Column:
        return F.struct(to_major["to"].alias("to"), F.lit(why).alias("why"))

    keep = F.struct(label.alias("to"), F.lit("keep").alias("why"))
    x_way = (
        F.when(thin_x, F.when(ty & (votes >= 1), by_major("moderate_weak_x_vote")).otherwise(to("Y", "moderate_weak_x")))
        .when((four <= 2) & (three >= 1) & ty & (votes >= 1), by_major("three_arm_majority"))
        .when((four <= 1) & (three <= 1), to("Y", "weak_support"))
        .when(fallback & (four <= 1), to("Y", "weak_fallback"))
        .when((four <= 1) & (votes >= 1) & ty, F.when((major == "T") & unsure, to("Y", "weak_t_vote")).otherwise(by_major("weak_majority")))
        .otherwise(keep))
    seen = number("arm_count_29")
    weak_three = seen.isNull() | (F.bround(seen) != 3) | ~F.upper(F.trim(F.coalesce("label_29", F.lit("")))).isin("T", "Y")
    flagged = unsure | fallback | err_t.isNull() | err_y.isNull() | sure(err_y + y_lead < err_t)
    strong = corner & sure(score >= 0.9) & ~unsure
    t_way = (
        F.when(mid & (post == "x_consistency") & source.isin("sparse_recovery_corner", "sparse_recovery") & (arm_count >= 4), to("Y", "moderate_x_t"))
        .when(mid & (source == "centroid") & (arm_count == 3) & sure(score < 0.02), to("Y", "moderate_low_score_t"))
        .when(weak_three & flagged & ~strong, to("Y", "weak_t")).otherwise(keep))
    y_way = (
        F.when(ultra & (post == "x_consistency") & (arm_count >= 4), to("T", "very_sparse_x_y"))
        .when(ultra & corner & (arm_count == 3) & sure((score <= 0.08) & (err_t <= 100.0) & (err_y <= 40.0)) & ~unsure, to("T", "very_sparse_corner_y"))
        .otherwise(keep))
    verdict = F.when(wing & (label == "X"), x_way).when(wing & (label == "T"), t_way).when(wing & (label == "Y"), y_way).otherwise(keep)
    out = dets.where(~F.coalesce(gone, F.lit(False))).withColumn("_v", verdict)
    changed = F.col("_v.to").isin("T", "Y", "X") & (F.col("_v.to") != label)
    return out.withColumns({"bias_reason": F.col("_v.why"), "post": F.when(changed, "sparse_bias").otherwise(F.col("post")),
                            "label": F.when(changed, F.col("_v.to")).otherwise(label)}).drop("_v")


def sparse_t_snap(dets: DataFrame, px: DataFrame, rules: Rules = Rules(), reach: int = 8, moderate: float = VERY_SPARSE, min_votes: int = 3,
                  min_three: int = 3, max_four: int = 1, key: str = "tile_id") -> DataFrame:
    """In very sparse scenes a Y whose circles saw a T moves to the pixel nearby that reads best as a T, and becomes one.

    Best: highest score, least T error, nearest, then upper and left. ``dets`` carries ``branch_ratio`` and the ``x_*``
    columns. Equal places are searched once, and pixels are read once however many rows look at them."""
    asked = (
        (F.col("label") == "Y") & F.lower(F.trim("source_kind")).isin("graph", "hybrid") & (F.col("branch_ratio") < moderate) & (F.col("x_major") == "T")
        & (F.col("x_votes") >= max(1, min_votes)) & (F.col("x_three") >= max(1, min_three)) & (F.col("x_four") <= max(0, max_four)))
    places = cut(dets.where(asked).select(key, "x", "y").distinct())
    near = cut(box_join(px.select(key, "x", "y"), places, -reach, reach, [key]).select(
        key, F.col("x_b").alias("px"), F.col("y_b").alias("py"), F.col("x_a").alias("x"), F.col("y_a").alias("y"), "d2"))
    spots = near.select(key, "x", "y").distinct().withColumn("id", P.line_key())
    read = A.local_geometry(px, spots, rules=rules, snap=0, key=key).where("label = 'T' AND arm_count >= 3").select(key, "id", "score", "err_t")
    tee = near.withColumn("id", P.line_key()).join(shuffled(read), [key, "id"])
    rank = F.struct((-F.col("score")).alias("s"), F.col("err_t").alias("e"), "d2", F.col("y").alias("ny"), F.col("x").alias("nx"))
    best = tee.groupBy(key, "px", "py").agg(F.min(rank).alias("b")).select(key, F.col("px").alias("x"), F.col("py").alias("y"), F.col("b.nx").alias("_nx"), F.col("b.ny").alias("_ny"))
    hit = F.col("_nx").isNotNull() & F.coalesce(asked, F.lit(False))
    return dets.join(shuffled(best), [key, "x", "y"], "left").withColumns({
        "_hit": hit}).withColumns({"label": F.when(F.col("_hit"), "T").otherwise(F.col("label")), "post": F.when(F.col("_hit"), "sparse_t_snap").otherwise(F.col("post")),
                                   "x": F.when(F.col("_hit"), F.col("_nx")).otherwise(F.col("x")), "y": F.when(F.col("_hit"), F.col("_ny")).otherwise(F.col("y"))}).select(*dets.columns)


# ---------------------------------------------------------------- all of it

COLUMNS = ["id", "x", "y", *GRAPH, "area", "source_kind"]
EXTRA = {"post": "string", "arm_count_29": "int", "label_29": "string", "x_four": "int", "x_three": "int", "x_major": "string", "x_votes": "int"}


def _tier_detect(px: DataFrame, ratios: DataFrame, cfg: Detector, tier: Tier, bank: Sequence | None, key: str) -> DataFrame:
    rules = replace(cfg.rules, outer=tier.outer)
    graph = cut(graph_detections(px, cfg, tier, key)) if cfg.mode != "template" else None
    template = cut(template_detections(px, bank, cfg, tier, key)) if cfg.mode != "graph" else None
    if cfg.mode == "graph":
        found = graph
    elif cfg.mode == "template":
        found = template
    elif cfg.conflict_aware:
        settled = fusion.fuse_sources(graph, template, px, float(tier.nms), rules, key)
        detail = graph.withColumn("id", F.xxhash64("source_kind", "id")).select(key, "id", *[c for c in (*GRAPH, "area") if c not in ("label", "score")])
        found = settled.join(shuffled(detail), [key, "id"], "left")
    else:
        found = fusion.fuse_simple(_full(graph, key), _full(template, key), float(tier.nms), key).drop("cluster_size", "cluster_source_kinds")
    found = _full(found, key)
    if cfg.t_to_y or cfg.y_to_t:
        seen = A.local_recheck(found.withColumnRenamed("local_ambiguous", "_sure"), px, cfg.t_to_y, cfg.y_to_t, rules, key)
        found = seen.withColumn("local_ambiguous", F.coalesce("local_ambiguous", "_sure")).drop("_sure", "local_label", "local_arm_count")
    if cfg.vote:
        found = A.multiradius_vote(cut(found), px, cfg.vote_outers, rules=rules, key=key)
    if cfg.feature_tree or cfg.structural_tree:
        rich = fusion.radius_features(cut(found.drop("arm_count_29", "label_29")), px, key=key)
        if cfg.feature_tree:
            rich = fusion.tree_rule(rich, cfg.feature_tree)
        if cfg.structural_tree:
            shares = ratios.select(key, F.col("branch_ratio").alias("_share"))
            rich = A.structural_relabel(rich.join(shares, key), cfg.structural_tree, branch_ratio="_share" if cfg.auto_scale else None)
        found = rich.select(key, *COLUMNS, *EXTRA)
    if tier.x_consistency:
        found = x_evidence(cut(found), px, cfg.x_outers, rules=replace(rules, bridge=tier.bridge), key=key)
    shares = ratios.select(key, F.col("branch_ratio") if cfg.auto_scale else F.lit(None).cast("double").alias("branch_ratio"))
    found = cut(found.select(key, *COLUMNS, *EXTRA).join(shares, key))
    if tier.debias:
        found = cut(sparse_bias_relabel(found, key=key).drop("bias_reason"))
    if cfg.t_snap and cfg.auto_scale and tier.lo < VERY_SPARSE:
        found = cut(sparse_t_snap(found, px, replace(rules, bridge=tier.bridge), key=key))
    if tier.merge > 0:
        found = cluster_nms(found, float(tier.merge), [key], respect_label=False)
    return found.select(key, *COLUMNS, "post", "branch_ratio")


def _full(dets: DataFrame, key: str) -> DataFrame:
    """The columns of the detector, null where a source does not have them."""
    kinds = {"arm_count": "int", "local_err_t": "double", "local_err_y": "double", "local_ambiguous": "boolean", "center_source": "string", "area": "bigint", **EXTRA}
    missing = [F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in dets.columns]
    return dets.select("*", *missing).select(key, *COLUMNS, *EXTRA)


def detect(px: DataFrame, cfg: Detector = Detector(), bank: Sequence | None = None, key: str = "tile_id") -> DataFrame:
    """``px(key, y, x)`` -> ``(key, id, x, y, label, score, arm_count, local_*, center_source, area, source_kind, post, branch_ratio)``.

    ``bank`` (template and hybrid mode) is a short list of (label, array). A tile without a pixel has no rows."""
    if cfg.mode not in MODES or cfg.center not in CENTERS:
        raise ValueError(f"mode is one of {MODES} and center one of {CENTERS}")
    if cfg.mode != "graph" and not bank:
        raise ValueError("template and hybrid mode need templates")
    net = cut(px.select(key, "y", "x").distinct() if cfg.thinned else thin(px.select(key, "y", "x").distinct(), key))
    ratios = cut(P.branch_ratio(net, key).select(key, "branch_ratio"))
    if not cfg.auto_scale:
        return _tier_detect(net, ratios, cfg, cfg.base, bank, key)

    def one(tier: Tier) -> DataFrame | None:
        mine = ratios.where((F.col("branch_ratio") >= tier.lo) & (F.col("branch_ratio") < tier.hi))
        if is_empty(mine):
            return None
        return _tier_detect(cut(net.join(mine.select(key), key, "left_semi")), mine, cfg, tier, bank, key)

    # The tiers are few and do not depend on one another, so their jobs run side by side.
    every = tiers(cfg)
    with ThreadPoolExecutor(len(every)) as pool:
        parts = [p for p in pool.map(one, every) if p is not None]
    return reduce(DataFrame.unionByName, parts or [_tier_detect(net, ratios, cfg, cfg.base, bank, key)])
