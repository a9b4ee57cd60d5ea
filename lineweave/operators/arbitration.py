"""From several heads' answers to one label for each row, then to one label for each place.

Rows carry ``{head}_pred``, ``{head}_prob_{N,T,X,Y}``, ``consensus``, ``agreement``, the geometry columns
(``geometry_label, branch_count, min_gap_deg, max_gap_deg``) and the proposal columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.functions import votes as V
from lineweave.operators.spatial import nms, radius_clusters


@dataclass(frozen=True)
class Settings:
    """Switches of the ladder. 0 turns a numeric rule off."""

    x_mode: str = "veto"
    t_min_gap_floor: float = 0.0
    rescue_max_gap: float = 0.0
    rescue_min_gap_floor: float = 0.0
    rescue_min_agreement: int = 0
    rescue_segment_two_arm: bool = False
    endpoint_mode: str = "allow"            # allow | rescue_only | veto
    positive_only: bool = False
    virtual_t_min_agreement: int = 0
    drop_border_virtual: bool = False
    gate: float = 0.50
    virtual_gate: float = 0.60
    border_virtual_gate: float = 0.70
    geometry_voter: bool = True
    t_min_gap: tuple[float, float] = (75.0, 95.0)
    t_max_gap: tuple[float, float] = (155.0, 205.0)
    y_min_gap: float = 100.0


def with_votes(df: DataFrame, heads: Sequence[str] = V.HEADS) -> DataFrame:
    """Adds the plain vote: consensus, agreement and their raw copies."""
    votes = [F.col(f"{h}_pred") for h in heads]
    v = V.consensus(votes)
    return df.withColumn("_v", v).withColumns({
        "consensus": F.col("_v.label"), "agreement": F.col("_v.n"), "raw_consensus": F.col("_v.label"),
        "raw_agreement": F.col("_v.n"), "raw_x_votes": V.raw_x_votes(votes),
    }).drop("_v")


def synthesis_filter(df: DataFrame, x_mode: str = "veto", heads: Sequence[str] = V.HEADS) -> DataFrame:
    """Settle ``consensus`` from votes, geometry and origin, one staged column at a time.

    Fewer than three agreeing heads count as weak. A weak T from a virtual bridge never survives (its
    trust rule asks for three), a weak Y only with the boosted-tree head behind it."""
    votes = [F.col(f"{h}_pred") for h in heads]
    voted = F.array(*votes)
    blocked = F.lit(V.bars_x(x_mode))
    c, geo = F.col("consensus"), F.col("geometry_label")
    weak, virtual = F.col("agreement") < 3, V.is_virtual()
    trusted_y = (c == "Y") & (F.col("xgb_pred") == "Y") & (F.col("agreement") >= 2) & (geo != "T")
    stages = [
        F.when(blocked & (c == "X"), V.second_best(votes)).otherwise(c),
        F.when(c.isin("Y", "X") & (geo == "T"), "T").when((c == "T") & (geo != "T"), "Y").otherwise(c),
        F.when(virtual & weak & c.isin("T", "X", "Y") & ~trusted_y, "N")
        .when(virtual & blocked & (c == "X"), "N").otherwise(c),
        F.when(F.col("border_flag") & weak & c.isin("T", "X", "Y"), "N").otherwise(c),
        F.when(blocked & (F.col("_raw") == "X") & (c == "T"),
               F.when(F.array_contains(voted, "Y"), "Y").when(F.array_contains(voted, "N"), "N").otherwise("Y")).otherwise(c),
        F.when((F.col("proposal_source") == "base_topology") & (c == "Y") & (F.col("xgb_pred") != "Y"), "N").otherwise(c),
        F.when((c == "Y") & F.forall(voted, lambda v: v == "T"), "T").otherwise(c),
    ]
    out = df.withColumn("_raw", c)
    for stage in stages:
        out = out.withColumn("consensus", stage)
    return out.drop("_raw")


def curved_t(cfg: Settings) -> Column:
    """The wide-gap signature that lets a row count as a (curved) T."""
    if cfg.rescue_max_gap <= 0:
        return F.lit(False)
    ok = (V.row_agreement() >= cfg.rescue_min_agreement) & F.coalesce(F.col("max_gap_deg") > cfg.rescue_max_gap, F.lit(False))
    if cfg.rescue_min_gap_floor > 0:
        ok = ok & F.coalesce(F.col("min_gap_deg") >= cfg.rescue_min_gap_floor, F.lit(False))
    return ok


def ty_arbitrate(df: DataFrame, cfg: Settings) -> DataFrame:
    """Demote narrow T rows to Y, rescue wide Y rows to T, then apply the endpoint-to-endpoint policy."""
    out, c = df, F.col("consensus")
    if cfg.t_min_gap_floor > 0:
        narrow = F.coalesce(F.col("min_gap_deg") < cfg.t_min_gap_floor, F.lit(True))
        out = out.withColumn("consensus", F.when((c == "T") & narrow, "Y").otherwise(c))
    rescue = curved_t(cfg)
    if cfg.rescue_segment_two_arm:
        rescue = rescue | (
            (F.col("proposal_type") == "virtual_gap_endpoint_segment") & (F.col("geometry_label") == "Unknown")
            & (F.col("branch_count") == 2) & (V.row_agreement() >= cfg.rescue_min_agreement))
    out = out.withColumn("consensus", F.when((c == "Y") & rescue, "T").otherwise(c))
    if cfg.endpoint_mode != "allow":
        spared = curved_t(cfg) if cfg.endpoint_mode == "rescue_only" else F.lit(False)
        hit = (c == "T") & (F.col("proposal_type") == "virtual_gap_endpoint_endpoint") & ~spared
        out = out.withColumn("consensus", F.when(hit, "Y").otherwise(c))
    return out


def output_filters(df: DataFrame, cfg: Settings) -> DataFrame:
    drop = F.lit(False)
    if cfg.positive_only:
        drop = drop | (F.col("consensus") == "N")
    if cfg.virtual_t_min_agreement > 0:
        drop = drop | (V.is_virtual() & (F.col("consensus") == "T") & (V.row_agreement() < cfg.virtual_t_min_agreement))
    if cfg.drop_border_virtual:
        drop = drop | (V.is_virtual() & F.col("border_flag"))
    return df.where(~F.coalesce(drop, F.lit(False)))


def geometry_vote(cfg: Settings) -> Column:
    lo, hi = F.col("min_gap_deg"), F.col("max_gap_deg")
    known = (F.col("branch_count") == 3) & lo.isNotNull() & hi.isNotNull()
    return F.when(known & hi.between(*cfg.t_max_gap) & lo.between(*cfg.t_min_gap), "T").when(known & (lo >= cfg.y_min_gap), "Y")


def label_by_head(df: DataFrame, head: str, cascade: bool, cfg: Settings) -> DataFrame:
    """Label rows by one head alone, either by its best class or by gate first and type second."""
    probs = V.head_probs(head)
    pred = F.col(f"{head}_pred")
    if not cascade:
        label = V.choose_label(probs, cfg.x_mode)["label"]
        out = df.withColumns({"_label": label, "gate_prob_positive": F.lit(None).cast("double"),
                              "gate_threshold_used": F.lit(None).cast("double"), "gate_decision": F.lit(""),
                              "geometry_vote": F.lit(""), "geometry_vote_applied": F.lit("")})
    else:
        gated = df.withColumns({
            "gate_prob_positive": V.gate_probability(probs),
            "gate_threshold_used": V.gate_threshold(V.is_virtual(), F.col("border_flag"), cfg.gate, cfg.virtual_gate,
                                                    cfg.border_virtual_gate),
        })
        accept = F.col("gate_prob_positive") >= F.col("gate_threshold_used")
        kind = V.choose_label(probs, cfg.x_mode, ("T", "Y", "X"))["label"]
        vote = geometry_vote(cfg) if cfg.geometry_voter else F.lit(None).cast("string")
        out = gated.withColumns({
            "gate_decision": F.when(accept, "accept").otherwise("reject"), "_kind": F.when(accept, kind).otherwise("N"), "_vote": vote,
        })
        counted = F.col("_kind").isin("T", "Y") & F.col("_vote").isNotNull()
        out = out.withColumns({
            "geometry_vote": F.when(counted, F.col("_vote")).otherwise(""),
            "geometry_vote_applied": F.when(counted & (F.col("_vote") != F.col("_kind")), "override").otherwise(""),
            "_label": F.when(counted, F.col("_vote")).otherwise(F.col("_kind")),
        }).drop("_kind", "_vote")
    raw = F.coalesce(F.nullif(F.trim(pred), F.lit("")), F.col("_label"))
    return out.withColumns({
        "consensus": F.col("_label"), "raw_consensus": raw, "raw_agreement": F.lit(1),
        "agreement": F.when(F.col("_label") == "N", 0).otherwise(1), "raw_x_votes": (raw == "X").cast("int"),
    }).drop("_label")


def keep_or_drop_n(df: DataFrame, as_y: bool = False) -> DataFrame:
    if as_y:
        return df.withColumn("consensus", F.when(F.col("consensus") == "N", "Y").otherwise(F.col("consensus")))
    return df.where(F.col("consensus") != "N")


# ---------------------------------------------------------------- decisions across rows of a place

def mixed_cluster_arbitrate(df: DataFrame, r: float, by: Sequence[str], cfg: Settings) -> DataFrame:
    """Where T and Y rows lie in one cluster, T becomes Y unless it bears the wide-gap signature."""
    if r <= 0:
        return df
    ty = F.col("consensus").isin("T", "Y") & V.has_xy()
    clustered = radius_clusters(df.where(ty).select(*by, "id", "x", "y", "consensus"), r, by)
    mixed = clustered.groupBy(*by, "cluster_id").agg(F.count_if(F.col("consensus") == "T").alias("_t"),
                                                     F.count_if(F.col("consensus") == "Y").alias("_y"))
    hit = (
        clustered.where("consensus = 'T'").join(mixed.where("_t > 0 AND _y > 0"), [*by, "cluster_id"], "left_semi")
        .select(*by, "id", F.lit(True).alias("_hit"))
    )
    c = F.col("consensus")
    return (
        df.join(hit, [*by, "id"], "left")
        .withColumn("consensus", F.when(F.col("_hit") & (c == "T") & ~curved_t(cfg), "Y").otherwise(c))
        .select(*df.columns)
    )


def same_label_nms(df: DataFrame, r: float, by: Sequence[str]) -> DataFrame:
    """Suppress weaker rows of the same label within ``r``; N rows and rows without a place always stay."""
    if r <= 0:
        return df
    subject = F.coalesce(F.col("consensus").isin("T", "X", "Y") & V.has_xy(), F.lit(False))
    kept = nms(df.where(subject), r, [*by, "consensus"], [-V.row_agreement(), -V.row_score()], inclusive=True)
    return df.where(~subject).unionByName(kept)


def cluster_arbitrate(df: DataFrame, r: float, by: Sequence[str], x_mode: str = "veto",
                      prefix: str = "avg_prob") -> DataFrame:
    """One answer for each cluster: the class with the best mean probability, kept by the row that backs it most."""
    if r <= 0:
        return df
    placed = V.has_xy()
    core = df.where(placed).select(*by, "id", "x", "y", *[f"{prefix}_{c}" for c in V.CLASSES])
    clustered = radius_clusters(core, r, by)

    def backer(p: Column) -> Column:
        return F.min(F.struct((-p).alias("s"), F.col("id")))

    # The row that backs each class most is read with the means, so rows meet the answer of their cluster once.
    means = clustered.groupBy(*by, "cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), backer(F.lit(0.0)).alias("_w"),
        *[F.coalesce(F.avg(F.nanvl(f"{prefix}_{c}", F.lit(None))), F.lit(0.0)).alias(f"_m_{c}") for c in V.CLASSES],
        *[backer(F.coalesce(f"{prefix}_{c}", F.lit(0.0))).alias(f"_w_{c}") for c in V.CLASSES])
    best = V.choose_label({c: F.col(f"_m_{c}") for c in V.CLASSES}, x_mode)
    winner = F.coalesce(*[F.when(F.col("_b.label") == c, F.col(f"_w_{c}.id")) for c in V.CLASSES], F.col("_w.id"))
    verdict = means.withColumn("_b", best).select(*by, "cluster_id", "cluster_size", F.col("_b.label").alias("cluster_label"),
                                                  F.col("_b.p").alias("cluster_score"), winner.alias("_w"))
    marked = clustered.join(verdict, [*by, "cluster_id"]).select(
        *by, "id", "cluster_id", "cluster_size", "cluster_label", "cluster_score", (F.col("_w") == F.col("id")).alias("_win"))
    joined = df.join(marked, [*by, "id"], "left")
    support_n = F.greatest(F.lit(1), F.bround(F.col("cluster_score") * 4.0).cast("int"))
    return joined.withColumns({
        "consensus": F.when(F.col("_win"), F.col("cluster_label")).when(~F.col("_win"), "N").otherwise(F.col("consensus")),
        "agreement": F.when(F.col("_win"), support_n).when(~F.col("_win"), 0).otherwise(F.col("agreement")),
    }).drop("_win")


def meta_override(df: DataFrame, x_mode: str = "veto", min_conf: float = 0.0, force: bool = False) -> DataFrame:
    """Replace the label by that of a meta model (``meta_prob_*``) where it is sure enough."""
    best = V.choose_label(V.head_probs("meta"), x_mode)
    sure = (F.lit(force) | (F.col("meta_confidence") >= V.unit(F.lit(float(min_conf))))) & (F.col("consensus") != "ERROR")
    support = F.greatest(F.lit(1), F.bround(F.col("meta_confidence") * 4.0).cast("int"))
    return (
        df.withColumn("_m", best)
        .withColumns({"meta_pred": F.col("_m.label"), "meta_confidence": F.col("_m.p")})
        .withColumn("_sure", sure)
        .withColumns({"consensus": F.when(F.col("_sure"), F.col("meta_pred")).otherwise(F.col("consensus")),
                      "agreement": F.when(F.col("_sure"), support).otherwise(F.col("agreement"))})
        .drop("_m", "_sure")
    )
