"""Radius joins, suppression, clustering and matching of points.

All of them work on distinct locations first: copies at one place are folded into one row before any
pair is formed, so a place that holds a third of all rows costs no more than any other place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineweave.operators.graph import components
from lineweave.operators.ranks import dense_rank, running_total
from lineweave.session import cut, is_empty, shuffled


def _suffixed(df: DataFrame, by: Sequence[str], suffix: str) -> DataFrame:
    return df.select(*by, *[F.col(c).alias(c + suffix) for c in df.columns if c not in by])


def _cell(c: Column, r: float) -> Column:
    return F.floor(c / F.lit(2.0 * r))


def _span(df: DataFrame, x: str, y: str, r: float) -> DataFrame:
    """Copy each row to every grid cell (side 2r) that its disk touches: at most 4 cells."""
    xs = F.sequence(_cell(F.col(x) - F.lit(r), r), _cell(F.col(x) + F.lit(r), r))
    ys = F.sequence(_cell(F.col(y) - F.lit(r), r), _cell(F.col(y) + F.lit(r), r))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def _within(r: float, inclusive: bool) -> Column:
    d2 = _d2()
    return d2 <= F.lit(float(r) ** 2) if inclusive else d2 < F.lit(float(r) ** 2)


def _d2() -> Column:
    dx = F.col("x_a").cast("double") - F.col("x_b")
    dy = F.col("y_a").cast("double") - F.col("y_b")
    return dx * dx + dy * dy


def radius_join(a: DataFrame, b: DataFrame, r: float, by: Sequence[str], inclusive: bool = True,
                how: str = "inner") -> DataFrame:
    """Pairs of rows within ``r`` that share ``by``.

    Columns of the two sides get ``_a`` and ``_b``; ``d2`` is the squared distance. ``b`` is the side
    that is copied to neighbouring cells, so pass the smaller table there."""
    left = _suffixed(a, by, "_a").withColumn("_cx", _cell(F.col("x_a"), r)).withColumn("_cy", _cell(F.col("y_a"), r))
    right = _span(_suffixed(b, by, "_b"), "x_b", "y_b", r)
    keys = [*by, "_cx", "_cy"]
    right = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    cond = _within(r, inclusive)
    for i, k in enumerate(keys):
        cond = cond & (F.col(k) == F.col(f"_r{i}"))
    out = left.join(shuffled(right), cond, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_cx", "_cy")
    return out.withColumn("d2", _d2()).drop("_cx", "_cy", *[f"_r{i}" for i in range(len(keys))])


def radius_semi_join(a: DataFrame, b: DataFrame, r: float, by: Sequence[str], inclusive: bool = True,
                     how: str = "left_semi") -> DataFrame:
    """Rows of ``a`` with some ``b`` within ``r``."""
    places = b.select(*by, "x", "y").distinct()
    out = radius_join(a, places, r, by, inclusive, how=how)
    return out.select(*[F.col(c) if c in by else F.col(c + "_a").alias(c) for c in a.columns])


def radius_anti_join(a: DataFrame, b: DataFrame, r: float, by: Sequence[str], inclusive: bool = True) -> DataFrame:
    """Rows of ``a`` with no ``b`` within ``r``."""
    return radius_semi_join(a, b, r, by, inclusive, how="left_anti")


# ---------------------------------------------------------------- suppression

def nms(df: DataFrame, r: float, by: Sequence[str], order: Sequence[Column], inclusive: bool = False,
        id_col: str = "id") -> DataFrame:
    """Greedy suppression: best first, drop everything within ``r`` of a kept row.

    ``order`` ranks rows, least first; ``id_col`` (unique inside ``by``) breaks ties. Each round keeps
    every row that no undecided neighbour outranks and drops its neighbours, which gives the same rows as the
    one-by-one walk because the order is total."""
    if r <= 0:
        return df
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"))
    best = cut(df.select(*by, "x", "y", rank.alias("rank")).groupBy(*by, "x", "y").agg(F.min("rank").alias("rank")))
    pairs = radius_join(best, best, r, by, inclusive).where(F.col("rank_a") < F.col("rank_b"))
    live = cut(pairs.select(*by, F.col("rank_a.id").alias("win"), F.col("rank_b.id").alias("lose")))
    gone: list[DataFrame] = []
    while not is_empty(live):
        losers = live.select(*by, F.col("lose").alias("win")).distinct()
        out = cut(live.join(shuffled(losers), [*by, "win"], "left_anti").select(*by, "lose").distinct())
        gone.append(out)
        live = cut(
            live.join(shuffled(out), [*by, "lose"], "left_anti")
            .join(shuffled(out.withColumnRenamed("lose", "win")), [*by, "win"], "left_anti")
        )
    kept = best.select(*by, F.col("rank.id").alias(id_col))
    if gone:
        kept = kept.join(shuffled(reduce(DataFrame.unionByName, gone).withColumnRenamed("lose", id_col)), [*by, id_col], "left_anti")
    return df.join(shuffled(kept), [*by, id_col], "left_semi").select(*df.columns)


# ---------------------------------------------------------------- clusters

def radius_clusters(df: DataFrame, r: float, by: Sequence[str], id_col: str = "id") -> DataFrame:
    """Single-link groups: adds ``cluster_id``, the least ``id_col`` of the group.

    Points closer than r are linked. A grid cell whose diagonal is r holds one group by itself, so
    the graph has one node per occupied cell, not one per point."""
    side = r / 2 ** 0.5 * (1 - 1e-12)
    cell = F.struct(*[F.col(c) for c in by], F.floor(F.col("x") / F.lit(side)).alias("gx"),
                    F.floor(F.col("y") / F.lit(side)).alias("gy"))
    places = cut(df.select(*by, "x", "y", cell.alias("cell")).distinct())
    pairs = radius_join(places, places, r, by, inclusive=True).where(F.col("cell_a") < F.col("cell_b"))
    groups = components(pairs.select(F.col("cell_a").alias("u"), F.col("cell_b").alias("v")))
    tagged = (
        df.withColumn("_cell", cell)
        .join(shuffled(groups.withColumnRenamed("node", "_cell")), "_cell", "left")
        .withColumn("_comp", F.coalesce("comp", "_cell"))
        .drop("comp", "_cell")
    )
    names = tagged.groupBy("_comp").agg(F.min(id_col).alias("cluster_id"))
    return tagged.join(shuffled(names), "_comp").select(*df.columns, "cluster_id")


def cluster_numbers(clustered: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``cluster_number`` to rows with ``cluster_id``: 0, 1, ... inside ``by`` in the order of the first members."""
    return dense_rank(clustered, ["cluster_id"], by, "cluster_number")


# ---------------------------------------------------------------- matching

def greedy_match(truth: DataFrame, pred: DataFrame, r: float, by: Sequence[str], gt_id: str = "gt_id",
                 pred_id: str = "id") -> DataFrame:
    """One-to-one pairs by rising distance within ``r`` -> ``(by, gt_id, pred_id, distance)``.

    Places are paired, not rows: the nearest pair of places that choose each other hand out
    min(n, m) matches at once, in id order, and the emptied place leaves. Ties in distance go to the place with the
    least id, truth first."""
    pairs = radius_join(_places(truth, by, gt_id), _places(pred, by, pred_id), r, by)
    live = cut(
        pairs.select(*by, F.struct(F.col("d2"), F.col("key_a").alias("g"), F.col("key_b").alias("p")).alias("o"),
                     F.col("n_a").alias("ng"), F.col("n_b").alias("np"),
                     F.lit(0).cast("bigint").alias("og"), F.lit(0).cast("bigint").alias("op"))
    )
    taken: list[DataFrame] = []
    while not is_empty(live):
        best_g = W.partitionBy(*by, F.col("o.g"))
        best_p = W.partitionBy(*by, F.col("o.p"))
        marked = live.withColumn("_g", F.min("o").over(best_g)).withColumn("_p", F.min("o").over(best_p))
        hit = cut(
            marked.where((F.col("o") == F.col("_g")) & (F.col("o") == F.col("_p")))
            .withColumn("k", F.least(F.col("ng") - F.col("og"), F.col("np") - F.col("op")))
            .drop("_g", "_p")
        )
        taken.append(hit)
        used_g = hit.select(*by, F.col("o.g").alias("g"), F.col("k").alias("kg"))
        used_p = hit.select(*by, F.col("o.p").alias("p"), F.col("k").alias("kp"))
        live = cut(
            live.withColumn("g", F.col("o.g")).withColumn("p", F.col("o.p"))
            .join(shuffled(used_g), [*by, "g"], "left").join(shuffled(used_p), [*by, "p"], "left")
            .withColumn("og", F.col("og") + F.coalesce("kg", F.lit(0)))
            .withColumn("op", F.col("op") + F.coalesce("kp", F.lit(0)))
            .where((F.col("og") < F.col("ng")) & (F.col("op") < F.col("np")))
            .select(*live.columns)
        )
    if not taken:
        taken = [live.withColumn("k", F.lit(0).cast("bigint"))]
    spans = taken[0]
    for more in taken[1:]:
        spans = spans.unionByName(more)
    spans = spans.select(*by, F.col("o.g").alias("g"), F.col("o.p").alias("p"), F.sqrt("o.d2").alias("distance"), "og", "op", "k")
    t, p = _ranked_places(truth, by, gt_id), _ranked_places(pred, by, pred_id)
    t_row = t.select(*by, F.col("place").alias("g"), F.col("pos").alias("_pg"), F.col("key").alias(gt_id))
    p_row = p.select(*by, F.col("place").alias("p"), F.col("pos").alias("_pp"), F.col("key").alias("pred_id"))
    # A span hands the truth rows og + 1 .. og + k of its place the prediction rows op + 1 .. op + k.
    mine = t_row.join(shuffled(spans), [*by, "g"]).where((F.col("_pg") > F.col("og")) & (F.col("_pg") <= F.col("og") + F.col("k")))
    return mine.withColumn("_pp", F.col("_pg") - F.col("og") + F.col("op")).join(shuffled(p_row), [*by, "p", "_pp"]).select(*by, gt_id, "pred_id", "distance")


def _places(df: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    return df.groupBy(*by, "x", "y").agg(F.min(id_col).alias("key"), F.count(F.lit(1)).alias("n"))


def _ranked_places(df: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Number the rows of each place in id order as ``pos`` = 1..n; ``place`` is its least id.

    Ids are only compared, so any orderable type will do. A place of one row needs no ranking; crowded ones are ranked over
    range slices, never sorted by one task."""
    place = [*by, "x", "y"]
    one = df.groupBy(*place).agg(F.min(id_col).alias("place"), F.count(F.lit(1)).alias("n"))
    rows = df.select(*place, F.col(id_col).alias("key")).join(shuffled(one), place)
    lone = rows.where("n = 1").withColumn("pos", F.lit(1).cast("bigint"))
    crowd = running_total(rows.where("n > 1").withColumn("_one", F.lit(1).cast("bigint")), "_one", ["key"], place)
    return lone.unionByName(crowd.select(*place, "key", "place", "n", F.col("upto").alias("pos")))


# ---------------------------------------------------------------- merged groups

def merge_groups(df: DataFrame, groups: Sequence[str], by: Sequence[str], id_col: str = "id") -> DataFrame:
    """One row for each group: the best-scored row at the group's medoid, with the group's size and sources.

    The member with the least total squared distance to the others is the one nearest to the mean, so no pairs are made."""
    means = df.groupBy(*groups).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    off = F.pow(F.col("x") - F.col("_mx"), 2) + F.pow(F.col("y") - F.col("_my"), 2)
    rest = [c for c in df.columns if c not in (*groups, "x", "y")]
    lead = F.min(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"), F.struct(*rest).alias("row")))
    out = df.join(shuffled(means), list(groups)).groupBy(*groups).agg(
        lead.alias("_b"), F.min(F.struct(F.round(off, 6).alias("o"), F.col(id_col).alias("i"), "x", "y")).alias("_m"),
        F.count(F.lit(1)).alias("cluster_size"), F.array_sort(F.collect_set("source_kind")).alias("cluster_source_kinds"))
    kind = F.when(F.size("cluster_source_kinds") == 1, F.get("cluster_source_kinds", F.lit(0))).otherwise("hybrid")
    return out.select(*groups, F.col("_m.x").alias("x"), F.col("_m.y").alias("y"), *[F.col(f"_b.row.{c}").alias(c) for c in rest if c != "source_kind"],
                      kind.alias("source_kind"), "cluster_size", "cluster_source_kinds")


def cluster_nms(df: DataFrame, r: float, by: Sequence[str], respect_label: bool = True, label: str = "label") -> DataFrame:
    """Single-link groups merged to one row each; across labels the label with the best (score, size, name) wins its group."""
    if respect_label:
        grouped = radius_clusters(df, r, [*by, label])
        return merge_groups(grouped, [*by, label, "cluster_id"], by).drop("cluster_id")
    grouped = radius_clusters(df, r, by)
    votes = grouped.groupBy(*by, "cluster_id", label).agg(F.max("score").alias("_s"), F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*by, "cluster_id").agg(F.min(F.struct((-F.col("_s")).alias("s"), (-F.col("_n")).alias("n"), F.col(label).alias(label))).alias("_w"))
    winners = best.select(*by, "cluster_id", F.col(f"_w.{label}").alias(label))
    kept = grouped.join(shuffled(winners), [*by, "cluster_id", label], "left_semi")
    return merge_groups(kept, [*by, label, "cluster_id"], by).drop("cluster_id")


def box_join(px: DataFrame, centers: DataFrame, lo: int, hi: int, by: Sequence[str]) -> DataFrame:
    """Pairs with ``lo <= px - center <= hi`` on both axes; columns get ``_a`` and ``_b``."""
    reach = max(abs(lo), abs(hi))
    near = radius_join(px, centers, reach * 2 ** 0.5 + 1e-9, by)
    return near.where((F.col("x_a") - F.col("x_b")).between(lo, hi) & (F.col("y_a") - F.col("y_b")).between(lo, hi))
