"""Connected components of an edge table by repeated random contraction.

Every round each node picks the neighbour (or itself) with the least hash of that round; the picked
nodes become the nodes of the next, smaller graph. The expected number of rounds is logarithmic in
the number of nodes, whatever the shape of the graph, and no node ever holds its neighbours in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.session import cut, is_empty, shuffled

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any comparable type -> ``(node, comp)``; ``comp`` is the least node of the component.

    Only nodes with an edge appear. Self loops are ignored."""
    live = cut(_simple(edges.select("u", "v")))
    picks: list[DataFrame] = []
    for seed in range(MAX_ROUNDS):
        if is_empty(live):
            break
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pick = cut(
            both.groupBy("u")
            .agg(F.min(F.struct(F.xxhash64("v", F.lit(seed)).alias("h"), F.col("v"))).alias("m"))
            .select(
                "u",
                F.least(F.struct(F.xxhash64("u", F.lit(seed)).alias("h"), F.col("u").alias("v")), F.col("m"))["v"].alias("rep"),
            )
        )
        picks.append(pick)
        left = pick.select(F.col("u"), F.col("rep").alias("ru"))
        right = pick.select(F.col("u").alias("v"), F.col("rep").alias("rv"))
        live = cut(_simple(live.join(shuffled(left), "u").join(shuffled(right), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds; {live.count()} edges are left")
    if not picks:
        return live.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    root = picks[-1]
    for pick in reversed(picks[:-1]):
        later = root.select(F.col("u").alias("rep"), F.col("rep").alias("later"))
        root = pick.join(shuffled(later), "rep", "left").select("u", F.coalesce("later", "rep").alias("rep"))
    root = cut(root)
    least = root.groupBy("rep").agg(F.min("u").alias("comp"))
    return root.join(shuffled(least), "rep").select(F.col("u").alias("node"), "comp")


def _simple(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
