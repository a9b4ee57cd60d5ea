"""Pairs of like items, found in shared buckets and checked exactly, without a row for each pair.

Items are classes of equal things with one row each. Buckets with the same members are folded into one. The members of a
large bucket are dealt into blocks, and each pair of blocks is one small group, so the size of a bucket never decides the
size of a task. A pair that shares several buckets is looked at in the least of them only, so links can be counted. What
leaves a group is one row per linked member: its links there, and one edge of a spanning forest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_MEMBERS = 1024
BLOCK_WEIGHT = 1 << 21


def shared_buckets(classes: DataFrame, block: int = BLOCK_MEMBERS) -> DataFrame:
    """``classes(item, weight, buckets array<long>)`` -> ``(item, keys)`` for items that share a bucket.

    ``keys`` is an array of (bucket, blocks), one for each distinct set of members the item is in, bounded by the
    number of buckets of an item."""
    rows = classes.select("item", "weight", F.explode(F.array_distinct("buckets")).alias("bucket"))
    sets = (
        rows.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").alias("w"),
            F.bit_xor(F.xxhash64("item")).alias("a"),
            F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b"),
        )
        .where("n > 1")
        .groupBy("n", "w", "a", "b")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") / BLOCK_WEIGHT)).cast("int").alias("blocks"))
    )
    return rows.join(sets, "bucket").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks"))).alias("keys"))


def linked(members: DataFrame, similar: Callable[[list, list | None], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """``members(item string, copies, keys, data binary)`` -> ``(item, links, root)``.

    ``similar(left, right)`` gets the data of a block, or of two, and yields for each left position the right positions
    that are like it; with ``right`` None both are the same block and only later positions count. ``links`` weighs each
    partner by its copies; sum it over the rows of an item. ``root`` is an item of the same group of linked items."""
    every = F.sequence(F.lit(0), F.col("key.blocks") - 1)
    parts = (
        members.select("item", "copies", F.transform("keys", lambda k: k["bucket"]).alias("own"), F.explode("keys").alias("key"), "data")
        .withColumn("mine", F.pmod(F.xxhash64("item"), F.col("key.blocks")).cast("int"))
        .select("item", "copies", "own", F.col("key.bucket").alias("bucket"), "mine", F.explode(every).alias("other"), "data")
        .select("item", "copies", "own", "bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "data")
        .repartition("bucket", "lo", "hi")
        .sortWithinPartitions("bucket", "lo", "hi")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["bucket", "lo", "hi"]):
            out = _one_group(group.drop_duplicates("item"), similar)
            if out is not None:
                yield out

    return parts.mapInPandas(run, "item string, links long, root string")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted rows, over the borders of batches."""
    held: list[pd.DataFrame] = []
    at = None
    for batch in batches:
        if batch.empty:
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            now = tuple(k[lo])
            if held and now != at:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            at = now
            held.append(batch.iloc[lo:hi])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _one_group(group: pd.DataFrame, similar: Callable) -> pd.DataFrame | None:
    bucket, lo, hi = (int(group[c].iat[0]) for c in ("bucket", "lo", "hi"))
    mine = group["mine"].to_numpy()
    left = np.flatnonzero(mine == lo)
    right = None if lo == hi else np.flatnonzero(mine == hi)
    if len(group) < 2 or not len(left) or (right is not None and not len(right)):
        return None
    items, copies, data = group["item"].to_numpy(), group["copies"].to_numpy(), group["data"].to_numpy()
    seen: dict[int, list[int]] = {}
    for i, own in enumerate(group["own"]):
        for b in own:
            if b < bucket:
                seen.setdefault(int(b), []).append(i)
    earlier: list[list[np.ndarray]] = [[] for _ in items]
    for same in seen.values():
        if len(same) > 1:
            same = np.array(same)
            for i in same:
                earlier[i].append(same)
    links, root = np.zeros(len(items), np.int64), np.arange(len(items))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    other = left if right is None else right
    for i, found in similar([data[k] for k in left], None if right is None else [data[k] for k in right]):
        a, b = left[i], other[found]
        if len(b) and earlier[a]:
            b = b[~np.isin(b, np.concatenate(earlier[a]))]
        links[a] += copies[b].sum()
        links[b] += copies[a]
        for j in b:
            x, y = top(a), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    got = np.flatnonzero(links)
    if not len(got):
        return None
    return pd.DataFrame({"item": items[got], "links": links[got], "root": items[[top(i) for i in got]]})
