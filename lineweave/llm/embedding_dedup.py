"""Embedding near-dedup: Euclidean p-stable hashing finds pairs, exact cosines decide.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of ``width``; a table joins ``planes``
cell numbers to one bucket, and there are ``tables`` of them. Two unit vectors of cosine c lie sqrt(2 - 2c) apart, so the
chance to share a cell falls with the distance; the number of tables follows from the recall wanted at the threshold."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import candidates
from lineweave.llm.registry import query, table
from lineweave.llm.words import mix
from lineweave.operators.graph import components
from lineweave.session import cut

PLANES = 8
WIDTH = 1.5


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The chance that two points so far apart share a cell of one projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def choose_tables(threshold: float, recall: float, planes: int = PLANES, width: float = WIDTH) -> int:
    hit = same_cell(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** planes
    return 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))


def _projections(dim: int, tables: int, planes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([3, dim])
    return rng.standard_normal((dim, tables * planes)), rng.uniform(0, width, tables * planes)


def sketches(vectors: DataFrame, tables: int, planes: int, width: float) -> DataFrame:
    """``(vec_id, embedding, label)`` -> ``(vec_id, item, data, buckets)``.

    ``item`` names the label and the unit vector as 64-bit floats, so copies share it. Rows that can't be compared have a
    null ``item``: a null label, or a vector that is null, empty, zero or not finite throughout."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            item, data = np.full(len(pdf), None, object), np.full(len(pdf), None, object)
            buckets = np.full(len(pdf), None, object)
            sizes: dict[int, list[int]] = {}
            for i, (lab, v) in enumerate(zip(pdf["label"], pdf["v"], strict=True)):
                if lab is not None and v is not None and len(v):
                    sizes.setdefault(len(v), []).append(i)
            for dim, at in sizes.items():
                at = np.array(at)
                x = np.array([np.asarray(pdf["v"].iat[i], float) for i in at])
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                at, x = at[ok], x[ok] / top[ok, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                normals, shift = _projections(dim, tables, planes, width)
                cells = np.floor((x @ normals + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, planes)
                for k, i in enumerate(at):
                    lab = str(pdf["label"].iat[i])
                    item[i] = hashlib.md5(lab.encode() + b"\0" + x[k].tobytes()).hexdigest()
                    data[i] = x[k].tobytes()
                    seed = np.frombuffer(hashlib.md5(f"{dim}:{lab}".encode()).digest()[:8], np.uint64)[0]
                    h = mix(np.arange(tables, dtype=np.uint64) ^ seed)
                    for p in range(planes):
                        h = mix(h ^ cells[k, :, p])
                    buckets[i] = h.astype(np.int64)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "item": item, "data": data, "buckets": buckets})

    return rows.mapInPandas(run, f"vec_id {kind}, item string, data binary, buckets array<long>")


def _cosine(threshold: float):
    def similar(left: list[bytes], right: list[bytes] | None) -> Iterator[tuple[int, np.ndarray]]:
        a = np.array([np.frombuffer(v, np.float64) for v in left])
        b = a if right is None else np.array([np.frombuffer(v, np.float64) for v in right])
        close = a @ b.T >= threshold
        if right is None:
            close &= np.tri(len(a), len(a), -1, dtype=bool).T
        for i in np.flatnonzero(close.any(axis=1)):
            yield i, np.flatnonzero(close[i])

    return similar


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``.

    Two rows are linked when their labels are equal and not null, their vectors have equal length and the cosine in double
    precision is at least ``threshold``. Copies of a vector link to each other. ``component_id`` is the least vec_id that
    links reach, ``kept`` tells whether it is the row's own. Rows that can't be compared have no link and stay. A repeated
    row counts as one more vector, and all rows with the kept vec_id are marked."""
    tables = choose_tables(threshold, recall)
    flat = cut(sketches(vectors.select("vec_id", "embedding", "label"), tables, PLANES, WIDTH))
    classes = flat.where("item is not null").groupBy("item").agg(
        F.min(F.struct("vec_id")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("data").alias("data"), F.first("buckets").alias("buckets")
    )
    classes = cut(classes.select("item", F.col("rep.vec_id").alias("least"), "copies", "data", "buckets"))
    keys = candidates.shared_buckets(classes.select("item", F.lit(1).alias("weight"), "buckets"))
    pairs = cut(candidates.linked(classes.select("item", "copies", "data").join(keys, "item"), _cosine(threshold)))
    comp = components(pairs.select(F.col("item").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("item"), "comp")
    links = pairs.groupBy("item").agg(F.sum("links").alias("links"))
    placed = classes.select("item", "least", "copies").join(comp, "item", "left").join(links, "item", "left").withColumn("comp", F.coalesce("comp", "item"))
    first = placed.groupBy("comp").agg(F.min(F.struct("least"))["least"].alias("component_id"))
    verdict = placed.join(first, "comp").select("item", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = flat.select("vec_id", "item").join(verdict, "item", "left")
    # A row that can't be compared joins nothing and is a component of its own.
    own = F.when(F.col("item").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


SQL = """
WITH RECURSIVE raw AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), unit AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM raw
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_count(e) = len(e) AND isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0
), pair AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT p.v, r.root FROM reach r JOIN pair p ON p.u = r.node WHERE r.root < p.v
), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node
), links AS (SELECT u, count(*) AS n FROM pair GROUP BY u)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id LEFT JOIN links l ON l.u = e.vec_id
"""


@query("op3_embedding_dedup", SQL)
def op3(spark, sf_dir):
    """Links and component of every vector at cosine 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
