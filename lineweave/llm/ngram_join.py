"""N-gram Jaccard join: MinHash banding finds pairs, full n-gram sets decide.

Documents with the same set of n-grams are one class from the start, so exact copies cost one signature row each and no
pair. Bands and rows are chosen for a target recall at the threshold; the shuffle is on band hashes only. Texts are read
a second time for those classes alone that share a band with another one."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import candidates
from lineweave.llm.registry import query, table
from lineweave.llm.words import PUNCTUATION, UNSPACED, char_class, gram_hashes, mix, rows_at_once, slices
from lineweave.operators.graph import components
from lineweave.session import cut

MAX_HASHES = 128


def choose_bands(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the longest rows whose bands reach ``recall`` at ``threshold`` within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _signatures(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts with grams) x bands hashes."""
    rng = np.random.default_rng(7)
    xor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(first), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = mix(h ^ np.minimum.reduceat((grams ^ xor[k]) * odd[k], first))
        out[:, b] = h
    return out


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    grams, counts = gram_hashes(texts, words)
    ends = np.cumsum(counts)
    return grams, counts, [np.unique(grams[e - c : e]) for e, c in zip(ends, counts, strict=True)]


def _name(grams: np.ndarray, text: bytes) -> str:
    """Name of a set of n-grams; without any, of the text less the white space around it."""
    return hashlib.md5(grams.tobytes() if len(grams) else b"text:" + text.strip()).hexdigest()


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, th, item, weight, buckets)``; ``item`` names the set of n-grams.

    A text without a word has no buckets."""
    rows_in = docs.select("doc_id", F.xxhash64("text").alias("th"), F.lower("text").alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for lo, hi in slices(texts):
                grams, counts, sets = _sets(texts[lo:hi], words)
                sig = _signatures(grams, counts, bands, rows).astype(np.int64) if len(grams) else np.empty((0, bands), np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([_name(s, t) for s, t in zip(sets, texts[lo:hi], strict=True)], pa.string()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel())),
                    ],
                    names=["doc_id", "th", "item", "weight", "buckets"],
                )

    return rows_in.mapInArrow(run, f"doc_id {kind}, th long, item string, weight long, buckets array<long>")


def _gram_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(item, text)`` -> ``(item, data)``: the sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in slices(raw):
                _, _, sets = _sets(raw[lo:hi], words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item", "data"]
                )

    return texts.select("item", F.lower("text").alias("text")).mapInArrow(run, "item string, data binary")


def _jaccard(threshold: float):
    def similar(left: list[bytes], right: list[bytes] | None) -> Iterator[tuple[int, np.ndarray]]:
        both = [np.frombuffer(x, np.uint64) for x in (left if right is None else left + right)]
        size = np.array([len(x) for x in both])
        _, at = np.unique(np.concatenate(both), return_inverse=True)
        ends = np.cumsum(size)
        base = 0 if right is None else len(left)
        for i in range(len(left)):
            lo = i + 1 if right is None else base
            if lo >= len(both):
                return
            mark = np.zeros(at.max() + 1, np.int64)
            mark[at[ends[i] - size[i] : ends[i]]] = 1
            start = ends[lo] - size[lo]
            shared = np.add.reduceat(mark[at[start:]], (ends - size)[lo:] - start)
            found = np.flatnonzero(shared / (size[i] + size[lo:] - shared) >= threshold)
            yield i, found + (lo - base)

    return similar


def ngram_classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document -> ``(doc_id, th, class_id, n_links, kept)``.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word n-grams (lower case, parted
    by white space and punctuation; in scripts written without spaces each character is a word) is at least ``threshold``. ``n_links`` counts the other documents linked to it, copies included;
    ``class_id`` is the least doc_id reachable by links. A text of fewer than ``words`` words has one gram of all its
    words. Texts without a word have no gram and are linked when they are equal but for white space around them; null, empty
    and blank ones are one class. Each input row counts as a
    document, so repeated rows link to each other. A null doc_id is an id less than all others. ``th`` is the hash of the
    text as it came; with doc_id it names the row. ``kept`` marks the row of a class with the least doc_id, then the least
    ``th``; rows that agree in both are equal and are all marked."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select("doc_id", "text")
    flat = cut(sketches(docs, words, bands, rows))
    classes = flat.groupBy("item").agg(
        F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), F.first("buckets").alias("buckets")
    )
    keys = candidates.shared_buckets(classes.where("weight > 0"))
    wanted = classes.select("item", "copies", "rep.doc_id", "rep.th").join(keys, "item")
    wanted = cut(wanted)
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.th").eqNullSafe(F.col("w.th"))
    # The wanted rows grow with the corpus, so the same shuffled join serves every size.
    reps = wanted.select("item", "doc_id", "th").hint("merge").alias("w")
    texts = docs.withColumn("th", F.xxhash64("text")).alias("d").join(reps, same).select("item", "text")
    members = _gram_sets(texts, words).join(wanted.select("item", "copies", "keys"), "item")
    pairs = cut(candidates.linked(members, _jaccard(threshold)))
    comp = components(pairs.select(F.col("item").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("item"), "comp")
    links = pairs.groupBy("item").agg(F.sum("links").alias("links"))
    placed = classes.select("item", "copies", "rep").join(comp, "item", "left").join(links, "item", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "item"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("first"))
    verdict = placed.join(least, "comp").select("item", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("th").eqNullSafe(F.col("first.th"))
    return flat.select("doc_id", "th", "item").join(verdict, "item").select("doc_id", "th", F.col("first.doc_id").alias("class_id"), "n_links", kept.alias("kept"))


SQL = (
    """
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[%s]|[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f%s]+') AS w, text FROM documents
), grams AS (
  SELECT doc_id, text, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM toks
), keyed AS (
  SELECT doc_id, CASE WHEN len(g) > 0 THEN array_to_string(list_sort(g), chr(10)) ELSE 'text:' || trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS k, g FROM grams
), classes AS MATERIALIZED (
  SELECT k, min(doc_id) AS rep, count(*) AS copies, any_value(g) AS g FROM keyed GROUP BY k
), shingle AS MATERIALIZED (
  SELECT rep, len(g) AS n, unnest(g) AS s FROM classes
), pair AS MATERIALIZED (
  SELECT a.rep AS u, b.rep AS v FROM shingle a JOIN shingle b ON a.s = b.s AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8
), reach(node, root) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT p.v, r.root FROM reach r JOIN pair p ON p.u = r.node WHERE r.root < p.v
), comp AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
), links AS (
  SELECT p.u AS rep, sum(c.copies) AS n FROM pair p JOIN classes c ON c.rep = p.v GROUP BY p.u
)
SELECT d.doc_id, m.root AS class_id, CAST(coalesce(l.n, 0) + c.copies - 1 AS BIGINT) AS n_links
FROM keyed d JOIN classes c ON c.k = d.k JOIN comp m ON m.node = c.rep LEFT JOIN links l ON l.rep = c.rep
"""
    % (char_class(UNSPACED), char_class(UNSPACED + PUNCTUATION))
)


@query("op6_ngram_jaccard", SQL)
def op6(spark, sf_dir):
    """Class and number of links of every document, at five words, 0.8 and 99.99 % recall."""
    return ngram_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
