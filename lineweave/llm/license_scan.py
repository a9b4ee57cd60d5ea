"""License scan: an exact join of text blocks with license templates by the containment of word sets.

The words of the templates are ordered by how many documents of the whole corpus have them, rarest first. A template of m
distinct words is contained in a block when at least ``a = ceil(threshold * m)`` of them are there, so one of its m - a + 1
rarest words, its prefix, must be in the block: only places of prefix words are looked at. A document of fewer than
a words is passed over (length). A place of the k-th word of the order can, when no rarer word of the template is near, reach
no more than the later words of the order in its reach (position). What is left is counted exactly, for every block.

Blocks of a template are all stretches of as many consecutive words as the template has, and a quarter more. Neighbouring
blocks that contain it are one result. Templates are a parameter of the job, never data, and travel with the tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.llm.words import rows_at_once, slices, split_words

THRESHOLD = 0.85
#: Label and phrase: whole phrases that name a license by themselves.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
# Sentences of public license notices.
#: Label and template. Of up to six words all are needed, of longer ones 85 in 100.
TEMPLATES = [
    ("apache", "apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
PLACES = "array<struct<label:string,start:bigint,length:bigint>>"
BLOCKS = "array<struct<label:string,start:bigint,length:bigint,containment:double>>"
_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
_BLOCK = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("containment", pa.float64())])


def needed(words: int, threshold: float) -> int:
    """How many of ``words`` distinct words a block must have; the margin takes up rounding of the product."""
    return max(1, math.ceil(threshold * words - 1e-9))


def block_words(words: int) -> int:
    """Words of a block for a template of ``words`` words."""
    return words + -(-words // 4)


@dataclass
class _Template:
    label: str
    order: list[int]
    need: int
    width: int


def _tokens(texts: Sequence[bytes], known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(number in known or -1 of each word, words of each text)``; only A-Z are lower-cased."""
    buf, starts, ends, owner = split_words([t.lower() for t in texts])
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    inside = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[inside].tobytes())])
    found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    return found, np.bincount(owner, minlength=len(texts))


def _known(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({w for _, text in [*phrases, *templates] for w in text.split()})


def word_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each word occurs, over all documents. The answer has one entry for each word asked for."""
    known = pa.array([w.encode() for w in words], pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in rows_at_once(batches):
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for lo, hi in slices(texts):
                found, counts = _tokens(texts[lo:hi], known)
                doc = np.repeat(np.arange(len(counts)), counts)[found >= 0]
                pairs = np.unique(doc * len(words) + found[found >= 0])
                total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total)], names=["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in sums.collect()}


def _prepared(templates: Sequence[tuple[str, str]], words: list[str], count: dict[str, int], threshold: float) -> list[_Template]:
    number = {w: i for i, w in enumerate(words)}
    out = []
    for label, text in templates:
        distinct = sorted(set(text.split()), key=lambda w: (count.get(w, 0), w))
        out.append(_Template(label, [number[w] for w in distinct], needed(len(distinct), threshold), block_words(len(text.split()))))
    return out


def _phrase_places(found: np.ndarray, doc: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Starts of the places where the words of the phrase stand one after another in one text."""
    at = np.flatnonzero(found[: len(found) - len(phrase) + 1] == phrase[0]) if len(found) >= len(phrase) else np.empty(0, np.int64)
    for k, w in enumerate(phrase[1:], 1):
        at = at[found[at + k] == w]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def _contained(found: np.ndarray, doc: np.ndarray, first: np.ndarray, counts: np.ndarray, t: _Template) -> Iterator[tuple[int, int, float]]:
    """``(start, end, containment)`` of the merged blocks that contain the template, in all texts of a batch."""
    rank = np.full(found.max(initial=0) + 2, -1, np.int32)
    for k, w in enumerate(t.order):
        if w < len(rank) - 1:
            rank[w] = k
    r = rank[found]
    at = np.flatnonzero(r >= 0)
    r = r[at]
    prefix = len(t.order) - t.need + 1
    anchors = []
    for k in range(prefix):
        mine = at[r == k]
        mine = mine[counts[doc[mine]] >= t.need]
        later = at[r >= k]
        reach = np.searchsorted(later, mine + t.width) - np.searchsorted(later, mine - t.width, "right")
        anchors.append(mine[reach >= t.need])
    anchors = np.sort(np.concatenate(anchors))
    if not len(anchors):
        return
    near = _covered(anchors - t.width + 1, anchors + t.width, len(found))
    at, r = at[near[at]], r[near[at]]
    # A word counts once in a block: for the starts after its last place before.
    order = np.lexsort((at, r))
    same = np.concatenate([[False], r[order][1:] == r[order][:-1]])
    last = np.full(len(at), -1, np.int64)
    last[order[1:]] = np.where(same[1:], at[order][:-1], -1)
    begin = np.maximum(np.maximum(last + 1, at - t.width + 1), first[doc[at]])
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, at + 1, -1)
    shared = np.cumsum(change[:-1])
    starts = np.flatnonzero((shared >= t.need) & _covered(anchors - t.width + 1, anchors + 1, len(found)))
    if not len(starts):
        return
    breaks = np.flatnonzero((np.diff(starts) > 1) | (doc[starts[1:]] != doc[starts[:-1]])) + 1
    for lo, hi in zip([0, *breaks], [*breaks, len(starts)], strict=True):
        d = doc[starts[lo]]
        end = min(starts[hi - 1] + t.width, first[d] + counts[d])
        yield int(starts[lo]), int(end), int(shared[starts[lo:hi]].max()) / len(t.order)


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Places inside any of the stretches."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(lo, 0, n), 1)
    np.add.at(change, np.clip(hi, 0, n), -1)
    return np.cumsum(change[:-1]) > 0


def _scan(texts: list[bytes], known: pa.Array, phrases: list[tuple[str, list[int]]], templates: list[_Template]) -> tuple[np.ndarray, list, list]:
    found, counts = _tokens(texts, known)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    places: list[list[dict]] = [[] for _ in texts]
    blocks: list[list[dict]] = [[] for _ in texts]
    for label, phrase in phrases:
        for s in _phrase_places(found, doc, phrase).tolist():
            places[doc[s]].append({"label": label, "start": int(s - first[doc[s]]), "length": len(phrase)})
    for t in templates:
        for s, e, share in _contained(found, doc, first, counts, t):
            blocks[doc[s]].append({"label": t.label, "start": int(s - first[doc[s]]), "length": e - s, "containment": share})
    for rows in [*places, *blocks]:
        rows.sort(key=lambda x: (x["start"], x["length"], x["label"]))
    return counts, places, blocks


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES), threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, places, blocks)``, one row for each row.

    ``templates`` and ``phrases`` are (label, words) with lower-case words parted by spaces; a phrase without a word is an
    error. Words of a text are runs of digits, letters and characters from 128 on, A-Z lower-cased, numbered from 0. ``places`` are all places of
    phrases. ``blocks`` are the blocks that hold at least ``threshold`` of the distinct words of a template, overlapping
    and touching ones merged, with the greatest share that one of them holds; a block ends with its text. Both are
    ordered by start, then length, then label. Null and empty texts have no words. Ties in frequency are ordered by word. Rows that come
    twice stay two rows; other columns are not read. Texts are read twice, once for the frequencies."""
    if not all(text.split() for _, text in [*templates, *phrases]):
        raise ValueError("a template or phrase has no word")
    rows = docs.select("doc_id", "text")
    words = _known(phrases, templates)
    ready = _prepared(templates, words, word_frequencies(rows, words), threshold)
    number = {w: i for i, w in enumerate(words)}
    named = [(label, [number[w] for w in text.split()]) for label, text in phrases]
    spelled = [w.encode() for w in words]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(spelled, pa.large_binary())
        for batch in rows_at_once(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                counts, places, blocks = _scan(texts[lo:hi], known, named, ready)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(places, pa.list_(_PLACE)), pa.array(blocks, pa.list_(_BLOCK))],
                    names=["doc_id", "n_words", "places", "blocks"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, places {PLACES}, blocks {BLOCKS}")


def _values(rows: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"('{label}', '{text}')" for label, text in rows)


SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), words AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs
), phrases AS (
  SELECT label, string_split(p, ' ') AS ws FROM (VALUES {_values(PHRASES)}) t(label, p)
), places AS (
  SELECT d.doc_id, p.label, w.i FROM words w JOIN phrases p ON p.ws[1] = w.word JOIN docs d ON d.doc_id = w.doc_id AND d.w[w.i + 1:w.i + len(p.ws)] = p.ws
), templates AS (
  SELECT label, row_number() OVER () AS t, list_distinct(string_split(p, ' ')) AS ws, len(string_split(p, ' ')) + ceil(len(string_split(p, ' ')) / 4) AS width
  FROM (VALUES {_values(TEMPLATES)}) t(label, p)
), sizes AS (
  SELECT t, label, width, len(ws) AS m, ceil({THRESHOLD} * len(ws) - 1e-9) AS need FROM templates
), hits AS (
  SELECT w.doc_id, x.t, w.word, w.i FROM words w JOIN (SELECT t, unnest(ws) AS word FROM templates) x ON x.word = w.word
), likely AS MATERIALIZED (
  SELECT h.* FROM hits h JOIN (SELECT doc_id, t FROM hits JOIN sizes USING (t) GROUP BY doc_id, t HAVING count(DISTINCT word) >= any_value(need)) g
    ON g.doc_id = h.doc_id AND g.t = h.t
), shares AS (
  SELECT a.doc_id, a.t, a.i, count(DISTINCT b.word) AS n FROM likely a JOIN sizes s ON s.t = a.t
  JOIN likely b ON b.doc_id = a.doc_id AND b.t = a.t AND b.i >= a.i AND b.i < a.i + s.width GROUP BY a.doc_id, a.t, a.i
), blocks AS (
  SELECT doc_id, label, n / m AS share FROM shares JOIN sizes USING (t) WHERE n >= need
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), both_labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT doc_id, label, share FROM blocks UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN both_labels l ON l.doc_id = d.doc_id
"""


@query("op13_license_scan", SQL)
def op13(spark, sf_dir):
    """Licenses named in every document. A base phrase stands whole, so it scores 1; a document without a license scores 0."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    more = F.transform("blocks", lambda b: b["label"])
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
