"""Periodic runs in word sequences, found by string synchronising sets at dyadic scales.

At scale t (a power of two) a position is synchronising when the least name among the t-word fragments that begin in the
t + 1 places from it on is that of the first or the last of them. Membership depends on the 2t words of its context alone,
so positions in equal contexts are members together, and any 2t places with a fragment that counts hold a member in their
first half. In a run of period q with t <= q < 2t and four periods or more, a member and its copy q words on are therefore
both there, and the copy is the next member in an equal context: such neighbours propose the period, and the proposal
is extended word by word to its run. Fragments of period t/4 at most get no name, which keeps the sets sparse; they lie in
runs of smaller period, found at the scales before. Periods below the first scale are read off directly.

Names are hashes of fragments by doubling; words are compared exactly when a proposal is extended, so a run is never false."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.llm.words import mix, rows_at_once, slices

#: Periods from here on are proposed by synchronising sets.
FIRST_SCALE = 4
MIN_PERIODS = 4
MIN_WORDS = 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_U = np.uint64
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _small(x: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """Runs of the prime period, or 1, ``q`` that are not runs of period 1."""
    same = np.concatenate([[False], x[q:] == x[:-q], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1])
    start, count = turns[::2], turns[1::2] - turns[::2]
    wide = count + q >= MIN_PERIODS * q
    start, count = start[wide], count[wide]
    if q > 1:
        flat = np.ones(len(start), bool)
        for j in range(q - 1):
            flat &= x[start + j] == x[start + j + 1]
        start, count = start[~flat], count[~flat]
    return list(zip(start.tolist(), (count + q).tolist(), [q] * len(start), strict=True))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: prefixes and suffixes of blocks of that width."""
    n = len(h) - width + 1
    blocks = np.full(-(-len(h) // width) * width, _NONE, np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        off = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(off):
            return at + int(off[0])
        at, step = at + step, step * 2
    return n


def _proposals(h: np.ndarray, context: np.ndarray, t: int, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """``(position, period)`` of members of the synchronising set of scale t and the next members in equal contexts."""
    h = h.copy()
    for start, length, period in runs:
        if period <= t // 4 and length >= t:
            h[start : start + length - t + 1] = _NONE
    low = _least(h, t + 1)
    n = len(low)
    at = np.flatnonzero(((h[:n] == low) | (h[t : t + n] == low)) & (low != _NONE))
    name = context[at]
    order = np.argsort(name, kind="stable")
    at, name = at[order], name[order]
    gap = np.diff(at)
    near = np.flatnonzero((name[1:] == name[:-1]) & (gap >= t) & (gap < 2 * t))
    return at[near], gap[near]


def find_runs(x: np.ndarray) -> np.ndarray:
    """All maximal runs of a sequence of numbers with at least ``MIN_PERIODS`` smallest periods: rows (start, length, period)."""
    runs: list[tuple[int, int, int]] = []
    for q in range(1, FIRST_SCALE):
        if len(x) > q:
            runs += _small(x, q)
    h, t = mix(x.astype(np.uint64) + _LEFT), 1
    while MIN_PERIODS * t <= len(x):
        context = mix(h[:-t] * _LEFT + (h[t:] ^ _RIGHT) * _RIGHT)
        if t >= FIRST_SCALE:
            runs += _extended(x, t, *_proposals(h, context, t, runs))
        h, t = context, 2 * t
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def _extended(x: np.ndarray, t: int, at: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    last, start, end = 0, 0, 0
    order = np.lexsort((at, period))
    for i, q in zip(at[order].tolist(), period[order].tolist(), strict=True):
        if q == last and start <= i and i + q + 2 * t <= end:
            continue
        back = _agree(x[:i][::-1], x[: i + q][::-1])
        last, start, end = q, i - back, i + q + _agree(x[i:], x[i + q :])
        if end - start >= MIN_PERIODS * q:
            found.append((start, end - start, q))
    return found


def _words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words end to end, their offsets, their numbers, words of each text)``; equal words have equal numbers."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buf]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if len(starts) and len(ends) < len(starts):
        ends = np.append(ends, len(buf))
    solid = buf[~space]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(solid.tobytes())])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    counts = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(texts))
    return solid, offsets, numbers, counts


def _collapse(texts: list[bytes]) -> Iterator[tuple[list[dict], bytes]]:
    """``(runs, text without later periods)`` of each text; all texts are searched as one sequence with partings between."""
    solid, offsets, numbers, counts = _words(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    # A parting is a number of its own, so no run reaches over it; text d is shifted by the d partings before it.
    line = np.empty(len(numbers) + len(texts), np.int64)
    line[np.arange(len(numbers)) + owner] = numbers
    line[ends + np.arange(len(texts))] = len(numbers) + np.arange(len(texts))
    runs = find_runs(line)
    runs = runs[runs[:, 1] >= MIN_WORDS]
    of = np.searchsorted(ends + np.arange(len(texts)), runs[:, 0], "right")
    place = runs[:, 0] - of
    delta = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(delta, place + runs[:, 2], 1)
    np.add.at(delta, place + runs[:, 1], -1)
    kept = np.cumsum(delta[:-1]) == 0
    size = np.diff(offsets)
    # Words with one space after each, the dropped ones left out.
    spaced = np.full(len(solid) + len(numbers), 32, np.uint8)
    spaced[np.arange(len(solid)) + np.repeat(np.arange(len(numbers)), size)] = solid
    spaced = spaced[np.repeat(kept, size + 1)].tobytes()
    stop = np.concatenate([[0], np.cumsum(np.where(kept, size + 1, 0))])[np.concatenate([[0], ends])]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        mine = slice(cuts[d], cuts[d + 1])
        rows = zip((place[mine] - (ends[d] - counts[d])).tolist(), runs[mine, 1].tolist(), runs[mine, 2].tolist(), strict=True)
        yield [{"start": s, "length": n, "period": q} for s, n, q in rows], spaced[stop[d] : max(stop[d], stop[d + 1] - 1)]


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, runs, collapsed)``, one row for each row.

    Words are parted by ASCII white space and numbered from 0. ``runs`` are the maximal stretches of words with a smallest
    period q, of at least 6 words and 4 periods, ordered by start, then period; stretches of different periods may overlap.
    ``collapsed`` is the text without the words that any run has after its first period, joined by one space. A null or
    blank text has no runs and collapses to the empty text. Rows that come twice stay two rows; other columns are not
    read. A text is searched as a whole, in time that grows with n log n, so a task holds one text at least."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                runs, left = zip(*_collapse(texts[lo:hi]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(runs, _ARROW_RUNS), pa.array([t.decode() for t in left], pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")


_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _tailed(docs: DataFrame) -> DataFrame:
    """The texts of the query: where 10 divides the crc32 of doc_id, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(index, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    text = F.array_join(F.flatten(F.transform(F.array(words), tail)), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


SQL = """
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, bytes
), placed AS (
  SELECT doc_id, w, h, len(w) AS n, h // 10 % greatest(len(w), 1) AS a, h // 10 % 8 AS r FROM docs
), periods AS (
  SELECT *, 1 + (n - a) // (3 + r) AS p FROM placed
), words AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM periods)
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND y.i - x.i <= x.n / 4
), islands AS (
  SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM equal
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
  SELECT * FROM stretches a WHERE NOT EXISTS (
    SELECT 1 FROM stretches b WHERE b.doc_id = a.doc_id AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.len >= a.s + a.len)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.i = w.i) GROUP BY doc_id
), summary AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'len': len, 'q': q}, (-len, s, q)) AS best, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.len AS BIGINT) AS length,
  CAST(best.q AS BIGINT) AS period, CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(s.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN summary s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op12_periodic_runs", SQL)
def op12(spark, sf_dir):
    """Runs of every document: how many, the longest, and digests of all runs and of the collapsed text."""
    found = collapse_runs(_tailed(table(spark, sf_dir, "documents")))
    rank = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(rank).alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return best.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.n div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
