"""Mixing sources to target weights as a Pfair schedule.

The text of each source, in doc_id order, is cut into blocks of equal size. With weight w, block i of a source is released
at slot floor(i / w) and due at slot ceil((i + 1) / w); in each slot the released block with the earliest deadline comes
next. Weights are whole numbers that are not rounded to a short period, and the blocks there are get their slots one after
the other, so after any number of slots a source is less than one block away from its target, as long as no source has
run out. With ``parts`` targets are rounded to so many parts and one period of the schedule is repeated; that is what the
SQL of op8 defines, and there the bound holds for the rounded targets only."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.operators.ranks import running_total
from lineweave.session import checkpoint_root, cut

BLOCK_CHARS = 65_536
SHARES = 1_000
MAX_SOURCES = 10_000
#: Slots that the driver holds before it writes them.
SLOTS_AT_ONCE = 500_000


def earliest_deadline_first(shares: Sequence[int]) -> list[int]:
    """The source of each slot of one period of ``sum(shares)`` slots; ties go to the lower source number."""
    period = sum(shares)
    later = [(0, s, 0) for s in range(len(shares))]
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(period):
        while later and later[0][0] <= t:
            _, s, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < shares[s]:
            heapq.heappush(later, ((i + 1) * period // shares[s], s, i + 1))
    return out


def slots_of_blocks(shares: Sequence[int], blocks: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """``(source, block, slot)`` of the first ``blocks[s]`` blocks of each source, earliest deadline first, in slot order.

    A source that has run out asks for no slot. Until then this is the schedule of sources that never end."""
    period = sum(shares)
    later = [(0, s, 0) for s in range(len(shares)) if blocks[s]]
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []
    t = 0
    while later or ready:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            _, s, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i, t
        t += 1
        if i + 1 < blocks[s]:
            heapq.heappush(later, ((i + 1) * period // shares[s], s, i + 1))


def target_shares(totals: DataFrame, weights: dict[str, float] | None = None, parts: int | None = None, block_chars: int = BLOCK_CHARS) -> list[tuple[str, int, int]]:
    """``(source key, characters, shares)`` ordered by key: one row for each source, at most MAX_SOURCES.

    Without weights a source's target is in proportion to the whole square root of its characters, which lifts small
    sources; these are the shares as they are. Given weights become whole numbers as fine as 64 bits allow for the number
    of blocks, so that rounding stays far below a block. With ``parts`` both are rounded to so many parts. A source
    without a weight, or without characters, gets one share."""
    rows = totals.orderBy("src").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        found = [int(r["root"]) for r in rows]
    else:
        given = [max(Fraction(weights.get(r["src"][1:], 0)), Fraction(0)) for r in rows]
        blocks = sum(r["chars"] // block_chars + 2 for r in rows)
        fine = (1 << 61) // max(blocks, 1)  # a block's number times all shares stays below 2 ** 62
        found = [round(g * fine / sum(given)) if g else 0 for g in given]
    whole = sum(found)
    if parts:
        found = [(2 * parts * p + whole) // (2 * whole) if whole else 1 for p in found]
    return [(r["src"], r["chars"], max(1, p)) for r, p in zip(rows, found, strict=True)]


def _written_slots(spark: SparkSession, shares: Sequence[int], blocks: Sequence[int]) -> DataFrame:
    """The table of ``slots_of_blocks``; the driver holds SLOTS_AT_ONCE rows of it."""
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = "s int, block long, slot long"
    spark.createDataFrame([], schema).write.parquet(path)
    slots = slots_of_blocks(shares, blocks)
    while some := list(islice(slots, SLOTS_AT_ONCE)):
        columns = [pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        spark.createDataFrame(pa.table(columns, ["s", "block", "slot"]), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _template(spark: SparkSession, shares: Sequence[int]) -> DataFrame:
    """``(s, i, at)``: where in a period block i of source s comes."""
    nth: list[int] = [0] * len(shares)
    turn = []
    for s in earliest_deadline_first(shares):
        turn.append(f"{s},{nth[s]}")
        nth[s] += 1
    word = F.split(F.col("x"), ",")
    return spark.range(1).select(F.posexplode(F.split(F.lit(";".join(turn)), ";")).alias("at", "x")).select(
        word[0].cast("int").alias("s"), word[1].cast("long").alias("i"), F.col("at").cast("long").alias("at")
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, parts: int | None = None) -> DataFrame:
    """A place in the mix for each row of ``docs(doc_id, source, text)``.

    -> ``(doc_id, source, th, block, release, deadline, slot, position, on_target)``. A document belongs to the block in
    which its first character falls; ``position`` counts all documents from 0 in mix order: by slot, then in source order.
    When a source has run out the others go on in order, each block between its release and its deadline, so all rows are
    kept; ``on_target`` marks the slots before that point. Targets are exact, or rounded to ``parts`` parts. A null source is a source of its own, null and empty texts have no characters,
    rows with equal doc_id are ordered by ``th``, the hash of the text. An empty table gives an empty result."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("th"), key.alias("src"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    rows = cut(rows)
    sums = rows.groupBy("src").agg(F.sum("chars").alias("chars"))
    shares = target_shares(sums.withColumn("root", F.floor(F.sqrt("chars"))), weights, parts, block_chars)
    period = sum(k for _, _, k in shares)
    one = spark.range(1)
    names = F.array(*[F.struct(F.lit(src).alias("src"), F.lit(i).alias("s"), F.lit(k).cast("long").alias("k"), F.lit(chars).cast("long").alias("total")) for i, (src, chars, k) in enumerate(shares)])
    known = one.select(F.explode(names).alias("n")).select("n.*") if shares else one.where("false").select(F.lit("").alias("src"), F.lit(0).alias("s"), F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("total"))

    # A source has run out at this block; empty texts at its end may still lie in it.
    known = known.withColumn("end", F.greatest(F.lit(1), F.ceil(F.col("total") / block_chars)).cast("long"))
    if parts:
        template = _template(spark, [k for _, _, k in shares])

        def slot_of(blocks: DataFrame) -> DataFrame:
            # The template has one row for each slot of a period, at most parts + MAX_SOURCES.
            at = blocks.withColumn("i", F.pmod("block", "k"))
            return at.join(F.broadcast(template), ["s", "i"]).withColumn("slot", F.expr(f"(block div k) * {max(period, 1)}L") + F.col("at")).drop("i", "at")
    else:
        table_of_slots = _written_slots(spark, [k for _, _, k in shares], [max(1, -(-chars // block_chars)) + 1 for _, chars, _ in shares])

        def slot_of(blocks: DataFrame) -> DataFrame:
            return blocks.join(table_of_slots, ["s", "block"])

    horizon = slot_of(known.withColumn("block", F.col("end"))).agg(F.min("slot")).first()[0] or 0
    placed = running_total(rows, "chars", ["doc_id", "th"], ["src"]).withColumn("block", F.expr(f"before div {block_chars}L"))
    placed = slot_of(placed.join(F.broadcast(known), "src"))
    placed = placed.select(
        "doc_id",
        "source",
        "th",
        "block",
        F.expr(f"(block * {period}L) div k").alias("release"),
        F.expr(f"((block + 1) * {period}L + k - 1) div k").alias("deadline"),
        "slot",
        (F.col("slot") < horizon).alias("on_target"),
        F.col("upto"),
        F.lit(1).cast("long").alias("_one"),
    )
    ordered = running_total(placed, "_one", ["slot", "doc_id", "th"])
    return ordered.select("doc_id", "source", "th", "block", "release", "deadline", "slot", F.col("before").alias("position"), "on_target")


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, CAST(coalesce(length(text), 0) AS BIGINT) AS chars FROM documents
), totals AS (
  SELECT src, CAST(sum(chars) AS BIGINT) AS total, CAST(floor(sqrt(CAST(sum(chars) AS BIGINT))) AS BIGINT) AS q FROM d GROUP BY src
), shares AS (
  SELECT src, total, row_number() OVER (ORDER BY src) AS s,
    CASE WHEN sum(q) OVER () = 0 THEN 1 ELSE greatest(1, (2000 * q + sum(q) OVER ()) // (2 * sum(q) OVER ())) END AS k0 FROM totals
), sk AS (SELECT src, total, s, CAST(k0 AS BIGINT) AS k FROM shares
), base AS (SELECT list(k ORDER BY s) AS ks, CAST(sum(k) AS BIGINT) AS period FROM sk
), sim(t, c, ks, period, s, i) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ks, lambda x: CAST(0 AS BIGINT)), ks, period, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM base
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ks) + 1), lambda j: c[j] + CAST(j = pick AS BIGINT)), ks, period, pick, c[pick]
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(ks) + 1), lambda j: c[j] < ks[j] AND (c[j] * period) // ks[j] <= t + 1),
          lambda j: {'due': ((c[j] + 1) * period + ks[j] - 1) // ks[j], 'j': j})).j AS pick FROM sim WHERE t + 1 < period)
), template AS (SELECT t, s, i, period FROM sim WHERE s > 0
), placed AS (
  SELECT d.doc_id, d.source, sk.s, sk.k, (sum(chars) OVER (PARTITION BY d.src ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - chars) // 65536 AS block
  FROM d JOIN sk ON sk.src = d.src
), slots AS (
  SELECT p.doc_id, p.source, CAST(p.block AS BIGINT) AS block, p.k, t.period, CAST((p.block // p.k) * t.period + t.t AS BIGINT) AS slot
  FROM placed p JOIN template t ON t.s = p.s AND t.i = p.block % p.k
), horizon AS (
  SELECT min((e.b // e.k) * t.period + t.t) AS h
  FROM (SELECT s, k, greatest(1, CAST(ceil(total / 65536) AS BIGINT)) AS b FROM sk) e JOIN template t ON t.s = e.s AND t.i = e.b % e.k
)
SELECT doc_id, source, block, (block * period) // k AS release, ((block + 1) * period + k - 1) // k AS deadline, slot,
  row_number() OVER (ORDER BY slot, doc_id) - 1 AS position, slot < h AS on_target
FROM slots, horizon
"""


@query("op8_pfair_mixing", SQL)
def op8(spark, sf_dir):
    """Slot and position of every document in the mix, at square-root targets in SHARES parts, as its SQL rounds them."""
    return mix(table(spark, sf_dir, "documents"), parts=SHARES).drop("th")
