"""Line dedup: a suffix array over line ids by prefix doubling, and deletion of later copies of repeated line runs.

Suffixes are ranked by their first line, then by 2, 4, ... lines: the rank at depth 2d of a position is the rank of the
pair (rank at p, rank at p + d). Ranks count the suffixes before, so every round is a refinement of the suffix order, and
positions with one rank at depth d are an interval of the suffix array whose common prefix is at least d lines. A suffix
that is alone in its interval has no copy at that depth and leaves the rounds (discarding), so only repeated lines are ever
shuffled again. Doubling ends at the depth that decides every deletion: a run counts from ``min_words`` words on, and a
line of the sequence has one word at least: blank lines are no part of it, so they neither end a run nor go with one.

A run of L lines is named by two overlapping intervals of depth 2^h <= L, as in a sparse table. The shortest runs that
reach ``min_words``, taken forwards from each line and backwards from it, cover all longer repeated runs exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.llm.words import UNSPACED, char_class
from lineweave.operators.ranks import running_total
from lineweave.session import cut

#: Thai, Lao, Burmese, Khmer, Japanese and Chinese are written without spaces: there every character counts as a word.
_ALONE = char_class(UNSPACED)
WORD = f"[{_ALONE}]|[^ \\t\\r\\f\\x0B{_ALONE}]+"


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, j, k, words, a, b)`` for every line with a word: the j-th of these, line k of the text; (a, b) is its 128-bit id."""

    def counted(line: Column, k: Column) -> Column:
        return F.struct(k.alias("k"), line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words"))

    worded = F.filter(F.transform(F.split("text", "\n", -1), counted), lambda x: x["words"] > 0)
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(worded).alias("j", "x"))
    return lines.select("doc_id", "th", "j", "x.k", "x.words", F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(1), "x.line").alias("b"))


def _ranked(keys: DataFrame, names: list[str], rank: str) -> DataFrame:
    """``(names, rank)`` of every name that occurs twice or more: how many suffixes come before it."""
    counts = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return running_total(counts, "_n", names).select(*names, F.col("before").alias(rank))


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """``(doc_id, th, j, k, words, r0, r1, ...)`` for each repeated line; ``rh`` is the rank of the suffix at 2^h lines.

    A rank is null where the first 2^h lines occur nowhere else, or reach past a line that is not repeated
    or the end of the document. The last rank is at the greatest power of two up to ``depth``."""
    lines = _lines(docs)
    # Rows that come twice are one document.
    at = lines.join(_ranked(lines, ["a", "b"], "r0"), ["a", "b"]).drop("a", "b")
    at = cut(at.dropDuplicates(["doc_id", "th", "j"]))
    doc = W.partitionBy("doc_id", "th").orderBy("j")
    h = 0
    while 2 << h <= depth:
        step, low, high = 1 << h, f"r{h}", f"r{h + 1}"
        after = F.when(F.lead("j", step).over(doc) == F.col("j") + step, F.lead(low, step).over(doc))
        paired = at.withColumn("_next", after)
        names = _ranked(paired.where(f"{low} is not null and _next is not null"), [low, "_next"], high)
        at = cut(paired.join(names, [low, "_next"], "left").drop("_next"))
        h += 1
    return at


def _shortest_runs(at: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, th, ks, length, x, y)``: the shortest runs of repeated lines ``ks`` with enough words, by name (length, x, y)."""
    doc = W.partitionBy("doc_id", "th").orderBy("j")

    def run(step) -> Column:
        found, words, open_ = [], F.col("words"), F.lit(True)
        for n in range(1, min_words + 1):
            if n > 1:
                open_ = open_ & (step("j", n - 1) == F.col("j") + (n - 1) * step.sign)
                words = words + step("words", n - 1)
            h = n.bit_length() - 1
            ends = (step(f"r{h}", 0), step(f"r{h}", n - (1 << h))) if step.sign > 0 else (step(f"r{h}", n - 1), step(f"r{h}", (1 << h) - 1))
            ks = F.array(*[step("k", m) for m in range(n)][:: step.sign])
            name = F.struct(ks.alias("ks"), F.lit(n).alias("length"), ends[0].alias("x"), ends[1].alias("y"))
            found.append(F.when(F.coalesce(open_ & (words >= min_words), F.lit(False)), name))
        return F.coalesce(*found)

    def ahead(col: str, n: int) -> Column:
        return F.lead(col, n).over(doc) if n else F.col(col)

    def back(col: str, n: int) -> Column:
        return F.lag(col, n).over(doc) if n else F.col(col)

    ahead.sign, back.sign = 1, -1
    both = at.select("doc_id", "th", run(ahead).alias("f"), run(back).alias("g"))
    return (
        both.select("doc_id", "th", F.explode(F.array_distinct(F.array("f", "g"))).alias("run"))
        .select("doc_id", "th", "run.*")
        .where("x is not null and y is not null")
    )


def later_copies(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``(doc_id, th, gone)``: for each document with later copies, the numbers of the lines to delete, ascending.

    A run of lines (blank ones between do not count, and stay) of at least ``min_words`` words is a later copy when the same lines occur
    in an earlier place: a lower doc_id (null first), or higher up in the same document; the two may overlap. Lines must
    be equal byte for byte. ``th`` is the hash of the text; rows with equal doc_id and text are one document, and rows of
    one doc_id with different texts are ordered by that hash. A null or empty text has no line."""
    runs = _shortest_runs(suffix_ranks(docs.select("doc_id", "text"), min_words), min_words)
    spot = F.struct("doc_id", "th", F.col("ks")[0].alias("start"))
    names = ["length", "x", "y"]
    first = runs.groupBy(*names).agg(F.min(spot).alias("first"))
    return (
        runs.join(first, names)
        .where(spot > F.col("first"))
        .select("doc_id", "th", F.explode("ks").alias("k"))
        .groupBy("doc_id", "th")
        .agg(F.sort_array(F.collect_set("k")).alias("gone"))
    )


def drop_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with the lines in ``gone`` cut out of ``text``, plus ``n_lines`` (before) and ``n_removed``.

    Other columns stay as they are, except that a column of one of those two names is replaced. A null text stays null."""
    keep = docs.drop("n_lines", "n_removed")
    marks = gone.select(F.col("doc_id").alias("_ld_id"), F.col("th").alias("_ld_th"), F.col("gone").alias("_ld_gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.xxhash64("text") == F.col("_ld_th"))
    lines = F.split("text", "\n", -1)

    def left(all_lines: Column) -> Column:
        index = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_ld_gone"))
        return F.transform(index, lambda i: F.get(all_lines, i))

    cut_text = F.array_join(F.flatten(F.transform(F.array(lines), left)), "\n")
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(cut_text)
    out = keep.join(marks, same, "left")
    counts = [
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_ld_gone").isNull(), F.lit(0)).otherwise(F.size("_ld_gone")).cast("long").alias("n_removed"),
    ]
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep.columns], *counts)


SQL = (
    """
WITH lines AS (
  SELECT doc_id, k, line, len(regexp_extract_all(line, '%s')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
        FROM documents WHERE text IS NOT NULL)
), docs AS (
  SELECT doc_id, list(line ORDER BY k) AS ls, list(w ORDER BY k) AS ws, list(k ORDER BY k) AS ks FROM lines WHERE w > 0 GROUP BY doc_id
), spots AS (
  SELECT doc_id, ls, ws, ks, unnest(range(1, len(ls) + 1)) AS p FROM docs
), sized AS (
  SELECT doc_id, ls, ks, p,
    list_filter(range(1, 6), lambda j: p + j - 1 <= len(ls) AND list_sum(ws[p:p + j - 1]) >= 5)[1] AS f,
    list_filter(range(1, 6), lambda j: p - j + 1 >= 1 AND list_sum(ws[p - j + 1:p]) >= 5)[1] AS g
  FROM spots
), runs AS (
  SELECT doc_id, p AS s, ks[p:p + f - 1] AS own, array_to_string(ls[p:p + f - 1], chr(10)) AS t FROM sized WHERE f IS NOT NULL
  UNION
  SELECT doc_id, p - g + 1, ks[p - g + 1:p], array_to_string(ls[p - g + 1:p], chr(10)) FROM sized WHERE g IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS nth FROM runs
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(own) AS k FROM ranked WHERE nth > 1) GROUP BY doc_id
)
SELECT d.doc_id,
  CASE WHEN g.ks IS NULL THEN d.text ELSE array_to_string(
    list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(g.ks, i)),
                   lambda i: string_split(d.text, chr(10))[i]), chr(10)) END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.ks), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""
    % WORD.replace("\\x0B", "\\v")
)


@query("op1_line_dedup", SQL)
def op1(spark, sf_dir):
    """Every document without its later copies of line runs of five words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, later_copies(docs))
