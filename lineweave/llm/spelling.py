"""Spelling variants: words one edit apart, found by search schemes on a bidirectional FM-index of the delimited vocabulary.

If two words differ by one edit, one half of the first stands unchanged at that end of the second. So two searches find all
of them: match the first half exactly from the left delimiter and extend to the right over the other half with one
error, or match the second half exactly from the right delimiter and extend to the left. The first runs on the index of the
reversed words, the second on that of the words; together they are the two sides of the bidirectional index.

The vocabulary grows with the corpus, so each side is cut into shards of consecutive words in the order of its delimited
suffixes. A half is matched by its interval of suffix ranks: how many words are less than it, and how many begin with it,
both counted over range slices. The interval names the shards to search, however long it is. A
shard with very many searches is searched in several tasks. Each pair is counted in one search alone, and what leaves a
search is one row per word: how many near words, and the best of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.operators.ranks import running_total
from lineweave.session import cut, is_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shard of the index, and searches of a task in it.
SHARD_WORDS = 1 << 13
SHARD_SEARCHES = 1 << 14
#: Searches carried at once through the index.
AT_ONCE = 1 << 14
#: Intervals of up to so many suffixes are read; in longer ones every letter is tried.
READ = 32
#: A form is so many times more frequent than its variant.
FACTOR = 5


class FmIndex:
    """Backward search over words, each ended by a delimiter. Letters are numbered from 1; the delimiter is 0."""

    def __init__(self, words: Sequence[str]):
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.letters, text = np.unique(points, return_inverse=True)
        self.size, self.words = len(text), len(words)
        self.base = len(self.letters) + 1
        ends = np.flatnonzero(text == 0)
        left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(self.size)
        rank, step = text.copy(), 1
        while step <= left.max(initial=0):
            after = np.zeros(self.size, np.int64)
            after[:-step] = np.where(left[:-step] >= step, rank[step:] + 1, 0)
            rank = np.unique(rank * (self.size + 2) + after, return_inverse=True)[1]
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.before = text[self.suffixes - 1]
        self.keys = np.sort(self.before * self.size + np.arange(self.size))
        self.starts = ends - left[np.concatenate([[0], ends[:-1] + 1])]

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """Letters as numbers; a letter the index does not have gets the number after the last."""
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        return np.where(known, at, len(self.letters))

    def step(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The suffixes less than ``letter`` before any of the first ``row`` suffixes."""
        return np.searchsorted(self.keys, letter * self.size + row)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(interval, letter, lo, hi)`` of every letter that stands before a suffix of each interval."""
        span = hi - lo
        short = np.flatnonzero(span <= READ)
        n = span[short]
        rows = np.arange(n.sum()) + np.repeat(lo[short] - (np.cumsum(n) - n), n)
        seen = np.unique(np.repeat(short, n) * self.base + self.before[rows])
        long = np.flatnonzero(span > READ)
        every = (long[:, None] * self.base + np.arange(len(self.letters))).ravel()
        of, letter = np.divmod(np.concatenate([seen, every]), self.base)
        of, letter = of[letter > 0], letter[letter > 0]
        low, high = self.step(letter, lo[of]), self.step(letter, hi[of])
        full = high > low
        return of[full], letter[full], low[full], high[full]

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(interval, word)``: the words that are all matched, from one delimiter to the other."""
        delimiter = np.zeros(len(lo), np.int64)
        first, n = self.step(delimiter, lo), self.step(delimiter, hi) - self.step(delimiter, lo)
        of = np.repeat(np.arange(len(lo)), n)
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return of, np.searchsorted(self.starts, self.suffixes[self.keys[at] % self.size])


def one_error(index: FmIndex, points: np.ndarray, first: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(search, word)``: for each pattern the words that begin with its first ``exact`` letters and are one edit away.

    Pattern s is ``points[first[s]:first[s] + length[s]]`` in the order in which the index is walked."""
    text = index.numbers(points)
    lo, hi = np.zeros(len(first), np.int64), np.full(len(first), index.words, np.int64)
    s = np.arange(len(first))
    for k in range(int(exact.max(initial=0))):
        more = exact[s] > k
        done, s_more = s[~more], s[more]
        letter = text[first[s_more] + k]
        low, high = index.step(letter, lo[s_more]), index.step(letter, hi[s_more])
        lo[s_more], hi[s_more] = low, high
        s = np.concatenate([done, s_more[high > low]])
    clean = (s, exact[s], lo[s], hi[s])
    none = np.empty(0, np.int64)
    spent = (none, none, none, none)
    found_s, found_w = [none], [none]

    def keep(state: tuple, mask: np.ndarray) -> tuple:
        return tuple(x[mask] for x in state)

    def joined(*states: tuple) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*states, strict=True))

    while len(clean[0]) or len(spent[0]):
        # One error made: what is left must match.
        over = spent[1] == length[spent[0]]
        of, word = index.whole(spent[2][over], spent[3][over])
        found_s.append(spent[0][over][of])
        found_w.append(word)
        s, j, lo, hi = keep(spent, ~over)
        letter = text[first[s] + j]
        low, high = index.step(letter, lo), index.step(letter, hi)
        spent = keep((s, j + 1, low, high), high > low)
        # No error yet: match, replace, insert or leave out.
        s, j, lo, hi = clean
        of, letter, low, high = index.children(lo, hi)
        s, at = s[of], j[of]
        open_ = at < length[s]
        want = np.full(len(s), -1, np.int64)
        want[open_] = text[first[s[open_]] + at[open_]]
        match = open_ & (letter == want)
        inside = j < length[clean[0]]
        spent = joined(
            spent,
            (s, at, low, high),
            keep((s, at + 1, low, high), open_ & ~match),
            keep((clean[0], j + 1, lo, hi), inside),
        )
        clean = keep((s, at + 1, low, high), match)
    # A word can be reached by several edits, such as either of two equal letters left out.
    pairs = np.unique(np.concatenate(found_s) * (index.words + 1) + np.concatenate(found_w))
    return pairs // (index.words + 1), pairs % (index.words + 1)


def _points(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code points end to end, first of each word, length of each word)``."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.array([len(w) for w in words], np.int64)
    return points, np.cumsum(length) - length, length


def _search(words: list[str], counts: np.ndarray, asked: list[str], half: np.ndarray, mirrored: bool) -> pd.DataFrame:
    """Near words in one shard. With ``mirrored`` all words are reversed, and pairs with equal first halves are left out."""
    index = FmIndex([w[::-1] for w in words])
    plain = [w[::-1] for w in words] if mirrored else words
    by_word = np.argsort(np.argsort(np.array(plain, object), kind="stable"), kind="stable")
    w_points, w_first, w_length = _points(words)
    keys, best, near, best_n = [], [], [], []
    for lo in range(0, len(asked), AT_ONCE):
        some = asked[lo : lo + AT_ONCE]
        points, first, length = _points(some)
        exact = half[lo : lo + AT_ONCE]
        s, w = one_error(index, points, first, length, exact)
        if mirrored:
            # The other half, read from the end: equal ones were found by the other search.
            other = length[s] - exact[s]
            same = w_length[w] >= other
            for k in range(int(other.max(initial=0))):
                live = np.flatnonzero(same & (other > k))
                a, b = s[live], w[live]
                same[live] = points[first[a] + length[a] - 1 - k] == w_points[w_first[b] + w_length[b] - 1 - k]
            s, w = s[~same], w[~same]
        order = np.lexsort((by_word[w], -counts[w], s))
        s, w = s[order], w[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        n = np.diff(np.append(head, len(s)))
        keys += [some[i] for i in s[head]]
        best += [plain[i] for i in w[head]]
        near.append(n)
        best_n.append(counts[w[head]])
    return _frame(keys, np.concatenate(near), np.concatenate(best_n), best)


def _frame(keys: list[str], near: np.ndarray, best_n: np.ndarray, best: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series(keys, dtype=object), "near": near, "best_n": best_n, "best": pd.Series(best, dtype=object)})


def _intervals(side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``side(key, n, exact)`` -> the words ``(key, n, shard)`` and the searches ``(key, exact, shard)``."""
    halves = side.select("exact").distinct()
    probe = halves.select(F.col("exact").alias("key"), F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"), "exact", F.lit(None).cast("long").alias("n"), F.lit(0).alias("w"))
    # After all words that begin with the half: no letter of a word is as great.
    probe = probe.withColumn("key", F.when(F.col("kind") == 2, F.concat("key", F.lit("\uffff"))).otherwise(F.col("key")))
    line = side.select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("exact"), "n", F.lit(1).alias("w")).unionByName(probe)
    ranked = cut(running_total(line, "w", ["key", "kind"]).select("key", "kind", "exact", "n", "before"))
    words = ranked.where("kind = 1").select("key", "n", F.floor(F.col("before") / SHARD_WORDS).alias("shard"))
    bounds = ranked.where("kind <> 1").groupBy("exact").agg(F.min("before").alias("lo"), F.max("before").alias("hi"))
    shards = F.sequence(F.floor(F.col("lo") / SHARD_WORDS), F.floor((F.col("hi") - 1) / SHARD_WORDS))
    searches = side.select("key", "exact").join(bounds, "exact").select("key", F.length("exact").alias("half"), F.explode(shards).alias("shard"))
    return words, searches


def _side(vocabulary: DataFrame, mirrored: bool) -> DataFrame:
    """``(word, near, best_n, best)`` from the searches of one side."""
    size = F.floor(F.length("word") / 2).cast("int")
    key = F.reverse("word") if mirrored else F.col("word")
    exact = F.length("word") - size if mirrored else size
    side = vocabulary.select(key.alias("key"), "n", exact.alias("exact")).selectExpr("key", "n", "substring(key, 1, exact) AS exact")
    words, searches = _intervals(side)
    chunks = searches.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_SEARCHES).alias("chunks"))
    words = words.join(chunks, "shard").select("key", "n", "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    searches = searches.join(chunks, "shard").select("key", "half", "shard", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _frame([], np.empty(0, np.int64), np.empty(0, np.int64), [])
        left = left.sort_values("key")
        return _search(left["key"].tolist(), left["n"].to_numpy(), right["key"].tolist(), right["half"].to_numpy(np.int64), mirrored)

    found = words.groupBy("shard", "chunk").cogroup(searches.groupBy("shard", "chunk")).applyInPandas(run, "key string, near long, best_n long, best string")
    return found.select((F.reverse("key") if mirrored else F.col("key")).alias("word"), "near", "best_n", "best")


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``docs(text)`` with words of Latin letters -> ``(word, n)``: words long and frequent enough, over all rows.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased."""
    return _counted(docs.select(F.explode(_runs("text", min_length)).alias("word")), min_length, min_count)


def _runs(text: str, min_length: int):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))


def _counted(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def variant_forms(vocabulary: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``vocabulary(word, n)`` -> ``(word, form, root, n, n_near, form_n)``, one row per word.

    Words are near when one inserted, deleted or replaced code point makes one the other; ``n_near`` counts them. ``form``
    is the near word of largest ``n``, of equals the least in code-point order, if that is at least ``factor`` (2 or
    more) times ``n``, else null. ``root`` is the last form that is reached from form to form, or the word itself. Words
    are distinct and have two code points or more; null words and rows without a count are left out, and other columns are not read."""
    known = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")).where("n is not null and length(word) >= 2"))
    both = _side(known, False).unionByName(_side(known, True))
    least = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    best = both.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("least"))
    placed = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("least.m")).alias("best_n"), "least.best")
    rises = F.col("best_n") >= factor * F.col("n")
    placed = cut(placed.select("word", "n", "n_near", F.when(rises, F.col("best")).alias("form"), F.when(rises, F.col("best_n")).alias("form_n")))
    roots = _roots(placed.where("form is not null").select("word", F.col("form").alias("root")))
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Follows links to their ends, twice as far each round. Counts rise along a chain, so it has an end."""
    links = cut(links)
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        moved = cut(links.join(ahead, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")))
        if is_empty(moved.where("_moved")):
            return links
        links = moved.drop("_moved")


SQL = """
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS w FROM documents
), once AS (
  SELECT doc_id, w, count(*) AS k FROM found WHERE length(w) >= 6 GROUP BY doc_id, w
), hashed AS (
  SELECT w, k, xor(list_reduce(
      flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) AS BIGINT) - 64] END)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM once, bytes
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), shorter AS (
  SELECT word, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word AS u, b.word AS v FROM shorter a JOIN shorter b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.cut
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.cut
), best AS (
  SELECT p.u AS word, count(*) AS n_near, arg_min(p.v, (-w.n, p.v)) AS form, max(w.n) AS form_n FROM near p JOIN words w ON w.word = p.v GROUP BY p.u
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT k.word, f.form, depth + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""


@query("op11_spelling_variants", SQL)
def op11(spark, sf_dir):
    """Words of all documents, one code point deleted in one run of 199 (by the crc32 of document and run), with their forms.

    A null doc_id has no hash, so its runs stay whole."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(_runs("text", 6)).alias("word"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")))
    at = F.col("h") % F.length("word")
    short = F.concat(F.expr("substring(word, 1, cast(h % length(word) as int))"), F.substr("word", (at + 2).cast("int")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, short).otherwise(F.col("word")).alias("word"))
    return variant_forms(_counted(words, 6, 5))
