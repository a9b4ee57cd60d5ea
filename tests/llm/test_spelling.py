"""Spelling variants against every pair of words."""

import random
import zlib
from collections import Counter

import pytest

from lineweave.llm import spelling
from lineweave.llm.spelling import variant_forms, vocabulary
from tests.llm.tables import documents


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts, factor=5):
    rows = {}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        rows[w] = (form, n, len(near), counts[form] if form else None)
    out = {}
    for w, row in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out[w] = (row[0], root, *row[1:])
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("shard", [7, 1 << 16])
def test_all_pairs_whatever_the_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "SHARD_SEARCHES", 2 * shard)
    monkeypatch.setattr(spelling, "AT_ONCE", 5)
    monkeypatch.setattr(spelling, "READ", 2)
    rng = random.Random(shard)
    counts = {}
    while len(counts) < 120:
        w = "".join(rng.choice("abÿ") for _ in range(rng.randint(2, 8)))
        counts[w] = rng.choice([5, 6, 30, 200, 2000])
    counts["a" * 300] = 7
    counts["a" * 299 + "b"] = 70
    words = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 AS shard", "'x' AS key")
    assert got(variant_forms(words)) == expected(counts)


def test_one_beginning_for_most_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 16)
    monkeypatch.setattr(spelling, "SHARD_SEARCHES", 16)
    rng = random.Random(3)
    counts = {"con" + "".join(rng.choice("xyz") for _ in range(rng.randint(3, 4))): rng.randint(5, 99) for _ in range(90)}
    assert got(variant_forms(spark.createDataFrame(list(counts.items()), "word string, n long"))) == expected(counts)


def test_chains_end_at_their_root(spark):
    counts = {"aaaaaa": 5**7, "aaaaab": 5**6, "aaaabb": 5**5, "aaabbb": 5**4, "aabbbb": 5**3, "abbbbb": 5**2, "bbbbbb": 5}
    out = got(variant_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in out.values()} == {"aaaaaa"} and out == expected(counts)


def test_no_words(spark):
    assert variant_forms(spark.createDataFrame([], "word string, n long")).count() == 0
    assert variant_forms(spark.createDataFrame([(None, 5), ("a", 9), ("abc", None)], "word string, n long")).count() == 0


def test_vocabulary_counts_longest_runs(spark):
    rows = [(1, "ABCdef, abcdef abcdefÀ ÀBCDEF abcde x_abcdef9 ×÷×÷×÷", None, None, None), (1, "abcdef", None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    words = {r["word"]: r["n"] for r in vocabulary(documents(spark, rows), min_count=1).collect()}
    assert words == {"abcdef": 4, "abcdefÀ": 1, "Àbcdef": 1, "×÷×÷×÷": 1}


def test_query_deletes_one_code_point_in_some_runs(spark, tmp_path):
    rng = random.Random(6)
    stems = ["straße", "Kétchup", "network", "pattern", "abcdefg"]
    rows = [(i if i else None, " ".join(rng.choice(stems) for _ in range(60)), None, None, None) for i in range(60)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text, *_ in rows:
        for w in text.split():
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}
    assert got(spelling.op11(spark, str(tmp_path))) == expected(counts)
