"""Line dedup, n-gram join and embedding dedup against brute force."""

import random
import re

import numpy as np
import pytest

from lineweave.llm.embedding_dedup import choose_tables, near_vectors, same_cell
from lineweave.llm.line_dedup import drop_lines, later_copies
from lineweave.llm.ngram_join import choose_bands, ngram_classes
from tests.llm.tables import documents, prose


def n_words(line):
    return len(re.findall("[\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0eff]|[^ \t\r\f\v\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0eff]+", line))


def brute_lines(rows, min_words):
    """Every later copy of every run, by looking at all pairs of places; blank lines are passed over."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: d[0])
    lines = [(d, k, x) for d, t in docs for k, x in enumerate(t.split("\n")) if n_words(x)]
    gone = set()
    for j in range(len(lines)):
        for i in range(j):
            n = words = 0
            while j + n < len(lines) and lines[i + n][2] == lines[j + n][2] and lines[i][0] == lines[i + n][0] and lines[j][0] == lines[j + n][0]:
                words += n_words(lines[j + n][2])
                n += 1
            if words >= min_words:
                gone |= {(lines[j + m][0], lines[j + m][1]) for m in range(n)}
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def test_double_spaced_verse_and_unspaced_scripts(spark):
    verse = "the cat sat\n\non mats\n \nby day\n\n\nand slept"
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\n\u6211\u4eec\u53bb\u516c\u56ed"
    rows = [(1, f"one\n{verse}", "en", "s", 0), (2, f"two\n{verse}\nthree", "en", "s", 0), (3, chinese, "zh", "s", 0), (4, f"{chinese}\n\u5f88\u597d", "zh", "s", 0), (5, "on mats\n\nby", "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in drop_lines(documents(spark, rows), later_copies(documents(spark, rows))).collect()}
    assert got == brute_lines(rows, 5)
    assert got[2].split() == ["two", "three"] and got[4] == "\u5f88\u597d" and got[5] == rows[4][1]


@pytest.mark.parametrize("min_words", [1, 3, 5, 9])
def test_line_runs(spark, min_words):
    rng = random.Random(min_words)
    pool = ["a b", "c", "d e f", "", "g h i j k l", "m", " ", "\u4eca\u5929", "\u6211a \u3042"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))), "en", "s", 0) for i in range(25)]
    docs = documents(spark, [*rows, rows[3], (90, None, "en", "s", 0)])
    got = drop_lines(docs, later_copies(docs, min_words)).collect()
    want = brute_lines(rows, min_words)
    assert len(got) == 27
    assert all(r["text"] == want.get(r["doc_id"]) for r in got)
    assert all(r["th"] == "th" and r["n_lines"] == (0 if r["text"] is None else len(dict((x[0], x[1]) for x in rows)[r["doc_id"]].split("\n"))) for r in got)


ALONE = "\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0eff"


def brute_classes(rows, words=5, threshold=0.8):
    grams = []
    for r in rows:
        w = re.findall(f"[{ALONE}]|[a-z0-9\x80-\U0010ffff]+", re.sub("[\u00a0\u00ab\u00bb\u2000-\u206f\u3000-\u3003]", " ", re.sub(f"([{ALONE}])", r" \1 ", (r[1] or "").lower())))
        grams.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else {(r[1] or "").strip()})
    n = len(rows)
    link = [[j for j in range(n) if j != i and (grams[i] == grams[j] or len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= threshold)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in link[i]:
                root[i] = min(root[i], root[j])
    return sorted((rows[i][0], rows[root[i]][0], len(link[i])) for i in range(n))


def test_ngram_classes(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        text = prose(rng.randint(3, 120), rng).split()
        for _ in range(rng.randint(1, 5)):
            w = text[:]
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "new"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    rows += [(len(rows) + k, t, "en", "s", 0) for k, t in enumerate(["", None, "  ", "HELLO, there.", "hello THERE", "?!", "?! ", "--", "Ab\u00e4r 1!2", "ab\u00c4r 1 2"])]
    got = ngram_classes(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_ngrams_beyond_ascii(spark):
    """Texts of scripts without spaces that differ in one character, and re-quoted ones, are linked."""
    rng = random.Random(21)
    han = [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)]
    text = prose(40, rng)
    quoted = text.replace(" ", "\u201d ", 1).replace(" ", "\u00a0\u201c", 2)
    texts = ["".join(han), "".join(han[:150] + ["\u3042"] + han[151:]), "\u3002".join(["".join(han[:100]), "".join(han[100:])]), "".join(han[::-1]), text, "\u00ab" + quoted + "\u00bb\u2026", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35 abc\u4e00d\u00e9 \U00020001"]
    rows = [(i, t, "zh", "s", 0) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_classes(documents(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert [c for _, c, _ in got] == [0, 0, 0, 3, 4, 4, 6]


def test_many_near_copies_are_split(spark, monkeypatch):
    """A bucket larger than a block: every link is counted, whatever the blocks."""
    from lineweave.llm import candidates

    monkeypatch.setattr(candidates.shared_buckets, "__defaults__", (16,))
    rng = random.Random(2)
    text = prose(200, rng).split()
    rows = []
    for i in range(150):
        w = text[:]
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = ngram_classes(documents(spark, rows, clash=False)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95, 1.0):
        bands, rows = choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 or bands * rows >= 128
    assert same_cell(0.0) == 1.0 and same_cell(10.0) < 0.1
    assert choose_tables(0.93, 0.999) > choose_tables(0.98, 0.999)


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        center = rng.standard_normal(24)
        for _ in range(6):
            rows.append((len(rows), (center + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.25, 0.3])).tolist(), c % 3))
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum()
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        root = np.minimum(root, np.where(near, root[None], len(rows)).min(axis=1))
    assert sum(got[i]["component_id"] == root[i] for i in range(len(rows))) >= 0.98 * len(rows)


def test_vectors_that_compare_with_nothing(spark, tmp_path):
    from tests.llm.tables import write_tables

    vectors = spark.read.parquet(write_tables(spark, tmp_path) + "/embeddings.parquet")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(vectors).collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    same = [(i, 4, None, False) for i in (1, 2, 2, 3)] + [(None, 4, None, True)]
    assert got == sorted(alone + same, key=str)
