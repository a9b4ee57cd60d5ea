"""Periodic runs against all starts and periods; license blocks against all windows."""

import random

import numpy as np
import pytest

from lineweave.llm import license_scan, periodic_runs
from lineweave.llm.license_scan import scan_licenses
from lineweave.llm.periodic_runs import collapse_runs, find_runs
from tests.llm.tables import documents


def every_run(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            u = x[i : j + q]
            if len(u) >= 4 * q and not any(all(u[k] == u[k + p] for k in range(len(u) - p)) for p in range(1, q)):
                out.append((i, len(u), q))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(rng, n):
    x = []
    while len(x) < n:
        part = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 25))]
        x += (part * rng.randint(2, 5) if rng.random() < 0.3 else part) * rng.choice([1, 1, 2, 4, 6])
    if x and rng.random() < 0.3:
        x[rng.randrange(len(x))] = 9
    return x


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_all_runs(seed):
    rng = random.Random(seed)
    for _ in range(250):
        x = repetitive(rng, rng.randint(0, 110))
        assert [tuple(r) for r in find_runs(np.array(x, np.int64)).tolist()] == every_run(x)


def test_long_periods_and_word_sequences_like_thue_and_morse():
    rng = np.random.default_rng(3)
    part = rng.integers(0, 50, 3000)
    line = np.concatenate([rng.integers(100, 200, 777), np.tile(part, 5)[: 4 * 3000 + 1], rng.integers(100, 200, 99)])
    assert find_runs(line).tolist() == [[777, 12001, 3000]]
    tm = np.array([bin(i).count("1") % 2 for i in range(1 << 13)])
    assert find_runs(tm).tolist() == []  # no block comes three times in a row


def test_runs_in_texts(spark):
    rng = random.Random(8)
    texts = ["", None, " \n\t", "a", "a a a a a a", "a a a a a", "é b é b é b é b x", "x " * 40000, "one two " * 5 + "one  three"]
    texts += [" ".join("abcdefghij"[i] for i in repetitive(rng, 60)) for _ in range(40)]
    docs = documents(spark, [(i if i else None, t, "en", "a", None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in collapse_runs(docs).collect()}
    for i, t in enumerate(texts):
        words = (t or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        if len(words) < 1000:
            runs = [r for r in every_run(words) if r[1] >= 6]
            assert [(r["start"], r["length"], r["period"]) for r in got[i or None]["runs"]] == runs
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            assert got[i or None]["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert got[7]["collapsed"] == "x"


def test_edited_texts_have_the_asked_tail(spark):
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    words = [f"w{k}" for k in range(83)]
    rows = periodic_runs._tailed(documents(spark, [(i, "\n ".join(words), None, None, None) for i in ids] + [(3, None, None, None, None)])).collect()
    for r in rows:
        if r["doc_id"] == 3:
            assert r["text"] is None
            continue
        g = zlib.crc32(str(r["doc_id"]).encode()) // 10
        a, n = g % 83, 83
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"].split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isdigit() and not ("a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def blocks_of(words, label, template, threshold):
    """Merged stretches of windows that hold enough of the template, by trying every window."""
    want = set(template.split())
    width = license_scan.block_words(len(template.split()))
    good = {s: len(want & set(words[s : s + width])) / len(want) for s in range(len(words))}
    good = {s: v for s, v in good.items() if v * len(want) >= license_scan.needed(len(want), threshold)}
    out = []
    for s in sorted(good):
        if out and out[-1][1] == s - 1:
            out[-1] = (out[-1][0], s, max(out[-1][2], good[s]))
        else:
            out.append((s, s, good[s]))
    return [(label, s, min(e + width, len(words)) - s, v) for s, e, v in out]


def test_blocks_are_all_blocks(spark):
    rng = random.Random(5)
    templates = [("a", "one two three four five six seven eight nine ten"), ("b", "two two four"), ("b", "é x9 one the"), ("c", "the")]
    phrases = [("p", "one two"), ("q", "the the the"), ("p", "four")]
    pool = "one two three four five six seven eight nine ten é x9 the THE the the filler".split()
    texts = [None, "", "  ", "the", "ONE,two;THREE", "İ One two"]
    for _ in range(300):
        t = [rng.choice(pool) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            part = templates[0][1].split()
            part[rng.randrange(10)] = rng.choice(pool)
            at = rng.randint(0, len(t))
            t[at:at] = part
        texts.append(rng.choice([" ", ", ", "\n"]).join(t))
    docs = documents(spark, [(i if i else None, t, "en", "a", None) for i, t in enumerate(texts)])
    for threshold in (0.5, 0.8, 1.0):
        for r in scan_licenses(docs, templates, phrases, threshold).collect():
            w = words_of(texts[r["doc_id"] or 0])
            assert r["n_words"] == len(w)
            want = [b for label, t in templates for b in blocks_of(w, label, t, threshold)]
            assert sorted(tuple(b) for b in r["blocks"]) == sorted(want)
            places = [(label, s, len(p.split())) for label, p in phrases for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
            assert sorted(tuple(p) for p in r["places"]) == sorted(places)


def test_changed_notices_are_found_and_clean_texts_left_alone(spark):
    mit = dict((b, a) for a, b in license_scan.TEMPLATES)
    long_ones = [t for t in mit if len(set(t.split())) > 13]  # two words off stay above the threshold
    rng = random.Random(2)
    rows = []
    for i, t in enumerate(long_ones):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        del w[rng.randrange(len(w))]
        rows.append((i, "Some words before it.\n" + " ".join(w).upper() + ".\nAnd after.", None, None, None))
    rows += [(100, "This license plate is free to any person who may obtain it under the terms of the public.", None, None, None), (101, "Licensed under the Eclipse Public License, Version 2.0.", None, None, None)]
    got = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in scan_licenses(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(long_ones))] == [{mit[t]} for t in long_ones]
    assert got[100] == set() and got[101] == set()


def test_frequencies_count_documents_not_words(spark):
    docs = documents(spark, [(1, "the the cat", None, None, None), (1, "the the cat", None, None, None), (2, "A cat", None, None, None), (3, None, None, None, None)])
    assert license_scan.word_frequencies(docs, ["the", "cat", "a", "dog"]) == {"the": 2, "cat": 3, "a": 1, "dog": 0}


def test_a_template_without_a_word_is_an_error(spark):
    with pytest.raises(ValueError, match="no word"):
        scan_licenses(documents(spark), [("a", " ")])
