"""Packing and mixing: plans by brute force and by their guarantees."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lineweave.llm import mixing, packing
from lineweave.session import cut
from tests.llm.tables import document_rows, documents, prose


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 16, 50])
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, cap + 1), min(cap, 9))}
    used: dict[int, int] = {}
    ranks = {n: [] for n in histogram}
    for length, first, upto, each, base, at in packing.plan_best_fit(histogram, cap):
        for r in range(first, upto):
            ranks[length].append(r)
            seq, off = base + (r - first) // each, at + (r - first) % each * length
            assert used.get(seq, 0) == off
            used[seq] = off + length
    assert all(sorted(v) == list(range(histogram[n])) for n, v in ranks.items())
    assert max(used.values()) <= cap
    # One document after the other, into the fullest sequence it fits.
    free: list[int] = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = min((f for f in free if f >= n), default=None)
            if fit is None:
                free.append(cap - n)
            else:
                free.remove(fit)
                free.append(fit - n)
    assert len(used) == len(free)


def test_pieces_are_the_tokenizers_ids(spark):
    encoder = packing.Encoder(packing.vocabulary_path())
    texts = [r[1] or "" for r in document_rows()] + ["It's 5 o'clock... ÀÉ ß ﬁ é́ don't<|endoftext|> x\x1cy", "A.B,c. .. ,, end.\nNew Line!", "ΣΑΣ İstanbul"]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    got = packing.pack_documents(documents(spark)).collect()
    want = []
    for r in document_rows():
        ids = np.array([*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(r[0]), k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("shares", [[1], [1, 1, 1], [500, 300, 199, 1], [7, 5, 3, 2, 2], [1] * 40 + [60]])
def test_earliest_deadline_first(shares):
    slots, period = mixing.earliest_deadline_first(shares), sum(shares)
    assert [slots.count(s) for s in range(len(shares))] == shares
    seen = [0] * len(shares)
    for t, s in enumerate(slots):
        i = seen[s]
        assert i * period // shares[s] <= t < -(-(i + 1) * period // shares[s])
        seen[s] += 1
        assert all(abs(seen[k] - (t + 1) * shares[k] / period) < 1 for k in range(len(shares)))


def test_mix_keeps_to_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 30), "en", rng.choices(["a", "b", None], [6, 3, 1])[0], 0) for i in range(600)]
    got = sorted(mixing.mix(documents(spark, rows), {"a": 0.2, "b": 0.5}, block_chars=100).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(600)) and sorted(r["doc_id"] for r in got) == list(range(600))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    blocks: dict = {}
    for r in got:
        if r["on_target"]:
            blocks.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in blocks.values())
    target = {"a": 200, "b": 500, None: 1}
    slots = max(blocks) + 1
    for s, k in target.items():
        # Blocks that hold the start of no document leave a slot without rows.
        assert sum(s in v for v in blocks.values()) <= slots * k / 701 + 1


def test_targets_are_not_rounded_to_a_short_period(spark):
    def shares(rows, weights=None):
        totals = spark.createDataFrame(rows, "src string, chars long, root long")
        found = [k for _, _, k in mixing.target_shares(totals, weights)]
        return [k / sum(found) for k in found]

    two = [("=a", 10**10, 10**5), ("=b", 10**10, 10**5)]
    assert shares(two, {"a": 1 / 3, "b": 2 / 3}) == pytest.approx([1 / 3, 2 / 3], rel=1e-9)
    assert shares(two, {"a": 0.00001, "b": 0.99999}) == pytest.approx([0.00001, 0.99999], rel=1e-9)
    many = [(f"={i:04}", i * i, i) for i in range(1, 2001)]
    assert shares(many) == pytest.approx([i / sum(range(1, 2001)) for i in range(1, 2001)])


def test_long_mix_stays_within_a_block(spark):
    weights = {"a": 1 / 3, "b": 2 / 3 - 0.0004, "c": 0.0004}
    rows = [(i, "x" * 10, "en", "abc"[0 if i < 4000 else 1 if i < 11990 else 2], 0) for i in range(12_000)]
    got = [r for r in mixing.mix(documents(spark, rows, clash=False), weights, block_chars=10).collect() if r["on_target"]]
    got.sort(key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got))) and len(got) > 11_000
    seen = dict.fromkeys(weights, 0)
    for r in got:
        seen[r["source"]] += 1
        assert all(abs(seen[s] - (r["slot"] + 1) * w) < 1 + 1e-6 for s, w in weights.items())


def test_mix_of_awkward_rows(spark):
    got = mixing.mix(documents(spark)).collect()
    assert sorted(r["position"] for r in got) == list(range(len(document_rows())))


def test_packed_sequences_keep_the_mix(spark, monkeypatch):
    """Short and long documents, as much of each: any beginning of the sequences has about half of each."""
    monkeypatch.setattr(corpus_pipeline, "mix", lambda docs: mixing.mix(docs, block_chars=4000))
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(20, 60), rng), "en", "short", 0) for i in range(2400)]
    rows += [(5000 + i, prose(rng.randint(200, 600), rng), "en", "long", 0) for i in range(240)]
    mixed = cut(corpus_pipeline.source_mixing(spark, documents(spark, rows, clash=False), ""))
    got = sorted(corpus_pipeline.packing(spark, mixed, "").collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    last = got[-1]["sequence_id"]
    assert {r["sequence_id"] for r in got} == set(range(last + 1))
    for share in (0.2, 0.4, 0.6, 0.8):
        sizes = [0, 0]
        for r in got:
            if r["sequence_id"] < share * last:
                sizes[r["doc_id"] >= 5000] += r["length"]
        assert abs(sizes[0] / sum(sizes) - 0.5) < 0.1, (share, sizes)
    assert sum(r["length"] for r in got) > 0.95 * 2048 * last
