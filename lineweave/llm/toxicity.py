"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text.

Two zstandard dictionaries are made from training text. The ordinary one is trained on windows of ordinary documents. The
toxic one has the same content and, before it, text that sets toxic documents apart. So what both know costs the same in
both, and the difference of the compressed lengths of a window measures toxic text alone. Ordinary windows that still gain
from the toxic text go into both dictionaries, round by round. A document's largest differences are calibrated on other
training documents to a probability, on which the threshold is set."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.lang_id import held_out
from lineweave.llm.registry import query, table

#: Bounds of the training sample, in the mean: documents of a class for the dictionaries, windows of each, documents of a class to calibrate on.
DICTIONARY_DOCS = 2_000
DICTIONARY_WINDOWS = 100
CALIBRATION_DOCS = 3_000
WINDOW_BYTES = 64
ORDINARY_BYTES, TELLING_BYTES, HARD_BYTES = 65_536, 4_096, 16_384
ROUNDS = 4
#: A word sets toxic documents apart from this z-score and number of documents on.
TELLING_Z, TELLING_DOCS = 3.5, 8
THRESHOLD = 0.3
FEATURES = 6

_WORD = re.compile(rb"[^\s.,;:!?\"()|]{3,}")


def windows(text: str) -> list[bytes]:
    """The text in lower case in pieces of at most WINDOW_BYTES bytes, cut at white space where there is some."""
    raw = text.lower().encode()
    out, at = [], 0
    while at < len(raw):
        end = at + WINDOW_BYTES
        if end < len(raw):
            gap = max(raw.rfind(b" ", at + 1, end), raw.rfind(b"\n", at + 1, end))
            end = gap if gap > at else end
        out.append(raw[at:end])
        at = end
    return out


class Distance:
    """Bytes saved by the toxic dictionary, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic)

    @staticmethod
    def _compressor(content: bytes):
        import zstandard as zstd

        parameters = zstd.ZstdCompressionParameters(
            compression_level=13,
            min_match=3,
            strategy=zstd.STRATEGY_BTOPT,
            window_log=18,
            hash_log=16,
            chain_log=16,
            search_log=4,
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
            format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        content = zstd.ZstdCompressionDict(content or b" " * 16, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=parameters)
        return zstd.ZstdCompressor(dict_data=content, compression_params=parameters).compress

    def saved(self, pieces: Sequence[bytes]) -> np.ndarray:
        a, b = self.ordinary, self.toxic
        return np.array([len(a(p)) - len(b(p)) for p in pieces], np.int64)

    def features(self, text: str | None) -> list[float]:
        """The three largest differences, how many are 2 and 4 or more, and the number of windows (the last three as logs)."""
        d = np.sort(self.saved(windows(text or "")))[::-1]
        top = [float(x) for x in d[:3]] + [0.0] * (3 - min(3, len(d)))
        return [*top, *(float(np.log1p(n)) for n in ((d >= 2).sum(), (d >= 4).sum(), len(d)))]


class ToxicityModel:
    """Dictionaries and a logistic calibration; without both classes in the training rows, a constant score."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", weights: np.ndarray | None = None, mean=0.0, scale=1.0, constant: float = 0.0):
        self.ordinary, self.toxic, self.weights, self.mean, self.scale, self.constant = ordinary, toxic, weights, mean, scale, constant

    def distance(self) -> Distance:
        return Distance(self.ordinary, self.toxic)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.constant)
        z = (features - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> bytes:
    """Words that far more toxic documents hold than ordinary ones; the clearest come last, where they are cheapest."""
    holds = [Counter(w for doc in side for w in {m for p in doc for m in _WORD.findall(p)}) for side in (toxic, ordinary)]
    n, m = len(toxic), len(ordinary)
    scored = []
    for word, c in holds[0].items():
        p = (c + holds[1][word]) / (n + m)
        z = (c / n - holds[1][word] / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
        if z >= TELLING_Z and c >= min(TELLING_DOCS, max(2, n // 20)):
            scored.append((z, word))
    return (b" ".join(w for _, w in sorted(scored)) + b" ")[-TELLING_BYTES:]


def _trained(pieces: list[bytes], size: int) -> bytes:
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, pieces).as_bytes()
    except zstd.ZstdError:  # too little text to choose from
        return b"".join(pieces)[-size:]


def make_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """``(ordinary, toxic)`` dictionary contents from the windows of training documents."""
    plain = [p for doc in ordinary for p in doc]
    base, telling = _trained(plain, ORDINARY_BYTES), _telling(toxic, ordinary)
    hard = b""
    for _ in range(ROUNDS):
        saved = Distance(hard + base, telling + hard + base).saved(plain)
        worst = list(dict.fromkeys(plain[i] for i in np.argsort(saved, kind="stable") if saved[i] >= 2))
        if not worst:
            break
        hard += b" ".join(worst)[-HARD_BYTES:] + b" "
    return hard + base, telling + hard + base


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = ridge * len(x) * 1e-2 * np.append(np.ones(len(w) - 1), 0)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled documents that are not held out.

    Half of them, by a hash, are for the dictionaries and half for calibration. Of each class a share is kept, by another hash,
    so that the bounds above hold in the mean; the calibration takes the shares back out of its constant. A doc_id with several labels counts
    as toxic if one says so. What reaches the driver is bounded: windows of the first half, a few numbers for each document
    of the second."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.withColumns({"h": F.xxhash64("doc_id"), "half": F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)), "draw": F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 20)) / float(1 << 20)})
    sizes = {(r["half"], r["toxic"]): r["n"] for r in known.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {(half, k): min(1.0, most / max(1, sizes.get((half, k), 0))) for half, most in ((0, DICTIONARY_DOCS), (1, CALIBRATION_DOCS)) for k in (0, 1)}

    def drawn(half: int) -> DataFrame:
        share = F.when(F.col("toxic") == 1, shares[half, 1]).otherwise(shares[half, 0])
        return known.where((F.col("half") == half) & (F.col("draw") < share))

    first, second = drawn(0), drawn(1)
    text = docs.where("text is not null").select("doc_id", "text")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "pieces": [_some(windows(t), i) for t, i in zip(pdf["text"], pdf["h"], strict=True)]})

    # Both samples are bounded, so they may be broadcast.
    picked = text.join(F.broadcast(first.select("doc_id", "toxic", "h")), "doc_id").dropDuplicates(["doc_id"])
    rows = picked.select("toxic", "text", "h").mapInPandas(cut_up, "toxic int, pieces array<binary>").collect()
    sides = {k: list({tuple(map(bytes, r["pieces"])): None for r in rows if r["toxic"] == k}) for k in (0, 1)}
    if not sides[0] or not sides[1]:
        share = len(sides[1]) / max(1, len(sides[0]) + len(sides[1]))
        return ToxicityModel(constant=float(share))
    model = ToxicityModel(*make_dictionaries(sides[1], sides[0]))
    rest = text.join(F.broadcast(second.select("doc_id", "toxic")), "doc_id").dropDuplicates(["doc_id"])
    got = _measured(rest, model, ["toxic"]).collect()
    x, y = np.array([r["features"] for r in got], float).reshape(-1, FEATURES), np.array([r["toxic"] for r in got], float)
    if 0 < y.sum() < len(y):
        model.weights, model.mean, model.scale = fit_logistic(x, y)
        model.weights[-1] -= np.log(shares[1, 1] / shares[1, 0])
    else:
        model.constant = float(y.mean()) if len(y) else 0.0
    return model


def _some(pieces: list[bytes], seed: int) -> list[bytes]:
    if len(pieces) <= DICTIONARY_WINDOWS:
        return pieces
    at = np.random.default_rng(abs(int(seed))).choice(len(pieces), DICTIONARY_WINDOWS, replace=False)
    return [pieces[i] for i in sorted(at)]


def _measured(docs: DataFrame, model: ToxicityModel, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``features array<double>`` of each row's whole ``text``."""
    rows = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic))  # bounded by the sizes above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(*shared.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                yield part.drop(columns="text").assign(features=[distance.features(t) for t in part["text"]])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInPandas(run, f"{fields}features array<double>")


def score(docs: DataFrame, model: ToxicityModel, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on), one row for each row.

    Null and empty texts have no window and get the score of a text without any difference."""
    measured = _measured(docs, model, keep)
    if model.weights is None:
        value = F.lit(float(model.constant))
    else:
        w = model.weights[:-1] / model.scale
        z = F.lit(float(model.weights[-1] - (w * model.mean).sum()))
        for k in range(FEATURES):
            z = z + F.col("features")[k] * F.lit(float(w[k]))
        value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    return measured.withColumn("score", value).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("features")


@query("op7_toxicity")
def op7(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
