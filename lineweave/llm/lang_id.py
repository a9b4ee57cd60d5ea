"""Language ID: unigram models over the pieces of a public vocabulary, with all segmentations of a word summed.

A word's probability in a language is the sum over all ways to cut it into pieces of the product of the pieces'
probabilities, found by a forward pass over its bytes. The pieces' probabilities come from the same lattice by
expectation maximisation. A text is the product of its words; equal words of a batch are scored once."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.llm.words import rows_at_once, slices, word_hashes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The bound of the training sample: documents of a language, and distinct words of a language.
TRAIN_DOCS = 400
TRAIN_WORDS = 50_000
PIECE_BYTES = 10
WORD_BYTES = 24
ROUNDS = 3
SMOOTHING = 0.05
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of at most PIECE_BYTES bytes; all single bytes are among them."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p.lower() for p in pieces if len(p) <= PIECE_BYTES} | {bytes([b]) for b in range(256)})


class Lattice:
    """All pieces found in a list of words: for each length, the places where one starts and which one it is."""

    def __init__(self, words: Sequence[bytes], hashes: Sequence[tuple[np.ndarray, np.ndarray]]):
        sizes = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        first = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + _U(1)
        room = np.repeat(first + sizes, sizes) - np.arange(len(buf))
        self.first = first[self.order]
        self.count = len(buf)
        self.piece = []
        h = np.zeros(len(buf), np.uint64)
        for n in range(1, PIECE_BYTES + 1):
            ok = room >= n
            h[: len(buf) - n + 1] = h[: len(buf) - n + 1] * _BASE + buf[n - 1 :]
            known, ids = hashes[n - 1]
            found = np.full(len(buf), -1, np.int32)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = ok & (known[at] == h)
                found[hit] = ids[at[hit]]
            self.piece.append(found)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, bytes, language], words longest first; ``p`` has a last row of zeros for no piece."""
        longest = int(self.sizes[0]) if len(self.sizes) else 0
        alpha = np.zeros((len(self.sizes), longest + 1, p.shape[1]))
        alpha[:, 0] = 1
        for t in range(1, longest + 1):
            live = int(np.searchsorted(-self.sizes, -t, "right"))
            for n in range(1, min(t, PIECE_BYTES) + 1):
                got = self.piece[n - 1][self.first[:live] + t - n]
                hit = np.flatnonzero(got >= 0)
                alpha[hit, t] += alpha[hit, t - n] * p[got[hit]]
        return alpha

    def ends(self, alpha: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.sizes), alpha.shape[2]))
        out[self.order] = alpha[np.arange(len(self.sizes)), self.sizes]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations, for one language."""
        alpha = self.forward(p)
        n_words, longest = alpha.shape[0], alpha.shape[1] - 1
        beta = np.zeros((n_words, longest + 1, 1))
        beta[np.arange(n_words), self.sizes] = 1
        counts = np.zeros(len(p))
        w = weight[self.order] / np.maximum(alpha[np.arange(n_words), self.sizes, 0], 1e-300)
        for t in range(longest, 0, -1):
            live = int(np.searchsorted(-self.sizes, -t, "right"))
            for n in range(1, min(t, PIECE_BYTES) + 1):
                got = self.piece[n - 1][self.first[:live] + t - n]
                hit = np.flatnonzero(got >= 0)
                term = p[got[hit]] * beta[hit, t]
                beta[hit, t - n] += term
                counts += np.bincount(got[hit], alpha[hit, t - n, 0] * term[:, 0] * w[hit], len(p))
        return counts


def _piece_hashes(pieces: Sequence[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n in range(1, PIECE_BYTES + 1):
        own = [(i, p) for i, p in enumerate(pieces) if len(p) == n]
        raw = np.frombuffer(b"".join(p for _, p in own), np.uint8).reshape(-1, n).astype(np.uint64) + _U(1)
        h = np.zeros(len(own), np.uint64)
        for k in range(n):
            h = h * _BASE + raw[:, k]
        order = np.argsort(h)
        out.append((h[order], np.array([i for i, _ in own], np.int32)[order]))
    return out


def _word_runs(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(distinct words, word of each run, text of each run)``. A word is a run of letters (ASCII, or any byte from 128
    on) in lower case; a longer run than WORD_BYTES counts as several words."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    letter = _LETTER[buf]
    edge = np.diff(np.concatenate([[False], letter]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts = -(-(ends - starts) // WORD_BYTES)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + nth * WORD_BYTES, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + WORD_BYTES)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    owner = np.searchsorted(first, starts, "right") - 1
    _, one, inverse = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    return [b" " + raw[s:e] for s, e in zip(starts[one], ends[one], strict=True)], inverse, owner


class LanguageModel:
    """Languages, their log priors, and each piece's probability in each of them."""

    def __init__(self, languages: list[str], prior: np.ndarray, pieces: list[bytes], p: np.ndarray):
        self.languages, self.prior, self.pieces, self.p = languages, prior, pieces, p

    def scores(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(language, posterior)`` of each text; -1 where a text has no word."""
        if not hasattr(self, "_hashes"):
            self._hashes = _piece_hashes(self.pieces)
        best, sure = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.languages:
            return best, sure
        for lo, hi in slices(texts, SLICE_BYTES):
            words, inverse, owner = _word_runs(texts[lo:hi])
            if not words:
                continue
            lattice = Lattice(words, self._hashes)
            logs = np.log(np.maximum(lattice.ends(lattice.forward(self.p)), 1e-300))
            total = np.stack([np.bincount(owner, logs[inverse, k], hi - lo) for k in range(len(self.languages))], axis=1) + self.prior
            top = total.argmax(axis=1)
            has = np.bincount(owner, minlength=hi - lo) > 0
            best[lo:hi] = np.where(has, top, -1)
            sure[lo:hi] = np.where(has, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0)
        return best, sure

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_hashes"}


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, path: str | None = None) -> LanguageModel:
    """Fit on ``docs(doc_id, text, lang)``: rows with a language and a text that are not held out.

    The sample is bounded by TRAIN_DOCS whole documents of each language, those with the least hash, and by their
    TRAIN_WORDS most frequent words. What reaches the driver is one row per language and word of that sample."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    narrow = known.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.xxhash64("text").alias("t"))
    line = W.partitionBy("l").orderBy(F.xxhash64("i", "t"), "i", "t")
    picks = narrow.withColumn("n", F.row_number().over(line)).where(F.col("n") <= TRAIN_DOCS)
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("t"))
    sample = known.join(F.broadcast(picks), same, "left_semi").select("lang", "text")  # TRAIN_DOCS rows a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_once(batches):
            langs, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs)):
                words, inverse, _ = _word_runs([t for t, x in zip(texts, langs, strict=True) if x == lang])
                n = np.bincount(inverse, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = words.withColumn("r", F.row_number().over(top)).where(F.col("r") <= TRAIN_WORDS).select("lang", "word", "n").collect()
    sizes = {r["l"]: r["count"] for r in narrow.groupBy("l").count().collect()}
    return fit(rows, sizes, read_vocabulary(path or vocabulary_path()))


def fit(rows: Sequence[tuple[str, bytes, int]], sizes: dict[str, int], vocabulary: list[bytes]) -> LanguageModel:
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros(0), [], np.zeros((1, 0)))
    hashes = _piece_hashes(vocabulary)
    counts = np.zeros((len(vocabulary), len(languages)))
    for k, lang in enumerate(languages):
        own = sorted((bytes(r[1]), r[2]) for r in rows if r[0] == lang)
        lattice, weight = Lattice([w for w, _ in own], hashes), np.array([n for _, n in own], float)
        p = np.full((len(vocabulary) + 1, 1), 1 / len(vocabulary))
        for _ in range(ROUNDS):
            p[-1] = 0
            c = lattice.expected(p, weight)[:-1]
            p[:-1, 0] = (c + SMOOTHING / len(vocabulary)) / (c.sum() + SMOOTHING)
        counts[:, k] = c
    keep = np.flatnonzero((counts.sum(axis=1) > 0.01) | np.array([len(v) == 1 for v in vocabulary]))
    c = counts[keep]
    p = np.zeros((len(keep) + 1, len(languages)))
    p[:-1] = (c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * len(keep))
    prior = np.log(np.array([sizes.get(x, 0) + 1.0 for x in languages]))
    return LanguageModel(languages, prior - np.logaddexp.reduce(prior), [vocabulary[i] for i in keep], p)


def identify(docs: DataFrame, model: LanguageModel, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``lang_pred`` and ``score``, one row for each row.

    A null, empty or letterless text is ``und`` with score 0, and so is every text if nothing was learned. ``score`` is
    the posterior of the predicted language. Kept columns named like the new ones are replaced."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    sent = keep if "text" in keep else [*keep, "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in sent], letter.alias("__letter"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary pieces x languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows_at_once(batches):
            texts, letters = batch.column(sent.index("text")).to_pylist(), batch.column(len(sent)).to_pylist()
            best, sure = m.scores([t.encode() if has else b"" for t, has in zip(texts, letters, strict=True)])
            ok = best >= 0
            langs = pa.array([m.languages[b] if o else "und" for o, b in zip(ok, best, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], langs, pa.array(np.where(ok, sure, 0.0), pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


@query("op10_language_id")
def op10(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.withColumn("held_out", held_out()), train(docs), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
