"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the count of pieces of each length goes into the plan, and
there are at most ``capacity`` lengths, so the plan is small whatever the corpus. The plan gives each length a list of
slots by rank; a piece finds its slot by its rank among the pieces of its length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table
from lineweave.operators.ranks import running_total
from lineweave.session import cut

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Bounds of what a worker holds: chunks with their ids, length of those kept longest, chunks encoded in one call, documents handled at once.
KNOWN_CHUNKS = 650_000
SHORT_CHUNK = 6
CALL_CHUNKS = 10_000
DOCS_AT_ONCE = 200

# White space that str.split() and the tokenizer see differently.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# Texts in which every word may be put into lower case and cut off from a single stop or comma, as the vocabulary does.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ., \n]*")
_TWO_STOPS = ("..", ".,", ",.", ",,")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary never joins text over white space, so the ids of a text are those of its chunks. Chunks met before are
    looked up, all new chunks of a batch are encoded together: plain words, each of which is one word of the vocabulary's
    own splitting, without its normalizer, and all others with it. At most KNOWN_CHUNKS are held; then only short ones stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _split(self, text: str, plain: list[str], other: list[str]) -> list[str] | None:
        """The chunks of a text in order, also added to ``plain`` or ``other``; None if it must be encoded as a whole."""
        if _PLAIN.fullmatch(text) and not any(two in text for two in _TWO_STOPS):
            words = text.lower().replace(".", " . ").replace(",", " , ").split()
            plain += words
            return words
        if _ODD_SPACE.search(text):
            return None
        if "\n" not in text:
            words = text.split()
            other += words
            return words
        return [w for line in text.split("\n") for w in self._split(line, plain, other)]

    def _learn(self, chunks: list[str], plain: bool) -> None:
        for lo in range(0, len(chunks), CALL_CHUNKS):
            some = chunks[lo : lo + CALL_CHUNKS]
            if plain:  # no offsets needed: the tokens that end words part them
                got = self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            else:
                got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            if plain:
                cuts = np.concatenate([[0], np.flatnonzero(self.word_end[ids]) + 1])
            else:
                cuts = np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), np.cumsum([0] + [len(c) + 1 for c in some]))
            cuts, raw = (cuts * 4).tolist(), ids.tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        plain: list[str] = []
        other: list[str] = []
        parts = [self._split(t, plain, other) for t in texts]
        if len(self.known) > KNOWN_CHUNKS:
            self.known = {c: ids for c, ids in self.known.items() if len(c) <= SHORT_CHUNK}
        self._learn(list(set(plain).difference(self.known)), True)
        self._learn(list(set(other).difference(self.known)), False)
        look = self.known.__getitem__
        for text, part in zip(texts, parts, strict=True):
            if part is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(look, part))


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that what it knows serves the next task too."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, keys: Sequence[str], path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(keys..., piece, start, length, ids_crc32)``: each text as token ids and END_ID, cut every ``capacity`` ids.

    A null text counts as empty and gives one piece that holds END_ID alone."""
    rows = docs.select(*keys, "text")
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    end = np.array([END_ID], "<u4").tobytes()
    names = [*keys, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(lo, DOCS_AT_ONCE)
                owner, out = [], []
                for i, ids in enumerate(encoder.encode([t or "" for t in part.column(len(keys)).to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        owner.append(i)
                        out.append((k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                index = pa.array(owner, pa.int32())
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(j).take(index) for j in range(len(keys))]
                    + [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    names=names,
                )

    return rows.mapInArrow(run, f"{fields}, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts -> steps ``(length, first, upto, each, sequence, offset)``.

    The pieces of ``length`` with ranks first <= rank < upto go ``each`` to a sequence, from ``sequence`` on, the first of
    them at ``offset``. Sequences with the same free space are ranges of numbers, so a step fills or splits a range and
    the work grows with the number of lengths, not of pieces."""
    free: dict[int, list[tuple[int, int]]] = {}
    steps, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                start, count, room = opened, -(-(total - rank) // (capacity // length)), capacity
                opened += count
            else:
                start, count = free[room].pop()
                if not free[room]:
                    del free[room]
            each = room // length
            full = min(count, (total - rank) // each)
            if full:
                steps.append((length, rank, rank + full * each, each, start, capacity - room))
                rank += full * each
                if room - each * length:
                    free.setdefault(room - each * length, []).append((start, full))
            start, count = start + full, count - full
            if count and rank < total:
                some = total - rank
                steps.append((length, rank, total, some, start, capacity - room))
                rank = total
                if room - some * length:
                    free.setdefault(room - some * length, []).append((start, 1))
                start, count = start + 1, count - 1
            if count:
                free.setdefault(room, []).append((start, count))
    return steps


def pack(cut_pieces: DataFrame, order: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces; ``order`` must tell all pieces apart."""
    spark = cut_pieces.sparkSession
    counts = {r[0]: r[1] for r in cut_pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    steps = plan_best_fit(counts, capacity)
    plan = spark.createDataFrame(steps, "length long, first long, upto long, each long, base long, at long")
    by_length = plan.groupBy("length").agg(F.collect_list(F.struct("first", "upto", "each", "base", "at")).alias("steps"))
    # One row for each length, and few steps in each: bounded by the capacity.
    ranked = running_total(cut_pieces.withColumn("_one", F.lit(1).cast("long")), "_one", order, ["length"]).withColumnRenamed("before", "rank")
    placed = ranked.drop("_one", "upto").join(F.broadcast(by_length), "length")
    step = F.filter("steps", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["upto"]))[0]
    nth = F.col("rank") - F.col("step.first")
    return (
        placed.withColumn("step", step)
        .withColumn("sequence_id", F.col("step.base") + F.floor(nth / F.col("step.each")).cast("long"))
        .withColumn("offset", F.col("step.at") + F.pmod(nth, F.col("step.each")) * F.col("length"))
        .drop("steps", "step", "rank")
    )


def in_order(packed: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same sequences, numbered by the ``order`` of their first and longest pieces; it must tell all pieces apart.

    The least place of all pieces would not do: sequences of many short pieces would come before all others."""
    firsts = packed.where("offset = 0").select("sequence_id", *order, F.lit(1).cast("long").alias("_one"))
    numbers = running_total(firsts, "_one", order).select("sequence_id", F.col("before").alias("_number"))
    return packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("_number")).drop("_number")


def pack_documents(
    docs: DataFrame, order: Sequence[str] = ("doc_id",), path: str | None = None, capacity: int = CAPACITY, keep_order: bool = False
) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Every row is a document of its own; repeated rows are packed as often as they come. ``order`` names the columns whose
    order breaks ties between pieces of one length; with ``keep_order`` the sequences are numbered in that order too, by their
    longest pieces, not by decreasing length. An empty table gives an empty result."""
    keys = list(dict.fromkeys(["doc_id", *order]))
    path = path or vocabulary_path()
    flat = docs.select(*keys, "text")
    done = cut(pieces(flat, keys, path, capacity).withColumn("_n", F.monotonically_increasing_id()))
    whole = [*order, "piece", "_n"]
    out = pack(done, whole, capacity)
    if keep_order:
        out = in_order(out, whole)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    """Every document's pieces of at most 2048 tokens, and their places."""
    return pack_documents(table(spark, sf_dir, "documents"))
