"""Personal data: generous generators propose spans, boosted trees select among them.

The base patterns of each kind always count. Beside them, looser patterns propose spans that may overlap: addresses with
"at" and "dot" spelt out, numbers without a plus sign, with other separators or in other groups. Trees see the form of a
span and the text around it. They learn from what a span is in its normal form ("[at]" read as "@", separators taken out),
from checksums, lengths and words before it, whether a base pattern finds it or not; a proposal these leave open teaches
nothing. By trees that did not see a proposal, each kind gets the threshold from which its precision is high enough; what
passes it and touches no base span is added, the surest first. All proposals teach, in passes over their table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.boosting import BoostedTrees, fit_folds
from lineweave.llm.registry import query, table
from lineweave.operators.ranks import running_total
from lineweave.session import cut, is_empty

KINDS = ("email", "ip", "card", "phone")
FOLDS = 4
#: A threshold needs this precision, on at least so many proposals that pass it.
PRECISION, LEAST_PASSING = 0.97, 30
CONTEXT = 24
DOCS_AT_ONCE = 500
#: A piece of proposals is passed on from this size.
PROPOSALS_AT_ONCE = 2_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Whatever a pattern of _LOOSE can match holds one of these.
_HINT = re.compile(r"[0-9@]|[(\[{]at[)\]}]|\bdot\b", re.I)
_AT = re.compile(r" ?[(\[{]at[)\]}] ?| at ", re.I)
_DOT = re.compile(r" ?[(\[{]dot[)\]}] ?| dot ", re.I)
#: Endings that make an address of words alone.
_TAILS = frozenset("com org net edu gov io info eu de fr es it uk ch at us".split())
_MORE_BEFORE, _MORE_AFTER = re.compile(r"[0-9][ ()./-]{0,2}$"), re.compile(r"[ ()./-]{0,2}[0-9]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}")

_LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
        r"(?:(?:@| ?[(\[{]at[)\]}] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,63})+| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+)",
        re.I,
    ),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+ ?)?\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}
_CUES = tuple(
    re.compile(p, re.I)
    for p in (r"\b(?:e-?mail|mail|write|contact)", r"\b(?:tel|phone|call|fax|mobile|cell)", r"\b(?:card|visa|master|account|iban|pay)", r"\b(?:ip|host|server|address)\b", r"\b(?:version|license|licence|no|page|isbn|id|key|password|token)\b")
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, for each kind, less those that fail its test; by start, then kind."""
    found = []
    at = low = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        # Later matches can't begin before this sign: it is no part of a name.
        at += 1
        if m:
            found.append(("email", start, m.end()))
            at = low = m.end()
        else:
            low = at
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans of the looser patterns; they may overlap."""
    return [(kind, m.start(), m.end()) for kind, pattern in _LOOSE.items() for m in pattern.finditer(text)]


def normal(kind: str, span: str) -> str:
    """The span as a base pattern would have it."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", span, count=1))
    if kind == "ip":
        return span.replace(" ", "").replace(",", ".")
    return "+" * (kind == "phone") + _digits(span)


def valid(kind: str, span: str) -> bool:
    s = normal(kind, span)
    return (kind, 0, len(s)) in base_spans(s)


def label(text: str, kind: str, start: int, end: int) -> int | None:
    """1: surely personal data of its kind, 0: surely not, None: open."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    if not valid(kind, span):
        return 0
    named, other = bool(_CUES[("email", "phone", "card", "ip").index(kind)].search(before)), bool(_CUES[4].search(before))
    if kind == "email":
        tail = re.search(r"\.([A-Za-z]{2,24})$", normal(kind, span))
        if not tail:
            return 0
        if "@" in span or re.search(r"[(\[{]at[)\]}]", span, re.I) or tail.group(1).lower() in _TAILS:
            return 1
        return None if named else 0  # words of a sentence
    if kind == "ip":
        if "," not in span and " " not in span:
            return 0 if other and not named else 1
        return 1 if named else 0 if ", " in span else None
    groups = re.findall(r"[0-9]+", span)
    if kind == "card":
        if named or len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]):
            return 1 if named or span[0] in "3456" else None
        return None
    if span[0] == "+":
        return 1
    if _MORE_BEFORE.search(before) or _MORE_AFTER.match(after) or _DATE.match(span):
        return 0
    if named or (span[0] == "(" and len(groups) > 1):
        return 1
    return 0 if other or len(groups) == 1 else None


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form and surroundings of a span as numbers."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    around = before + after
    tail = re.search(r"[A-Za-z]+$", span)
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(len(digits)),
        float(sum(c.isalpha() for c in span)),
        float(span.count(" ")),
        float(span.count(".")),
        float(span.count("-")),
        float(span.count("(") + span.count("[")),
        float("@" in span),
        float(span.startswith("+")),
        float(luhn(digits) if digits else 0),
        float(len(groups)),
        float(max((len(g) for g in groups), default=0)),
        float(max((int(g[-6:]) for g in groups), default=0) <= 255),
        float(len(tail.group()) if tail else 0),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(sum("0" <= c <= "9" for c in around)),
        float(sum(c.isupper() for c in around)),
        float(bool(_MORE_BEFORE.search(before))),
        float(bool(_MORE_AFTER.match(after))),
        float(valid(kind, span)),
        float(tail is not None and tail.group().lower() in _TAILS),
        float(any(c in span for c in "@[({")),
        *(float(bool(c.search(before))) for c in _CUES),
    ]


class PiiModel:
    """Trees and a threshold for each kind; without trees nothing is added."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        open_kinds = {k for k, t in self.thresholds.items() if t <= 1}
        if self.trees is None or not open_kinds:
            return base
        loose = [s for s in proposals(text) if s[0] in open_kinds and not any(s[1] < e and b < s[2] for _, b, e in base)]
        if not loose:
            return base
        p = self.trees.predict(np.array([features(text, *s) for s in loose]))
        taken = list(base)
        for i in np.argsort(-p, kind="stable"):
            kind, start, end = loose[i]
            if p[i] >= self.thresholds[kind] and not any(start < e and b < end for _, b, e in taken):
                taken.append(loose[i])
        return sorted(taken, key=lambda s: (s[1], KINDS.index(s[0])))


def _proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["h", "kind", "y", "x"]
    rows, seen = [], set()      # of one piece at a time: what repeats inside a piece is not made again
    for pdf in batches:
        for text in pdf["text"]:
            if len(rows) >= PROPOSALS_AT_ONCE:
                yield pd.DataFrame(rows, columns=columns)
                rows, seen = [], set()
            if not text or not _HINT.search(text):
                continue
            for kind, start, end in proposals(text):
                y = label(text, kind, start, end)
                if y is not None:
                    key = hashlib.md5(f"{kind}{text[max(0, start - CONTEXT) : end + CONTEXT]}".encode()).digest()
                    h = int.from_bytes(key[:8], "little", signed=True)
                    if h not in seen:
                        seen.add(h)
                        rows.append((h, kind, y, np.array(features(text, kind, start, end), np.float32)))
    yield pd.DataFrame(rows, columns=columns)


def train(docs: DataFrame) -> PiiModel:
    """Fit on the labelled proposals of all documents; equal ones in equal surroundings count once.

    All of them teach the trees and count for the precision. A kind with few proposals takes the threshold of all kinds
    together, one without any is off."""
    rows = cut(docs.select("text").mapInPandas(_proposed, "h long, kind string, y int, x array<float>").dropDuplicates(["h"]))
    if is_empty(rows):
        return PiiModel()
    trees, judged = fit_folds(rows.withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")), FOLDS, ["kind"])
    return PiiModel(trees, _thresholds(cut(judged)))


def _thresholds(judged: DataFrame) -> dict[str, float]:
    """For each kind the least probability of 0.5 or more from which on the share of positives is PRECISION; above 1 if there is none."""
    every = judged.withColumn("kind", F.explode(F.array("kind", F.lit("")))).groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    ranked = running_total(every.withColumn("_down", -F.col("p")), "n", ["_down"], ["kind"]).withColumnRenamed("upto", "passing").drop("before")
    ranked = running_total(ranked, "positive", ["_down"], ["kind"])
    ok = (F.col("p") >= 0.5) & (F.col("upto") / F.col("passing") >= PRECISION) & (F.col("passing") >= LEAST_PASSING)
    found = {r["kind"]: r for r in ranked.groupBy("kind").agg(F.min(F.when(ok, F.col("p"))).alias("p"), F.sum("n").alias("n")).collect()}

    def threshold(kind: str) -> float:
        return 2.0 if found[kind]["p"] is None else found[kind]["p"]

    return {k: 2.0 if k not in found else threshold("") if found[k]["n"] < LEAST_PASSING else threshold(k) for k in KINDS}


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redactions(docs: DataFrame, model: PiiModel, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``base`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive.

    One row for each row; null and empty texts have none. A kept column named like a new one is replaced."""
    keep = [c for c in keep if c not in ("base", "spans")]
    sent = keep if "text" in keep else [*keep, "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in sent])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen small trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), DOCS_AT_ONCE):
                part = pdf.iloc[lo : lo + DOCS_AT_ONCE]
                base, spans = [], []
                for text in part["text"]:
                    hit = bool(text) and _HINT.search(text)
                    own = base_spans(text) if hit else []
                    base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in (shared.value.spans(text, own) if hit else own)])
                yield part[list(keep)].assign(base=base, spans=spans)

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return rows.mapInPandas(run, f"{fields}base {span}, spans {span}")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_pii")
def op4(spark, sf_dir):
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = redactions(docs, train(docs), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
