"""Main text of web pages by scoring the element tree.

Each paragraph has points for its length and its commas; its parent gets them all, the ancestors above ever smaller shares.
A container's score is discounted by its link density. The best container is kept, with those siblings that score well
beside it; an article or main element around it, or the best one inside it, stands for it. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out by element, role and class. A class or id,
a form or a hidden block only counts against what it holds: paragraphs in it weigh a fifth, or a fiftieth where a name
starts with such a word, and if the best container still lies in it, the element stays."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.registry import query, table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_HINT = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_LEADING = re.compile(r"(?:^|\s)([a-z]+)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea select title xmp".split())
_DROP = frozenset("nav footer aside menu head svg canvas object audio video map".split())
_DOUBTED = frozenset("form button dialog".split())
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_UNSHOWN = re.compile(r"\bstyle\s*=\s*[\"'][^\"']*\b(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p pre td blockquote div section li dd article main body".split())
_WHOLE = frozenset("html body article main".split())
_ENDS_P = _BLOCK - {"html", "body"}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar".split()
)
#: Points: one for a paragraph, one for each comma, one for every so many characters up to a limit; how far they go up.
LENGTH_STEP, LENGTH_POINTS, LEVELS = 100, 3, 5
SIBLING_SHARE = 0.2
#: What a paragraph weighs in an element that may be left out, or most likely is.
DOUBT, STRONG_DOUBT = 0.2, 0.02
PAGES_AT_ONCE = 200


class _Tree:
    def __init__(self) -> None:
        self.name, self.parent, self.dropped, self.weight = ["#page"], [-1], [False], [1.0]
        self.own, self.commas = [0], [0]
        self.linked = [0]
        self.pieces: list[tuple[int, str]] = []

    def add(self, name: str, parent: int, dropped: bool, weight: float) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.dropped.append(dropped or self.dropped[parent])
        self.weight.append(weight)
        self.own.append(0)
        self.commas.append(0)
        self.linked.append(0)
        return len(self.name) - 1


def _unwanted(name: str, rest: str, inside_article: bool) -> tuple[bool, float]:
    """Is the element left out for sure, and what do paragraphs in it weigh?"""
    if name in _DROP or (name == "header" and not inside_article):
        return True, 1.0
    weight = DOUBT if name in _DOUBTED else 1.0
    if name in _WHOLE or not rest:
        return False, weight
    for kind, *values in _HINT.findall(rest) if "=" in rest else ():
        value = "".join(values).lower()
        if kind.lower() == "role":
            if value in _ROLES:
                return True, 1.0
            continue
        for found, worth in ((_WORD, DOUBT), (_LEADING, STRONG_DOUBT)):
            words = found.findall(value)
            if any(w in _NAMES for w in words) or ("header" in words and not inside_article):
                weight = min(weight, worth)
    if _UNSHOWN.search(rest) or ("hidden" in rest.lower() and _HIDDEN.search(_QUOTED.sub("", rest))):
        weight = STRONG_DOUBT
    return False, weight


def parse(html: str) -> _Tree:
    """The tree of a page, forgiving: what is not closed ends with its parent, what closes nothing is passed over."""
    tree = _Tree()
    stack, open_names, articles = [0], {}, 0
    at = link = 0

    def leave() -> None:
        nonlocal articles, link
        node = stack.pop()
        name = tree.name[node]
        open_names[name] -= 1
        articles -= name in ("article", "main")
        link -= name == "a"

    def say(text: str) -> None:
        if not text:
            return
        node = stack[-1]
        if tree.dropped[node]:
            return
        text = unescape(text)
        size = len(text.strip())
        tree.pieces.append((node, text))
        if size:
            tree.own[node] += size
            tree.commas[node] += text.count(",") + text.count("、") + text.count("，")
            if link:
                tree.linked[node] += size

    while True:
        m = _TAG.search(html, at)
        if not m:
            say(html[at:])
            return tree
        say(html[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if name in _BLOCK:
                tree.pieces.append((-1, " "))
            if open_names.get(name):
                while tree.name[stack[-1]] != name:
                    leave()
                leave()
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name == "br" or name in _BLOCK:
            tree.pieces.append((-1, " "))
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _ENDS_P and open_names.get("p"):
            while tree.name[stack[-1]] != "p":
                leave()
            leave()
        if name == "body" and open_names.get("head"):
            while tree.name[stack[-1]] != "head":
                leave()
            leave()
        if name == "li" and tree.name[stack[-1]] == "li":
            leave()
        stack.append(tree.add(name, stack[-1], *_unwanted(name, rest, articles > 0)))
        open_names[name] = open_names.get(name, 0) + 1
        articles += name in ("article", "main")
        link += name == "a"


def _scores(tree: _Tree) -> tuple[list[float], list[int], list[int]]:
    """``(score, text, linked text)`` of every element, of what is not dropped."""
    n = len(tree.name)
    # Text of inline elements belongs to the paragraph around them.
    size, linked, commas = ([0 if d else v for v, d in zip(values, tree.dropped, strict=True)] for values in (tree.own, tree.linked, tree.commas))
    text = size[:]
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        text[up] += text[i]
        linked[up] += linked[i]
        if tree.name[i] not in _BLOCK:
            size[up] += size[i]
            commas[up] += commas[i]
    points, weight = [0.0] * n, [1.0] * n
    for i in range(1, n):
        weight[i] = min(tree.weight[i], weight[tree.parent[i]])
        if tree.dropped[i] or not size[i] or tree.name[i] not in _PARAGRAPH:
            continue
        worth = (1 + commas[i] + min(size[i] / LENGTH_STEP, LENGTH_POINTS)) * weight[i]
        # A container with text of its own is a paragraph of itself.
        up, share = (tree.parent[i], 1.0) if tree.name[i] in ("p", "pre", "li", "dd", "td", "blockquote") else (i, 1.0)
        for level in range(1, LEVELS + 1):
            if up < 0:
                break
            points[up] += worth * share
            up, share = tree.parent[up], 0.5 if level == 1 else 1 / (3 * level)
    return [p * (1 - linked[i] / text[i]) if text[i] else 0.0 for i, p in enumerate(points)], text, linked


def _settle(tree: _Tree) -> None:
    """Drop every doubtful element that does not hold the best container; after that, none is doubtful."""
    n = len(tree.name)
    if min(tree.weight) == 1:
        return
    score, _, _ = _scores(tree)
    best = max(range(n), key=lambda i: (score[i], -i))
    holds = set()
    up = best if score[best] else -1
    while up > 0:
        holds.add(up)
        up = tree.parent[up]
    for i in range(1, n):
        tree.dropped[i] = tree.dropped[i] or tree.dropped[tree.parent[i]] or (tree.weight[i] < 1 and i not in holds)
    tree.weight = [1.0] * n


def _roots(tree: _Tree) -> set[int]:
    n = len(tree.name)
    _settle(tree)
    score, text, linked = _scores(tree)
    best = max(range(n), key=lambda i: (score[i], -i))
    if not score[best]:
        return {0}
    for wanted in ("article", "main"):
        up = best
        while up > 0:
            if tree.name[up] == wanted:
                least = SIBLING_SHARE * score[up]
                beside = (i for i in range(1, n) if tree.name[i] == "article" and tree.parent[i] == tree.parent[up] and score[i] > 0 and score[i] >= least)
                return {up, *beside} if wanted == "article" else {up}
            up = tree.parent[up]
    inside = [False] * n
    for i in range(best + 1, n):
        inside[i] = tree.parent[i] == best or inside[tree.parent[i]]
    marked = [i for i in range(n) if inside[i] and tree.name[i] in ("article", "main") and score[i] > 0]
    if marked:
        best = max(marked, key=lambda i: (score[i], -i))
    least = SIBLING_SHARE * score[best]
    if marked:
        return {i for i in marked if tree.parent[i] == tree.parent[best] and score[i] >= least}
    roots = {best}
    if tree.name[best] in ("body", "html") or best == 0:
        return roots
    for i in range(1, n):
        if i != best and tree.parent[i] == tree.parent[best] and not tree.dropped[i]:
            alone = tree.name[i] in ("p", "pre", "blockquote") or re.fullmatch("h[1-6]", tree.name[i])
            if score[i] >= least or (alone and text[i] and linked[i] / text[i] < 0.25):
                roots.add(i)
    return roots


def main_text(html: str | None) -> str:
    """Main text of a page; empty for a null or empty page, and all text that is not left out if nothing scores."""
    if not html:
        return ""
    tree = parse(html)
    roots = _roots(tree)
    keep = [False] * len(tree.name)
    for i in range(len(keep)):
        keep[i] = not tree.dropped[i] and (i in roots or (i > 0 and keep[tree.parent[i]]))
    return " ".join("".join(t for node, t in tree.pieces if node < 0 or keep[node]).split())


def extract(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """``keep`` columns of ``pages`` plus ``text`` and ``n_chars``, one row for each row. Kept columns of those names are
    replaced. Repeated rows give repeated results."""
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                texts = [main_text(h) for h in part.column(len(keep)).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), sizes], names=[*keep, "text", "n_chars"])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{fields}text string, n_chars long")


@query("op9_html_extraction")
def op9(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
