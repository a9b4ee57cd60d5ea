"""Gradient-boosted trees on a few features: logistic loss, splits on quantile bins.

``fit`` learns from an array, ``fit_folds`` from a table of any length: rows in equal bins are folded into one with a count,
and each level of a tree is one pass that only sends sums by node, feature and bin to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators.ranks import group_quantiles
from lineweave.session import cut

#: Gradients are whole multiples of this, so that their sums do not depend on the order of rows.
GRAIN = 2.0**-24
#: Folded rows that one task of a pass reads, about.
TASK_ROWS = 20_000


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.start, self.edges, self.grown = 0.0, [], []

    def _begin(self, share: float) -> None:
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self._begin(y.mean())
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        raw = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.grown.append(tree)
            raw += self._walk(tree, binned)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._predict(self._binned(x))

    def _predict(self, binned: np.ndarray) -> np.ndarray:
        raw = self.start + sum((self._walk(t, binned) for t in self.grown), np.zeros(len(binned)))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree: feature and bin of each inner node (feature -1: all rows go left), value of each leaf."""
        inner = (1 << self.depth) - 1
        tree = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner + 1)
        for level in range(self.depth):
            self._split(tree, level, *self._sums(binned, self._node(tree, binned, level), level, g, h))
        return tree

    def _node(self, tree: tuple, binned: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after so many levels."""
        feature, cut, _ = tree
        node = np.zeros(len(binned), np.int64)
        for _ in range(levels):
            own = feature[node]
            node = 2 * node + 1 + ((own >= 0) & (binned[np.arange(len(binned)), np.maximum(own, 0)] > cut[node]))
        return node

    def _sums(self, binned: np.ndarray, node: np.ndarray, level: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of ``g`` and of ``h`` by feature, node of the level and bin."""
        width, first = 1 << level, (1 << level) - 1
        sums = np.zeros((2, binned.shape[1], width, self.bins))
        for f in range(binned.shape[1]):
            at = (node - first) * self.bins + binned[:, f]
            for v, out in zip((g, h), sums, strict=True):
                out[f] = np.bincount(at, v, width * self.bins).reshape(width, -1)
        return sums

    def _split(self, tree: tuple, level: int, g: np.ndarray, h: np.ndarray) -> None:
        """Best feature and bin of each node of the level; after the last level the values of the leaves."""
        feature, cut, value = tree
        width, first = 1 << level, (1 << level) - 1
        best = np.full(width, 1e-6)
        g, h = g.cumsum(axis=2), h.cumsum(axis=2)
        for f, (gs, hs) in enumerate(zip(g, h, strict=True)):
            gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
            gain = gs**2 / (hs + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
            gain[(hs < self.least * 0.1) | (hr < self.least * 0.1)] = 0
            pick = gain.argmax(axis=1)
            got = gain[np.arange(width), pick]
            better = np.flatnonzero(got > best)
            best[better], feature[first + better], cut[first + better] = got[better], f, pick[better]
        if level < self.depth - 1:
            return
        nodes = np.arange(width)
        own, at = feature[first:], np.where(feature[first:] >= 0, cut[first:], self.bins - 1)
        left = [s[np.maximum(own, 0), nodes, at] for s in (g, h)]
        whole = [s[0, :, -1] for s in (g, h)]
        value[0::2] = left[0] / (left[1] + 1) * self.rate
        value[1::2] = (whole[0] - left[0]) / (whole[1] - left[1] + 1) * self.rate

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        return tree[2][self._node(tree, binned, self.depth) - len(tree[0])]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def fit_folds(rows: DataFrame, folds: int, by: Sequence[str] = (), **settings) -> tuple[BoostedTrees, DataFrame]:
    """Trees from all of ``rows(fold, y, x array<float>, by)``, and ``(by, p, n, positive)``: the rows by a probability of trees that did not see their fold.

    One model for each fold and one for all rows grow side by side. ``folds`` counts from 0; the bins are those of all rows."""
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    models = [BoostedTrees(**settings) for _ in range(folds + 1)]
    one = models[0]
    cells = rows.select(F.posexplode("x").alias("f", "v")).withColumn("v", F.col("v").cast("double"))
    cuts = group_quantiles(cells, ["f"], "v", np.linspace(0, 1, one.bins + 1)[1:-1].tolist()).collect()
    edges = [np.unique(r["q"]) for r in sorted(cuts, key=lambda r: r["f"])]
    for m in models:
        m.edges = edges

    def bin_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                binned = one._binned(np.stack(pdf["x"].to_numpy()).astype(float)).astype(np.uint8)
                yield pdf.drop(columns="x").assign(b=[r.tobytes() for r in binned])

    binned = rows.select(*by, "fold", "y", "x").mapInPandas(bin_up, f"{kinds}fold int, y int, b binary")
    binned = cut(binned.groupBy(*by, "fold", "y", "b").agg(F.count(F.lit(1)).alias("n")))
    counts = binned.groupBy("fold", "y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).toPandas()
    binned = binned.coalesce(1 + int(counts["rows"].sum()) // TASK_ROWS)      # sums are sent once for each task of a pass
    for i, m in enumerate(models):
        seen = counts[counts["fold"] != i] if (counts["fold"] != i).any() else counts
        m._begin(float((seen["y"] * seen["n"]).sum() / seen["n"].sum()))

    shape = (2, len(edges))
    for _ in range(one.trees):
        trees = [(np.full((1 << m.depth) - 1, -1), np.zeros((1 << m.depth) - 1, np.int64), np.zeros(1 << m.depth)) for m in models]
        for level in range(one.depth):
            size = 2 * len(edges) * (1 << level) * one.bins

            def add_up(batches: Iterator[pd.DataFrame], trees=trees, level=level, size=size) -> Iterator[pd.DataFrame]:
                total = np.zeros((len(models), size))
                for pdf in batches:
                    if not len(pdf):
                        continue
                    b, y, n, fold = _matrix(pdf["b"]), *(pdf[c].to_numpy() for c in ("y", "n", "fold"))
                    for i, m in enumerate(models):
                        own = fold != i
                        p = m._predict(b[own])
                        g, h = (np.rint(v / GRAIN) * n[own] for v in (y[own] - p, np.maximum(p * (1 - p), 1e-6)))
                        total[i] += m._sums(b[own], m._node(trees[i], b[own], level), level, g, h).ravel()
                at = np.flatnonzero(total)
                yield pd.DataFrame({"at": at, "v": total.ravel()[at].astype(np.int64)})

            sums = binned.mapInPandas(add_up, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
            total = np.zeros(len(models) * size)
            total[sums["at"].to_numpy()] = sums["v"].to_numpy() * GRAIN
            for m, tree, part in zip(models, trees, total.reshape(len(models), *shape, 1 << level, one.bins), strict=True):
                m._split(tree, level, *part)
        for m, tree in zip(models, trees, strict=True):
            m.grown.append(tree)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b, fold, p = _matrix(pdf["b"]), pdf["fold"].to_numpy(), np.zeros(len(pdf))
                for i in np.unique(fold):
                    p[fold == i] = models[i]._predict(b[fold == i])
                yield pdf[[*by, "y", "n"]].assign(p=p)

    judged = binned.mapInPandas(judge, f"{kinds}y int, n long, p double")
    return models[-1], judged.groupBy(*by, "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("positive"))
