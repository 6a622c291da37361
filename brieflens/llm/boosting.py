"""Small gradient-boosted trees: fitted with numpy on a bounded table, applied as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Goes left where feature <= cut."""

    feature: int
    cut: float
    left: Split | float
    right: Split | float


@dataclass(frozen=True)
class Boosted:
    names: list[str]
    base: float
    trees: list[Split | float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += walk(tree, x)
        return out

    def expression(self, feature: dict[str, Column]) -> Column:
        """The margin over columns named as the features."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + as_column(tree, [feature[n] for n in self.names])
        return total


def walk(node: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, Split):
        return np.full(len(x), node)
    return np.where(x[:, node.feature] <= node.cut, walk(node.left, x), walk(node.right, x))


def as_column(node: Split | float, columns: list[Column]) -> Column:
    if not isinstance(node, Split):
        return F.lit(float(node))
    return F.when(columns[node.feature] <= F.lit(node.cut), as_column(node.left, columns)).otherwise(as_column(node.right, columns))


def grown(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float, least: float = 0.75) -> Split | float:
    """One regression tree on first and second derivatives; ties go to the first feature and the lowest cut."""
    leaf = float(-rate * slope.sum() / (curve.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return leaf
    best, gain = None, 1e-6
    g_all, h_all = slope.sum(), curve.sum()
    for f in range(x.shape[1]):
        values, code = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        gl, hl = np.cumsum(np.bincount(code, slope))[:-1], np.cumsum(np.bincount(code, curve))[:-1]
        gr, hr = g_all - gl, h_all - hl
        better = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g_all * g_all / (h_all + 1)
        better[(hl < least) | (hr < least)] = -1
        k = int(np.argmax(better))
        if better[k] > gain + 1e-9:
            best, gain = (f, float((values[k] + values[k + 1]) / 2)), float(better[k])
    if best is None:
        return leaf
    f, cut = best
    low = x[:, f] <= cut
    return Split(f, cut, grown(x[low], slope[low], curve[low], depth - 1, rate), grown(x[~low], slope[~low], curve[~low], depth - 1, rate))


def fitted(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Logistic loss."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grown(x, p - y, p * (1 - p), depth, rate)
        margin += walk(tree, x)
        made.append(tree)
    return Boosted(names, base, made)


def safe_threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut above which at least `precision` of the held-out rows are positive; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    m, right = margin[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(m[1:] < m[:-1], True)  # cuts only between different margins
    good = np.flatnonzero((right >= precision) & last)
    if not len(good):
        return float("inf")
    k = good[-1]
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k] - 1e-6)
