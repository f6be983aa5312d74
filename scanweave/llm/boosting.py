"""Histogram gradient-boosted trees for two classes, grown on a bounded sample (`fit`) or on all rows of a table (`grow`).

Trees are complete binary trees of a fixed depth, grown level by level from
histograms of gradients; they are kept flattened in arrays, node i's children at
2i+1 and 2i+2, so that scoring walks all rows down all levels at once. A tree
can also be written as a Column for scoring inside a DataFrame plan.

`fit` cuts features into at most 64 bins by quantiles. `grow` is for whole
numbers from 0, rounded down by `steps`, and lets Spark sum the histograms: one
aggregation a level over all rows, of which the driver sees a row for each node,
feature and value, however many rows there are. Gradients are summed as whole
numbers and leaves are multiples of 1 / UNIT, so the trees don't depend on how
rows are partitioned, and a margin takes a bounded number of values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

#: Parts of a unit of margin, of a gradient, and the largest step of a leaf before its rate.
UNIT, FINE, STEP = 256, 1 << 20, 4.0
#: Above any value of a feature.
NEVER = (1 << 31) - 1


@dataclass
class Forest:
    """feature, threshold: (trees, inner nodes); leaf: (trees, leaves). A row goes left if its value is <= the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def margin_column(self, features: list[Column]) -> Column:
        """The margin as an expression, for plans without Python."""
        inner = self.feature.shape[1]

        def node(t: int, i: int) -> Column:
            if i >= inner:
                return F.lit(float(self.leaf[t, i - inner]))
            if not np.isfinite(self.threshold[t, i]):
                return node(t, 2 * i + 1)
            return F.when(features[self.feature[t, i]] <= F.lit(float(self.threshold[t, i])), node(t, 2 * i + 1)).otherwise(node(t, 2 * i + 2))

        out = F.lit(float(self.base))
        for t in range(len(self.feature)):
            out = out + node(t, 0)
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, reg: float = 1.0, least: float = 1.0) -> Forest:
    """x: (n, features) of finite values; y: 0 or 1. With no rows the forest scores 0.5, with one class near that class."""
    n, m = x.shape
    inner = (1 << depth) - 1
    p = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(p / (1 - p)))
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Forest(feature, threshold, leaf, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    margin = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(n, np.int64)
        for d in range(depth):
            first, nodes = (1 << d) - 1, 1 << d
            place = at - first
            best, cut = np.full(nodes, 1e-9), np.full((nodes, 2), -1)
            for j in range(m):
                key = place * bins + binned[:, j]
                g = np.cumsum(np.bincount(key, grad, nodes * bins).reshape(nodes, bins), axis=1)
                h = np.cumsum(np.bincount(key, hess, nodes * bins).reshape(nodes, bins), axis=1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + reg) + gr**2 / (hr + reg) - g[:, -1:] ** 2 / (h[:, -1:] + reg)
                gain[(h < least) | (hr < least)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better], cut[better] = top[better], np.stack([np.full(nodes, j), k], axis=1)[better]
            for v in np.flatnonzero(cut[:, 0] >= 0):
                feature[t, first + v], threshold[t, first + v] = cut[v, 0], edges[cut[v, 0]][cut[v, 1]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        place = at - inner
        leaf[t] = rate * np.bincount(place, grad, inner + 1) / (np.bincount(place, hess, inner + 1) + reg)
        margin += leaf[t, place]
    return Forest(feature, threshold, leaf, base)


def steps(value: Column) -> Column:
    """Whole numbers from 0, rounded down to their first six binary digits: below 64 as they are, and 32 values from each power of 2 to the next."""
    value = F.least(value.cast("long"), F.lit(NEVER - 1)).cast("int")
    return let(value, lambda v: let(F.greatest(F.length(F.bin(v)) - 6, F.lit(0)), lambda k: F.call_function("shiftleft", F.call_function("shiftright", v, k), k)))


def _numbers(values: np.ndarray) -> str:
    return f"array({','.join(str(int(v)) for v in values.ravel())})"


def _place(feature: np.ndarray, cut: np.ndarray, depth: int, first: str = "0") -> str:
    """SQL: the node, depth levels down, that x reaches in the tree whose nodes start at first."""
    down = f"2 * at + 1 + int(get(x, get({_numbers(feature)}, {first} + at)) >= get({_numbers(cut)}, {first} + at))"
    return f"aggregate(sequence(1, {depth}), 0, (at, d) -> {down})" if depth else "0"


def _units(feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: int) -> str:
    """SQL: the margin of x, an array of `steps`, in parts of 1 / UNIT."""
    trees, inner = feature.shape
    place = _place(feature, cut, (inner + 1).bit_length() - 1, f"t * {inner}")
    return f"aggregate(sequence(0, {trees - 1}), {base}, (m, t) -> m + get({_numbers(leaf)}, t * {inner + 1} + {place} - {inner}))" if trees else str(base)


@dataclass
class Grown(Forest):
    """A forest whose margins are whole parts of 1 / UNIT; a row goes right in a node if its value is >= the cut."""

    cut: np.ndarray

    def units(self) -> Column:
        """The margin of the column x, an array of `steps`, in parts of 1 / UNIT."""
        return F.expr(_units(self.feature, self.cut, np.rint(self.leaf * UNIT), round(self.base * UNIT)))


def grow(rows: DataFrame, trees: int = 80, depth: int = 4, rate: float = 0.15, reg: float = 1.0, least: float = 1.0) -> Grown:
    """rows: x (an array of `steps`, as long in each row), y (0 or 1), n (how often the row counts, long). All rows are used, in an aggregation for each level of each tree; they should be at hand (cached).

    With no rows the forest scores 0.5, with one class near that class.
    """
    inner = (1 << depth) - 1
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0))).first()
    n, good = map(int, total)
    p = (good + 1.0) / (n + 2.0)
    base = round(float(np.log(p / (1 - p))) * UNIT)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), NEVER), np.zeros((trees, inner + 1), np.int64)
    for t in range(trees if 0 < good < n else 0):
        q = f"1 / (1 + exp(-({_units(feature[:t], cut[:t], leaf[:t], base)}) / {UNIT}D)) AS q"
        for d in range(depth):
            first = (1 << d) - 1
            judged = rows.selectExpr("n", "x", "y", q, f"{_place(feature[t], cut[t], d)} - {first} AS at")
            each = judged.selectExpr(f"n * bigint(round((y - q) * {FINE})) AS g", f"n * greatest(bigint(round(q * (1 - q) * {FINE})), 1) AS h", "at", "posexplode(x) AS (f, v)")
            # a row for each node, feature and value
            got = [c.to_numpy() for c in each.groupBy("at", "f", "v").agg({"g": "sum", "h": "sum"}).select("at", "f", "v", "sum(g)", "sum(h)").toArrow().columns]
            order = np.lexsort((got[2], got[1], got[0]))
            for v, own in _by(got[0][order], [c[order] for c in got[1:]]):
                feature[t, first + v], cut[t, first + v], *sides = _best(*own, reg, least)
                if d == depth - 1:
                    leaf[t, 2 * v : 2 * v + 2] = [round(rate * UNIT * float(np.clip(g / (h + reg), -STEP, STEP))) for g, h in sides]
    return Grown(feature, np.where(cut < NEVER, cut - 0.5, np.inf), leaf / UNIT, base / UNIT, cut)


def _by(key: np.ndarray, columns: list[np.ndarray]):
    """(key, the columns of its rows) of rows in order of key."""
    at = np.flatnonzero(np.diff(key, prepend=-1))
    for a, b in zip(at, [*at[1:], len(key)], strict=True):
        yield int(key[a]), [c[a:b] for c in columns]


def _best(f: np.ndarray, v: np.ndarray, g: np.ndarray, h: np.ndarray, reg: float, least: float):
    """Of a node's sums by feature and value, in their order: the feature and the cut of the largest gain, and the gradients left and right of it; where none gains, all go left."""
    first = f == f[0]
    all_g, all_h = g[first].sum() / FINE, h[first].sum() / FINE
    best = (1e-9, 0, NEVER, (all_g, all_h), (0.0, 0.0))
    for j, (values, gs, hs) in _by(f, [v, g, h]):
        gl, hl = np.cumsum(gs)[:-1] / FINE, np.cumsum(hs)[:-1] / FINE
        gr, hr = all_g - gl, all_h - hl
        gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - all_g**2 / (all_h + reg)
        gain[(hl < least) | (hr < least)] = 0
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), j, int(values[k + 1]), (gl[k], hl[k]), (gr[k], hr[k]))
    return best[1:]


def threshold_at(score: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The least threshold from which on at least the given share of the rows is of class 1; infinite where there is none. With n, a row stands for n rows, y of them of class 1."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / np.cumsum(np.ones(len(y)) if n is None else n[order])
    last = np.append(np.diff(score[order]) != 0, True) if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else np.inf
