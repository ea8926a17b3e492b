"""Gradient-boosted trees in numpy: training on binned features, prediction, and LightGBM's text models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Inner nodes: feature, threshold (at most goes left), children (~leaf number, or a node); leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int) if len(self.feature) else np.full(len(x), -1)
        while (go := np.flatnonzero(at >= 0)).size:
            k = at[go]
            at[go] = np.where(x[go, self.feature[k]] <= self.threshold[k], self.left[k], self.right[k])
        return self.value[~at]


@dataclass
class Booster:
    """Trees of each class in turn; scores become probabilities by a softmax (one class: a logistic)."""

    classes: list
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        k = max(1, len(self.classes) if len(self.classes) > 2 else 1)
        out = np.zeros((len(x), k))
        for i, t in enumerate(self.trees):
            out[:, i % k] += t.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x)
        if z.shape[1] == 1:
            p = 1 / (1 + np.exp(-z[:, 0]))
            return np.column_stack([1 - p, p])
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _grow(xb: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Tree:
    feature, threshold, left, right, value = [], [], [], [], []

    def leaf(rows) -> int:
        value.append(-rate * g[rows].sum() / (h[rows].sum() + ridge))
        return ~(len(value) - 1)

    def node(rows, level) -> int:
        best = (1e-9, -1, -1)
        if level < depth and len(rows) >= 2 * least:
            G, H = g[rows].sum(), h[rows].sum()
            for f in range(xb.shape[1]):
                m = len(edges[f]) + 1
                cg, ch, cn = (np.cumsum(np.bincount(xb[rows, f], weights=w, minlength=m))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = cg**2 / (ch + ridge) + (G - cg) ** 2 / (H - ch + ridge) - G**2 / (H + ridge)
                gain[(cn < least) | (len(rows) - cn < least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] < 0:
            return leaf(rows)
        _, f, cut = best
        at = len(feature)
        feature.append(f)
        threshold.append(edges[f][cut])
        left.append(0)
        right.append(0)
        low = xb[rows, f] <= cut
        left[at] = node(rows[low], level + 1)
        right[at] = node(rows[~low], level + 1)
        return at

    node(np.arange(len(g)), 0)
    return Tree(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, ridge: float = 1.0) -> Booster:
    """Trees on quantile bins by second-order gains of the softmax loss."""
    names = sorted(set(y.tolist()))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    xb = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    out = Booster(names)
    k = len(names) if len(names) > 2 else 1
    z = np.zeros((len(x), k))
    for _ in range(rounds if len(names) > 1 else 0):
        p = 1 / (1 + np.exp(-z)) if k == 1 else np.exp(z - z.max(1, keepdims=True))
        p = p if k == 1 else p / p.sum(1, keepdims=True)
        for j in range(k):
            hit = (y == names[1 if k == 1 else j]).astype(float)
            t = _grow(xb, edges, p[:, j] - hit, np.maximum(p[:, j] * (1 - p[:, j]), 1e-6), depth, least, ridge, rate)
            out.trees.append(t)
            z[:, j] += t.predict(x)
    return out


def parsed(text: str, classes: list) -> Booster:
    """A LightGBM text model with numerical splits."""
    trees = []
    for block in text.split("\nTree=")[1:]:
        d = dict(line.split("=", 1) for line in block.splitlines()[1:] if "=" in line)
        ints = lambda k: np.array(d.get(k, "").split(), int)  # noqa: B023, E731
        trees.append(Tree(ints("split_feature"), np.array(d.get("threshold", "").split(), float), ints("left_child"), ints("right_child"), np.array(d["leaf_value"].split(), float)))
    return Booster(classes, trees)
