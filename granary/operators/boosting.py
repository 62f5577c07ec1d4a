"""Boosted regression trees: fitted on a bounded sample on the driver, scored as a column expression."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A leaf's value, or a split: feature <= threshold goes low."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)


def thresholds(x: np.ndarray, exact: int = 8, quantiles: int = 6) -> list[np.ndarray]:
    """Where each feature may be split: between its values if they are few, else at quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) <= exact:
            out.append((values[1:] + values[:-1]) / 2)
        else:
            out.append(np.unique(np.sort(column)[[(len(column) - 1) * q // (quantiles + 1) for q in range(1, quantiles + 1)]]))
    return out


def _grow(x: np.ndarray, g: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> Tree:
    total, moment = w.sum(), (w * g).sum()
    tree = Tree(moment / total if total else 0.0)
    if not depth or len(x) < 2 * least:
        return tree
    best = (1e-12, -1, 0.0)
    for f, at in enumerate(cuts):
        for t in at:
            low = x[:, f] <= t
            n = int(low.sum())
            if n < least or len(x) - n < least:
                continue
            a, b = w[low].sum(), (w[low] * g[low]).sum()
            # The squared error falls by what the two means explain beyond the one.
            gain = (b * b / a if a else 0) + ((moment - b) ** 2 / (total - a) if total > a else 0) - (moment * moment / total if total else 0)
            if gain > best[0]:
                best = (gain, f, float(t))
    if best[1] < 0:
        return tree
    low = x[:, best[1]] <= best[2]
    return Tree(tree.value, best[1], best[2], _grow(x[low], g[low], w[low], cuts, depth - 1, least), _grow(x[~low], g[~low], w[~low], cuts, depth - 1, least))


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.threshold, predict(tree.low, x), predict(tree.high, x))


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, rounds: int = 50, depth: int = 3, rate: float = 0.1, least: int = 20) -> Boosted:
    """Log-odds of y by gradient steps; x is a sample that the caller bounds."""
    w = np.ones(len(y)) if w is None else w
    positive = w[y == 1].sum()
    model = Boosted(float(np.log((positive + 1) / (w.sum() - positive + 1))), rate)
    score, cuts = np.full(len(y), model.base), thresholds(x)
    for _ in range(rounds):
        tree = _grow(x, y - 1 / (1 + np.exp(-np.clip(score, -30, 30))), w, cuts, depth, least)
        score += rate * predict(tree, x)
        model.trees.append(tree)
    return model


def score(model: Boosted, features: Column) -> Column:
    """The model's log-odds of an array of features, as nested conditions."""
    def of(tree: Tree) -> Column:
        if tree.feature < 0:
            return F.lit(float(tree.value))
        return F.when(F.get(features, F.lit(tree.feature)) <= tree.threshold, of(tree.low)).otherwise(of(tree.high))

    out = F.lit(float(model.base))
    for tree in model.trees:
        out = out + model.rate * of(tree)
    return out
