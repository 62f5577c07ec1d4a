"""Unsupervised estimation of comparison weights: expectation and maximisation over agreement patterns."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns are a product of levels, so their number does not grow with the pairs. More than this is a wrong model.
MOST_PATTERNS = 100_000
#: Keeps the share of a level that no pair reaches above zero.
FLOOR = 1e-9


@dataclass
class Estimate:
    prior: float
    m: list[np.ndarray]
    u: list[np.ndarray]
    rounds: int
    converged: bool


def pattern_counts(pairs: DataFrame, levels: list[str], times: str | None = None) -> DataFrame:
    """Pairs by agreement pattern: one partial aggregation, whatever the number of pairs. times: how many a row stands for."""
    return pairs.groupBy(*levels).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))


def fit(patterns: np.ndarray, counts: np.ndarray, m: list[np.ndarray], u: list[np.ndarray], prior: float, rounds: int = 100, tolerance: float = 1e-6) -> Estimate:
    """patterns: a row per pattern, a column per comparison, -1 where it is missing, which says nothing of either class."""
    done, converged = 0, False
    if not len(patterns):
        return Estimate(prior, m, u, done, converged)
    present = patterns >= 0
    hits = [np.equal.outer(patterns[:, c], np.arange(len(m[c]))).astype(float) for c in range(patterns.shape[1])]
    for done in range(1, rounds + 1):
        like = np.array([np.full(len(patterns), prior), np.full(len(patterns), 1 - prior)])
        for c, hit in enumerate(hits):
            for side, shares in enumerate((m, u)):
                like[side] *= np.where(present[:, c], hit @ shares[c], 1.0)
        total = like.sum(axis=0)
        match = np.divide(like[0], total, out=np.zeros(len(total)), where=total > 0)
        fresh = [[], []]
        for side, mass in enumerate((counts * match, counts * (1 - match))):
            for c, hit in enumerate(hits):
                whole = mass[present[:, c]].sum()
                was = (m, u)[side][c]
                fresh[side].append((mass @ hit + FLOOR) / (whole + FLOOR * len(was)) if whole > 0 else was)
        after = float((counts * match).sum() / counts.sum())
        moved = max([abs(after - prior), *(np.abs(a - b).max() for side, old in enumerate((m, u)) for a, b in zip(fresh[side], old, strict=True))])
        prior, (m, u) = after, fresh
        if moved < tolerance:
            converged = True
            break
    return Estimate(prior, m, u, done, converged)


def estimate(pairs: DataFrame, levels: list[str], m: list[list[float]], u: list[list[float]], prior: float, times: str | None = None, **limits) -> Estimate:
    """Fits the model to candidate pairs with an integer level a comparison. times: how many pairs a row stands for."""
    found = pattern_counts(pairs, levels, times).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} agreement patterns")
    found.sort(key=lambda r: tuple(r[c] for c in levels))
    patterns = np.array([[r[c] for c in levels] for r in found], dtype=int).reshape(len(found), len(levels))
    return fit(patterns, np.array([r["n"] for r in found], dtype=float), [np.array(x) for x in m], [np.array(x) for x in u], prior, **limits)
