"""Suffix order and longest previous factors of the windows of many snippets, in numpy.

Suffixes are put in the order of their first `length` symbols, by content and not by hash. The longest previous factor of
a suffix is the longest match with one that begins earlier: its nearest neighbours in suffix order that begin earlier,
the previous and the next smaller position, hold it.
"""
from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, match): the order of the suffixes at starts by their first `length` symbols, ties as they are given; and
    how many symbols each shares with the one before it in that order, at most `length`."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(symbols, length)[starts]
    order = np.argsort(rows.view(f"S{length * symbols.itemsize}").reshape(-1), kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    match = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return order, np.concatenate([[0], match])


def previous_smaller(place: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in suffix order: the nearest one before it whose place is smaller (-1: none), and their match.

    Minima over 2, 4, 8, ... neighbours let every suffix skip larger places in a logarithm of steps.
    """
    n = len(place)
    least, low = [place], [match]
    while 2 << (len(least) - 1) <= n:
        w, a, m = 1 << (len(least) - 1), least[-1], low[-1]
        least.append(np.concatenate([a[:w], np.minimum(a[w:], a[:-w])]))
        low.append(np.concatenate([m[:w], np.minimum(m[w:], m[:-w])]))
    at, shared = np.arange(n) - 1, match.copy()
    for level in range(len(least) - 1, -1, -1):
        w = 1 << level
        skip = np.flatnonzero(at - w + 1 >= 0)
        skip = skip[least[level][at[skip]] >= place[skip]]
        shared[skip] = np.minimum(shared[skip], low[level][at[skip]])
        at[skip] -= w
    none = at < 0
    none[~none] = place[at[~none]] >= place[~none]
    return np.where(none, -1, at), np.where(none, 0, shared)


def next_smaller(place: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As previous_smaller, for the nearest one after it."""
    at, shared = previous_smaller(place[::-1], np.concatenate([match[:1], match[:0:-1]]))
    at, shared = at[::-1], shared[::-1]
    return np.where(at < 0, -1, len(place) - 1 - at), shared


def longest_factors(symbols: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int, later: bool) -> np.ndarray:
    """How much of each suffix, up to `length` symbols, one of a smaller place begins with too; with `later`, one of any
    other place. Of suffixes of equal place, none counts for the others."""
    order, match = suffix_order(symbols, starts, length)
    out = np.zeros(len(starts), np.int64)
    for ranked in [place[order], -place[order]][: 1 + later]:
        both = np.maximum(previous_smaller(ranked, match)[1], next_smaller(ranked, match)[1])
        out[order] = np.maximum(out[order], both)
    return out
