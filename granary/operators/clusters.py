"""What follows connected components: average-linkage refinement and cohesion."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _merged(total: np.ndarray, count: np.ndarray, never: np.ndarray, threshold: float) -> np.ndarray:
    """merge_average() of summed links (changed in place), where never tells of links that forbid a merger.

    The best partner of each row is kept, so that a merger looks anew only at rows that lost theirs: about the square of n.
    """
    n = len(total)
    mean = np.divide(total, count, out=np.full((n, n), -np.inf), where=(count > 0) & ~never)
    np.fill_diagonal(mean, -np.inf)
    of, best, at = np.arange(n), np.full(n, -np.inf), np.zeros(n, dtype=int)

    def look(p: int) -> None:
        if p + 1 < n:
            at[p] = p + 1 + int(mean[p, p + 1:].argmax())
            best[p] = mean[p, at[p]]

    for p in range(n):
        look(p)
    while n:
        a = int(best.argmax())  # of equal means, the first row, and its first partner
        if not np.isfinite(best[a]) or best[a] < threshold:
            break
        b = int(at[a])
        of[of == b] = a
        for table in (total, count):  # links add up, and those between the two are inside now
            table[a] += table[b]
            table[:, a] = table[a]
            table[b] = table[:, b] = 0
            table[a, a] = 0
        never[a] |= never[b]
        never[:, a] = never[a]
        mean[a] = np.divide(total[a], count[a], out=np.full(n, -np.inf), where=(count[a] > 0) & ~never[a])
        mean[:, a] = mean[a]
        mean[b] = mean[:, b] = mean[a, a] = best[b] = -np.inf
        lost = (at[:a] == a) | (at[:a] == b)
        fresh, was = mean[:a, a], best[:a]
        first = (fresh > was) | ((fresh == was) & (lost | (at[:a] > a)))
        again = np.flatnonzero(lost & ~first & (was > -np.inf))
        at[:a][first], best[:a][first] = a, fresh[first]
        for p in (*again, a, *(a + 1 + np.flatnonzero((at[a + 1:b] == b) & (best[a + 1:b] > -np.inf)))):
            look(int(p))
    return of


def _scale(weights: np.ndarray, rows: float) -> float:
    """A power of two: sums of weights in whole parts of it are exact for all pairs of so many rows, and so equal means are."""
    most = np.abs(weights[np.isfinite(weights)]).max(initial=1.0)
    return 2.0 ** (52 - np.ceil(np.log2(most)) - np.ceil(np.log2(max(rows * rows, 2.0))))


def merge_average(n: int, edges: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """The least member of each member's cluster, after merging while two clusters' links average the threshold."""
    each = np.array([e for e in edges if e[0] != e[1]], dtype=float).reshape(-1, 3)
    i, j, w = each[:, 0].astype(int), each[:, 1].astype(int), each[:, 2]
    total, count, never = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n), dtype=bool)
    scale = _scale(w, max(n, np.sqrt(len(w))))
    for a, b in ((i, j), (j, i)):
        np.add.at(total, (a, b), np.where(np.isfinite(w), np.rint(w * scale), 0.0))
        np.add.at(count, (a, b), 1.0)
        never[a[~np.isfinite(w)], b[~np.isfinite(w)]] = True
    return _merged(total, count, never, threshold * scale - 0.5)


def refine(labels: DataFrame, links: DataFrame, threshold: float, largest: int | None = None) -> DataFrame:
    """labels (node, label) with components split where they hang together by weak links on average. With `largest`, larger
    components stay as they are; without it none does, and a component of n rows takes memory for n * n links in one task.

    links: (a, b, weight), those below the threshold too.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.filter(_meant(largest)).select("label")
    inside = labels.join(small, "label")
    a = inside.select(F.col("node").alias("a"), F.col("label").alias("_la"))
    b = inside.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
    edges = links.join(a, "a").join(b, "b").filter("_la = _lb").select(F.col("_la").alias("label"), "a", "b", "weight")
    rows = inside.select("label", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("weight")).unionByName(edges.select("label", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("weight")))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(group.loc[group["b"].isna(), "a"].unique())
        pairs = group[group["b"].notna()]
        i, j = np.searchsorted(nodes, pairs["a"]), np.searchsorted(nodes, pairs["b"].astype("int64"))
        of = merge_average(len(nodes), list(zip(i, j, pairs["weight"], strict=True)), threshold)
        return pd.DataFrame({"node": nodes, "label": nodes[of]})

    refined = rows.groupBy("label").applyInPandas(split, "node long, label long")
    return labels.join(small, "label", "left_anti").select("node", "label").unionByName(refined)


def _meant(largest: int | None):
    return F.col("_n") >= 3 if largest is None else F.col("_n").between(3, largest)


def merge_classes(ids: list[np.ndarray], links: dict[tuple[int, int], float], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of merge_average() of rows in classes: all rows of class i have the same link with all of class j.

    Rows of a class whose own link is as strong as any it has are one from the start: a best merger of one of them is with
    another of them or with what averages the same with all of them. Other classes are taken row by row.
    """
    most = np.full(len(ids), -np.inf)
    for (i, j), w in links.items():
        if i != j:
            most[i], most[j] = max(most[i], w), max(most[j], w)
    own = np.array([links.get((c, c), -np.inf) for c in range(len(ids))])
    one = (own >= most) & (own >= threshold)
    parts = [(c, x) for c, rows in enumerate(ids) if len(rows) for x in ([np.sort(rows)] if one[c] or len(rows) == 1 else rows[:, None])]
    parts.sort(key=lambda part: part[1][0])
    least, sizes = np.array([x[0] for _, x in parts]), np.array([len(x) for _, x in parts], dtype=float)
    of_class = [[] for _ in ids]
    for k, (c, _) in enumerate(parts):
        of_class[c].append(k)
    n = len(parts)
    weight = np.full((n, n), np.nan)
    for (i, j), w in links.items():
        weight[np.ix_(of_class[i], of_class[j])] = weight[np.ix_(of_class[j], of_class[i])] = w
    scale = _scale(weight, sizes.sum())
    count = np.where(np.isnan(weight), 0.0, np.outer(sizes, sizes))
    np.fill_diagonal(count, 0.0)
    never = ~np.isfinite(weight) & (count > 0)
    total = np.rint(np.where(np.isfinite(weight), weight, 0.0) * scale) * count
    of = _merged(total, count, never, threshold * scale - 0.5)
    return np.concatenate([x for _, x in parts]), np.repeat(least[of], sizes.astype(int))


def refine_classes(members: DataFrame, links: DataFrame, labels: DataFrame, threshold: float, largest: int | None = None) -> DataFrame:
    """refine() of the components that connected_classes() gives at the threshold, by links (a, b, weight) between classes
    (members: node, _class).

    A component whose links all reach the threshold hangs together on any average, so it stays. The classes of each other
    one meet in a task: links between rows are never made.
    """
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"_l{x}")) for x in "ab")
    within = links.join(a, "a").join(b, "b").filter("_la = _lb").select(F.col("_la").alias("label"), "a", "b", "weight")
    few = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(_meant(largest)).select("label")
    few = few.join(within.filter(F.col("weight") < threshold + 1e-9 * max(1.0, abs(threshold))), "label", "left_semi")
    rows = labels.join(few, "label").join(members, "node").groupBy("label", F.col("_class").alias("a")).agg(F.collect_list(F.col("node").cast("long")).alias("ids"))
    long = lambda c: F.col(c).cast("long").alias(c)
    group = rows.select("label", long("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("weight"), "ids")
    group = group.unionByName(within.join(few, "label", "left_semi").select("label", long("a"), long("b"), "weight", F.lit(None).cast("array<long>").alias("ids")))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        held = group[group["ids"].notna()]
        number = {c: k for k, c in enumerate(held["a"])}
        met = group[group["ids"].isna()]
        links = {(number[i], number[int(j)]): w for i, j, w in zip(met["a"], met["b"], met["weight"], strict=True)}
        nodes, of = merge_classes([np.asarray(x, dtype=np.int64) for x in held["ids"]], links, threshold)
        return pd.DataFrame({"node": nodes, "label": of})

    return labels.join(few, "label", "left_anti").select("node", "label").unionByName(group.groupBy("label").applyInPandas(split, "node long, label long"))


def cohesion(labels: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(label, size, cohesion): the least weight of the links from the threshold on inside a cluster; null without any."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"_l{x}")) for x in "ab")
    inside = links.filter(F.col("weight") >= threshold).join(a, "a").join(b, "b").filter("_la = _lb")
    least = inside.groupBy(F.col("_la").alias("label")).agg(F.min("weight").alias("cohesion"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).join(least, "label", "left")
