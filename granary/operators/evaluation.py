"""Scores of predictions: per tag and overall, calibration, conformal thresholds, gates and trends."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_counts(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by, tag, tp, fp, fn, p, r, f1) of two maps of tag to value. A wrong value is both a false and a missed one."""
    by = by or []
    tags = F.array_distinct(F.concat(F.map_keys(gold), F.map_keys(predicted)))
    each = rows.select(*by, F.explode(tags).alias("tag"), gold, predicted)
    g, p = (F.nullif(F.trim(F.element_at(F.col(c), F.col("tag"))), F.lit("")) for c in (gold, predicted))
    each = each.select(*by, "tag", g.alias("_g"), p.alias("_p"))
    same = F.col("_g").isNotNull() & F.col("_p").isNotNull() & (F.col("_g") == F.col("_p"))
    wrong = lambda c: F.col(c).isNotNull() & ~F.coalesce(same, F.lit(False))
    out = each.groupBy(*by, "tag").agg(F.count_if(same).alias("tp"), F.count_if(wrong("_p")).alias("fp"), F.count_if(wrong("_g")).alias("fn"))
    return with_scores(out)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds p, r and f1 to tp, fp and fn; 0 where there is nothing to divide by."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.withColumns({"p": p, "r": r}).withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def overall(rows: DataFrame, gold: str, predicted: str, by: list[str]) -> DataFrame:
    """(by, n, exact, exact_rate, macro_f1, micro_f1): micro by the sums of all tags, macro by the mean of their f1."""
    tags = tag_counts(rows, gold, predicted, by)
    micro = with_scores(tags.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    pairs = lambda c: F.array_sort(F.filter(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), F.trim(e["value"]).alias("v"))), lambda e: e["v"] != ""))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(pairs(gold) == pairs(predicted)).alias("exact"))
    out = whole.join(micro, by, "left")
    return out.select(*by, "n", "exact", (F.col("exact") / F.greatest(F.col("n"), F.lit(1))).alias("exact_rate"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"), F.coalesce("f1", F.lit(0.0)).alias("micro_f1"))


def calibration_bins(rows: DataFrame, confidence: str, correct: str, bins: int) -> DataFrame:
    """(bin, n, conf, acc, gap) of equal bins of confidence; 1 belongs to the last."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    out = rows.filter(F.col(confidence).between(0, 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return out.withColumn("gap", F.abs(F.col("conf") - F.col("acc")))


def calibration_errors(rows: DataFrame, confidence: str, correct: str, bins: int = 15, least: int = 20) -> DataFrame:
    """One row: ece, mce, robust_mce (bins of `least` rows or more), brier. A pass over the rows and one over the bins."""
    b = calibration_bins(rows, confidence, correct, bins).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"), F.coalesce(F.max(F.when(F.col("n") >= least, F.col("gap"))), F.lit(0.0)).alias("robust_mce")
    )
    brier = rows.filter(F.col(confidence).between(0, 1)).agg(F.avg(F.pow(F.col(confidence) - F.col(correct).cast("double"), 2)).alias("brier"))
    return b.join(F.broadcast(brier))  # two tables of one row


def isotonic(rows: DataFrame, x: str, y: str, grid: int = 10_000) -> list[tuple[float, float]]:
    """(x, fitted) of the least-squares rising step function, weighted by counts, for interpolation.

    Rows are first averaged on a grid of x, which bounds what reaches the driver; pools of neighbours that fall are merged.
    """
    cells = rows.groupBy(F.round(F.col(x) * grid).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("w"), F.avg(F.col(y).cast("double")).alias("y")).orderBy("g").collect()  # grid + 1 rows
    pools: list[list[float]] = []  # sum, weight, first, last
    for c in cells:
        pools.append([c["y"] * c["w"], c["w"], c["g"], c["g"]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    out = []
    for total, weight, first, last in pools:
        out += [(g / grid, total / weight) for g in dict.fromkeys((first, last))]
    return out


def interpolated(c: Column, knots: list[tuple[float, float]]) -> Column:
    """Between the two knots (x, y) around a value, on the line; beyond the ends, the end's. Null and NaN count as 0."""
    value = F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    at = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(min(1.0, max(0.0, y)))).alias("y")) for x, y in sorted(knots)])
    below = F.size(F.filter(at, lambda k: k["x"] <= value))
    a, b = F.get(at, F.greatest(below - 1, F.lit(0))), F.get(at, F.least(below, F.size(at) - 1))
    share = F.when(b["x"] > a["x"], (value - a["x"]) / (b["x"] - a["x"])).otherwise(0.0)
    return a["y"] + F.greatest(F.lit(0.0), share) * (b["y"] - a["y"])


def conformal_threshold(scores: DataFrame, score: str, coverage: float) -> DataFrame:
    """One row: n, and the threshold: the score of rank ceil((n + 1) * coverage); infinite where there is no such rank.

    Ranks come from counts of equal scores, so that no window holds all rows.
    """
    counts = scores.groupBy(score).agg(F.count(F.lit(1)).alias("_c"))
    total = scores.agg(F.count(F.lit(1)).alias("n"))
    n = total.first()["n"]
    rank = -int(-(n + 1) * coverage // 1)
    if not n or rank > n:
        return total.withColumn("threshold", F.lit(float("inf")))
    below = counts.withColumn("_upto", F.sum("_c").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
    return total.withColumn("threshold", F.lit(float(below.filter(F.col("_upto") >= rank).agg(F.min(score)).first()[0])))


def gate(scores: DataFrame, baseline: DataFrame, keys: list[str], metric: str, tolerance: float) -> DataFrame:
    """(keys, was, now, verdict): pass, regressed beyond the tolerance, new, or missing."""
    old = baseline.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(metric).alias("was"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = scores.select(*keys, F.col(metric).alias("now")).join(old, on, "full")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") < F.col("was") - tolerance, "regressed").otherwise("pass")
    return j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "was", "now", verdict.alias("verdict"))


def trends(runs: DataFrame, run: str, series: list[str], metric: str) -> DataFrame:
    """Each run's metric with its change since the run before, in each series."""
    w = Window.partitionBy(*series).orderBy(run)
    return runs.withColumn("change", F.col(metric) - F.lag(metric).over(w))


def oracle_at(ranked: DataFrame, query: str, rank: str, right: str, ks: tuple[int, ...]) -> DataFrame:
    """(k, queries, hits, rate): how many queries have a right candidate among their first k."""
    first = ranked.groupBy(query).agg(F.min(F.when(F.col(right), F.col(rank))).alias("_first"))
    wide = first.agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(F.col("_first") <= k).alias(f"h{k}") for k in ks])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks]))
    return wide.select("queries", each).select("k", "queries", "hits", (F.col("hits") / F.col("queries")).alias("rate"))


def adjusted_rand(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: ari, from the contingency table's pair counts; 1 for equal groupings of nothing to tell apart."""
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    cells = rows.groupBy(truth, found).agg(F.count(F.lit(1)).alias("n")).agg(two("n").alias("both"))
    a = rows.groupBy(truth).agg(F.count(F.lit(1)).alias("n")).agg(two("n").alias("a"), F.sum("n").alias("rows"))
    b = rows.groupBy(found).agg(F.count(F.lit(1)).alias("n")).agg(two("n").alias("b"))
    one = cells.join(F.broadcast(a)).join(F.broadcast(b))  # tables of one row
    expected = F.col("a") * F.col("b") / (F.col("rows") * (F.col("rows") - 1) / 2)
    top = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def invariance(rows: DataFrame, variants: dict[str, Column], answer) -> DataFrame:
    """(variant, n, same, rate): how often a changed text gets the answer of the unchanged one. rows: text."""
    each = rows.select("text", F.explode(F.create_map(*[x for k, v in variants.items() for x in (F.lit(k), v)])).alias("variant", "_other"))
    out = each.select("variant", answer(F.col("text")).alias("_a"), answer(F.col("_other")).alias("_b"))
    return out.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("same")).withColumn("rate", F.col("same") / F.col("n"))


def share_of_draws(draws: DataFrame, source: str, window: str, requested: dict[str, float]) -> DataFrame:
    """(window, source, n, share, requested, deviation) for every source that was asked for or drawn in a window."""
    ask = F.create_map(*[x for k, v in requested.items() for x in (F.lit(k), F.lit(v))])
    total = draws.groupBy(window).agg(F.count(F.lit(1)).alias("_all"))
    every = total.select(window, "_all", F.explode(F.map_keys(ask)).alias(source))
    seen = draws.groupBy(F.col(window).alias("_w"), F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    j = every.join(seen, (F.col(window) == F.col("_w")) & (F.col(source) == F.col("_s")), "left")
    share = F.coalesce("n", F.lit(0)) / F.col("_all")
    asked = F.element_at(ask, F.col(source))
    return j.select(window, source, F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), asked.alias("requested"), (share - asked).alias("deviation"))
