"""Exact aggregates that Spark has no single function for."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], rule: str) -> DataFrame:
    """Order statistics by rule: "floor" takes sorted[min(n - 1, floor(p * n))], "nearest" sorted[ceil(p * n) - 1].

    Values are counted before they are ordered, so a group's rows never meet; its distinct values do.
    """
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    out = []
    for name, p in shares.items():
        n = F.col("_all")
        at = F.least(n - 1, F.floor(n * p)) if rule == "floor" else F.greatest(F.ceil(n * p), F.lit(1)) - 1
        out.append(F.min(F.when(F.col("_to") > at, F.col(value))).alias(name))
    return ranked.groupBy(group).agg(*out)


def shares(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """Each key's share, its rank, and whether it dominates: over 40 % or over 1.5 times the next."""
    by = df.groupBy(key).agg(F.sum(weight).alias("rows"))
    order = Window.orderBy(F.desc("rows"), key)  # one row per key
    out = by.withColumns({"share": F.col("rows") / F.sum("rows").over(Window.partitionBy()), "rank": F.row_number().over(order), "_next": F.lead("rows").over(order)})
    return out.withColumn("dominant", (F.col("share") > 0.4) | ((F.col("rank") == 1) & (F.col("rows") > 1.5 * F.coalesce("_next", F.lit(0))))).drop("_next")


def pairwise_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of pairs put together, from contingency counts; null where undefined."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(pairs(F.col("n")).alias("both"))
    t = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("true_pairs"))
    p = cells.groupBy(predicted).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("predicted_pairs"))
    out = both.join(t).join(p)  # one row each
    precision, recall = F.col("both") / F.nullif(F.col("predicted_pairs"), F.lit(0.0)), F.col("both") / F.nullif(F.col("true_pairs"), F.lit(0.0))
    return out.select("both", "true_pairs", "predicted_pairs", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"))


def transitions(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Log-probabilities of label pairs in sequence, with one added to each count, less the row's greatest."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.withColumn("to", F.lead(label).over(w)).filter("to is not null").groupBy(F.col(label).alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))
    names = df.select(F.col(label).alias("x")).distinct()
    grid = names.select(F.col("x").alias("from")).join(names.select(F.col("x").alias("to")))  # labels are few
    full = grid.join(seen, ["from", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    row = Window.partitionBy("from")
    p = F.log(F.col("n") / F.sum("n").over(row))
    return full.withColumn("logp", p).select("from", "to", (F.col("logp") - F.max("logp").over(row)).alias("score"))
