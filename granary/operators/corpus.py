"""Corpus operators: first-wins dedup, splits, token statistics and lints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the first by order. A partial aggregate on the order, then a join: no sort of whole rows."""
    keyed = df.withColumn("_key", F.sha2(key, 256))
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(first.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col(order) == F.col("_first"))).drop("_k", "_first")


def split(identity: Column, region: Column, held_out: list[str]) -> Column:
    """Held-out regions go to val or test by a hash bit, all others to train."""
    return F.when(region.isin(*held_out), F.when(T.hash_bucket(identity, 2) == 0, "val").otherwise("test")).otherwise("train")


def token_labels(df: DataFrame, text: str, label: str) -> DataFrame:
    return df.select(F.explode(T.tokens(F.col(text))).alias("token"), F.col(label).alias("label")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))


def bigram_labels(df: DataFrame, text: str, label: str, least: int = 2) -> DataFrame:
    """Neighbouring tokens by label; bigrams seen less than `least` times in all are dropped."""
    t = T.tokens(F.col(text))
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    each = df.select(F.explode(pairs).alias("bigram"), F.col(label).alias("label")).groupBy("bigram", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("bigram"))
    return each.withColumn("_total", total).filter(F.col("_total") >= least).drop("_total")


def majority(counts: DataFrame, key: str) -> DataFrame:
    """The label that most rows of a key have; ties go to the lesser label."""
    best = F.max_by(F.struct("label", "n"), F.struct(F.col("n"), F.col("_rank")))
    ranked = counts.withColumn("_rank", F.transform(F.split("label", ""), lambda c: -F.ascii(c)))
    out = ranked.groupBy(key).agg(best.alias("b"), F.sum("n").alias("total"))
    return out.select(key, F.col("b.label").alias("label"), F.col("b.n").alias("count"), "total", (F.col("b.n") / F.col("total")).alias("confidence"))


def lint_outliers(shard: DataFrame, corpus: DataFrame, key: str, sure: float = 0.66, shard_least: int = 50, corpus_least: int = 200) -> DataFrame:
    """Keys whose majority label in a shard is not the corpus's, where both are well supported."""
    s, c = shard.alias("s"), corpus.alias("c")
    hit = s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"))
    hit = hit.filter((F.col("c.confidence") >= sure) & (F.col("s.total") >= shard_least) & (F.col("c.total") >= corpus_least) & (F.col("s.label") != F.col("c.label")))
    return hit.select(F.col(f"s.{key}").alias(key), F.col("s.label").alias("shard_label"), F.col("c.label").alias("corpus_label"))


def lint_vacuum(shard: DataFrame, corpus: DataFrame, shard_least: int = 20, corpus_least: int = 100) -> DataFrame:
    """(token, label) that a shard has often and the corpus never, of tokens that the corpus has often."""
    known = corpus.groupBy("token").agg(F.sum("n").alias("corpus_total")).filter(F.col("corpus_total") >= corpus_least)
    often = shard.filter(F.col("n") >= shard_least).join(known, "token")
    return often.join(corpus.select("token", "label"), ["token", "label"], "left_anti").select("token", "label", "n")
