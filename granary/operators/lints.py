"""Lints of labelled rows against a corpus: tags of words and pairs, rules, and plain sanity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least counts that a finding needs, and the share of rows without any tag from which a shard teaches nothing.
BIGRAM, BLANK = 10, 0.9


def _majority(counts: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, n, total): the most frequent value; of equal ones the least."""
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col(value).alias("b"))).alias("_b"), F.sum("n").alias("total"))
    return best.select(*key, F.col("_b.b").alias(value), (-F.col("_b.a")).alias("n"), "total")


def _pairs(rows: DataFrame) -> DataFrame:
    n = F.least(F.size("tokens"), F.size("labels"))
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    two = lambda c, i, low: F.concat_ws(" ", *[(F.lower(F.get(c, i + k)) if low else F.get(c, i + k)) for k in (0, 1)])
    return rows.select(F.explode(F.transform(at, lambda i: F.struct(two("tokens", i, True).alias("bigram"), two("labels", i, False).alias("label")))).alias("x")).select("x.*").groupBy("bigram", "label").agg(F.count(F.lit(1)).alias("n"))


def bigram_collisions(shard: DataFrame, corpus: DataFrame, least: int = BIGRAM) -> DataFrame:
    """Pairs of neighbours whose most frequent pair of labels differs, where both are seen `least` times."""
    a, b = _majority(_pairs(shard), ["bigram"], "label"), _majority(_pairs(corpus), ["bigram"], "label")
    b = b.select("bigram", F.col("label").alias("corpus_label"), F.col("n").alias("corpus_count"))
    j = a.join(b, "bigram").filter((F.col("label") != F.col("corpus_label")) & (F.col("n") >= least) & (F.col("corpus_count") >= least))
    return j.select("bigram", F.col("label").alias("shard_label"), "corpus_label", F.col("n").alias("shard_count"), "corpus_count")


def _tags(rows: DataFrame, *more: str) -> DataFrame:
    """(word, tag, more, n) of words that are not numbers, without B- and I-."""
    each = rows.select(*more, F.explode(F.arrays_zip("tokens", "labels")).alias("x")).filter("x.tokens IS NOT NULL AND x.labels IS NOT NULL")
    each = each.filter(~F.regexp_like("x.tokens", F.lit("^\\p{Nd}+$")))
    return each.groupBy(F.col("x.tokens").alias("word"), F.regexp_replace("x.labels", "^[BI]-", "").alias("tag"), *more).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(shard: DataFrame, corpus: DataFrame, threshold: float = 0.7, least: int = 50) -> DataFrame:
    """word, shard_tag, corpus_tag, share, total, kind: words that the corpus, in the countries where the shard has them,
    tags otherwise at least `threshold` of `least` times or more. Street prefixes and suffixes that the corpus takes for
    streets are affix splits, all else contradictions."""
    own = _tags(shard, "country")
    mine = _majority(own.groupBy("word", "tag").agg(F.sum("n").alias("n")), ["word"], "tag").select("word", F.col("tag").alias("shard_tag"))
    where = own.select("word", "country").distinct()
    theirs = _tags(corpus, "country")
    near = theirs.join(where.select(F.col("word").alias("_w"), F.col("country").alias("_c")), (F.col("word") == F.col("_w")) & F.col("country").eqNullSafe(F.col("_c")), "left_semi")
    top = _majority(near.groupBy("word", "tag").agg(F.sum("n").alias("n")), ["word"], "tag")
    share: Column = F.col("n") / F.col("total")
    j = mine.join(top, "word").filter((F.col("total") >= least) & (F.col("tag") != F.col("shard_tag")) & (share >= threshold))
    kind = F.when(F.col("shard_tag").isin("street_suffix", "street_prefix") & (F.col("tag") == "street"), "affix-split").otherwise("contradiction")
    return j.select("word", "shard_tag", F.col("tag").alias("corpus_tag"), share.alias("share"), "total", kind.alias("kind"))


def sanity(rows: DataFrame) -> DataFrame:
    """One row: n, truncated (another number of labels than tokens), blank (no tag at all), verdict."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("tokens") != F.size("labels")).alias("truncated"), F.count_if(F.forall("labels", lambda x: x == "O")).alias("blank"))
    return out.withColumn("verdict", F.when(F.col("truncated") > 0, "error").when(F.col("blank") >= BLANK * F.greatest(F.col("n"), F.lit(1)), "warn").otherwise("pass"))


def rule_hits(rows: DataFrame, rules: list[tuple[str, str, bool, tuple[str, ...]]], least: int = 5) -> DataFrame:
    """token, rule, label, n. rules: (name, pattern, whether case matters, labels that words of the pattern may not have)."""
    each = rows.select(F.explode(F.arrays_zip("tokens", "labels")).alias("x")).groupBy(F.lower("x.tokens").alias("token"), F.col("x.labels").alias("label")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    hits = F.filter(F.array(*[F.when(F.regexp_like("token", F.lit(p if case else f"(?i){p}")) & F.col("label").isin(*bad), F.lit(name)) for name, p, case, bad in rules]), lambda x: x.isNotNull())
    return each.select("token", F.explode(hits).alias("rule"), "label", "n")
