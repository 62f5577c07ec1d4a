"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's frequent-items sketch belongs to that family) names the digests that may hold a large
share of all rows. Those few are counted exactly, and their winners are broadcast, so that their rows never meet: each
map task marks its own. All other digests are rare by construction and take an ordinary shuffle: an aggregation with map-side sums, from which
texts without a copy come out whole, and a join of the rows that have copies.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, documents, free, mark, materialize, without_ids, without_space

#: A digest of more than 1 / SHARE of all rows is heavy: at most SHARE digests are, which bounds the broadcast.
SHARE = 1000
#: Counters of the summary. Its counts err by 3.5 / TRACKED of all rows at most, less than half of a heavy digest's.
TRACKED = 8192
#: Summaries are merged in so many groups first, then once more.
MERGERS = 64


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Slim rows: doc_id, digest (SHA-256 of the text without white space), n_chars of the original text, a row's uid."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(without_space(as_text(text)), 256)).alias("digest"),
        F.char_length(as_text(text)).alias("n_chars"),
        F.monotonically_increasing_id().alias("uid"),
    )


def frequent_keys(slim: DataFrame, rows: int) -> DataFrame:
    """At most SHARE hash keys, among them that of every digest that more than rows / SHARE rows have."""
    parts = slim.select(F.xxhash64("digest").alias("key"), (F.spark_partition_id() % MERGERS).alias("merger"))
    merged = parts.groupBy("merger").agg(F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("s"))
    # Grouped, since the merge of no summary at all, in a partition without rows, fails in Spark 4.1.
    merged = merged.groupBy((F.col("merger") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"))
    items = merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {SHARE})")).alias("x"))
    return items.filter(F.col("x.count") >= max(2, rows / SHARE)).select(F.col("x.item").alias("key"))


def _winner() -> list:
    """The row that stays: most code points, smallest doc_id (null last), first row."""
    return [F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("uid").alias("u"))), F.count(F.lit(1))]


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when they are identical without white space; a null text counts as empty, and empty texts are one
    group. Of equal texts the row with the most code points stays, then the smallest doc_id (a null doc_id comes last).
    Of repeated rows, with one doc_id and one text, exactly one stays. No rows give no rows; further columns of docs,
    whatever their names, are not read.
    """
    slim = materialize(digests(docs, text, doc_id), "digests")
    heavy = slim.join(F.broadcast(frequent_keys(slim, slim.count())), F.xxhash64("digest") == F.col("key"), "left_semi")
    top, size = _winner()
    winners = heavy.groupBy("digest").agg(top.alias("top"), size.alias("group_size")).filter("group_size > 1")
    winners = F.broadcast(winners)  # SHARE rows at most, but for equal 64-bit keys
    marked = slim.join(winners, "digest")
    rest = slim.join(winners.select("digest"), "digest", "left_anti")
    groups = materialize(rest.groupBy("digest").agg(top.alias("top"), size.alias("group_size")), "groups")
    single = groups.filter("group_size = 1").select("digest", F.bitwise_not("top.d").alias("doc_id"), F.col("top.n_chars").alias("n_chars"), F.bitwise_not("top.u").alias("uid"), "top", "group_size")
    several = rest.join(groups.filter("group_size > 1"), "digest")
    return marked.unionByName(several).unionByName(single).select(
        "doc_id",
        F.bitwise_not("top.d").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.bitwise_not("top.u")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Decisions are made on slim rows and carried back by doc_id: the few that go are the small side of the join. Where a
    doc_id repeats, by (doc_id, digest), and one of the rows that repeat both is taken.
    """
    since = mark()
    groups = exact_groups(docs, text, doc_id).select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"), "kept")
    groups = materialize(groups, "kept")
    free(since)
    if groups.groupBy("_id").count().filter("count > 1").isEmpty():
        gone = materialize(groups.filter(~F.col("kept")).select("_id"), "gone")
        return without_ids(docs, doc_id, gone)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # whatever the columns are called
    rows = docs.select(own.alias("_row"), F.col(doc_id).alias("_own_id"), F.unhex(F.sha2(without_space(as_text(text)), 256)).alias("_own_digest"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest"))
    found = rows.join(groups.filter("kept").select("_id", "_digest"), same, "left_semi")
    return found.dropDuplicates(["_own_id", "_own_digest"]).select("_row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("n_chars")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC) = 1 AS kept,
       text_sha256
FROM t
"""
