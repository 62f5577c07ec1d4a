"""Corpus build, statistics, lints and samples on the documents table."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import corpus as C
from granary.operators import stats as S
from granary.plans.registry import query
from granary.plans.tables import table

TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9''_-]+'), lambda x: x <> '')"
LICENSE = """CASE WHEN text LIKE '%MIT License%' THEN 'MIT' WHEN text LIKE '%Apache License%' THEN 'Apache-2.0' WHEN text LIKE '%CC BY-NC%' THEN 'CC-BY-NC-4.0'
 WHEN text LIKE '%GNU General Public License%' THEN 'GPL-3.0' ELSE 'unknown' END"""


def _licensed(spark, d):
    t = F.col("text")
    kind = F.when(t.contains("MIT License"), "MIT").when(t.contains("Apache License"), "Apache-2.0").when(t.contains("CC BY-NC"), "CC-BY-NC-4.0").when(t.contains("GNU General Public License"), "GPL-3.0").otherwise("unknown")
    return table(spark, d, "documents").select("doc_id", "source", kind.alias("license"))


@query("agg_license_counts", f"SELECT license, count(*) AS n FROM (SELECT {LICENSE} AS license FROM documents) GROUP BY 1")
def agg_license_counts(spark, d):
    return _licensed(spark, d).groupBy("license").agg(F.count(F.lit(1)).alias("n"))


@query("flt_license_exclude", f"SELECT doc_id, license FROM (SELECT doc_id, {LICENSE} AS license FROM documents) WHERE NOT regexp_matches(license, '(?i)^(gpl|cc[-]by[-]nc)')")
def flt_license_exclude(spark, d):
    return _licensed(spark, d).filter(~T.license_excluded(F.col("license"), ["gpl", "cc-by-nc"])).select("doc_id", "license")


BUCKET = "CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % {} AS INTEGER)"


@query("cor_hash_split", f"SELECT doc_id, {BUCKET.format(10)} AS bucket, CASE WHEN lang IN ('de') THEN CASE WHEN {BUCKET.format(2)} = 0 THEN 'val' ELSE 'test' END ELSE 'train' END AS split FROM documents")
def cor_hash_split(spark, d):
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", T.hash_bucket(i, 10).alias("bucket"), C.split(i, F.col("lang"), ["de"]).alias("split"))


@query("agg_split_counts", f"SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM (SELECT source, CASE WHEN lang IN ('de') THEN CASE WHEN {BUCKET.format(2)} = 0 THEN 'val' ELSE 'test' END ELSE 'train' END AS split FROM documents) GROUP BY 1")
def agg_split_counts(spark, d):
    s = table(spark, d, "documents").select("source", C.split(F.col("doc_id").cast("string"), F.col("lang"), ["de"]).alias("split"))
    return s.groupBy("source").agg(*[F.count_if(F.col("split") == x).alias(x) for x in ("train", "val", "test")])


@query("cor_source_id", "SELECT doc_id, source || '-' || substr(sha256('doc_id' || chr(31) || doc_id || chr(30) || 'lang' || chr(31) || lang), 1, 12) AS source_id FROM documents")
def cor_source_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.source_id(F.col("source"), {"lang": F.col("lang"), "doc_id": F.col("doc_id").cast("string")}).alias("source_id"))


@query("cor_first_wins", r"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def cor_first_wins(spark, d):
    return C.first_wins(table(spark, d, "documents").select("doc_id", "source", "text"), T.canonical(F.col("text")), "doc_id").select("doc_id", "source")


COUNTS = f"(SELECT token, label, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token, lang AS label FROM documents{{}}) GROUP BY 1, 2)"
MAJORITY = "(SELECT token, arg_max(label, (n, -ascii(label[1]), -ascii(label[2]))) AS label, max(n) AS count, CAST(sum(n) AS BIGINT) AS total, max(n) / CAST(sum(n) AS DOUBLE) AS confidence FROM {} GROUP BY 1)"


@query("agg_token_label", f"SELECT * FROM {COUNTS.format('')}")
def agg_token_label(spark, d):
    return C.token_labels(table(spark, d, "documents"), "text", "lang")


@query("agg_bigram_label", f"""WITH w AS (SELECT {TOKENS} AS t, lang AS label FROM documents),
 b AS (SELECT unnest(list_transform(list_zip(t[1:len(t) - 1], t[2:]), lambda x: x[1] || ' ' || x[2])) AS bigram, label FROM w WHERE len(t) > 1),
 c AS (SELECT bigram, label, count(*) AS n FROM b GROUP BY 1, 2) SELECT bigram, label, n FROM (SELECT *, sum(n) OVER (PARTITION BY bigram) AS s FROM c) WHERE s >= 2""")
def agg_bigram_label(spark, d):
    return C.bigram_labels(table(spark, d, "documents"), "text", "lang")


@query("agg_majority_label", f"SELECT token, label, count, total, round(confidence, 9) AS confidence FROM {MAJORITY.format(COUNTS.format(''))}")
def agg_majority_label(spark, d):
    return C.majority(C.token_labels(table(spark, d, "documents"), "text", "lang"), "token").withColumn("confidence", F.round("confidence", 9))


SHARD, REST = COUNTS.format(" WHERE source = 'src0'"), COUNTS.format(" WHERE source <> 'src0'")


def _shard_and_rest(spark, d):
    docs = table(spark, d, "documents")
    return C.token_labels(docs.filter("source = 'src0'"), "text", "lang"), C.token_labels(docs.filter("source <> 'src0'"), "text", "lang")


@query("lint_outliers", f"SELECT s.token, s.label AS shard_label, c.label AS corpus_label FROM {MAJORITY.format(SHARD)} s JOIN {MAJORITY.format(REST)} c USING (token) WHERE c.confidence >= 0.5 AND s.total >= 2 AND c.total >= 4 AND s.label <> c.label")
def lint_outliers(spark, d):
    s, c = _shard_and_rest(spark, d)
    return C.lint_outliers(C.majority(s, "token"), C.majority(c, "token"), "token", 0.5, 2, 4)


@query("lint_vacuum", f"SELECT s.token, s.label, s.n FROM {SHARD} s JOIN (SELECT token FROM {REST} GROUP BY 1 HAVING sum(n) >= 3) k USING (token) LEFT JOIN {REST} c ON c.token = s.token AND c.label = s.label WHERE s.n >= 2 AND c.token IS NULL")
def lint_vacuum(spark, d):
    return C.lint_vacuum(*_shard_and_rest(spark, d), 2, 3)


@query("agg_tf_table", "SELECT w AS value, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS frequency FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def agg_tf_table(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = w.agg(F.sum("n").alias("total"))
    return w.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("frequency"))  # one row


@query("agg_source_shares", "SELECT *, (share > 0.4) OR (rank = 1 AND \"rows\" > 1.5 * coalesce(nxt, 0)) AS dominant FROM (SELECT source, \"rows\", \"rows\" / CAST(sum(\"rows\") OVER () AS DOUBLE) AS share, CAST(row_number() OVER w AS INTEGER) AS rank, lead(\"rows\") OVER w AS nxt FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS \"rows\" FROM documents GROUP BY 1) WINDOW w AS (ORDER BY \"rows\" DESC, source))".replace("SELECT *, (share", "SELECT source, \"rows\", share, rank, (share", 1))
def agg_source_shares(spark, d):
    return S.shares(table(spark, d, "documents"), "source", F.col("n_chars"))


@query("agg_epoch_mixture", "SELECT win, source, n, round(n / CAST(sum(n) OVER (PARTITION BY win) AS DOUBLE) - 0.05, 9) AS deviation FROM (SELECT doc_id // 100 AS win, source, count(*) AS n FROM documents GROUP BY 1, 2)")
def agg_epoch_mixture(spark, d):
    n = table(spark, d, "documents").groupBy(F.expr("doc_id div 100").alias("win"), "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("deviation", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("win")) - 0.05, 9))


@query("agg_transitions", """WITH s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT DISTINCT event_type AS x FROM events),
 g AS (SELECT l.x AS a, r.x AS b, (SELECT count(*) FROM s WHERE s.a = l.x AND s.b = r.x) + 1 AS n FROM e l, e r), p AS (SELECT a, b, ln(n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE)) AS p FROM g)
 SELECT a AS "from", b AS "to", round(p - max(p) OVER (PARTITION BY a), 9) AS score FROM p""")
def agg_transitions(spark, d):
    return S.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("score", F.round("score", 9))


@query("srt_balanced_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7-' || doc_id)) AS r FROM documents) WHERE r <= 20")
def srt_balanced_sample(spark, d):
    """The 20 rows of least hash of each language: a top-k, kept by a bounded aggregate in each task."""
    h = F.sha2(F.concat(F.lit("7-"), F.col("doc_id").cast("string")), 256)
    w = Window.partitionBy("lang").orderBy("h")
    return table(spark, d, "documents").select("lang", "doc_id", h.alias("h")).withColumn("r", F.row_number().over(w)).filter("r <= 20").select("lang", "doc_id")


@query("srt_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256('s' || doc_id) LIMIT 50")
def srt_hash_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("s"), F.col("doc_id").cast("string")), 256).alias("h")).orderBy("h").limit(50).select("doc_id")


@query("srt_every_nth", "SELECT doc_id, source FROM documents WHERE doc_id % 10 = 0")
def srt_every_nth(spark, d):
    return table(spark, d, "documents").filter("doc_id % 10 = 0").select("doc_id", "source")


@query("srt_weighted_draws", "SELECT doc_id, source, CAST(k AS INTEGER) AS draw FROM (SELECT doc_id, source, unnest(range(0, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END)) AS k FROM documents)")
def srt_weighted_draws(spark, d):
    n = F.when(F.col("source") == "src0", 3).when(F.col("source") == "src1", 2).otherwise(1)
    return table(spark, d, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(0), n - 1)).alias("draw"))


@query("cor_golden_validate", "SELECT item_id, length(trim(text)) > 0 AS has_text, regexp_matches(text, '^[A-Z]') AS begins_upper, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9''_-]+'), lambda x: x <> '')) AS n_tokens FROM benchmark")
def cor_golden_validate(spark, d):
    return table(spark, d, "benchmark").select("item_id", (F.length(F.trim("text")) > 0).alias("has_text"), F.regexp_like("text", F.lit("^[A-Z]")).alias("begins_upper"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("cor_contamination", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) >= 30 AND contains(d.text, b.text)")
def cor_contamination(spark, d):
    """Whole benchmark items inside documents: candidates share the item's first five words, an equi join."""
    first = lambda c: F.concat_ws(" ", F.slice(F.split(c, "\\s+"), 1, 5))
    items = table(spark, d, "benchmark").filter(F.length("text") >= 30).select("item_id", F.col("text").alias("item"), first(F.col("text")).alias("head"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\\s+").alias("w"))
    heads = F.expr("array_distinct(transform(sequence(1, greatest(size(w) - 4, 1)), i -> concat_ws(' ', get(w, i - 1), get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3))))")
    docs = docs.select("doc_id", "text", F.explode(heads).alias("head"))
    return docs.join(items, "head").filter(F.contains("text", "item")).select("doc_id", "item_id").distinct()
