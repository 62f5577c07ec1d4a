"""Scalar functions and evaluation on whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.registry import query
from granary.plans.tables import table


@query("fn_collapse", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS folded FROM documents")
def fn_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.canonical(F.col("text")), 256).alias("folded"))


@query("fn_word_shape", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g') AS shape FROM part")
def fn_word_shape(spark, d):
    return table(spark, d, "part").select("p_partkey", T.word_shape(F.col("p_brand")).alias("shape"))


@query("fn_emails", "SELECT doc_id, len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) AS n FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')")
def fn_emails(spark, d):
    n = F.regexp_count("text", F.lit(T.EMAIL))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n")).filter("n > 0")


@query("fn_phone", "SELECT conv_id, turn, nullif(CASE WHEN length(x) >= 10 THEN right(x, 10) ELSE x END, '') AS phone FROM (SELECT conv_id, turn, regexp_replace(text, '[^0-9]', '', 'g') AS x FROM conversations)")
def fn_phone(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.phone(F.col("text")).alias("phone"))


@query("fn_us_zip", r"SELECT doc_id, nullif(regexp_extract(text, '\b([0-9]{5})(-[0-9]{4})?\b', 1), '') AS zip FROM documents")
def fn_us_zip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.us_zip(F.col("text")).alias("zip"))


@query("fn_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("fn_url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def fn_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("fn_page_title", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def fn_page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("evl_calibration", """WITH x AS (SELECT least(n_chars / 5000.0, 1) AS p, quality FROM documents JOIN labels USING (doc_id)) SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 9) AS confidence, round(avg(quality), 9) AS accuracy, round(abs(avg(p) - avg(quality)), 9) AS gap FROM x GROUP BY 1""")
def evl_calibration(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"), "quality")
    b = x.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("quality").alias("accuracy"))
    return b.select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"), F.round(F.abs(F.col("confidence") - F.col("accuracy")), 9).alias("gap"))


@query("evl_conversation_spans", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def evl_conversation_spans(spark, d):
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), roles.alias("roles"), F.sum(F.length("text")).alias("chars"))
