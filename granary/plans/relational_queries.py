"""Joins, aggregations, windows, sorts, set operations and hierarchies."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import linkage as L
from granary.operators import stats as S
from granary.operators.lineage import cut
from granary.plans.registry import query
from granary.plans.tables import PLACES, places, table


@query("join_inner_names", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner_names(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("join_left_population", "SELECT c_custkey, coalesce(n, 0) AS population, round(-log10(coalesce(n, 0) + 1), 9) AS neg_rank FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_left_population(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    p = F.coalesce("n", F.lit(0))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", p.alias("population"), F.round(-F.log10(p + 1), 9).alias("neg_rank"))


@query("join_reconcile", """SELECT c_custkey, CASE WHEN e AND f THEN 'enrolled' WHEN e THEN 'eligible-not-enrolled' WHEN f THEN 'funded-not-eligible' ELSE 'neither' END AS bucket FROM
 (SELECT c_custkey, c_acctbal > 0 AS e, c_custkey IN (SELECT o_custkey FROM orders) AS f FROM customer)""")
def join_reconcile(spark, d):
    funded = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    c = table(spark, d, "customer").join(funded, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", (F.col("c_acctbal") > 0).alias("e"), F.col("k").isNotNull().alias("f"))
    return c.select("c_custkey", F.when(F.col("e") & F.col("f"), "enrolled").when(F.col("e"), "eligible-not-enrolled").when(F.col("f"), "funded-not-eligible").otherwise("neither").alias("bucket"))


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_exists_flag", "SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AS has_return FROM supplier")
def join_exists_flag(spark, d):
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).distinct()
    return table(spark, d, "supplier").join(r, F.col("s_suppkey") == F.col("k"), "left").select("s_suppkey", F.col("k").isNotNull().alias("has_return"))


@query("join_interval", "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity BETWEEN p_size - 5 AND p_size + 5")
def join_interval(spark, d):
    on = (F.col("l_partkey") == F.col("p_partkey")) & F.col("l_quantity").between(F.col("p_size") - 5, F.col("p_size") + 5)
    return table(spark, d, "lineitem").join(table(spark, d, "part"), on).select("l_orderkey", "l_linenumber", "p_partkey")


@query("join_as_of", """WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)
 SELECT c_custkey, o_orderkey FROM customer JOIN v ON c_custkey = o_custkey WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30')""")
def join_as_of(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))
    at = F.lit("1996-06-30").cast("timestamp_ntz")
    live = v.filter((F.col("valid_from").cast("timestamp_ntz") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to").cast("timestamp_ntz") > at)))
    return table(spark, d, "customer").join(live, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("join_group_trim", """WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
 SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS trimmed FROM lineitem JOIN g USING (l_returnflag) WHERE abs(l_extendedprice - m) <= 1.5 * s GROUP BY 1""")
def join_group_trim(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")  # noqa: E741
    g = l.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    near = l.join(g, "l_returnflag").filter(F.abs(F.col("l_extendedprice") - F.col("m")) <= 1.5 * F.col("s"))
    return near.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("trimmed"))


@query("join_correlated_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN round((SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey), 6) ELSE c_acctbal END AS balance FROM customer")
def join_correlated_update(spark, d):
    up = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 6).alias("m"))
    return table(spark, d, "customer").join(up, F.col("c_nationkey") == F.col("k"), "left").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("m")).otherwise(F.col("c_acctbal")).alias("balance"))


@query("join_coverage_unknown", "SELECT n_nationkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 3 THEN 'covered' ELSE 'sparse' END AS coverage FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def join_coverage_unknown(spark, d):
    n = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 3, "covered").otherwise("sparse").alias("coverage"))


PCT = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query("agg_percentile_floor", "SELECT l_returnflag, " + ", ".join(f"list_sort(list(l_quantity))[CAST(least(count(*) - 1, floor(count(*) * {p})) AS BIGINT) + 1] AS {k}" for k, p in PCT.items()) + " FROM lineitem GROUP BY 1")
def agg_percentile_floor(spark, d):
    return S.exact_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", PCT, "floor")


@query("agg_percentile_nearest", "SELECT l_returnflag, " + ", ".join(f"list_sort(list(l_quantity))[CAST(greatest(ceil(count(*) * {p}), 1) AS BIGINT)] AS {k}" for k, p in PCT.items()) + " FROM lineitem GROUP BY 1")
def agg_percentile_nearest(spark, d):
    return S.exact_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", PCT, "nearest")


@query("agg_quantile_linear", "SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_discount, 0.35) AS d35 FROM lineitem GROUP BY 1")
def agg_quantile_linear(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.9).alias("p90"), F.percentile("l_discount", 0.35).alias("d35"))


@query("agg_rollup", "SELECT n_name, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS matches FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def agg_rollup(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("matches"))


@query("agg_tag_f1", """WITH x AS (SELECT lang, quality = 1 AS t, n_chars > 400 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM x GROUP BY 1)
 SELECT lang, tp, fp, fn, round(tp / greatest(tp + fp, 1), 9) AS precision, round(tp / greatest(tp + fn, 1), 9) AS recall, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 9) AS f1 FROM c""")
def agg_tag_f1(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 400).alias("p"))
    c = x.groupBy("lang").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    one = F.lit(1)
    return c.withColumns({"precision": F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), 9), "recall": F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one), 9), "f1": F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), one), 9)})


@query("agg_pairwise_prf", """WITH c AS (SELECT p_brand AS t, p_type AS p, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS b, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY t)) AS t, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY p)) AS p)
 SELECT CAST(b AS DOUBLE) AS both, CAST(t AS DOUBLE) AS true_pairs, CAST(p AS DOUBLE) AS predicted_pairs, round(b / p, 9) AS precision, round(b / t, 9) AS recall, round(2 * (b / p) * (b / t) / (b / p + b / t), 9) AS f1 FROM s""")
def agg_pairwise_prf(spark, d):
    out = S.pairwise_scores(table(spark, d, "part"), "p_brand", "p_type")
    return out.select(*[F.col(c).cast("double").alias(c) for c in ("both", "true_pairs", "predicted_pairs")], *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("agg_alias_bag", "SELECT n_regionkey, string_agg(n_name, chr(57344) ORDER BY n_name) AS bag FROM nation GROUP BY 1")
def agg_alias_bag(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "").alias("bag"))


@query("agg_two_of_a_kind", "SELECT o_custkey, min(o_orderpriority) AS first, max(o_orderpriority) AS second FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 2")
def agg_two_of_a_kind(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s")).filter(F.size("s") == 2)
    return s.select("o_custkey", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"))


@query("agg_filing_census", "SELECT l_suppkey, CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'mid' ELSE 'high' END AS bucket, count(DISTINCT l_orderkey) AS blocks FROM lineitem GROUP BY 1, 2")
def agg_filing_census(spark, d):
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_suppkey", F.when(p < 10000, "low").when(p < 50000, "mid").otherwise("high").alias("bucket")).agg(F.countDistinct("l_orderkey").alias("blocks"))


@query("agg_conditional", "SELECT l_shipmode_key, n, big, CAST(taxed AS BIGINT) AS taxed FROM (SELECT l_linenumber AS l_shipmode_key, count(*) AS n, count(*) FILTER (l_quantity > 25) AS big, sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS taxed FROM lineitem GROUP BY 1)".replace("l_shipmode_key", "line"))
def agg_conditional(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.sum(F.when(F.col("l_tax") > 0.04, 1).otherwise(0)).alias("taxed"))


@query("agg_multi_source", "WITH c AS (SELECT DISTINCT sha256(text) AS k, source FROM documents) SELECT a.source AS a, b.source AS b, count(*) AS n FROM c a JOIN c b ON a.k = b.k AND a.source < b.source GROUP BY 1, 2")
def agg_multi_source(spark, d):
    k = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.sort_array(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    p = k.select(F.explode(F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a, b))))")).alias("p"))
    return p.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


@query("agg_weighted_merge", "SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean, min(s_acctbal) AS lo, max(s_acctbal) AS hi, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY 1")
def agg_weighted_merge(spark, d):
    """Partial means, one for each half of the keys, merged by their counts."""
    part = table(spark, d, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 2).alias("half")).agg(F.avg("s_acctbal").alias("m"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("s_name").alias("name"))
    return part.groupBy("s_nationkey").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.min("name").alias("name"))


@query("win_primary_preference", """SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY eff DESC, c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM
 (SELECT *, c_acctbal + CASE WHEN c_nationkey = first_value(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) THEN 0 ELSE -1000 END AS eff FROM customer) QUALIFY place <= 25""")
def win_primary_preference(spark, d):
    by = Window.partitionBy("c_mktsegment")
    first = F.first("c_nationkey").over(by.orderBy(F.desc("c_acctbal"), "c_custkey"))
    c = table(spark, d, "customer").withColumn("eff", F.col("c_acctbal") + F.when(F.col("c_nationkey") == first, 0).otherwise(-1000))
    return c.withColumn("place", F.row_number().over(by.orderBy(F.desc("eff"), F.desc("c_acctbal"), "c_custkey"))).filter("place <= 25").select("c_custkey", "c_mktsegment", "place")


@query("win_exact_tier", """SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_name LIKE '%red%' THEN 2 WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 0 END DESC, p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 10""")
def win_exact_tier(spark, d):
    tier = F.when(F.col("p_name").like("%red%"), 2).when(F.col("p_type").like("%STEEL%"), 1).otherwise(0)
    w = Window.partitionBy("p_brand").orderBy(tier.desc(), F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("place", F.row_number().over(w)).filter("place <= 10").select("p_partkey", "p_brand", "place")


@query("win_referential", "SELECT c_custkey, round(least(1, log2(1 + greatest(c_acctbal, 0)) / 14), 9) AS referential FROM customer")
def win_referential(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.least(F.lit(1.0), F.log2(1 + F.greatest("c_acctbal", F.lit(0.0))) / 14), 9).alias("referential"))


@query("win_neighbors", "SELECT event_id, round(CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE (a + b) / 2 END, 9) AS between_value FROM (SELECT event_id, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def win_neighbors(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("b"), F.lead("value").over(w).alias("a"))
    return e.select("event_id", F.round(F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).otherwise((F.col("a") + F.col("b")) / 2), 9).alias("between_value"))


@query("srt_merge_top", """SELECT DISTINCT c_custkey FROM (SELECT * FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) UNION ALL SELECT * FROM (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20))""")
def srt_merge_top(spark, d):
    a = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "c_custkey").limit(20).select("c_custkey")
    return a.unionByName(b).dropDuplicates()


@query("set_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union_distinct(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("set_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def set_upsert(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


CLOSURE = f"WITH RECURSIVE p AS {PLACES}, c AS (SELECT id, id AS ancestor, 0 AS depth FROM p UNION ALL SELECT c.id, q.parent_id, c.depth + 1 FROM c JOIN p q ON q.id = c.ancestor WHERE q.parent_id > 0)"


@query("rec_closure", CLOSURE + " SELECT id, ancestor, depth FROM c")
def rec_closure(spark, d):
    return L.closure(places(spark, d), cut)


@query("rec_lineage", CLOSURE + " SELECT c.id, string_agg(p.name, ' < ' ORDER BY depth) AS lineage FROM c JOIN p ON p.id = c.ancestor WHERE depth > 0 GROUP BY 1")
def rec_lineage(spark, d):
    p = places(spark, d)
    up = L.closure(p, cut).filter("depth > 0").join(p.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    names = F.transform(F.sort_array(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"])
    return up.groupBy("id").agg(F.array_join(names, " < ").alias("lineage"))


@query("agg_placetype_census", CLOSURE + " SELECT c.ancestor, p.placetype, count(*) AS n FROM c JOIN p ON p.id = c.id WHERE depth > 0 GROUP BY 1, 2")
def agg_placetype_census(spark, d):
    p = places(spark, d)
    return L.closure(p, cut).filter("depth > 0").join(p.select("id", "placetype"), "id").groupBy("ancestor", "placetype").agg(F.count(F.lit(1)).alias("n"))


@query("join_closure_self", CLOSURE + " SELECT a.name, count(DISTINCT c.id) AS children FROM c JOIN p a ON a.id = c.ancestor JOIN p b ON b.id = c.id WHERE a.placetype = 'region' AND b.placetype = 'nation' GROUP BY 1")
def join_closure_self(spark, d):
    p = places(spark, d)
    a = p.filter("placetype = 'region'").select(F.col("id").alias("ancestor"), "name")
    b = p.filter("placetype = 'nation'").select("id")
    return L.closure(p, cut).join(a, "ancestor").join(b, "id").groupBy("name").agg(F.countDistinct("id").alias("children"))


@query("win_dfs_labels", CLOSURE + ", t AS (SELECT id, string_agg(lpad(CAST(ancestor AS VARCHAR), 9, '0'), '/' ORDER BY depth DESC) AS path FROM c GROUP BY 1), s AS (SELECT ancestor AS id, count(*) AS n FROM c GROUP BY 1) SELECT id, row_number() OVER (ORDER BY path) - 1 AS pre, row_number() OVER (ORDER BY path) - 1 + n AS post FROM t JOIN s USING (id)")
def win_dfs_labels(spark, d):
    """Pre-order by materialized path; a place's interval is as wide as its subtree."""
    c = L.closure(places(spark, d), cut)
    path = F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("depth", "ancestor")))), lambda x: F.lpad(x["ancestor"].cast("string"), 9, "0")), "/")
    t = c.groupBy("id").agg(path.alias("path"))
    n = c.groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    pre = F.row_number().over(Window.orderBy("path")).cast("long") - 1
    return t.join(n, "id").select("id", pre.alias("pre"), (pre + F.col("n")).alias("post"))
