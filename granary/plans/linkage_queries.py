"""Record linkage and gazetteer queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import linkage as L
from granary.operators.lineage import cut
from granary.plans.registry import query
from granary.plans.tables import table

WORDS = "string_split(lower(p_name), ' ')"
PAIRS = f"""WITH e AS (SELECT DISTINCT p_partkey AS id, unnest({WORDS}) || p_size AS k FROM part), f AS (SELECT k FROM e GROUP BY 1 HAVING count(*) >= 2),
 p AS (SELECT DISTINCT a.id AS lo, b.id AS hi FROM e a JOIN e b ON a.k = b.k AND a.id < b.id WHERE a.k IN (SELECT k FROM f))"""
JACCARD = "len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE)"


def _keys():
    return F.transform(F.split(F.lower("p_name"), " "), lambda w: F.concat(w, F.col("p_size").cast("string")))


def _pairs(spark, d):
    """All pairs that share a word and a size."""
    return L.blocking_pairs(table(spark, d, "part"), _keys(), "p_partkey")


#: What the scores of a pair are read from: parts that agree in these and in their keys are one class.
FIELDS = ("w", "p_brand")


def _parts(spark, d):
    return table(spark, d, "part").withColumn("w", F.split(F.lower("p_name"), " "))


def _said():
    """Levels and weight of a pair of classes or slices."""
    name = L.level(T.jaccard(F.col("aw"), F.col("bw")), [0.99, 0.4])
    brand = F.when(F.col("ap_brand") == F.col("bp_brand"), 0).otherwise(1)
    total = L.weight(F.col("name_level"), [0.6, 0.3, 0.1], [0.01, 0.09, 0.9]) + L.weight(F.col("brand_level"), [0.9, 0.1], [0.04, 0.96])
    return {"name_level": name, "brand_level": brand}, {"weight": total}


def _scored(spark, d):
    """a, b, levels, weight and n of every pair of classes: n pairs of parts have them."""
    levels, total = _said()
    return L.class_pairs(L.classes(_parts(spark, d), _keys(), "p_partkey", FIELDS)).withColumns(levels).withColumns(total).select(F.col("a_at").alias("a"), F.col("b_at").alias("b"), *levels, *total, "n")


def _members(spark, d):
    return L.class_of(_parts(spark, d), _keys(), "p_partkey", FIELDS)


LEVELS = f"""x AS (SELECT lo, hi, CASE WHEN j >= 0.99 THEN 0 WHEN j >= 0.4 THEN 1 ELSE 2 END AS name_level, brand_level FROM (SELECT lo, hi, {JACCARD.format('wa', 'wb')} AS j, CASE WHEN ba = bb THEN 0 ELSE 1 END AS brand_level
 FROM (SELECT lo, hi, string_split(lower(a.p_name), ' ') AS wa, string_split(lower(b.p_name), ' ') AS wb, a.p_brand AS ba, b.p_brand AS bb FROM p JOIN part a ON a.p_partkey = lo JOIN part b ON b.p_partkey = hi))),
 w AS (SELECT *, CASE name_level WHEN 0 THEN log2(0.6 / 0.01) WHEN 1 THEN log2(0.3 / 0.09) ELSE log2(0.1 / 0.9) END + CASE brand_level WHEN 0 THEN log2(0.9 / 0.04) ELSE log2(0.1 / 0.96) END AS weight FROM x)"""
PROBABILITY = "1 / (1 + pow(2.0, -(weight + log2(0.001 / 0.999))))"


@query("lnk_blocking", PAIRS + " SELECT lo, hi FROM p")
def lnk_blocking(spark, d):
    return _pairs(spark, d)


@query("lnk_dropped_keys", f"SELECT k AS key, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest({WORDS}) || p_size AS k FROM part) GROUP BY 1 HAVING count(*) > 8")
def lnk_dropped_keys(spark, d):
    """The keys of lnk_blocking whose blocks a cap of 8 rows would drop."""
    return L.dropped_keys(table(spark, d, "part"), _keys(), 8)


@query("lnk_score_pairs", PAIRS + ", " + LEVELS + f" SELECT lo, hi, name_level, brand_level, round(weight, 9) AS weight, CASE WHEN {PROBABILITY} >= 0.5 THEN 'match' WHEN {PROBABILITY} <= 0.001 THEN 'non-match' ELSE 'review' END AS decision FROM w")
def lnk_score_pairs(spark, d):
    levels, total = _said()
    met = L.meetings(L.slices(_parts(spark, d), _keys(), "p_partkey", FIELDS)).withColumns(levels).withColumns(total)
    decision = L.decide(L.probability(F.col("weight"), 0.001), 0.001, 0.5)
    return L.each_pair(met, {"name_level": F.col("name_level"), "brand_level": F.col("brand_level"), "weight": F.round("weight", 9), "decision": decision})


@query("lnk_patterns", PAIRS + ", " + LEVELS + " SELECT name_level, brand_level, count(*) AS n FROM w GROUP BY 1, 2")
def lnk_patterns(spark, d):
    return _scored(spark, d).groupBy("name_level", "brand_level").agg(F.sum("n").alias("n"))


@query("lnk_resolve", PAIRS + ", " + LEVELS + """, m AS MATERIALIZED (SELECT lo AS a, hi AS b FROM w WHERE weight >= 5 UNION SELECT hi, lo FROM w WHERE weight >= 5),
 r AS (WITH RECURSIVE r AS (SELECT p_partkey AS id, p_partkey AS n FROM part UNION SELECT r.id, m.b FROM r JOIN m ON r.n = m.a) SELECT id, min(n) AS entity FROM r GROUP BY 1) SELECT id, entity, count(*) OVER (PARTITION BY entity) AS members FROM r""")
def lnk_resolve(spark, d):
    edges = cut(_scored(spark, d).filter("weight >= 5").select("a", "b"))
    out = L.connected_classes(_members(spark, d), edges, cut)
    size = out.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("members"))
    return out.join(size, F.col("label") == F.col("_l")).select(F.col("node").alias("id"), F.col("label").alias("entity"), "members")


@query("lnk_representative", "SELECT p_brand, arg_max(p_partkey, (CAST(p_size > 25 AS INTEGER) + CAST(p_retailprice > 1000 AS INTEGER), -p_partkey)) AS representative FROM part GROUP BY 1")
def lnk_representative(spark, d):
    filled = (F.col("p_size") > 25).cast("int") + (F.col("p_retailprice") > 1000).cast("int")
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(filled, -F.col("p_partkey"))).alias("representative"))


@query("lnk_organization", "SELECT s_suppkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(s_name || ' Inc, LLC'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('inc', 'llc')), ' ') AS canonical FROM supplier")
def lnk_organization(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.organization(F.concat("s_name", F.lit(" Inc, LLC"))).alias("canonical"))


@query("lnk_frequency_key", "SELECT p_partkey, trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', ' ', 'g')) AS key FROM part")
def lnk_frequency_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.frequency_key(F.col("p_type")).alias("key"))


@query("lnk_term_frequency", """WITH t AS (SELECT p_brand, count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) AS f FROM part GROUP BY 1) SELECT p_partkey, round(0.5 * log2(0.04 / greatest(f, 0.0001)), 9) AS adjustment FROM part JOIN t USING (p_brand)""")
def lnk_term_frequency(spark, d):
    p = table(spark, d, "part")
    n = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    f = n.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return p.join(f, "p_brand").select("p_partkey", F.round(0.5 * F.log2(0.04 / F.greatest("f", F.lit(0.0001))), 9).alias("adjustment"))


@query("lnk_levenshtein", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - levenshtein(a.n_name, b.n_name) / CAST(greatest(length(a.n_name), length(b.n_name)) AS DOUBLE), 9) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def lnk_levenshtein(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return j.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(T.levenshtein_similarity(F.col("a.n_name"), F.col("b.n_name")), 9).alias("similarity"))


@query("gaz_alias_explode", "SELECT DISTINCT p_partkey, k FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS k, lower(p_name) AS primary_key FROM part) WHERE k <> primary_key")
def gaz_alias_explode(spark, d):
    keys = F.array_distinct(F.split(F.lower("p_name"), " "))
    return table(spark, d, "part").select("p_partkey", F.explode(F.filter(keys, lambda k: k != F.lower("p_name"))).alias("k"))


@query("gaz_prefix_top", "SELECT p_partkey, pre, CAST(r AS INTEGER) AS r FROM (SELECT p_partkey, substr(p_name, 1, 3) AS pre, row_number() OVER (PARTITION BY substr(p_name, 1, 3) ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def gaz_prefix_top(spark, d):
    w = Window.partitionBy("pre").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("pre", F.substring("p_name", 1, 3)).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_partkey", "pre", "r")


@query("gaz_trigram_jaccard", """WITH g AS (SELECT n_nationkey AS id, list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS t FROM (SELECT n_nationkey, '  ' || lower(n_name) || ' ' AS p FROM nation)), e AS (SELECT id, unnest(t) AS x FROM g)
 SELECT a.id AS a, b.id AS b, round(count(*) / CAST(any_value(len(ga.t)) + any_value(len(gb.t)) - count(*) AS DOUBLE), 9) AS similarity FROM e a JOIN e b ON a.x = b.x AND a.id < b.id JOIN g ga ON ga.id = a.id JOIN g gb ON gb.id = b.id GROUP BY 1, 2""")
def gaz_trigram_jaccard(spark, d):
    """Shared trigrams by an inverted index: only names with one in common meet."""
    g = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), T.trigrams(F.col("n_name")).alias("t")).withColumn("n", F.size("t"))
    e = g.select("id", "n", F.explode("t").alias("x"))
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.id") < F.col("b.id")))
    s = j.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("k"))
    return s.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 9).alias("similarity"))


@query("gaz_bm25", """WITH t AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS w FROM part), f AS (SELECT id, w, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
 a AS (SELECT avg(n) AS m, count(*) AS docs FROM l), q AS (SELECT w, count(*) AS df FROM f GROUP BY 1)
 SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))), 6) AS score FROM f JOIN l USING (id) JOIN q USING (w), a WHERE w IN ('red', 'blue') GROUP BY 1""")
def gaz_bm25(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("ws"))
    f = t.select("id", F.size("ws").alias("n"), F.explode("ws").alias("w")).filter(F.col("w").isin("red", "blue")).groupBy("id", "n", "w").agg(F.count(F.lit(1)).alias("tf"))
    q = f.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    a = t.agg(F.avg(F.size("ws")).alias("m"), F.count(F.lit(1)).alias("docs"))
    one = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("m")))
    return f.join(q, "w").join(F.broadcast(a)).groupBy("id").agg(F.round(F.sum(one), 6).alias("score"))  # a is one row
