"""Calibration, evaluation boards and gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import geo as G
from granary.functions import text as T
from granary.operators import evaluation as E
from granary.operators import linkage as L
from granary.operators.lineage import cut
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, addresses, points, sql_km, sql_points, table

#: A confidence and whether it was right, for each order line, fixed by its fields.
CONF = "(SELECT l_orderkey, l_linenumber, l_returnflag AS locale, (l_extendedprice * 100 % 1000) / 1000.0 AS conf, (l_partkey * 7 + l_linenumber) % 1000 < (l_extendedprice * 100 % 1000) * 0.8 + 100 AS correct FROM lineitem)"


def _conf(spark, d):
    conf = (F.col("l_extendedprice") * 100 % 1000) / 1000.0
    right = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1000 < (F.col("l_extendedprice") * 100 % 1000) * 0.8 + 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("locale"), conf.alias("conf"), right.alias("correct"))


_BINS = f"(SELECT CAST(least(floor(conf * 15), 14) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM {CONF} WHERE conf BETWEEN 0 AND 1 GROUP BY 1)"


@query("cal_bins", f"SELECT bin, n, round(c, 9) AS conf, round(a, 9) AS acc, round(abs(c - a), 9) AS gap FROM {_BINS}")
def cal_bins(spark, d):
    b = E.calibration_bins(_conf(spark, d), "conf", "correct", 15)
    return b.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("conf", "acc", "gap")])


@query("cal_errors", f"SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - a)) / sum(n), 9) AS ece, round(max(abs(c - a)), 9) AS mce, round(coalesce(max(abs(c - a)) FILTER (WHERE n >= 20), 0), 9) AS robust_mce, (SELECT round(avg(pow(conf - CAST(correct AS INTEGER), 2)), 9) FROM {CONF} WHERE conf BETWEEN 0 AND 1) AS brier FROM {_BINS}")
def cal_errors(spark, d):
    e = E.calibration_errors(_conf(spark, d), "conf", "correct")
    return e.select("n", *[F.round(c, 9).alias(c) for c in ("ece", "mce", "robust_mce", "brier")])


@query("cal_isotonic")
def cal_isotonic(spark, d):
    """The rising fit of correctness by confidence, as knots."""
    return spark.createDataFrame(E.isotonic(_conf(spark, d).filter("conf BETWEEN 0 AND 1"), "conf", "correct", 1000), "x double, fitted double")


_KNOTS = [(0.1, 0.2), (0.4, 0.35), (0.7, 0.7), (0.95, 0.9)]
_LINE = " ".join(f"WHEN conf < {b[0]} THEN {a[1]} + (conf - {a[0]}) / ({b[0]} - {a[0]}) * ({b[1]} - {a[1]})" for a, b in zip(_KNOTS, _KNOTS[1:]))


@query("cal_apply", f"SELECT l_orderkey, l_linenumber, round(CASE WHEN conf <= 0.1 THEN 0.2 {_LINE} ELSE 0.9 END, 9) AS calibrated FROM {CONF}")
def cal_apply(spark, d):
    return _conf(spark, d).select("l_orderkey", "l_linenumber", F.round(E.interpolated(F.col("conf"), _KNOTS), 9).alias("calibrated"))


@query("cal_conformal", f"SELECT count(*) AS n, list_sort(list(conf))[CAST(ceil((count(*) + 1) * 0.9) AS BIGINT)] AS threshold FROM {CONF} WHERE correct")
def cal_conformal(spark, d):
    return E.conformal_threshold(_conf(spark, d).filter("correct"), "conf", 0.9)


@query("cal_containment", f"SELECT c_nationkey AS area, count(*) AS n, count(*) FILTER (WHERE lat BETWEEN 30 AND 45 AND lon BETWEEN -115 AND -85) AS inside FROM {sql_points('customer', 'c_custkey')} p JOIN customer ON c_custkey = p.id GROUP BY 1")
def cal_containment(spark, d):
    """How many of each area's points a polygon holds."""
    corners = [(-115.0, 30.0), (-85.0, 30.0), (-85.0, 45.0), (-115.0, 45.0)]
    ring = F.array(F.array(*[F.struct(F.lit(x - 1e-9 if x < -100 else x + 1e-9).alias("x"), F.lit(y - 1e-9 if y < 40 else y + 1e-9).alias("y")) for x, y in corners]))
    p = points(spark, d, "customer", "c_custkey").join(table(spark, d, "customer"), F.col("id") == F.col("c_custkey"))
    return p.groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"), F.count_if(G.in_rings(F.col("lon"), F.col("lat"), ring)).alias("inside"))


_TOKENS = "list_distinct(string_split(lower(p_name), ' '))"


@query("cal_truth_grains", f"""WITH p AS (SELECT p_partkey AS id, p_size AS k, {_TOKENS} AS w FROM part), m AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.k = b.k AND a.id <> b.id AND len(list_intersect(a.w, b.w)) >= 0.7 * len(list_distinct(list_concat(a.w, b.w)))),
 r AS (WITH RECURSIVE r AS (SELECT id, id AS n FROM p UNION SELECT r.id, m.b FROM r JOIN m ON r.n = m.a) SELECT id, min(n) AS truth FROM r GROUP BY 1) SELECT id, truth FROM r""")
def cal_truth_grains(spark, d):
    """Truth groups: rows of one block whose names share 0.7 of their words, and what those link to."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("k"), F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("w"))
    # Names repeat: words are compared once for each pair of different names of a block.
    names = p.groupBy("k", "w").agg(F.min("id").alias("rep"))
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.rep") < F.col("b.rep"))).filter(T.jaccard(F.col("a.w"), F.col("b.w")) >= 0.7)
    edges = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    labels = L.connected(edges, names.select(F.col("rep").alias("node")), cut)
    return p.join(names, ["k", "w"]).join(labels, F.col("rep") == F.col("node")).select("id", F.col("label").alias("truth"))


@query("evl_tags", f"""WITH x AS (SELECT country, 'street' AS tag, street AS g, CASE WHEN id % 3 = 0 THEN street WHEN id % 3 = 1 THEN locality END AS p FROM {ADDRESSES} UNION ALL SELECT country, 'locality', locality, CASE WHEN id % 2 = 0 THEN locality END FROM {ADDRESSES} UNION ALL SELECT country, 'venue', NULL, CASE WHEN id % 5 = 0 THEN 'x' END FROM {ADDRESSES} WHERE id % 5 = 0),
 c AS (SELECT country, tag, count(*) FILTER (WHERE g = p) AS tp, count(*) FILTER (WHERE p IS NOT NULL AND (g IS NULL OR g <> p)) AS fp, count(*) FILTER (WHERE g IS NOT NULL AND (p IS NULL OR g <> p)) AS fn FROM x GROUP BY 1, 2)
 SELECT country, tag, tp, fp, fn, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c""")
def evl_tags(spark, d):
    return E.tag_counts(_parsed(spark, d), "gold", "predicted", ["country"])


def _parsed(spark, d):
    a = addresses(spark, d)
    gold = F.create_map(F.lit("street"), F.col("street"), F.lit("locality"), F.col("locality"))
    street = F.when(F.col("id") % 3 == 0, F.col("street")).when(F.col("id") % 3 == 1, F.col("locality"))
    parts = F.array(F.struct(F.lit("street").alias("k"), street.alias("v")), F.struct(F.lit("locality").alias("k"), F.when(F.col("id") % 2 == 0, F.col("locality")).alias("v")), F.struct(F.lit("venue").alias("k"), F.when(F.col("id") % 5 == 0, "x").alias("v")))
    return a.select("id", "country", gold.alias("gold"), F.map_from_entries(F.filter(parts, lambda x: x["v"].isNotNull())).alias("predicted"))


_TAGS = f"""(SELECT country, tag, tp, fp, fn, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (SELECT country, tag, count(*) FILTER (WHERE g = p) AS tp, count(*) FILTER (WHERE p IS NOT NULL AND (g IS NULL OR g <> p)) AS fp, count(*) FILTER (WHERE g IS NOT NULL AND (p IS NULL OR g <> p)) AS fn FROM
 (SELECT country, 'street' AS tag, street AS g, CASE WHEN id % 3 = 0 THEN street WHEN id % 3 = 1 THEN locality END AS p FROM {ADDRESSES} UNION ALL SELECT country, 'locality', locality, CASE WHEN id % 2 = 0 THEN locality END FROM {ADDRESSES} UNION ALL SELECT country, 'venue', NULL, 'x' FROM {ADDRESSES} WHERE id % 5 = 0) GROUP BY 1, 2))"""
_OVERALL = f"(SELECT a.country, n, exact, exact / n AS exact_rate, macro_f1, micro_f1 FROM (SELECT country, count(*) AS n, count(*) FILTER (WHERE (id % 3 = 0 OR (id % 3 = 1 AND locality = street)) AND id % 2 = 0 AND id % 5 <> 0) AS exact FROM {ADDRESSES} GROUP BY 1) a JOIN (SELECT country, avg(f1) AS macro_f1, CASE WHEN sum(tp) > 0 THEN 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END AS micro_f1 FROM {_TAGS} GROUP BY 1) b USING (country))"


@query("evl_overall", f"SELECT country, n, exact, exact_rate, round(macro_f1, 9) AS macro_f1, round(micro_f1, 9) AS micro_f1 FROM {_OVERALL}")
def evl_overall(spark, d):
    o = E.overall(_parsed(spark, d), "gold", "predicted", ["country"])
    return o.withColumns({c: F.round(c, 9) for c in ("macro_f1", "micro_f1")})


@query("evl_spread", f"SELECT round(max(micro_f1) - min(micro_f1), 9) AS spread, arg_min(country, (micro_f1, country)) AS lowest FROM {_OVERALL}")
def evl_spread(spark, d):
    o = E.overall(_parsed(spark, d), "gold", "predicted", ["country"])
    return o.agg(F.round(F.max("micro_f1") - F.min("micro_f1"), 9).alias("spread"), F.min(F.struct("micro_f1", "country"))["country"].alias("lowest"))


_HIT = f"(SELECT c.id, c_nationkey AS state, {sql_km('c', 's')} AS km FROM {sql_points('customer', 'c_custkey')} c JOIN customer ON c_custkey = c.id LEFT JOIN {sql_points('supplier', 's_suppkey')} s ON s.id = c.id % 120)"


@query("evl_resolver", f"""WITH h AS {_HIT}, q AS (SELECT state, list_sort(list(round(km, 6))) AS k FROM h WHERE km IS NOT NULL GROUP BY 1)
 SELECT h.state, count(*) AS n, count(km) AS resolved, count(*) FILTER (WHERE km <= 1000) AS matches, any_value(k[CAST(least(len(k) - 1, floor(0.5 * len(k))) AS BIGINT) + 1]) AS p50, any_value(k[CAST(least(len(k) - 1, floor(0.9 * len(k))) AS BIGINT) + 1]) AS p90, any_value(k[CAST(least(len(k) - 1, floor(0.99 * len(k))) AS BIGINT) + 1]) AS p99 FROM h LEFT JOIN q USING (state) GROUP BY 1""")
def evl_resolver(spark, d):
    """Per state: how many resolved, how many near enough, and percentiles of the distance, by position."""
    c = points(spark, d, "customer", "c_custkey").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("state")), F.col("id") == F.col("c_custkey"))
    s = points(spark, d, "supplier", "s_suppkey").select(F.col("id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    h = c.join(s, F.col("id") % 120 == F.col("sid"), "left").withColumn("km", G.haversine(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")))
    counts = h.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("km").alias("resolved"), F.count_if(F.col("km") <= 1000).alias("matches"))
    # Positions by counts of equal distances: a state's rows need not meet.
    from pyspark.sql import Window

    each = h.filter("km IS NOT NULL").groupBy("state", F.round("km", 6).alias("km")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("state").orderBy("km"))
    total = F.sum("c").over(Window.partitionBy("state"))
    at = each.withColumns({"_upto": upto, "_all": total})
    least = lambda q: F.min(F.when(F.col("_upto") > F.least(F.col("_all") - 1, F.floor(q * F.col("_all"))), F.col("km")))
    q = at.groupBy(F.col("state").alias("_s")).agg(least(0.5).alias("p50"), least(0.9).alias("p90"), least(0.99).alias("p99"))
    return counts.join(q, F.col("state") == F.col("_s"), "left").drop("_s")


@query("evl_trends", "WITH m AS (SELECT year(o_orderdate) AS run, o_orderstatus AS series, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2) SELECT run, series, round(score, 6) AS score, round(score - lag(score) OVER (PARTITION BY series ORDER BY run), 6) AS change FROM m")
def evl_trends(spark, d):
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("run"), F.col("o_orderstatus").alias("series")).agg(F.avg("o_totalprice").alias("score"))
    return E.trends(m, "run", ["series"], "score").select("run", "series", F.round("score", 6).alias("score"), F.round("change", 6).alias("change"))


@query("evl_invariance", f"SELECT unnest(['lower', 'spaces', 'cut']) AS variant, count(*) AS n, unnest([count(*), count(*), count(*) FILTER (WHERE substring(raw, 1, len(raw) - 5) LIKE '%' || postcode)]) AS same, unnest([1.0, 1.0, count(*) FILTER (WHERE substring(raw, 1, len(raw) - 5) LIKE '%' || postcode) / count(*)]) AS rate FROM {ADDRESSES}")
def evl_invariance(spark, d):
    """Whether the postcode that is read from a text stays when the text changes in ways that should not matter, or should."""
    rows = addresses(spark, d).select(F.col("raw").alias("text"))
    text = F.col("text")
    variants = {"lower": F.lower(text), "spaces": F.replace(text, F.lit(" "), F.lit("  ")), "cut": F.substring(text, F.lit(1), F.length(text) - 5)}
    return E.invariance(rows, variants, lambda c: F.nullif(F.regexp_extract(c, "([0-9]{5})$", 1), F.lit("")))


@query("evl_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY 1")
def evl_latency(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"))
    return e.select("event_type", *[F.round(F.get("q", F.lit(i)), 9).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


_RUN = "(SELECT o_orderpriority AS board, round(avg(o_totalprice), 6) AS score FROM orders WHERE year(o_orderdate) = {0} GROUP BY 1)"


@query("evl_gate", f"SELECT coalesce(a.board, b.board) AS board, b.score AS was, a.score AS now, CASE WHEN a.score IS NULL THEN 'missing' WHEN b.score IS NULL THEN 'new' WHEN a.score < b.score - 1000 THEN 'regressed' ELSE 'pass' END AS verdict FROM {_RUN.format(1997)} a FULL JOIN (SELECT * FROM {_RUN.format(1996)} WHERE board <> '5-LOW') b ON a.board = b.board")
def evl_gate(spark, d):
    run = lambda y: table(spark, d, "orders").filter(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("board")).agg(F.round(F.avg("o_totalprice"), 6).alias("score"))
    return E.gate(run(1997), run(1996).filter("board <> '5-LOW'"), ["board"], "score", 1000.0)


@query("evl_oracle", "WITH f AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS f FROM lineitem GROUP BY 1) SELECT k, count(*) AS queries, count(*) FILTER (WHERE f <= k) AS hits, count(*) FILTER (WHERE f <= k) / count(*) AS rate FROM f, (SELECT unnest([1, 3, 5]) AS k) GROUP BY 1")
def evl_oracle(spark, d):
    l = table(spark, d, "lineitem").withColumn("right", F.col("l_returnflag") == "R")
    return E.oracle_at(l, "l_orderkey", "l_linenumber", "right", (1, 3, 5))


@query("evl_rand_index", """WITH x AS (SELECT c_nationkey AS t, c_custkey % 25 AS f FROM customer), c AS (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT count(*) AS n FROM x GROUP BY t, f)), a AS (SELECT sum(n * (n - 1) / 2.0) AS a, sum(n) AS r FROM (SELECT count(*) AS n FROM x GROUP BY t)),
 d AS (SELECT sum(n * (n - 1) / 2.0) AS d FROM (SELECT count(*) AS n FROM x GROUP BY f)) SELECT round((c.b - a * d / (r * (r - 1) / 2.0)) / ((a + d) / 2 - a * d / (r * (r - 1) / 2.0)), 9) AS ari FROM c, a, d""")
def evl_rand_index(spark, d):
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("t"), (F.col("c_custkey") % 25).alias("f"))
    return E.adjusted_rand(x, "t", "f").select(F.round("ari", 9).alias("ari"))


@query("evl_errors", f"SELECT country, kind, count(*) AS n FROM (SELECT country, CASE WHEN id % 3 = 0 THEN 'right' WHEN id % 3 = 1 AND locality <> street THEN 'wrong' WHEN id % 3 = 1 THEN 'right' ELSE 'missed' END AS kind FROM {ADDRESSES}) GROUP BY 1, 2")
def evl_errors(spark, d):
    """What happened to the street of each address: right, wrong or missed."""
    g, p = F.element_at("gold", F.lit("street")), F.element_at("predicted", F.lit("street"))
    kind = F.when(p.isNull(), "missed").when(g == p, "right").otherwise("wrong")
    return _parsed(spark, d).groupBy("country", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_COLLIDE = "len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE)"


@query("agg_collision_census", f"""WITH p AS (SELECT p_partkey AS id, p_size || p_brand AS k, {_TOKENS} AS w FROM part), x AS (SELECT {_COLLIDE} AS j FROM p a JOIN p b ON a.k = b.k AND a.id < b.id)
 SELECT CASE WHEN j >= 0.7 THEN 'collision' WHEN j >= 0.3 THEN 'partial' ELSE 'separable' END AS band, count(*) AS pairs FROM x GROUP BY 1""")
def agg_collision_census(spark, d):
    """Pairs of one block by how far their names agree. Rows of equal names are counted, not paired."""
    p = table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.col("p_brand")).alias("k"), F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("w"))
    n = p.groupBy("k", "w").agg(F.count(F.lit(1)).alias("n"))
    own = n.filter("n > 1").select(F.lit("collision").alias("band"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    a, b = n.alias("a"), n.alias("b")
    j = T.jaccard(F.col("a.w"), F.col("b.w"))
    other = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.w") < F.col("b.w"))).select(F.when(j >= 0.7, "collision").when(j >= 0.3, "partial").otherwise("separable").alias("band"), (F.col("a.n") * F.col("b.n")).alias("pairs"))
    return own.unionByName(other).groupBy("band").agg(F.sum("pairs").alias("pairs"))


@query("cal_mixture", "WITH x AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS w, event_type AS s FROM events), t AS (SELECT w, count(*) AS a FROM x GROUP BY 1), q AS (SELECT unnest(['click', 'view', 'error', 'rare']) AS s, unnest([0.4, 0.3, 0.2, 0.1]) AS r) SELECT t.w AS \"window\", q.s AS source, count(x.s) AS n, count(x.s) / a AS share, r AS requested, count(x.s) / a - r AS deviation FROM t CROSS JOIN q LEFT JOIN x ON x.w = t.w AND x.s = q.s GROUP BY t.w, q.s, a, r")
def cal_mixture(spark, d):
    """Shares of draws in windows against those asked for."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).alias("window"), F.col("event_type").alias("source"))
    return E.share_of_draws(e, "source", "window", {"click": 0.4, "view": 0.3, "error": 0.2, "rare": 0.1})
