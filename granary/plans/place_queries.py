"""Queries of clusters, number ranges, nearness, prefixes and decoding."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import geo as G
from granary.functions import text as T
from granary.operators import clusters, decode, places
from granary.operators import linkage as L
from granary.operators.lineage import cut
from granary.plans.linkage_queries import _members, _scored
from granary.plans.registry import query
from granary.plans.tables import points, sql_km, sql_points, table

C, S = sql_points("customer", "c_custkey"), sql_points("supplier", "s_suppkey")


def _clusters(spark, d):
    """Parts with their classes, the links of classes, written once, and the components of those from 5 bits on."""
    members, links = cut(_members(spark, d)), cut(_scored(spark, d).select("a", "b", "weight"))
    return members, links, cut(L.connected_classes(members, links.filter("weight >= 5"), cut))


@query("lnk_average_linkage")
def lnk_average_linkage(spark, d):
    members, links, labels = _clusters(spark, d)
    return clusters.refine_classes(members, links, labels, 5.0)


@query("lnk_cohesion")
def lnk_cohesion(spark, d):
    _, links, labels = _clusters(spark, d)  # a class is known by one of its parts, which stands for all of them
    return clusters.cohesion(labels, links, 5.0).withColumn("cohesion", F.round("cohesion", 9))


RANGES = "(SELECT p_partkey AS rid, p_partkey % 25 AS street, p_size AS low, p_size + p_partkey % 9 AS high, CASE p_partkey % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'even' ELSE 'mixed' END AS parity FROM part)"


@query("geo_tightest_range", f"""SELECT id, n, tier, width, rid, low, high FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, width, rid) AS r FROM (
 SELECT id, n, CASE WHEN parity = CASE WHEN n % 2 = 1 THEN 'odd' ELSE 'even' END THEN 0 WHEN parity = 'mixed' THEN 1 ELSE 2 END AS tier, high - low AS width, rid, low, high
 FROM (SELECT c_custkey AS id, c_custkey % 25 AS street, 1 + c_custkey % 50 AS n FROM customer) q JOIN {RANGES} USING (street) WHERE n BETWEEN low AND high)) WHERE r = 1""")
def geo_tightest_range(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).alias("street"), (1 + F.col("c_custkey") % 50).alias("n"))
    key = F.col("p_partkey")
    parity = F.when(key % 4 == 0, "odd").when(key % 4 == 1, "even").otherwise("mixed")
    ranges = table(spark, d, "part").select(key.alias("rid"), (key % 25).alias("street"), F.col("p_size").alias("low"), (F.col("p_size") + key % 9).alias("high"), parity.alias("parity"))
    return places.tightest_range(asked, ranges, "street")


@query("geo_between_neighbours", f"""WITH k AS (SELECT id % 7 AS street, id * 13 % 900 AS n, avg(lat) AS lat, avg(lon) AS lon FROM {S} GROUP BY 1, 2), q AS (SELECT id, id % 7 AS street, id * 17 % 1000 AS n FROM {C}),
 j AS (SELECT q.id, q.street, q.n, list({{'n': k.n, 'lat': k.lat, 'lon': k.lon}} ORDER BY k.n DESC) FILTER (k.n < q.n) AS lo, list({{'n': k.n, 'lat': k.lat, 'lon': k.lon}} ORDER BY k.n) FILTER (k.n > q.n) AS hi FROM q JOIN k USING (street) GROUP BY 1, 2, 3),
 e AS (SELECT id, street, n, lo IS NOT NULL AND hi IS NOT NULL AS two, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo[1] WHEN lo IS NOT NULL THEN lo[2] ELSE hi[2] END AS s, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi[1] WHEN lo IS NOT NULL THEN lo[1] ELSE hi[1] END AS x FROM j)
 SELECT id, street, n, round(s.lat + (x.lat - s.lat) * (n - s.n) / (x.n - s.n), 6) AS lat, round(s.lon + (x.lon - s.lon) * (n - s.n) / (x.n - s.n), 6) AS lon, CASE WHEN two THEN 'both' ELSE 'single' END AS bracket FROM e WHERE two OR (n - s.n) / CAST(x.n - s.n AS DOUBLE) <= 2""")
def geo_between_neighbours(spark, d):
    known = points(spark, d, "supplier", "s_suppkey").select((F.col("id") % 7).alias("street"), (F.col("id") * 13 % 900).alias("number"), "lat", "lon")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("street"), (F.col("c_custkey") * 17 % 1000).alias("n"))
    return places.between_neighbours(asked, known, "street").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("win_nearness", f"SELECT s.id, round(4 * least(1, log10(s_acctbal * s_acctbal + 1) / 6) + greatest({', '.join(f'4 * {w} / (1 + ' + sql_km('s', p) + ' / 30)' for p, w in (('x', 1), ('y', 0.5)))}), 6) AS score FROM {S} s JOIN supplier ON s_suppkey = s.id, (SELECT 40 AS lat, -100 AS lon) x, (SELECT 30 AS lat, -80 AS lon) y")
def win_nearness(spark, d):
    s = points(spark, d, "supplier", "s_suppkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal"), "id")
    size = F.log10(F.col("s_acctbal") * F.col("s_acctbal") + 1)
    return s.select("id", F.round(places.nearness(size, F.col("lat"), F.col("lon"), [(40.0, -100.0, 1.0), (30.0, -80.0, 0.5)]), 6).alias("score"))


@query("gaz_prefix_prior", """WITH c AS (SELECT prefix, c_nationkey AS region, count(*) AS n FROM (SELECT unnest([left(k, 2), left(k, 3)]) AS prefix, c_nationkey FROM (SELECT CAST(c_custkey * 7919 % 100000 + 100000 AS VARCHAR) AS k, c_nationkey FROM customer)) GROUP BY 1, 2)
 SELECT prefix, region, n, share FROM (SELECT *, n / CAST(sum(n) OVER (PARTITION BY prefix) AS DOUBLE) AS share, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, region) AS r FROM c) WHERE r = 1""")
def gaz_prefix_prior(spark, d):
    codes = table(spark, d, "customer").select((F.col("c_custkey") * 7919 % 100000 + 100000).cast("string").alias("k"), "c_nationkey")
    return places.prefix_prior(codes, "k", "c_nationkey", (2, 3))


@query("gaz_pair_index", "SELECT p_brand, p_type, count(*) AS n, CAST('0x' || substr(sha256('42' || chr(31) || p_brand || chr(31) || p_type), 1, 8) AS BIGINT) % 100 < 10 AS held_out FROM part GROUP BY 1, 2")
def gaz_pair_index(spark, d):
    return places.pair_index(table(spark, d, "part"), "p_brand", "p_type", 10)


@query("fn_fnv1a", "SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(p_name, ''), lambda x: CAST(ascii(x) AS HUGEINT))), lambda h, x: (xor(CAST(h AS UINTEGER), CAST(x AS UINTEGER)) * CAST(16777619 AS HUGEINT)) % 4294967296) % 65536 AS bucket FROM part")
def fn_fnv1a(spark, d):
    return table(spark, d, "part").select("p_partkey", (T.fnv1a(F.col("p_name")) % 65536).alias("bucket"))


@query("lnk_conjunction", "SELECT p_partkey, w || '|' || b AS key FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w, p_type FROM part), LATERAL (SELECT unnest(string_split(lower(p_type), ' ')) AS b)")
def lnk_conjunction(spark, d):
    words = lambda c: F.split(F.lower(c), " ")
    return table(spark, d, "part").select("p_partkey", F.explode(T.conjunction(words("p_name"), words("p_type"))).alias("key"))


@query("lnk_address_id", f"SELECT id, 'tx.' || CAST(floor(lat / 0.05) AS BIGINT) || ':' || CAST(floor(lon / 0.05) AS BIGINT) || '.' || substr(sha256(CAST(id AS VARCHAR)), 1, 16) AS address FROM {C}")
def lnk_address_id(spark, d):
    return points(spark, d, "customer", "c_custkey").select("id", T.address_id(F.lit("TX"), G.cell(F.col("lat"), F.col("lon"), 0.05), F.col("id").cast("string")).alias("address"))


@query("join_name_evidence", "SELECT a AS a, b AS b, CASE WHEN x = y THEN 0.9 WHEN a % 3 = b % 3 THEN 0.75 ELSE 0.5 END AS score FROM (SELECT s_suppkey AS a, upper(s_name) || CASE s_suppkey % 3 WHEN 0 THEN ' LLC' WHEN 1 THEN ', Inc.' ELSE '' END AS x, s_nationkey AS k, s_name FROM supplier) JOIN (SELECT s_suppkey AS b, s_name || CASE s_suppkey % 3 WHEN 0 THEN ' llc' WHEN 1 THEN ' inc' ELSE '' END AS y, s_name AS t FROM supplier) ON s_name = t")
def join_name_evidence(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey") % 3
    end = lambda *e: F.when(key == 0, e[0]).when(key == 1, e[1]).otherwise("")
    a = s.select(F.col("s_suppkey").alias("a"), F.concat(F.upper("s_name"), end(" LLC", ", Inc.")).alias("x")).withColumn("k", T.organization(F.col("x")))
    b = s.select(F.col("s_suppkey").alias("b"), F.concat("s_name", end(" llc", " inc")).alias("y")).withColumn("k", T.organization(F.col("y")))
    return a.join(b, "k").select("a", "b", T.name_evidence(F.col("x"), F.col("y")).alias("score"))


@query("cor_decode")
def cor_decode(spark, d):
    """Labels of the words of a name, scored by their shapes; I may only follow B or I."""
    shape = lambda w: F.array(F.length(w) / 10.0, (F.ascii(w) % 5) / 4.0, (F.length(w) % 3) / 2.0)
    rows = table(spark, d, "part").select("p_partkey", F.transform(F.split("p_name", " "), shape).alias("scores"))
    out = decode.decode(rows, "scores", ["O", "B", "I"], [[0.1, 0.2, float("-inf")], [0.0, 0.1, 0.5], [0.1, 0.1, 0.2]])
    return out.select("p_partkey", F.array_join("path", " ").alias("path"), F.round("path_score", 9).alias("score"))
