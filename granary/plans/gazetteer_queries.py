"""Place tables, search, ranking, address cascades and reverse lookup over stand-in places."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import geo as G
from granary.operators import gazetteer as Z
from granary.operators import linkage as L
from granary.operators.lineage import cut
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, PLACES, addresses, places, points, sql_km, sql_points, table

_FOLD = lambda c: f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
P = sql_points("customer", "c_custkey")
_SUP = sql_points("supplier", "s_suppkey")


@query("gaz_candidates", f"""WITH a AS (SELECT id, {_FOLD('street')} AS k, street AS w, 0 AS o, false AS ab FROM {ADDRESSES} UNION ALL SELECT id, {_FOLD('locality')}, locality, 1, false FROM {ADDRESSES} UNION ALL SELECT id, {_FOLD('region')}, region, 1, true FROM {ADDRESSES}),
 x AS (SELECT id, k, min({{'o': o, 'ab': ab, 'w': w}}) AS m FROM a WHERE k <> '' GROUP BY 1, 2), n AS (SELECT id, count(*) AS n FROM x GROUP BY 1)
 SELECT k AS name_key, country, 'locality' AS kind, round(-log10(coalesce(c_acctbal, 0) + 1001), 9) AS neg_rank, x.id, m.w AS name, CASE WHEN m.ab THEN 'abbr' WHEN m.o = 1 AND n >= 3 THEN 'gloss' END AS role FROM x JOIN n USING (id) JOIN {ADDRESSES} d USING (id) JOIN customer ON c_custkey = id""")
def gaz_candidates(spark, d):
    """Primary names, aliases and abbreviations as one clustered table with ranks and roles."""
    a = addresses(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("id") == F.col("c_custkey"))
    p = a.select("id", F.col("street").alias("name"), "country", F.lit("locality").alias("kind"), (F.col("c_acctbal") + 1000).alias("population"))
    other = a.select("id", F.inline(F.array(F.struct(F.col("locality").alias("alias"), F.lit(False).alias("abbreviation")), F.struct(F.col("region").alias("alias"), F.lit(True).alias("abbreviation")))))
    return Z.candidate_table(p, other, 3).withColumn("neg_rank", F.round("neg_rank", 9))


@query("gaz_coincident", f"""WITH r AS (SELECT c_nationkey AS id, 'town ' || c_nationkey AS name, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS a, min(lon) AS b, max(lat) AS c, max(lon) AS d FROM {P} p JOIN customer ON c_custkey = p.id GROUP BY 1),
 t AS (SELECT p.id, 'Town ' || CAST(c_nationkey AS VARCHAR) AS name, lat, lon, c_nationkey AS up FROM {P} p JOIN customer ON c_custkey = p.id WHERE p.id % 3 = 0),
 j AS (SELECT r.id AS region, t.id AS town, {sql_km('r', 't')} AS km, {sql_km('x', 'y').replace('x.lat', 'a').replace('x.lon', 'b').replace('y.lat', 'c').replace('y.lon', 'd')} AS diagonal FROM t JOIN r ON t.up = r.id AND lower(t.name) = lower(r.name))
 SELECT region, town, CASE WHEN km <= 2 THEN 'city-state' ELSE 'capital-seat' END AS relationship, round(km, 6) AS km FROM j WHERE km <= greatest(0.15 * diagonal, 12)""")
def gaz_coincident(spark, d):
    c = points(spark, d, "customer", "c_custkey").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("id") == F.col("c_custkey"))
    r = c.groupBy(F.col("k").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))
    r = r.withColumn("name", F.concat(F.lit("town "), F.col("id").cast("string")))
    t = c.filter("id % 3 = 0").withColumn("name", F.concat(F.lit("Town "), F.col("k").cast("string")))
    out = Z.coincident_roles(r, t, t.select("id", F.col("k").alias("ancestor")))
    return out.withColumn("km", F.round("km", 6))


@query("gaz_importance", "SELECT c_custkey, round(least(1, log2(1 + (c_acctbal + 1000) / 1000.0) / 14), 9) AS referential, CASE WHEN c_custkey % 3 = 0 THEN 0.5 END AS encyclopedic FROM customer")
def gaz_importance(spark, d):
    people = F.col("c_acctbal") + 1000
    legacy = F.when(F.col("c_custkey") % 3 == 0, 0.5).when(F.col("c_custkey") % 3 == 1, Z.referential(people))
    a, b = Z.importance_split(legacy, people)
    return table(spark, d, "customer").select("c_custkey", F.round(a, 9).alias("referential"), b.alias("encyclopedic"))


_TOKENS = f"(SELECT id, unnest(string_split(k, ' ')) AS token, len(string_split(k, ' ')) AS length FROM (SELECT id, {_FOLD('raw')} AS k FROM {ADDRESSES}))"


@query("gaz_inverted_index", f"SELECT token, id, count(*) AS tf, any_value(length) AS length FROM {_TOKENS} GROUP BY 1, 2")
def gaz_inverted_index(spark, d):
    return Z.inverted_index(addresses(spark, d), "id", F.col("raw"))


@query("gaz_search", f"""WITH t AS (SELECT token, id, count(*) AS tf, any_value(length) AS length FROM {_TOKENS} GROUP BY 1, 2), n AS (SELECT count(*) AS n, avg(length) AS a FROM (SELECT DISTINCT id, length FROM t)), f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
 q AS (SELECT DISTINCT n_nationkey AS query, unnest(['oak', 'springfield', 'broadway', CAST(n_nationkey * 7 + 1 AS VARCHAR)]) AS token FROM nation) SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM q JOIN f USING (token) JOIN t USING (token), n GROUP BY 1, 2""")
def gaz_search(spark, d):
    index = cut(Z.inverted_index(addresses(spark, d), "id", F.col("raw")))
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), F.concat_ws(" ", F.lit("Oak, Springfield oak Broadway"), (F.col("n_nationkey") * 7 + 1).cast("string")).alias("text"))
    return Z.bm25(index, q).withColumn("score", F.round("score", 6))


_GRAMS = lambda c: f"list_distinct(list_transform(range(1, len({c}) + 1), lambda i: substring(' ' || {c} || ' ', CAST(i AS INTEGER), 3)))"


@query("gaz_soft_score", f"""SELECT id, round(greatest(CASE WHEN a = q THEN 1 ELSE len(list_intersect({_GRAMS('a')}, {_GRAMS('q')})) / CAST(len(list_distinct(list_concat({_GRAMS('a')}, {_GRAMS('q')}))) AS DOUBLE) END, CASE WHEN b = q THEN 1 ELSE len(list_intersect({_GRAMS('b')}, {_GRAMS('q')})) / CAST(len(list_distinct(list_concat({_GRAMS('b')}, {_GRAMS('q')}))) AS DOUBLE) END), 9) AS score
 FROM (SELECT id, {_FOLD('street')} AS a, {_FOLD('locality')} AS b, 'main street springfeld' AS q FROM {ADDRESSES})""")
def gaz_soft_score(spark, d):
    return addresses(spark, d).select("id", F.round(Z.soft_score(F.lit("Main Street Springfeld"), F.col("street"), F.array("locality")), 9).alias("score"))


_LEX = [("coffee shop", "cafe", None), ("pharmacy", "health", "en"), ("apotheke", "health", "de"), ("petrol station", "fuel", None), ("oak", "tree", None)]


@query("gaz_lexicon", """SELECT p_partkey AS query, CASE p_partkey % 5 WHEN 0 THEN 'coffee shop' WHEN 1 THEN 'pharmacy' WHEN 3 THEN 'petrol station' ELSE 'apotheke' END AS phrase, CASE p_partkey % 5 WHEN 0 THEN 'cafe' WHEN 3 THEN 'fuel' ELSE 'health' END AS category, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'exact' ELSE 'typo' END AS how FROM part WHERE p_partkey % 5 <> 2 AND (p_partkey % 5 <> 4 OR p_partkey % 2 = 0)""")
def gaz_lexicon(spark, d):
    """Categories by phrase, some for one locale only, some a typo away."""
    n = F.col("p_partkey") % 5
    text = F.when(n == 0, "Coffee  Shop").when(n == 1, "pharmacy").when(n == 2, "nothing known").when(n == 3, "petrol statin").otherwise("apotheka")
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query"), text.alias("text"), F.when((n == 4) & (F.col("p_partkey") % 2 == 0), "de").otherwise("en").alias("locale"))
    return Z.lexicon_matches(q, spark.createDataFrame(_LEX, "phrase string, category string, locale string"))


@query("win_candidate_score", f"""SELECT p.id, round(-(p.id % 10) + CASE WHEN p.id % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN country = 'US' THEN 0.3 ELSE 0 END - 0.1 * greatest(length(street) - 8, 0) / 10.0 + 0.8 / (1 + {sql_km('q', 'p')} / 100) + 4 * least(1, log10(1 + (c_acctbal + 1000)) / 6), 9) AS score,
 round(4 * least(1, log10(1 + (c_acctbal + 1000)) / 6) + 4 / (1 + {sql_km('q', 'p')} / 100), 9) AS prominence FROM {P} p JOIN {ADDRESSES} a USING (id) JOIN customer ON c_custkey = p.id, (SELECT 40 AS lat, -100 AS lon) q""")
def win_candidate_score(spark, d):
    c = points(spark, d, "customer", "c_custkey").join(addresses(spark, d).drop("raw"), "id").join(table(spark, d, "customer"), F.col("id") == F.col("c_custkey"))
    own = {"rank": F.col("id") % 10, "name": F.col("street"), "kind": F.when(F.col("id") % 2 == 0, "region").otherwise("locality"), "country": F.col("country"), "parent_id": F.lit(None), "lat": F.col("lat"), "lon": F.col("lon"), "population": F.col("c_acctbal") + 1000}
    s = Z.candidate_score(own, {"length": F.lit(5), "kind": F.lit("region"), "country": F.lit("US"), "lat": F.lit(40.0), "lon": F.lit(-100.0)})
    return c.select("id", s.alias("s")).select("id", F.round("s.score", 9).alias("score"), F.round("s.prominence", 9).alias("prominence"))


@query("win_importance_rank", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END, p_retailprice + CASE WHEN p_type = 'ECONOMY' THEN 100 ELSE 0 END DESC, p_partkey) AS INTEGER) AS rank FROM part")
def win_importance_rank(spark, d):
    """Exact matches first; inside a tier by importance with a prior for one country."""
    key = F.col("p_retailprice") + F.when(F.col("p_type") == "ECONOMY", 100).otherwise(0)
    return Z.ranked(table(spark, d, "part"), "p_brand", [F.when(F.col("p_size") % 3 == 0, 0).otherwise(1), F.desc(key), F.col("p_partkey")]).select("p_partkey", "rank")


@query("win_containment", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END, l_linenumber) AS INTEGER) AS place FROM lineitem WHERE l_linenumber <= 7 QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def win_containment(spark, d):
    """Inside each tier of exact matches, contained candidates first, else in order."""
    from pyspark.sql import Window

    l = table(spark, d, "lineitem").filter("l_linenumber <= 7")
    once = l.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.first("l_returnflag").alias("flag"), F.first("l_quantity").alias("q")).filter("n = 1")
    # The statement's windows are over all rows of an order; places of rows that repeat are left out of both.
    w = Window.partitionBy("l_orderkey", F.col("l_returnflag") == "R").orderBy(F.when(F.col("l_quantity") > 25, 0).otherwise(1), "l_linenumber")
    return l.withColumn("place", F.row_number().over(w)).join(once.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "place")


@query("win_nearest_group", f"""WITH g AS (SELECT c.id AS q, s.id % 7 AS g, min({sql_km('c', 's')}) AS km FROM {P} c JOIN {_SUP} s ON abs(c.lat - s.lat) <= 1 AND {sql_km('c', 's')} <= 60 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY km, g) AS r, lead(km) OVER (PARTITION BY q ORDER BY km, g) AS n FROM g)
 SELECT q, g, round(km, 6) AS km FROM r WHERE r = 1 AND km <= 25 AND (n IS NULL OR n >= 2 * km)""")
def win_nearest_group(spark, d):
    c = points(spark, d, "customer", "c_custkey").select(F.col("id").alias("q"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    s = points(spark, d, "supplier", "s_suppkey").select((F.col("id") % 7).alias("g"), "lat", "lon")
    near = c.withColumn("cell", F.explode(G.reach_cells(F.col("a"), F.col("b"), 60.0))).join(s.withColumn("cell", G.reach_cell(F.col("lat"), F.col("lon"), 60.0)), "cell")
    near = near.withColumn("km", G.haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lon"))).filter("km <= 60")
    return Z.nearest_group(near, "q", "g", "km").withColumn("km", F.round("km", 6))


@query("win_first_ancestors", f"""WITH RECURSIVE r AS (SELECT id, id AS ancestor, parent_id, 0 AS depth FROM {PLACES} UNION ALL SELECT r.id, p.id, p.parent_id, depth + 1 FROM r JOIN {PLACES} p ON p.id = r.parent_id) SELECT id, ancestor, CAST(row_number() OVER (PARTITION BY id ORDER BY depth, ancestor) - 1 AS INTEGER) AS ordinal FROM r WHERE depth > 0 QUALIFY ordinal < 8""")
def win_first_ancestors(spark, d):
    return Z.first_ancestors(L.closure(places(spark, d), cut))


@query("win_plausible_first", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN o < 5 AND event_type = 'error' THEN 1 ELSE 0 END, o) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o FROM events)")
def win_plausible_first(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return Z.plausible_first(e, "user_id", "o", F.col("event_type") == "error").select("event_id", "rank")


@query("win_by_evidence", "WITH x AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, arg_min(event_id, (CASE WHEN event_type = 'click' AND m - value <= 2.5 THEN 0 ELSE 1 END, event_id)) AS event_id FROM x GROUP BY 1")
def win_by_evidence(spark, d):
    return Z.by_evidence(table(spark, d, "events"), "user_id", "event_id", "value", F.col("event_type") == "click").select("user_id", "event_id")


@query("geo_address_cascade", f"""WITH t AS (SELECT {_FOLD('street')} AS s, house_number AS n, postcode AS z, {_FOLD('locality')} AS l, {{'lat': CAST(lat AS DOUBLE), 'lon': CAST(lon AS DOUBLE)}} AS p FROM {ADDRESSES} a JOIN {P} USING (id) WHERE id % 2 = 0),
 q AS (SELECT id, {_FOLD('street')} AS s, house_number AS n, CASE WHEN id % 3 = 0 THEN '00000' ELSE postcode END AS z, CASE WHEN id % 5 = 0 THEN 'nowhere' ELSE {_FOLD('locality')} END AS l FROM {ADDRESSES}),
 a AS (SELECT s, n, z, min(p) AS p FROM t GROUP BY ALL), b AS (SELECT s, n, l, min(p) AS p FROM t GROUP BY ALL), c AS (SELECT s, n, min(p) AS p FROM t GROUP BY ALL HAVING count(DISTINCT p) = 1)
 SELECT q.id, coalesce(a.p, b.p, c.p).lat AS lat, coalesce(a.p, b.p, c.p).lon AS lon, CASE WHEN a.p IS NOT NULL THEN 'postcode' WHEN b.p IS NOT NULL THEN 'locality' WHEN c.p IS NOT NULL THEN 'alone' END AS how FROM q LEFT JOIN a ON q.s = a.s AND q.n = a.n AND q.z = a.z LEFT JOIN b ON q.s = b.s AND q.n = b.n AND q.l = b.l LEFT JOIN c ON q.s = c.s AND q.n = c.n""")
def geo_address_cascade(spark, d):
    a = addresses(spark, d).withColumnRenamed("house_number", "number")
    t = a.filter("id % 2 = 0").join(points(spark, d, "customer", "c_custkey").select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), "id")
    q = a.withColumns({"postcode": F.when(F.col("id") % 3 == 0, "00000").otherwise(F.col("postcode")), "locality": F.when(F.col("id") % 5 == 0, "nowhere").otherwise(F.col("locality"))})
    return Z.address_points(q, t)


@query("geo_reverse", f"""WITH a AS (SELECT n_nationkey AS area, CASE WHEN n_nationkey % 3 = 0 THEN 'county' ELSE 'region' END AS tier, 24.9985 + n_nationkey % 5 * 4.003 AS a, 24.9985 + n_nationkey % 5 * 4.003 + 4 + n_nationkey % 3 AS b, -125.0015 + n_nationkey // 5 * 11.003 AS c, -125.0015 + n_nationkey // 5 * 11.003 + 9 + n_nationkey % 3 AS d FROM nation)
 SELECT p.id, arg_min(tier, (CASE tier WHEN 'county' THEN 0 ELSE 1 END, round((b - a) * (d - c), 9), area)) AS tier, CAST(arg_min(area, (CASE tier WHEN 'county' THEN 0 ELSE 1 END, round((b - a) * (d - c), 9), area)) AS VARCHAR) AS area FROM {P} p LEFT JOIN a ON lat > a AND lat < b AND lon > c AND lon < d GROUP BY 1""")
def geo_reverse(spark, d):
    """The smallest area of the finest tier around each point; null where none is."""
    k = F.col("n_nationkey")
    box = {"min_lat": 24.9985 + k % 5 * 4.003, "max_lat": 24.9985 + k % 5 * 4.003 + 4 + k % 3, "min_lon": -125.0015 + F.floor(k / 5) * 11.003, "max_lon": -125.0015 + F.floor(k / 5) * 11.003 + 9 + k % 3}
    areas = table(spark, d, "nation").select(k.alias("area"), F.when(k % 3 == 0, "county").otherwise("region").alias("tier"), *[c.cast("double").alias(n) for n, c in box.items()])
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat")))
    p = points(spark, d, "customer", "c_custkey").select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    out = Z.reverse(p, areas.withColumn("rings", ring), ("county", "region"))
    return out.select("id", "tier", F.col("area").cast("string").alias("area"))


@query("join_cell_coverage", f"WITH s AS (SELECT DISTINCT CAST(floor(lat / 10) AS BIGINT) || ':' || CAST(floor(lon / 10) AS BIGINT) AS cell, CAST(floor(lat / 10) AS BIGINT) % 2 AS completeness FROM {_SUP}) SELECT x.cell, CAST(completeness AS DOUBLE) AS completeness, CASE WHEN s.cell IS NULL THEN 'unknown' WHEN completeness > 0 THEN 'covered' ELSE 'empty' END AS status FROM (SELECT DISTINCT CAST(floor(lat) AS BIGINT) || ':' || CAST(floor(lon) AS BIGINT) AS cell, CAST(floor(lat / 10) AS BIGINT) || ':' || CAST(floor(lon / 10) AS BIGINT) AS up FROM {P}) x LEFT JOIN s ON s.cell = up")
def join_cell_coverage(spark, d):
    """Fine cells by their parent's row of a coverage table."""
    cell = lambda step: G.cell(F.col("lat"), F.col("lon"), step)
    surveyed = points(spark, d, "supplier", "s_suppkey").select(cell(10).alias("cell"), (F.floor(F.col("lat") / 10) % 2).cast("double").alias("completeness")).distinct()
    fine = points(spark, d, "customer", "c_custkey").select(cell(1).alias("cell")).distinct()
    up = lambda c: F.concat_ws(":", *[F.floor(F.get(F.split(c, ":"), F.lit(i)).cast("double") / 10).cast("string") for i in (0, 1)])
    return Z.coverage(fine, surveyed, up)


@query("gaz_checks", "SELECT unnest(['rows', 'nations', 'negative']) AS \"check\", unnest([CAST(count(*) AS DOUBLE), CAST(count(DISTINCT c_nationkey) AS DOUBLE), CAST(count(*) FILTER (WHERE c_acctbal < 0) AS DOUBLE)]) AS value, unnest([1500.0, 25.0, 100000.0]) AS expected, unnest([abs(count(*) - 1500.0) <= 75, abs(count(DISTINCT c_nationkey) - 25.0) <= 1.25, abs(count(*) FILTER (WHERE c_acctbal < 0) - 100000.0) <= 5000]) AS passed FROM customer")
def gaz_checks(spark, d):
    rules = {"rows": F.count(F.lit(1)), "nations": F.count_distinct("c_nationkey"), "negative": F.count_if(F.col("c_acctbal") < 0)}
    return Z.checks(table(spark, d, "customer"), rules, {"rows": 1500, "nations": 25, "negative": 100000})


@query("gaz_slim", f"SELECT id, name FROM {PLACES} WHERE placetype <> 'customer' OR id IN (SELECT o_custkey + 1000 FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def gaz_slim(spark, d):
    """The part of the table that a small distribution holds: areas, and places that are large enough."""
    large = table(spark, d, "orders").groupBy((F.col("o_custkey") + 1000).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 12").select("id")
    p = places(spark, d)
    return p.filter("placetype <> 'customer'").select("id", "name").unionByName(p.filter("placetype = 'customer'").join(large, "id", "left_semi").select("id", "name"))


@query("gaz_first_seen_codes", "WITH f AS (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY 1), c AS (SELECT p_brand, row_number() OVER (ORDER BY f) - 1 AS code FROM f) SELECT p_partkey, code FROM part JOIN c USING (p_brand)")
def gaz_first_seen_codes(spark, d):
    """Numbers for the few values of a column, in the order in which they first occur."""
    from pyspark.sql import Window

    p = table(spark, d, "part")
    codes = p.groupBy("p_brand").agg(F.min("p_partkey").alias("_f")).withColumn("code", F.row_number().over(Window.orderBy("_f")) - 1).drop("_f")  # one row a value
    return p.join(F.broadcast(codes.limit(65536)), "p_brand").select("p_partkey", "code")


@query("gaz_prefix_probe", f"WITH x AS (SELECT substring(postcode, 1, 2) AS p, region, count(*) AS n FROM {ADDRESSES} GROUP BY 1, 2), m AS (SELECT p, arg_min(region, (-n, region)) AS region, max(n) / sum(n) AS share FROM x GROUP BY 1) SELECT id, CASE WHEN share >= 0.3 THEN m.region END AS region FROM {ADDRESSES} a JOIN m ON p = substring(postcode, 1, 2)")
def gaz_prefix_probe(spark, d):
    """The region that a postcode's first digits speak for, where most rows agree."""
    from granary.operators.census import dominant

    a = addresses(spark, d).select("id", F.substring("postcode", 1, 2).alias("p"), "region")
    prior = dominant(a, ["p"], "region").select(F.col("p").alias("_p"), F.col("region").alias("_r"), "share")
    return a.join(prior, F.col("p") == F.col("_p")).select("id", F.when(F.col("share") >= 0.3, F.col("_r")).alias("region"))
