"""Profiles, counts, filters and samples of reference tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import geo as G
from granary.operators import census as C
from granary.operators import linkage as L
from granary.operators.lineage import cut
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, PLACES, addresses, places, points, sql_km, sql_points, table

CUSTOMERS = sql_points("customer", "c_custkey")
ANCESTORS = f"""(WITH RECURSIVE r AS (SELECT id, id AS ancestor, parent_id FROM {PLACES} UNION ALL SELECT r.id, p.id, p.parent_id FROM r JOIN {PLACES} p ON p.id = r.parent_id) SELECT id, ancestor FROM r)"""
POPULATION = "(SELECT o_custkey + 1000 AS id, CAST(floor(round(sum(o_totalprice), 2)) AS BIGINT) AS population FROM orders GROUP BY 1)"


def _population(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") + 1000).alias("pid")).agg(F.floor(F.round(F.sum("o_totalprice"), 2)).alias("population"))


def _ancestors(spark, d):
    return L.closure(places(spark, d), cut).select("id", "ancestor")


@query("sql_hive_partitions", "SELECT o_orderkey, o_totalprice, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def sql_hive_partitions(spark, d):
    """A table partitioned by folder: only the folders of one value are read."""
    from granary.operators.lineage import folder

    path = folder(spark, "hive")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status")).write.partitionBy("status").parquet(path)
    return spark.read.parquet(path).filter((F.col("status") == "F") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_totalprice", "status")


@query("sql_flatten_levels", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END), ''), CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END) AS town FROM part")
def sql_flatten_levels(spark, d):
    """The first filled of a field and the innermost of nested levels."""
    level = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    levels = F.when(F.col("p_size") % 2 == 0, F.array(level("region", "p_brand"), level("town", "p_type"))).otherwise(F.array(level("region", "p_brand")))
    city = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(F.trim(city), F.lit("")), F.element_at(levels, -1)["value"]).alias("town"))


@query("sql_fill_rates", """SELECT 'lang' AS "column", count(nullif(trim(lang), '')) AS filled, count(*) AS total, count(nullif(trim(lang), '')) / count(*) AS share FROM documents UNION ALL
 SELECT 'source', count(nullif(trim(source), '')), count(*), count(nullif(trim(source), '')) / count(*) FROM documents UNION ALL SELECT 'text', count(nullif(trim(text), '')), count(*), count(nullif(trim(text), '')) / count(*) FROM documents""")
def sql_fill_rates(spark, d):
    return C.fill_rates(table(spark, d, "documents"), ["lang", "source", "text"])


@query("sql_list_counts", "SELECT dataset, count(*) AS n FROM (SELECT unnest([lang, source]) AS dataset FROM documents) GROUP BY 1")
def sql_list_counts(spark, d):
    return C.item_counts(table(spark, d, "documents"), F.array("lang", "source"), "dataset")


@query("sql_observed_aliases", "SELECT p_size AS area, lower(p_brand) AS said, lower(p_type) AS official, count(*) AS n FROM part WHERE lower(p_brand) <> lower(p_type) GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def sql_observed_aliases(spark, d):
    return C.observed_aliases(table(spark, d, "part"), F.col("p_size"), F.col("p_brand"), F.col("p_type"), 2)


@query("sql_extent_fallback", f"""WITH e AS (SELECT c_nationkey AS k, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM {CUSTOMERS} p JOIN customer ON c_custkey = p.id WHERE c_acctbal > 9000 GROUP BY 1)
 SELECT n_nationkey, coalesce(a, n_nationkey - 1) AS min_lat, coalesce(b, n_nationkey + 1) AS max_lat, (coalesce(a, n_nationkey - 1) + coalesce(b, n_nationkey + 1)) / 2 AS lat FROM nation LEFT JOIN e ON k = n_nationkey""")
def sql_extent_fallback(spark, d):
    """The extent of each area's points, or a box around the area where it has none."""
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey", "c_nationkey")
    e = C.extents(points(spark, d, "customer", "c_custkey").join(rich, F.col("id") == F.col("c_custkey")), "c_nationkey")
    n = table(spark, d, "nation").join(e, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    low, high = F.coalesce("min_lat", F.col("n_nationkey") - 1), F.coalesce("max_lat", F.col("n_nationkey") + 1)
    return n.select("n_nationkey", low.cast("double").alias("min_lat"), high.cast("double").alias("max_lat"), ((low + high) / 2).cast("double").alias("lat"))


@query("sql_parent_kinds", f"SELECT c.placetype AS kind, p.placetype AS parent, count(*) AS n FROM {PLACES} c JOIN {PLACES} p ON p.id = c.parent_id GROUP BY 1, 2")
def sql_parent_kinds(spark, d):
    p = places(spark, d)
    up = p.select(F.col("id").alias("up"), F.col("placetype").alias("parent"))
    return p.join(up, F.col("parent_id") == F.col("up")).groupBy(F.col("placetype").alias("kind"), "parent").agg(F.count(F.lit(1)).alias("n"))


@query("sql_ancestor_kinds", f"SELECT c.placetype AS kind, p.placetype AS ancestor, count(*) AS n FROM {ANCESTORS} a JOIN {PLACES} c ON c.id = a.id JOIN {PLACES} p ON p.id = a.ancestor WHERE a.id <> a.ancestor GROUP BY 1, 2")
def sql_ancestor_kinds(spark, d):
    p = places(spark, d).select("id", "placetype")
    a = _ancestors(spark, d).filter("id <> ancestor").join(p, "id").withColumnRenamed("placetype", "kind")
    up = p.select(F.col("id").alias("ancestor"), F.col("placetype").alias("ancestor_kind"))
    return a.join(up, "ancestor").groupBy("kind", "ancestor_kind").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("ancestor_kind", "ancestor")


@query("sql_dominant_name", """WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_name, (-n, p_name)) AS p_name, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, max(n) / sum(n) AS share FROM c GROUP BY 1""")
def sql_dominant_name(spark, d):
    return C.dominant(table(spark, d, "part"), ["p_brand"], "p_name")


@query("sql_collision_degree", "WITH x AS (SELECT p_name, count(DISTINCT p_brand) AS degree FROM part GROUP BY 1) SELECT p_partkey, part.p_name, degree FROM part JOIN x USING (p_name)")
def sql_collision_degree(spark, d):
    return C.collision_degree(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand").select("p_partkey", "p_name", "degree")


@query("sql_filter_then_sample", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY sha256('s' || o_orderkey), o_orderkey LIMIT 50")
def sql_filter_then_sample(spark, d):
    return C.hash_sample(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "o_orderkey", 50, "s").select("o_orderkey")


_RING = ((-120, 28), (-90, 26), (-80, 44), (-100, 40), (-118, 47))


def _sql_ring(lon, lat):
    parts = []
    for (x1, y1), (x2, y2) in zip(_RING, (_RING[-1], *_RING[:-1])):
        parts.append(f"CASE WHEN ({y1} > {lat}) <> ({y2} > {lat}) AND {lon} < ({x2} - {x1}) * ({lat} - {y1}) / CAST({y2} - {y1} AS DOUBLE) + {x1} THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query("sql_points_in_area", f"SELECT id, lat, lon FROM {CUSTOMERS} WHERE {_sql_ring('lon', 'lat')}")
def sql_points_in_area(spark, d):
    """Address points inside a polygon: its box first, which is pushed to the scan, then the ring."""
    ring = F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in _RING]))
    p = points(spark, d, "customer", "c_custkey").filter(F.col("lon").between(-120, -80) & F.col("lat").between(26, 47))
    return p.filter(G.in_rings(F.col("lon"), F.col("lat"), ring))


@query("sql_segment_sides", """SELECT p_partkey, side, from_hn, to_hn, least(from_hn, to_hn) AS min_hn, greatest(from_hn, to_hn) AS max_hn, CASE WHEN from_hn % 2 <> to_hn % 2 THEN 'mixed' WHEN from_hn % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM
 (SELECT p_partkey, 'left' AS side, p_size * 2 AS from_hn, p_size * 2 + 98 AS to_hn FROM part UNION ALL SELECT p_partkey, 'right', p_size * 2 + 99, CAST(p_partkey % 50 + 1 AS INTEGER) FROM part WHERE p_partkey % 7 <> 0)""")
def sql_segment_sides(spark, d):
    """A street segment's two ranges as rows; a side without numbers has none."""
    right = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 50 + 1).cast("int")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), a.cast("int").alias("from_hn"), b.cast("int").alias("to_hn")) for s, a, b in (("left", F.col("p_size") * 2, F.col("p_size") * 2 + 98), ("right", F.col("p_size") * 2 + 99, right))])
    out = table(spark, d, "part").select("p_partkey", F.inline(sides)).filter("to_hn IS NOT NULL")
    odd = lambda c: F.col(c) % 2
    parity = F.when(odd("from_hn") != odd("to_hn"), "mixed").when(odd("from_hn") == 1, "odd").otherwise("even")
    return out.withColumns({"min_hn": F.least("from_hn", "to_hn"), "max_hn": F.greatest("from_hn", "to_hn"), "parity": parity})


@query("sql_concordance", "SELECT DISTINCT s_suppkey, s_name, l_partkey % 50 AS concordance, coalesce(s_acctbal, 0) AS population FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def sql_concordance(spark, d):
    c = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("concordance")).distinct()
    return c.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "concordance", F.coalesce("s_acctbal", F.lit(0.0)).alias("population"))


@query("sql_containing_counts", "SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS containing FROM orders GROUP BY 1")
def sql_containing_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("containing"))


@query("sql_centroid_provenance", f"SELECT a.id, a.postcode, coalesce(p.lat, 0) AS lat, coalesce(p.lon, 0) AS lon, CASE WHEN p.id IS NULL THEN 'none' ELSE 'supplier' END AS provenance FROM {ADDRESSES} a LEFT JOIN {sql_points('supplier', 's_suppkey')} p ON p.id = a.id")
def sql_centroid_provenance(spark, d):
    s = points(spark, d, "supplier", "s_suppkey").select(F.col("id").alias("sid"), "lat", "lon")
    a = addresses(spark, d).join(s, F.col("id") == F.col("sid"), "left")
    return a.select("id", "postcode", F.coalesce("lat", F.lit(0.0)).cast("double").alias("lat"), F.coalesce("lon", F.lit(0.0)).cast("double").alias("lon"), F.when(F.col("sid").isNull(), "none").otherwise("supplier").alias("provenance"))


@query("sql_shared_names", "SELECT p_name, count(*) AS holders FROM part GROUP BY 1 HAVING count(*) > 1")
def sql_shared_names(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")


@query("sql_postcode_coverage", f"SELECT country, count(*) AS n, count(DISTINCT postcode) AS postcodes, count(DISTINCT substring(postcode, 1, 2)) AS prefixes FROM {ADDRESSES} GROUP BY 1")
def sql_postcode_coverage(spark, d):
    return addresses(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("postcode").alias("postcodes"), F.count_distinct(F.substring("postcode", 1, 2)).alias("prefixes"))


@query("sql_attribution", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def sql_attribution(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("sql_one_per_street", f"SELECT street, min(id) AS id, arg_min(raw, id) AS raw FROM {ADDRESSES} GROUP BY 1")
def sql_one_per_street(spark, d):
    """One row per street: that of the least id, where the engine that the statement is from takes any."""
    return addresses(spark, d).groupBy("street").agg(F.min("id").alias("id"), F.min_by("raw", "id").alias("raw"))


@query("sql_triage", f"SELECT p.id, p.name, p.placetype, coalesce(population, 0) AS population, population IS NULL AS unknown FROM {PLACES} p LEFT JOIN {POPULATION} n USING (id) WHERE placetype <> 'region'")
def sql_triage(spark, d):
    p = places(spark, d).filter("placetype <> 'region'").join(_population(spark, d), F.col("id") == F.col("pid"), "left")
    return p.select("id", "name", "placetype", F.coalesce("population", F.lit(0)).alias("population"), F.col("population").isNull().alias("unknown"))


@query("flt_live", "SELECT o_orderkey FROM orders WHERE (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END) <> 0 AND o_orderkey % 11 <> 0")
def flt_live(spark, d):
    current = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(-1)
    return table(spark, d, "orders").filter(C.live(current, F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))).select("o_orderkey")


@query("flt_box_overlap", f"""WITH e AS (SELECT c_nationkey, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM {CUSTOMERS} p JOIN customer ON c_custkey = p.id WHERE c_acctbal > 9500 GROUP BY 1)
 SELECT c_nationkey FROM e WHERE min_lat <= 45 + 300 / 111 AND max_lat >= 45 - 300 / 111 AND min_lon <= -110 + 300 / (111 * cos(radians(45))) AND max_lon >= -110 - 300 / (111 * cos(radians(45)))""")
def flt_box_overlap(spark, d):
    """Areas whose box meets that of 300 km around a point."""
    rich = table(spark, d, "customer").filter("c_acctbal > 9500").select("c_custkey", "c_nationkey")
    e = C.extents(points(spark, d, "customer", "c_custkey").join(rich, F.col("id") == F.col("c_custkey")), "c_nationkey")
    return e.filter(C.overlaps("", *G.box_around(F.lit(45.0), F.lit(-110.0), F.lit(300.0)))).select("c_nationkey")


@query("flt_smallest_boxes", f"""WITH e AS (SELECT c_nationkey AS area, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM {CUSTOMERS} p JOIN customer ON c_custkey = p.id WHERE c_custkey % 5 = 0 GROUP BY 1)
 SELECT id, area, CAST(r AS INTEGER) AS rank FROM (SELECT s.id, area, row_number() OVER (PARTITION BY s.id ORDER BY round((b - a) * (d - c), 9), area) AS r FROM {sql_points('supplier', 's_suppkey')} s JOIN e ON s.lat BETWEEN a AND b AND s.lon BETWEEN c AND d) WHERE r <= 3""")
def flt_smallest_boxes(spark, d):
    """The areas whose boxes hold a point, smallest first. Areas are few, so their boxes are the broadcast side."""
    some = table(spark, d, "customer").filter("c_custkey % 5 = 0").select("c_custkey", F.col("c_nationkey").alias("area"))
    e = C.extents(points(spark, d, "customer", "c_custkey").join(some, F.col("id") == F.col("c_custkey")), "area")
    s = points(spark, d, "supplier", "s_suppkey")
    hit = s.join(F.broadcast(e.limit(4096)), F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
    size = F.round((F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon")), 9)
    return C.top_by_group(hit, ["id"], [size, F.col("area")], 3).select("id", "area", "rank")


@query("flt_plausible_country", f"SELECT id, CASE WHEN country = 'US' THEN p.lat < 18 OR p.lat > 72 OR p.lon < -180 OR p.lon > -66 WHEN country = 'DE' THEN p.lat < 47 OR p.lat > 55.5 OR p.lon < 5.5 OR p.lon > 15.5 ELSE false END AS implausible FROM {ADDRESSES} a JOIN {CUSTOMERS} p USING (id)")
def flt_plausible_country(spark, d):
    """Whether a point lies outside the box of its country; a country without a box never is."""
    box = spark.createDataFrame([("US", 18.0, 72.0, -180.0, -66.0), ("DE", 47.0, 55.5, 5.5, 15.5)], "c string, a double, b double, x double, y double")
    j = addresses(spark, d).join(points(spark, d, "customer", "c_custkey"), "id").join(F.broadcast(box), F.col("country") == F.col("c"), "left")
    out = (F.col("lat") < F.col("a")) | (F.col("lat") > F.col("b")) | (F.col("lon") < F.col("x")) | (F.col("lon") > F.col("y"))
    return j.select("id", F.coalesce(out, F.lit(False)).alias("implausible"))


@query("flt_exclusion", "SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AS may_exclude FROM lineitem")
def flt_exclusion(spark, d):
    basis = F.when(F.col("l_returnflag") == "A", "designated").when(F.col("l_returnflag") == "R", "surveyed").when(F.col("l_linenumber") % 2 == 0, "observed")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.supports_exclusion(basis).alias("may_exclude"))


@query("flt_expanded_kinds", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'locality,borough,localadmin,region,macroregion' ELSE 'venue,county,macrocounty' END AS kinds FROM part")
def flt_expanded_kinds(spark, d):
    asked = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("locality"), F.lit("region"), F.lit("borough"))).otherwise(F.array(F.lit("venue"), F.lit("county")))
    return table(spark, d, "part").select("p_partkey", F.array_join(C.expanded_filter(asked), ",").alias("kinds"))


@query("flt_bounds", "SELECT event_id, value * 4 - 100 BETWEEN -90 AND 90 AND value * 8 - 200 BETWEEN -180 AND 180 AS valid FROM events")
def flt_bounds(spark, d):
    return table(spark, d, "events").select("event_id", G.in_bounds(F.col("value") * 4 - 100, F.col("value") * 8 - 200).alias("valid"))


@query("flt_pick", "SELECT p_partkey, nullif(trim(concat_ws(', ', nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' || p_name || ' ' ELSE '  ' END), ''), nullif(trim(CASE WHEN p_size % 3 = 0 THEN p_brand END), ''))), '') AS picked FROM part")
def flt_pick(spark, d):
    from granary.functions.text import pick

    p = table(spark, d, "part").withColumns({"a": F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).otherwise("  "), "b": F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))})
    return p.select("p_partkey", pick(["a", "b"], ", ").alias("picked"))


@query("join_same_name", f"""SELECT r.id AS region, l.id AS town, coalesce(population, 0) AS population FROM (SELECT *, substring(name, 1, 9) AS k FROM {PLACES} WHERE placetype = 'customer') l JOIN (SELECT id, 'customer#' AS k FROM {PLACES} WHERE placetype = 'nation') r ON lower(l.k) = r.k
 JOIN {ANCESTORS} a ON a.id = l.id AND a.ancestor = r.id LEFT JOIN {POPULATION} p ON p.id = l.id""")
def join_same_name(spark, d):
    """Places under a region with which they share a folded name, and their population."""
    p = places(spark, d)
    town = p.filter("placetype = 'customer'").select(F.col("id").alias("town"), F.lower(F.substring("name", 1, 9)).alias("k"))
    region = p.filter("placetype = 'nation'").select(F.col("id").alias("region"), F.lit("customer#").alias("rk"))
    up = _ancestors(spark, d).withColumnsRenamed({"id": "_id", "ancestor": "_up"})
    # By the ancestor first: names alone would pair every town with every region.
    j = town.join(up, F.col("town") == F.col("_id")).join(region, (F.col("_up") == F.col("region")) & (F.col("k") == F.col("rk")))
    return j.join(_population(spark, d), F.col("town") == F.col("pid"), "left").select("region", "town", F.coalesce("population", F.lit(0)).alias("population"))


@query("join_under_parent", f"SELECT id FROM {PLACES} WHERE parent_id = 2 OR id IN (SELECT id FROM {ANCESTORS} WHERE ancestor = 2)")
def join_under_parent(spark, d):
    """Direct children and all descendants: a union of ids, so that both sides stay equi joins."""
    p = places(spark, d)
    ids = p.filter("parent_id = 2").select("id").union(_ancestors(spark, d).filter("ancestor = 2").select("id")).distinct()
    return p.join(ids, "id", "left_semi").select("id")


@query("agg_street_centroid", f"SELECT street, postcode, locality, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, min(lat) AS min_lat, max(lat) AS max_lat, count(*) AS n, min(raw) AS raw FROM {ADDRESSES} a JOIN {CUSTOMERS} p USING (id) GROUP BY 1, 2, 3")
def agg_street_centroid(spark, d):
    a = addresses(spark, d).join(points(spark, d, "customer", "c_custkey"), "id")
    return a.groupBy("street", "postcode", "locality").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))


@query("agg_region_per_place", f"SELECT a.id, min(ancestor) AS region, count(DISTINCT ancestor) AS regions FROM {ANCESTORS} a JOIN {PLACES} p ON p.id = a.ancestor WHERE placetype = 'nation' GROUP BY 1")
def agg_region_per_place(spark, d):
    nations = places(spark, d).filter("placetype = 'nation'").select(F.col("id").alias("ancestor"))
    return _ancestors(spark, d).join(nations, "ancestor").groupBy("id").agg(F.min("ancestor").alias("region"), F.count_distinct("ancestor").alias("regions"))


@query("agg_ladder", f"""WITH s AS (SELECT id, placetype, CASE WHEN parent_id % 2 = 0 THEN 'A' ELSE 'B' END AS c FROM (SELECT p.id, p.placetype, CASE WHEN p.placetype = 'customer' THEN p.parent_id ELSE p.id END AS parent_id FROM {PLACES} p)),
 t AS (SELECT c, count(*) AS parents FROM s WHERE placetype = 'nation' GROUP BY 1), n AS (SELECT c, placetype, count(*) AS nodes FROM s WHERE placetype IN ('nation', 'customer') GROUP BY 1, 2),
 k AS (SELECT p.c, x.placetype, count(DISTINCT p.id) AS covered FROM s x JOIN {ANCESTORS} a ON a.id = x.id JOIN s p ON p.id = a.ancestor WHERE p.placetype = 'nation' AND x.placetype IN ('nation', 'customer') AND x.c = p.c AND x.id <> p.id GROUP BY 1, 2)
 SELECT t.c AS country, r.rung, coalesce(nodes, 0) AS nodes, coalesce(covered, 0) AS parents_covered, parents, coalesce(covered, 0) / parents AS coverage FROM t, (SELECT unnest(['areas', 'places']) AS rung, unnest(['nation', 'customer']) AS k) r LEFT JOIN n ON n.c = t.c AND n.placetype = r.k LEFT JOIN k ON k.c = t.c AND k.placetype = r.k""")
def agg_ladder(spark, d):
    p = places(spark, d)
    own = F.when(F.col("placetype") == "customer", F.col("parent_id")).otherwise(F.col("id"))
    p = p.select("id", F.col("placetype").alias("kind"), F.when(own % 2 == 0, "A").otherwise("B").alias("country"))
    return C.ladder(p, _ancestors(spark, d), {"areas": ("nation",), "places": ("customer",)}, ("nation",))


@query("agg_literal_mining", f"SELECT literal, n FROM (SELECT literal, count(*) AS n FROM (SELECT unnest(regexp_extract_all(raw, '\\b[0-9]{{5}}\\b')) AS literal FROM {ADDRESSES}) GROUP BY 1) ORDER BY n DESC, literal LIMIT 20")
def agg_literal_mining(spark, d):
    found = addresses(spark, d).select(F.explode(F.regexp_extract_all("raw", F.lit("\\b[0-9]{5}\\b"), F.lit(0))).alias("literal"))
    return found.groupBy("literal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "literal").limit(20)


@query("agg_ring_spread", f"""WITH c AS (SELECT CAST(floor(lat / 2) AS BIGINT) AS a, CAST(floor(lon / 2) AS BIGINT) AS b, max(id % 100) AS s FROM {CUSTOMERS} GROUP BY 1, 2)
 SELECT (a + i) || ':' || (b + j) AS cell, max(s / (1.0 + greatest(abs(i), abs(j)))) AS salience FROM c, range(-1, 2) x(i), range(-1, 2) y(j) GROUP BY 1""")
def agg_ring_spread(spark, d):
    """Salience of cells after each spreads to its ring at less weight: the most that reaches a cell."""
    p = points(spark, d, "customer", "c_custkey")
    c = p.groupBy(F.floor(F.col("lat") / 2).alias("a"), F.floor(F.col("lon") / 2).alias("b")).agg(F.max(F.col("id") % 100).alias("s"))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1.0 + max(abs(i), abs(j))).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = c.select("a", "b", "s", F.explode(ring).alias("r"))
    cell = F.concat_ws(":", (F.col("a") + F.col("r.i")).cast("string"), (F.col("b") + F.col("r.j")).cast("string"))
    return out.groupBy(cell.alias("cell")).agg(F.max(F.col("s") / F.col("r.w")).alias("salience"))


@query("agg_mixed_scripts", f"""SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[Ѐ-ӿ]')) AS mixed, count(*) FILTER (WHERE regexp_matches(text, '[À-ɏ]')) AS accented FROM documents GROUP BY 1""")
def agg_mixed_scripts(spark, d):
    has = lambda p: F.regexp_like("text", F.lit(f"[{p}]"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(has("A-Za-z") & has("Ѐ-ӿ")).alias("mixed"), F.count_if(has("À-ɏ")).alias("accented"))


_FAN = f"""SELECT s.*, n.population FROM (SELECT DISTINCT l_partkey % 40 AS g, l_suppkey AS id FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 48 AND l_discount > 0.08) s JOIN (SELECT s_suppkey AS id, CAST(floor(s_acctbal) AS BIGINT) AS population FROM supplier) n USING (id)"""


@query("agg_fanout", f"""WITH c AS (SELECT x.g, x.id, p.lat, p.lon, population FROM ({_FAN}) x JOIN {sql_points('supplier', 's_suppkey')} p USING (id)), k AS (SELECT a.g, max({sql_km('a', 'b')}) AS km FROM c a JOIN c b ON a.g = b.g AND a.id < b.id GROUP BY 1),
 s AS (SELECT g, count(*) AS n, max(population) AS top, list_sort(list(id)) AS ids, arg_max(id, population) AS best FROM c GROUP BY 1), t AS (SELECT c.g, count(*) AS tied FROM c JOIN s ON s.g = c.g AND population = top GROUP BY 1)
 SELECT s.g, CASE WHEN n = 1 THEN 'single' WHEN km <= 5 THEN 'coincident' WHEN top > 0 AND tied = 1 THEN 'population' ELSE 'unresolvable' END AS verdict,
 array_to_string(CASE WHEN n = 1 OR km <= 5 THEN ids WHEN top > 0 AND tied = 1 THEN [best] ELSE [] END, ',') AS keep FROM s LEFT JOIN k USING (g) JOIN t USING (g)""")
def agg_fanout(spark, d):
    l = table(spark, d, "lineitem").filter("l_linenumber = 7 AND l_quantity > 48 AND l_discount > 0.08").select((F.col("l_partkey") % 40).alias("g"), F.col("l_suppkey").alias("id")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.floor("s_acctbal").alias("population"))
    c = l.join(s, "id").join(points(spark, d, "supplier", "s_suppkey"), "id")
    out = C.fanout(c, "g")
    return out.select("g", "verdict", F.array_join(F.col("keep").cast("array<string>"), ",").alias("keep"))


@query("srt_clustered", "SELECT c_mktsegment, c_custkey FROM customer")
def srt_clustered(spark, d):
    """Rows dealt by ranges of a key and sorted in each part, as a clustered table is loaded."""
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey").repartitionByRange(8, "c_mktsegment", "c_custkey").sortWithinPartitions("c_mktsegment", "c_custkey")


@query("srt_row_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 100)")
def srt_row_limit(spark, d):
    return table(spark, d, "orders").limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("srt_stride", "SELECT c_custkey FROM customer WHERE c_custkey % greatest(1, (SELECT count(*) FROM customer) // 50) = 0 AND c_custkey // greatest(1, (SELECT count(*) FROM customer) // 50) < 50")
def srt_stride(spark, d):
    c = table(spark, d, "customer")
    return C.stride_sample(c, "c_custkey", 50, c.count()).select("c_custkey")


@query("srt_seeded_draws", "SELECT o_orderkey, CAST(((o_orderkey % 2147483648) * 1103515245 + 12345) % 2147483648 AS BIGINT) AS draw FROM orders")
def srt_seeded_draws(spark, d):
    """A linear congruential draw for each row from its own key, so that no order of rows matters."""
    from granary.functions.random import lcg

    return table(spark, d, "orders").select("o_orderkey", lcg(F.col("o_orderkey")).alias("draw"))


@query("set_not_in", f"SELECT id FROM {ADDRESSES} WHERE country NOT IN ('US', 'FR')")
def set_not_in(spark, d):
    return addresses(spark, d).filter(~F.col("country").isin("US", "FR")).select("id")


@query("set_unsurveyed", "SELECT n_nationkey, 'unknown' AS status FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_unsurveyed(spark, d):
    """Asked units less surveyed ones: unknown, not empty."""
    done = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey").join(done, "n_nationkey", "left_anti").withColumn("status", F.lit("unknown"))
