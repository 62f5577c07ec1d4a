"""Names, keys, and the full resolution of records."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import names as N
from granary.functions import text as T
from granary.operators import boosting as B
from granary.operators import resolution as R
from granary.operators.lineage import cut
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, addresses, pick_by_key, sql_km, table

_GIVEN = pick_by_key(["Jonathan", "Margaret", "Wei", "Olga", "Pedro", "Fatima", "Hugh", "Ingrid"], "p")
_TYPO = pick_by_key(["Jonathon", "Margret", "Wei", "Olga", "Pedra", "Fatimah", "Hugh", "Ingrid"], "p")
_FAMILY = pick_by_key(["Smith", "Novak", "Garcia", "Okafor", "Lindqvist", "Dubois", "Tanaka"], "p")
_PLACE = pick_by_key(["1 Oak St, Springfield", "22 Main Ave, Portland", "7 Elm Rd, Salem", "9 Bay Dr, Austin", "3 High St, Boston"], "p")

#: Records of a few people each, with spellings, gaps and places that differ between them.
RECORDS = f"""(SELECT c_custkey AS id, CASE WHEN c_custkey // 500 % 3 = 1 AND p % 2 = 0 THEN {_TYPO[1]} ELSE {_GIVEN[1]} END AS given, CASE WHEN p % 9 = 0 THEN NULL ELSE {_FAMILY[1]} END AS family, CASE WHEN p % 4 = 0 THEN 'acme health' WHEN p % 4 = 1 THEN 'blue river clinic' END AS organization,
 CASE WHEN c_custkey % 7 <> 0 THEN '555 ' || lpad(CAST(p AS VARCHAR), 7, '0') END AS phone, CAST(NULL AS VARCHAR) AS email, CASE WHEN c_custkey % 5 <> 0 THEN lower({_PLACE[1]}) || p END AS address_key, {_PLACE[1]} || ' ' || p AS address_raw, 30 + p * 0.07 + c_custkey * 0.000001 AS lat, -100 + p % 50 * 0.3 AS lon FROM (SELECT c_custkey, c_custkey % 500 AS p FROM customer))"""


def _records(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 500).alias("p"))
    given = F.when((F.floor(F.col("id") / 500) % 3 == 1) & (F.col("p") % 2 == 0), _TYPO[0]).otherwise(_GIVEN[0])
    return r.select(
        "id", given.alias("given"), F.when(F.col("p") % 9 != 0, _FAMILY[0]).alias("family"), F.when(F.col("p") % 4 == 0, "acme health").when(F.col("p") % 4 == 1, "blue river clinic").alias("organization"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("555 "), F.lpad(F.col("p").cast("string"), 7, "0"))).alias("phone"), F.lit(None).cast("string").alias("email"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lower(_PLACE[0]), F.col("p").cast("string"))).alias("address_key"), F.concat_ws(" ", _PLACE[0], F.col("p").cast("string")).alias("address_raw"),
        (30 + F.col("p") * 0.07 + F.col("id") * 0.000001).alias("lat"), (-100 + F.col("p") % 50 * 0.3).alias("lon"),
    )


_SIM = "CASE WHEN a.{0} IS NULL OR b.{0} IS NULL THEN -1 WHEN lower(a.{0}) = lower(b.{0}) THEN 0 WHEN greatest(jaro_winkler_similarity(lower(a.{0}), lower(b.{0})), 1 - levenshtein(lower(a.{0}), lower(b.{0})) / CAST(greatest(length(a.{0}), length(b.{0})) AS DOUBLE)) >= 0.88 THEN 1 ELSE 2 END"
_W = "CASE {0} WHEN 0 THEN log2(0.8 / 0.01) WHEN 1 THEN log2(0.15 / 0.03) WHEN 2 THEN log2(0.05 / 0.96) ELSE 0 END"
_LEVELS = f"""r AS {RECORDS}, f AS (SELECT trim(regexp_replace(upper(address_raw), '[^A-Z0-9]+', ' ', 'g')) AS key, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY 1),
 q AS (SELECT a.id AS lo, b.id AS hi FROM r a JOIN r b ON a.id < b.id AND abs(floor(a.lat / 0.05) - floor(b.lat / 0.05)) <= 2 AND abs(floor(a.lon / 0.05) - floor(b.lon / 0.05)) <= 2 UNION SELECT a.id, b.id FROM r a JOIN r b ON a.id < b.id AND a.address_key = b.address_key UNION SELECT a.id, b.id FROM r a JOIN r b ON a.id < b.id AND a.phone = b.phone),
 l AS (SELECT lo, hi, {_SIM.format('given')} AS given, {_SIM.format('family')} AS family, {_SIM.format('organization')} AS org, CASE WHEN a.address_key = b.address_key THEN 0 WHEN {sql_km('a', 'b')} <= 0.05 THEN 1 WHEN {sql_km('a', 'b')} <= 0.5 THEN 2 WHEN {sql_km('a', 'b')} <= 5 THEN 3 ELSE 4 END AS spatial, share FROM q JOIN r a ON a.id = lo JOIN r b ON b.id = hi JOIN f ON f.key = trim(regexp_replace(upper(a.address_raw), '[^A-Z0-9]+', ' ', 'g'))),
 w AS (SELECT *, {_W.format('given')} + {_W.format('family')} + {_W.format('org')} + CASE spatial WHEN 0 THEN log2(0.85 / 0.01) + log2(0.01 / greatest(share, 0.0001)) WHEN 1 THEN log2(0.1 / 0.02) WHEN 2 THEN log2(0.03 / 0.05) WHEN 3 THEN log2(0.015 / 0.2) ELSE log2(0.005 / 0.72) END AS weight, given IN (0, 1) OR family IN (0, 1) OR org IN (0, 1) AS backed FROM l)"""


@query("lnk_contributions", f"WITH {_LEVELS} SELECT lo, hi, given, family, org AS organization, spatial, round(weight, 6) AS weight FROM w")
def lnk_contributions(spark, d):
    """Every candidate pair with its levels and the sum of what they say."""
    records = _records(spark, d)
    model = R.Model()
    weight = lambda levels, share: F.round(sum(R.weights(levels, share, model).values(), F.lit(0.0)), 6)
    return R.told(records, model, R.address_frequency(records), lambda levels, share: {**levels, "weight": weight(levels, share)})


@query("lnk_full_resolve", f"""WITH {_LEVELS}, m AS MATERIALIZED (SELECT lo AS a, hi AS b FROM w WHERE weight >= 0 AND backed UNION SELECT hi, lo FROM w WHERE weight >= 0 AND backed),
 e AS (WITH RECURSIVE e AS (SELECT id, id AS n FROM r UNION SELECT e.id, m.b FROM e JOIN m ON e.n = m.a) SELECT id, min(n) AS entity FROM e GROUP BY 1),
 c AS (SELECT x.entity, min(weight) AS cohesion FROM w JOIN e x ON x.id = lo JOIN e y ON y.id = hi AND x.entity = y.entity WHERE weight >= 0 AND backed GROUP BY 1),
 t AS (SELECT entity, count(*) AS members, arg_min(id, (-(CAST(family IS NOT NULL AS INTEGER) + CAST(organization IS NOT NULL AS INTEGER) + CAST(phone IS NOT NULL AS INTEGER) + CAST(address_key IS NOT NULL AS INTEGER)), id)) AS representative FROM r JOIN e USING (id) GROUP BY 1)
 SELECT id, entity, members, round(cohesion, 6) AS cohesion, representative FROM e JOIN t USING (entity) LEFT JOIN c USING (entity)""")
def lnk_full_resolve(spark, d):
    out = R.resolve(_records(spark, d), cut, corroborate=True)
    return out.withColumn("cohesion", F.round("cohesion", 6))


@query("lnk_learned_resolve")
def lnk_learned_resolve(spark, d):
    """With shares estimated from the pairs, phones, and average linkage. Iterative: a test holds it to known people."""
    return R.resolve(_records(spark, d), cut, R.Model().with_phone(), threshold=2.0, corroborate=True, learn=True, linkage="average")


@query("lnk_pair_features", f"""WITH {_LEVELS} SELECT lo, hi, array_to_string(list_concat([CAST(given = 0 AS INTEGER), CAST(given = 1 AS INTEGER), CAST(given = 2 AS INTEGER), CAST(family = 0 AS INTEGER), CAST(family = 1 AS INTEGER), CAST(family = 2 AS INTEGER), CAST(org = 0 AS INTEGER), CAST(org = 1 AS INTEGER), CAST(org = 2 AS INTEGER)],
 [CAST(spatial = 0 AS INTEGER), CAST(spatial = 1 AS INTEGER), CAST(spatial = 2 AS INTEGER), CAST(spatial = 3 AS INTEGER), CAST(spatial = 4 AS INTEGER), CAST(spatial = 0 AND given = 2 AND family = 2 AS INTEGER), CAST(spatial = 0 AND org = 2 AS INTEGER)]), ',') AS features FROM w""")
def lnk_pair_features(spark, d):
    records = _records(spark, d)
    model = R.Model()
    return R.told(records, model, None, lambda levels, _: {"features": F.array_join(R.feature(levels, model).cast("array<string>"), ",")})


_TREES = B.Boosted(-1.0, 0.5, [B.Tree(0, 0, 25.0, B.Tree(-1.0), B.Tree(0, 1, 0.05, B.Tree(0.5), B.Tree(2.0))), B.Tree(0, 1, 0.02, B.Tree(-0.25), B.Tree(0.75))])


@query("lnk_boosted_score", "SELECT l_orderkey, l_linenumber, round(-1.0 + 0.5 * CASE WHEN l_quantity <= 25 THEN -1.0 WHEN l_discount <= 0.05 THEN 0.5 ELSE 2.0 END + 0.5 * CASE WHEN l_discount <= 0.02 THEN -0.25 ELSE 0.75 END, 9) AS score FROM lineitem")
def lnk_boosted_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(B.score(_TREES, F.array("l_quantity", "l_discount")), 9).alias("score"))


_T = ["", "Dr. ", "Mr ", "Prof. Dr. "]
_M = ["", "A. ", "Lee Ann "]
_P = ["", "van der ", "de ", ""]
_S = ["", " Jr.", " MD PhD", ""]


def _person(key):
    """A name of known parts: the written form and the parts, as columns and as SQL."""
    t, m, p, s = (pick_by_key(x, k) for x, k in ((_T, f"{key}"), (_M, f"{key}"), (_P, f"{key}"), (_S, f"{key}")))
    return t, m, p, s


@query("lnk_person_names", """SELECT id, nullif(trim(t), '') AS prefix, given, nullif(trim(m), '') AS middle, family, nullif(trim(p), '') AS family_particle, nullif(trim(s), '') AS suffix, CASE WHEN id % 11 = 0 THEN 'Buzz' END AS nickname FROM
 (SELECT c_custkey AS id, ['', 'Dr. ', 'Mr ', 'Prof. Dr. '][CAST(c_custkey % 4 + 1 AS INTEGER)] AS t, ['', 'A. ', 'Lee Ann '][CAST(c_custkey % 3 + 1 AS INTEGER)] AS m, ['', 'van der ', 'de ', '', ''][CAST(c_custkey % 5 + 1 AS INTEGER)] AS p, ['', ' Jr.', ' MD PhD', '', '', '', ''][CAST(c_custkey % 7 + 1 AS INTEGER)] AS s,
 ['Ada', 'Bo', 'Cy'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS given, ['Berg', 'Lima', 'Moss', 'Tran'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS family FROM customer)""")
def lnk_person_names(spark, d):
    """Written names whose parts the SQL knows: some turned round at a comma, some with a nickname."""
    pick = lambda values: pick_by_key(values, "c_custkey")[0]
    t, m, p, s = pick(_T), pick(_M), pick(["", "van der ", "de ", "", ""]), pick(["", " Jr.", " MD PhD", "", "", "", ""])
    given, family = pick(["Ada", "Bo", "Cy"]), pick(["Berg", "Lima", "Moss", "Tran"])
    nick = F.when(F.col("c_custkey") % 11 == 0, ' "Buzz" ').otherwise(" ")
    plain = F.concat(t, given, nick, m, p, family, s)
    turned = F.concat(p, family, F.lit(", "), t, given, nick, F.trim(m))
    comma = F.concat(t, given, nick, m, p, family, F.when(s != "", F.concat(F.lit(","), s)).otherwise(""))
    written = F.when((F.col("c_custkey") % 6 == 1) & (s == ""), turned).when(F.col("c_custkey") % 6 == 2, comma).otherwise(plain)
    n = N.person_name(F.col("w"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), written.alias("w")).select("id", n.alias("n")).select("id", "n.*")


_ORGS = "['The Acme & Sons, Inc.', 'Café Río S.A. de C.V.', 'Müller GmbH + Co. KG', 'North Star d/b/a Polaris LLC', 'O’Brien Holdings Limited', 'Físico PT Clinic PLLC']"


@query("lnk_organizations", f"SELECT c_custkey AS id, ['acme and sons', 'cafe rio de', 'muller and', 'north star', 'obrien holdings', 'fisico pt clinic'][CAST(c_custkey % 6 + 1 AS INTEGER)] AS canonical, ['inc', 'sa cv', 'gmbh co kg', '', 'limited', 'pllc'][CAST(c_custkey % 6 + 1 AS INTEGER)] AS designations, [NULL, NULL, NULL, 'polaris', NULL, NULL][CAST(c_custkey % 6 + 1 AS INTEGER)] AS dba FROM customer")
def lnk_organizations(spark, d):
    raw = pick_by_key(["The Acme & Sons, Inc.", "Café Río S.A. de C.V.", "Müller GmbH + Co. KG", "North Star d/b/a Polaris LLC", "O’Brien Holdings Limited", "Físico PT Clinic PLLC"], "c_custkey")[0]
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.organization_name(raw, "ID", "healthcare").alias("o"))
    return o.select("id", "o.canonical", F.array_join("o.designations", " ").alias("designations"), "o.dba")


_KEY = lambda c: f"nullif(trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"


@query("lnk_address_key", f"SELECT id, concat_ws('|', {', '.join(_KEY(c) for c in ('house_number', 'street', 'locality', 'region', 'postcode', 'country'))}) AS key FROM {ADDRESSES}")
def lnk_address_key(spark, d):
    a = addresses(spark, d)
    return a.select("id", N.address_key({c: F.col(c) for c in ("country", "postcode", "region", "locality", "street", "house_number")}).alias("key"))


@query("lnk_exact_keys", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN substring(lower(p_name), 1, 5) END AS key FROM part")
def lnk_exact_keys(spark, d):
    blank = F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    return table(spark, d, "part").select("p_partkey", F.get(N.exact_key(blank, 5), F.lit(0)).alias("key"))


@query("lnk_family_rollup", """WITH f AS (SELECT o_orderkey AS node, 'ein:' || ['acme', 'north star', 'blue river clinic'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS family, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) AS b FROM orders)
 SELECT family, count(*) AS nodes, CAST(min(a) AS VARCHAR) AS first_from FROM f WHERE a <= DATE '1997-06-30' AND b > DATE '1997-06-30' GROUP BY 1""")
def lnk_family_rollup(spark, d):
    """Members of families by canonical parent on a day, by half-open validity."""
    name = pick_by_key(["Acme, Inc.", "The North Star LLC", "Blue River Clinic PLLC"], "o_custkey")[0]
    start = F.to_date("o_orderdate")
    f = table(spark, d, "orders").select(N.family_id(F.lit("ein"), name).alias("family"), start.alias("a"), F.date_add(start, (F.col("o_orderkey") % 900).cast("int")).alias("b"))
    day = F.lit("1997-06-30").cast("date")
    return f.filter((F.col("a") <= day) & (F.col("b").isNull() | (F.col("b") > day))).groupBy("family").agg(F.count(F.lit(1)).alias("nodes"), F.min("a").cast("string").alias("first_from"))


@query("lnk_corroborated_codes", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'pinned' WHEN s_suppkey % 4 = 1 THEN 'none' WHEN s_suppkey % 4 = 2 THEN 'accepted' ELSE 'other' END AS basis, s_suppkey % 10 = 0 OR s_suppkey % 4 = 2 AS corroborated FROM supplier")
def lnk_corroborated_codes(spark, d):
    """Whether an industry code backs a candidate: pinned ones need none."""
    code = F.when(F.col("s_suppkey") % 4 == 1, " ").when(F.col("s_suppkey") % 4 == 2, "4813").otherwise("7372")
    basis = F.when(F.col("s_suppkey") % 10 == 0, "pinned").when(F.trim(code) == "", "none").when(F.trim(code).isin("4812", "4813", "4899"), "accepted").otherwise("other")
    return table(spark, d, "supplier").select("s_suppkey", basis.alias("basis"), basis.isin("pinned", "accepted").alias("corroborated"))


@query("lnk_mapping", "SELECT unnest(['id', 'organization', 'address', 'name', 'phone', 'email']) AS role, unnest(['NPI', 'Facility', 'Street,City,Zip Code', 'First Name,Last Name', 'Phone 1', 'E-Mail']) AS columns")
def lnk_mapping(spark, d):
    """Roles of columns by the words of their headers."""
    from granary.sources.ingest import infer_mapping

    found = infer_mapping(["NPI", "Facility", "Street", "City", "Zip Code", "First Name", "Last Name", "Phone 1", "E-Mail", "Notes"])
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found.items()], "role string, columns string")


@query("lnk_ingest", f"SELECT CAST(id AS VARCHAR) AS id, 'Ada' AS given, 'Moss' AS family, 'acme' AS organization, raw AS address, lower('X' || id || '@Example.org') AS email FROM {ADDRESSES}")
def lnk_ingest(spark, d):
    """Rows of a table with unknown headers as records."""
    from granary.sources.ingest import infer_mapping, records

    a = addresses(spark, d).select(
        F.concat(F.lit(" "), F.col("id").cast("string")).alias("NPI"), F.lit("Ada").alias("First Name"), F.lit(" Moss ").alias("Last Name"), F.lit("Acme, Inc.").alias("Company"),
        F.concat_ws(" ", "house_number", "street").alias("Street"), F.col("locality").alias("City"), F.concat_ws(" ", "region", "postcode").alias("State Zip"), F.concat(F.lit("X"), F.col("id").cast("string"), F.lit("@Example.org")).alias("Email"),
    )
    r = records(a, infer_mapping(a.columns))
    return r.select("id", "name.given", "name.family", "organization.canonical", "address", "email").withColumnRenamed("canonical", "organization")
