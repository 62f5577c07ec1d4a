"""Normalization, folding, offsets, token classes, kinds and codes over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import identifiers as I
from granary.functions import normalize as N
from granary.functions import shape as S
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, addresses, table

_ONE = {k: v for k, v in N.PUNCTUATION.items() if len(v) == 1}
_Q = lambda s: "'" + s.replace("'", "''") + "'"
PLAIN = f"replace(translate({{0}}, {_Q(''.join(_ONE))}, {_Q(''.join(_ONE.values()))}), '…', '...')"
TIDY = f"regexp_replace(regexp_replace(regexp_replace({PLAIN}, '[ \\t]+', ' ', 'g'), '^[ \\t\\n\\r]+', ''), '[ \\t\\n\\r.,;:]+$', '')"


@query("txt_normalize", f"SELECT doc_id, sha256({TIDY.format('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def txt_normalize(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(N.normalize(F.col("text")), 256).alias("digest"))


@query("txt_unaccented", "SELECT doc_id, sha256(strip_accents(text)) AS digest FROM documents WHERE text IS NOT NULL")
def txt_unaccented(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(N.unaccented(F.col("text")), 256).alias("digest"))


_EN = ", ".join(f"'{k}': '{v}'" for k, v in N.ABBREVIATIONS["en"].items())


@query("txt_abbreviations", f"SELECT id, list_aggregate(list_transform(regexp_extract_all(raw, '[\\p{{L}}\\p{{N}}''_-]+\\.?|[^\\p{{L}}\\p{{N}}''_-]+'), lambda p: coalesce(MAP {{{_EN}}}[lower(regexp_replace(p, '\\.$', ''))], p)), 'string_agg', '') AS text FROM {ADDRESSES}")
def txt_abbreviations(spark, d):
    return addresses(spark, d).select("id", N.abbreviations(F.col("raw")).alias("text"))


@query("txt_offsets", f"SELECT id, {TIDY.format('raw')} AS text, len({TIDY.format('raw')}) AS n, true AS faithful FROM {ADDRESSES}")
def txt_offsets(spark, d):
    """The normalized text with the place of each character in the raw one; unchanged characters stand there."""
    raw = F.concat(F.lit("  "), F.replace(F.col("raw"), F.lit(", "), F.lit(",  ")), F.lit(" ;"))
    a = addresses(spark, d).select("id", raw.alias("odd")).repartition("id")  # few bytes, much work: on all cores
    m = N.text_and_map(N.whitespace_with_offsets(N.punctuation_with_offsets(N.characters(F.col("odd")))))

    def checked(m):
        there = lambda k: F.substring(F.col("odd"), F.element_at(m["map"], k) + 1, F.lit(1))
        same = F.forall(F.sequence(F.lit(1), F.length(m["text"])), lambda k: N.bound(there(k), lambda c: (F.substring(m["text"], k, F.lit(1)) == c) | c.isin(*N.PUNCTUATION)))
        return F.struct(m["text"].alias("text"), F.size(m["map"]).cast("long").alias("n"), same.alias("faithful"))

    return a.select("id", N.bound(m, checked).alias("m")).select("id", "m.*")


@query("txt_fold_key", f"SELECT id, trim(regexp_replace(regexp_replace(lower(strip_accents(raw)), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM {ADDRESSES}")
def txt_fold_key(spark, d):
    return addresses(spark, d).select("id", N.fold(F.col("raw")).alias("key"))


_TOK = lambda c: f"regexp_extract_all({c}, " + _Q(S.TOKENS) + ")"
_HAS = lambda x: f"regexp_matches(t, '[{x}]')"
_CLASS = f"CASE WHEN {_HAS(S.CJK)} THEN 'cjk' WHEN {_HAS(S.CYRILLIC)} THEN 'cyrillic' WHEN {_HAS(S.ARABIC)} THEN 'arabic' WHEN {_HAS('0-9')} AND {_HAS(S.ALPHA)} THEN 'mixed' WHEN {_HAS('0-9')} THEN 'digit' WHEN {_HAS(S.ALPHA)} THEN 'alpha' ELSE 'mixed' END"


@query("shp_token_classes", f"SELECT lang, class, count(*) AS n FROM (SELECT lang, {_CLASS} AS class FROM (SELECT lang, unnest({_TOK('text')}) AS t FROM documents)) GROUP BY 1, 2")
def shp_token_classes(spark, d):
    t = table(spark, d, "documents").select("lang", F.explode(S.tokens(F.col("text"))).alias("t"))
    return t.select("lang", S.token_class(F.col("t")).alias("class")).groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = f"list_transform({_TOK('raw')}, lambda t: {_CLASS})"
_FOLD = "CASE WHEN len(k) = 0 THEN 'alpha' WHEN list_contains(k, 'mixed') OR (list_contains(k, 'digit') AND list_contains(k, 'alpha')) THEN 'alphanumeric' WHEN list_contains(k, 'digit') THEN 'numeric' ELSE 'alpha' END"


@query("shp_query_shape", f"""SELECT id, {_FOLD} AS class, len(list_filter(list_transform(regexp_split_to_array(raw, '[,;\\n]'), lambda x: trim(x)), lambda x: x <> '')) AS segments,
 3 * len(list_filter({_TOK('raw')}, lambda t: regexp_matches(t, '^[0-9]{{5}}$'))) AS formats, CASE WHEN raw LIKE '%  %' THEN 'double' ELSE 'single' END AS spaces FROM (SELECT id, raw, {_CLASSES} AS k FROM {ADDRESSES})""")
def shp_query_shape(spark, d):
    raw = F.col("raw")
    return addresses(spark, d).select("id", S.input_class(raw).alias("class"), F.size(S.segments(raw)).cast("long").alias("segments"), F.size(S.known_formats(raw)).cast("long").alias("formats"), S.whitespace_pattern(raw).alias("spaces"))


_MIX = "CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN raw WHEN 1 THEN postcode WHEN 2 THEN locality WHEN 3 THEN 'near ' || locality WHEN 4 THEN 'PO Box ' || house_number ELSE 'Oak and Main' END"


@query("shp_kind", f"""SELECT id, CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN 'structured_address' WHEN 1 THEN 'postcode_only' WHEN 2 THEN CASE WHEN locality IN ('New York') THEN 'venue' ELSE 'locality_only' END WHEN 3 THEN 'landmark' WHEN 4 THEN 'po_box' ELSE 'intersection' END AS kind,
 CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN CASE WHEN locality = 'New York' THEN 0.88 ELSE 0.85 END WHEN 3 THEN 0.9 WHEN 4 THEN 1.0 ELSE CASE WHEN true THEN 0.85 END END AS score FROM {ADDRESSES}""")
def shp_kind(spark, d):
    """Texts of six known kinds, by the key; the SQL knows which."""
    a = addresses(spark, d)
    mix = F.when(F.col("id") % 6 == 0, F.col("raw")).when(F.col("id") % 6 == 1, F.col("postcode")).when(F.col("id") % 6 == 2, F.col("locality")).when(F.col("id") % 6 == 3, F.concat(F.lit("near "), F.col("locality"))).when(F.col("id") % 6 == 4, F.concat(F.lit("PO Box "), F.col("house_number"))).otherwise("Oak and Main")
    k = S.best_kind(F.col("q"))
    return a.select("id", mix.alias("q")).select("id", k["kind"].alias("kind"), F.round(k["score"], 6).alias("score"))


@query("shp_locale", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'en-GB' WHEN id % 3 = 1 THEN 'en-US' ELSE 'ru-RU' END AS locale, CASE WHEN id % 3 = 0 THEN 0.95 WHEN id % 3 = 1 THEN 0.5 ELSE 0.85 END AS confidence FROM {ADDRESSES}")
def shp_locale(spark, d):
    """Texts whose locale their key fixes: a British postcode, five digits, or Cyrillic."""
    q = F.when(F.col("id") % 3 == 0, F.concat(F.col("locality"), F.lit(" SW1A 1AA"))).when(F.col("id") % 3 == 1, F.col("raw")).otherwise("улица Ленина")
    l = S.locale_of(F.col("q"))
    return addresses(spark, d).select("id", q.alias("q")).select("id", l["locale"].alias("locale"), l["confidence"].alias("confidence"))


@query("shp_postcode_countries", f"SELECT id, CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 'GB' WHEN 1 THEN 'NL' WHEN 2 THEN 'CZ,SK,SE,GR' ELSE '' END AS countries FROM {ADDRESSES}")
def shp_postcode_countries(spark, d):
    n = F.col("house_number")
    code = F.when(F.col("id") % 4 == 0, "EC1A 1BB").when(F.col("id") % 4 == 1, F.concat(F.lpad(n, 4, "1"), F.lit(" ab"))).when(F.col("id") % 4 == 2, F.concat(F.lpad(n, 3, "1"), F.lit(" 00"))).otherwise(F.col("postcode"))
    return addresses(spark, d).select("id", F.array_join(S.countries_of_postcode(code), ",").alias("countries"))


_DIR = "'n', 's', 'e', 'w', 'ne', 'nw', 'se', 'sw', 'north', 'south', 'east', 'west', 'northeast', 'northwest', 'southeast', 'southwest'"


@query("txt_street_parts", f"""WITH a AS (SELECT id, string_split(trim(street), ' ') AS w FROM {ADDRESSES}), b AS (SELECT id, w, len(w) AS n, CASE WHEN len(w) >= 2 AND lower(w[1]) IN ({_DIR}) THEN 1 ELSE 0 END AS f, regexp_replace(lower(w[-1]), '\\.$', '') AS l FROM a),
 c AS (SELECT *, CASE WHEN n - f >= 2 AND l IN ('st', 'ave', 'blvd', 'rd', 'lane') THEN 1 ELSE 0 END AS k FROM b) SELECT id, CASE WHEN f = 1 THEN w[1] END AS prefix, array_to_string(w[f + 1:n - k], ' ') AS street, CASE WHEN k = 1 THEN w[-1] END AS suffix FROM c""")
def txt_street_parts(spark, d):
    return addresses(spark, d).select("id", S.us_street_parts(F.col("street")).alias("p")).select("id", "p.*")


@query("txt_codes", """SELECT c_custkey, CASE WHEN c_custkey < 10000000000 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS frn, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik,
 strftime(DATE '1990-01-01' + CAST(c_custkey % 9000 AS INTEGER), '%Y-%m-%d') AS day, c_custkey % 7 <> 0 AS valid FROM customer""")
def txt_codes(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    day = F.date_add(F.lit("1990-01-01").cast("date"), (key % 9000).cast("int"))
    written = F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))
    iso = F.when(key % 7 == 0, F.lit("1999-02-30")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    cik = F.when(key % 5 == 0, F.concat(key.cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), key.cast("string")))
    return c.select("c_custkey", I.padded_code(key.cast("string")).alias("frn"), I.padded_code(cik).alias("cik"), I.us_date(written).alias("day"), I.is_iso_date(iso).alias("valid"))


@query("txt_geoids", """SELECT l_orderkey, l_linenumber, lpad(CAST(l_suppkey % 56 + 1 AS VARCHAR), 2, '0') AS state, lpad(CAST(l_suppkey % 500 AS VARCHAR), 3, '0') AS county, lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') AS tract,
 CASE WHEN l_linenumber % 2 = 0 THEN lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') END AS block, CASE WHEN l_linenumber % 2 = 0 THEN 'block' ELSE 'tract' END AS level FROM lineitem""")
def txt_geoids(spark, d):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    full = F.concat(pad(F.col("l_suppkey") % 56 + 1, 2), pad(F.col("l_suppkey") % 500, 3), pad(F.col("l_partkey") % 1000000, 6), F.when(F.col("l_linenumber") % 2 == 0, pad(F.col("l_orderkey") % 10000, 4)).otherwise(""))
    g = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.geoid(full).alias("g"))
    return g.select("l_orderkey", "l_linenumber", "g.state", "g.county", "g.tract", "g.block", "g.level")


@query("txt_softmax", "WITH e AS (SELECT user_id, event_type, exp(avg(value) - max(avg(value)) OVER (PARTITION BY user_id)) AS x FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, round(x / sum(x) OVER (PARTITION BY user_id), 9) AS share FROM e")
def txt_softmax(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    whole = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))  # a few types a user
    return whole.select("user_id", F.explode(I.softmax(F.col("m"))).alias("event_type", "share")).select("user_id", "event_type", F.round("share", 9).alias("share"))


@query("txt_even_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def txt_even_rounding(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("half"))


@query("txt_feature_hash", """WITH g AS (SELECT p_partkey, unnest([3, 4, 5]) AS n, '^' || lower(p_name) || '$' AS t FROM part), x AS (SELECT p_partkey, substring(t, CAST(i AS INTEGER), n) AS gram FROM g, range(1, 64) r(i) WHERE i <= len(t) - n + 1),
 h AS (SELECT p_partkey, CAST(('0x' || substring(sha256(gram), 1, 8)) AS BIGINT) % 65536 AS bucket FROM x) SELECT p_partkey, bucket, count(*) AS n FROM h GROUP BY 1, 2""")
def txt_feature_hash(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(I.gram_buckets(F.col("p_name"), (3, 4, 5), 65536)).alias("bucket"))
    return p.groupBy("p_partkey", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("txt_json_modes", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS k, event_id % 10 = 0 AS broken FROM events")
def txt_json_modes(spark, d):
    """Tolerant reading: a broken object is null and marked; from_json in FAILFAST mode would end the job."""
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    parsed = F.from_json(text, "k bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").cast("string").alias("k"), F.col("p._bad").isNotNull().alias("broken"))
