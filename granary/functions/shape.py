"""The shape of a query text: token classes, known formats, segments, and what kind of query it may be."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that part tokens, and connectors, which part none inside a token.
PUNCT = "!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^`{|}~¡¿“”–—、。"
CONNECT = "'_‘’-"
SPACE = " \\t\\n\\r "
ALPHA = "A-Za-zÀ-ɏḀ-ỿ"
CYRILLIC = "Ѐ-ԯ"
ARABIC = "؀-ۿݐ-ݿ"
CJK = "぀-ヿ㐀-䶿一-鿿가-힯"
TOKENS = f"[^{SPACE}{PUNCT}{CONNECT}][^{SPACE}{PUNCT}]*"

# Postal formats of one token, and of two; confidence.
ONE = (("us_zip4", "\\d{5}-\\d{4}", 0.95), ("ca_postcode", "[A-Z]\\d[A-Z]\\d[A-Z]\\d", 0.95), ("jp_postcode", "\\d{3}-\\d{4}", 0.95), ("uk_postcode", "[A-Z]{1,2}\\d[A-Z\\d]?\\d[A-Z]{2}", 0.9), ("nl_postcode", "\\d{4}[A-Z]{2}", 0.9), ("us_zip", "\\d{5}", 0.6), ("fr_postcode", "\\d{5}", 0.6), ("de_postcode", "\\d{5}", 0.6))
TWO = (("uk_postcode", "[A-Z]{1,2}\\d[A-Z\\d]? \\d[A-Z]{2}", 0.9), ("ca_postcode", "[A-Z]\\d[A-Z] \\d[A-Z]\\d", 0.9), ("nl_postcode", "\\d{4} [A-Z]{2}", 0.9), ("cz_postcode", "\\d{3} \\d{2}", 0.6), ("sk_postcode", "\\d{3} \\d{2}", 0.6), ("se_postcode", "\\d{3} \\d{2}", 0.6), ("gr_postcode", "\\d{3} \\d{2}", 0.6))
COUNTRY_OF_POSTCODE = (("GB", "[A-Z]{1,2}\\d[A-Z\\d]?\\s?\\d[A-Z]{2}"), ("CA", "[A-Z]\\d[A-Z]\\s?\\d[A-Z]\\d"), ("IE", "(?:[A-Z]\\d{2}|D6W)\\s?[A-Z\\d]{4}"))
STREET_WORDS = ("st", "street", "ave", "avenue", "blvd", "boulevard", "rd", "road", "dr", "drive", "ln", "lane", "ct", "court", "pl", "place", "way", "pkwy", "parkway", "hwy", "highway", "cir", "circle")
LANDMARK = ("behind", "near", "across from", "opposite", "next to", "by the", "in front of", "close to", "beside")
CROSSING = "(?i)\\bcorner of\\b|\\bintersection of\\b|\\b\\w+ +(?:and|&|@) +\\w+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKENS), F.lit(0))


def token_class(t: Column) -> Column:
    """cjk, cyrillic, arabic, mixed, digit, alpha or other, by the characters that a token holds."""
    has = lambda x: F.regexp_like(t, F.lit(f"[{x}]"))
    out = F.when(has(CJK), "cjk").when(has(CYRILLIC), "cyrillic").when(has(ARABIC), "arabic")
    return out.when(has("0-9") & has(ALPHA), "mixed").when(has("0-9"), "digit").when(has(ALPHA), "alpha").otherwise("mixed")


def input_class(c: Column) -> Column:
    """The class of a whole text, from those of its tokens."""
    classes = F.transform(tokens(c), token_class)
    has = lambda x: F.array_contains(classes, x)
    scripts = ("cjk", "cyrillic", "arabic")
    out = F.when(F.size(classes) == 0, "alpha")
    for s in scripts:
        others = [has(x) for x in (*scripts, "alpha") if x != s]
        alone = has(s) & ~(others[0] | others[1] | others[2])
        out = out.when(alone, s)
    return out.when(has("cjk") | has("cyrillic") | has("arabic"), "mixed").when(has("mixed") | has("digit") & has("alpha"), "alphanumeric").when(has("digit"), "numeric").when(has("alpha"), "alpha").otherwise("mixed")


def known_formats(c: Column) -> Column:
    """array<struct<format, body, confidence>>: of each token, then of each two neighbours."""
    own = tokens(c)
    none = F.filter(F.array(F.struct(F.lit("").alias("format"), F.lit("").alias("body"), F.lit(0.0).alias("confidence"))), lambda x: x["format"] != "")

    def hits(body: Column, patterns: tuple) -> Column:
        found = F.array(*[F.when(F.regexp_like(body, F.lit(f"(?i)^{p}$")), F.struct(F.lit(f).alias("format"), body.alias("body"), F.lit(x).alias("confidence"))) for f, p, x in patterns])
        return F.filter(found, lambda x: x.isNotNull())

    one = F.flatten(F.transform(own, lambda t: hits(t, ONE)))
    pairs = F.transform(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", F.get(own, i), t))
    return F.concat(none, one, F.flatten(F.transform(pairs, lambda t: hits(t, TWO))))


def segments(c: Column) -> Column:
    """Parts between commas, semicolons and line ends, trimmed; empty ones are left out."""
    return F.filter(F.transform(F.split(c, "[,;\\n]"), lambda x: F.trim(x)), lambda x: x != "")


def whitespace_pattern(c: Column) -> Column:
    tab, double, single = c.contains("\t"), c.contains("  "), c.contains(" ")
    return F.when(tab & single, "mixed").when(tab, "tab").when(double, "double").when(single, "single").otherwise("none")


def countries_of_postcode(c: Column) -> Column:
    """Countries whose postcodes look like this; several share some forms, and plain digits say nothing."""
    code = F.trim(c)
    like = lambda p: F.regexp_like(code, F.lit(f"(?i)^{p}$"))
    out = F.when(like(COUNTRY_OF_POSTCODE[0][1]), F.array(F.lit(COUNTRY_OF_POSTCODE[0][0])))
    for country, p in COUNTRY_OF_POSTCODE[1:]:
        out = out.when(like(p), F.array(F.lit(country)))
    out = out.when(like("\\d{4}\\s?[A-Z]{2}"), F.array(F.lit("NL"))).when(like("\\d{3} \\d{2}"), F.array(*map(F.lit, ("CZ", "SK", "SE", "GR"))))
    return out.otherwise(F.array().cast("array<string>"))


def kind_scores(c: Column) -> dict[str, Column]:
    """How far a text may be of each kind of query, 0 to 1."""
    formats, parts, size = known_formats(c), F.size(segments(c)), F.length(c)
    shape, trimmed = input_class(c), F.trim(c)
    words = F.split(trimmed, "[\\s,]+")
    proper = (F.size(words) > 1) & F.forall(words, lambda w: F.regexp_like(w, F.lit("^[A-Z]")))
    numbered = F.regexp_like(trimmed, F.lit("\\s\\d+")) & ~F.regexp_like(trimmed, F.lit("^\\d"))
    no_venue = (F.length(trimmed) == 0) | (F.length(trimmed) > 50) | ~F.regexp_like(trimmed, F.lit("[A-Z]")) | (F.size(formats) > 0) | (parts > 2) | F.exists(words, lambda w: F.lower(w).isin(*STREET_WORDS)) | F.regexp_like(trimmed, F.lit("^\\d+\\s"))
    short = F.size(words).between(2, 4) & (parts == 1)
    venue = F.when(no_venue, 0.0).when(short & (numbered | proper), 0.88).when(short, 0.65).when((F.size(words) <= 6) & (parts == 1) & proper, 0.75).otherwise(0.0)
    hit = F.get(formats, F.lit(0))
    share = F.length(hit["body"]) / size
    postcode = F.when((size == 0) | (size > 16) | (F.size(formats) == 0), 0.0).when(share < 0.7, 0.0).otherwise(F.least(F.lit(1.0), hit["confidence"] * share + 0.1))
    locality = F.when((size == 0) | (size > 30) | (shape != "alpha") | (F.size(formats) > 0) | (parts > 2), 0.0).otherwise(0.85)
    alnum = shape == "alphanumeric"
    structured = F.when(size == 0, 0.0).when((parts >= 2) & alnum, 0.9).when((size >= 15) & alnum, 0.75).when(parts >= 2, 0.6).when(alnum, 0.4).otherwise(0.0)
    low = F.lower(trimmed)
    led = F.lit(False)
    for x in LANDMARK:
        led = led | low.startswith(x + " ") | (low == x)
    box = F.regexp_like(low, F.lit("\\b(p\\.?o\\.?( box)?|box|b\\.?p\\.?|casilla|apartado) #?\\d+"))
    return {
        "po_box": F.when(box, 1.0).otherwise(0.0), "intersection": F.when(F.regexp_like(c, F.lit(CROSSING)), 0.85).otherwise(0.0), "landmark": F.when(led, 0.9).otherwise(0.0),
        "venue": venue, "postcode_only": postcode, "locality_only": locality, "structured_address": structured, "vague": F.lit(0.3),
    }


def best_kind(c: Column) -> Column:
    """struct(score, kind) of the highest score; of equal ones, the kind that is listed first."""
    scores = list(kind_scores(c).items())
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(scores)]))
    first = F.get(ranked, F.lit(0))
    return F.struct((-first["s"]).alias("score"), first["kind"].alias("kind"))


def locale_of(c: Column) -> Column:
    """struct(confidence, locale): by script, by an unambiguous postal format, or else by default."""
    shape, formats = input_class(c), known_formats(c)
    sure = F.get(F.filter(formats, lambda x: x["confidence"] >= 0.9), F.lit(0))["format"]
    pair = lambda x, l: F.struct(F.lit(x).alias("confidence"), F.lit(l).alias("locale"))
    none = F.lit(None).cast("struct<confidence:double,locale:string>")
    script = F.when(shape == "cjk", pair(0.8, "ja-JP")).when(shape == "cyrillic", pair(0.85, "ru-RU")).when(shape == "arabic", pair(0.85, "ar")).otherwise(none)
    five = F.exists(formats, lambda x: x["format"].isin("us_zip", "fr_postcode"))
    code = F.when(sure == "us_zip4", pair(0.95, "en-US")).when(sure == "uk_postcode", pair(0.95, "en-GB")).when(sure == "ca_postcode", pair(0.9, "en-CA")).when(sure == "jp_postcode", pair(0.95, "ja-JP")).when(five, pair(0.5, "en-US")).otherwise(none)
    order = F.array_sort(F.array(*[F.struct(-F.coalesce(x["confidence"], F.lit(0.0)), F.lit(i), x.alias("x")) for i, x in enumerate((script, code, pair(0.3, "en-US")))]))
    return F.get(order, F.lit(0))["x"]


def us_street_parts(c: Column) -> Column:
    """struct(prefix, street, suffix) of a street's name: directions in front, street words or directions behind."""
    words = F.split(F.trim(c), "\\s+")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "\\.$", ""))
    n = F.size(words)
    direction = lambda w: w.isin("n", "s", "e", "w", "ne", "nw", "se", "sw", "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest")
    kind = lambda w: w.isin(*STREET_WORDS, "ter", "terrace", "sq", "square", "trail", "loop")
    front = F.when((n >= 2) & direction(F.get(plain, F.lit(0))), 1).otherwise(0)
    last, before = F.get(plain, n - 1), F.get(plain, n - 2)
    behind = F.when((n >= 2) & direction(last) & F.coalesce(kind(before), F.lit(False)), 2).when((n - front >= 2) & (kind(last) | direction(last)), 1).otherwise(0)
    join = lambda a, k: F.array_join(F.slice(words, a + 1, F.greatest(k, F.lit(0))), " ")
    street = join(front, n - front - behind)
    whole = (n == 1) | (street == "")
    return F.struct(F.when(~whole & (front == 1), F.get(words, F.lit(0))).alias("prefix"), F.when(whole, F.trim(c)).otherwise(street).alias("street"), F.when(~whole & (behind > 0), join(n - behind, behind)).alias("suffix"))
