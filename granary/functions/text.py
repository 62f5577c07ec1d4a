"""Scalar text expressions. All are columns of built-in functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Designations that a canonical organization name leaves out.
DESIGNATIONS = ("inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa")


def collapse(c: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\x0B\\f\\r]+", " "))


def canonical(c: Column) -> Column:
    return F.lower(collapse(c))


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def pick(columns: list[str], separator: str = " ") -> Column:
    """The filled ones of some columns, trimmed, joined; null if none is filled."""
    return empty_to_null(F.concat_ws(separator, *[empty_to_null(F.col(c)) for c in columns]))


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits, apostrophes, underscores and hyphens."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9'_-]+"), lambda w: w != "")


def organization(c: Column) -> Column:
    """Lower case, punctuation to spaces, designations off."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(plain, lambda w: ~w.isin(*DESIGNATIONS)), " ")


def phone(c: Column) -> Column:
    """The last ten digits, or all if there are fewer; null without digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.nullif(F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits), F.lit(""))


def frequency_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def hash_bucket(c: Column, n: int) -> Column:
    """The first four bytes of SHA-256, big-endian, modulo n."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def source_id(adapter: Column, fields: dict[str, Column]) -> Column:
    """adapter-<12 hex digits> of the fields sorted by name; field and value parted by U+001F, fields by U+001E."""
    parts = [F.concat(F.lit(k + "\u001f"), F.coalesce(fields[k], F.lit(""))) for k in sorted(fields)]
    return F.concat(adapter, F.lit("-"), F.substring(F.sha2(F.concat_ws("\u001e", *parts), 256), 1, 12))


def word_shape(c: Column) -> Column:
    """A for capitals, a for small letters, 0 for digits."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def license_excluded(c: Column, prefixes: list[str]) -> Column:
    """Whether the license begins with any prefix, whatever the case."""
    return F.regexp_like(c, F.lit("(?i)^(" + "|".join(p.replace("-", "[-]").replace(".", "[.]") for p in prefixes) + ")"))


PO_BOX = "(?i)\\b(p\\.? ?o\\.? ?box|post office box)\\s*#?\\s*([0-9]+)"
US_ZIP = "\\b([0-9]{5})(-[0-9]{4})?\\b"
EMAIL = "[a-z0-9.]+@[a-z0-9.]+"


def po_box(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, PO_BOX, 2), F.lit(""))


def us_zip(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, US_ZIP, 1), F.lit(""))

# Fixed value: a house number may be two numbers with a hyphen, and may end in one letter.
HOUSE_NUMBER = "^(\\d+(?:-\\d+)?[A-Za-z]?)\\s+(\\S.*)$"


def street_line(c: Column) -> Column:
    """struct(house_number, street) of a line; no number where it doesn't begin with one, null for a blank line."""
    line = F.trim(c)
    number = F.nullif(F.regexp_extract(line, HOUSE_NUMBER, 1), F.lit(""))
    street = F.when(number.isNull(), line).otherwise(F.trim(F.regexp_extract(line, HOUSE_NUMBER, 2)))
    return F.when(line != "", F.struct(number.alias("house_number"), street.alias("street")))


def fnv1a(c: Column, salt: int = 0) -> Column:
    """32-bit FNV-1a over the code points of a string, each as one step; null for null.

    Equal to a hash over UTF-16 units for texts below U+10000.
    """
    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(F.ascii(unit).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))

    units = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(units, F.lit(2166136261 ^ salt).cast("long"), step)


def conjunction(*keys: Column) -> Column:
    """Every combination of one key of each array, joined by a bar; none where an array is empty."""
    def cross(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat_ws("|", x, y))))

    out = keys[0]
    for more in keys[1:]:
        out = cross(out, more)
    return F.filter(out, lambda x: x.isNotNull())


def address_id(state: Column, cell: Column, key: Column) -> Column:
    """<state>.<cell>.<16 hex digits of the key's SHA-256>."""
    return F.concat_ws(".", F.lower(state), cell, F.substring(F.sha2(key, 256), 1, 16))


def designations(c: Column) -> Column:
    """The designations of an organization's name, sorted."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.array_sort(F.filter(plain, lambda w: w.isin(*DESIGNATIONS)))


def name_evidence(a: Column, b: Column) -> Column:
    """How far two names with one canonical form agree: as written, but for spelling, or with other designations."""
    return F.when(a == b, 0.9).when(designations(a) == designations(b), 0.75).otherwise(0.5)
