"""Text normalization without Python workers: tables of characters are built from Unicode's own data when loaded."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic signs and what stands for them in plain text.
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "−": "-", "―": "-", "﹣": "-", "…": "...", " ": " "}

# Abbreviations of street words by language, lower case.
ABBREVIATIONS = {
    "en": {"n": "North", "s": "South", "e": "East", "w": "West", "ne": "Northeast", "nw": "Northwest", "se": "Southeast", "sw": "Southwest", "st": "Street", "ave": "Avenue", "blvd": "Boulevard", "rd": "Road", "dr": "Drive", "ct": "Court", "ln": "Lane", "pl": "Place", "pkwy": "Parkway", "hwy": "Highway", "sq": "Square", "ter": "Terrace"},
    "fr": {"r": "Rue", "bd": "Boulevard", "av": "Avenue", "bvd": "Boulevard", "pl": "Place", "imp": "Impasse", "sq": "Square"},
    "es": {"av": "Avenida", "avda": "Avenida", "avd": "Avenida"},
    "und": {"bd": "Boulevard", "bvd": "Boulevard", "boul": "Boulevard", "av": "Avenue", "imp": "Impasse"},
}
#: What a token holds; all else parts tokens.
TOKEN = "\\p{L}\\p{N}'_-"


def punctuation(c: Column) -> Column:
    """Typographic quotes, dashes, ellipses and spaces as plain ones."""
    one = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in PUNCTUATION.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


@lru_cache(maxsize=1)
def _cjk() -> tuple[str, str, dict[str, str]]:
    wide = {chr(i): unicodedata.normalize("NFKC", chr(i)) for i in [*range(0xFF01, 0xFF5F), 0x3000, *range(0xFF61, 0xFFA0)]}
    voiced = {}
    for base in (chr(i) for i in range(0xFF66, 0xFF9E)):
        for mark in "ﾞﾟ":
            both = unicodedata.normalize("NFKC", base + mark)
            if len(both) == 1:
                voiced[base + mark] = both
    return "".join(wide), "".join(wide.values()), voiced


def cjk(c: Column) -> Column:
    """Full-width signs and half-width kana in their usual width; the postal mark goes."""
    one, to, voiced = _cjk()
    out = F.replace(c, F.lit("〒"), F.lit(""))
    for k, v in voiced.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.translate(out, one, to)


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str, dict[str, str]]:
    """Letters of the Latin blocks whose compatibility decomposition is plain letters and marks."""
    one, many = {}, {}
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if plain != chr(i) and plain.isascii() and plain.isalpha():
            (one if len(plain) == 1 else many)[chr(i)] = plain
    return "".join(one), "".join(one.values()), many


def unaccented(c: Column) -> Column:
    """Latin letters without their marks; marks that stand alone (U+0300 to U+036F) go."""
    one, to, many = _latin()
    out = F.regexp_replace(F.translate(c, one, to), "[̀-ͯ]", "")
    for k, v in many.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def whitespace(c: Column) -> Column:
    """Runs of blanks and tabs as one blank; no white space in front, and neither it nor .,;: behind. Lines stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "^[ \\t\\n\\r]+", ""), "[ \\t\\n\\r.,;:]+$", "")


def abbreviations(c: Column, locale: str = "en") -> Column:
    """Abbreviated street words written out, with the dot behind them taken away; other tokens stay."""
    known = next((v for k, v in ABBREVIATIONS.items() if locale.lower().startswith(k)), ABBREVIATIONS["en"])
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    parts = F.regexp_extract_all(c, F.lit(f"[{TOKEN}]+\\.?|[^{TOKEN}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(pairs, F.lower(F.regexp_replace(p, "\\.$", ""))), p)), "")


def normalize(c: Column, locale: str | None = None) -> Column:
    """Width, punctuation, white space, and with a locale abbreviations. Texts should be in composed form."""
    out = whitespace(punctuation(cjk(c)))
    return abbreviations(out, locale) if locale else out


def fold(c: Column) -> Column:
    """For comparison: lower case, no marks, apostrophes away, other signs to single blanks."""
    plain = F.lower(unaccented(c))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "['’`]", ""), "[^a-z0-9]+", " "))


# --- offsets: a text as an array of (character, place in the raw text)

def characters(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x, i: F.struct(x.alias("c"), i.alias("i")))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often it is used, and not anew for each element of an array."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def punctuation_with_offsets(chars: Column) -> Column:
    """Each character that stands for a sign points to it."""
    known = F.create_map(*[F.lit(x) for kv in PUNCTUATION.items() for x in kv])

    def plain(x: Column) -> Column:
        each = lambda s: F.transform(F.filter(F.split(s, ""), lambda y: y != ""), lambda y: F.struct(y.alias("c"), x["i"].alias("i")))
        out = lambda s: F.when(F.length(s) == 1, F.array(F.struct(s.alias("c"), x["i"].alias("i")))).otherwise(each(s))
        return F.when(x["c"].isin(*PUNCTUATION), bound(F.element_at(known, x["c"]), out)).otherwise(F.array(F.struct(x["c"].alias("c"), x["i"].alias("i"))))

    return F.flatten(F.transform(chars, plain))


def whitespace_with_offsets(chars: Column) -> Column:
    """A run of blanks is the blank that it begins with; what whitespace() cuts off is left out."""
    inline = lambda x: x["c"].isin(" ", "\t")

    def runs(chars: Column) -> Column:
        kept = F.filter(chars, lambda x, i: ~(inline(x) & (i > 0) & inline(F.coalesce(F.get(chars, i - 1), F.struct(F.lit("x").alias("c"), F.lit(0).alias("i"))))))
        return F.transform(kept, lambda x: F.struct(F.when(x["c"] == "\t", " ").otherwise(x["c"]).alias("c"), x["i"].alias("i")))

    def trimmed(kept: Column) -> Column:
        def within(text: Column) -> Column:
            behind = F.regexp_replace(text, "^[ \\t\\n\\r]+", "")
            return F.slice(kept, F.length(text) - F.length(behind) + 1, F.length(F.regexp_replace(behind, "[ \\t\\n\\r.,;:]+$", "")))

        return bound(F.array_join(F.transform(kept, lambda x: x["c"]), ""), within)

    return bound(bound(chars, runs), trimmed)


def text_and_map(chars: Column) -> Column:
    """struct(text, map): map[k] is the place in the raw text of the text's character k."""
    return bound(chars, lambda x: F.struct(F.array_join(x["c"], "").alias("text"), x["i"].alias("map")))
