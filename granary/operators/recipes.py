"""Training rows by templates: components and the spans that they fill are known when the text is written.

A recipe turns rows of address parts into rows of raw text with components, spans and labels. Choices are draws by the
row's key and a seed, so that reruns and other partitionings give the same rows.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.random import bucket
from granary.functions.shape import us_street_parts

#: A piece of a template: a tag and its value (a column, or the name of a part), or text between.
Piece = tuple[str, Column | str] | str


@dataclass(frozen=True)
class Form:
    """One way to write a row: pieces in order. A null or empty value drops its piece and the text before it."""

    name: str
    pieces: tuple[Piece, ...]


def written(forms: list[Form], choice: Column) -> Column:
    """struct(template, raw, components, spans array<struct<start, end, tag>>) of the form that the choice names by number."""
    def one(form: Form) -> Column:
        parts, glue = [], ""
        for p in form.pieces:
            if isinstance(p, str):
                glue += p
            else:
                tag, value = p
                value = F.trim(F.col(value)) if isinstance(value, str) else value
                parts.append(F.struct(F.lit(glue).alias("before"), F.lit(tag).alias("tag"), F.coalesce(value.cast("string"), F.lit("")).alias("value")))
                glue = ""
        kept = F.filter(F.array(*parts), lambda x: x["value"] != "")
        start = F.struct(F.lit("").alias("raw"), F.array().cast("array<struct<start:int,end:int,tag:string>>").alias("spans"))

        def add(acc: Column, x: Column) -> Column:
            before = F.when(acc["raw"] == "", F.trim(x["before"])).otherwise(x["before"])
            text = F.concat(acc["raw"], before)
            a = F.length(text)
            span = F.struct(a.alias("start"), (a + F.length(x["value"])).alias("end"), x["tag"].alias("tag"))
            return F.struct(F.concat(text, x["value"]).alias("raw"), F.when(x["tag"] == "", acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

        done = F.aggregate(kept, start, add)
        tagged = F.filter(kept, lambda x: x["tag"] != "")
        values = F.map_from_entries(F.transform(tagged, lambda x: F.struct(x["tag"].alias("k"), x["value"].alias("v"))))
        return F.transform(F.array(done), lambda r: F.struct(F.lit(form.name).alias("template"), r["raw"].alias("raw"), values.alias("components"), r["spans"].alias("spans")))[0]

    out = F.when(choice == 0, one(forms[0]))
    for i, form in enumerate(forms[1:], 1):
        out = out.when(choice == i, one(form))
    return out


def labels(raw: Column, spans: Column) -> Column:
    """struct(tokens, labels): words of letters, digits, marks and '_- with B- and I- tags of the span that holds them."""
    words = F.regexp_extract_all(raw, F.lit("[\\p{L}\\p{N}\\p{M}'_-]+|[^\\p{L}\\p{N}\\p{M}'_-]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<t:string,l:string>>").alias("out"))

    def add(acc: Column, w: Column) -> Column:
        a, b = acc["at"], acc["at"] + F.length(w)
        inside = F.get(F.filter(spans, lambda s: (s["start"] <= a) & (b <= s["end"])), F.lit(0))
        first = ~F.regexp_like(F.substring(raw, inside["start"] + 1, a - inside["start"]), F.lit("[\\p{L}\\p{N}\\p{M}'_-]"))
        label = F.when(inside.isNull(), "O").when(first, F.concat(F.lit("B-"), inside["tag"])).otherwise(F.concat(F.lit("I-"), inside["tag"]))
        token = F.regexp_like(w, F.lit("[\\p{L}\\p{N}\\p{M}'_-]"))
        return F.struct(b.alias("at"), F.when(token, F.concat(acc["out"], F.array(F.struct(w.alias("t"), label.alias("l"))))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(words, start, add)["out"]
    return F.struct(F.transform(done, lambda x: x["t"]).alias("tokens"), F.transform(done, lambda x: x["l"]).alias("labels"))


@dataclass(frozen=True)
class Recipe:
    """rows: parts -> rows that it takes, with any parts that it adds; forms and choice: how each is written."""

    name: str
    country: str
    locale: str
    prepare: Callable[[DataFrame, str], DataFrame]
    forms: Callable[[], list[Form]]
    choice: Callable[[str], Column]
    license: str = "Synthetic"


RECIPES: dict[str, Recipe] = {}
#: Columns of the parts that recipes read; all are texts, and id is a number.
PARTS = ("id", "house_number", "street", "locality", "region", "postcode", "country")


def recipe(name: str, country: str, locale: str, choice: Callable[[str], Column], needs: tuple[str, ...]) -> Callable:
    def keep(make: Callable[[], list[Form]]) -> Callable[[], list[Form]]:
        def prepare(df: DataFrame, seed: str) -> DataFrame:
            for c in needs:
                df = df.filter(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
            return df

        RECIPES[name] = Recipe(name, country, locale, prepare, make, choice)
        return make

    return keep


def run(name: str, parts: DataFrame, seed: str = "0") -> DataFrame:
    """source_id, source, country, locale, license, template, raw, components, spans, tokens, labels of every row taken.

    A row that lacks a part that the recipe needs is left out, as is one whose text would be empty.
    """
    r = RECIPES[name]
    rows = r.prepare(parts, seed).withColumn("_w", written(r.forms(), r.choice(seed)))
    rows = rows.filter(F.col("_w.raw") != "").withColumn("_l", labels(F.col("_w.raw"), F.col("_w.spans")))
    source = f"synth-{name}"
    source_id = T.source_id(F.lit(source), {"raw": F.col("_w.raw"), "v": F.col("id").cast("string")})
    country = F.lit(r.country) if r.country else F.col("country")
    return rows.select("id", source_id.alias("source_id"), F.lit(source).alias("source"), country.alias("country"), F.lit(r.locale).alias("locale"), F.lit(r.license).alias("license"), "_w.*", "_l.*")


def _c(tag: str, name: str | None = None) -> Piece:
    return tag, name or tag


def by_number(n: int) -> Callable[[str], Column]:
    """Forms in turn, by the row's number."""
    return lambda seed: (F.col("id") % n).cast("int")


def by_draw(n: int, what: str) -> Callable[[str], Column]:
    return lambda seed: bucket(n, F.lit(f"{seed}/{what}"), F.col("id").cast("string"))


def draw(values: tuple[str, ...], what: str) -> Column:
    """One of some texts, by a draw of the row's key."""
    return F.element_at(F.array(*map(F.lit, values)), bucket(len(values), F.lit(what), F.col("id").cast("string")) + 1)


NUMBER, STREET, TOWN, REGION, CODE = (_c(x) for x in ("house_number", "street", "locality", "region", "postcode"))
FULL = ("house_number", "street", "locality", "postcode")

# Words before a box number by country, units, and signs of a crossing.
BOXES = {"US": ("PO Box", "P.O. Box", "P.O.Box", "PO BOX", "POB", "Post Office Box", "Box"), "DE": ("Postfach",), "FR": ("BP", "B.P.", "Boîte Postale", "BP."), "ES": ("Apdo.", "Apdo", "Apartado", "Apartado de Correos")}
UNITS = ("Apt", "Unit", "Suite", "Ste", "#")
CROSSINGS = (" & ", " and ", " at ", " / ", " @ ")
VENUES = ("Bob's Pizza", "Acme Corporation", "Joe's Diner", "Sunrise Bakery", "Maple Leaf Cafe", "Wall Street Industries", "Park Avenue Dental", "Main Street Bakery", "Hill Street Blues Bar")


@recipe("po-box", "", "und", by_number(2), ("locality", "postcode"))
def po_box() -> list[Form]:
    leader = F.lit(None).cast("string")
    for country, words in BOXES.items():
        leader = F.when(F.col("country") == country, draw(words, "box")).otherwise(leader)
    box = ("po_box", F.concat_ws(" ", F.coalesce(leader, F.lit("PO Box")), (F.col("id") * 37 % 9900 + 1).cast("string")))
    return [Form("po-box", (box, ", ", TOWN, ", ", REGION, " ", CODE)), Form("po-box-plain", (box, ", ", TOWN, " ", CODE))]


@recipe("po-box-military", "US", "en-US", by_number(3), ())
def military() -> list[Form]:
    unit = ("po_box", F.concat_ws(" ", draw(("PSC", "CMR", "Unit"), "unit"), (F.col("id") * 13 % 9999 + 1).cast("string"), F.lit("Box"), (F.col("id") * 7 % 9999 + 1).cast("string")))
    town = ("locality", draw(("APO", "FPO", "DPO"), "office"))
    code = lambda prefix, n, low: ("postcode", F.concat(F.lit(prefix), F.lpad((low + F.col("id") % n).cast("string"), 5 - len(prefix), "0")))
    return [Form("military", (unit, ", ", town, " ", ("region", F.lit(r)), " ", c)) for r, c in (("AE", code("09", 1000, 0)), ("AP", code("96", 100, 200)), ("AA", code("340", 100, 0)))]


@recipe("no-street", "", "und", by_number(6), ("locality", "region", "postcode"))
def no_street() -> list[Form]:
    venue = ("venue", draw(VENUES, "venue"))
    return [
        Form("venue-plain", (venue, ", ", TOWN, ", ", REGION, " ", CODE)), Form("locality-region-postcode", (TOWN, ", ", REGION, " ", CODE)), Form("locality-region", (TOWN, ", ", REGION)),
        Form("postcode-only", (CODE,)), Form("country-only", (_c("country"),)), Form("venue-locality", (venue, ", ", TOWN)),
    ]


@recipe("house-venue", "", "und", by_number(2), FULL)
def house_venue() -> list[Form]:
    venue = ("venue", draw(VENUES, "venue"))
    tail = (", ", TOWN, ", ", REGION, " ", CODE)
    return [Form("venue-after-street", (NUMBER, " ", STREET, ", ", venue, *tail)), Form("venue-before-street", (venue, ", ", NUMBER, " ", STREET, *tail))]


@recipe("intersection", "US", "en-US", by_number(3), ("street", "locality"))
def intersection() -> list[Form]:
    other = ("intersection_b", draw(("5th Ave", "N Broadway", "42nd St", "Elm Blvd"), "cross"))
    one, sign = ("intersection_a", F.trim(F.col("street"))), ("", draw(CROSSINGS, "sign"))
    return [Form("bare", (one, sign, other)), Form("corner", (("", F.lit("corner of ")), one, sign, other)), Form("with-town", (one, sign, other, ", ", TOWN, ", ", REGION))]


@recipe("bare-country", "", "und", by_number(1), ("country",))
def bare_country() -> list[Form]:
    return [Form("country", (_c("country"),))]


@recipe("nl-postcode", "NL", "nl-NL", by_number(6), FULL)
def nl_postcode() -> list[Form]:
    digits = F.substring(F.regexp_replace("postcode", "[^0-9]", ""), 1, 4)
    letters = draw(("AB", "XZ", "KL"), "letters")
    out = []
    for glue in ("", " "):
        code = ("postcode", F.concat(digits, F.lit(glue), letters))
        out += [Form("street-first", (STREET, " ", NUMBER, ", ", code, " ", TOWN)), Form("postcode-first", (code, " ", TOWN, ", ", STREET, " ", NUMBER)), Form("town-first", (TOWN, ", ", code, ", ", STREET, " ", NUMBER))]
    return out


@recipe("cz-pcfirst-preposition", "CZ", "cs-CZ", by_number(4), FULL)
def cz() -> list[Form]:
    code = ("postcode", F.when(F.col("id") % 2 == 0, F.concat_ws(" ", F.substring("postcode", 1, 3), F.substring("postcode", 4, 2))).otherwise(F.col("postcode")))
    town = ("locality", F.concat(F.trim(F.col("locality")), F.lit(" nad Labem")))
    return [Form("postcode-first", (code, " ", town, ", ", STREET, " ", NUMBER)), Form("street-first", (STREET, " ", NUMBER, ", ", code, " ", town)), Form("town-first", (town, ", ", code, ", ", STREET, " ", NUMBER)), Form("streetless", (town, " ", code, ", ", ("country", F.lit("Česko"))))]


@recipe("no-street-led", "NO", "nb-NO", by_number(3), FULL)
def no_street_led() -> list[Form]:
    return [Form("street-led", (STREET, " ", NUMBER, ", ", CODE, " ", TOWN)), Form("town-led", (TOWN, ", ", CODE, ", ", STREET, " ", NUMBER)), Form("postcode-led", (CODE, " ", TOWN, ", ", STREET, " ", NUMBER))]


@recipe("no-fragment", "NO", "nb-NO", by_number(4), ("street",))
def no_fragment() -> list[Form]:
    return [Form("street", (STREET,)), Form("street-number", (STREET, " ", NUMBER)), Form("town", (TOWN,)), Form("postcode", (CODE,))]


@recipe("si-bare-village", "SI", "sl-SI", by_number(3), ("locality", "house_number"))
def si() -> list[Form]:
    village = ("street", F.trim(F.col("locality")))
    return [Form("with-postcode", (village, " ", NUMBER, ", ", CODE, " ", TOWN)), Form("bare", (village, " ", NUMBER, ", ", TOWN)), Form("postcode-first", (CODE, " ", TOWN, ", ", village, " ", NUMBER))]


@recipe("fr-order", "FR", "fr-FR", by_number(5), FULL)
def fr_order() -> list[Form]:
    return [
        Form("canonical", (NUMBER, " ", STREET, ", ", CODE, " ", TOWN)), Form("postcode-town-first", (CODE, " ", TOWN, ", ", NUMBER, " ", STREET)), Form("town-first", (TOWN, ", ", CODE, ", ", NUMBER, " ", STREET)),
        Form("postcode-last", (TOWN, " ", NUMBER, " ", STREET, " ", CODE)), Form("postcode-alone-first", (CODE, ", ", NUMBER, " ", STREET, ", ", TOWN)),
    ]


@recipe("fr-bare-street", "FR", "fr-FR", by_number(4), ("house_number", "street", "locality"))
def fr_bare_street() -> list[Form]:
    kind, short = ("street_prefix", F.lit("Rue")), ("street_prefix", F.lit("R"))
    return [Form("comma", (NUMBER, " ", kind, " ", STREET, ", ", TOWN)), Form("no-comma", (NUMBER, " ", kind, " ", STREET, " ", TOWN)), Form("short", (NUMBER, " ", short, " ", STREET, " ", TOWN)), Form("street-only", (kind, " ", STREET))]


@recipe("fr-fragment", "FR", "fr-FR", by_number(3), ("street",))
def fr_fragment() -> list[Form]:
    kind = ("street_prefix", draw(("Rue", "Avenue", "Place"), "voie"))
    return [Form("street", (kind, " ", STREET)), Form("street-town", (kind, " ", STREET, ", ", TOWN)), Form("street-town-plain", (kind, " ", STREET, " ", TOWN))]


@recipe("fr-lieudit", "FR", "fr-FR", by_number(2), ("locality", "postcode"))
def fr_lieudit() -> list[Form]:
    hamlet = ("dependent_locality", draw(("Le Bourg", "La Croix", "Les Granges"), "hamlet"))
    return [Form("hamlet", (hamlet, ", ", CODE, " ", TOWN)), Form("lieu-dit", (("", F.lit("Lieu-dit ")), hamlet, ", ", CODE, " ", TOWN))]


@recipe("fr-admin-split", "FR", "fr-FR", by_number(2), ("locality", "region", "postcode"))
def fr_admin() -> list[Form]:
    return [Form("region", (CODE, " ", TOWN, ", ", REGION)), Form("region-brackets", (TOWN, " (", REGION, ") ", CODE))]


@recipe("german", "DE", "de-DE", by_number(2), ("street", "locality"))
def german() -> list[Form]:
    return [Form("native", (STREET, " ", NUMBER, ", ", CODE, " ", TOWN)), Form("international", (NUMBER, " ", STREET, ", ", TOWN, ", ", REGION, " ", CODE))]


@recipe("locale", "", "und", by_number(2), ("street", "locality"))
def locale() -> list[Form]:
    return [Form("native", (STREET, ", ", NUMBER, ", ", CODE, " ", TOWN)), Form("space", (STREET, " ", NUMBER, ", ", CODE, " ", TOWN))]


@recipe("country-balanced", "", "und", by_number(2), ("locality", "country"))
def country_balanced() -> list[Form]:
    return [Form("town-country", (TOWN, ", ", _c("country"))), Form("full", (NUMBER, " ", STREET, ", ", TOWN, ", ", _c("country")))]


def _split_street() -> tuple[Piece, Piece, Piece]:
    p = us_street_parts(F.col("street"))
    return ("street_prefix", p["prefix"]), ("street", p["street"]), ("street_suffix", p["suffix"])


@recipe("street", "US", "en-US", by_number(2), ("street", "locality"))
def street() -> list[Form]:
    a, b, c = _split_street()
    return [Form("numbered", (NUMBER, " ", a, " ", b, " ", c, ", ", TOWN, ", ", REGION, " ", CODE)), Form("unnumbered", (a, " ", b, " ", c, ", ", TOWN, ", ", REGION, " ", CODE))]


@recipe("street-bare", "US", "en-US", by_number(2), ("street",))
def street_bare() -> list[Form]:
    a, b, c = _split_street()
    return [Form("bare", (a, " ", b, " ", c)), Form("numbered", (NUMBER, " ", a, " ", b, " ", c))]


@recipe("unit", "US", "en-US", by_number(2), FULL)
def unit() -> list[Form]:
    u = ("unit", F.concat_ws(" ", draw(UNITS, "unit"), (F.col("id") * 11 % 90 + 1).cast("string")))
    return [Form("after-street", (NUMBER, " ", STREET, " ", u, ", ", TOWN, ", ", REGION, " ", CODE)), Form("comma", (NUMBER, " ", STREET, ", ", u, ", ", TOWN, ", ", REGION, " ", CODE))]


@recipe("trailing-region", "", "und", by_number(4), ("locality", "region"))
def trailing_region() -> list[Form]:
    return [Form("plain", (TOWN, ", ", REGION)), Form("postcode", (TOWN, ", ", REGION, " ", CODE)), Form("country", (TOWN, ", ", REGION, ", ", _c("country"))), Form("numbered", (NUMBER, " ", TOWN, ", ", REGION, " ", CODE))]


@recipe("boundary-stress", "", "und", by_draw(3, "form"), FULL)
def boundary_stress() -> list[Form]:
    return [Form("no-commas", (NUMBER, " ", STREET, " ", TOWN, " ", REGION, " ", CODE)), Form("run-on", (TOWN, " ", STREET, " ", NUMBER)), Form("code-between", (STREET, " ", CODE, " ", TOWN))]


@recipe("anchor-absorption", "", "und", by_draw(3, "form"), FULL)
def anchor_absorption() -> list[Form]:
    return [Form("number-at-postcode", (CODE, " ", NUMBER, " ", STREET)), Form("town-in-street", (NUMBER, " ", ("street", F.concat_ws(" ", F.col("locality"), F.lit("Road"))), ", ", TOWN)), Form("region-last", (STREET, ", ", TOWN, " ", REGION))]
