"""Names of people and organizations, and keys of addresses, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.normalize import fold, unaccented
from granary.functions.text import collapse

# Words before and after a person's name, and words that begin a family name.
TITLES = ("airman br brig brigadier capt captain cmdr col colonel commander commissioner cpl cpt dep deputy doctor dr father fr gen general hon honorable judge lt ltcol ltgen maj major master miss mr mrs ms mx "
          "pastor pfc pres president private prof professor pvt rabbi rep representative rev reverend sen senator sgt sir sister").split()
SUFFIXES = "jr sr i ii iii iv v vi vii viii phd md do dds dmd dvm esq esquire jd llm cpa rn lpn pa pe od dc dpm psyd edd mba mfa msw pharmd".split()
PARTICLES = "al bin da das de del della den der di do dos du el ibn la le lo mac mc san santa st ter van vande vanden vander vere von zu zur".split()

# Legal forms that a canonical organization name leaves out; some only in some countries, and some are
# professions in health care.
FORMS = ("inc incorporated corp corporation co company llc lllp llp pllc lp ltd limited plc pc pa ag sa sas sarl sl gmbh mbh ug bv nv oy oyj ab as asa spa srl kg kgaa kk pty proprietary bhd sdn cc cv ulc aps kft zrt "
         "doo ood ead bvba sprl").split()
COUNTRY_FORMS = {"ID": ("pt", "tbk", "ud"), "FR": ("sca", "scs", "sci", "eurl", "sasu", "snc"), "BE": ("sca", "scs"), "LU": ("sca", "scs"), "ES": ("scs",), "IT": ("sapa", "snc")}
PROFESSIONS = {"general": (), "healthcare": ("pt", "sca", "scs", "ot", "dpt")}
TRADING_AS = "(?i)\\s+(?:d/b/a|dba|doing business as|t/a|trading as|a/k/a|aka|fka|f/k/a)\\s+"

# Fixed value: the order of an address key's parts.
KEY_ORDER = "po_box house_number street_prefix street_prefix_particle street street_suffix intersection_a intersection_b unit dependent_locality locality subregion region postcode country".split()


def _plain(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "\\.$", "")


def person_name(c: Column) -> Column:
    """struct(prefix, given, middle, family, family_particle, suffix, nickname); null for a blank name.

    "Family, Given" is turned round unless what follows the only comma are suffixes. A nickname stands in brackets or
    quotes. The first particle that is not the last word begins the family name.
    """
    quoted = "\\s*\\(([^)]+)\\)\\s*|\\s*\"([^\"]+)\"\\s*"
    nickname = F.nullif(F.trim(F.concat(F.regexp_extract(c, quoted, 1), F.regexp_extract(c, quoted, 2))), F.lit(""))
    text = collapse(F.regexp_replace(c, quoted, " "))
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    one = F.size(parts) == 2
    behind = one & (tail != "") & F.forall(F.split(tail, "\\s+"), lambda w: _plain(w).isin(*SUFFIXES))
    text = F.when(behind, head).when(one & (head != "") & (tail != ""), F.concat_ws(" ", tail, head)).otherwise(text)
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        first = F.coalesce(F.get(F.filter(at, lambda i: ~_plain(F.get(w, i)).isin(*TITLES)), F.lit(0)), n)
        front = F.greatest(F.least(first, n - 1), F.lit(0))
        held = F.coalesce(F.array_max(F.filter(at, lambda i: ~_plain(F.get(w, i)).isin(*SUFFIXES))), F.lit(-1))
        back = F.greatest(F.least(n - 1 - held, n - front - 1), F.lit(0))
        return F.struct(F.slice(w, 1, front).alias("front"), F.slice(w, front + 1, F.greatest(n - front - back, F.lit(0))).alias("name"), F.slice(w, n - back + 1, back).alias("back"))

    def named(p: Column) -> Column:
        r = p["name"]
        n = F.size(r)
        at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        particle = lambda i: _plain(F.get(r, i)).isin(*PARTICLES)
        begin = F.get(F.filter(at, lambda i: particle(i) & (i < n - 1)), F.lit(0))
        end = F.get(F.filter(at, lambda i: (i >= begin) & (~particle(i) | (i >= n - 1))), F.lit(0))
        words = lambda a, k: F.nullif(F.array_join(F.slice(r, a + 1, F.greatest(k, F.lit(0))), " "), F.lit(""))
        front = F.nullif(F.array_join(p["front"], " "), F.lit(""))
        back = F.nullif(F.concat_ws(" ", F.nullif(F.array_join(p["back"], " "), F.lit("")), F.when(behind, tail)), F.lit(""))
        family = F.when(begin.isNotNull(), words(end, n - end)).when(n > 1, F.get(r, n - 1))
        given = F.when(begin.isNull() | (begin > 0), F.get(r, F.lit(0)))
        middle = F.when(begin.isNotNull(), words(F.lit(1), begin - 1)).otherwise(words(F.lit(1), n - 2))
        return F.struct(front.alias("prefix"), given.alias("given"), middle.alias("middle"), family.alias("family"), words(begin, end - begin).alias("family_particle"), back.alias("suffix"), nickname.alias("nickname"))

    whole = F.get(F.transform(F.transform(F.array(words), of), named), F.lit(0))
    return F.when(F.trim(c) != "", whole)


def _fragment(c: Column, forms: tuple[str, ...]) -> Column:
    """struct(canonical, designations) of one name."""
    plain = F.lower(unaccented(c))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[&+]", " and "), "[.'’]", ""), "[^a-z0-9\\s]", " ")
    plain = F.regexp_replace(collapse(plain), "^the\\s+", "")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.struct(F.array_join(F.filter(words, lambda w: ~w.isin(*forms)), " ").alias("canonical"), F.filter(words, lambda w: w.isin(*forms)).alias("designations"))


def organization_name(c: Column, country: str | None = None, domain: str = "general") -> Column:
    """struct(raw, canonical, designations, dba): the name without legal forms, and the name that it trades as."""
    forms = tuple(x for x in (*FORMS, *COUNTRY_FORMS.get((country or "").strip().upper(), ())) if x not in PROFESSIONS[domain])
    parts = F.split(c, TRADING_AS)
    legal = _fragment(F.get(parts, F.lit(0)), forms)
    dba = _fragment(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " "), forms)["canonical"]
    return F.when(F.trim(c) != "", F.struct(c.alias("raw"), legal["canonical"].alias("canonical"), legal["designations"].alias("designations"), F.nullif(dba, F.lit("")).alias("dba")))


def address_key(components: dict[str, Column], separator: str = "|") -> Column:
    """Folded parts in a fixed order; empty ones are left out."""
    parts = [F.nullif(fold(F.regexp_replace(components[k], "[&+/]", " ")), F.lit("")) for k in KEY_ORDER if k in components]
    return F.concat_ws(separator, *parts)


def exact_key(c: Column, prefix: int | None = None) -> Column:
    """An array of one key, or none for a blank value."""
    key = F.lower(collapse(c))
    return F.when(F.coalesce(key, F.lit("")) != "", F.array(F.left(key, F.lit(prefix)) if prefix else key)).otherwise(F.array().cast("array<string>"))


def family_id(kind: Column, name: Column) -> Column:
    """<kind>:<canonical name>; null without a name."""
    canonical = F.nullif(organization_name(name)["canonical"], F.lit(""))
    return F.when(canonical.isNotNull(), F.concat_ws(":", kind, canonical))
