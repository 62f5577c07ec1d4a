"""Training rows of every recipe, and lints of labelled rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import lints as L
from granary.operators import recipes as R
from granary.plans.registry import query
from granary.plans.tables import ADDRESSES, addresses

_N, _S, _L, _G, _C, _K = (f"trim({c})" for c in ("house_number", "street", "locality", "region", "postcode", "country"))
_DRAW = "CAST(('0x' || substring(sha256('{0}' || chr(31) || id), 1, 8)) AS BIGINT) % {1}"


def _pick(values, what):
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}][{_DRAW.format(what, len(values))} + 1])"


_VENUE = _pick(R.VENUES, "venue")
_CASES = {
    "bare-country": [_K],
    "no-street": [f"{_VENUE} || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}", f"{_L} || ', ' || {_G} || ' ' || {_C}", f"{_L} || ', ' || {_G}", _C, _K, f"{_VENUE} || ', ' || {_L}"],
    "house-venue": [f"{_N} || ' ' || {_S} || ', ' || {_VENUE} || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}", f"{_VENUE} || ', ' || {_N} || ' ' || {_S} || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}"],
    "nl-postcode": [x for g in ("", " ") for z in [f"(substring(postcode, 1, 4) || '{g}' || {_pick(('AB', 'XZ', 'KL'), 'letters')})"] for x in (f"{_S} || ' ' || {_N} || ', ' || {z} || ' ' || {_L}", f"{z} || ' ' || {_L} || ', ' || {_S} || ' ' || {_N}", f"{_L} || ', ' || {z} || ', ' || {_S} || ' ' || {_N}")],
    "cz-pcfirst-preposition": [x.replace("Z", "(CASE WHEN id % 2 = 0 THEN substring(postcode, 1, 3) || ' ' || substring(postcode, 4, 2) ELSE postcode END)").replace("TOWN", f"({_L} || ' nad Labem')") for x in (f"Z || ' ' || TOWN || ', ' || {_S} || ' ' || {_N}", f"{_S} || ' ' || {_N} || ', ' || Z || ' ' || TOWN", f"TOWN || ', ' || Z || ', ' || {_S} || ' ' || {_N}", "TOWN || ' ' || Z || ', Česko'")],
    "no-street-led": [f"{_S} || ' ' || {_N} || ', ' || {_C} || ' ' || {_L}", f"{_L} || ', ' || {_C} || ', ' || {_S} || ' ' || {_N}", f"{_C} || ' ' || {_L} || ', ' || {_S} || ' ' || {_N}"],
    "no-fragment": [_S, f"{_S} || ' ' || {_N}", _L, _C],
    "si-bare-village": [f"{_L} || ' ' || {_N} || ', ' || {_C} || ' ' || {_L}", f"{_L} || ' ' || {_N} || ', ' || {_L}", f"{_C} || ' ' || {_L} || ', ' || {_L} || ' ' || {_N}"],
    "fr-order": [f"{_N} || ' ' || {_S} || ', ' || {_C} || ' ' || {_L}", f"{_C} || ' ' || {_L} || ', ' || {_N} || ' ' || {_S}", f"{_L} || ', ' || {_C} || ', ' || {_N} || ' ' || {_S}", f"{_L} || ' ' || {_N} || ' ' || {_S} || ' ' || {_C}", f"{_C} || ', ' || {_N} || ' ' || {_S} || ', ' || {_L}"],
    "fr-bare-street": [f"{_N} || ' Rue ' || {_S} || ', ' || {_L}", f"{_N} || ' Rue ' || {_S} || ' ' || {_L}", f"{_N} || ' R ' || {_S} || ' ' || {_L}", f"'Rue ' || {_S}"],
    "fr-fragment": [f"{_pick(('Rue', 'Avenue', 'Place'), 'voie')} || ' ' || {_S}" + t for t in ("", f" || ', ' || {_L}", f" || ' ' || {_L}")],
    "fr-lieudit": [f"{p}{_pick(('Le Bourg', 'La Croix', 'Les Granges'), 'hamlet')} || ', ' || {_C} || ' ' || {_L}" for p in ("", "'Lieu-dit ' || ")],
    "fr-admin-split": [f"{_C} || ' ' || {_L} || ', ' || {_G}", f"{_L} || ' (' || {_G} || ') ' || {_C}"],
    "german": [f"{_S} || ' ' || {_N} || ', ' || {_C} || ' ' || {_L}", f"{_N} || ' ' || {_S} || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}"],
    "locale": [f"{_S} || ', ' || {_N} || ', ' || {_C} || ' ' || {_L}", f"{_S} || ' ' || {_N} || ', ' || {_C} || ' ' || {_L}"],
    "country-balanced": [f"{_L} || ', ' || {_K}", f"{_N} || ' ' || {_S} || ', ' || {_L} || ', ' || {_K}"],
    "street": [f"{_N} || ' ' || {_S} || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}", f"{_S} || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}"],
    "street-bare": [_S, f"{_N} || ' ' || {_S}"],
    "unit": [f"{_N} || ' ' || {_S} || '{g}' || {_pick(R.UNITS, 'unit')} || ' ' || (id * 11 % 90 + 1) || ', ' || {_L} || ', ' || {_G} || ' ' || {_C}" for g in (" ", ", ")],
    "trailing-region": [f"{_L} || ', ' || {_G}", f"{_L} || ', ' || {_G} || ' ' || {_C}", f"{_L} || ', ' || {_G} || ', ' || {_K}", f"{_N} || ' ' || {_L} || ', ' || {_G} || ' ' || {_C}"],
    "intersection": [f"{p}{_S} || {_pick(R.CROSSINGS, 'sign')} || {_pick(('5th Ave', 'N Broadway', '42nd St', 'Elm Blvd'), 'cross')}{t}" for p, t in (("", ""), ("'corner of ' || ", ""), ("", f" || ', ' || {_L} || ', ' || {_G}"))],
    "po-box": [f"CASE country {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {_pick(v, chr(98) + chr(111) + chr(120))}' for k, v in R.BOXES.items())} ELSE 'PO Box' END || ' ' || (id * 37 % 9900 + 1) || ', ' || {_L} || {t} || {_C}" for t in (f"', ' || {_G} || ' '", "' '")],
    "po-box-military": [f"{_pick(('PSC', 'CMR', 'Unit'), 'unit')} || ' ' || (id * 13 % 9999 + 1) || ' Box ' || (id * 7 % 9999 + 1) || ', ' || {_pick(('APO', 'FPO', 'DPO'), 'office')} || ' {r} ' || {z}" for r, z in (("AE", "'09' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0')"), ("AP", "'96' || lpad(CAST(200 + id % 100 AS VARCHAR), 3, '0')"), ("AA", "'340' || lpad(CAST(id % 100 AS VARCHAR), 2, '0')"))],
    "boundary-stress": [f"{_N} || ' ' || {_S} || ' ' || {_L} || ' ' || {_G} || ' ' || {_C}", f"{_L} || ' ' || {_S} || ' ' || {_N}", f"{_S} || ' ' || {_C} || ' ' || {_L}"],
    "anchor-absorption": [f"{_C} || ' ' || {_N} || ' ' || {_S}", f"{_N} || ' ' || locality || ' Road, ' || {_L}", f"{_S} || ', ' || {_L} || ' ' || {_G}"],
}


def _register(name: str, cases: list[str]) -> None:
    n = len(cases)
    choice = _DRAW.format("0/form", n) if name in ("boundary-stress", "anchor-absorption") else f"CAST(id % {n} AS INTEGER)"
    sql = f"SELECT id, CASE {choice} {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(cases))} END AS raw, true AS spanned, true AS labelled FROM {ADDRESSES}"

    def rows(spark, d):
        """raw, whether each span holds its component, and whether each token in a span has its tag."""
        r = R.run(name, addresses(spark, d))
        held = F.forall("spans", lambda s: F.substring(F.col("raw"), s["start"] + 1, s["end"] - s["start"]) == F.element_at(F.col("components"), s["tag"]))
        begun = F.filter("labels", lambda x: x.startswith("B-"))
        return r.select("id", "raw", held.alias("spanned"), ((F.size(begun) == F.size("spans")) & (F.size("tokens") == F.size("labels"))).alias("labelled"))

    rows.__module__ = __name__
    query(f"rcp_{name.replace('-', '_')}", sql)(rows)


for _name, _cases in _CASES.items():
    _register(_name, _cases)


def _labelled(spark, d, name):
    return R.run(name, addresses(spark, d))


@query("lint_vocabulary")
def lint_vocabulary(spark, d):
    """Words that a recipe tags otherwise than the corpus of the same countries mostly does. Tests hold it to a plain version."""
    return L.vocabulary(_labelled(spark, d, "street"), _labelled(spark, d, "locale"), least=20)


@query("lint_bigrams")
def lint_bigrams(spark, d):
    """Pairs of words whose tags differ between a recipe and the corpus. Tests hold it to a plain version."""
    return L.bigram_collisions(_labelled(spark, d, "street"), _labelled(spark, d, "locale"), 10)


@query("lint_sanity", f"SELECT 'no-fragment' AS shard, count(*) AS n, 0 AS truncated, 0 AS blank, 'pass' AS verdict FROM {ADDRESSES}")
def lint_sanity(spark, d):
    return L.sanity(_labelled(spark, d, "no-fragment")).select(F.lit("no-fragment").alias("shard"), "n", F.col("truncated").cast("int").alias("truncated"), F.col("blank").cast("int").alias("blank"), "verdict")


@query("lint_rules", f"SELECT lower(postcode) AS token, 'five-digits' AS rule, 'B-postcode' AS label, count(*) AS n FROM {ADDRESSES} WHERE id % 4 = 3 GROUP BY 1 HAVING count(*) >= 1")
def lint_rules(spark, d):
    """Words that match a rule and carry a label that it forbids."""
    return L.rule_hits(_labelled(spark, d, "no-fragment"), [("five-digits", "^[0-9]{5}$", False, ("B-postcode",))], 1)
