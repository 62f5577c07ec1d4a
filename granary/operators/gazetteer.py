"""Place tables and lookups: candidates with ranks and roles, search, ranking rules, address cascades, reverse lookup."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import geo as G
from granary.functions.normalize import fold



def neg_rank(population: Column, country_population: Column | None = None) -> Column:
    """-log10(population + 1); without people, a country's known population counts."""
    people = F.coalesce(population, F.lit(0))
    if country_population is not None:
        people = F.when(people > 0, people).otherwise(F.coalesce(country_population, F.lit(0)))
    return -F.log10(people + 1)


def candidate_table(places: DataFrame, aliases: DataFrame, gloss: int = 50) -> DataFrame:
    """name_key, country, kind, neg_rank, id, name, role: one row per place and key, ready to be clustered by key.

    places: id, name, country, kind, population. aliases: id, alias, abbreviation (boolean). The primary name's key comes
    first; an alias of the same key adds none. role: abbr for abbreviations, gloss for names of a place, other than a
    country or region, with `gloss` keys or more, else null.
    """
    base = places.select("id", "name", "country", "kind", neg_rank(F.col("population")).alias("neg_rank"))
    own = base.select("id", fold(F.col("name")).alias("name_key"), F.col("name").alias("written"), F.lit(0).alias("_order"), F.lit(False).alias("abbreviation"))
    other = aliases.select("id", fold(F.col("alias")).alias("name_key"), F.col("alias").alias("written"), F.lit(1).alias("_order"), "abbreviation")
    keys = own.unionByName(other).filter("name_key <> ''").groupBy("id", "name_key").agg(F.min(F.struct("_order", "abbreviation", "written")).alias("_k"))
    many = keys.groupBy(F.col("id").alias("_i")).agg(F.count(F.lit(1)).alias("_keys"))
    j = keys.join(base, "id").join(many, F.col("id") == F.col("_i"))
    wide = ~F.col("kind").isin("country", "dependency", "disputed", "empire", "macroregion", "region", "macrocounty", "county")
    role = F.when(F.col("_k.abbreviation"), "abbr").when((F.col("_k._order") == 1) & (F.col("_keys") >= gloss) & wide, "gloss")
    return j.select("name_key", "country", "kind", "neg_rank", "id", F.col("_k.written").alias("name"), role.alias("role"))


def coincident_roles(regions: DataFrame, towns: DataFrame, ancestors: DataFrame, fraction: float = 0.15, least_km: float = 12.0, city_km: float = 2.0) -> DataFrame:
    """(region, town, relationship, km): a town of its region's name that lies near the region's middle.

    regions: id, name, lat, lon and the box; towns: id, name, lat, lon. Near: within a share of the box's diagonal, or
    least_km. Joined by the ancestor first, which few towns share.
    """
    r = regions.select(F.col("id").alias("region"), F.lower("name").alias("_rn"), F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), G.haversine(F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("max_lon")).alias("_diagonal"))
    t = towns.select(F.col("id").alias("town"), F.lower("name").alias("_tn"), "lat", "lon").join(ancestors.select(F.col("id").alias("_id"), F.col("ancestor").alias("_up")), F.col("town") == F.col("_id"))
    j = t.join(r, (F.col("_up") == F.col("region")) & (F.col("_tn") == F.col("_rn"))).withColumn("km", G.haversine(F.col("_rlat"), F.col("_rlon"), F.col("lat"), F.col("lon")))
    near = j.filter(F.col("km") <= F.greatest(fraction * F.col("_diagonal"), F.lit(least_km)))
    return near.select("region", "town", F.when(F.col("km") <= city_km, "city-state").otherwise("capital-seat").alias("relationship"), "km")


def referential(population: Column) -> Column:
    """0 to 1 by people."""
    return F.least(F.lit(1.0), F.log2(1 + F.coalesce(population, F.lit(0)) / 1000.0) / 14)


def importance_split(legacy: Column, population: Column, tolerance: float = 1e-6) -> tuple[Column, Column]:
    """(referential, encyclopedic): a legacy score that only repeats the referential one says nothing more."""
    own = referential(population)
    return own, F.when(legacy.isNotNull() & (F.abs(legacy - own) > tolerance * F.greatest(own, F.lit(1.0))), legacy)


# --- search

def inverted_index(docs: DataFrame, id: str, text: Column) -> DataFrame:
    """(token, id, tf, length): one row per token of a text, in folded form."""
    words = docs.select(F.col(id).alias("id"), F.filter(F.split(fold(text), " "), lambda w: w != "").alias("w"))
    each = words.select("id", F.size("w").alias("length"), F.explode("w").alias("token"))
    return each.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(index: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score) of every text that holds a word of a query. queries: query, text. Higher is better."""
    lengths = index.select("id", "length").distinct().agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_avg"))
    df = index.groupBy(F.col("token").alias("_t")).agg(F.count(F.lit(1)).alias("_df"))
    asked = queries.select("query", F.explode(F.array_distinct(F.filter(F.split(fold(F.col("text")), " "), lambda w: w != ""))).alias("token"))
    j = asked.join(df, F.col("token") == F.col("_t")).join(F.broadcast(lengths)).join(index, "token")
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("_avg")))
    return j.groupBy("query", "id").agg(F.sum(part).alias("score"))


def soft_score(text: Column, name: Column, aliases: Column) -> Column:
    """1 where a folded name equals the folded text, else the best share of common trigrams; 0 for an empty text."""
    grams = lambda c: trigram_set(c)
    q = fold(text)
    each = F.filter(F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: fold(a)), lambda a: a != "")
    score = lambda a: F.when(a == q, 1.0).otherwise(F.size(F.array_intersect(grams(a), grams(q))) / F.size(F.array_union(grams(a), grams(q))))
    return F.when(q == "", 0.0).otherwise(F.coalesce(F.array_max(F.transform(each, score)), F.lit(0.0)))


def trigram_set(c: Column) -> Column:
    """Trigrams of a text between single blanks."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def lexicon_matches(queries: DataFrame, lexicon: DataFrame, most_typos: int = 1) -> DataFrame:
    """(query, phrase, category, how): exact entries, those of the query's locale only, then entries a typo away.

    queries: query, text, locale. lexicon: phrase, category, locale (null: any). A typo's candidates share a first or a
    last character pair, so that no query meets the whole lexicon.
    """
    q = queries.select("query", fold(F.col("text")).alias("_q"), F.col("locale").alias("_l"))
    x = lexicon.select("phrase", "category", fold(F.col("phrase")).alias("_p"), F.col("locale").alias("_of"))
    allowed = F.col("_of").isNull() | (F.col("_of") == F.col("_l"))
    exact = q.join(x, F.col("_q") == F.col("_p")).filter(allowed).select("query", "phrase", "category", F.lit("exact").alias("how"))
    ends = lambda c: F.array(F.concat(F.lit("<"), F.left(c, F.lit(2))), F.concat(F.lit(">"), F.right(c, F.lit(2))))
    left = q.join(exact.select(F.col("query").alias("_done")).distinct(), F.col("query") == F.col("_done"), "left_anti").filter(F.length("_q") >= 4)
    near = left.withColumn("_e", F.explode(ends(F.col("_q")))).join(x.withColumn("_f", F.explode(ends(F.col("_p")))), F.col("_e") == F.col("_f"))
    near = near.filter(allowed & (F.levenshtein("_q", "_p") <= most_typos)).select("query", "phrase", "category", F.lit("typo").alias("how")).distinct()
    return exact.unionByName(near)


# --- ranking

# What each property of a candidate adds to its score.
@dataclass(frozen=True)
class Weights:
    kind: float = 0.5
    implicit_town: float = 0.2
    country: float = 0.3
    child: float = 0.5
    descendant: float = 0.2
    length: float = 0.1
    proximity: float = 0.8
    scale_km: float = 100.0
    bias: float = 4.0
    population: float = 4.0
    population_log: float = 6.0


def candidate_score(c: dict[str, Column], asked: dict[str, Column], w: Weights = Weights()) -> Column:
    """struct(score, prominence, km). c: rank, name, kind, country, parent_id, lat, lon, population. asked: length, and
    those that are asked for of kind, country, parent_id, lat, lon. (0, 0) is no place."""
    score = -c["rank"]
    if "kind" in asked:
        score = score + F.when(c["kind"] == asked["kind"], w.kind).otherwise(0.0)
    else:
        score = score + F.when(c["kind"] == "locality", w.implicit_town).otherwise(0.0)
    if "country" in asked:
        score = score + F.when(c["country"] == asked["country"], w.country).otherwise(0.0)
    if "parent_id" in asked:
        score = score + F.when(c["parent_id"] == asked["parent_id"], w.child).otherwise(w.descendant)
    score = score - w.length * F.greatest(F.length(c["name"]) - asked["length"] - 3, F.lit(0)) / 10
    km = F.lit(None).cast("double")
    near, decay = F.lit(0.0), F.lit(0.0)
    if "lat" in asked:
        placed = c["lat"].isNotNull() & c["lon"].isNotNull() & ~((c["lat"] == 0) & (c["lon"] == 0))
        km = F.when(placed, G.haversine(asked["lat"], asked["lon"], c["lat"], c["lon"]))
        decay = F.coalesce(1 / (1 + km / w.scale_km), F.lit(0.0))
        near = decay * w.bias
    people = F.when(c["population"] > 0, w.population * F.least(F.lit(1.0), F.log10(1 + c["population"]) / w.population_log)).otherwise(0.0)
    return F.struct((score + decay * w.proximity + people).alias("score"), (people + near).alias("prominence"), km.alias("km"))


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def nearest_group(rows: DataFrame, query: str, group: str, km: str, most_km: float = 25.0, dominance: float = 2.0) -> DataFrame:
    """(query, group, km): the group with the nearest row, if it is near enough and the next group is twice as far."""
    each = rows.groupBy(query, group).agg(F.min(km).alias("km"))
    w = Window.partitionBy(query).orderBy("km", group)
    top = each.withColumns({"_r": F.row_number().over(w), "_next": F.lead("km").over(w)}).filter("_r = 1")
    return top.filter((F.col("km") <= most_km) & (F.col("_next").isNull() | (F.col("_next") >= F.col("km") * dominance))).select(query, group, "km")


def first_ancestors(closure: DataFrame, most: int = 8) -> DataFrame:
    """(id, ancestor, ordinal): the nearest `most` ancestors of each place, the nearest first."""
    w = Window.partitionBy("id").orderBy("depth", "ancestor")
    return closure.filter("depth > 0").withColumn("ordinal", F.row_number().over(w) - 1).filter(F.col("ordinal") < most).select("id", "ancestor", "ordinal")


def plausible_first(df: DataFrame, query: str, order: str, implausible: Column, budget: int = 5) -> DataFrame:
    """Candidates with rank: those that were looked at and found implausible go last, all else stays in order."""
    vetoed = (F.col(order) < budget) & F.coalesce(implausible, F.lit(False))
    return df.withColumn("_v", vetoed).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_v", order))).drop("_v")


def by_evidence(df: DataFrame, query: str, order: str, score: str, evidence: Column, margin: float = 2.5) -> DataFrame:
    """The first candidate of each query that evidence backs within a margin of the best score; else the first."""
    best = F.max(score).over(Window.partitionBy(query))
    backed = F.coalesce(evidence, F.lit(False)) & (best - F.col(score) <= margin)
    w = Window.partitionBy(query).orderBy(F.desc("_b"), order)
    return df.withColumn("_b", backed).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_b", "_r")


# --- addresses

def address_points(queries: DataFrame, table: DataFrame) -> DataFrame:
    """(id, lat, lon, how): by street, number and postcode; else town; else the one such address that there is.

    queries: id, street, number, postcode, locality. table: street, number, postcode, locality, lat, lon. Keys are
    folded; of several rows of a key, the least place. Three equi joins, each on what the one before left.
    """
    t = table.select(*[fold(F.col(c)).alias(c) for c in ("street", "number", "postcode", "locality")], F.struct("lat", "lon").alias("p"))
    q = queries.select("id", *[fold(F.col(c)).alias(c) for c in ("street", "number", "postcode", "locality")])
    out = q
    for how, keys in (("postcode", ("street", "number", "postcode")), ("locality", ("street", "number", "locality")), ("alone", ("street", "number"))):
        by = t.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("p").alias(f"p_{how}"), F.count_distinct("p").alias("_n"))
        by = by.filter("_n = 1") if how == "alone" else by
        on = F.lit(True)
        for k in keys:
            on = on & (out[k] == by[f"_{k}"])
        out = out.join(by.drop("_n"), on, "left").drop(*[f"_{k}" for k in keys])
    found = F.coalesce("p_postcode", "p_locality", "p_alone")
    how = F.when(F.col("p_postcode").isNotNull(), "postcode").when(F.col("p_locality").isNotNull(), "locality").when(F.col("p_alone").isNotNull(), "alone")
    return out.select("id", found["lat"].alias("lat"), found["lon"].alias("lon"), how.alias("how"))


def reverse(points: DataFrame, areas: DataFrame, tiers: tuple[str, ...], step: float = 1.0) -> DataFrame:
    """(id, tier, area) of the smallest area of the finest tier whose rings hold a point.

    points: id, lat, lon. areas: area, tier, the box, rings. Boxes are dealt to grid cells, so that a point meets only
    areas of its cell; the box and then the rings decide.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step))
    cells = F.flatten(F.transform(span("min_lat", "max_lat"), lambda i: F.transform(span("min_lon", "max_lon"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    a = areas.withColumn("_c", F.explode(cells)).withColumns({"_i": F.col("_c.i"), "_j": F.col("_c.j")})
    p = points.withColumns({"_pi": F.floor(F.col("lat") / step), "_pj": F.floor(F.col("lon") / step)})
    hit = p.join(a, (F.col("_pi") == F.col("_i")) & (F.col("_pj") == F.col("_j")))
    hit = hit.filter(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & G.in_rings(F.col("lon"), F.col("lat"), F.col("rings")))
    order = F.lit(len(tiers))
    for i, t in enumerate(tiers):
        order = F.when(F.col("tier") == t, i).otherwise(order)
    size = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
    best = hit.groupBy("id").agg(F.min(F.struct(order.alias("o"), F.round(size, 9).alias("s"), F.col("area").alias("area"), F.col("tier").alias("tier"))).alias("b"))
    return points.select("id").join(best, "id", "left").select("id", "b.tier", "b.area")


def coverage(cells: DataFrame, surveyed: DataFrame, parent: Callable[[Column], Column]) -> DataFrame:
    """(cell, completeness, status) by the parent cell's row; no row is unknown, not empty."""
    j = cells.withColumn("_p", parent(F.col("cell"))).join(surveyed.select(F.col("cell").alias("_s"), "completeness"), F.col("_p") == F.col("_s"), "left")
    return j.select("cell", "completeness", F.when(F.col("_s").isNull(), "unknown").when(F.col("completeness") > 0, "covered").otherwise("empty").alias("status"))


def checks(df: DataFrame, rules: dict[str, Column], baseline: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(check, value, expected, passed) of one aggregate each, against a baseline by relative tolerance."""
    wide = df.agg(*[c.cast("double").alias(k) for k, c in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.lit(float(baseline[k])).alias("expected")) for k in rules]))
    out = wide.select(each.alias("x")).select("x.*")
    return out.withColumn("passed", F.abs(F.col("value") - F.col("expected")) <= tolerance * F.abs(F.col("expected")))
