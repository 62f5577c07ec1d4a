"""Counts, profiles and coverage of reference tables, each one plan of joins and aggregations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import empty_to_null


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, total, share): rows whose value is neither null nor blank. One pass over the table."""
    counts = [F.count(empty_to_null(F.col(c).cast("string"))).alias(c) for c in columns]
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *counts)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])).alias("x")
    share = F.when(F.col("_total") > 0, F.col("x.filled") / F.col("_total"))
    return wide.select(each, "_total").select("x.column", "x.filled", F.col("_total").alias("total"), share.alias("share"))


def item_counts(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """How often each item of a list column occurs."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def observed_aliases(df: DataFrame, area: Column, said: Column, official: Column, least: int) -> DataFrame:
    """(area, said, official, n): other names under which an area's official one is seen at least `least` times."""
    low = df.select(area.alias("area"), F.lower(said).alias("said"), F.lower(official).alias("official")).filter("said <> official")
    return low.groupBy("area", "said", "official").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def dominant(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group its most frequent value, how often it and all occur, and its share; of equal ones the least value."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b"))).alias("_top"), F.sum("_n").alias("total"))
    best = best.select(*group, F.col("_top.b").alias(value), (-F.col("_top.a")).alias("n"), "total")
    return best.withColumn("share", F.col("n") / F.col("total"))


def collision_degree(df: DataFrame, name: str, area: str) -> DataFrame:
    """df with degree: in how many areas its name occurs. The counts are aggregated first, then joined back."""
    degree = df.groupBy(F.col(name).alias("_name")).agg(F.count_distinct(area).alias("degree"))
    return df.join(degree, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def hash_sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows, the same each time: those of least SHA-256 of salt and key. Filter first, then sample."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key).limit(n)


def extents(points: DataFrame, group: str) -> DataFrame:
    return points.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def overlaps(a: str, lat_low: Column, lat_high: Column, lon_low: Column, lon_high: Column) -> Column:
    """Whether the box with columns min_lat ... max_lon, prefixed by a, meets another; borders count."""
    c = lambda x: F.col(f"{a}{x}")
    return (c("min_lat") <= lat_high) & (c("max_lat") >= lat_low) & (c("min_lon") <= lon_high) & (c("max_lon") >= lon_low)


def live(current: Column, deprecated: Column) -> Column:
    """A place that exists now: not known to be gone, and not replaced."""
    return (F.coalesce(current, F.lit(-1)) != 0) & (F.coalesce(deprecated, F.lit(0)) == 0)


def supports_exclusion(basis: Column) -> Column:
    """Only what was designated or surveyed may say that something is not there."""
    return F.coalesce(basis.isin("designated", "surveyed"), F.lit(False))


# A filter for one kind of place lets in what goes for it.
FILTER_GROUPS = {"locality": ("locality", "borough", "localadmin"), "region": ("region", "macroregion"), "county": ("county", "macrocounty")}


def expanded_filter(kinds: Column) -> Column:
    """The kinds that a list of kinds stands for, each once, in order."""
    groups = F.create_map(*[x for k, v in FILTER_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(kinds, lambda k: F.coalesce(F.element_at(groups, k), F.array(k)))))


def ladder(places: DataFrame, ancestors: DataFrame, rungs: dict[str, tuple[str, ...]], parent_kinds: tuple[str, ...]) -> DataFrame:
    """(country, rung, nodes, parents_covered, parents, coverage) for every country with parents and every rung.

    places: id, country, kind. ancestors: id, ancestor. A parent is covered if a node of the rung lies below it.
    """
    rung = F.lit(None).cast("string")
    for name, kinds in rungs.items():
        rung = F.when(F.col("kind").isin(*kinds), name).otherwise(rung)
    nodes = places.withColumn("rung", rung).filter("rung IS NOT NULL")
    counted = nodes.groupBy("country", "rung").agg(F.count(F.lit(1)).alias("nodes"))
    parents = places.filter(F.col("kind").isin(*parent_kinds)).select(F.col("id").alias("parent"), F.col("country").alias("parent_country"))
    below = nodes.join(ancestors.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).join(parents, F.col("ancestor") == F.col("parent"))
    below = below.filter((F.col("country") == F.col("parent_country")) & (F.col("id") != F.col("parent")))
    covered = below.groupBy("country", "rung").agg(F.count_distinct("parent").alias("parents_covered"))
    total = parents.groupBy(F.col("parent_country").alias("country")).agg(F.count(F.lit(1)).alias("parents"))
    every = total.withColumn("rung", F.explode(F.array(*map(F.lit, rungs))))
    out = every.join(counted, ["country", "rung"], "left").join(covered, ["country", "rung"], "left").fillna(0, ["nodes", "parents_covered"])
    return out.withColumn("coverage", F.col("parents_covered") / F.col("parents"))


def fanout(candidates: DataFrame, group: str, spread_km: float = 5.0) -> DataFrame:
    """(group, verdict, keep) for the places that share a concordance.

    One place is single; places within spread_km of each other are coincident, and all stay; else the one of more people
    than all others stays, or none. candidates: group, id, lat, lon, population. A group farther apart in latitude
    alone is spread; of the rest, pairs are compared by an equi join on the group.
    """
    from granary.functions.geo import haversine

    size = candidates.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"), F.max("population").alias("top"), F.max_by("id", "population").alias("top_id"),
        F.max("lat").alias("_a"), F.min("lat").alias("_b"), F.max("lon").alias("_c"), F.min("lon").alias("_d"),
    )
    tied = candidates.join(size.select(F.col(group).alias("_g"), F.col("top").alias("_top")), F.col(group) == F.col("_g")).filter("population = _top").groupBy(F.col(group).alias("_t")).agg(F.count(F.lit(1)).alias("tied"))
    wide = F.radians(F.col("_a") - F.col("_b")) * 6371.0 > spread_km
    few = size.filter((F.col("n") > 1) & ~wide).select(F.col(group).alias("_g"))
    near = candidates.join(few, F.col(group) == F.col("_g"), "left_semi")
    a, b = near.alias("a"), near.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.id") < F.col("b.id")))
    most = pairs.groupBy(F.col(f"a.{group}").alias("_m")).agg(F.max(haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))).alias("km"))
    out = size.join(tied, F.col(group) == F.col("_t"), "left").join(most, F.col(group) == F.col("_m"), "left")
    verdict = F.when(F.col("n") <= 1, "single").when(F.col("km") <= spread_km, "coincident").when((F.col("top") > 0) & (F.col("tied") == 1), "population").otherwise("unresolvable")
    keep = F.when(verdict.isin("single", "coincident"), F.col("ids")).when(verdict == "population", F.array("top_id")).otherwise(F.array().cast("array<bigint>"))
    return out.select(group, verdict.alias("verdict"), keep.alias("keep"))


def stride_sample(df: DataFrame, order: str, n: int, rows: int) -> DataFrame:
    """About n rows spread evenly over the order of a dense number from 0."""
    step = max(1, rows // n)
    return df.filter((F.col(order) % step == 0) & (F.floor(F.col(order) / step) < n))


def top_by_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
