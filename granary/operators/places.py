"""Lookups of numbers and places: ranges, neighbours on a street, nearness, prefixes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import geo as G

#: How far beyond two known numbers a third is placed, in units of their distance from the farther.
MOST_BEYOND = 2.0
# Fixed values of the nearness score: most of prominence and of nearness, the scale of either.
PROMINENCE, PROMINENT_LOG10, NEARNESS, NEAR_KM = 4.0, 6.0, 4.0, 30.0


def _blocks(low: Column, high: Column) -> Column:
    """Blocks (level, at) that make up the whole numbers from low to high: block `at` of a level holds at * 2 ** level and
    the 2 ** level - 1 numbers after it. At most two of a level."""
    low, end = F.ceil(low), F.floor(high) + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - low, F.lit(1)))).cast("int"))

    def of(level: Column) -> Column:
        a, z = -F.call_function("shiftright", -low, level), F.call_function("shiftright", end, level)
        block = lambda on, at: F.when(on & (a < z), F.struct(level.alias("level"), at.alias("at")))
        return F.array(block(a.bitwiseAND(F.lit(1)) == 1, a), block(z.bitwiseAND(F.lit(1)) == 1, z - 1))

    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def tightest_range(queries: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """queries (id, key, n) with the range (rid, key, low, high, parity) that holds n: of n's own parity first, then
    mixed, then any; of those the narrowest, then the least rid. n is a whole number.

    Ranges are cut into blocks of powers of two; a block keeps its best range of each parity, and a number looks at the one
    block of each level that holds it. No number meets each range of its key.
    """
    r = ranges.filter(F.col("low") <= F.col("high")).select(F.col(key).alias("_key"), "rid", "low", "high", "parity", F.explode(_blocks(F.col("low"), F.col("high"))).alias("_b"))
    narrow = F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "rid", "low", "high")).alias("_r")
    r = r.groupBy("_key", F.col("_b.level").alias("_level"), F.col("_b.at").alias("_at"), "parity").agg(narrow)
    levels = F.broadcast(r.select(F.col("_level").alias("_of")).distinct())  # 63 at most
    asked = queries.select(F.col(key).alias("_k"), F.col("n").alias("_n")).distinct().join(levels)
    hit = asked.join(r, (F.col("_k") == F.col("_key")) & (F.col("_of") == F.col("_level")) & (F.call_function("shiftright", F.col("_n").cast("long"), F.col("_of")) == F.col("_at")))
    own = F.when(F.col("_n") % 2 == 1, "odd").otherwise("even")
    tier = F.when(F.col("parity") == own, 0).when(F.col("parity") == "mixed", 1).otherwise(2)
    found = hit.groupBy("_k", "_n").agg(F.min(F.struct(tier.alias("tier"), "_r.width", "_r.rid", "_r.low", "_r.high")).alias("_best"))
    hit = queries.join(found, (F.col(key) == F.col("_k")) & (F.col("n") == F.col("_n")))
    return hit.groupBy("id", "n").agg(F.min("_best").alias("best")).select("id", "n", "best.*")


def between_neighbours(queries: DataFrame, points: DataFrame, street: str) -> DataFrame:
    """queries (id, street, n) with lat, lon and bracket from the numbers next to n on its street, n itself left out.

    Between two known numbers the place is in proportion; beyond the last it goes on along the last two, as far as
    MOST_BEYOND. Points that share a number count as their mean. One sort per street, no pairs.
    """
    known = points.groupBy(street, "number").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    at = F.struct(F.col("number").alias("number"), F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    along = Window.partitionBy(street).orderBy("number")
    known = known.select(street, F.col("number").alias("n"), F.lit(None).cast("long").alias("id"), at.alias("_here"), F.lag(at).over(along).alias("_back"), F.lead(at).over(along).alias("_on"))
    asked = queries.select(street, F.col("n"), F.col("id").cast("long").alias("id"), *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("_here", "_back", "_on")])
    both = known.select(street, "n", "id", F.struct("_here", F.col("_back").alias("_next")).alias("_low"), F.struct("_here", F.col("_on").alias("_next")).alias("_high"))
    both = both.unionByName(asked.select(street, "n", "id", F.lit(None).cast(both.schema["_low"].dataType).alias("_low"), F.lit(None).cast(both.schema["_high"].dataType).alias("_high")))
    # Frames by value: a known number equal to n is in neither.
    order = Window.partitionBy(street).orderBy(F.col("n").cast("long"))
    found = both.withColumns({"_low": F.last("_low", True).over(order.rangeBetween(Window.unboundedPreceding, -1)), "_high": F.first("_high", True).over(order.rangeBetween(1, Window.unboundedFollowing))}).filter("id IS NOT NULL")
    low, high = F.col("_low._here"), F.col("_high._here")
    two = low.isNotNull() & high.isNotNull()
    start = F.when(two, low).when(low.isNotNull(), F.col("_low._next")).otherwise(F.col("_high._next"))
    end = F.when(two, high).otherwise(F.coalesce(low, high))
    out = found.select("id", street, "n", two.alias("_two"), start.alias("_s"), end.alias("_e"))
    share = (F.col("n") - F.col("_s.number")) / (F.col("_e.number") - F.col("_s.number"))
    out = out.withColumn("_t", share).filter((F.col("_t") <= MOST_BEYOND) | F.col("_two"))
    place = lambda c: (F.col(f"_s.{c}") + (F.col(f"_e.{c}") - F.col(f"_s.{c}")) * F.col("_t")).alias(c)
    return out.select("id", street, "n", place("lat"), place("lon"), F.when(F.col("_two"), "both").otherwise("single").alias("bracket"))


def nearness(prominence: Column, lat: Column, lon: Column, biases: list[tuple[float, float, float]]) -> Column:
    """Prominence (log10) and the strongest nearness to any (lat, lon, weight); (0, 0) is no coordinate."""
    near = [F.lit(NEARNESS * w) / (1 + G.haversine(F.lit(a), F.lit(b), lat, lon) / NEAR_KM) for a, b, w in biases]
    strongest = F.greatest(F.lit(0.0), F.lit(0.0), *near)
    return PROMINENCE * F.least(F.lit(1.0), F.greatest(prominence, F.lit(0)) / PROMINENT_LOG10) + F.when((lat == 0) & (lon == 0), 0.0).otherwise(strongest)


def prefix_prior(codes: DataFrame, code: str, region: str, lengths: tuple[int, ...]) -> DataFrame:
    """(prefix, region, n, share): the region that most codes of a prefix have; ties go to the lesser."""
    each = codes.select(F.explode(F.array_distinct(F.array(*[F.left(code, F.lit(k)) for k in lengths]))).alias("prefix"), F.col(region).alias("region"))
    counts = each.groupBy("prefix", "region").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "region")).alias("best")
    return counts.groupBy("prefix").agg(best, F.sum("n").alias("total")).select("prefix", "best.region", (-F.col("best.m")).alias("n"), (-F.col("best.m") / F.col("total")).alias("share"))


def pair_index(pairs: DataFrame, child: str, parent: str, held_percent: int = 0, seed: int = 42) -> DataFrame:
    """(child, parent, n, held_out): counts of pairs; a fixed share of pairs, by hash, is held out whatever the order."""
    bucket = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), F.col(child).cast("string"), F.col(parent).cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    return pairs.groupBy(child, parent).agg(F.count(F.lit(1)).alias("n")).withColumn("held_out", bucket < held_percent)
