"""Codes, dates, area identifiers, and small numeric helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_code(c: Column, width: int = 10) -> Column:
    """A number of at most `width` digits, padded with zeros in front; null for anything else."""
    digits = F.trim(c)
    return F.when(F.regexp_like(digits, F.lit(f"^[0-9]{{1,{width}}}$")), F.lpad(digits, width, "0"))


def is_iso_date(c: Column) -> Column:
    """YYYY-MM-DD of a day that exists."""
    return F.coalesce(F.regexp_like(c, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def us_date(c: Column) -> Column:
    """M/D/YYYY as YYYY-MM-DD; null where there is no such day."""
    return F.date_format(F.try_to_date(c, "M/d/yyyy"), "yyyy-MM-dd")


#: Length of an area's code -> its level. States are two digits, counties three more, tracts six, blocks four.
LEVELS = {2: "state", 5: "county", 10: "county_subdivision", 11: "tract", 12: "block_group", 15: "block"}


def geoid(c: Column) -> Column:
    """struct(level, state, county, tract, block_group, block) of an area's code; null for another length."""
    level = F.lit(None).cast("string")
    for n, name in LEVELS.items():
        level = F.when(F.length(c) == n, name).otherwise(level)
    part = lambda a, n, least: F.when(F.length(c) >= least, F.substring(c, a, n))
    tract = F.when(F.length(c) >= 11, F.substring(c, 6, 6))
    whole = F.struct(level.alias("level"), part(1, 2, 2).alias("state"), part(3, 3, 5).alias("county"), tract.alias("tract"), F.when(F.length(c) >= 12, F.substring(c, 12, 1)).alias("block_group"), F.when(F.length(c) == 15, F.substring(c, 12, 4)).alias("block"))
    return F.when(level.isNotNull() & F.regexp_like(c, F.lit("^[0-9]+$")), whole)


def softmax(scores: Column) -> Column:
    """Of a map's values, from the largest down, so that none overflows."""
    top = F.array_max(F.map_values(scores))
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform_values(scores, lambda _, v: F.exp(v - top) / total)


def gram_buckets(c: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Buckets of the character n-grams of a lower-case text between ^ and $, repeats kept."""
    text = F.concat(F.lit("^"), F.lower(c), F.lit("$"))

    def grams(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, all_).otherwise(F.array().cast("array<string>"))

    return F.transform(F.concat(*map(grams, sizes)), lambda g: F.conv(F.substring(F.sha2(g, 256), 1, 8), 16, 10).cast("long") % buckets)
