"""Tables and the stand-in columns that several queries share. Coordinates are fixed functions of a key."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: str) -> Column:
    return F.lit(25) + (F.col(key) * 37 % 2500) / 100


def lon(key: str) -> Column:
    return F.lit(-125) + (F.col(key) * 91 % 5800) / 100


LAT, LON = "(25 + ({0} * 37 % 2500) / 100.0)", "(-125 + ({0} * 91 % 5800) / 100.0)"


def sql_points(table_: str, key: str) -> str:
    return f"(SELECT {key} AS id, {LAT.format(key)} AS lat, {LON.format(key)} AS lon FROM {table_})"


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), lat(key).alias("lat"), lon(key).alias("lon"))


HAVERSINE = "(2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - ({a}))))".format(a="pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)")


def sql_km(a: str, b: str) -> str:
    return HAVERSINE.format(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


#: A place hierarchy out of region, nation and customer: ids 1-9, 101-199, and 1000 on.
PLACES = """(SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(-1 AS BIGINT) AS parent_id, r_name AS name, 'region' AS placetype FROM region
 UNION ALL SELECT CAST(n_nationkey + 101 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), n_name, 'nation' FROM nation
 UNION ALL SELECT c_custkey + 1000, CAST(c_nationkey + 101 AS BIGINT), c_name, 'customer' FROM customer)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    row = lambda df, i, up, name, kind: df.select(i.cast("long").alias("id"), up.cast("long").alias("parent_id"), F.col(name).alias("name"), F.lit(kind).alias("placetype"))
    out = row(r, F.col("r_regionkey") + 1, F.lit(-1), "r_name", "region")
    out = out.unionByName(row(n, F.col("n_nationkey") + 101, F.col("n_regionkey") + 1, "n_name", "nation"))
    return out.unionByName(row(c, F.col("c_custkey") + 1000, F.col("c_nationkey") + 101, "c_name", "customer"))


class pick_by_key:
    """The same choice by a key, as a column [0], made when there is a session, and as SQL [1]."""

    def __init__(self, values: list[str], key: str) -> None:
        self.values, self.key = values, key

    def __getitem__(self, i: int) -> Column | str:
        n = len(self.values)
        if i == 0:
            return F.element_at(F.array(*map(F.lit, self.values)), (F.col(self.key) % n + 1).cast("int"))
        quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in self.values)
        return f"[{quoted}][CAST({self.key} % {n} + 1 AS INTEGER)]"


_DIRECTION = pick_by_key(["", "N ", "SW ", "", "East "], "c_custkey")
_STREET = pick_by_key(["Oak", "Main", "Élan", "Maple Hill", "St. Louis", "O’Neil", "Broadway"], "c_custkey")
_KIND = pick_by_key([" St", " Ave.", " Blvd", "", " Rd", " Lane"], "c_custkey")
_TOWN = pick_by_key(["Springfield", "Köln", "Saint-Étienne", "Oslo", "Portland", "Łódź", "New York", "Ávila"], "c_custkey")
_REGION = pick_by_key(["OR", "TX", "NY", "CA", "WA"], "c_custkey")
_COUNTRY = pick_by_key(["US", "DE", "FR", "NO", "US", "PL", "US", "ES"], "c_custkey")

_NUMBER = "CAST(c_custkey * 7 % 990 + 1 AS VARCHAR)"
_ZIP = "lpad(CAST(c_custkey * 379 % 90000 + 10000 AS VARCHAR), 5, '0')"
#: An address for each customer, fixed by its key.
ADDRESSES = f"""(SELECT c_custkey AS id, {_NUMBER} AS house_number, {_DIRECTION[1]} || {_STREET[1]} || {_KIND[1]} AS street, {_TOWN[1]} AS locality, {_REGION[1]} AS region, {_ZIP} AS postcode, {_COUNTRY[1]} AS country,
 {_NUMBER} || ' ' || {_DIRECTION[1]} || {_STREET[1]} || {_KIND[1]} || ', ' || {_TOWN[1]} || ', ' || {_REGION[1]} || ' ' || {_ZIP} AS raw FROM customer)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADDRESSES as a DataFrame."""
    number = (F.col("c_custkey") * 7 % 990 + 1).cast("string")
    postcode = F.lpad((F.col("c_custkey") * 379 % 90000 + 10000).cast("string"), 5, "0")
    street = F.concat(_DIRECTION[0], _STREET[0], _KIND[0])
    raw = F.concat(number, F.lit(" "), street, F.lit(", "), _TOWN[0], F.lit(", "), _REGION[0], F.lit(" "), postcode)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), number.alias("house_number"), street.alias("street"), _TOWN[0].alias("locality"),
        _REGION[0].alias("region"), postcode.alias("postcode"), _COUNTRY[0].alias("country"), raw.alias("raw"),
    )
