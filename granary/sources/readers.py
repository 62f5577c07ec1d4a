"""Sources: delimited files, line-delimited GeoJSON, adapters that map a source to canonical rows, and their checks."""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T

CANONICAL = ("raw", "components", "country", "locale", "source", "source_id", "corpus_version", "license")


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, header: bool = True, strict: bool = False) -> DataFrame:
    """A file's rows by header, all text unless a schema is given; `.tsv` and `.txt` are split at tabs.

    Strict: a row with another number of columns ends the job. Otherwise missing columns are null.
    """
    sep = sep or ("\t" if path.endswith((".tsv", ".txt")) else ",")
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def read_positional(spark: SparkSession, path: str, width: int, keep: Mapping[int, tuple[str, str]], sep: str = ",") -> DataFrame:
    """Some columns of a file by position: {position: (name, type)}. Only those are parsed, the rest is pruned."""
    rows = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
    return rows.select(*[F.col(f"c{i}").try_cast(kind).alias(name) for i, (name, kind) in keep.items()])


def read_geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One feature a line: the properties as columns, with lon and lat of point geometries. Blank lines are left out."""
    rows = spark.read.schema(f"type string, properties struct<{properties}>, geometry struct<type: string, coordinates: string>").json(path)
    point = F.when(F.col("geometry.type") == "Point", F.from_json("geometry.coordinates", "array<double>"))
    return rows.select("properties.*", F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))


@dataclass(frozen=True)
class Adapter:
    """How a source's rows become canonical ones. components: tag -> column; identity: the fields that name a row."""

    id: str
    read: Callable[[SparkSession, str], DataFrame]
    components: Mapping[str, Column]
    raw: Column
    country: Column
    license: str
    identity: tuple[str, ...]
    locale: Column = field(default_factory=lambda: F.lit(None).cast("string"))


class Registry:
    """Adapters in the order in which they were added."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[], Adapter]] = {}

    def add(self, make: Callable[[], Adapter]) -> Callable[[], Adapter]:
        if make.__name__ in self._known:
            raise ValueError(f"{make.__name__} is registered twice")
        self._known[make.__name__] = make
        return make

    def ids(self) -> list[str]:
        return list(self._known)

    def get(self, name: str) -> Adapter:
        return self._known[name]()


ADAPTERS = Registry()


def canonical_rows(adapter: Adapter, rows: DataFrame, version: str) -> DataFrame:
    """Rows of CANONICAL; empty components are left out of the map."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), T.empty_to_null(c).alias("value")) for k, c in sorted(adapter.components.items())]), lambda p: p["value"].isNotNull())
    return rows.select(
        T.collapse(adapter.raw).alias("raw"), F.map_from_entries(pairs).alias("components"), adapter.country.alias("country"), adapter.locale.alias("locale"),
        F.lit(adapter.id).alias("source"), T.source_id(F.lit(adapter.id), {k: F.col(k).cast("string") for k in adapter.identity}).alias("source_id"),
        F.lit(version).alias("corpus_version"), F.lit(adapter.license).alias("license"),
    )


def checked(rows: DataFrame, source: str) -> DataFrame:
    """The rows; one of another source, or without raw, id, country or license, ends the job with its id."""
    wrong = F.concat_ws(",", F.when(~F.col("source").eqNullSafe(source), "source"), *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", c) for c in ("source_id", "raw", "country", "license")])
    fail = F.raise_error(F.concat(F.lit("bad row "), F.coalesce("source_id", F.lit("?")), F.lit(": "), wrong))
    return rows.withColumn("raw", F.when(wrong == "", F.col("raw")).otherwise(fail.cast("string")))


def dedup_key() -> Column:
    """Country, sorted components and folded raw text, hashed: provenance doesn't count."""
    parts = F.array_sort(F.transform(F.map_entries("components"), lambda e: F.concat_ws("\u001f", e["key"], e["value"])))
    return F.sha2(F.concat_ws("\u001e", F.col("country"), F.array_join(parts, "\u001d"), T.canonical(F.col("raw"))), 256)


def run_adapter(spark: SparkSession, name: str, path: str, version: str, adapters: Registry = ADAPTERS) -> DataFrame:
    """Canonical rows of one source: read, mapped, checked, one of each dedup key (that of the least source_id)."""
    adapter = adapters.get(name)
    # A row without raw text or country names no place.
    rows = canonical_rows(adapter, adapter.read(spark, path), version).filter("raw <> '' AND country <> ''")
    keyed = checked(rows, adapter.id).withColumn("_key", dedup_key())
    first = F.min_by(F.struct(*CANONICAL), "source_id").alias("row")
    return keyed.groupBy("_key").agg(first).select("row.*")


def _line(*columns: str) -> Column:
    return F.concat_ws(" ", *[T.empty_to_null(F.col(c)) for c in columns])


@ADAPTERS.add
def ban() -> Adapter:
    """French addresses, semicolons."""
    street, town = _line("numero", "rep", "nom_voie"), _line("code_postal", "nom_commune")
    parts = {"house_number": _line("numero", "rep"), "street": F.col("nom_voie"), "postcode": F.col("code_postal"), "locality": F.col("nom_commune")}
    return Adapter("ban", lambda s, p: read_delimited(s, p, sep=";"), parts, F.concat_ws(", ", F.nullif(street, F.lit("")), F.nullif(town, F.lit(""))), F.lit("FR"), "Licence Ouverte 2.0", ("id",), F.lit("fr-FR"))


@ADAPTERS.add
def openaddresses() -> Adapter:
    """Line-delimited features with number, street, city, region and postcode."""
    parts = {"house_number": F.col("number"), "street": F.col("street"), "locality": F.col("city"), "region": F.col("region"), "postcode": F.col("postcode")}
    raw = F.concat_ws(", ", F.nullif(_line("number", "street"), F.lit("")), T.empty_to_null(F.col("city")), F.nullif(_line("region", "postcode"), F.lit("")))
    return Adapter("openaddresses", lambda s, p: read_geojson_lines(s, p, "hash string, number string, street string, unit string, city string, region string, postcode string"), parts, raw, F.lit("US"), "CC0-1.0", ("hash",), F.lit("en-US"))


@ADAPTERS.add
def geonames_postal() -> Adapter:
    """Postal places, tabs, without a header."""
    schema = "country string, code string, place string, admin1 string, admin1_code string, admin2 string, admin2_code string, admin3 string, admin3_code string, lat double, lon double, accuracy int"
    return Adapter("geonames_postal", lambda s, p: read_delimited(s, p, schema, "\t", header=False), {"locality": F.col("place"), "postcode": F.col("code"), "region": F.col("admin1")}, F.concat_ws(", ", _line("code", "place"), T.empty_to_null(F.col("admin1"))), F.col("country"), "CC-BY-4.0", ("country", "code", "place"))
