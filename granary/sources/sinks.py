"""Sinks: split Parquet shards with a manifest, JSON lines, sorted id lists, overlays and GeoJSON."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file, through Hadoop's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """A row per Parquet file: rows, bytes, least and greatest source_id, and a digest that no row order changes."""
    rows = spark.read.parquet(path)
    digest = F.sum(F.xxhash64(*[F.to_json(c) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"), F.min("source_id").alias("first_id"), F.max("source_id").alias("last_id"), digest.alias("digest"))


def write_shards(df: DataFrame, path: str, version: str, split: str = "split", most: int = 1_000_000) -> DataFrame:
    """Parquet by split, at most so many rows a file, and a table of the files under _manifest; returns that table.

    Rows are dealt by (split, hash of source_id) over the session's partitions, so that a large split is not one task.
    A folder that holds a manifest was written whole, and is left as it is.
    """
    spark = df.sparkSession
    manifest = f"{path}/_manifest"
    if not exists(spark, f"{manifest}/_SUCCESS"):
        dealt = df.repartition(F.col(split), F.pmod(F.xxhash64("source_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
        dealt.sortWithinPartitions(split, "source_id").write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy(split).parquet(path)
        shard_table(spark, path).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def typed_copy(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """JSON lines to Parquet with a schema. A line that doesn't parse, or spans out of order, end the job."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(source)
    if "span_starts" in rows.columns:
        starts, ends = F.col("span_starts"), F.col("span_ends")
        n = F.size(starts)
        fits = (n == F.size(ends)) & (n == F.size("span_tags"))
        later = F.slice(starts, 2, F.greatest(n - 1, F.lit(0)))
        ordered = F.forall(F.zip_with(F.slice(ends, 1, F.greatest(n - 1, F.lit(0))), later, lambda e, s: e <= s), lambda z: z) & F.forall(F.zip_with(starts, ends, lambda s, e: s < e), lambda z: z)
        good = F.when(fits, ordered).otherwise(False)
        rows = rows.withColumn("span_starts", F.when(F.coalesce(good, starts.isNull()), starts).otherwise(F.raise_error(F.lit("spans out of order")).cast("array<int>")))
    rows.write.mode("overwrite").parquet(target)


def write_id_lists(df: DataFrame, path: str, split: str = "split") -> None:
    """The source_ids of each split in byte order: files in order of their names hold ascending ids."""
    for (name,) in df.select(split).distinct().collect():
        df.filter(F.col(split) == name).select("source_id").orderBy("source_id").write.mode("overwrite").text(f"{path}/{name}")


def overlay(spark: SparkSession, parts: dict[str, str], path: str) -> dict:
    """A manifest that puts written corpora together by reference; ranges of ids tell which may hold a row."""
    out = {"parts": []}
    for name, where in sorted(parts.items()):
        total = spark.read.parquet(f"{where}/_manifest").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).first()
        out["parts"].append({"name": name, "path": where, **total.asDict()})
    write_text(spark, path, json.dumps(out, sort_keys=True))
    return out


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """A GeoJSON point feature; geometry is null without a coordinate."""
    point = F.when(lon.isNotNull() & lat.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line; read_geojson_lines reads them back."""
    features.select("feature").write.mode("overwrite").text(path)
