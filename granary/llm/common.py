"""What the operators of this package share: the shared folder, whole-table digests and distributed running sums."""
from __future__ import annotations

import atexit
import math
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that every contract of this package means.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where it is unset and Spark runs in one process, a temporary folder is set in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: While a table is written, Arrow batches hold so many rows or bytes at most, which bounds what a Python worker and its
#: executor hold at once; long texts come alone.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: After a table of so many bytes, the driver collects garbage: only then does Spark drop the shuffle files behind it.
TIDY = 16 << 20
#: Seconds before that, since events of the job that still wait to be read hold its plan, and with it the files.
SETTLE = 1.0


def _length(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if _length(spark, path) >= TIDY:
        for _ in range(2):
            time.sleep(SETTLE)
            spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For free(): how many tables materialize() has written so far."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(since: int) -> None:
    """Delete the tables written since mark() but for the last, which is all that the result still reads."""
    for spark, path in _written[since:-1]:
        _delete(spark, path)
    del _written[since:-1]


def discard(at: int) -> None:
    """Delete the table that materialize() wrote as number `at`, counted as mark() does, when all that reads it is written."""
    _delete(*_written[at])


def release() -> None:
    """Delete every table that materialize() wrote in this process; results that read them end here."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended
            return


def as_text(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without_ids(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (_id), with all their columns, whatever they are called."""
    name = next(f"gone_{i}" for i in range(len(docs.columns) + 1) if f"gone_{i}" not in docs.columns)
    gone = gone.select(F.col("_id").alias(name))
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(name)), "left_anti")


def without_space(col: Column) -> Column:
    """The text without any character of SPACE, by byte-level replacement."""
    for c in " \n\t\r\x0b\x0c":
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def count_of(col: Column, character: str) -> Column:
    return F.char_length(col) - F.char_length(F.replace(col, F.lit(character), F.lit("")))


def buckets_for(rows: int, each: int = 50_000, least: int = 256) -> int:
    """Bits of an order key that deal rows into buckets of about `each`."""
    return max(int(math.log2(least)), math.ceil(math.log2(max(1, rows / each))))


def running_sums(df: DataFrame, group: list[str], order: Column, sums: dict[str, Column], rows: int, ties: list[str]) -> DataFrame:
    """Adds to each row the sums over the rows before it in its group, in the order of the 64-bit key `order`, then `ties`.

    No group meets in one task: rows are dealt by the leading bits of the key, a small table of (group, bucket) totals
    gives each bucket its start, and only the rows of one bucket are sorted together. df is read twice, so it should be
    cheap to read. The key must be spread evenly over 64 bits, as a hash is.
    """
    bits = buckets_for(rows)
    keyed = df.withColumn("_key", order).withColumn("_bucket", F.shiftright("_key", 64 - bits))
    at = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*at).agg(*[F.sum(c).cast("long").alias(f"_{k}_all") for k, c in sums.items()])
    starts = starts.select(
        *[F.col(g).alias(f"_at_{g}") for g in at],
        *[F.coalesce(F.sum(f"_{k}_all").over(before), F.lit(0)).alias(f"_{k}_start") for k in sums],
    )
    inside = Window.partitionBy("_bucket", *group).orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    dealt = keyed.repartition("_bucket").withColumns({f"_{k}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    same = [F.col(g).eqNullSafe(F.col(f"_at_{g}")) for g in at]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = dealt.join(starts, on, "left")
    return joined.select(*df.columns, *[(F.col(f"_{k}_in") + F.col(f"_{k}_start")).cast("long").alias(k) for k in sums])
