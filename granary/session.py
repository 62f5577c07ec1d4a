"""Local session used by the bench and the tests."""
from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int = 8, name: str = "granary") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
