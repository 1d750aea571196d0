"""Sessions for scripts and tests. Queries get theirs from the caller and never make one."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str, partitions: int = 16, master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session with adaptive execution, fixed shuffle and default parallelism, and quiet logs."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.default.parallelism": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
