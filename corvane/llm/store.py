"""Tables in the shared folder that the cluster names, and joins whose broadcast side is checked first."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests on one machine) a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop's."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            pass


def shared_table_root(spark: SparkSession, name: str) -> str:
    """A new folder for tables in the shared folder, which is removed when the process ends."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, root))
    return root


class Tables:
    """Written tables of one operator call: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_table_root(spark, name)
        self.at: dict[str, str] = {}
        self.n = 0

    def write(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        """Writes `df` as the table `name`; an earlier version stays until drop_old or the process ends."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        old, self.at[name] = self.at.get(name), path
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.at:
                remove(self.spark, self.at.pop(n))


def join_checked(big: DataFrame, small: DataFrame, on, how: str, rows: int, most_rows: int = 2_000_000) -> DataFrame:
    """Joins with `small` broadcast if its counted `rows`, of a few numbers each, are at most `most_rows`."""
    return big.join(F.broadcast(small) if rows <= most_rows else small, on, how)
