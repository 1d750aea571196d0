"""File sources and sinks. Schemas are given, not inferred, so no scan is spent on guessing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header. Values that do not parse become null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines of a file or folder, gzip included; without a schema it is inferred."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; one file if `single`, which sends all rows through one task: for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").json(path, compression=compression)


def flat_array(df: DataFrame, column: str, separator: str = "|") -> DataFrame:
    """An array column as text, for formats without arrays."""
    return df.withColumn(column, F.array_join(column, separator))


def number_range(spark: SparkSession, n: int, partitions: int = 16) -> DataFrame:
    """0 .. n-1 as `index`, made where it is used."""
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "index")


def local_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as rows (position, name, type, nullable)."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")
