"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def as_vector(values: Column) -> Column:
    """An ML vector, without a UDF."""
    return array_to_vector(F.transform(values, lambda x: x.cast("double")))


def scaled_columns(values: Column, columns: list[int], scales: list[float]) -> Column:
    """The chosen elements (from 0), each divided by its scale."""
    return F.array(*[F.get(values, F.lit(c)) / F.lit(float(s)) for c, s in zip(columns, scales, strict=True)])
