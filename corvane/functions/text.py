"""Shingles and Jaccard distance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shingles(text: Column, k: int = 4) -> Column:
    """Sorted distinct k-character pieces of the lower-cased text; empty if it is shorter."""
    empty = F.array().cast("array<string>")

    def pieces(chars: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(chars) - k), lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))
        return F.when(F.size(chars) >= k, F.sort_array(F.array_distinct(cut))).otherwise(empty)

    # bound as a lambda variable, so that the text is taken apart once and not for every piece, and read by place
    return F.when(text.isNotNull(), F.get(F.transform(F.array(F.split(F.lower(text), "")), pieces), F.lit(0))).otherwise(empty)


def jaccard_distance(left: Column, right: Column) -> Column:
    """1 - |intersection| / |union| of two arrays of distinct values; two empty ones are at 1."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, 1 - F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(1.0))


def distance_from_counts(shared: Column, n: Column, m: Column) -> Column:
    """The same from the sizes; m + n - shared must not be 0."""
    return 1 - shared / (n + m - shared)
