"""Uncentred SVD, leverage scores and deterministic CUR embeddings of tall matrices.

A matrix is a DataFrame with a key and an array of doubles. Only its d x d Gram matrix, d being the number of columns,
reaches the driver, where the eigenvectors are found; it is summed where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import l2_norm, scaled_columns
from corvane.operators.checkpoints import cut


@dataclass(frozen=True)
class Basis:
    """Right singular vectors as columns, by falling singular value."""

    singular: np.ndarray
    v: np.ndarray

    def leverage(self, k: int) -> np.ndarray:
        """Sums to 1 over the columns."""
        return (self.v[:, :k] ** 2).sum(axis=1) / k

    def columns(self, k: int) -> list[int]:
        """The k columns of highest leverage; equal ones (to 12 digits) by the higher index, as at full rank."""
        score = np.round(self.leverage(k), 12)
        return [int(i) for i in sorted(range(len(score)), key=lambda i: (-score[i], -i))[:k]]


def svd_basis(matrix: DataFrame, values: str = "features", k: int | None = None) -> Basis:
    """The uncentred SVD without U. The d(d+1)/2 sums of products of columns are one aggregation."""
    width = matrix.select(F.max(F.size(values))).first()[0]
    rows = matrix.select(F.transform(values, lambda x: x.cast("double")).alias("v"))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = rows.select(*[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))).alias(f"s{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((width, width))
    for (i, j), x in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = x
    value, vector = np.linalg.eigh(gram)
    order = np.argsort(value)[::-1][:k]
    return Basis(np.sqrt(np.maximum(value[order], 0)), vector[:, order])


def top_rows(matrix: DataFrame, key: str, k: int, values: str = "features") -> DataFrame:
    """(key, norm) of the k rows of largest norm; among equals the larger key."""
    return matrix.select(key, l2_norm(F.col(values)).alias("norm")).orderBy(F.desc("norm"), F.desc(key)).limit(k)


def cur_embedding(matrix: DataFrame, basis: Basis, k: int, values: str = "features") -> DataFrame:
    """Replaces the values by those of the k selected columns, each over sqrt(max(k * leverage, 1e-12))."""
    columns, score = basis.columns(k), basis.leverage(k)
    scales = [float(np.sqrt(max(k * score[c], 1e-12))) for c in columns]
    return matrix.withColumn(values, scaled_columns(F.col(values), columns, scales))


def cur_factors(matrix: DataFrame, basis: Basis, key: str, k: int, values: str = "features") -> DataFrame:
    """(factor, position, key, values): U, the pseudo-inverse of the k x k intersection of the selected rows and
    columns, and R, the k rows of largest norm, row by row. The k rows are what reaches the driver."""
    picked = matrix.join(F.broadcast(top_rows(matrix, key, k, values).select(key, "norm")), key).orderBy(F.desc("norm"), F.desc(key)).limit(k).select(key, values).collect()
    r = np.array([x[values] for x in picked], dtype=float)
    u = np.linalg.pinv(r[:, basis.columns(k)])
    rows = [("U", i, None, [float(x) for x in u[i]]) for i in range(len(u))] + [("R", i, str(x[key]), [float(y) for y in r[i]]) for i, x in enumerate(picked)]
    return matrix.sparkSession.createDataFrame(rows, "factor string, position int, key string, values array<double>")


def embedding_preview(embedded: DataFrame, key: str, k: int, values: str = "features", rows: int = 5) -> DataFrame:
    """The first rows by key, with the values as columns f_1 .. f_k."""
    return embedded.orderBy(key).limit(rows).select(key, *[F.get(values, F.lit(i)).alias(f"f_{i + 1}") for i in range(k)])


def _sparse(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, value) of ML vectors, dense ones with all places, without a UDF."""
    raw = vectors.select(key, F.unwrap_udt(column).alias("x"))
    places = F.coalesce("x.indices", F.sequence(F.lit(0), F.size("x.values") - 1))
    return raw.select(key, places.alias("at"), F.col("x.values").alias("value"))


def _batches(part: pa.RecordBatch, most: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, index of the row of each entry, its place, its value)."""
    for k in range(0, part.num_rows, most):
        b = part.slice(k, most)
        at, value = (b.column(c) for c in ("at", "value"))
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(at).to_numpy())
        yield b, row, at.flatten().to_numpy(), value.flatten().to_numpy()


def _sums(at: np.ndarray, columns: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The sums, column by column, of the values that go to each of n places; one column is held at a time."""
    return np.stack([np.bincount(at, x, n) for x in columns], axis=1)


def sparse_svd_projection(vectors: DataFrame, key: str, k: int, column: str = "features", rounds: int = 4, seed: int = 42) -> DataFrame:
    """(key, coords) of the truncated uncentred SVD of ML vectors, by subspace iteration.

    Each round is one pass that sums A'(A Q) over Arrow batches where the rows are and by place in the executors, with
    a few columns more than k; what the driver holds is a matrix of features x (k + 8), so the number of features must
    have a bound, as a vocabulary has.
    """
    rows = cut(_sparse(vectors, key, column))
    context, width = vectors.sparkSession.sparkContext, rows.select(F.max(F.array_max("at"))).first()[0] + 1
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(k + 8, width))))[0]
    size = q.shape[1]

    def images(batches: Iterator[pa.RecordBatch], q: np.ndarray) -> Iterator[tuple]:
        for part in batches:
            for b, row, at, value in _batches(part):
                yield b, row, at, value, _sums(row, (value * x[at] for x in q.T), b.num_rows)

    def pass_of(shared, inner: bool) -> np.ndarray:
        """A'(A Q), or (A Q)'(A Q)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size if inner else width, size))
            for _, row, at, value, y in images(batches, shared.value):
                if inner:
                    out += y.T @ y
                else:
                    for c, x in enumerate(y.T):
                        out[:, c] += np.bincount(at, value * x[row], width)
            some = np.flatnonzero(out.any(axis=1))
            for k in range(0, len(some), 50_000):
                part = some[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(out[part].ravel()), size).cast(pa.list_(pa.float64()))], names=["place", "v"])

        each = rows.select("at", "value").mapInArrow(run, "place bigint, v array<double>")
        sums = each.groupBy("place").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(size)]).alias("v")).toArrow()
        total = np.zeros((size if inner else width, size))
        if sums.num_rows:
            total[sums.column("place").to_numpy()] = np.array(sums.column("v").to_pylist())
        return total

    for _ in range(rounds):
        shared = context.broadcast(q)
        q = np.linalg.qr(pass_of(shared, False))[0]
        shared.destroy()
    value, vector = np.linalg.eigh(pass_of(context.broadcast(q), True))
    v = context.broadcast(q @ vector[:, np.argsort(value)[::-1][:k]])

    def coords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for b, row, at, value in _batches(part):
                y = _sums(row, (value * x[at] for x in v.value.T), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(y), pa.list_(pa.float64()))], names=[key, "coords"])

    return rows.mapInArrow(coords, f"{key} {vectors.schema[key].dataType.simpleString()}, coords array<double>")
