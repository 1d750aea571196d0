"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold[k] - w.x). Training reads about `max_rows` rated rows and `max_chars` characters of
their texts at most (documented bounds of a classifier's sample) and sends hashed features to the driver; scoring is
one narrow pass over all whole texts and gives the expected grade, the tail probability P(grade >= tail) and the
selection by it.

Defined results: null and empty texts share one feature of their own; rows without a rating, or with a negative one,
are not learned from; an id with several ratings has the highest; rows with the same rating and features are learned
from once; with no rated row, or one grade only, every text gets that grade (0 if none); a tail probability of exactly
`keep_at` is kept; repeated rows give repeated results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import lists, map_texts, training_texts, trim
from corvane.llm.features import TextShape
from corvane.llm.native import held_out


@dataclass(frozen=True)
class OrdinalParams:
    bits: int = 18
    rate: float = 0.3
    l2: float = 1e-5
    epochs: int = 8
    max_rows: int = 8_000
    max_chars: int = 48_000_000
    seed: int = 11


@dataclass(frozen=True)
class OrdinalModel:
    params: OrdinalParams
    thresholds: np.ndarray
    weight: np.ndarray

    def at_most(self, s: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last, a row for each score."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.asarray(s)[:, None], -30, 30)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, p: OrdinalParams = OrdinalParams()) -> OrdinalModel:
    """AdaGrad on the negative log likelihood; thresholds are kept in order after every step."""
    top = int(grades.max()) if len(grades) else 0
    w, gw = np.zeros(1 << p.bits, np.float64), np.full(1 << p.bits, 1e-6)
    share = np.array([(grades <= k).mean() for k in range(top)]) if top else np.zeros(0)
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gt, rng = np.full(top, 1e-6), np.random.default_rng(p.seed)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for _ in range(p.epochs if top else 0):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            y, s = grades[k], float(w[at] @ x)
            hi = sig(theta[y] - s) if y < top else 1.0
            lo = sig(theta[y - 1] - s) if y > 0 else 0.0
            mass = max(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi), lo * (1 - lo)
            g = np.clip((dhi - dlo) / mass, -4, 4) * x + p.l2 * w[at]  # d loss / d w
            gw[at] += g * g
            w[at] -= p.rate * g / np.sqrt(gw[at])
            for j, d in ((y, -dhi / mass), (y - 1, dlo / mass)):
                if 0 <= j < top:
                    gt[j] += d * d
                    theta[j] -= p.rate * 0.3 * d / np.sqrt(gt[j])
            theta.sort()
    return OrdinalModel(p, theta, w.astype(np.float32))


def train(docs: DataFrame, ratings: DataFrame, p: OrdinalParams = OrdinalParams(), folds: int = 5) -> OrdinalModel:
    """ratings: doc_id, grade (0, 1, ...). Rows of the held-out fold are not learned from."""
    known = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where((F.col("grade") >= 0) & ~held_out(F.col("doc_id"), folds))
    texts = training_texts(docs, known.groupBy("doc_id").agg(F.max("grade").alias("grade")), "grade", p.max_rows, p.max_chars)

    def setup():
        shape = TextShape(p.bits)

        def work(batch: list) -> dict:
            pairs = [shape(t) for t in batch]
            at = [a.astype(np.int32) for a, _ in pairs]
            x = [v for _, v in pairs]
            return {"at": at, "x": x, "digest": [xxhash.xxh3_64_intdigest(a.tobytes() + v.tobytes()) >> 1 for a, v in zip(at, x, strict=True)]}

        return work

    one = map_texts(texts, "at array<int>, x array<float>, digest bigint", setup).groupBy("grade", "digest")
    got = one.agg(F.first(F.struct("at", "x")).alias("row")).select("grade", "digest", "row.at", "row.x").toArrow()
    y, rows = got.column("grade").to_numpy().astype(np.int64), lists(got, "at", "x")
    order = np.lexsort((got.column("digest").to_numpy(), y))
    model = fit_ordinal([rows[k] for k in order], y[order], p)
    del got, rows
    trim()
    return model


def rate(docs: DataFrame, model: OrdinalModel, tail: int = 1, keep_at: float = 0.5, folds: int = 5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, kept for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        m = shared.value
        shape = TextShape(m.params.bits)

        def work(batch: list) -> dict:
            s = np.array([float(m.weight[a] @ v) for a, v in map(shape, batch)])
            above = 1 - m.at_most(s)
            last = above[:, tail - 1] if 0 < tail <= above.shape[1] else np.full(len(s), float(tail <= 0))
            return {"expected_grade": above.sum(axis=1), "tail_prob": last}

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, "expected_grade double, tail_prob double", setup).withColumn("kept", F.col("tail_prob") >= keep_at)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: sound but toxic; 2: sound. Null without a quality label; an unknown toxicity counts as none."""
    return F.when(quality == 0, 0).when((quality == 1) & (F.coalesce(toxic, F.lit(0)) == 1), 1).when(quality == 1, 2)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return rate(docs, train(docs, ratings)).select("doc_id", "held_out", "expected_grade", "tail_prob", "kept")
