"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads about `max_rows` labelled rows and `max_chars` characters of their texts at most (documented bounds of
a classifier's sample), chosen by hashes of the document id; their feature indexes, never their texts, reach the
driver. The L1 penalty leaves a few thousand weights, which are broadcast. Scoring is one narrow pass over all whole
texts.

Defined results: null and empty texts have no features and get the intercept's score; labels that are null, or
neither 0 nor 1, are not learned from; an id with both labels counts as toxic; rows with the same label and features
are learned from once; an untrained model (no labelled row) scores 0.5 less a hair for everything (predicted 0), and a
score of exactly 0.5 is predicted 1; repeated rows give repeated results; score() ignores other columns, whatever
their names, and drop_toxic() passes them unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import keep_where, lists, map_texts, training_texts, trim
from corvane.llm.features import NGrams
from corvane.llm.native import held_out


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    skips: tuple[int, ...] = (1, 2, 3)
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 6
    max_rows: int = 10_000
    max_chars: int = 48_000_000
    seed: int = 7


@dataclass(frozen=True)
class ToxicModel:
    params: FtrlParams
    intercept: float = -1e-6
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def scorer(self):
        grams = NGrams(self.params.bits, self.params.skips)
        dense = np.zeros(1 << self.params.bits, np.float32)
        dense[self.index] = self.weight

        def score(text: str | None) -> float:
            at = grams(text)
            return float(1 / (1 + np.exp(-np.clip(self.intercept + dense[at].sum(), -30, 30))))

        return score


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, p: FtrlParams = FtrlParams()) -> ToxicModel:
    """Per-coordinate FTRL-proximal over binary features; the intercept has its own unpenalised coordinate."""
    if not len(rows):
        return ToxicModel(p)
    size = 1 << p.bits
    z, n, rng = np.zeros(size + 1), np.zeros(size + 1), np.random.default_rng(p.seed)
    l1 = np.full(size + 1, p.l1)
    l1[size] = 0.0
    bias = np.array([size])

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1[at], 0.0, (np.sign(za) * l1[at] - za) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            at = np.concatenate([rows[k], bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:size])
    return ToxicModel(p, float(w[size]), index, w[index].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams(), folds: int = 5) -> ToxicModel:
    """Learns from labelled rows outside the held-out fold; each (doc_id, text) counts once."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds))
    texts = training_texts(docs, known.groupBy("doc_id").agg(F.max("label").alias("label")), "label", p.max_rows, p.max_chars)

    def setup():
        grams = NGrams(p.bits, p.skips)

        def work(batch: list) -> dict:
            made = [grams(t).astype(np.int32) for t in batch]
            return {"at": made, "digest": [xxhash.xxh3_64_intdigest(a) >> 1 for a in made]}

        return work

    got = map_texts(texts, "at array<int>, digest bigint", setup).groupBy("label", "digest").agg(F.first("at").alias("at")).toArrow()
    y, rows = got.column("label").to_numpy(), lists(got, "at")
    order = np.lexsort((got.column("digest").to_numpy(), y))
    model = fit_ftrl([rows[k][0] for k in order], y[order], p)
    del got, rows
    trim()
    return model


def score(docs: DataFrame, model: ToxicModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        one = shared.value.scorer()
        return lambda batch: {"score": [one(t) for t in batch]}

    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, "score double", setup).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams(), threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold, in one narrow pass that sends each text once."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def setup():
        one = shared.value.scorer()
        return lambda batch: [one(t) < threshold for t in batch]

    return keep_where(docs, setup)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
