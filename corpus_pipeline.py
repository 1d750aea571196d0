"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding.

Each stage reads what its predecessor kept, as written, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.decontam import drop_contaminated
from corvane.llm.linededup import drop_recurring
from corvane.llm.ngram_join import keep_one
from corvane.llm.pieces import encode
from corvane.llm.store import shared_table_root
from corvane.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars is that of the text that stays. Every document stays."""
    clean = drop_recurring(docs.select(*COLUMNS))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that stays, and whether they decode to its text."""
    return encode(docs.select("doc_id", "text", "source")).select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontamination), ("SentencePiece encoding", sentencepiece)]

#: The first stage is a trained model, which SQL cannot express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_table_root(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
