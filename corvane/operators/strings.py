"""A deterministic corpus of noisy copies of prototype strings, stratified samples and binary n-gram vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA, CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.config import ClusterConfig
from corvane.functions.text import shingles
from corvane.operators.checkpoints import cut
from corvane.sources.files import number_range


def _draw(n: int | Column, *key: Column) -> Column:
    """A number 0 .. n-1 that depends on the key only: the first 13 hex digits of the MD5 of its parts, modulo n."""
    digits = F.substring(F.md5(F.concat_ws(",", *[k.cast("string") for k in key])), 1, 13)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _letter(*key: Column) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(26, *key) + 1, F.lit(1))


def string_corpus(spark: SparkSession, c: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(index, prototype_id, string): copies of prototype index mod prototype_count with 4 to 9 edits, min_length to
    max_length characters, half of them with about 30 % capitals. Every value is a function of the seed and index."""
    index, seed = F.col("index"), F.lit(c.seed)
    proto = (index % c.prototype_count).cast("int")
    base = F.array_join(F.transform(F.sequence(F.lit(1), 40 + _draw(17, seed, proto, F.lit("n"))), lambda i: _letter(seed, proto, i)), "")
    edits = F.sequence(F.lit(1), 4 + _draw(6, seed, index, F.lit("e")))

    def edit(s: Column, k: Column) -> Column:
        n, at, new, kind = F.length(s), _draw(F.length(s), seed, index, k, F.lit("p")), _letter(seed, index, k, F.lit("c")), _draw(3, seed, index, k, F.lit("k"))
        head, tail, rest = F.substring(s, F.lit(1), at), F.substring(s, at + 1, n), F.substring(s, at + 2, n)
        return F.when(kind == 0, F.concat(head, new, rest)).when((kind == 1) & (n < c.max_length), F.concat(head, new, tail)).when((kind == 2) & (n > c.min_length), F.concat(head, rest)).otherwise(s)

    plain = F.aggregate(edits, base, edit)
    loud = F.array_join(F.transform(F.split("plain", ""), lambda ch, i: F.when(_draw(10, seed, index, i, F.lit("u")) < 3, F.upper(ch)).otherwise(ch)), "")
    rows = number_range(spark, c.total_strings, c.partitions).select(index.cast("int").alias("index"), proto.alias("prototype_id"), plain.alias("plain"))
    return rows.select("index", "prototype_id", F.when(_draw(2, seed, index, F.lit("m")) == 0, loud).otherwise(F.col("plain")).alias("string"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int = ClusterConfig.plot_sample) -> DataFrame:
    """Rows of every stratum by its share of n, rounded half to even and at least 1, then at most n of all.

    Which rows: the first by the MD5 of their key.
    """
    order = F.md5(F.col(key).cast("string"))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    quota = F.greatest(F.lit(1), F.bround(n * F.col("_size") / F.col("_total")))
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(stratum).orderBy(order, key)))
    taken = ranked.join(sizes, stratum).join(F.broadcast(total), F.lit(True)).where(F.col("_k") <= quota)
    return taken.orderBy(order, key).limit(n).select(*rows.columns)


def gram_vectors(strings: DataFrame, k: int = ClusterConfig.shingle, most: int = 1 << 19) -> DataFrame:
    """(id, features): binary vectors over all character k-grams that occur; more than `most` of them are refused."""
    sets = cut(strings.select("id", shingles(F.col("string"), k).alias("grams")))
    n = sets.select(F.explode("grams")).distinct().count()
    if n > most:
        raise ValueError(f"{n} distinct {k}-grams, more than the {most} that the driver is to hold")
    return CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=max(n, 1)).fit(sets).transform(sets).select("id", "features")


def plane(vectors: DataFrame, k: int = 3) -> DataFrame:
    """Principal components as plot coordinates: Spark has no distributed t-SNE, for which this stands in."""
    return PCA(k=k, inputCol="features", outputCol="coords").fit(vectors).transform(vectors).select("id", "coords")
