"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Documents are read and cut into words once: every window, of each width that the benchmark has, is hashed inside the
row that holds its words; (width, hash, start) is generated and meets the hash set at once, and the words are looked at
again for the few windows that the set lets through, whose text must equal the benchmark's. One more entry a document
carries its number of words through the same join, so no second pass counts them. The benchmark's windows are written
once and broadcast only when their measured size is under `max_broadcast_mb`; beyond that the windows of the documents
are shuffled to them by hash, and the text of a hit is verified where its words are, with the same result.

Defined results: null and empty texts have no words and no hits; an item without words gives no window; windows
that several items share count for each item; an item without an id counts in n_hit and is in no list of items; items with
the same id are one in the list; repeated rows of documents give repeated results, and rows of one id with different
texts a result each; contamination() ignores other columns of either table, whatever their names, and
drop_contaminated() passes those of docs unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.native import LOWER, UPPER, let, non_null, window_hashes
from corvane.llm.store import Tables, join_checked

#: Characters that separate words once A-Z are lower case.
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of digits, letters a-z and everything beyond ASCII, with only A-Z lowered."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), OTHER), "")


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Distinct windows (n, h, gram) with the ids of the items they come from; an item of fewer words is one window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(non_null(F.col("text"))).alias("words"))
    sized = words.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(width)))
    starts = sized.select("item", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    grams = starts.select("item", "n", F.slice("words", F.col("at"), F.col("n")).alias("w"))
    keyed = grams.select("item", "n", F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("h"), F.array_join("w", " ").alias("gram"))
    return keyed.groupBy("n", "h", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hashed(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(key, words, n, h, start) for every window of a document, and once a document n = 0 with its number of words
    as start."""
    words = docs.select("key", item_words(F.col("body")).alias("words"))
    sized = lambda n: F.transform(window_hashes(F.col("words"), n), lambda h, i: F.struct(F.lit(n).alias("n"), h.alias("h"), i.cast("int").alias("start")))
    own = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("h"), F.size("words").alias("start")))
    return words.select("key", "words", F.explode(F.concat(own, *[sized(n) for n in widths])).alias("x")).select("key", "words", "x.n", "x.h", "x.start")


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_broadcast_mb: int = 256) -> DataFrame:
    """(key, start, n, items) for every occurrence of a benchmark window, with start counting words from 0; and one
    row of n = 0 for every row of `docs`, of which start is the number of words.

    `docs` has the columns key and body.
    """
    windows = Tables(docs.sparkSession, "decontamination").write(benchmark_windows(benchmark, width), "windows")
    size = windows.agg(F.coalesce(F.sum(F.length("gram") + 16 * F.size("items") + 64), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("n")).alias("widths")).first()
    hashed = _hashed(docs, size["widths"])
    side = windows.select(F.col("n").alias("m"), F.col("h").alias("g"), "gram", "items")
    same = (F.col("n") == F.col("m")) & (F.col("h") == F.col("g"))
    text = F.array_join(F.slice("words", F.col("start") + 1, F.greatest(F.col("n"), F.lit(1))), " ") == F.col("gram")
    if size["bytes"] <= max_broadcast_mb * 1_000_000:
        return hashed.join(F.broadcast(side), same & text, "left").where("n = 0 OR gram IS NOT NULL").select("key", "start", "n", "items")
    found = hashed.where("n > 0").select("key", "n", "h", "start").join(side, same, "left_semi").select("key", "n", "h", "start")
    again = docs.dropDuplicates(["key"]).select("key", item_words(F.col("body")).alias("words")).join(found.distinct(), "key")
    hits = again.join(side, same & text).select("key", "start", "n", "items")
    return hits.unionAll(hashed.where("n = 0").select("key", "start", "n", F.lit(None).cast("array<string>").alias("items")))


def covered(spans: Column) -> Column:
    """Words inside the union of spans, an array of struct(start, n)."""
    first = F.struct(F.lit(0).cast("int").alias("hit"), F.lit(0).cast("int").alias("end"))

    def step(a: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct((a["hit"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).cast("int").alias("hit"), F.greatest(a["end"], end).cast("int").alias("end"))

    return F.aggregate(F.sort_array(spans), first, step, lambda a: a["hit"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_broadcast_mb: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted), spans (sorted), contaminated."""
    rows = docs.select("doc_id", non_null(F.col("text")).alias("body")).select(F.struct("doc_id", F.xxhash64("body").alias("t")).alias("key"), "body")
    hits = find_hits(rows, benchmark, width, max_broadcast_mb)
    own = F.col("n") == 0
    each = hits.groupBy("key").agg(
        F.max(F.when(own, F.col("start"))).alias("n_words"), F.sum(own.cast("int")).alias("copies"), F.collect_set(F.when(~own, F.struct("start", "n"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    out = each.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"),
        F.sort_array("items").alias("items"),
        F.sort_array("spans").alias("spans"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy").withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_hit_pct: int = 0, max_broadcast_mb: int = 256) -> DataFrame:
    """Documents, all columns, of which at most max_hit_pct per cent of the words are hit."""
    bad = contamination(docs, benchmark, width, max_broadcast_mb).where(100 * F.col("n_hit") > max_hit_pct * F.col("n_words"))
    bad = Tables(docs.sparkSession, "decontamination").write(bad.select(F.col("doc_id").alias("bad_id")).distinct(), "bad")
    return join_checked(docs, bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti", bad.count())


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
