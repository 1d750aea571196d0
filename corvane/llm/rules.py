"""Quality rules, line first: failing lines are removed, then documents that lost too much are rejected.

Everything is one narrow projection of built-in functions: no shuffle, no Python. A document's lines and
words live in arrays inside its row, so cost and memory follow the longest document, never a group.

Defined results: null text counts as empty; an empty text has no words, fails the base rule (too few words)
and is not kept; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.native import SPACE, let, non_null, space_words, window_hashes

SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under|privacy policy|cookie policy|uses? cookies|terms of (use|service)|"
    r"enable javascript|subscribe to|sign up for|log in to|click here|lorem ipsum)"
)
TERMINAL = r"[.!?:;…。！？\"'”’»)\]}]$"


@dataclass(frozen=True)
class LineRules:
    """Shares are in per cent, so that every comparison is of whole numbers."""

    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    nav_separators: int = 2
    short_line_words: int = 4
    max_symbol_pct: int = 30
    max_shout_pct: int = 30
    max_lost_pct: int = 50


def repeated_words(words: Column, width: int) -> Column:
    """Words that lie in a window of `width` words which the text has twice or more."""
    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
            return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

        first = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-width).cast("int").alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).cast("int").alias("n"), p.cast("int").alias("last"))
        return F.aggregate(let(ordered, starts), first, step, lambda a: a["n"])

    return let(window_hashes(words, width), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("long")


def line_fails(line: Column, rules: LineRules) -> Column:
    """Navigation, boilerplate or punctuation rule broken; `line` has at least one word."""
    n = F.size(space_words(line))
    navigation = F.regexp_count(line, F.lit(r"\|")) >= rules.nav_separators
    boilerplate = line.rlike(BOILERPLATE)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 100 > n * rules.max_symbol_pct
    shouting = F.regexp_count(line, F.lit("!!")) * 100 > n * rules.max_shout_pct
    fragment = (n < rules.short_line_words) & ~F.rtrim(line).rlike(TERMINAL)
    return navigation | symbols | shouting | fragment | boilerplate


def evaluate(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the counts, the base verdict, the verdict and the cleaned text."""
    base = docs.select(F.col(id_col).alias("doc_id"), non_null(F.col(text_col)).alias("body"))
    blank = F.regexp_replace("body", SPACE, "")
    has_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    counted = base.select(
        "doc_id",
        "body",
        let(space_words(F.col("body")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, rules.window).alias("r"))).alias("w"),
        F.length(blank).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split("body", "\n"), has_word),
            lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"), F.filter(ls, lambda x: ~line_fails(x, rules)).alias("good")),
        ).alias("l"),
    )
    flat = counted.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.array_join("l.good", "\n").alias("clean_text"),
    )
    kept_chars = F.length(F.regexp_replace("clean_text", SPACE, "")).cast("long")
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    judged = flat.withColumn("base_failed", base_failed).withColumn("kept_chars", kept_chars)
    kept = ~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("kept_chars")) <= rules.max_lost_pct * F.col("word_chars"))
    return judged.withColumn("kept", kept)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return evaluate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
