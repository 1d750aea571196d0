"""Language identification, word first: known words score by their log frequency in each language; an unseen
word falls back to its character n-grams, from the longest known length down to single characters.

Training counts all words of a bounded share of the documents with a language (documented bounds of a classifier's
sample): about `max_rows` documents and `max_chars` characters, the rows divided equally among the languages, so that a
rare language is learned too. Counting is by DataFrame functions; n-gram counts come from the words. The tables, of
which the sample bounds the size, are broadcast; prediction is one narrow pass over all whole texts, in which a worker
looks every distinct token up once.

Defined results: null texts and texts without a letter are `und` with score 0; texts of which no n-gram is known get
the language of most documents; of languages with equal scores the first by name is predicted; with nothing to learn
from every text is `und`; a row that is repeated counts as often as it is there; repeated rows give repeated results;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import Memo, bounded_share, map_texts, trim
from corvane.llm.native import held_out

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    max_rows: int = 10_000
    max_chars: int = 8_000_000
    max_gram: int = 4
    backoff_weight: float = 0.4


@dataclass(frozen=True)
class Logs:
    """Log frequencies of keys, a row of `table` each and a column a language, less the largest of the row."""

    at: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    @staticmethod
    def of(at: dict[str, int], weight: np.ndarray) -> Logs:
        logs = np.log((weight + 0.5) / (weight.sum(axis=0) + 0.5 * len(at))) if len(at) else weight
        return Logs(at, (logs - logs.max(axis=1, keepdims=True)).astype(np.float32) if logs.size else logs)


@dataclass(frozen=True)
class LangModel:
    params: LangParams
    langs: list[str]
    prior: np.ndarray
    words: Logs = field(default_factory=Logs)
    grams: list[Logs] = field(default_factory=list)

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency of a word, or the mean over the longest length of which n-grams are known."""
        if (known := self.words.at.get(word)) is not None:
            return self.words.table[known]
        marked = f"<{word}>"
        for n in range(len(self.grams), 0, -1):
            get = self.grams[n - 1].at.get
            found = [k for i in range(len(marked) - n + 1) if (k := get(marked[i : i + n])) is not None]
            if found:
                return self.grams[n - 1].table[found].sum(axis=0) * (self.params.backoff_weight / len(found))
        return np.zeros(len(self.langs), np.float32)

    def predictor(self):
        rows: list[np.ndarray] = []

        def place(raw: str) -> int:
            word = letters(raw)
            rows.append(self.word_scores(word) if word else np.zeros(len(self.langs), np.float32))
            return len(rows) - 1

        memo, table, size = Memo(place, most=1 << 62), np.zeros((0, len(self.langs)), np.float32), 0
        most = 96_000_000 // (200 + 8 * max(len(self.langs), 1))  # words of which a worker keeps the scores

        def predict(text: str | None) -> tuple[str, float]:
            nonlocal table, size
            if not self.langs or text is None or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0
            if len(rows) > most:
                memo.clear()
                rows.clear()
                size = 0
            raw = text.split()
            at = np.fromiter((memo[w] for w in raw), np.int64, len(raw))
            if len(rows) > size:
                if len(rows) > len(table):
                    table = np.concatenate([table[:size], np.zeros((len(rows) + 4096 - size, len(self.langs)), np.float32)])
                table[size : len(rows)] = rows[size:]
                size = len(rows)
            s = self.prior + table[at].sum(axis=0, dtype=np.float64)
            e = np.exp(s - s.max())
            best = int(e.argmax())
            return self.langs[best], float(e[best] / e.sum())

        return predict


def letters(raw: str) -> str:
    """The token in lower case, only its letters."""
    low = raw.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


def build(lang: list[str], word: list[str], n: np.ndarray, docs_by_lang: dict[str, int], p: LangParams = LangParams()) -> LangModel:
    """Language, word and count of each pair that occurs."""
    langs = sorted(docs_by_lang)
    at = {name: k for k, name in enumerate(langs)}
    n_docs = sum(docs_by_lang.values()) or 1
    prior = np.array([math.log(docs_by_lang[name] / n_docs) for name in langs])
    words: dict[str, int] = {}
    row = np.array([words.setdefault(w, len(words)) for w in word], np.int64)
    weight = np.zeros((len(words), len(langs)), np.float32)
    np.add.at(weight, (row, np.array([at[x] for x in lang], np.int64)), n)
    damped, grams = np.log1p(weight), []
    for k in range(1, p.max_gram + 1):
        names: dict[str, int] = {}
        to = np.fromiter((names.setdefault(m[i : i + k], len(names)) for w in words for m in (f"<{w}>",) for i in range(len(m) - k + 1)), np.int32)
        of = np.repeat(np.arange(len(words)), [max(0, len(w) + 3 - k) for w in words])
        sums = np.zeros((len(names), len(langs)), np.float32)
        np.add.at(sums, to, damped[of])
        grams.append(Logs.of(names, sums))
    return LangModel(p, langs, prior - prior.max() if len(langs) else prior, Logs.of(words, weight), grams)


def train(docs: DataFrame, p: LangParams = LangParams(), folds: int = 5) -> LangModel:
    known = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds))
    docs_by_lang = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, p.max_rows // max(len(docs_by_lang), 1))
    unit = 1 << 30
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(unit))
    crowded = {name: int(each / n * unit) for name, n in docs_by_lang.items() if n > each}
    most = F.lit(unit)
    for name, k in sorted(crowded.items()):
        most = F.when(F.col("lang") == name, k).otherwise(most)
    share = bounded_share(known.where(part < most), p.max_chars, F.col("doc_id"), size=F.length("text"), seed=18)
    token = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counts = share.select("lang", token).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    got = counts.orderBy("lang", "word").toArrow()
    model = build(got.column("lang").to_pylist(), got.column("word").to_pylist(), got.column("n").to_numpy(), docs_by_lang, p)
    del got
    trim()
    return model


def predict(docs: DataFrame, model: LangModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        one = shared.value.predictor()

        def work(batch: list) -> dict:
            pairs = [one(t) for t in batch]
            return {"lang_pred": [a for a, _ in pairs], "score": [b for _, b in pairs]}

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, "lang_pred string, score double", setup)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
