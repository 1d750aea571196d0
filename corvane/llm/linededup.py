"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its token count, then its leading tokens; variable fields (tokens with a digit) are
wildcards from the start. A leaf's templates generalise further: the tokens after the leading ones form `blocks`
runs by position, and a template has two runs as wildcards, so lines of one path that agree on all other runs share it.
One more has every capitalised token after the leading ones and every one with a digit as a wildcard, if they are three
at least. A template needs fixed words for half of its tokens; where no pair of runs leaves them, one run is a wildcard
(from `min_general` tokens on whatever stays), or none. Lines that share a template with fewer wildcards share those with more, so the
former are only made where the latter are not. Fields among the leading tokens, in lower case in more than two runs, or
of varying length are not generalised. A template is one hash, its leaf (path) in the high bits and its fixed tokens and
kind in the others; hence no task holds the tree or a leaf: counting the distinct texts of every template is one
aggregation that combines before it shuffles, whatever the size of a leaf. The levels of the tree are counted in turn:
only leaves that lines of two distinct texts have are parsed to templates, and when lines are dropped only those with a
recurring template. A template in at least `min_docs` distinct texts recurs, from `long_tokens` tokens on in `long_docs`, and its
lines are dropped from all documents but the one with the smallest id.

Lines of fewer than `min_tokens` tokens have one template, of all their tokens, and must be in more distinct texts to
recur: `few_docs`, or `least_docs` from one or two tokens. In them a token with a digit is a wildcard only beside two
words or more that are half of the tokens at least, so that 'Page 3 of 9' is a template and 'Total 3' is itself. Lines
without a letter have no template when they are that short. How many texts a template needs is in its two lowest bits.

Exact copies of a document count as one text, so copies alone never make a line recur: they are left for the
near-duplicate stage.

The recurring templates are broadcast up to `max_broadcast` of them (16 bytes each); beyond, the same decision is a
shuffle join.

Defined results: null text counts as empty and comes back as null; a text all of whose lines are dropped becomes
empty, its row stays; lines are split at \\n only and kept lines are unchanged; rows without an id keep their lines, and
count as texts; of texts with the same id the id alone decides, so all rows of the smallest id keep the line, and so do
repeated rows of it; repeated rows give repeated results; all columns of docs pass, but one that has the name of an
added count is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.arrow import column, fresh, in_arrow, slices
from corvane.llm.store import Tables

#: The lowest bit of a token's hash says that it is a word, with a letter and without a digit, the next that its first
#: character is upper case.
WILD = 0x9E3779B97F4A7C14
#: Bits of a template's hash that tell its leaf.
LEAF_BITS = 20
DIGIT = re.compile(r"\d")
#: Bytes of text whose lines are hashed together: their token arrays are some 20 times as large.
PART = 500_000


@dataclass(frozen=True)
class TreeParams:
    lead: int = 2
    blocks: int = 5
    min_tokens: int = 6
    min_general: int = 12
    min_docs: int = 3
    few_docs: int = 5
    least_docs: int = 10
    long_tokens: int = 12
    long_docs: int = 2
    max_broadcast: int = 4_000_000

    def needs(self) -> list[tuple[int, int]]:
        """(tokens from which on, distinct texts to recur), four at most, for the two lowest bits of a template."""
        return [(1, self.least_docs), (3, self.few_docs), (self.min_tokens, self.min_docs), (self.long_tokens, self.long_docs)]


class Tokens(dict):
    """Hashes of tokens, WILD for those with a digit; emptied when it reaches about `most` bytes."""

    def __init__(self, most: int = 64_000_000):
        super().__init__()
        self.most = self.left = most

    def __missing__(self, raw: str) -> int:
        self.left -= 190 + len(raw)
        if self.left < 0:
            self.clear()
            self.left = self.most
        if raw.isalpha():
            value = xxhash.xxh3_64_intdigest(raw) & -4 | (3 if raw[0].isupper() else 1)
        elif DIGIT.search(raw):
            value = WILD
        else:
            value = xxhash.xxh3_64_intdigest(raw) & -4 | any(map(str.isalpha, raw)) | raw[0].isupper() << 1
        self[raw] = value
        return value


class Templates:
    """The templates of lines, as signed 64-bit hashes; all lines of a part of a batch are hashed together."""

    def __init__(self, p: TreeParams):
        self.p = p
        self.ids = Tokens()
        self.pairs = np.triu_indices(p.blocks, 1)
        rng = np.random.default_rng(5)
        self.odd = rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _leaves(self, tokens: list[list[str]], n: np.ndarray) -> np.ndarray:
        """The leaf of each line: a hash of its token count and its leading tokens."""
        leaf = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.p.lead):
            some = np.flatnonzero(n > k)
            leaf = (leaf ^ (leaf >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
            leaf[some] += np.fromiter((self.ids[tokens[j][k]] for j in some), np.uint64, len(some)) * np.uint64(0x165667B19E3779F9)
        return (leaf ^ (leaf >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def leaves(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(leaves as signed numbers, index of the line that each belongs to)."""
        tokens = [line.split() for line in lines]
        n = np.array([len(t) for t in tokens], np.int64)
        at = np.flatnonzero(n)
        return self._leaves([tokens[k] for k in at], n[at]).view(np.int64), at

    def __call__(self, lines: list[str], live: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(templates, index of the line that each belongs to); with `live` only of lines of whose leaf it says True."""
        p = self.p
        tokens = [line.split() for line in lines]
        n = np.array([len(t) for t in tokens], np.int64)
        at = np.flatnonzero(n)
        leaf = self._leaves([tokens[k] for k in at], n[at])
        if live is not None:
            some = live(leaf)
            at, leaf = at[some], leaf[some]
        if not len(at):
            return np.zeros(0, np.int64), at
        n = n[at]
        start, total = np.cumsum(n) - n, int(n.sum())
        x = np.zeros(total + 1, np.uint64)  # one more, for cuts at the end
        x[:-1] = np.fromiter(map(self.ids.__getitem__, chain.from_iterable([tokens[k] for k in at])), np.uint64, total)
        word, field, wild = (x & np.uint64(1)).astype(np.int64), (x & np.uint64(2)) > 0, x == np.uint64(WILD)
        while n.max() > len(self.odd):
            self.odd = np.concatenate([self.odd, self.odd * np.uint64(0xD6E8FEB86659FD93)])
        place = np.arange(total) - np.repeat(start, n)
        x[:-1] = (x[:-1] ^ (x[:-1] >> np.uint64(31))) * self.odd[place]
        x[:-1] ^= x[:-1] >> np.uint64(29)
        whole, words = np.add.reduceat(x[:-1], start), np.add.reduceat(word[:-1], start)
        few = n < p.min_tokens
        use = ~few | (words > 0)
        for k in np.flatnonzero(few & (np.add.reduceat(wild[:-1].astype(np.int64), start) > 0) & ((words < 2) | (2 * words < n))):
            own = tokens[at[k]]
            whole[k] = xxhash.xxh3_64_intdigest("\n".join(own))
            use[k] = any(map(str.isalpha, chain.from_iterable(own)))
        g = np.flatnonzero(~few)
        if not len(g):
            return self._finish(whole[use], n[use], np.zeros(int(use.sum()), np.int64), leaf[use]), at[use]
        field = (field | wild)[:-1] & (place >= p.lead)
        n_field = np.add.reduceat(field.astype(np.int64), start)[g]
        cuts = start[g][:, None] + p.lead + np.arange(p.blocks + 1) * (n[g] - p.lead)[:, None] // p.blocks
        empty = cuts[:, 1:] == cuts[:, :-1]
        run = np.where(empty, np.uint64(0), np.add.reduceat(x, cuts.ravel()).reshape(cuts.shape)[:, :-1])
        left = words[g][:, None] - np.where(empty, 0, np.add.reduceat(word, cuts.ravel()).reshape(cuts.shape)[:, :-1])
        i, j = self.pairs
        pair = 2 * (left[:, i] + left[:, j] - words[g][:, None]) >= n[g][:, None]
        covered = np.stack([pair[:, (i == k) | (j == k)].any(axis=1) for k in range(p.blocks)], axis=1)
        one = ~covered & ~empty & ((n[g] >= p.min_general)[:, None] | (2 * left >= n[g][:, None]))
        none = ~(pair.any(axis=1) | one.any(axis=1))
        # a field's word is a word that does not stay
        stays = words[g] - np.add.reduceat(field * word[:-1], start)[g]
        named = (n_field >= 3) & (2 * stays >= n[g])
        h = np.column_stack([whole[g], whole[g][:, None] - run, whole[g][:, None] - run[:, i] - run[:, j], whole[g] - np.add.reduceat(x[:-1] * field, start)[g]])
        row, kind = np.nonzero(np.column_stack([none, one, pair, named]))
        short = np.flatnonzero(few & use)
        owner = np.concatenate([short, g[row]])
        return self._finish(np.concatenate([whole[short], h[row, kind]]), n[owner], np.concatenate([np.zeros(len(short), np.int64), kind]), leaf[owner]), at[owner]

    def _finish(self, h: np.ndarray, n: np.ndarray, kind: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The leaf in the highest bits, what the template needs in the two lowest."""
        h = h ^ (n.astype(np.uint64) + kind.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) & np.uint64((1 << 64 - LEAF_BITS) - 4)
        need = np.searchsorted([k for k, _ in self.p.needs()], n, "right") - 1
        return (h | leaf & ~np.uint64((1 << 64 - LEAF_BITS) - 1) | need.astype(np.uint64)).view(np.int64)


def marked(sigs: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Says True of leaves that have one of the templates, and of few others, by the leaf's highest bits."""
    shift = np.uint64(64 - LEAF_BITS)
    live = np.zeros(1 << LEAF_BITS, bool)
    live[sigs.view(np.uint64) >> shift] = True
    return lambda leaf: live[leaf >> shift]


def among(leaves: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Says True of the leaves in a sorted array."""

    def live(leaf: np.ndarray) -> np.ndarray:
        own = leaf.view(np.int64)
        if not len(leaves):
            return np.zeros(len(own), bool)
        return leaves[np.minimum(np.searchsorted(leaves, own), len(leaves) - 1)] == own

    return live


def _hash(name: str) -> Column:
    """What stands for an id or a text where only equality matters; null for null."""
    return F.when(column(name).isNotNull(), F.xxhash64(column(name)))


def _crowded(rows: DataFrame, p: TreeParams) -> DataFrame:
    """The leaves (leaf) that lines of two distinct texts or more have. rows: text and its hash t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Templates(p)
        for batch in batches:
            for b, texts in slices(batch, "text"):
                lines = [t.split("\n") if t else [] for t in texts]
                leaf, line = tree.leaves(list(chain.from_iterable(lines)))
                if len(leaf):
                    own = b.column("t").to_numpy()[np.repeat(np.arange(len(texts)), [len(x) for x in lines])[line]]
                    order = np.argsort(leaf, kind="stable")
                    leaf, own = leaf[order], own[order]
                    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
                    made = (leaf[first], np.minimum.reduceat(own, first), np.maximum.reduceat(own, first))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["leaf", "lo", "hi"])

    each = in_arrow(rows, run, "leaf bigint, lo bigint, hi bigint")
    return each.groupBy("leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("leaf")


def _templates_of(rows: DataFrame, p: TreeParams, live: Callable | None = None) -> DataFrame:
    """(sig, and the other columns of rows) once for each distinct template of a row's text; live() gives on the worker
    what says which leaves matter."""
    rest = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, some = Templates(p), live and live()
        for batch in batches:
            for b, texts in slices(batch, "text", PART):
                lines = [t.split("\n") if t else [] for t in texts]
                sig, line = tree(list(chain.from_iterable(lines)), some)
                if len(sig):
                    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lines])[line]
                    order = np.lexsort((sig, owner))
                    sig, owner = sig[order], owner[order]
                    new = np.r_[True, (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])]
                    at = pa.array(owner[new])
                    yield pa.RecordBatch.from_arrays([pa.array(sig[new]), *(b.column(f.name).take(at) for f in rest)], names=["sig", *(f.name for f in rest)])

    return in_arrow(rows, run, StructType([StructField("sig", LongType()), *rest]))


def recurring(docs: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """(sig, n_docs, first_id) of the templates in as many distinct texts as they need."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"), "doc_id")
    leaves = Tables(docs.sparkSession, "leaves").write(_crowded(rows.select("text", "t"), p), "crowded")
    live = None
    if leaves.count() <= p.max_broadcast:  # otherwise all leaves are parsed, with the same result
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(leaves.toArrow().column("leaf").to_numpy()))
        live = lambda: among(shared.value)
    each = _templates_of(rows, p, live)
    once = each.groupBy("sig", "t").agg(F.min("doc_id").alias("doc_id"))
    need = F.array(*[F.lit(k) for _, k in p.needs()])[F.col("sig").bitwiseAND(3)]
    return once.groupBy("sig").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id")).where(F.col("n_docs") >= need)


def _dropping(rows: DataFrame, out: StructType, p: TreeParams, lookup: Callable, own: str, sigs: str | None) -> DataFrame:
    """Decides line by line. lookup() gives the sorted templates and the hashes of their first ids, which are compared
    with the row's, in the column `own`; with a column `sigs` a row brings its own templates along instead."""
    lines_at, gone_at = out.names[-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, schema = Templates(p), to_arrow_schema(out)
        known, holder = lookup()
        live = None if sigs else marked(known)
        for batch in batches:
            for b, texts in slices(batch, "text", PART):
                lines = [t.split("\n") if t else [] for t in texts]
                count = [len(x) for x in lines]
                sig, line = tree(list(chain.from_iterable(lines)), live)
                drop: set[int] = set()
                if len(sig):
                    owner = np.repeat(np.arange(len(texts)), count)[line]
                    if sigs:
                        order = np.argsort(owner, kind="stable")
                        ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
                        for k, part in enumerate(b.column(sigs)):
                            if part.is_valid:
                                mine = order[ends[k] : ends[k + 1]]
                                drop.update(line[mine[np.isin(sig[mine], part.values.to_numpy(zero_copy_only=False))]].tolist())
                    elif len(known):
                        at = np.minimum(np.searchsorted(known, sig), len(known) - 1)
                        ids = b.column(own)
                        valid, me = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                        hit = (known[at] == sig) & valid[owner] & (me[owner] != holder[at])
                        drop.update(line[hit].tolist())
                kept, gone, here = [], [], 0
                for t, ls in zip(texts, lines, strict=True):
                    some = [x for k, x in enumerate(ls, here) if k not in drop] if drop else ls
                    here += len(ls)
                    gone.append(len(ls) - len(some))
                    kept.append(t if len(some) == len(ls) else "\n".join(some))
                made = {"text": kept, lines_at: count, gone_at: gone}
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return in_arrow(rows, run, out)


def drop_recurring(docs: DataFrame, p: TreeParams = TreeParams(), lines: str = "n_lines", gone: str = "n_dropped") -> DataFrame:
    """All rows and columns of docs, the text without recurring lines, plus the counts `lines` and `gone`.

    A text crosses to Python and back once. Templates of the row itself come along only beyond `max_broadcast`.
    """
    tables = Tables(docs.sparkSession, "line-dedup")
    found = tables.write(recurring(docs, p).select("sig", "first_id").where("first_id IS NOT NULL"), "recurring")
    counts = (lines.lower(), gone.lower())
    docs = docs.select(*[column(n).cast("string").alias(n) if n == "text" else column(n) for n in docs.columns if n.lower() not in counts])
    out = StructType([*docs.schema.fields, StructField(lines, LongType()), StructField(gone, LongType())])
    own = fresh(docs, "own")
    rows = docs.withColumn(own, _hash("doc_id"))
    if found.count() <= p.max_broadcast:
        got = found.select("sig", F.xxhash64("first_id").alias("h")).toArrow()
        sig = got.column("sig").to_numpy()
        order = np.argsort(sig)
        shared = docs.sparkSession.sparkContext.broadcast((sig[order], got.column("h").to_numpy()[order]))
        return _dropping(rows, out, p, lambda: shared.value, own, None)
    # each row meets the templates that it has itself: (row, sig) pairs, joined and gathered by row
    key = F.struct(F.col(own).alias("i"), F.xxhash64("text").alias("t"))
    each = _templates_of(rows.where(F.col(own).isNotNull()).select("text", key.alias("key")), p)
    bad = each.join(found, "sig").where(F.col("key.i") != F.xxhash64("first_id")).groupBy("key").agg(F.collect_set("sig").alias("sigs"))
    sigs, k = fresh(docs, "sigs"), fresh(docs, "key")
    both = rows.withColumn(k, key).join(bad.select(F.col("key").alias(f"{k}_"), F.col("sigs").alias(sigs)), F.col(k) == F.col(f"{k}_"), "left")
    none = np.zeros(0, np.int64)
    return _dropping(both.select(*[column(n) for n in docs.columns], own, sigs), out, p, lambda: (none, none), own, sigs)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", "text")
