"""N-gram Jaccard join: a blocked sparse product of the document x n-gram incidence matrix with its transpose.

The product is never formed in full. Size-derived bounds cut it down before and while overlaps are accumulated:

1. Rows. Documents with equal n-gram sets are one row (a class). A class of n n-grams can only be linked if at
   least need(n) = ceil(t n) of its n-grams occur in another class. Column blocks (ranges of the n-gram hash) count
   such live n-grams; mappers combine first, so that an n-gram in any number of rows reaches its block once per
   map chunk. In prose most rows end here.
2. Columns. Among the surviving rows the n-grams are ordered by document frequency, rarest first. Two linked rows
   share one of the first live(n) - need(n) + 1 live n-grams of each, so only those columns are multiplied.
3. Stars. A column is first multiplied with its pivot row only, not with itself. Pairs whose sizes and positions in
   the column bound their overlap below the threshold are discarded. The overlap of the others is accumulated block by
   block over the columns of both rows; a pair is discarded as soon as the count so
   far and the smaller of the rows' remaining cells cannot reach the bound any more, and the count itself decides the
   pairs that stay. Links give components. `stars` rounds of this, with other pivots each, and only over columns whose
   rows are not yet in one component.
4. Rest. In the columns that remain open every pair of different components is decided in the same way: rows outside
   the column's largest component against all of its rows, each pair in the first column that it shares.

So a group of k near copies costs about k exact checks, not k squared, and no link between different components is
lost. Components are found by alternating large and small stars over written tables; nothing of a size that grows
with the documents is collected.

Defined results: null text and text without words have an empty set, no links and their own id as component; equal
sets are one class whatever the words' case; repeated rows give one result row each; a component of which some ids are
null has the smallest of the others as its id; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import in_arrow, slices
from corvane.llm.store import Tables, join_checked

A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class JaccardParams:
    """Similarity of at least num / den over n-grams of `width` words."""

    width: int = 5
    num: int = 4
    den: int = 5
    chunk: int = 800_000
    block: int = 700_000
    stars: int = 6
    parts: int = 8

    def need(self, n: str) -> str:
        """SQL for the overlap that a row of n needs with any partner."""
        return f"CAST(({self.num} * {n} + {self.den - 1}) DIV {self.den} AS INT)"

    def linked(self, both: str, n: str, m: str) -> str:
        return f"{self.num + self.den} * CAST({both} AS BIGINT) >= {self.num} * CAST({n} + {m} AS BIGINT)"


class Words(dict):
    """Hashes of words; at most 400,000 words of up to 64 bytes are remembered, some 100 MB."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = value
        return value


class GramSets:
    """Sorted distinct 64-bit hashes of a text's n-grams of words; a shorter text is one n-gram."""

    def __init__(self, width: int):
        self.width, self.ids = width, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.uint64, len(words))
        n, w = max(1, len(ids) - self.width + 1), min(self.width, len(ids))
        if not w:
            return ids
        h = np.full(n, w, np.uint64) * A
        for k in range(w):
            h = (h ^ (h >> np.uint64(31))) * B + ids[k : k + n] * C
        h = (h ^ (h >> np.uint64(32))) * D
        return np.unique(h ^ (h >> np.uint64(29)))


def _profile(rows: DataFrame, p: JaccardParams, with_grams: bool) -> DataFrame:
    """doc_id, n, cls (hash of the set) and, if asked for, its n-grams in blocks of columns."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n int, cls bigint" + (", blocks array<array<bigint>>" if with_grams else "")

    borders = np.array([(1 << 64) // p.parts * k for k in range(1, p.parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = GramSets(p.width)
        for batch in batches:
            for b, texts in slices(batch, "text"):
                made = [sets(t) for t in texts]
                cols = {"doc_id": b.column("doc_id"), "n": pa.array([len(s) for s in made], pa.int32()), "cls": pa.array([_digest(s) for s in made], pa.int64())}
                if with_grams:
                    cuts = [np.diff(np.r_[0, np.searchsorted(s, borders), len(s)]) for s in made]
                    flat = pa.array(np.concatenate(made).view(np.int64))
                    blocks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(cuts))].astype(np.int32)), flat)
                    cols["blocks"] = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * p.parts), blocks)
                yield pa.RecordBatch.from_pydict(cols)

    return in_arrow(rows, run, schema)


def _digest(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def live_counts(rows: DataFrame, p: JaccardParams, total: int) -> DataFrame:
    """cls, live: at least as many as the n-grams of the class that another class has too."""
    blocks = max(512, (total // p.block + 1) * 4)
    deals = max(32, total // 20_000_000)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, held, size = GramSets(p.width), set(), [], 0
        for t in (t for batch in batches for _, texts in slices(batch, "text") for t in texts):
            grams = sets(t)
            if len(grams) and (key := _digest(grams)) not in seen:
                seen.add(key)
                held.append((key, grams))
                size += len(grams)
            if size >= p.chunk:
                yield _blocks(held, blocks)
                held, size = [], 0
            if len(seen) > 2_000_000:
                seen.clear()  # a class that comes again is counted again: the count is an upper bound
        if held:
            yield _blocks(held, blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, done, held = None, [], [], 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for block, gram, cls, times, mark in zip(*(part.column(c).to_pylist() for c in ("block", "gram", "cls", "times", "mark")), strict=True):
                    if gram is None:  # counted by the chunk for its own classes
                        done.append((np.frombuffer(cls, np.int64), np.frombuffer(times, np.uint32)))
                        held += len(done[-1][0])
                        continue
                    if block != here and parts:
                        done.append(_count_block(parts))
                        parts, held = [], held + len(done[-1][0])
                        if held > 2_000_000:
                            yield _dealt(*_summed(done), deals)
                            done, held = [], 0
                    here = block
                    parts.append((gram, cls, times, mark))
        if parts:
            done.append(_count_block(parts))
        if done:
            yield _dealt(*_summed(done), deals)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, held = None, [], 0
        for b in batches:
            for deal, cls, times in zip(*(b.column(c).to_pylist() for c in ("deal", "cls", "times")), strict=True):
                if deal != here and parts:
                    yield _live(*_summed(parts))
                    parts, held = [], 0
                here = deal
                parts.append((np.frombuffer(cls, np.int64), np.frombuffer(times, np.uint32)))
                held += len(parts[-1][0])
                if held > 2_000_000:
                    parts = [_summed(parts)]
                    held = 0
        if parts:
            yield _live(*_summed(parts))

    sent = in_arrow(rows, split, "block int, gram binary, cls binary, times binary, mark binary")
    # sorted, so that a task holds one block at a time, of about `block` n-grams whatever the input
    each = in_arrow(sent.repartition(max(2, blocks // 4), "block").sortWithinPartitions("block"), count, "deal int, cls binary, times binary")
    # a task's counts travel as one row for each deal of classes, not as one for each class; a class is in one deal
    return in_arrow(each.repartition(deals, "deal").sortWithinPartitions("deal"), gather, "cls bigint, live int")


def _summed(done: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, where = np.unique(np.concatenate([d[0] for d in done]), return_inverse=True)
    return names, np.bincount(where, np.concatenate([d[1] for d in done]), minlength=len(names)).astype(np.uint32)


def _dealt(cls: np.ndarray, times: np.ndarray, deals: int) -> pa.RecordBatch:
    at = (cls.view(np.uint64) >> np.uint64(16)) % np.uint64(deals)
    order = np.argsort(at)
    cuts = np.searchsorted(at[order], np.arange(deals + 1, dtype=np.uint64))
    some = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(deals) if cuts[k] < cuts[k + 1]]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), *(pa.array([x[o].tobytes() for _, o in some], pa.binary()) for x in (cls, times))], names=["deal", "cls", "times"])


def _live(cls: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(times.astype(np.int32))], names=["cls", "live"])


def _pack(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash; the block stands for high bits. Equal hashes stay equal, which is all a bound needs."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _blocks(held: list[tuple[int, np.ndarray]], blocks: int) -> pa.RecordBatch:
    classes = np.array([k for k, _ in held], np.int64)
    h = np.concatenate([g for _, g in held])
    who = np.repeat(np.arange(len(held)), [len(g) for _, g in held])
    order = np.argsort(h)
    h, who = h[order], who[order]
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    both = twin.copy()
    both[:-1] |= twin[1:]
    own = np.bincount(who[both], minlength=len(held)).astype(np.uint32)
    marks = h[both & ~twin]
    rest_h, rest_who = h[~both], who[~both]
    place = lambda x: ((x >> np.uint64(48)) % np.uint64(blocks)).astype(np.int64)
    at, mark_at = place(rest_h), place(marks)
    order = np.argsort(at * len(held) + rest_who)
    at, rest_h, rest_who = at[order], rest_h[order], rest_who[order]
    order = np.argsort(mark_at, kind="stable")
    mark_at, marks = mark_at[order], marks[order]
    some = own > 0
    out: list[tuple] = [(int(classes[0] % blocks), None, classes[some].tobytes(), own[some].tobytes(), None)]
    cut, mcut = np.searchsorted(at, np.arange(blocks + 1)), np.searchsorted(mark_at, np.arange(blocks + 1))
    for k in range(blocks):
        a, z = cut[k], cut[k + 1]
        if a == z and mcut[k] == mcut[k + 1]:
            continue
        w = rest_who[a:z]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(w)]).astype(np.uint32)
        out.append((k, _pack(rest_h[a:z]), classes[w[first]].tobytes(), times.tobytes(), _pack(marks[mcut[k] : mcut[k + 1]])))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "gram", "cls", "times", "mark"])


def _count_block(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of one block and how many of their n-grams are live."""
    h = _unpack([x[0] for x in parts])
    cls = np.repeat(np.frombuffer(b"".join(x[1] for x in parts), np.int64), np.frombuffer(b"".join(x[2] for x in parts), np.uint32))
    marks = np.unique(_unpack([x[3] for x in parts]))
    order = np.argsort(h)
    h, cls = h[order], cls[order]
    if len(h):
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        last = np.r_[first[1:], len(h)] - 1
        live = np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)
        if len(marks):
            near = np.minimum(np.searchsorted(marks, h[first]), len(marks) - 1)
            live |= marks[near] == h[first]
        cls = cls[np.repeat(live, last - first + 1)]
    return np.unique(cls, return_counts=True)


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(u, v) for every node u of `edges` (a, b) but the smallest v of its component: large and small stars in turn."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = tables.write(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), name)
    sign = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    last = sign(e)
    while last[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = tables.write(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = sign(e)
        if now == last:
            break
        last = now
    return e


def _columns(grams: DataFrame, p: JaccardParams) -> DataFrame:
    """(cls, n, live, pos, h): the rarest-first prefix of every row that can still be linked."""
    post = grams.select("cls", "n", F.explode(F.flatten("blocks")).alias("h"))
    shared = post.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    row = post.join(shared, "h").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    row = row.withColumn("live", F.size("order")).withColumn("need", F.expr(p.need("n"))).where("live >= need")
    return row.select("cls", "n", "live", F.posexplode(F.expr("slice(order, 1, live - need + 1)")).alias("pos", "x")).select("cls", "n", "live", "pos", F.col("x.h").alias("h"))


def _open(cols: DataFrame, home: DataFrame, tables: Tables) -> DataFrame:
    """The entries of columns with rows of more than one component, with root, degree and the column's largest
    component `big`."""
    placed = cols.join(home, "cls")
    counts = placed.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("big"), F.count("*").alias("roots"))
    return tables.write(placed.join(counts.where("roots > 1").select("h", "big"), "h"), "open")


def _star(entries: DataFrame, k: int, p: JaccardParams) -> DataFrame:
    """(a, b): the rows of every column with its pivot, if they are of different components and may be linked.

    In the first round the pivot has the smallest hash, so that the columns of a group agree on few pivots. In the
    second it has most links so far: the centre of a group whose members differ from each other more than from it.
    Later it is any row of the column's largest component, another one in each column, so that a row outside meets
    many members.
    """
    order = (F.xxhash64("cls"), F.struct(-F.col("degree"), F.xxhash64("cls")), F.struct(F.col("root") != F.col("big"), F.xxhash64("cls", "h", F.lit(k))))[min(k, 2)]
    pivot = entries.groupBy("h").agg(F.min_by(F.struct("cls", "n", "live", "pos", "root"), order).alias("x"))
    x = [F.col(f"x.{a}").alias(b) for a, b in (("cls", "dls"), ("n", "m"), ("live", "mive"), ("pos", "qos"), ("root", "soot"))]
    star = entries.join(pivot, "h").select("cls", "n", "live", "pos", "root", *x).where("root <> soot")
    return _possible(star, p).groupBy(F.least("cls", "dls").alias("a"), F.greatest("cls", "dls").alias("b")).agg(F.count("*").alias("shared")).select("a", "b")


def _rest(entries: DataFrame, p: JaccardParams) -> DataFrame:
    """(a, b), each once: the pairs of different components that share a column and may be linked.

    One of the two rows lies outside the column's largest component. A pair is made in the first column that it
    shares, the one before which the rows' own columns have nothing in common; a row's list of columns is as long as
    its text allows, whatever the size of a group.
    """
    rows = entries.groupBy("cls", "n", "live", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "big"))).alias("own"))
    each = rows.select("cls", "n", "live", "root", F.col("own.h").alias("all"), F.posexplode("own").alias("k", "x"))
    left = each.select("cls", "n", "live", "root", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"), F.col("x.big").alias("big"), F.expr("slice(all, 1, k)").alias("before"))
    right = left.select("h", F.col("cls").alias("dls"), F.col("n").alias("m"), F.col("live").alias("mive"), F.col("pos").alias("qos"), F.col("root").alias("soot"), F.col("before").alias("past"))
    size, most = _bounds(p)
    fits = f"root <> soot AND (soot = big OR cls < dls) AND {size} AND {most} AND NOT arrays_overlap(before, past)"
    pairs = left.where("root <> big").alias("l").join(right.alias("r"), (F.col("l.h") == F.col("r.h")) & F.expr(fits))
    return pairs.select(F.least("cls", "dls").alias("a"), F.greatest("cls", "dls").alias("b"))


def _bounds(p: JaccardParams) -> tuple[str, str]:
    """SQL: sizes n and m allow a link; so do the positions of a column that both rows have."""
    most = "(least(pos, qos) + least(live - pos, mive - qos))"
    return p.linked("least(n, m)", "n", "m"), p.linked(most, "n", "m")


def _possible(pairs: DataFrame, p: JaccardParams) -> DataFrame:
    size, most = _bounds(p)
    return pairs.where(size).where(most)


def _settle(home: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """`home` after links (a, b): components of components, and each class's number of links."""
    of = lambda c: home.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    joined = components(between, tables, "stars").select(F.col("u").alias("root"), "v")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("more"))
    new = home.join(joined, "root", "left").join(degree, "cls", "left")
    return tables.write(new.select("cls", F.coalesce("v", "root").alias("root"), (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree")), "home")


def _links(pairs: DataFrame, grams: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) that are linked, by overlap counts accumulated over blocks of columns.

    The state of a pair is its count, or -1 once the bound is out of reach, and the cells of each row still to come.
    """
    left = grams.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("blocks").alias("g"))
    right = grams.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("blocks").alias("k"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    reach = p.linked("(s.hit + i + least(s.r - size(x.g), s.q - size(x.k)))", "n", "m")
    grown = f"transform(array(size(array_intersect(x.g, x.k))), i -> named_struct('hit', IF({reach}, s.hit + i, -1), 'r', s.r - size(x.g), 'q', s.q - size(x.k)))[0]"
    hit = f"aggregate(arrays_zip(g, k), named_struct('hit', 0, 'r', n, 'q', m), (s, x) -> IF(s.hit < 0, s, {grown}), s -> s.hit)"
    return both.withColumn("hit", F.expr(hit)).where(f"hit > 0 AND {p.linked('hit', 'n', 'm')}").select("a", "b")


def jaccard_components(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    tables = Tables(docs.sparkSession, "ngram-join")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    seen = tables.write(_profile(rows, p, False), "rows")
    classes = seen.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("first_id"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    alive = classes.join(live_counts(rows, p, total), "cls").where(f"least(live, n) >= {p.need('n')}")
    alive = tables.write(alive.select("cls", "n", F.col("first_id").alias("id")), "alive")
    ids = alive.select("id").distinct()
    texts = join_checked(rows, ids, rows["doc_id"].eqNullSafe(ids["id"]), "left_semi", alive.count())
    grams = tables.write(_profile(texts, p, True).dropDuplicates(["cls"]).select("cls", "n", "blocks"), "grams")
    cols = tables.write(_columns(grams, p), "cols")

    home = tables.write(alive.select("cls", F.col("cls").alias("root"), F.lit(0).cast("bigint").alias("degree")), "home")
    for k in range(p.stars):
        links = tables.write(_links(_star(_open(cols, home, tables), k, p), grams, p), f"links-{k}")
        if k > 1 and not links.limit(1).count():
            break
        home = _settle(home, links, tables)
    # what remains: pairs of different components within a column
    home = _settle(home, _links(_rest(_open(cols, home, tables), p), grams, p), tables)

    final = classes.join(home.select("cls", "root"), "cls", "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root"))
    first = final.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = tables.write(final.join(first, "root").select("cls", "component_id"), "named")
    tables.drop("alive", "grams", "cols", "open", "home", "stars", "rest", *(f"links-{k}" for k in range(p.stars)))
    out = seen.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """The documents, all columns, whose id is the smallest of their component; ids that are null stay."""
    others = jaccard_components(docs, p).where("doc_id <> component_id").select(F.col("doc_id").alias("other_id")).distinct()
    return join_checked(docs, others, docs["doc_id"] == others["other_id"], "left_anti", others.count())


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
