"""Arrow-side plumbing shared by the operators that run Python on batches of texts.

A batch is cut into slices by the bytes of its texts before any Python string is made of it, each text crosses the
border once in each direction, and what a worker remembers is bounded by bytes; so a worker's memory follows neither
the batch nor the number of distinct words.

Added columns replace columns of the same name (whatever its case), as DataFrame.withColumn does; all other columns
pass unchanged, whatever their names.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that are Python strings at once, and of an Arrow batch between the JVM and a worker.
SLICE, BATCH = 2_000_000, 4 << 20


class Memo(dict):
    """dict.__missing__ computed by `make`; emptied when keys, values and slots reach about `most` bytes."""

    def __init__(self, make: Callable, most: int = 48_000_000, each: int = 180):
        super().__init__()
        self.make, self.most, self.each, self.held = make, most, each, 0

    def __missing__(self, key):
        self.held += self.each + len(key)
        if self.held > self.most:
            self.clear()
            self.held = self.each + len(key)
        value = self[key] = self.make(key)
        return value


def column(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_arrow(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInArrow with batches of about BATCH bytes: where the session has Spark's default of 64 MB, which several
    tasks of an executor hold more than once each, inside and outside the JVM, it is lowered in the session."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key)) or 0) == 64 << 20:
        conf.set(key, str(BATCH))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return rows.mapInArrow(tidy, schema)


def trim() -> None:
    """Gives back to the system what a task has freed: idle workers stay beside the next stage's."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as make it none of the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts as strings) for runs of rows with about `most` bytes of text."""
    col = batch.column(text)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = pc.cast(col, pa.string())
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 100)
    at = 0
    while at < batch.num_rows:
        past = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, past + most, "right")))
        yield batch.slice(at, stop - at), col.slice(at, stop - at).to_pylist()
        at = stop


def map_texts(rows: DataFrame, schema: str, setup: Callable[[], Callable[[list], dict]], text: str = "text", keep: bool = False) -> DataFrame:
    """Adds columns to `rows`: setup() runs once per task and gives a function from texts (None: null) to columns, of
    which an attribute close, if there is one, is called when the task ends.

    The text column itself is returned only if `keep`. Rows keep their order and number.
    """
    added = StructType.fromDDL(schema)
    new = [f.name for f in added.fields]
    gone = {n.lower() for n in new} | (set() if keep else {text.lower()})
    kept = [f for f in rows.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    out = StructType(kept + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        work = setup()
        for batch in batches:
            for b, texts in slices(batch, text):
                made = work(texts)
                yield pa.RecordBatch.from_arrays([b.column(n).cast(arrow.field(n).type) for n in names] + [pa.array(made[n], type=arrow.field(n).type) for n in new], schema=arrow)
        getattr(work, "close", lambda: None)()

    sent = names if text in names else [*names, text]
    return in_arrow(rows.select(*[column(n) for n in sent]), run, out)


def keep_where(rows: DataFrame, setup: Callable[[], Callable[[list], list]], text: str = "text") -> DataFrame:
    """The rows, all columns, whose text the function that setup() gives says True of, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = setup()
        for batch in batches:
            for b, texts in slices(batch, text):
                yield b.filter(pa.array(good(texts), pa.bool_()))

    return in_arrow(rows, run, rows.schema)


def bounded_share(rows: DataFrame, limit: int, *by: Column, size: Column | None = None, seed: int = 17) -> DataFrame:
    """The rows whose hash of `by` lies under a threshold set so that about `limit` rows remain, or rows whose
    `size` adds up to about `limit`.

    All rows remain if there is no more. Rows of equal `by` stay or go together. The choice depends on the values
    only, never on partitions, and nothing is cut off afterwards: the limit is what is expected.
    """
    total = rows.agg(F.coalesce(F.sum(size if size is not None else F.lit(1)), F.lit(0))).first()[0]
    if total <= limit:
        return rows
    unit = 1 << 30
    return rows.where(F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(unit)) < int(limit / total * unit))


def lists(table: pa.Table, *names: str) -> list[tuple]:
    """The list columns of a collected table as NumPy views of its chunks, a tuple for each row."""
    return list(zip(*([v.values.to_numpy(zero_copy_only=False) for chunk in table.column(n).chunks for v in chunk] for n in names), strict=True))


def training_texts(docs: DataFrame, known: DataFrame, label: str, max_rows: int, max_chars: int) -> DataFrame:
    """(doc_id, label, text) of a bounded share of the labelled rows: about `max_rows` ids of `known` and about
    `max_chars` characters of their texts, chosen by hashes of the id. `known` has one row an id; it is broadcast,
    which `max_rows` bounds. A document row that is repeated is learned from once."""
    few = bounded_share(known, max_rows, F.col("doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    share = bounded_share(texts, max_chars, F.col("doc_id"), size=F.coalesce(F.length("text"), F.lit(0)) + 100, seed=18)
    return share.select("doc_id", label, "text")
