"""Sharding by size-tiered compaction, with versioned manifests that are committed atomically.

append() writes the rows of an arrival as small immutable shards, one for each task, and commits a manifest that has
them. compact() takes every tier (shards of similar size: the same power of `fanout`) that holds at least `fanout`
shards below the target size and merges it into about target-sized shards in one narrow job without a shuffle;
the merged shards replace the small ones in the next manifest. A manifest is written beside its place and renamed to
manifests/<version>.json, which fails if another writer was first; then the change is applied to that newer
manifest and tried again. Readers take one version and see all of its rows or none. vacuum() removes old manifests and every
data file that no kept version names: those of replaced shards at once, those that no manifest ever named (of failed or
repeated tasks, lost conflicts) and drafts of manifests once they are older than `orphan_hours`, since a younger one may
belong to a writer at work. The driver holds file names, sizes and row counts only, never rows.

A shard's size is its file's, so no key decides where rows go: a hot source or group of copies cannot make a shard
grow. Everything lives under one root, a path of any Hadoop file system, and failed or repeated tasks leave no rows
behind, because only listed files count.

Defined results: an empty arrival adds a version without shards; null values and repeated rows are stored as they
are; all columns are kept, whatever their names, but the one that read() adds replaces a column of its name; arrivals
whose columns differ are read together by name, missing values as null; of shards of equal size the first by path is
merged first. A merge gives about target-sized shards: it joins whole partitions, so a shard may be smaller or larger
than the target by the size of one input file.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrow import column
from corvane.llm.store import file_system, remove, shared_table_root


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Tiering:
    target_bytes: int = 128 << 20
    fanout: int = 4


def tier(size: int, t: Tiering) -> int:
    return int(math.log(max(size, 1), t.fanout) + 1e-9)


def plan(shards: list[Shard], t: Tiering) -> list[tuple[list[Shard], int]]:
    """(shards to merge, number of merged shards) for every tier that is full, small tiers first."""
    tiers = defaultdict(list)
    for s in shards:
        if s.bytes < t.target_bytes * 3 // 4:
            tiers[tier(s.bytes, t)].append(s)
    full = [sorted(group, key=lambda s: (s.bytes, s.path)) for _, group in sorted(tiers.items()) if len(group) >= t.fanout]
    merges = [(g, max(1, round(sum(s.bytes for s in g) / t.target_bytes))) for g in full]
    return [(g, n) for g, n in merges if n < len(g)]


class Conflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _jvm(self):
        return self.spark.sparkContext._jvm

    def versions(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards); without a version the newest, (0, []) before the first commit."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, []
        fs, p = file_system(self.spark, f"{self.root}/manifests/{version:09d}.json")
        stream = fs.open(p)
        try:
            text = self._jvm().org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def _publish(self, version: int, shards: list[Shard]) -> None:
        body = json.dumps({"version": version, "shards": [asdict(s) for s in shards]})
        draft = f"{self.root}/manifests/.{version:09d}-{uuid.uuid4().hex}"
        fs, p = file_system(self.spark, draft)
        stream = fs.create(p, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        jvm, to = self._jvm(), f"{self.root}/manifests/{version:09d}.json"
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(p, jvm.org.apache.hadoop.fs.Path(to), none)
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(to) from e
            raise

    def commit(self, add: list[Shard], drop: list[Shard] = ()) -> int:
        """The next version: the newest manifest without `drop` and with `add`. Fails if some of `drop` is gone."""
        gone = {s.path for s in drop}
        while True:
            version, now = self.manifest()
            if len(gone & {s.path for s in now}) != len(gone):
                raise Conflict("a shard to be replaced is no longer in the manifest")
            try:
                self._publish(version + 1, [s for s in now if s.path not in gone] + list(add))
                return version + 1
            except Conflict:
                continue

    def _write(self, df: DataFrame, name: str) -> list[Shard]:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        fs, p = file_system(self.spark, path)
        sizes = {f.getPath().getName(): f.getLen() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        rows = self.spark.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        counts = {r["name"]: r["n"] for r in rows.collect()}
        return [Shard(f"{path}/{n}", counts[n], size) for n, size in sorted(sizes.items()) if counts.get(n)]

    def append(self, df: DataFrame) -> int:
        return self.commit(self._write(df, "new"))

    def compact(self, t: Tiering = Tiering()) -> int:
        """Merges full tiers until none is left; the version after that."""
        while todo := plan(self.manifest()[1], t):
            for group, n in todo:
                merged = self._write(self.spark.read.option("mergeSchema", "true").parquet(*[s.path for s in group]).coalesce(n), "merged")
                if sum(s.rows for s in merged) != sum(s.rows for s in group):
                    raise ValueError("a merge has lost or repeated rows; nothing was committed")
                self.commit(merged, group)
        return self.manifest()[0]

    def vacuum(self, keep_versions: int = 1, orphan_hours: float = 24.0) -> int:
        """Removes manifests but the last `keep_versions` and the data files that none of them names; how many."""
        versions = self.versions()
        kept, old = versions[-keep_versions:], versions[:-keep_versions]
        live = {s.path for v in kept for s in self.manifest(v)[1]}
        dead = {s.path for v in old for s in self.manifest(v)[1]} - live
        before = time.time() - orphan_hours * 3600
        named = {self._below(p) for p in live | dead}
        orphans = [p for p, at in self._files("data") if at <= before and self._below(p) not in named]
        drafts = [p for p, at in self._files("manifests") if at <= before and p.rsplit("/", 1)[1].startswith(".")]
        for path in [*dead, *orphans, *drafts, *(f"{self.root}/manifests/{v:09d}.json" for v in old)]:
            remove(self.spark, path)
        return len(dead) + len(orphans)

    def _below(self, path: str) -> str:
        return path.rsplit("/data/", 1)[-1]

    def _files(self, folder: str) -> list[tuple[str, float]]:
        """(path, time of change in seconds) of all files under a folder."""
        fs, p = file_system(self.spark, f"{self.root}/{folder}")
        out, more = [], fs.listFiles(p, True) if fs.exists(p) else None
        while more is not None and more.hasNext():
            f = more.next()
            out.append((f.getPath().toString(), f.getModificationTime() / 1000))
        return out

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """The rows of a version, with the column `shard`: its path under the root."""
        version, shards = self.manifest(version)
        if not shards:
            raise ValueError("the version has no rows")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[s.path for s in shards])
        kept = [column(n) for n in rows.columns if n.lower() != shard.lower()]
        return rows.select(*kept, F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)$", 1).alias(shard))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Four arrivals of documents, each compacted; every document with the shard and version that hold it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, shared_table_root(spark, "shards"))
    for k in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k))
        store.compact()
        store.vacuum()
    version = store.manifest()[0]
    return store.read(version).select("doc_id", "n_chars", "shard", F.lit(version).alias("version"))
