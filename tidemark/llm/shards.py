"""Sharding by size-tiered compaction under a versioned manifest.

append() writes arrivals as small immutable Parquet files, arrive() several arrivals in
one job with a commit each.  compact() merges the files of one tier of like size at a
time into files of about TARGET_BYTES: the scan itself packs the small files of a merge
into read partitions of that size, and each partition writes one file, so nothing is
shuffled.  Every change commits one new manifest, a JSON file renamed into place where
no file of that version may exist; readers see either version, never a mixture.
Replaced files stay until vacuum().

The driver holds the manifest, a line for each file (not row).  All of it goes
through Hadoop's file systems, so the store can be anywhere that Spark can write.

Defined results: rows and columns are stored as they are, nulls, repeated rows and
empty texts included; files without rows are not listed; an empty store reads as no
rows.  A store takes no column called `_metadata`, which is Spark's own; sharded() stores
it under another name and gives it back.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_path

TARGET_BYTES, TIER_FACTOR, MERGE_AT = 128 << 20, 4, 4
#: Arrivals that the rows of one table are taken as.
ARRIVALS = 4


def _name() -> Column:
    """What tells the file that a row was read from: its folder and name."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, merge_at: int = MERGE_AT):
        self.spark, self.root, self.target, self.merge_at = spark, root.rstrip("/"), target_bytes, merge_at
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._path("manifests")) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] == "v")

    def manifest(self, version: int | None = None) -> dict:
        """{version, shards: [{file, bytes, rows}], schema}; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        text = self.spark.read.text(f"{self.root}/manifests/v{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """The next version, if no one else has committed it meanwhile."""
        new = {"version": base["version"] + 1, "shards": sorted(shards, key=lambda s: s["file"]), "schema": schema}
        draft, final = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{new['version']:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)  # fails where final exists
        return new

    def _described(self, folders: list[str], schema) -> list[list[dict]]:
        """Names, bytes and rows of the files of each written folder that have rows; one job counts them all."""
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])
        rows = {r.f: r.n for r in df.groupBy(_name().alias("f")).agg(F.count("*").alias("n")).collect()}
        out = []
        for folder in folders:
            files = {f"{folder.rsplit('/', 1)[1]}/{s.getPath().getName()}": s for s in self._fs.listStatus(self._path(folder))}
            out.append([{"file": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen(), "rows": rows[k]} for k, s in files.items() if k in rows])
        return out

    def _written(self, df: DataFrame) -> list[dict]:
        """Write df as files of a new folder; their names, bytes and rows."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._described([folder], df.schema)[0]

    def arrive(self, df: DataFrame, arrivals: int = ARRIVALS) -> dict:
        """df's rows as several arrivals, dealt out by a hash, written in one job; each becomes a version of its own."""
        self._checked(df)
        deal, draft = free_name(df, "arrival"), f"drafts/{uuid.uuid4().hex}"
        key = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")], F.lit(5))
        df.withColumn(deal, F.pmod(key, F.lit(arrivals))).write.option("compression", "zstd").partitionBy(deal).parquet(f"{self.root}/{draft}")
        folders = []
        self._fs.mkdirs(self._path("data"))
        for s in sorted(self._fs.listStatus(self._path(draft)), key=lambda s: s.getPath().getName()):
            if s.isDirectory():
                folders.append(f"data/{uuid.uuid4().hex}")
                self._fs.rename(s.getPath(), self._path(folders[-1]))
        self._fs.delete(self._path(draft), True)
        m = self.manifest()
        for shards in self._described(folders, df.schema) if folders else []:
            m = self._commit(m, m["shards"] + shards, df.schema.json())
        return m

    @staticmethod
    def _checked(df: DataFrame) -> None:
        if "_metadata" in (c.lower() for c in df.columns):
            raise ValueError("the column name _metadata is not allowed")

    def append(self, df: DataFrame) -> dict:
        """One new shard for each partition of df that has rows."""
        self._checked(df)
        base = self.manifest()
        return self._commit(base, base["shards"] + self._written(df), df.schema.json())

    def tier(self, size: int) -> int:
        """0 for files of half the target or more, then one more for each factor below."""
        return max(0, math.ceil(math.log(max(1, self.target / 2) / max(1, size), TIER_FACTOR))) if size < self.target / 2 else 0

    def _due(self, shards: list[dict]) -> list[dict]:
        """The files of the smallest tier that has enough of them; files of the largest tier are done."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return next((tiers[t] for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= self.merge_at), [])

    def compact(self) -> dict:
        """Merge until no tier is due; each round is one job and one commit, and leaves fewer files."""
        m = self.manifest()
        while due := self._due(m["shards"]):
            names = {s["file"] for s in due}
            merged = self._merged(due, m["schema"])
            if len(merged) >= len(due):  # the session packs no further
                break
            m = self._commit(m, [s for s in m["shards"] if s["file"] not in names] + merged, m["schema"])
        return m

    def _merged(self, due: list[dict], schema: str) -> list[dict]:
        own = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "4096", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            return self._written(self._files(due, schema))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _files(self, shards: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["shards"]:
            raise ValueError("the store has no rows")
        return self._files(m["shards"], m["schema"])

    def vacuum(self) -> int:
        """Delete the files that the newest manifest doesn't name; returns how many."""
        live, gone = {s["file"] for s in self.manifest()["shards"]}, 0
        for folder in self._fs.listStatus(self._path("data")):
            for s in self._fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if name not in live:
                    self._fs.delete(s.getPath(), False)
                    gone += 1
        return gone


def sharded(docs: DataFrame, root: str | None = None, **how) -> DataFrame:
    """Take docs as arrivals, compact, and read back: docs' columns with shard, shard_bytes, shard_rows and manifest_version.

    A column of docs that has one of these names gets underscores at its end until its name is free.
    """
    spark, added = docs.sparkSession, ["shard", "shard_bytes", "shard_rows", "manifest_version"]
    for c in docs.columns:
        if c.lower() in added:
            new = c + "_"
            while new.lower() in {x.lower() for x in docs.columns} | set(added):
                new += "_"
            docs = docs.withColumnRenamed(c, new)
    stored = {c: free_name(docs, "metadata_of_row") for c in docs.columns if c.lower() == "_metadata"}
    named = docs.withColumnsRenamed(stored)
    store = Store(spark, root or new_path(spark, "shards"), **how)
    store.arrive(named)
    m = store.compact()
    columns = [F.col(f"`{stored.get(c, c)}`").alias(c) for c in docs.columns]
    if not m["shards"]:
        return docs.limit(0).select("*", F.lit("").alias("shard"), *[F.lit(0).cast("long").alias(c) for c in added[1:]])
    key = free_name(named, "file_of_row")
    facts = [(s["file"].split("/", 1)[1], s["file"], s["bytes"], s["rows"]) for s in m["shards"]]
    listed = spark.createDataFrame(facts, f"`{key}` string, shard string, shard_bytes long, shard_rows long")
    rows = store.read().withColumn(key, _name())
    return rows.join(F.broadcast(listed), key).select(*columns, *added[:-1], F.lit(m["version"]).cast("long").alias(added[-1]))


def report(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "shard", "shard_bytes", "shard_rows", "manifest_version")
