"""Tables by key that take batches of changes: buckets of rows, and a manifest of each version.

A row's bucket is a hash of its key.  A batch rewrites the buckets it touches, in
folders of its own version, and then puts a manifest in place that names the current
folder of every bucket.  Putting it in place is one rename that fails where another
writer was faster, so a reader sees one version or the next one, and a writer never
loses another one's changes.  Folders that none of the last versions names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small files and listings on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, content: str) -> None:
        stream = self.fs.create(self.at(path), True)
        stream.write(bytearray(content.encode()))
        stream.close()

    def put(self, path: str, content: str) -> None:
        """Writes a file beside its place and renames it; an error if something is there."""
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.write(draft, content)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(path).toUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.at(draft), self.at(path), none)
        except Exception:
            self.delete(draft)
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class KeyedTable:
    """The last row of each key.

    ``order`` decides which of two rows of a key is later; of equal ones the batch's
    stays.  Columns of ``first`` keep the value of the first row that had one, like an id
    or a time of insertion; of two rows in a batch the earlier one's.  With ``partial``,
    null columns of a change leave the table's value as it is, and a change that comes late
    fills only what is null.  A null key is a key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64, first: tuple[str, ...] = (), partial: bool = False, keep: int = 2):
        self.spark, self.path, self.key, self.order, self.first, self.partial, self.keep = spark, path.rstrip("/"), key, order, first, partial, keep
        self.files = Files(spark, path)
        self.buckets = self.manifest().get("buckets", buckets)  # fixed once the table is there

    def manifest(self, back: int = 0) -> dict:
        names = [n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.files.read(f"{self.path}/manifests/{names[-1 - back]}")) if len(names) > back else {}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, of: set[str] | None = None) -> DataFrame | None:
        folders = [f for b, f in manifest.get("folders", {}).items() if of is None or b in of]
        if not folders:
            return None
        return self.spark.read.schema(manifest["schema"]).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self) -> DataFrame:
        """The rows of the newest version; an error if there is none."""
        manifest = self.manifest()
        if not manifest:
            raise ValueError(f"{self.path} has no version yet")
        found = self._folders(manifest)
        return self.spark.createDataFrame([], manifest["schema"]) if found is None else found

    def upsert(self, batch: DataFrame, number: int | None = None) -> int:
        """Merges a batch and returns the version; a batch whose ``number`` is no later than the last one's changes nothing."""
        before = self.manifest()
        version = before.get("version", -1)
        if number is not None and number <= before.get("batch", -1):
            return version
        schema = before.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        columns = [f.name for f in self.spark.createDataFrame([], schema).schema]
        key = f"`{self.key}`"
        rows = batch.select(*(F.col(f"`{c}`") for c in columns)).withColumns({"__new": F.lit(True), "__bucket": self.bucket(F.col(key))})
        touched = {str(r[0]) for r in rows.select("__bucket").distinct().collect()}  # ``buckets`` at most
        if not touched:
            return version
        old = self._folders(before, touched)
        if old is not None:
            rows = rows.unionByName(old.withColumns({"__new": F.lit(False), "__bucket": self.bucket(F.col(key))}))
        at = F.struct(F.col(f"`{self.order}`"), "__new")
        last = lambda c: F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), at) if self.partial else at).alias(c)
        once = lambda c: F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.struct("__new", F.col(f"`{self.order}`")))).alias(c)
        merged = rows.groupBy("__bucket", F.col(key)).agg(*(once(c) if c in self.first else last(c) for c in columns if c != self.key))
        name = f"{version + 1:012d}-{uuid.uuid4().hex[:8]}"
        # a bucket's rows meet anyway; a file for each
        merged.select("__bucket", *(F.col(f"`{c}`") for c in columns)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        folders = before.get("folders", {}) | {b: f"{name}/__bucket={b}" for b in touched}
        after = {"version": version + 1, "batch": before.get("batch", -1) if number is None else number, "buckets": self.buckets, "schema": schema, "folders": folders}
        self.files.put(f"{self.path}/manifests/{version + 1:012d}.json", json.dumps(after))
        self._expire()
        return version + 1

    def _expire(self) -> None:
        names = [n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        for name in names[: -self.keep]:
            self.files.delete(f"{self.path}/manifests/{name}")
        kept = [self.manifest(i) for i in range(min(self.keep, len(names)))]
        used = {f for m in kept for f in m["folders"].values()}
        oldest = kept[-1]["version"]
        for name in self.files.names(f"{self.path}/data"):
            buckets = [f"{name}/{b}" for b in self.files.names(f"{self.path}/data/{name}") if b.startswith("__bucket=")]
            if int(name.split("-")[0]) > oldest:  # another writer's folder can be without a manifest yet
                continue
            if not used.intersection(buckets):
                self.files.delete(f"{self.path}/data/{name}")
            else:
                for bucket in set(buckets) - used:
                    self.files.delete(f"{self.path}/data/{bucket}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that runs again after a restart changes nothing."""
        return lambda batch, number: self.upsert(batch, number) and None
