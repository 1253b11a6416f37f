"""Tables by key in hash buckets with a manifest of versions: a batch rewrites the buckets of its own keys and no others.

A version's data are folders of buckets; its manifest says which folder each bucket is in, and is put in place by one rename after
all of them are written. A batch whose version has a manifest already changes nothing, so a repeated micro-batch is harmless; one that
failed before its manifest has left folders that no manifest names, which vacuum removes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "__bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """A table at path whose rows are filed by a key's hash. The number of buckets is fixed by the first version; choose it so that a
    bucket is one task's work."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/manifest")
        if not self._files.exists(at):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, or the newest one's; null for an empty table."""
        known = [v for v in self.versions() if version is None or v == version]
        return json.loads(self._text(f"{self.path}/manifest/{known[-1]}.json")) if known else None

    def _publish(self, version: int, manifest: dict) -> None:
        temporary, final = self._path(f"{self.path}/manifest/.{version}.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/{version}.json")
        out = self._files.create(temporary)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(temporary, final):
            self._files.delete(temporary, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another batch")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: Sequence[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version; columns that came later are null in buckets written before."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"{self.path} has no version" if version is None else f"{self.path} has no version {version}")
        return self._read(sorted(m["folders"].values()), StructType.fromJson(m["schema"]))

    def apply(self, updates: DataFrame, version: int, merge: Merge) -> bool:
        """Makes a version: merge(old rows, new rows) of the buckets that updates have keys in. Old rows have the columns known so far. False
        if the version is there already; an older one than the newest is refused."""
        known = self.versions()
        if version in known:
            return False
        if known and version < known[-1]:
            raise ValueError(f"version {version} after {known[-1]}")
        old = self.manifest() or {"folders": {}, "schema": updates.schema.jsonValue(), "buckets": self.buckets, "key": self.key}
        if (old["key"], old["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"{self.path} is by {old['key']} in {old['buckets']} buckets")
        touched = [r[0] for r in updates.select(self.bucket().alias("b")).distinct().collect()]  # a row a bucket
        before = self._read([old["folders"][str(b)] for b in touched if str(b) in old["folders"]], StructType.fromJson(old["schema"]))
        merged = merge(before, updates)
        folder, schema = f"data/{version}-{uuid.uuid4().hex}", merged.schema
        merged.withColumn(_BUCKET, self.bucket()).repartition(max(1, len(touched)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = {s.getPath().getName().partition("=")[2] for s in self._files.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()}
        kept = {b: f for b, f in old["folders"].items() if int(b) not in touched}
        self._publish(version, old | {"schema": schema.jsonValue(), "folders": kept | {b: f"{folder}/{_BUCKET}={b}" for b in written}})
        return True

    def upsert(self, updates: DataFrame, version: int, order: Column | None = None) -> bool:
        """Updates replace rows of their keys, as a whole; columns that either side lacks are null, and null is a key as others. Of updates
        with one key the last by order stays; without an order keys must be unique."""
        if order is not None:
            columns = updates.columns
            one = F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), order).alias("__one")
            updates = updates.groupBy(F.col(f"`{self.key}`").alias("__key")).agg(one).select("__one.*")

        def merge(before: DataFrame, new: DataFrame) -> DataFrame:
            keys = new.select(F.col(f"`{self.key}`").alias("__key"))
            return before.join(keys, before[f"`{self.key}`"].eqNullSafe(keys["__key"]), "left_anti").unionByName(new, allowMissingColumns=True)

        return self.apply(updates, version, merge)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the folders that none of the newest keep manifests names, and older manifests; their names. Not while a batch is at work."""
        known = self.versions()
        live = [json.loads(self._text(f"{self.path}/manifest/{v}.json"))["folders"].values() for v in known[-keep:]]
        named, gone = {f for folders in live for f in folders}, []
        for v in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifest/{v}.json"), False)
        data = self._path(f"{self.path}/data")
        for s in self._files.listStatus(data) if self._files.exists(data) else []:
            folder = f"data/{s.getPath().getName()}"
            for b in self._files.listStatus(s.getPath()):
                if b.isDirectory() and f"{folder}/{b.getPath().getName()}" not in named:
                    self._files.delete(b.getPath(), True)
                    gone.append(f"{folder}/{b.getPath().getName()}")
            if not any(f.startswith(folder + "/") for f in named):
                self._files.delete(s.getPath(), True)
        return sorted(gone)
