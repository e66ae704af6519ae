"""The result cache as a versioned table: buckets of keys, deltas, snapshots, compaction.

A version is a manifest, one small JSON file that names the data files of each
bucket and the version in which they came. Data files are never changed, and a
manifest comes into being by a rename that fails if the version is there
already: a reader of one version is not moved by later ones, a writer that dies before
its rename has changed nothing, and of two writers of one version the second
starts anew on the first one's. A key's bucket is its hash, so a lookup reads
the buckets of its keys, and an upsert adds a file to each bucket it has keys
of and reads none. Where a bucket has several files the newest row of a key
counts; compaction makes them one file again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "cache_key string, text string"
JOINED = 4  # versions that are read by joins with the newer ones' keys; more are grouped, texts and all


class Conflict(Exception):
    """Another writer took the version."""


class Files:
    """The few calls that are made of the store that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a new file whole; raise Conflict if it is there."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(draft, self.path(name)):
            self.fs.delete(draft, False)
            raise Conflict(name)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class CacheTable:
    """Rows (cache_key, text) at ``path``; ``buckets`` holds when the table is made and stays."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        if not self.versions():
            try:
                self._commit({"version": 0, "buckets": buckets, "files": {}, "done": {}})
            except Conflict:
                pass
        self.buckets = self.manifest()["buckets"]

    def versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files.names(f"{self.path}/manifest") if x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.files.read(f"{self.path}/manifest/{version:012d}.json"))

    def _commit(self, manifest: dict) -> int:
        self.files.put(f"{self.path}/manifest/{manifest['version']:012d}.json", json.dumps(manifest))
        return manifest["version"]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """(cache_key, text) of some buckets or all; only buckets of several versions are grouped."""
        files = {int(b): x for b, x in manifest["files"].items() if buckets is None or int(b) in buckets}
        single = [name for x in files.values() if len({v for _, v in x}) == 1 for name, _ in x]
        several: dict[int, list[str]] = {}
        for x in files.values():
            if len({v for _, v in x}) > 1:
                for name, version in x:
                    several.setdefault(version, []).append(name)
        read = lambda names: self.spark.read.schema(ROWS).parquet(*(f"{self.path}/{n}" for n in names))
        parts = [read(single)] if single else []
        if len(several) > JOINED:
            rows = reduce(DataFrame.unionByName, (read(names).withColumn("version", F.lit(v)) for v, names in several.items()))
            parts.append(rows.groupBy("cache_key").agg(F.max_by("text", "version").alias("text")))
            several = {}
        # Rows of the newest version are as they are; of an older one those count whose key no newer one has. Only the newer keys are held in memory.
        keys = lambda v: reduce(DataFrame.unionByName, (read(names).select("cache_key") for w, names in several.items() if w > v))
        for v in several:
            parts.append(read(several[v]) if v == max(several) else read(several[v]).join(keys(v).hint("shuffle_hash"), "cache_key", "left_anti"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ROWS)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, the last one if none is given; what comes later does not show."""
        return self._read(self.manifest(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """``keys`` with ``cached_text``, null where nothing is held; reads the buckets that the keys fall in."""
        wanted = [r[0] for r in keys.where("cache_key is not null").select(self._bucket(F.col("cache_key"))).distinct().collect()]
        held = self._read(self.manifest(version), wanted).withColumnRenamed("text", "cached_text")
        return keys.join(held, "cache_key", "left")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with ``bucket`` and ``part``, those of a key together, in one shuffle: a bucket in as many parts as give all shuffle partitions work."""
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        key = F.xxhash64("cache_key")
        part = F.pmod(F.floor(key / self.buckets), F.lit(parts)).cast("int")
        return rows.withColumns({"bucket": self._bucket(F.col("cache_key")), "part": part}).repartition("bucket", "part")

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write (cache_key, text, bucket) as new files: bucket -> names."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = {}
        for part in self.files.names(f"{self.path}/{folder}"):
            if part.startswith("bucket="):
                found[part[7:]] = [f"{folder}/{part}/{x}" for x in self.files.names(f"{self.path}/{folder}/{part}") if x.endswith(".parquet")]
        return found

    def upsert(self, results: DataFrame, order: Column | None = None, tag: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Put the results that have a key and a text; of rows of one key that of the greatest ``order``, then text. Returns the version.

        ``tag`` names a stream and its batch: a batch that is there already, or an earlier one, is not put again.
        """
        if tag and self.manifest()["done"].get(tag[0], -1) >= tag[1]:
            return self.versions()[-1]
        new = results.where(F.length(F.coalesce("text", F.lit(""))) > 0).where("cache_key is not null")
        new = self._dealt(new.select("cache_key", (F.lit(0) if order is None else order).alias("o"), F.col("text").alias("t")))
        # The grouping is by the same columns first, and so needs no shuffle of its own.
        new = new.groupBy("bucket", "part", "cache_key").agg(F.max(F.struct("o", "t")).alias("x")).select("cache_key", F.col("x.t").alias("text"), "bucket")
        written = self._written(new)
        for _ in range(tries):
            old = self.manifest()
            if tag and old["done"].get(tag[0], -1) >= tag[1]:
                return old["version"]
            version, files = old["version"] + 1, dict(old["files"])
            for b, names in written.items():
                files[b] = files.get(b, []) + [[n, version] for n in names]
            done = old["done"] | ({tag[0]: tag[1]} if tag else {})
            try:
                return self._commit(old | {"version": version, "files": files, "done": done})
            except Conflict:
                continue  # the files stay as they are, later than what the other writer put
        raise Conflict(self.path)

    def compact(self, most: int = 1) -> int:
        """Make one version of each bucket that has more than ``most``; no row changes. Buckets that get new files meanwhile keep those."""
        old = self.manifest()
        many = {b: x for b, x in old["files"].items() if len({v for _, v in x}) > most}
        if not many:
            return old["version"]
        written = self._written(self._dealt(self._read(old, [int(b) for b in many])).drop("part"))
        while True:
            now = self.manifest()
            files = dict(now["files"])
            for b, before in many.items():
                if files[b][: len(before)] != before:
                    return now["version"]  # another compaction was here
                files[b] = [[n, before[-1][1]] for n in written.get(b, [])] + files[b][len(before) :]
            try:
                return self._commit(now | {"version": now["version"] + 1, "files": files})
            except Conflict:
                continue

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions and the files that none of them names; not while a writer is at work. Returns how many folders went."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.files.remove(f"{self.path}/manifest/{v:012d}.json")
        named = {n.split("/")[1] for v in versions[-keep:] for x in self.manifest(v)["files"].values() for n, _ in x}
        gone = [x for x in self.files.names(f"{self.path}/data") if x not in named]
        for x in gone:
            self.files.remove(f"{self.path}/data/{x}")
        for x in self.files.names(f"{self.path}/manifest"):
            if x.endswith(".tmp"):
                self.files.remove(f"{self.path}/manifest/{x}")
        return len(gone)
