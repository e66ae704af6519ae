"""What the training-data operators share: table access, lineage cuts, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``.

    Where that is unset a run on one machine gets a temporary folder; a cluster
    has no such folder of its own, and the call fails.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafwright-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path``, in whatever store that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Store:
    """Tables in one place of the shared folder, as Parquet: later steps read only the columns they want, and their sizes are known to the planner."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, shared_path(spark, name), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for file in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            removed(self.spark, file)

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these, from which the result is read."""
        kept = {f.rsplit("/", 2)[1] for t in tables for f in t.inputFiles()}
        for k in range(1, self.made + 1):
            if str(k) not in kept:
                removed(self.spark, f"{self.path}/{k}")

    def close(self) -> None:
        removed(self.spark, self.path)


#: Rows that a side has at most to be broadcast; they are a key and a few numbers each.
MOST = 200_000


def looked_up(left: DataFrame, keys: DataFrame, key: str, count: str, how: str = "inner", most: int = MOST) -> DataFrame:
    """``left`` joined with ``keys`` on ``key``, no key hot in a shuffle.

    ``keys`` is a table at rest with each key once; ``count`` says how many rows
    of ``left`` have it. Keys of more than a ``most``-th of those rows, which are
    fewer than ``most``, are broadcast; rows of the others meet in a shuffle, where
    no key has more than that share. ``how`` is inner, left or left_semi. ``left`` is read
    twice if both kinds exist.
    """
    n, total = keys.agg(F.count("*"), F.sum(count)).first()
    given = [] if how == "left_semi" else [c for c in keys.columns if c not in (key, count)]
    table = keys.select(key, *given)
    if n <= most:
        return left.join(F.broadcast(table), key, how)
    hot = F.col(count) > -(-total // most)
    heavy, light = (F.broadcast(keys.where(hot).select(key, *given)), keys.where(~hot).select(key, *given))
    few = left.join(heavy, key, "left_semi" if how == "left_semi" else "inner")
    return few.unionByName(left.join(F.broadcast(keys.where(hot).select(key)), key, "left_anti").join(light, key, how).select(*few.columns))


def components(edges: DataFrame, a: str, b: str, rounds: int = 50, store: Store | None = None) -> DataFrame:
    """Connected components of the links ``a``-``b`` by alternating large-star and small-star steps.

    Returns (node, component): component is the smallest node reachable. Nodes
    without links, links with a null end and self-links are left out. A node
    with very many links costs no more than its links: minima are partial
    aggregates, and nodes with many links get theirs by broadcast. The result
    lies in ``store``; tables of earlier rounds are deleted.
    """
    store = store or Store(edges.sparkSession, "components")
    kind = edges.schema[a].dataType.simpleString()
    e = edges.select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = store(e.distinct())
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        # Done when a node with a smaller neighbour has no other: then that neighbour has no smaller one.
        if least.where("m < u and n > 1").isEmpty():
            break
        large = store(looked_up(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = store(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = looked_up(large, lower, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = store(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        store.drop(e, least, large, lower)
        e = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Bits of the smallest and the largest sieve, 2 MB and 32 MB.
SIEVE_BITS = (24, 28)


def sieve(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the low bits of all values of ``column``, some eight bits for each up to the bound; it reaches the driver in words of 64 bits."""
    least, most = SIEVE_BITS
    bits = min(most, max(least, (8 * df.count()).bit_length()))
    low = df.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("x"))
    words = low.groupBy(F.shiftright("x", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("m")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return bitmap


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values the sieve lets through."""
    low = values & np.uint64((len(bitmap) << 6) - 1)
    return bitmap[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1) > 0


def tuples(batch, *names):
    """Columns of an Arrow record batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
