"""Phrases in texts by an index of rarest grams.

A phrase's grams are its runs of three code points, packed into one number; a
shorter phrase is its own gram. A first pass over the texts counts in how many
of them each gram of a phrase stands; each phrase is then known by its rarest
gram alone. A second pass offers of each text only the grams that some phrase
is known by, which meet the phrases in a join; a phrase longer than its gram is
then held against the text. What thins out the texts' grams is a sorted array, or
beyond a bound a bitmap, so its size does not follow the phrases'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import squeezed

SIZE = 3
#: Grams that a sieve holds one by one (8 MB), and bits of the bitmap beyond that (32 MB, a prime).
EXACT, BITS = 1 << 20, 268435399


def grams(text: str, size: int) -> np.ndarray:
    """All runs of ``size`` code points; a code point plus one takes 21 bits, so no two runs of any size share a number."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    out = np.zeros(max(0, len(codes) - size + 1), np.int64)
    for k in range(size):
        out = out << 21 | codes[k : k + len(out)]
    return out


class Sieve:
    """Which grams may be wanted."""

    def __init__(self, wanted: DataFrame, exact: int = EXACT):
        self.exact = wanted.count() <= exact
        if self.exact:
            self.held = np.sort(wanted.toArrow().column(0).to_numpy())
            return
        at = wanted.select(F.pmod("gram", F.lit(BITS)).alias("x"))
        words = at.groupBy(F.expr("x div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("m")).toArrow()
        self.held = np.zeros(BITS // 64 + 1, np.uint64)
        self.held[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)

    def of(self, found: np.ndarray) -> np.ndarray:
        """Those of the grams that pass, each once."""
        found = np.unique(found)
        if not self.exact:
            x = found % BITS
            return found[self.held[x // 64] >> (x % 64).astype(np.uint64) & np.uint64(1) > 0]
        at = np.searchsorted(self.held, found)
        return found[np.append(self.held, -1)[at] == found]


def of_phrases(plain: DataFrame) -> DataFrame:
    """(p, times, gram): the grams of each phrase."""

    def run(batches):
        for batch in batches:
            held = [np.unique(grams(p, min(SIZE, len(p)))) for p in batch.column("p").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
            yield pa.RecordBatch.from_arrays([batch.column("p").take(of), batch.column("times").take(of), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["p", "times", "gram"])

    return plain.groupBy("p").agg(F.count("*").alias("times")).mapInArrow(run, "p string, times long, gram long")


def of_texts(texts: DataFrame, sieve: Sieve, sizes: list[int], counted: bool = False) -> DataFrame:
    """(id, h, gram) for each gram that passes, each once for a text; ``counted``: (gram, n), the texts of a batch that have it."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            held = [shared.value.of(np.concatenate([grams(t, n) for n in sizes])) for t in batch.column("t").to_pylist()]
            found = np.concatenate([np.zeros(0, np.int64), *held])
            if counted:
                found, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["gram", "n"])
            else:
                of = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("h").take(of), pa.array(found)], ["id", "h", "gram"])

    return texts.select("id", "h", "t").mapInArrow(run, "gram long, n long" if counted else f"id {kind}, h long, gram long")


def seeds(texts: DataFrame, plain: DataFrame, exact: int = EXACT) -> tuple[DataFrame, list[int]]:
    """(p, times, gram), each phrase with its rarest gram, and the sizes of grams; a phrase with a gram that no text has is left out."""
    index = of_phrases(plain)
    sizes = sorted(r[0] for r in plain.select(F.least(F.length("p"), F.lit(SIZE))).distinct().collect())
    seen = of_texts(texts, Sieve(index.select("gram").distinct(), exact), sizes, counted=True).groupBy("gram").agg(F.sum("n").alias("n"))
    held = index.join(seen, "gram", "left").groupBy("p", "times").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return held.where("n > 0").select("p", "times", "gram"), sizes


def candidates(texts: DataFrame, plain: DataFrame, exact: int = EXACT) -> DataFrame:
    """(id, h, p, times): the texts that have a phrase's rarest gram."""
    known, sizes = seeds(texts, plain, exact)
    if not sizes:
        return texts.limit(0).select("id", "h", F.lit("").alias("p"), F.lit(0).cast("long").alias("times"))
    known = known.persist()  # the sieve and the join read it; a lost part is made again
    return of_texts(texts, Sieve(known.select("gram").distinct(), exact), sizes).join(known, "gram").select("id", "h", "p", "times")


def hits(texts: DataFrame, plain: DataFrame, exact: int = EXACT) -> DataFrame:
    """(id, hits): how many phrases ``p`` each text holds, without white space; a phrase counts as often as it is given."""
    texts = texts.select("id", squeezed(F.coalesce("text", F.lit(""))).alias("t")).withColumn("h", F.xxhash64("t"))
    met = candidates(texts.distinct(), plain, exact)
    sure = met.where(F.length("p") <= SIZE).select("id", "h", "times")
    held = met.where(F.length("p") > SIZE).join(texts.distinct(), ["id", "h"]).where(F.contains("t", F.col("p"))).select("id", "h", "times")
    counts = sure.unionByName(held).groupBy("id", "h").agg(F.sum("times").alias("hits"))
    return texts.join(counts, ["id", "h"], "left").select("id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
