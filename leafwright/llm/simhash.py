"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are cut into tiles by the set bits of their two halves. If two
tiles' counts differ by more than the radius in sum, no two of their members
can link, so that pair of tiles is never made. What is left is compared whole:
numpy exclusive-or and bit counts over sub-tiles, which are skipped by the same
rule on the counts of 16-bit quarters. A pair of tiles gives a spanning forest
of its links, not the links, so that a group of thousands of near copies costs
rows in proportion to its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, looked_up, saved, tuples

SEED = 42


def fingerprint(text: bytes | None, size: int = 4, chunk: int = 1 << 16) -> int:
    """The unsigned SimHash of one UTF-8 text (null or wordless: 0)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, chunk):
        h = b"".join([digest(line[i:j], SEED) for i, j in zip(starts[k : k + chunk], stops[k : k + chunk])])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            ids, texts = tuples(batch, "doc_id", "text")
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, sub: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``a``, or (if given) of those between ``a`` and ``b``."""

    def sorted_tile(x):
        q = _quarters(x)
        order = np.lexsort((q[:, 3], q[:, 1], q[:, 2], q[:, 0]))
        x, q = x[order], q[order]
        cuts = np.arange(0, len(x), sub)
        return x, cuts, np.minimum.reduceat(q, cuts), np.maximum.reduceat(q, cuts)

    x, cuts, low, high = sorted_tile(a)
    y, ycuts, ylow, yhigh = (x, cuts, low, high) if b is None else sorted_tile(b)
    nodes, shift = (x, 0) if b is None else (np.concatenate([x, y]), len(x))
    label = np.arange(len(nodes))
    for k, i in enumerate(cuts):
        gap = np.maximum(0, np.maximum(low[k] - yhigh, ylow - high[k])).sum(1)
        for m in np.flatnonzero(gap <= radius):
            if b is None and m < k:
                continue
            j = ycuts[m]
            near = np.bitwise_count(x[i : i + sub, None] ^ y[None, j : j + sub]) <= radius
            p, q = np.nonzero(near)
            if not len(p):
                continue
            p, q = p + i, q + j + shift
            while len(p):
                s, t = label[p], label[q]
                apart = s != t
                p, q, s, t = p[apart], q[apart], s[apart], t[apart]
                if len(p):
                    np.minimum.at(label, np.maximum(s, t), np.minimum(s, t))
                    while (label != (up := label[label])).any():
                        label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def tiled(cells: list[tuple[int, int, int]], tile_rows: int) -> list[tuple[int, int, int, int]]:
    """(hi, lo, first tile, parts) of each cell (hi, lo, count): small cells share a tile with those next to them, large ones have several."""
    out, tile, held = [], -1, tile_rows
    for hi, lo, n in sorted(cells):
        parts = -(-n // tile_rows)
        if parts > 1:
            out.append((hi, lo, tile + 1, parts))
            tile, held = tile + parts, tile_rows
            continue
        if held + n > tile_rows:
            tile, held = tile + 1, 0
        held += n
        out.append((hi, lo, tile, 1))
    return out


def links(fps: DataFrame, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """Links (u, v) that connect just what links of ``radius`` bits between distinct ``fp`` connect.

    ``fps`` has each fp once. The driver gets the counts by set bits of the two
    halves, 33 x 33 at most; a tile holds about ``tile_rows`` fingerprints
    whatever the input. A pair of tiles is made if some cells of theirs are
    within the radius; each tile goes to its pairs in one shuffle.
    """
    spark = fps.sparkSession
    fps = fps.select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")
    )
    cells = tiled([tuple(r) for r in fps.groupBy("hi", "lo").count().collect()], tile_rows)
    grid = spark.createDataFrame(cells or [(0, 0, 0, 1)], "hi int, lo int, tile long, parts long")
    tiles = (
        fps.join(F.broadcast(grid), ["hi", "lo"])
        .withColumn("tile", F.col("tile") + F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy("tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = saved(tiles)
    # Ranges of tiles that are near, a row for each pair of cells at most; the pairs are made where they are used.
    near = {(s, p, t, q) for h, l, s, p in cells for k, m, t, q in cells if (s, t) == (min(s, t), max(s, t)) and abs(h - k) + abs(l - m) <= radius}
    pairs = (
        spark.createDataFrame(sorted(near) or [(0, 1, 0, 1)], "s long, p long, t long, q long")
        .select(F.explode(F.sequence(F.col("s"), F.col("s") + F.col("p") - 1)).alias("a"), "t", "q")
        .select("a", F.explode(F.sequence(F.col("t"), F.col("t") + F.col("q") - 1)).alias("b"))
        .where("a <= b")
        .distinct()
        .withColumn("pair", F.xxhash64("a", "b"))
    )
    count = sum(p * q for _, p, _, q in near)
    ends = pairs.select("pair", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.where("a < b").select("pair", F.col("b").alias("tile"), F.lit(1).alias("side")))
    dealt = ends.join(tiles, "tile").select("pair", "side", "fps").repartition(max(1, min(count, 100_000)), "pair").sortWithinPartitions("pair", "side")

    def run(batches):
        last, mine = None, None

        def found(a, b):
            u, v = forest(a, b, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        # A pair comes as its first tile, then, unless it is the pair of a tile with itself, its second.
        for batch in batches:
            for k in range(batch.num_rows):
                pair, held = batch.column(0)[k].as_py(), batch.column(2)[k].values.to_numpy().view(np.uint64)
                if mine is not None:
                    yield found(mine, held if pair == last else None)
                last, mine = (None, None) if pair == last else (pair, held)
        if mine is not None:
            yield found(mine, None)

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, tile_rows: int = 32768) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null and wordless texts have fingerprint zero and link like any other. A
    null doc_id gets its component but is never the smallest; component_id is
    null if nothing reachable has an id. Repeated rows each give a row; columns
    other than doc_id and text are not read. An empty table gives no rows.
    """
    each = saved(fingerprints(docs, size))
    distinct = saved(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = components(links(distinct, radius, tile_rows), "u", "v").withColumnRenamed("node", "fp")
    classes = saved(distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = saved(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of")))
    classes = saved(looked_up(classes.select("fp", "component", "n"), smallest, "component", "of").select("fp", "component_id", "n"))
    return looked_up(each, classes, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each group: the one whose doc_id is its component's smallest.

    Rows without an id cannot be told apart and stay. Of rows that repeat an id
    one stays; as such ids are few, only their rows are dealt out anew.
    """
    found = near_duplicates(docs, radius, size)
    ids = saved(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")))
    single = docs.join(ids.where("n = 1"), "doc_id", "left_semi")
    again = docs.join(ids.where("n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(again).unionByName(docs.where("doc_id is null"))
