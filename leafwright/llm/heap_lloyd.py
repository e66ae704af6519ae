"""Vector codes: product quantisation by Lloyd's rounds over partition-local heaps.

Vectors are cut into equal parts, each part position has a codebook. A block,
some thousand rows of one input partition, keeps for each entry of each
codebook a heap of the parts that it holds. A part's key is its slack, the
lower bound of its distance to any other entry minus the upper bound of that
to its own, plus the drift its entry had summed up when the part was measured.
An entry's drift grows each round by its own move and the greatest move of any
other; while a key is over the drift, no other entry can be as near. So a round pops only the parts
whose bounds are violated, measures them exactly and pushes them again; the
others are not looked at. Sums of entries change by the parts that moved. A
round is one pass over the blocks, which lie in a table; what comes to the
driver is a sum for each component of each entry.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Store, looked_up
from .voronoi import LARGEST, whole

#: Rows and bytes of vectors that a block has at most.
BLOCK_ROWS, BLOCK_BYTES = 16384, 8 << 20
#: What square roots may err by.
SLACK = 1e-6


def measured(x: np.ndarray, book: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and its slack: the distance to the second nearest minus that to the nearest."""
    entry, slack = np.empty(len(x), np.int64), np.full(len(x), np.inf)
    y = book.astype(np.float64)
    own = (y**2).sum(1)
    for s in range(0, len(x), chunk):
        z = x[s : s + chunk].astype(np.float64)
        apart = (z**2).sum(1)[:, None] + own - 2 * (z @ y.T)  # whole numbers under 2**53: exact
        at = np.arange(len(z))
        first = apart.argmin(1)
        entry[s : s + chunk] = first
        if len(y) > 1:
            nearest = apart[at, first]
            apart[at, first] = np.inf
            slack[s : s + chunk] = np.sqrt(apart.min(1)) - np.sqrt(nearest)
    return entry, slack


class Heaps:
    """The heaps of one part position of a block: lists of (key, row), one for each entry."""

    def __init__(self, entries: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(entries)]

    def push(self, entry: np.ndarray, key: np.ndarray, rows: np.ndarray) -> None:
        for e, k, r in zip(entry.tolist(), key.tolist(), rows.tolist()):
            heapq.heappush(self.heaps[e], (k, r))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """The rows whose bounds the entries' summed drift has violated; no heap is searched beyond them."""
        out = []
        for heap, limit in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] <= limit + SLACK:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, keys and rows, heap by heap in the heaps' own order."""
        flat = [x for heap in self.heaps for x in heap]
        return np.array([len(h) for h in self.heaps], np.int32), np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32)

    @classmethod
    def unpacked(cls, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Heaps:
        out, flat, at = cls(0), list(zip(keys.tolist(), rows.tolist())), 0
        for n in sizes.tolist():
            out.heaps.append(flat[at : at + n])
            at += n
        return out


def moved(x: np.ndarray, rows: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """What entries gain and lose as rows go from ``old`` (None: from nowhere) to ``new``: counts, then sums of components."""
    ones = np.concatenate([np.ones((len(rows), 1), np.int64), x[rows].astype(np.int64)], axis=1)
    out = np.zeros((entries, ones.shape[1]), np.int64)
    np.add.at(out, new, ones)
    if old is not None:
        np.subtract.at(out, old, ones)
    return out


def greatest_other(move: np.ndarray) -> np.ndarray:
    """For each entry of each codebook the greatest move of any other."""
    top = np.argmax(move, axis=1)[:, None]
    rest = move.copy()
    np.put_along_axis(rest, top, 0, axis=1)
    out = np.repeat(move.max(1, keepdims=True), move.shape[1], axis=1)
    np.put_along_axis(out, top, rest.max(1, keepdims=True), axis=1)
    return out


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = BLOCK_ROWS, counted=None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row with a whole vector.

    Vectors that are null, or hold null or non-finite components, are dropped.
    Components become floor(``scale`` * x); vectors that are shorter than the
    longest, or than a multiple of ``parts``, count as if zeros followed. The
    first codebook is that of the smallest vec_ids, rows that repeat an id in
    the order of their vectors, null ids last; fewer rows than ``entries`` give
    as many entries. Rows that repeat an id each give a row. Null labels are
    one label. An empty table gives no rows. Components over 2**26 / ``scale``
    in size raise ValueError. ``counted``, if given, is called after each round
    with (parts measured, parts in all). Other columns are not read.
    """
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "lloyd")
    given = vectors.where(whole(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    width, most = given.agg(F.max(F.size("embedding")), F.max(largest)).first()
    if width is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    size = (most or 0) * scale + 1
    if size > LARGEST:
        raise ValueError(f"a component is over {LARGEST // scale} in size: distances are not exact")
    width = max(1, -(-width // parts))
    kind = np.int16 if size < 1 << 15 else np.int32

    def integers(column) -> np.ndarray:
        """(rows, parts, width) whole numbers."""
        sizes = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(sizes), parts * width), kind)
        out[np.arange(parts * width) < sizes[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        return out.reshape(-1, parts, width)

    first = given.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    books = integers(first.column("embedding").combine_chunks()).transpose(1, 0, 2).astype(np.int64)
    seeds, entries = books, books.shape[1]
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (np.dtype(kind).itemsize * parts * width)))

    label = given.schema["label"].dataType.simpleString()
    schema = f"ids array<long>, labels array<{label}>, x binary, entry binary, sizes binary, keys binary, places binary, looked long, at array<int>, change array<long>"
    shape = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def states(ids, labels, x, entry, heaps, looked, changes) -> pa.RecordBatch:
        some = np.flatnonzero(np.abs(changes).sum(2).ravel())
        sizes, keys, places = zip(*(h.packed() for h in heaps))
        bits = [np.concatenate(v).tobytes() for v in (sizes, keys, places)]
        row = [ids, labels, x.tobytes(), entry.astype(np.uint16).tobytes(), *bits, looked, some.tolist(), changes.reshape(parts * entries, -1)[some].ravel().tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, shape.types)], schema=shape)

    def begun(batches):
        """Blocks, every part measured."""
        ids, labels, xs = [], [], []

        def block():
            x = np.concatenate(xs).transpose(1, 0, 2)
            entry, heaps, changes = np.empty(x.shape[:2], np.int64), [], np.empty((parts, entries, width + 1), np.int64)
            rows = np.arange(x.shape[1])
            for p in range(parts):
                entry[p], slack = measured(x[p], seeds[p])
                heaps.append(Heaps(entries))
                heaps[p].push(entry[p], slack, rows)
                changes[p] = moved(x[p], rows, None, entry[p], entries)
            return states(ids, labels, x, entry, heaps, x.shape[0] * x.shape[1], changes)

        for batch in batches:
            for s in range(0, batch.num_rows, block_rows):
                some = batch.slice(s, block_rows)
                if ids and len(ids) + some.num_rows > block_rows:
                    yield block()
                    ids, labels, xs = [], [], []
                ids += some.column("vec_id").to_pylist()
                labels += some.column("label").to_pylist()
                xs.append(integers(some.column("embedding")))
        if ids:
            yield block()

    def opened(batch, k):
        ids, labels = batch.column("ids")[k].as_py(), batch.column("labels")[k].as_py()
        bits = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
        n = len(ids)
        sizes, keys, places = bits("sizes", np.int32).reshape(parts, -1), bits("keys", np.float64).reshape(parts, n), bits("places", np.int32).reshape(parts, n)
        return ids, labels, bits("x", kind).reshape(parts, n, width), bits("entry", np.uint16).reshape(parts, n).astype(np.int64), sizes, keys, places

    def again(books, drift):
        """The next round: parts whose bounds are violated are measured by ``books``."""

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, labels, x, entry, sizes, keys, places = opened(batch, k)
                    heaps, looked, changes = [], 0, np.zeros((parts, entries, width + 1), np.int64)
                    for p in range(parts):
                        heaps.append(Heaps.unpacked(sizes[p], keys[p], places[p]))
                        rows = heaps[p].pop(drift[p])
                        new, slack = measured(x[p][rows], books[p])
                        heaps[p].push(new, slack + drift[p][new], rows)
                        apart = new != entry[p][rows]
                        changes[p] = moved(x[p], rows[apart], entry[p][rows[apart]], new[apart], entries)
                        entry[p][rows] = new
                        looked += len(rows)
                    yield states(ids, labels, x, entry, heaps, looked, changes)

        return run

    state, drift, totals = store(given.mapInArrow(begun, schema)), np.zeros((parts, entries)), np.zeros((parts, entries, width + 1), np.int64)
    for _ in range(rounds):
        if counted:
            counted(*state.agg(F.sum("looked"), F.sum(F.size("ids")) * parts).first())
        each = state.select("at", F.posexplode("change").alias("k", "by"))
        sums = each.groupBy(F.col("at")[F.expr(f"k div {width + 1}").cast("int")].alias("place"), (F.col("k") % (width + 1)).alias("component")).agg(F.sum("by").alias("by"))
        for place, component, by in sums.collect():
            totals[place // entries, place % entries, component] += by
        held, after = totals[:, :, 0] > 0, books.copy()
        after[held] = totals[:, :, 1:][held] // totals[:, :, :1][held]
        move = np.sqrt(((after - books).astype(np.float64) ** 2).sum(2))
        drift, books = drift + move + greatest_other(move), after
        last, state = state, store(state.mapInArrow(again(books, drift), schema))
        store.drop(last)
    if counted:
        counted(*state.agg(F.sum("looked"), F.sum(F.size("ids")) * parts).first())

    told, final = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest(), books

    def coded(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, x, entry, *_ = opened(batch, k)
                apart = sum(((x[p].astype(np.int64) - final[p][entry[p]]) ** 2).sum(1) for p in range(parts))
                digits = np.char.mod("%02x", entry)
                code = ["".join(c) for c in digits.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, shape.field("labels").type.value_type), pa.array(code), pa.array(apart)], ["vec_id", "label", "code", "error"])

    done = store(state.mapInArrow(coded, f"vec_id long, label {label}, code string, error long"))
    # Labels as text, the null one empty; a hot one is joined by broadcast.
    done = done.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    errors = store(done.groupBy("named").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    out = looked_up(done, errors, "named", "rows").select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))
    store.drop(state)
    return out


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds by full comparison, in SQL, for vectors of one length that ``parts`` divides."""
    out = f"""
        with v as (
            select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) as x
            from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), p as (select r, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] as x from v, range({parts}) as t(part)),
        c0 as (select part, r as e, x from p where r < {entries}), """
    for k in range(rounds + 1):
        out += f"""
        a{k} as (
            select p.r, p.part, min(cast(list_inner_product(p.x, p.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(p.x, c.x) as bigint) * {entries} + c.e) as best
            from p join c{k} as c on c.part = p.part group by p.r, p.part
        ), """
        if k < rounds:
            out += f"""
        s{k} as (
            select part, e, list(floor(total / n) order by pos) as x
            from (select part, best % {entries} as e, pos, sum(y) as total, count(*) as n from (select a.part, best, unnest(p.x) as y, generate_subscripts(p.x, 1) as pos from a{k} as a join p on p.r = a.r and p.part = a.part) group by all)
            group by part, e
        ), c{k + 1} as (select c.part, c.e, coalesce(s.x, c.x) as x from c{k} as c left join s{k} as s on s.part = c.part and s.e = c.e), """
    return (
        out
        + f"""
        w as (select r, string_agg(printf('%02x', best % {entries}), '' order by part) as code, cast(sum(best // {entries}) as bigint) as error from a{rounds} group by r),
        h as (select sha256(string_agg(cast(y as bigint)::varchar, ',' order by part, e, pos)) as told from (select part, e, unnest(x) as y, generate_subscripts(x, 1) as pos from c{rounds}))
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, told as codebooks_sha256 from v join w on w.r = v.r, h"""
    )
