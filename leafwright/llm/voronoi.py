"""Exact top-k inner products by a Voronoi join.

Vectors become integers. A data vector x gets one coordinate more, the root of
(greatest norm)^2 - |x|^2, a query gets 0 there: the greater an inner product,
the smaller the distance. Queries and data go to the cells of their nearest
pivots. From the cells' summaries (distances of their members to the pivots)
each group of queries gets a radius within which all its answers lie and, for
each cell, the range of pivot distances that members within that radius can have.
Only rows in the range are replicated to the group, and are solved there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST, Store
from .simhash import tiled

#: Sizes of integer components and of the square of a norm up to which float64 products are exact.
LARGEST, EXACT = 1 << 26, 1 << 53


def whole(vectors: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vectors.isNotNull() & F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def scaled(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, and the lengths of the vectors."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component is over {LARGEST // scale} in size: its products are not exact")
    return flat.astype(np.int32), np.diff(column.offsets.to_numpy())


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros at their ends."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties to smaller columns; minus infinity is no score."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        over, ties = scores > kth, scores == kth
        ties &= np.cumsum(ties, axis=1, dtype=np.int32) <= k - over.sum(1, keepdims=True)
        over |= ties
    else:
        over = np.ones(scores.shape, bool)
    return np.nonzero(over & (scores > -np.inf))


def bounds(near: np.ndarray, far: np.ndarray, least: dict[int, list[float]], k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of queries and each of data: the range of distances to the data's pivot that answers can have.

    ``near`` and ``far`` are the least and greatest distances of a cell's queries
    to each pivot, ``least`` the smallest distances of each cell's members to
    theirs: far + least bounds the distance of that many members from all the cell's queries.
    """
    reach = np.concatenate([np.empty((len(far), 0)), *(far[:, j, None] + np.array(d)[None, :] for j, d in least.items())], axis=1)
    radius = np.sort(reach, axis=1)[:, k - 1 : k] if reach.shape[1] >= k else np.full((len(far), 1), np.inf)
    with np.errstate(invalid="ignore"):  # cells without queries
        return near - radius - slack, far + radius + slack


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, pivots: int = 128, tile_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the greatest inner products with each row for which ``queries`` holds.

    All rows but the query's own take part; ties go to the smaller vec_id, a
    null vec_id after all others. Vectors that are null, or hold null or
    non-finite components, take no part; shorter vectors count as if zeros
    followed. Rows that repeat a vec_id are rows of their own: each is a query
    and a candidate. Where fewer rows than ``k`` are left, all are given; an
    empty table gives no rows. Components over 2**26 / ``scale`` in size, or
    norms whose square passes 2**53, raise ValueError. Other columns are read by ``queries`` only.
    """
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "voronoi")
    given = vectors.where(whole(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), "embedding")

    def integers(batches):
        for batch in batches:
            flat, sizes = scaled(batch.column("embedding"), scale)
            x = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            own = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.bincount(own, flat.astype(np.float64) ** 2, len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("asks"), x, pa.array(norm)], ["vec_id", "asks", "x", "norm"])

    rows = store(given.mapInArrow(integers, "vec_id long, asks boolean, x array<int>, norm double").withColumn("row", F.monotonically_increasing_id()))
    n, asked, width, most = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x")), F.max("norm")).first()
    if not asked:
        return spark.createDataFrame([], ANSWERS)
    if most > EXACT:
        raise ValueError("the square of a norm passes 2**53: inner products are not exact")

    width = max(1, width)
    chosen = rows.orderBy(F.xxhash64("row"), "row").limit(pivots).select("x").toArrow()
    points = np.unique(matrix(chosen.column("x").combine_chunks(), width), axis=0)
    lifts = np.sqrt(np.maximum(0, most - (points**2).sum(1)))

    def placed(batches):
        for batch in batches:
            x, norm = matrix(batch.column("x"), width), batch.column("norm").to_numpy()
            inner = x @ points.T
            apart = np.sqrt(np.maximum(0, 2 * most - 2 * (inner + np.sqrt(np.maximum(0, most - norm))[:, None] * lifts)))
            cell = apart.argmin(1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            asking = np.sqrt(np.maximum(0, norm[:, None] + most - 2 * inner))
            spread = pa.array([d if a else None for a, d in zip(asks, asking.tolist())], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "vec_id", "x", "asks")), pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(x)), cell]), pa.array(asking.argmin(1), pa.int32()), spread],
                ["row", "vec_id", "x", "asks", "cell", "apart", "home", "spread"],
            )

    rows = store(rows.select("row", "vec_id", "x", "asks", "norm").mapInArrow(placed, "row long, vec_id long, x array<int>, asks boolean, cell int, apart double, home int, spread array<double>"))

    # Summaries: rows of cells, their k + 1 least distances (one may be the query's own), and ranges of the queries' distances to all pivots.
    sizes = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    nearest = rows.select("cell", "apart", F.row_number().over(Window.partitionBy("cell").orderBy("apart")).alias("at")).where(F.col("at") <= k + 1)
    least: dict[int, list[float]] = {}
    for r in nearest.collect():
        least.setdefault(r.cell, []).append(r.apart)
    ranges = rows.where("asks").select("home", F.posexplode("spread").alias("cell", "d")).groupBy("home", "cell").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.count("*").alias("n"))
    near, far, homes = np.full((len(points), len(points)), np.inf), np.full((len(points), len(points)), -np.inf), {}
    for home, cell, a, b, count in ranges.collect():
        near[home, cell], far[home, cell], homes[home] = a, b, count
    lo, hi = bounds(near, far, least, k + 1, 1e-6 * (1 + 2 * np.sqrt(most)))

    # Small cells share a tile, large ones have several; tiles grow with the data up to ``tile_rows``.
    most_rows = max(1, min(tile_rows, (1 << 24) // (4 * width)))
    of_data = tiled([(c, 0, m) for c, m in sizes.items()], max(1, min(most_rows, max(256, n // 64))))
    of_asks = tiled([(c, 0, m) for c, m in homes.items()], most_rows)
    groups: dict[int, list[int]] = {}
    for home, _, first, parts in of_asks:
        for g in range(first, first + parts):
            groups.setdefault(g, []).append(home)
    tile = lambda df, kind: df.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("first", "parts")
    grid = lambda cells, name: F.broadcast(spark.createDataFrame([(c, t, p) for c, _, t, p in cells], f"{name} int, first long, parts long"))
    data = tile(rows.join(grid(of_data, "cell"), "cell"), "cell").select("row", "vec_id", "x", "cell", "apart", F.col("tile").alias("t"))
    asks = tile(rows.where("asks").join(grid(of_asks, "home"), "home"), "home")
    asks = asks.select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("x").alias("y"), "home", F.col("tile").alias("g"))

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of one tile of data for each query of one group."""
        right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        q, x = matrix(left.column("y").combine_chunks(), width), matrix(right.column("x").combine_chunks(), width)
        cell, apart, home = right.column("cell").to_numpy(), right.column("apart").to_numpy(), left.column("home").to_numpy()
        mine, theirs = left.column("asker").to_numpy(), right.column("row").to_numpy()
        asked, found, score = [], [], []
        step = max(1, (1 << 22) // max(1, len(x)))
        for h in np.unique(home):
            some = np.flatnonzero((apart >= lo[h][cell]) & (apart <= hi[h][cell]))
            of = np.flatnonzero(home == h)
            for s in range(0, len(of), step):
                part = of[s : s + step]
                products = q[part] @ x[some].T
                products[mine[part][:, None] == theirs[some]] = -np.inf
                i, j = best(products, k)
                asked.append(part[i])
                found.append(some[j])
                score.append(products[i, j].astype(np.int64))
        asked, found = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (asked, found))
        return pa.table(
            {
                "asker": left.column("asker").take(pa.array(asked)),
                "query_id": left.column("query_id").take(pa.array(asked)),
                "vec_id": right.column("vec_id").take(pa.array(found)),
                "score": pa.array(np.concatenate(score) if score else np.empty(0, np.int64)),
            }
        )

    answers, some = None, sorted(groups)
    at_once = max(1, MOST // max(1, len(points) + max(t + p for _, _, t, p in of_data)))
    for s in range(0, len(some), at_once):
        # What is broadcast has a row for each group and cell, or group and tile: MOST at most.
        routes, pairs = [], set()
        for g in some[s : s + at_once]:
            least_of, most_of = lo[groups[g]].min(0), hi[groups[g]].max(0)
            for c, _, first, parts in of_data:
                if most_of[c] >= 0:
                    routes.append((g, int(c), float(least_of[c]), float(most_of[c])))
                    pairs.update((g, t) for t in range(first, first + parts))
        sent = data.join(F.broadcast(spark.createDataFrame(routes, "g long, cell int, lo double, hi double")), "cell").where("apart between lo and hi").drop("lo", "hi")
        asking = asks.join(F.broadcast(spark.createDataFrame(sorted(pairs), "g long, t long")), "g")
        local = asking.groupBy("g", "t").cogroup(sent.groupBy("g", "t")).applyInArrow(solved, "asker long, query_id long, vec_id long, score long")
        answers = local if answers is None else answers.unionByName(local)
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    store.only(rows)
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ANSWERS = "query_id long, rank int, vec_id long, score long"


def oracle(k: int = 5, scale: int = 256, every: int = 50) -> str:
    """All pairs, in SQL."""
    return f"""
        with v as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.r, q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.x, v.x) as bigint) as score
            from v as q join v on v.r != q.r where q.vec_id % {every} = 0
        ), n as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from n where rank <= {k}"""
