"""Merkle manifest, top-k search and vector codes against plain versions, on whole and on awkward tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.llm import heap_lloyd, merkle, queries, voronoi
from leafwright.llm.common import Store, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, r long, n long, g string, node string"
VECTORS = "vec_id long, embedding array<float>, label int, row long, x string, cell int, error long, code string"


# 11: Merkle manifest


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_by_hand(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def up(nodes):
    """The root of some nodes, and for each the groups it stands in: (place in the run, run)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for way, a in zip(ways, at):
            way.append((a % 8, runs[a // 8]))
        at, level = [a // 8 for a in at], [h(*run) for run in runs]
    return level[0], ways


def manifest_by_hand(rows, seen):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tries = {}
    for name in names:
        held = sorted(groups[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_by_hand(r, r.text)))
        tries[name] = (held, *up([leaf_by_hand(r, r.text) for r in held]))
    root, above = up([tries[name][1] for name in names])
    out = []
    for name, over in zip(names, above):
        held, subroot, ways = tries[name]
        for r, way in zip(held, ways):
            node, proof = leaf_by_hand(r, seen(r)), ""
            for a, run in way + over:
                proof += "".join(run[:a] + run[a + 1 :])
                node = h(*run[:a], node, *run[a + 1 :])
            out.append((r.doc_id, leaf_by_hand(r, r.text), subroot, root, h(proof), node, node == root))
    return sorted(out, key=repr)


def tampered(r):
    hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if hit else r.text


def test_manifest_query(spark, sf):
    rows = queries.op11_merkle_manifest(spark, sf).collect()
    docs = table(spark, sf, "documents").collect()
    assert sorted(map(tuple, rows), key=repr) == manifest_by_hand(docs, tampered)
    assert 0 < sum(not r.verified for r in rows) < len(rows)


AWKWARD = [
    *[(1, "Same", "en", "s", 4)] * 40, *[(7, f"Text {k % 5}", "en", None, None) for k in range(60)], (None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (None, None, None, None, None),
    (-(1 << 63), "low", "en", "s", 3), ((1 << 63) - 1, "HIGH", "en", "", 4), (5, "", "", "s", 0), (5, "E" * 300_000, "é", "s", 5), (6, "ß Ä Z", "é\0", "s", 5), (9, "lone", "zz", "s", 4), *[(k, f"T{k}", "ab", "s", 2) for k in range(-70, 71)],
]


@pytest.mark.parametrize("most", [1, 3, 16384])
def test_manifest_awkward(spark, most):
    docs = spark.createDataFrame([(*x, 1, 2, "g", "n") for x in AWKWARD], DOCS).repartition(3)
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    got = merkle.manifest(docs, found, digits=2 if most == 3 else 3, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_by_hand(docs.collect(), tampered)


def test_manifest_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest(none).count() == 0
    one = spark.createDataFrame([(3, "Text", None, "s", 4, 1, 2, "g", "n")], DOCS)
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
    (r,) = merkle.manifest(one, F.lit("other")).collect()
    assert not r.verified and r.folded_root != r.root


def test_ranks_without_sort(spark):
    rng = random.Random(3)
    ids = [rng.choice([rng.randrange(-(1 << 62), 1 << 62), rng.randrange(50)]) for _ in range(3000)] + [17] * 1500
    store = Store(spark, "ranks")
    rows = store(spark.createDataFrame([(x, "ab"[k % 2], k) for k, x in enumerate(ids)], "id long, g string, row long"))
    digits = [*merkle.number_digits("id", rows), *merkle.number_digits("row", rows)]
    got = {(r.g, r.id, r.row): (r.r, r.n) for r in merkle.ranked(rows, "g", digits, [F.col("id"), F.col("row")], store, most=20).collect()}
    for g in "ab":
        want = sorted((x, k) for k, x in enumerate(ids) if "ab"[k % 2] == g)
        assert {k: v for k, v in got.items() if k[0] == g} == {(g, *x): (r, len(want)) for r, x in enumerate(want)}
    sizes = [r["count"] for r in spark.read.parquet(f"{store.path}/1").groupBy("g").count().collect()]
    assert sum(sizes) == 4500
    store.close()


def test_text_digits_keep_order(spark):
    names = ["", "a", "a\0", "a\x01", "aÿ", "b", "é", "zz", "z", "日本", "日", "=x"]
    digits = list(merkle.text_digits("name", max(len(x.encode()) for x in names)))
    rows = spark.createDataFrame([(x,) for x in names], "name string").select("name", F.array(*digits).alias("d")).collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.d)] == sorted(names, key=str.encode)


# 12: top-k search


def search_by_hand(rows, every, k=5, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(kept) if a != b)
            out += [(i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, None, 1, "x", 2, 3, "c") for i, v in rows], VECTORS).repartition(parts)


def test_search_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    got = queries.op12_voronoi_search(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == search_by_hand(rows, 50)


@pytest.fixture(scope="module")
def awkward_vectors():
    rng = random.Random(5)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(6)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in centres[k % 6]]) for k in range(400)]
    rows += [(k, [0.5] * 8) for k in range(400, 550)] + [(500, [0.5] * 8)] * 3 + [(450, centres[0]), (None, centres[1]), (None, [0.5] * 8)]
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 8), (603, [float("inf")] + [0.0] * 7), (650, [1.0, -2.0]), (700, []), (750, [0.0] * 8), (800, [0.25] * 11)]
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize(("pivots", "tile"), [(1, 65536), (16, 40), (64, 7)])
def test_search_awkward(spark, awkward_vectors, pivots, tile):
    got = voronoi.top_k(vectors(spark, awkward_vectors), F.col("vec_id") % 50 == 0, pivots=pivots, tile_rows=tile).collect()
    assert sorted(map(tuple, got), key=repr) == search_by_hand(awkward_vectors, 50)


def test_search_edges(spark):
    assert voronoi.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi.top_k(vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi.top_k(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in voronoi.top_k(vectors(spark, [(0, [1.0]), (2, [-2.0])]), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 2, -131072)]
    with pytest.raises(Exception, match="not exact"):
        voronoi.top_k(vectors(spark, [(0, [3e38]), (2, [-2.0])]), F.col("vec_id") % 50 == 0)


def test_search_bounds_hold_and_prune():
    """Every true neighbour lies in the range of its cell; far clusters are out of all ranges but their own."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 16))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    data = np.repeat(centres, 80, axis=0) + rng.normal(0, 10, (960, 16))
    most = (data**2).sum(1).max()
    lift = lambda v: np.concatenate([v, np.sqrt(np.maximum(0, most - (v**2).sum(1)))[:, None]], axis=1)
    points, q = lift(data[::80]), np.concatenate([data[::7], np.zeros((len(data[::7]), 1))], axis=1)
    x = lift(data)
    apart, asking = (np.linalg.norm(v[:, None] - points[None], axis=2) for v in (x, q))
    cell, home = apart.argmin(1), asking.argmin(1)
    least = {c: sorted(apart[cell == c, c])[:6] for c in range(12)}
    near, far = (np.array([getattr(asking[home == c], f)(0) if (home == c).any() else [np.inf] * 12 for c in range(12)]) for f in ("min", "max"))
    lo, hi = voronoi.bounds(near, far, least, 6, 1e-3)
    own = apart[np.arange(len(x)), cell]
    inside = (own >= lo[home][:, cell]) & (own <= hi[home][:, cell])
    for k in range(len(q)):
        top = np.argsort(-(data @ q[k, :-1]), kind="stable")[:6]
        assert inside[k, top].all()
    assert inside.mean() < 0.25


# 13: vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[math.floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[whole[k][p * width : (p + 1) * width] for k in first] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in whole]

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                held = [v[p * width : (p + 1) * width] for v, a in zip(whole, now) if a[p][1] == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    now = assigned()
    errors, told = {}, h(",".join(str(x) for book in books for c in book for x in c))
    for (_, _, label), a in zip(kept, now):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in a)
    return sorted(((i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), errors[label], told) for (i, _, label), a in zip(kept, now)), key=repr)


def test_codes_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    got = queries.op13_heap_lloyd(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == codes_by_hand(rows)


@pytest.mark.parametrize(("entries", "block"), [(1, 4), (2, 64), (24, 50), (256, 16384)])
def test_codes_awkward(spark, awkward_vectors, entries, block):
    rows = [(i, v, None if k % 3 == 0 else k % 4) for k, (i, v) in enumerate(awkward_vectors)]
    given = spark.createDataFrame([(i, v, label, 1, "x", 2, 3, "c") for i, v, label in rows], VECTORS).repartition(3)
    got = heap_lloyd.codes(given, entries=entries, block_rows=block).collect()
    assert sorted(map(tuple, got), key=repr) == codes_by_hand(rows, entries=entries)


def test_codes_measure_only_violated_parts(spark):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 5) for _ in range(8)] for _ in range(16)]
    rows = [(k, [x + rng.gauss(0, 0.1) for x in centres[k % 16]], 1) for k in range(2000)]
    given, counts = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), []
    got = heap_lloyd.codes(given, entries=16, counted=lambda *x: counts.append(x)).collect()
    assert sorted(map(tuple, got), key=repr) == codes_by_hand(rows, entries=16)
    assert counts[0] == (8000, 8000) and all(looked < 0.2 * n for looked, n in counts[2:])


def test_heaps_pop_just_the_violated():
    rng = np.random.default_rng(1)
    keys, entry = rng.random(500) * 10, rng.integers(0, 7, 500)
    heaps, drift = heap_lloyd.Heaps(7), rng.random(7) * 5
    heaps.push(entry, keys, np.arange(500))
    heaps = heap_lloyd.Heaps.unpacked(*heaps.packed())
    assert heaps.pop(drift).tolist() == np.flatnonzero(keys <= drift[entry] + heap_lloyd.SLACK).tolist()
    assert heaps.pop(drift).tolist() == [] and heaps.packed()[0].sum() == (keys > drift[entry] + heap_lloyd.SLACK).sum()


def test_codes_edges(spark):
    assert heap_lloyd.codes(vectors(spark, [])).count() == 0
    assert heap_lloyd.codes(vectors(spark, [(1, None), (2, [None])])).count() == 0
    with pytest.raises(ValueError, match="not exact"):
        heap_lloyd.codes(vectors(spark, [(0, [3e38])]))
