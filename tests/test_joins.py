"""Joins by an index of their own, against plain versions on adversarial rows: boxes by a grid, vectors by pivots, phrases by rarest grams."""

import random
import time

from pyspark.sql import functions as F

from leafwright.operators import boxjoin, evaluation, layout, phrases_by_gram

LINES = "doc_id long, page_no int, line_id int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>"
BLOCKS = "doc_id long, page_no int, block_idx int, label string, bbox struct<x0: int, y0: int, x1: int, y1: int>"


def boxes(spark):
    """Pages with boxes of very different sizes, ties, repeats, negative places, empty and missing boxes."""
    r = random.Random(11)
    lines, blocks = [], []
    for page in range(8):
        size = (1, 20, 500, 5000)[page % 4]
        for k in range(60):
            x, y = r.uniform(-1000, 3000), r.uniform(-1000, 3000)
            w, h = r.choice([(r.uniform(0, size), r.uniform(0, size)), (0.0, 5.0), (4000.0, 3.0), (30.0, 12.0)])
            lines.append((page, 1, k, "t", None if k % 17 == 0 else (x, y, x + w, y + h)))
        for k in range(40):
            x, y, w, h = r.randrange(-1000, 3000), r.randrange(-1000, 3000), r.choice([0, 1, size, 300, 4000]), r.choice([1, size, 60])
            blocks.append((page, 1, k, "b", None if k % 13 == 0 else (x, y, x + w, y + h)))
        # Ties: the same block twice, the higher index first; two halves of one line; exactly the least share.
        blocks += [(page, 1, 90, "b", (0, 0, 100, 100)), (page, 1, 80, "b", (0, 0, 100, 100)), (page, 1, 70, "b", (200, 0, 210, 10)), (page, 1, 71, "b", (210, 0, 220, 10))]
        lines += [(page, 1, 100, "t", (10.0, 10.0, 90.0, 20.0))] * 3 + [(page, 1, 101, "t", (200.0, 0.0, 220.0, 10.0)), (page, 1, 102, "t", (30.0, 0.0, 130.0, 10.0))]
    lines += [(50, 1, 0, "alone", (0.0, 0.0, 5.0, 5.0))]
    blocks += [(60, 1, 0, "alone", (0, 0, 5, 5))]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_grid_equals_rows(spark):
    lines, blocks = boxes(spark)
    want = rows(layout.assigned(lines, blocks))
    assert rows(boxjoin.assigned_by_grid(lines, blocks)) == want
    for pairs in (0, 2500, 1 << 40):
        assert rows(boxjoin.assigned_by_size(lines, blocks, pairs=pairs)) == want
    assert rows(boxjoin.assigned_by_grid(lines.limit(0), blocks)) == [] and rows(boxjoin.assigned_by_grid(lines, blocks.limit(0))) == rows(layout.assigned(lines, blocks.limit(0)))


def test_grid_candidates_are_few_on_a_dense_page(spark):
    """50,000 lines and 5,000 blocks of one page: under ten candidates a line, and time in proportion."""
    side, page = 250, (F.col("id") % 1 + 1).alias("doc_id")
    place = lambda n: (F.col("id") % n, F.floor(F.col("id") / n))
    (cx, cy), (bx, by) = place(side), place(50)
    line = F.struct((cx * 40.0).alias("x0"), (cy * 20.0).alias("y0"), (cx * 40.0 + 36).alias("x1"), (cy * 20.0 + 14).alias("y1"))
    box = F.struct((bx * 200).cast("int").alias("x0"), (by * 40).cast("int").alias("y0"), (bx * 200 + 200).cast("int").alias("x1"), (by * 40 + 40).cast("int").alias("y1"))
    lines = spark.range(50_000).select(page, page.cast("int").alias("page_no"), F.col("id").cast("int").alias("line_id"), F.lit("t").alias("text"), line.alias("bbox"))
    blocks = spark.range(5_000).select(page, page.cast("int").alias("page_no"), F.col("id").cast("int").alias("block_idx"), F.lit("b").alias("label"), box.alias("bbox"))
    start = time.monotonic()
    got = boxjoin.assigned_by_grid(lines, blocks).select("line_id", "block_idx").collect()
    assert time.monotonic() - start < 60
    want = {k: (k // side * 20 // 40) * 50 + k % side * 40 // 200 for k in range(50_000)}
    assert len(got) == 50_000 and all(r.block_idx == want[r.line_id] for r in got)
    plan = boxjoin.candidates(lines, blocks)
    assert plan.count() < 2 * 50_000
    assert "BroadcastNestedLoopJoin" not in plan._jdf.queryExecution().executedPlan().toString()


VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(n, seed=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    return [(k, [x + r.gauss(0, 0.05) for x in centres[k % 20]], k % 2) for k in range(n)]


def test_pivots_give_all_pairs(spark):
    nan, inf = float("nan"), float("inf")
    given = clustered(240) + [(1000, None, 1), (1001, [], 1), (1002, [nan] * 16, 1), (1003, [inf] * 16, 1), (1004, [None] + [0.0] * 15, 1), (1005, [0.5, 0.5], 1), (1006, [0.5, 0.55], 1), (1007, [0.5] * 16, None)]
    given += [(2000 + k, [0.25] * 16, 0) for k in range(30)]
    vectors = spark.createDataFrame(given, VECTORS)
    plain = [(i, [float(x) for x in v], label) for i, v, label in [tuple(r) for r in vectors.collect()] if v and None not in v and all(abs(x) < inf for x in v)]
    want = set()
    for i, x, a in plain:
        for j, y, b in plain:
            if i < j and a == b and a is not None and len(x) == len(y) and sum(abs(p - q) for p, q in zip(x, y)) / len(x) < 0.06:
                want.add((i, j))
    for most, count in ((2048, 4), (5, 4), (5, 1)):
        got = evaluation.near_vectors(vectors, 0.06, count, most).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert len(want) > 500
    assert evaluation.near_vectors(vectors.limit(0), 0.06).count() == 0


def test_pivots_compare_few(spark):
    vectors = spark.createDataFrame(clustered(2000), VECTORS)
    pairs = 2 * 1000 * 999 / 2
    compared = evaluation.near_pairs(vectors, 0.07).count()
    assert evaluation.near_vectors(vectors, 0.07).count() <= compared < pairs / 10


def test_samples_are_few_and_sorted(spark):
    given = [("a", d, p) for d in range(30) for p in (1, 2)] + [("b", 0, 2), ("b", 29, 1), ("c", 0, 1)]
    labelled = spark.createDataFrame(given, "label string, doc_id long, page_no int").repartition(5)
    assert [tuple(r) for r in evaluation.samples(labelled).collect()] == [(0, 1, ["a", "c"]), (0, 2, ["a", "b"]), (29, 1, ["b"])]
    plan = evaluation.representatives(labelled)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("Exchange")


def test_grams_give_all_hits(spark):
    r = random.Random(9)
    letters = "abcdé日 \n\t"
    texts = [(k % 50, "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 40, 300])))) for k in range(120)] + [(7, None), (8, "x" * 200_000 + "needle"), (9, "\0\0a𝄞")]
    phrases = ["".join(r.choice("abcdé日") for _ in range(r.choice([1, 2, 3, 4, 6]))) for _ in range(60)] + ["needle", "x" * 40, "needle", " a b ", "", None, "\0", "\0a", "a𝄞", "𝄞", "absent words", "日"]
    given, wanted = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    plain = [p for p in ("".join((p or "").split()) for p in phrases) if p]
    want = sorted((i, sum(p in "".join((t or "").split()) for p in plain), len(plain)) for i, t in texts)
    assert sorted(map(tuple, evaluation.phrase_hits(given, wanted, 0).collect())) == want
    # By a bitmap too, as beyond the bound of the sorted array.
    squeezed = wanted.select(F.regexp_replace("phrase", r"(?U)\s", "").alias("p")).where("length(p) > 0")
    assert sorted((r.id, r.hits, len(plain)) for r in phrases_by_gram.hits(given, squeezed, exact=0).collect()) == want
    assert evaluation.phrase_hits(given, wanted.limit(0), -1).where("hits > 0").count() == 0


def test_grams_shuffle_few_rows(spark):
    """Under two rows meet for each text and phrase that match, though each phrase's start is common."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    phrases = ["common" + "".join(r.sample(words, 3)) for _ in range(50)] + ["q", "zz"]
    texts = [(k, "common" + "".join(r.choice(words) for _ in range(30)) + "".join(r.sample(phrases, 2))) for k in range(300)]
    given = spark.createDataFrame(texts, "id long, t string").withColumn("h", F.xxhash64("t"))
    met = phrases_by_gram.candidates(given, spark.createDataFrame([(p,) for p in phrases], "p string"))
    hits = sum(p in t for _, t in texts for p in phrases)
    assert hits <= met.count() < 2 * hits


def test_many_vectors_of_one_label_are_compared_in_small_tiles(spark):
    """Vectors spread evenly, which no pivot tells apart: tiles of bounded size, all near pairs, in the time that arrays take."""
    r = random.Random(6)
    given = [(k, [r.gauss(0, 0.125) for _ in range(64)], 1) for k in range(1500)]
    vectors = spark.createDataFrame(given, VECTORS)
    start = time.monotonic()
    got = evaluation.near_vectors(vectors, 0.125, most=200).collect()
    assert time.monotonic() - start < 15
    plain = [(r.vec_id, r.embedding) for r in vectors.collect()]
    some = {i: x for i, x in plain if i < 20}
    want = {(i, j) for i, x in some.items() for j, y in plain if i < j and sum(abs(p - q) for p, q in zip(x, y)) / 64 < 0.125}
    assert want and {(r.a, r.b) for r in got if r.a < 20} == want and len({(r.a, r.b) for r in got}) == len(got)


def test_texts_do_not_go_through_the_grid(spark):
    """Only pages and boxes are shuffled for the grid: a line's text is in none of its exchanges, and if nobody asks for it in none at all."""
    lines, blocks = boxes(spark)
    out = boxjoin.assigned_by_grid(lines, blocks).select("doc_id", "page_no", "line_id", "block_idx", "overlap")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in "".join(x for x in plan.split("\n") if "Aggregate" in x or "Join" in x or "Project" in x)
