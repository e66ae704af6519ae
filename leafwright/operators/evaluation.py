"""Quality of extractions: coverage, garbling, markers, phrases, labels, similarity."""

from __future__ import annotations

import difflib
import json
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from leafwright.functions.similar import ratio
from leafwright.functions.text import let, squeezed, strip
from leafwright.operators import phrases_by_gram

PAGE_MARK = r"<!-- PAGE (\d+) -->"
#: Fixed value: symbols that speak for formulas.
MATH = "∑∫√≤≥≈≠±×÷∞αβγδεζηθλμσφψωΩ∂∇"
PHRASE_BYTES = 4 << 20  # phrases up to this size go to every task


def coverage(output: Column, reference: Column) -> Column:
    """Characters of the output that are no white space over the stripped length of the reference; null where that is 0."""
    return F.bround(F.length(squeezed(F.coalesce(output, F.lit("")))) / F.nullif(F.length(strip(F.coalesce(reference, F.lit("")))), F.lit(0)), 3)


def table_rows(md: Column) -> Column:
    return F.regexp_count(md, F.lit(r"(?m)^\|.*\|")).cast("long")


def long_table_lines(md: Column, longest: int = 300) -> Column:
    return F.size(F.filter(F.split(md, "\n", -1), lambda x: x.startswith("|") & (F.length(x) > longest))).cast("long")


def page_envelope(pages: Column, text: Column) -> Column:
    """A batch's text under its marker, ``PAGE n`` or ``PAGES a-b``; an empty text is nothing."""
    first, last = F.get(pages, F.lit(0)).cast("string"), F.element_at(pages, -1).cast("string")
    label = F.when(F.size(pages) > 1, F.concat(F.lit("PAGES "), first, F.lit("-"), last)).otherwise(F.concat(F.lit("PAGE "), first))
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.concat(F.lit("\n\n<!-- "), label, F.lit(" -->\n\n"), text)).otherwise("")


def page_marks(md: Column) -> Column:
    return F.regexp_count(md, F.lit(PAGE_MARK)).cast("long")


def split_pages(md: Column) -> Column:
    """Array of (page, body) of a marked text; without marks the whole is page null."""
    numbers = F.regexp_extract_all(md, F.lit(PAGE_MARK), 1)
    pages = lambda bodies: F.transform(numbers, lambda n, i: F.struct(n.cast("int").alias("page"), strip(F.get(bodies, i + 1)).alias("body")))
    marked = let(F.split(md, PAGE_MARK, -1), pages)
    return F.when(~F.contains(md, F.lit("<!-- PAGE ")) | (F.size(numbers) == 0), F.array(F.struct(F.lit(None).cast("int").alias("page"), md.alias("body")))).otherwise(marked)


def picked_page(md: Column, page: Column) -> Column:
    """The body of one page; the whole text if nothing is marked, a notice if the page is not there."""
    parts = split_pages(md)
    hit = F.get(F.filter(parts, lambda x: x.page.isNull() | (x.page == page)), F.lit(0)).body
    return F.coalesce(hit, F.lit("PAGE NOT FOUND"))


def section(md: Column, start: str, end: str) -> Column:
    """What stands between two literal markers, stripped; null without them."""
    at = F.instr(md, start)
    rest = F.substr(md, at + len(start))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), strip(F.left(rest, stop - 1)))


def _held_by(phrases: Column):
    return lambda text: F.size(F.filter(phrases, lambda p: F.contains(text, p)))


def phrase_hits(texts: DataFrame, phrases: DataFrame, block_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(id, hits, phrases): how many phrases each text holds, white space apart.

    Phrases of up to ``block_bytes`` together are a constant of the plan, held
    against each text with no join. More of them meet the texts in a join on
    their rarest grams. Null texts are empty, empty phrases no phrases.
    """
    plain = phrases.select(squeezed(F.col("phrase")).alias("p")).where(F.length("p") > 0)
    bytes_, total = plain.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0)), F.count("*")).first()
    total = F.lit(total).cast("long").alias("phrases")
    if bytes_ > block_bytes:
        return phrases_by_gram.hits(texts, plain).select("id", "hits", total)
    block = [r.p for r in plain.collect()]
    # A lambda's variable is computed once; a column would be squeezed anew for each phrase.
    one = F.transform(F.array(squeezed(F.coalesce("text", F.lit("")))), _held_by(F.from_json(F.lit(json.dumps(block)), "array<string>")))
    return texts.select("id", F.get(one, F.lit(0)).cast("long").alias("hits"), total)


def text_labels(text: Column) -> Column:
    """Labels of a page that its text alone tells; the patterns are fixed values."""
    dots = (F.length(text) - F.length(F.replace(text, F.lit("......"), F.lit("")))) / 6 + F.regexp_count(text, F.lit("…")) + F.regexp_count(text, F.lit(r"[^\s]\s*\.{3,}\s*\d+"))
    has = lambda c, name: F.when(c, F.lit(name))
    return F.array_compact(
        F.array(
            has(F.regexp_like(text, F.lit(r"(?m)^\s*目\s*录\s*$")) | F.regexp_like(text, F.lit(r"(?mi)^Contents\s*$")), "toc_head"),
            has(dots >= 5, "toc_entries"),
            has(F.regexp_count(text, F.lit(f"[{MATH}]")) >= 6, "math_symbols"),
            has(F.regexp_like(text, F.lit(r"(?m)^\s*第\s*[0-9一二三四五六七八九十]+\s*章")), "chapter_head"),
        )
    )


def two_column(words: DataFrame) -> DataFrame:
    """(doc_id, page_no) of pages whose words (…, x0, page_w) stand in two columns with a gap between."""
    stats = words.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("x0")).alias("xs"), F.max("page_w").alias("w"))
    mid = F.expr("get(xs, size(xs) div 2)")
    stats = stats.withColumn("mid", mid).withColumn("l", F.expr("filter(xs, x -> x < mid)")).withColumn("r", F.expr("filter(xs, x -> x >= mid)"))
    near = F.expr("size(filter(xs, x -> x > w * 0.5D - 20 and x < w * 0.5D + 20)) / size(xs)")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x) / F.size(c)
    ok = (F.size("xs") > 80) & (F.size("l") > 60) & (F.size("r") > 60)
    return stats.where(ok).where((near < 0.05) & (mean("r") - mean("l") > F.col("w") * 0.35)).select("doc_id", "page_no")


def ruled(strokes: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, page_no) of pages with ``least`` long horizontal strokes (x0, y0, x1, y1, page_w)."""
    long = (F.abs(F.col("y0") - F.col("y1")) < 1) & (F.abs(F.col("x0") - F.col("x1")) > 0.2 * F.col("page_w"))
    return strokes.where(long).groupBy("doc_id", "page_no").count().where(F.col("count") >= least).select("doc_id", "page_no")


def representatives(labelled: DataFrame, each: int = 2) -> DataFrame:
    """(label, doc_id, page_no): the first pages of each label.

    A limit on the place within the label: Spark cuts each task's rows to that
    many of a label before it shuffles them, so a label on a third of all pages costs no sort of them.
    """
    place = F.row_number().over(Window.partitionBy("label").orderBy("doc_id", "page_no"))
    return labelled.select("label", "doc_id", "page_no", place.alias("_place")).where(F.col("_place") <= each).drop("_place")


def samples(labelled: DataFrame, each: int = 2) -> DataFrame:
    """(doc_id, page_no, labels): the representatives of all labels together, each page once with the labels it stands for, in page order."""
    held = representatives(labelled, each).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return held.orderBy("doc_id", "page_no")


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pivots(vectors: DataFrame, count: int = 4, sample: int = 256) -> list[list[float]]:
    """``count`` vectors that are far from each other, out of the ``sample`` of the lowest hashes; the choice changes no result."""
    rows = [r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()]
    apart = lambda a, b: sum(abs(x - y) for x, y in zip_longest(a, b, fillvalue=0.0))
    chosen, far = rows[:1], [apart(rows[0], x) for x in rows]
    while len(chosen) < count and max(far, default=0) > 0:
        chosen.append(rows[far.index(max(far))])
        far = [min(d, apart(chosen[-1], x)) for d, x in zip(far, rows)]
    return chosen


ALONE = -1 << 40  # the second cell of vectors whose first cell is not split
CELL = ["label", "n", "c", "c2"]
PAIR = [*CELL, "t", "e", "e2", "u"]
STEP = 1 << 15  # pairs compared at a time, so that what is summed stays in a core's cache


def _cells(v: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(label, n, c, at, c2, parts): where each first and second cell goes, and in how many tiles; and the tiles' pairs, each once."""
    held = v.groupBy("label", "n", "c", "at").agg(F.count("*").alias("held"))
    whole, of = Window.partitionBy("label", "n", "c"), Window.partitionBy(*CELL)
    held = held.withColumn("c2", F.when(F.sum("held").over(whole) > most, F.col("at")).otherwise(ALONE))
    held = held.withColumn("parts", F.ceil(F.sum("held").over(of) / most)).drop("held")
    a = held.select(*CELL, "parts").distinct()
    b = a.select("label", "n", F.col("c").alias("e"), F.col("c2").alias("e2"), F.col("parts").alias("q"))
    next_ = a.select("*", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("e"))
    alone = F.col("c2") == ALONE
    # Cells that are not split meet all of the next ones; split ones meet those that are not, and near ones of those that are.
    any_ = next_.where(alone).join(b, ["label", "n", "e"])
    seconds = F.when(F.col("e") == F.col("c"), F.array(F.col("c2"), F.col("c2") + 1)).otherwise(F.array(F.lit(ALONE).cast("long"), F.col("c2") - 1, F.col("c2"), F.col("c2") + 1))
    some = next_.where(~alone).withColumn("e2", F.explode(seconds)).join(b, ["label", "n", "e", "e2"])
    pairs = any_.unionByName(some).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    same = (F.col("c") == F.col("e")) & (F.col("c2") == F.col("e2"))
    pairs = pairs.withColumn("u", F.explode(F.sequence(F.when(same, F.col("t")).otherwise(0), F.col("q") - 1)))
    return held, pairs.select(*PAIR)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width).T.copy()


def _compared_tiles(limit: float, sift_only: bool):
    """Of two tiles, or of one with itself: pairs that no pivot tells apart, and unless ``sift_only`` those that are near."""
    slack = limit * (1 + 1e-9) + 1e-12

    def summed(shape, pairs):
        """Sums from the first component to the last, as a plain sum has them."""
        total, part = np.zeros(shape), np.empty(shape)
        for p, q in pairs:
            part = np.subtract(p, q, out=part)
            total += np.abs(part, out=part)
        return total

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        alone = not right.num_rows
        right = left if alone else right
        ids, others = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        n = left.column("n")[0].as_py()
        x, y = _matrix(left.column("embedding"), n), _matrix(right.column("embedding"), n)
        k = len(left.column("d")[0])
        dx, dy = _matrix(left.column("d"), k), _matrix(right.column("d"), k)
        found, step = [], max(1, STEP // len(others))
        for s in range(0, len(ids), step):
            first, second = ids[s : s + step, None], others[None, :]
            met = first < second if alone else first != second
            for p, q in zip(dx, dy):
                met &= np.abs(p[s : s + step, None] - q[None, :]) < slack
            i, j = np.nonzero(met)
            if sift_only:
                distance = np.zeros(len(i))
            elif len(i) * 4 > met.size:
                distance = (summed(met.shape, zip(x[:, s : s + step, None], y[:, None, :])) / n)[i, j]
            else:
                distance = summed(i.shape, ((p[s + i], q[j]) for p, q in zip(x, y))) / n
            near = slice(None) if sift_only else distance < limit
            i, j = ids[s + i[near]], others[j[near]]
            found.append((np.minimum(i, j), np.maximum(i, j), distance[near]))
        return pa.table([pa.array(np.concatenate(z)) for z in zip(*found)], names=["a", "b", "distance"])

    return run


def _met(vectors: DataFrame, limit: float, count: int, most: int, sift_only: bool) -> DataFrame:
    """(a, b, distance), by tiles.

    The distances of two vectors to a pivot differ by no more than the vectors
    do. Vectors go to cells as wide as the limit by the distance to the first
    pivot and meet those of their own and the next cells. A cell of more than ``most`` vectors
    is split by the second pivot in the same way, and what still has more is cut by hash: no tile, and so no
    task's piece of work, grows with the data. The other pivots sift the pairs that met.
    """
    n = F.size("embedding")
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (n > 0)).where(finite(F.col("embedding")))
    known = pivots(v, count)
    away = lambda p: F.zip_with("embedding", F.lit([float(x) for x in p]), lambda x, y: F.abs(F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    d = F.array(*(F.aggregate(away(p), F.lit(0.0), lambda t, z: t + z) / n for p in known)).cast("array<double>")
    v = v.select("vec_id", "label", "embedding", n.alias("n"), d.alias("d"))
    cell = lambda k: F.coalesce(F.floor(F.get("d", F.lit(k)) / limit), F.lit(0))
    v = v.select("*", cell(0).alias("c"), cell(1).alias("at"))
    held, pairs = _cells(v, most)
    v = v.join(held, ["label", "n", "c", "at"]).withColumn("t", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")))
    left = v.join(pairs, [*CELL, "t"]).select(*PAIR, "vec_id", "embedding", "d")
    other = v.select("label", "n", F.col("c").alias("e"), F.col("c2").alias("e2"), F.col("t").alias("u"), "vec_id", "embedding", "d")
    apart = pairs.where((F.col("c") != F.col("e")) | (F.col("c2") != F.col("e2")) | (F.col("t") != F.col("u")))
    right = other.join(apart, ["label", "n", "e", "e2", "u"]).select(*(F.col(x).alias(x) for x in (*PAIR, "vec_id", "embedding", "d")))  # columns of its own
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return left.groupBy(*PAIR).cogroup(right.groupBy(*PAIR)).applyInArrow(_compared_tiles(limit, sift_only), f"a {kind}, b {kind}, distance double")


def near_pairs(vectors: DataFrame, limit: float, count: int = 4, most: int = 2048) -> DataFrame:
    """(a, b): pairs of one label, a < b, that no pivot tells apart; all with a mean absolute difference below ``limit`` are among them."""
    return _met(vectors, limit, count, most, True).select("a", "b")


def near_vectors(vectors: DataFrame, limit: float, count: int = 4, most: int = 2048) -> DataFrame:
    """(a, b, distance): pairs a < b of one label with a mean absolute difference below ``limit``; null and non-finite vectors have none."""
    return _met(vectors, limit, count, most, False)


COMPARED = StructType([StructField(n, DoubleType() if n == "ratio" else LongType()) for n in ("chars_a", "chars_b", "ratio", "changed_lines")])


@F.pandas_udf(COMPARED)
def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Lengths, difflib's ratio, and the lines that a unified diff adds or takes away, of two whole texts; null is empty."""

    def one(x, y):
        lines = difflib.unified_diff(x.splitlines(), y.splitlines(), n=0, lineterm="")
        changed = sum(line[:1] in ("+", "-") for line in lines if line[:3] not in ("+++", "---"))
        return len(x), len(y), ratio(x, y), changed

    return pd.DataFrame([one(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], columns=["chars_a", "chars_b", "ratio", "changed_lines"])


def concatenated(pages: DataFrame) -> DataFrame:
    """(doc_id, md): a document's whole pages in order, each under its marker, a rule between."""
    part = F.concat(F.lit("<!-- PAGE "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("page_no", part.alias("p"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x.p), "\n\n---\n\n").alias("md"))


def gate(text: Column, covered: Column, encrypted: Column, least: float = 0.85) -> Column:
    """Whether an extraction stands, or which reason sends it on to recognition."""
    empty = F.coalesce(F.length(squeezed(text)), F.lit(0)) == 0
    return F.when(encrypted, "encrypted").when(empty, "empty").when(covered < least, "coverage").otherwise("ok")


def rerun_verdict(old_chars: Column, new_text: Column, garbled_chars: Column) -> Column:
    """Whether a second extraction is taken: not if empty, garbled, or half as long or less."""
    n = F.length(F.coalesce(new_text, F.lit("")))
    return F.when(n == 0, "empty").when(garbled_chars > 0, "garbled").when(n * 2 <= old_chars, "shrunk").otherwise("accept")
