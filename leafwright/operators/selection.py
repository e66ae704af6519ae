"""Page selection, text/image detection and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwright.functions.text import strip

THRESHOLD = 100  # mean characters a page below which a document is images
SAMPLE = 3  # first pages of a document that tell


def selected_pages(specs: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, pages, fault) from (doc_id, spec, total): distinct ascending pages, or why there are none.

    An end beyond the last page is cut to it before the range is tested. With
    ``strict`` a fault raises instead.
    """
    parts = F.filter(F.transform(F.split("spec", ","), strip), lambda p: p != "")
    ranges = specs.select("doc_id", "total", F.transform(parts, lambda p: F.struct(p.alias("p"), F.split(p, "-").alias("e"))).alias("parts"))
    each = """transform(parts, x -> struct(size(x.e) > 2 as malformed, size(x.e) = 2 as ranged, try_cast(trim(x.e[0]) as int) as a, try_cast(trim(element_at(x.e, -1)) as int) as b))"""
    cut = "transform(parts, x -> struct(x.malformed as malformed, x.a as a, if(x.ranged, least(x.b, total), x.b) as b))"
    bad = "transform(parts, x -> case when x.malformed then 'malformed' when x.a is null or x.b is null then 'not a number' when x.a < 1 or x.a > total or x.b > total or x.b < x.a then 'out of range' end)"
    ranges = ranges.withColumn("parts", F.expr(each)).withColumn("parts", F.expr(cut)).withColumn("bad", F.expr(f"filter({bad}, x -> x is not null)"))
    fault = F.when(F.size("bad") > 0, F.col("bad")[0]).when(F.size("parts") == 0, "nothing selected")
    # Only sound ranges are spelt out: sequence() counts down if its ends are the wrong way round.
    pages = F.expr("array_sort(array_distinct(flatten(transform(parts, x -> sequence(x.a, x.b)))))")
    out = ranges.withColumn("fault", fault)
    if strict:
        out = out.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault"))))
    return out.select("doc_id", F.when(F.col("fault").isNull(), pages).alias("pages"), "fault")


def suffixes(pages: DataFrame) -> DataFrame:
    """(doc_id, suffix) from (doc_id, page_no): runs of pages as ``p5-10_20``, cut to 80 characters after the p."""
    island = F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    runs = pages.select("doc_id", "page_no").distinct().withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", name.alias("n")))), lambda x: x.n), "_")
    return runs.groupBy("doc_id").agg(F.concat(F.lit("p"), F.left(joined, F.lit(80))).alias("suffix"))


def detection(pages: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, avg_chars, sample_size, is_image): the mean stripped length of a document's own first pages."""
    first = pages.where(F.col("page_no") <= sample)
    return first.groupBy("doc_id").agg(
        F.avg(F.length(strip(F.col("text")))).alias("avg_chars"), F.count("*").alias("sample_size"), (F.avg(F.length(strip(F.col("text")))) < threshold).alias("is_image")
    )


def engine(options: dict[str, Column], is_image: Column) -> Column:
    """The engine by precedence of what is asked for, else by detection."""
    chain = None
    for name, result in (
        ("text_only", "text"), ("audit", "audit"), ("hybrid", "hybrid"), ("vl", "vl"), ("glm", "glm"), ("dsocr", "dsocr"), ("llama", "llama"), ("ov", "ov"),
    ):
        if name in options:
            chain = F.when(options[name], result) if chain is None else chain.when(options[name], result)
    return (F.when(is_image, "hybrid") if chain is None else chain.when(is_image, "hybrid")).otherwise("text")


def first_passing(probes: DataFrame) -> DataFrame:
    """(job, backend, failed) from (job, rank, backend, ok, reason): the first backend that passes, and the failures before it."""
    chosen = F.min(F.when(F.col("ok"), F.struct("rank", "backend")))
    failures = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("rank", "backend", "reason"))))
    got = probes.groupBy("job").agg(chosen.alias("chosen"), failures.alias("failures"))
    before = F.filter("failures", lambda x: F.col("chosen").isNull() | (x["rank"] < F.col("chosen.rank")))
    return got.select("job", F.coalesce("chosen.backend", F.lit("paddle")).alias("backend"), F.array_join(F.transform(before, lambda x: F.concat_ws(":", x["backend"], x["reason"])), ";").alias("failed"))
