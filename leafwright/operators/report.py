"""Run reports and service contract as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW = 30  # characters below which a page has low content


def page_info(batches: DataFrame) -> DataFrame:
    """(doc_id, page, engine, time, chars): a batch's time and characters shared evenly over its pages."""
    n = F.size("pages")
    return batches.select(
        "doc_id", F.explode("pages").alias("page"), "engine", F.bround(F.col("seconds") / n, 1).alias("time"), F.floor(F.length("text") / n).cast("long").alias("chars")
    )


def issues(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, issue) from (doc_id, page, chars, error): low content first, then the error."""
    low = F.when(F.col("chars") < LOW, F.concat(F.lit("low content ("), F.col("chars").cast("string"), F.lit(" chars)")))
    found = pages.select("doc_id", "page", F.posexplode(F.filter(F.array(low, F.col("error")), lambda x: x.isNotNull())).alias("seq", "issue"))
    return found.withColumn("issue", F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), "issue"))


def run_report(pages: DataFrame) -> DataFrame:
    """(doc_id, status, total_time, pages, issues): one row a document; times are summed as rounded on their pages."""
    each = issues(pages).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "issue"))), lambda x: x.issue), "; ").alias("issues"))
    total = pages.groupBy("doc_id").agg(F.bround(F.sum(F.bround("time", 1)), 1).alias("total_time"), F.count("*").alias("pages"))
    return total.join(each, "doc_id", "left").select("doc_id", F.when(F.col("issues").isNull(), "ok").otherwise("warn").alias("status"), "total_time", "pages", "issues")


def as_json(df: DataFrame) -> DataFrame:
    """(json): rows as JSON objects; fields that are null are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def request_fault(engine: Column, source: Column, dpi: Column, output_dir: Column) -> Column:
    """The first fault of a request, or null; dpi comes as text."""
    number = dpi.try_cast("int")
    climbs = ~output_dir.startswith("/") & F.array_contains(F.split(F.translate(output_dir, "\\", "/"), "/"), "..")
    return (
        F.when(~F.coalesce(engine, F.lit("auto")).isin("auto", "hybrid", "glm", "dsocr", "ov"), "engine")
        .when(source.isNotNull() & ~source.isin("local", "cloud"), "source")
        .when(dpi.isNotNull() & (number.isNull() | ~number.between(50, 600)), "dpi")
        .when(output_dir.isNotNull() & climbs, "output_dir")
    )


def last_state(attempts: DataFrame) -> DataFrame:
    """(job, state, polls): each job's last state by time, then id."""
    return attempts.groupBy("job").agg(F.max_by("state", F.struct("at", "attempt_id")).alias("state"), F.count("*").alias("polls"))


def first_success(attempts: DataFrame, tries: int = 3) -> DataFrame:
    """(job, used, ok, at_try): the first of up to ``tries`` attempts that succeeded."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("at", "attempt_id"))
    few = attempts.withColumn("n", n).where(F.col("n") <= tries)
    hit = F.min(F.when(F.col("ok"), F.col("n")))
    return few.groupBy("job").agg(F.coalesce(hit, F.count("*")).cast("long").alias("used"), hit.isNotNull().alias("ok"), hit.cast("long").alias("at_try"))


def engine_totals(attempts: DataFrame) -> DataFrame:
    """(job, engine, n, ok, seconds): tries, those that succeeded, and their time, of each engine."""
    return attempts.groupBy("job", "engine").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum("seconds").alias("seconds"))


def warm_mean(items: DataFrame) -> DataFrame:
    """(grp, cold, warm_mean, n): the first item apart, the mean of the others; partial aggregates, so a group of any size is no sort."""
    held = items.groupBy("grp").agg(F.min_by("seconds", "seq").alias("cold"), F.sum("seconds").alias("total"), F.count("*").alias("n"))
    return held.select("grp", "cold", ((F.col("total") - F.col("cold")) / F.expr("nullif(n - 1, 0)")).alias("warm_mean"), "n")


def differential(totals: DataFrame) -> DataFrame:
    """(grp, per_item, fixed) from (grp, small_n, small_s, large_n, large_s)."""
    step = (F.col("large_s") - F.col("small_s")) / F.expr("nullif(large_n - small_n, 0)")
    return totals.select("grp", step.alias("per_item"), (F.col("small_s") - step * F.col("small_n")).alias("fixed"))


def rank_sums(scores: DataFrame) -> DataFrame:
    """(engine, rank_sum, pages) from (page, engine, score): ranks within a page, lowest score first, equal scores share a rank."""
    r = F.rank().over(Window.partitionBy("page").orderBy("score"))
    return scores.withColumn("r", r).groupBy("engine").agg(F.sum("r").cast("long").alias("rank_sum"), F.count("*").alias("pages"))
