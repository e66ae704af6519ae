"""The extraction facade: pages in, page results and a run report out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators import layout, report, selection
from leafwright.options import ExtractOptions, page_parts, page_runs
from leafwright.sources.cache_table import CacheTable


def chosen_pages(pages: DataFrame, options: ExtractOptions) -> DataFrame:
    """Pages of a selection like ``2-5,9``, as a filter that reaches the source; documents that lack a page give what they have."""
    if options.pages is None:
        return pages
    keep = F.lit(False)
    for a, b in page_runs(options.pages):
        keep = keep | F.col("page_no").between(a, b)
    return pages.where(keep)


def selection_faults(pages: DataFrame, options: ExtractOptions) -> DataFrame:
    """(doc_id, pages, fault) of documents that a strict selection stops at: a single page or the start of a range lies beyond their last page.

    Ends beyond it are cut. Without a selection there are no faults.
    """
    parts = page_parts(options.pages) if options.pages is not None else []
    beyond = max((a for a, _ in parts), default=0)
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    return last.where(F.col("pages") < beyond).withColumn("fault", F.lit(f"out of range: page {beyond}"))


def routed(pages: DataFrame, options: ExtractOptions) -> DataFrame:
    """Chosen pages with their document's engine; detection looks at the document's own first pages."""
    asked: dict[str, Column] = {"text_only": F.lit(options.text_only), "audit": F.lit(options.audit)}
    if options.engine != "auto":
        asked[options.engine] = F.lit(True)
    found = selection.detection(pages)
    engines = found.select("doc_id", selection.engine(asked, F.col("is_image")).alias("engine"))
    return chosen_pages(pages, options).join(engines, "doc_id")


def extract(pages: DataFrame, options: ExtractOptions | None = None, lines: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, engine, text, chars, error): the text layer where it is good enough, else recognised lines in their layout.

    ``lines`` and ``blocks`` are what a recogniser and a layout model gave; pages
    sent to recognition without lines get an error. Pages with lines but without
    blocks are their lines in order.
    """
    options = options or ExtractOptions()
    routes = routed(pages, options)
    text = routes.where("engine = 'text'").select("doc_id", F.col("page_no").alias("page"), "engine", "text", F.lit(None).cast("string").alias("error"))
    images = routes.where("engine <> 'text'")
    if lines is None:
        seen = images.select("doc_id", F.col("page_no").alias("page"), "engine", F.lit("").alias("text"), F.lit("no recogniser").alias("error"))
    else:
        wanted = images.select("doc_id", "page_no")
        read = lines.where(F.col("conf") >= options.min_conf).join(wanted, list(layout.PAGE), "left_semi")
        kept = (blocks if blocks is not None else lines.sparkSession.createDataFrame([], "doc_id long, page_no int, block_idx int, label string, score double, bbox struct<x0: int, y0: int, x1: int, y1: int>"))
        kept = layout.kept_blocks(kept, options.min_score).join(wanted, list(layout.PAGE), "left_semi")
        laid = layout.markdown(read, kept, layout.page_widths(kept, images)).select(*layout.PAGE, F.col("text").alias("md"))
        flat = layout.page_text(read).withColumnRenamed("text", "plain")
        has = kept.select(*layout.PAGE).distinct().withColumn("laid", F.lit(True))
        got = images.drop("text").join(flat, list(layout.PAGE), "left").join(laid, list(layout.PAGE), "left").join(has, list(layout.PAGE), "left")
        body = F.when(F.col("laid"), F.col("md")).otherwise(F.col("plain"))
        seen = got.select("doc_id", F.col("page_no").alias("page"), "engine", F.coalesce(body, F.lit("")).alias("text"), F.when(body.isNull(), "no lines").alias("error"))
    return text.unionByName(seen).withColumn("chars", F.length("text"))


def extract_cached(pages: DataFrame, read: Callable[[DataFrame], DataFrame], held: CacheTable, options: ExtractOptions | None = None) -> DataFrame:
    """Rows of ``pages`` with text, error and cache: ``hit`` if the text was held, else what ``read`` gives of the pages that were not.

    ``pages`` has cache_key and engine. Texts that were read are held from then
    on; audits are neither looked up nor held. ``refresh`` reads all anew and holds
    the results, ``no_cache`` does neither. What was read is written once, to a folder of the table, before it is put or returned.
    """
    options = options or ExtractOptions()
    able = F.col("engine") != "audit"
    known = held.lookup(pages.where(able)) if not (options.refresh or options.no_cache) else pages.where(able).withColumn("cached_text", F.lit(None).cast("string"))
    misses = known.where("cached_text is null").drop("cached_text").unionByName(pages.where(~able))
    path = f"{held.path}/runs/{uuid.uuid4().hex}"
    read(misses).write.parquet(path)
    got = pages.sparkSession.read.parquet(path)
    hits = known.where("cached_text is not null").withColumn("text", F.col("cached_text")).withColumns({"error": F.lit(None).cast("string"), "cache": F.lit("hit")})
    out = hits.select(*pages.columns, "text", "error", "cache").unionByName(got.select(*pages.columns, "text", "error", F.lit(None).cast("string").alias("cache")))
    if not options.no_cache:
        held.upsert(got.where(able).select("cache_key", "text"))
    return out


def extract_report(results: DataFrame) -> DataFrame:
    """The run report of ``extract``'s rows."""
    return report.run_report(results.withColumn("time", F.lit(0.0)))


def tool_result(reports: DataFrame, kind: str = "extract") -> DataFrame:
    """What a tool call shows of a report: six fields of an extraction, five of a layout; an error passes through."""
    fields = {"extract": ("status", "engine", "pages", "total_time", "issues", "output"), "layout": ("status", "total_blocks", "total_crops", "layout_path", "errors")}[kind]
    return reports.select(*(F.col(f) if f in reports.columns else F.lit(None).cast("string").alias(f) for f in fields), *[c for c in ("error",) if c in reports.columns])
