"""Canonical pages, lines, blocks and matrices from the driver's tables, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_PAGE = 10
PAGE_WIDTH = 1200
LABELS = ("title", "text", "table", "figure", "formula", "header")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, lines): ten lines of a document are a page. Rows stay where their document is."""
    n = LINES_A_PAGE
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("all"))
    pages = lines.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0, (size(all) - 1) div {n}), p -> slice(all, p * {n} + 1, {n}))")).alias("p", "lines"))
    return pages.select("doc_id", (F.col("p") + 1).alias("page_no"), "lines")


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, page_w)."""
    return document_pages(docs).select("doc_id", "page_no", F.array_join("lines", "\n").alias("text"), F.lit(float(PAGE_WIDTH)).alias("page_w"))


def ocr_lines(docs: DataFrame) -> DataFrame:
    """Lines with boxes in two columns and a made confidence."""
    li = F.col("line_id")
    rows = document_pages(docs).select("doc_id", "page_no", F.posexplode("lines").alias("line_id", "text"))
    x0, y0 = 50 + 600 * (li % 2), 40 + 24 * F.floor(li / 2)
    box = F.struct(
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + F.least(F.lit(550), 8 * F.length("text") + 1)).cast("double").alias("x1"), (y0 + 20).cast("double").alias("y1"),
    )
    conf = ((F.col("doc_id") * 31 + F.col("page_no") * 7 + li * 17) % 100) / F.lit(100.0)
    return rows.select("doc_id", "page_no", "line_id", "text", box.alias("bbox"), conf.alias("conf"))


def layout_blocks(docs: DataFrame) -> DataFrame:
    """Four blocks a page and, for every seventh document, one of full width."""
    made = """concat(transform(sequence(0, 3), b -> struct(b as block_idx, element_at(labels, cast((doc_id + b) % 6 + 1 as int)) as label,
        ((doc_id * 7 + b * 13) % 100) / 100D as score,
        struct(40 + 600 * (b % 2) as x0, cast(36 + 72 * (b div 2) + (doc_id * 5 + b * 11) % 17 - 8 as int) as y0,
               610 + 600 * (b % 2) as x1, cast(36 + 72 * (b div 2) + (doc_id * 5 + b * 11) % 17 - 8 + 72 as int) as y1) as bbox)),
        if(doc_id % 7 = 0, array(struct(4 as block_idx, element_at(labels, cast((doc_id + 4) % 6 + 1 as int)) as label, 0.9D as score,
               struct(40 as x0, 100 as y0, 1140 as x1, 118 as y1) as bbox)), array()))"""
    rows = document_pages(docs).select("doc_id", "page_no", F.array(*map(F.lit, LABELS)).alias("labels"))
    return rows.select("doc_id", "page_no", F.explode(F.expr(made)).alias("b")).select("doc_id", "page_no", "b.*")


def ctc_matrices(embeddings: DataFrame, steps: int = 8) -> DataFrame:
    """(line_id, matrix): a vector as ``steps`` rows of class scores."""
    rows = F.expr(f"transform(sequence(0, {steps - 1}), t -> slice(embedding, t * (size(embedding) div {steps}) + 1, size(embedding) div {steps}))")
    return embeddings.select(F.col("vec_id").alias("line_id"), rows.alias("matrix"))


def attempts(events: DataFrame) -> DataFrame:
    """(job, attempt_id, at, ok, seconds, engine): events as tries of jobs."""
    return events.select(
        F.col("user_id").alias("job"), F.col("event_id").alias("attempt_id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("seconds"), F.col("event_type").alias("engine"),
    )


#: DuckDB forms of the adapters, for oracles.
SQL_LINES = "lines as (select doc_id, i - 1 as line_idx, t from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents))"
SQL_PAGES = SQL_LINES + ", page as (select doc_id, (line_idx // 10 + 1)::int as page_no, string_agg(t, chr(10) order by line_idx) as text from lines group by 1, 2)"
SQL_OCR = (
    SQL_LINES
    + """, ocr as (select doc_id, (line_idx // 10 + 1)::int as page_no, (line_idx % 10)::int as line_id, t as text,
    (50 + 600 * ((line_idx % 10) % 2))::double as x0, (40 + 24 * ((line_idx % 10) // 2))::double as y0,
    (50 + 600 * ((line_idx % 10) % 2) + least(550, 8 * length(t) + 1))::double as x1, (60 + 24 * ((line_idx % 10) // 2))::double as y1,
    ((doc_id * 31 + (line_idx // 10 + 1) * 7 + (line_idx % 10) * 17) % 100) / 100.0::double as conf from lines)"""
)
SQL_BLOCKS = """pg as (select distinct doc_id, page_no from ocr), blocks as (
    select doc_id, page_no, b::int as block_idx, ['title', 'text', 'table', 'figure', 'formula', 'header'][((doc_id + b) % 6 + 1)::int] as label,
        ((doc_id * 7 + b * 13) % 100) / 100.0::double as score, (40 + 600 * (b % 2))::int as x0, (36 + 72 * (b // 2) + (doc_id * 5 + b * 11) % 17 - 8)::int as y0,
        (610 + 600 * (b % 2))::int as x1, (36 + 72 * (b // 2) + (doc_id * 5 + b * 11) % 17 + 64)::int as y1
    from pg, range(4) r(b)
    union all select doc_id, page_no, 4, ['title', 'text', 'table', 'figure', 'formula', 'header'][((doc_id + 4) % 6 + 1)::int], 0.9::double, 40, 100, 1140, 118 from pg where doc_id % 7 = 0)"""
