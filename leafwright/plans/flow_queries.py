"""Queries on whole flows: the facade, incremental ingestion, and extensions on events."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.operators.evaluation import concatenated
from leafwright.options import ExtractOptions
from leafwright.sources import document_files, pdf
from leafwright.sources.cache_table import CacheTable
from leafwright.sources.driver_tables import SQL_BLOCKS, SQL_OCR, SQL_PAGES, layout_blocks, ocr_lines, pages, table
from leafwright.streaming import ingest, jobs, totals

from . import extract
from .geometry_queries import RENDERED
from .registry import query, sql_strip


@query(
    f"""with {SQL_PAGES}, d as (select doc_id, avg(length({sql_strip("text")})) < 100 as image from page where page_no <= 3 group by 1)
    select doc_id, page_no as page, case when image then 'hybrid' else 'text' end as engine, case when image then '' else text end as text, case when image then 'no recogniser' end as error,
        case when image then 0 else length(text) end::int as chars from page join d using (doc_id) where page_no between 1 and 2 or page_no = 4"""
)
def extract_text_path(spark, d):
    return extract.extract(pages(table(spark, d, "documents")), ExtractOptions(pages="1-2,4"))


_ALL = SQL_OCR.replace(", ocr as (", ", every as (") + ", ocr as (select * from every where conf >= 0.5)"
_LAID = RENDERED.replace(SQL_OCR, _ALL).replace("distinct doc_id, page_no from ocr)", "distinct doc_id, page_no from every)")


@query(
    f"""with laid as ({_LAID}), {_ALL}, {SQL_BLOCKS.replace("distinct doc_id, page_no from ocr)", "distinct doc_id, page_no from every)")},
    flat as (select doc_id, page_no, string_agg(text, chr(10) order by floor(y0 / 20), x0, line_id) as plain from ocr group by 1, 2),
    body as (select doc_id, page_no, case when exists (select 1 from blocks b where b.doc_id = pg.doc_id and b.page_no = pg.page_no and score >= 0.3) then laid.text else plain end as t
        from pg left join laid using (doc_id, page_no) left join flat using (doc_id, page_no))
    select doc_id, page_no as page, 'hybrid' as engine, coalesce(t, '') as text, case when t is null then 'no lines' end as error, length(coalesce(t, ''))::int as chars from body"""
)
def extract_hybrid_path(spark, d):
    docs = table(spark, d, "documents")
    return extract.extract(pages(docs), ExtractOptions(engine="hybrid"), ocr_lines(docs), layout_blocks(docs))


def _scratch(spark) -> str:
    """A new path that all machines reach: in the checkpoint folder, or on one machine in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.gettempdir()
    return f"{base}/ingest-{uuid.uuid4().hex}"


@query("select 'd' || doc_id as cache_key, text from documents where text <> ''")
def ingest_incremental(spark, d):
    """A stream over the document files into a cache table, run twice: the second run finds nothing new.

    The path is a pattern, as a stream takes a pattern or a folder but no single file.
    """
    docs, path = table(spark, d, "documents"), _scratch(spark)
    keyed = lambda b: b.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("cache_key"), "text")
    for _ in range(2):
        ingest.ingest(spark, f"{d}/documents.parque[t]", docs.schema, keyed, f"{path}/table", f"{path}/state")
    return ingest.cached(spark, f"{path}/table")


@query(
    f"""with {SQL_PAGES}, k as (select 'd' || doc_id || '_p' || page_no as cache_key, doc_id, page_no, text from page)
    select 1 as version, cache_key, text from k where doc_id % 2 = 0 and text <> ''
    union all select 2, cache_key, case when page_no = 1 then 'new ' || text else text end from k where case when page_no = 1 then true else text <> '' and doc_id % 2 = 0 end
    union all select 3, cache_key, case when page_no = 1 then 'new ' || text else text end from k where case when page_no = 1 then true else text <> '' and doc_id % 2 = 0 end"""
)
def cache_versions(spark, d):
    """Three versions of a cache: pages of every other document, first pages of all put over them, compacted; each read as it was."""
    keyed = pages(table(spark, d, "documents")).withColumn("cache_key", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_p"), F.col("page_no").cast("string")))
    held = CacheTable(spark, f"{_scratch(spark)}/cache", buckets=16)
    held.upsert(keyed.where("doc_id % 2 = 0"))
    held.upsert(keyed.where("page_no = 1").withColumn("text", F.concat(F.lit("new "), "text")))
    held.compact()
    return reduce(DataFrame.unionByName, (held.snapshot(v).select(F.lit(v).alias("version"), "cache_key", "text") for v in (1, 2, 3)))


@query(
    f"""with {SQL_PAGES} select doc_id, page_no, case when doc_id % 3 = 0 then 'old ' || doc_id else text end as text, case when doc_id % 3 <> 0 and text = '' then 'empty result' end as error,
        case when doc_id % 3 = 0 then 'hit' end as cache from page"""
)
def extract_with_cache(spark, d):
    """A run against a cache that holds every third document: hits are taken, the rest is read and held, a second run reads what had no text."""
    keyed = pages(table(spark, d, "documents")).select(
        "doc_id", "page_no", "text", F.lit("hybrid").alias("engine"), F.concat_ws("_", F.lit("d"), F.col("doc_id").cast("string"), F.col("page_no").cast("string")).alias("cache_key")
    )
    held = CacheTable(spark, f"{_scratch(spark)}/cache", buckets=16)
    held.upsert(keyed.where("doc_id % 3 = 0").select("cache_key", F.concat(F.lit("old "), F.col("doc_id").cast("string")).alias("text")))
    read = lambda misses: misses.join(keyed.select("cache_key", "text"), "cache_key").withColumn("error", F.when(F.length("text") == 0, "empty result"))
    return extract.extract_cached(keyed.drop("text"), read, held).select("doc_id", "page_no", "text", "error", "cache")


@query(
    f"""with {SQL_PAGES} select 'doc' || doc_id as stem, 'txt' as ext, string_agg(text || chr(12), '' order by page_no) as text from page group by doc_id"""
)
def document_files_read(spark, d):
    """Each document written as a text file with form feeds and as Markdown under page marks, and the text files read back by a filter on the name."""
    page, path = pages(table(spark, d, "documents")), f"{_scratch(spark)}/files"
    plain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.concat(x.text, F.lit("\f"))), "")
    marked = concatenated(page).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stem"), F.col("md").alias("text"))
    document_files.write(page.groupBy(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stem")).agg(plain.alias("text")), path, "txt")
    document_files.write(marked, path, "md")
    return document_files.read(spark, path).where("ext = 'txt'").select("stem", "ext", "text")


@query(
    f"""with {SQL_PAGES}, i as (select length(text) as n, (doc_id * 7 + page_no) % 40 / 8.0::double as s, (doc_id + page_no) % 50 = 0 as e from page)
    select case when sum((n < 30)::int + e::int) > 0 then 'warn' else 'ok' end as status, round(sum(round_even(s, 1)), 1) as total_time, count(*) as pages, count(*) filter (e) as errors,
        sum((n < 30)::int + e::int)::bigint as issues, sum(n)::bigint as chars from i"""
)
def run_totals(spark, d):
    """Totals of a run over all pages, gathered while its rows are written."""
    id_, page = F.col("doc_id"), F.col("page_no")
    error = F.when((id_ + page) % 50 == 0, "timeout")
    rows = pages(table(spark, d, "documents")).select("doc_id", "page_no", F.length("text").alias("chars"), ((id_ * 7 + page) % 40 / F.lit(8.0)).alias("time"), error.alias("error"), "text")
    rows, seen = totals.observed(rows)
    rows.write.parquet(f"{_scratch(spark)}/rows")
    return totals.told(spark, seen)


def _job_events(events):
    """Events as those of a service's jobs, a job for each user and day."""
    state = F.create_map(*[F.lit(x) for x in ("signup", "submit", "purchase", "done", "error", "failed")])
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.coalesce(F.try_element_at(state, F.col("event_type")), F.lit("poll")).alias("state"), F.col("props").alias("message"), F.when(F.col("value") >= 5, "http://result").alias("url"),
    )


@query(
    """with e as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as job, ts, event_id as seq, event_type as t, props, value from events),
    j as (select job, min(ts) as started, min({'a': ts, 's': seq, 't': t, 'p': props, 'v': value}) filter (t in ('purchase', 'error')) as x from e group by job),
    k as (select *, started + interval 4 hour as until, (select max(ts) from events) - interval 1 minute as now from j)
    select job, case when x.a < until then case when x.t = 'error' or x.v < 5 then 'failed' else 'done' end when until <= now then 'failed' else 'open' end as state,
        case when x.a < until then case when x.t = 'error' then x.p when x.v < 5 then 'done without a result' end when until <= now then 'timeout' end as cause,
        started, case when x.a < until then x.a when until <= now then until end as ended from k"""
)
def job_states_stream(spark, d):
    """Last states of jobs whose events came as a stream, timeouts by timers. All jobs come at once, so state is held by shards."""
    events, path = table(spark, d, "events"), _scratch(spark)
    shards = max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = lambda s: _job_events(s.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]"))
    jobs.follow(spark, read, f"{path}/states", f"{path}/progress", wait=4 * 3600, late="1 minute", shards=shards)
    last = jobs.latest(spark, f"{path}/states")
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    return ingest.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, s"""
)
def event_sessions(spark, d):
    return ingest.event_sessions(table(spark, d, "events"))


def _as_pdf(page):
    """(path, length, content): each document's pages (doc_id, page_no, text) as an uncompressed PDF of UTF-16 codes, its second lines ruled as a table of one row."""
    code = lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj"))
    line = F.split("text", "\n")
    drawn = F.concat(
        F.lit("BT /F1 9 Tf 12 TL 20 700 Td "), F.array_join(F.transform(line, lambda x: F.concat(code(x), F.lit(" T*"))), " "), F.lit(" ET "),
        F.lit("10 10 200 20 re S 100 10 m 100 30 l S BT /F1 9 Tf 15 15 Td "), code(F.col("page_no").cast("string")), F.lit(" 100 0 Td "), code(F.size(line).cast("string")), F.lit(" ET"),
    )
    # The same exchange as the groupBy's, with a count that is not lowered: reading the files is the work, not their bytes.
    dealt = page.repartition(int(page.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    docs = dealt.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", drawn.alias("d")))), lambda x: x.d).alias("drawn"))
    number = lambda i, odd: (10 + 2 * i + odd).cast("string")
    kids = F.array_join(F.transform("drawn", lambda x, i: F.concat(number(i, 0), F.lit(" 0 R"))), " ")
    body = F.transform(
        "drawn",
        lambda x, i: F.concat(
            number(i, 0), F.lit(" 0 obj\n<< /Type /Page /Resources << /Font << /F1 3 0 R >> >> /Contents "), number(i, 1), F.lit(" 0 R >>\nendobj\n"),
            number(i, 1), F.lit(" 0 obj\n<< >>\nstream\n"), x, F.lit("\nendstream\nendobj\n"),
        ),
    )
    head = """%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n3 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>\nendobj
4 0 obj\n<< >>\nstream\n2 beginbfrange <0000> <D7FF> <0000> <E000> <FFFF> <E000> endbfrange\nendstream\nendobj\n2 0 obj\n<< /Type /Pages /Kids ["""
    whole = F.concat(F.lit(head), kids, F.lit("] >>\nendobj\n"), F.array_join(body, ""))
    return docs.select(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.length(whole).cast("long").alias("length"), F.encode(whole, "UTF-8").alias("content"))


@query(
    f"""with {SQL_PAGES} select doc_id, page_no, {sql_strip("regexp_replace(regexp_replace(text || chr(10) || page_no || ' ' || (length(text) - length(replace(text, chr(10), '')) + 1), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')")} as text,
        1 as n_tables, page_no || '|' || (length(text) - length(replace(text, chr(10), '')) + 1) as cells from page"""
)
def pdf_text_layer(spark, d):
    """All documents as PDF files, whole, and their pages read back: text, and tables within ruled lines."""
    read = pdf.pages_of(_as_pdf(pages(table(spark, d, "documents"))))
    cells = F.array_join(F.flatten(F.flatten("tables")), "|")
    return read.select(F.col("stem").cast("long").alias("doc_id"), "page_no", "text", F.size("tables").alias("n_tables"), cells.alias("cells"))
