"""Queries on pages of text: selection, routing, sinks, tables, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators import evaluation, report, selection, tables
from leafwright.sources.driver_tables import SQL_PAGES, document_pages, pages, table

from .registry import query, sql_squeeze, sql_strip


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(_docs(spark, d))


def _marked() -> F.Column:
    """A document's pages as one marked text, in page order."""
    part = F.concat(F.lit("\n\n<!-- PAGE "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), F.col("text"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", part.alias("p")))), lambda x: x.p), "")


MARKED = "string_agg(chr(10) || chr(10) || '<!-- PAGE ' || page_no || ' -->' || chr(10) || chr(10) || text, '' order by page_no)"


@query(
    f"""with {SQL_PAGES}, d as (select doc_id, avg(length({sql_strip("text")}))::double as avg_chars, count(*) as sample_size from page where page_no <= 3 group by 1)
    select doc_id, avg_chars, sample_size, avg_chars < 100 as is_image, case when avg_chars < 100 then 'hybrid' else 'text' end as engine from d"""
)
def detect_route(spark, d):
    found = selection.detection(_pages(spark, d))
    return found.withColumn("engine", selection.engine({}, F.col("is_image")))


@query(
    """select doc_id, case when doc_id % 17 = 0 then 'audit' when doc_id % 5 = 0 then 'hybrid' when doc_id % 3 = 0 then 'glm' when doc_id % 7 = 0 then 'ov' when length(text) < 100 then 'hybrid' else 'text' end as engine
    from documents"""
)
def engine_precedence(spark, d):
    asked = {"audit": F.col("doc_id") % 17 == 0, "hybrid": F.col("doc_id") % 5 == 0, "glm": F.col("doc_id") % 3 == 0, "ov": F.col("doc_id") % 7 == 0}
    return _docs(spark, d).select("doc_id", selection.engine(asked, F.length("text") < 100).alias("engine"))


SPECS = ("1-3", "2, 4-99", "1,1-2,5", "3-1", "0", "x", ",", "1-2-3", "2")


@query(
    f"""with {SQL_PAGES}, t as (select doc_id, max(page_no) as total, {list(SPECS)}[(doc_id % {len(SPECS)} + 1)::int] as spec from page group by 1),
    p as (select doc_id, total, trim(unnest(string_split(spec, ','))) as part from t),
    e as (select doc_id, total, string_split(part, '-') as e from p where part <> ''),
    r as (select doc_id, total, len(e) > 2 as malformed, try_cast(trim(e[1]) as int) as a, case when len(e) = 2 then least(try_cast(trim(e[-1]) as int), total) else try_cast(trim(e[-1]) as int) end as b from e),
    f as (select doc_id, a, b, case when malformed then 'malformed' when a is null or b is null then 'not a number' when a < 1 or a > total or b > total or b < a then 'out of range' end as bad from r),
    g as (select t.doc_id, case when bool_or(f.doc_id is not null) then max(bad) else 'nothing selected' end as fault from t left join f on f.doc_id = t.doc_id group by 1),
    n as (select distinct f.doc_id, unnest(range(a, b + 1)) as page from f join g using (doc_id) where fault is null)
    select g.doc_id, string_agg(page::varchar, ',' order by page) as pages, any_value(fault) as fault from g left join n on n.doc_id = g.doc_id group by 1"""
)
def page_ranges(spark, d):
    spec = F.array(*map(F.lit, SPECS))[(F.col("doc_id") % len(SPECS)).cast("int")]
    totals = document_pages(_docs(spark, d)).groupBy("doc_id").agg(F.max("page_no").alias("total")).withColumn("spec", spec)
    return selection.selected_pages(totals).select("doc_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "fault")


@query(
    f"""with {SQL_PAGES}, s as (select doc_id, page_no from page where (doc_id + page_no) % 4 <> 0),
    i as (select doc_id, page_no, page_no - row_number() over (partition by doc_id order by page_no) as island from s),
    r as (select doc_id, island, min(page_no) as a, max(page_no) as b from i group by 1, 2)
    select doc_id, 'p' || left(string_agg(case when a = b then a::varchar else a || '-' || b end, '_' order by a), 80) as suffix from r group by 1"""
)
def page_suffix_islands(spark, d):
    return selection.suffixes(_pages(spark, d).where((F.col("doc_id") + F.col("page_no")) % 4 != 0))


@query(f"with {SQL_PAGES} select doc_id, string_agg(text || chr(12), '' order by page_no) as dump from page group by 1")
def text_only_dump(spark, d):
    part = F.concat("text", F.lit("\f"))
    return _pages(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", part.alias("p")))), lambda x: x.p), "").alias("dump"))


@query(f"with {SQL_PAGES} select doc_id, {MARKED} as md from page where length({sql_squeeze('text')}) > 0 group by 1")
def page_envelope_md(spark, d):
    return _pages(spark, d).where(~T.is_blank(F.col("text"))).groupBy("doc_id").agg(_marked().alias("md"))


@query(
    """with r as (select doc_id, i::int as row_no, string_split(t, '|') as c from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where contains(t, '|')),
    k as (select doc_id, row_no, array_to_string(list_transform(c, lambda x: x), ' | ') as key from r)
    select doc_id as table_id, min(row_no)::int as row_no, key from k group by 1, 3"""
)
def table_dedupe(spark, d):
    lines = _docs(spark, d).select(F.col("doc_id").alias("table_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "t")).where(F.col("t").contains("|"))
    cells = lines.select("table_id", (F.col("i") + 1).alias("row_no"), F.posexplode(F.split("t", r"\|", -1)).alias("col_no", "cell"))
    return tables.deduped(cells)


@query(
    """with r as (select doc_id, i, string_split(t, '|') as c from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where contains(t, '|')),
    f as (select doc_id, i, c from r qualify row_number() over (partition by doc_id, array_to_string(c, ' | ') order by i) = 1),
    w as (select *, first_value(len(c)) over (partition by doc_id order by i) as w, row_number() over (partition by doc_id order by i) as n, count(*) over (partition by doc_id) as total from f),
    l as (select *, case when total = 1 then array_to_string(c, ' | ') else '| ' || array_to_string(list_transform(range(1, w + 1), lambda k: coalesce(c[k], '')), ' | ') || ' |' || chr(10) end
        || case when n = 1 and total > 1 then '|' || array_to_string(list_transform(range(w), lambda k: '---'), '|') || '|' || chr(10) else '' end as line from w)
    select doc_id, string_agg(line, '' order by i) as md, count(*) as rows from l group by 1"""
)
def table_markdown(spark, d):
    rows = F.expr(r"transform(filter(split(text, '\n', -1), x -> contains(x, '|')), x -> split(x, '\\|', -1))")
    found = _docs(spark, d).select("doc_id", rows.alias("rows")).where(F.size("rows") > 0)
    return found.select("doc_id", tables.markdown(F.col("rows")).alias("md"), F.size(tables.first_rows(F.col("rows"))).cast("long").alias("rows"))


@query(
    f"""with {SQL_PAGES}, c as (select doc_id, page_no, text, string_split(text, chr(10))[1] as a, coalesce(string_split(text, chr(10))[2], '') as b from page),
    p as (select doc_id, page_no, chr(10) || chr(10) || '<!-- PAGE ' || page_no || ' -->' || chr(10) || chr(10) || text || case when contains(a, '|') then chr(10) || chr(10) || '[TABLES]' || chr(10) || chr(10)
        || case when a || ' | x' = b || ' | y' then '' else '| ' || a || ' | x |' || chr(10) || '|---|---|' || chr(10) || '| ' || b || ' | y |' || chr(10) end || chr(10) else '' end as s, contains(a, '|')::int as n from c)
    select doc_id, case when doc_id % 3 = 0 then '<!-- PDFMUX OUTPUT (structured, from text layer) -->' || chr(10) || chr(10) || '# d' || doc_id || chr(10) || chr(10) || '<!-- PYMUPDF + PDFPLUMBER REFERENCE -->' || chr(10) else '' end
        || string_agg(s, '' order by page_no) as text, sum(n)::bigint as total_tables from p group by 1"""
)
def text_path_document(spark, d):
    """The text path's document; a page whose first line has a bar gives a table of its first two lines."""
    lines = F.split("text", "\n", -1)
    a, b = F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    made = F.when(a.contains("|"), F.array(F.array(F.array(a, F.lit("x")), F.array(b, F.lit("y")))))
    structured = _docs(spark, d).where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("# d"), F.col("doc_id").cast("string")).alias("content"))
    return tables.text_documents(_pages(spark, d).withColumn("tables", made), structured)


@query(
    f"""with {SQL_PAGES}, m as (select doc_id, {MARKED} as md from page group by 1)
    select doc_id, round_even(length({sql_squeeze("md")})::double / nullif(length({sql_strip("d.text")}), 0), 3) as coverage, length(md)::bigint as md_chars from m join documents d using (doc_id)"""
)
def coverage_metrics(spark, d):
    docs = _docs(spark, d)
    made = pages(docs).groupBy("doc_id").agg(_marked().alias("md")).join(docs.select("doc_id", "text"), "doc_id")
    return made.select("doc_id", evaluation.coverage(F.col("md"), F.col("text")).alias("coverage"), F.length("md").cast("long").alias("md_chars"))


@query("select doc_id, (length(t) - length(replace(t, '�', '')))::bigint as n from (select doc_id, replace(text, 'é', '�') as t from documents)")
def replacement_count(spark, d):
    return _docs(spark, d).select("doc_id", T.count_of(F.translate("text", "é", "�"), "�").alias("n"))


@query(
    f"""with {SQL_PAGES}, g as (select doc_id, page_no, translate(text, 'éß', '�') as t from page)
    select doc_id, page_no, len(regexp_extract_all(t, '[\\x{{E000}}-\\x{{F8FF}}\\x{{FFFD}}]')) as garbled, translate(t, '�', ' ') as cleaned from g where regexp_matches(t, '[\\x{{E000}}-\\x{{F8FF}}\\x{{FFFD}}]')"""
)
def garble_census(spark, d):
    text = F.translate("text", "éß", "�")
    return _pages(spark, d).select("doc_id", "page_no", T.garbled(text).alias("garbled"), T.cleaned(text).alias("cleaned")).where("garbled > 0")


@query(
    """with t as (select doc_id, case when contains(text, '|') then '|' || replace(text, chr(10), chr(10) || '|') else text end as md from documents)
    select doc_id, len(regexp_extract_all(md, '(?m)^\\|.*\\|'))::bigint as table_rows, len(list_filter(string_split(md, chr(10)), lambda x: starts_with(x, '|') and length(x) > 300))::bigint as long_lines from t"""
)
def md_table_rows(spark, d):
    md = F.when(F.col("text").contains("|"), F.concat(F.lit("|"), F.replace("text", F.lit("\n"), F.lit("\n|")))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", md.alias("md")).select("doc_id", evaluation.table_rows(F.col("md")).alias("table_rows"), evaluation.long_table_lines(F.col("md")).alias("long_lines"))


@query(f"with {SQL_PAGES} select doc_id, count(*) as marks, min({sql_strip('text')}) filter (page_no = 2) as second from page group by 1")
def page_split(spark, d):
    made = _pages(spark, d).groupBy("doc_id").agg(_marked().alias("md"))
    second = evaluation.picked_page(F.col("md"), F.lit(2))
    return made.select("doc_id", evaluation.page_marks(F.col("md")).alias("marks"), F.nullif(second, F.lit("PAGE NOT FOUND")).alias("second"))


@query(f"select doc_id, {sql_strip('n.text')} as section from (select doc_id, text from documents) n")
def section_slice(spark, d):
    md = F.concat(F.lit("front\n<!-- BEGIN -->\n"), "text", F.lit("\n<!-- END -->\nback"))
    return _docs(spark, d).select("doc_id", evaluation.section(md, "<!-- BEGIN -->", "<!-- END -->").alias("section"))


@query(
    f"""with p as (select {sql_squeeze("text")} as p from benchmark), t as (select doc_id as id, {sql_squeeze("text")} as t from documents)
    select id, (select count(*) from p where contains(t, p)) as hits, (select count(*) from p) as phrases from t"""
)
def phrase_hits(spark, d):
    phrases = table(spark, d, "benchmark").select(F.col("text").alias("phrase"))
    return evaluation.phrase_hits(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), phrases)


LABELLED = """case when doc_id % 5 = 0 then 'Contents' || chr(10) || replace(text, '. ', ' ...... 7 ') when doc_id % 5 = 1 then translate(text, 'éè', '∑≤') when doc_id % 5 = 2 then '第 3 章' || chr(10) || text else text end"""
SQL_LABELLED = f"""{SQL_PAGES}, t as (select doc_id, page_no, {LABELLED} as t from page), l as (select doc_id, page_no, list_filter([
    case when regexp_matches(t, '(?m)^\\s*目\\s*录\\s*$') or regexp_matches(t, '(?mi)^Contents\\s*$') then 'toc_head' end,
    case when (length(t) - length(replace(t, '......', ''))) / 6 + len(regexp_extract_all(t, '…')) + len(regexp_extract_all(t, '[^\\s]\\s*\\.{{3,}}\\s*\\d+')) >= 5 then 'toc_entries' end,
    case when len(regexp_extract_all(t, '[{evaluation.MATH}]')) >= 6 then 'math_symbols' end,
    case when regexp_matches(t, '(?m)^\\s*第\\s*[0-9一二三四五六七八九十]+\\s*章') then 'chapter_head' end], lambda x: x is not null) as labels from t)"""


def _labelled(spark, d):
    text = F.expr(LABELLED.replace("chr(10)", "'\\n'"))
    return _pages(spark, d).select("doc_id", "page_no", evaluation.text_labels(text).alias("labels"))


_STARTS = "text, left(text, 1), left(text, 2), left(text, 3), substr(text, 5, 12)"


@query(
    f"""with p as (select {sql_squeeze("x")} as p from (select unnest([{_STARTS}]) as x from benchmark)), t as (select doc_id as id, {sql_squeeze("text")} as t from documents)
    select id, (select count(*) from p where p <> '' and contains(t, p)) as hits, (select count(*) from p where p <> '') as phrases from t"""
)
def phrase_hits_by_gram(spark, d):
    """Whole items, their starts of one to three characters, and parts of them, by the index of rarest grams."""
    phrases = table(spark, d, "benchmark").select(F.explode(F.expr(f"array({_STARTS})")).alias("phrase"))
    return evaluation.phrase_hits(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), phrases, block_bytes=0)


@query(f"with {SQL_LABELLED} select doc_id, page_no, array_to_string(labels, ',') as labels from l")
def page_labels(spark, d):
    return _labelled(spark, d).select("doc_id", "page_no", F.array_join("labels", ",").alias("labels"))


@query(f"with {SQL_LABELLED}, u as (select unnest(labels) as label, doc_id, page_no from l) select * from u qualify row_number() over (partition by label order by doc_id, page_no) <= 2")
def representative_pages(spark, d):
    return evaluation.representatives(_labelled(spark, d).select(F.explode("labels").alias("label"), "doc_id", "page_no"))


@query(
    f"""with {SQL_LABELLED}, u as (select unnest(labels) as label, doc_id, page_no from l), r as (select * from u qualify row_number() over (partition by label order by doc_id, page_no) <= 2)
    select doc_id, page_no, string_agg(distinct label, ',' order by label) as labels from r group by all"""
)
def sample_pages(spark, d):
    found = evaluation.samples(_labelled(spark, d).select(F.explode("labels").alias("label"), "doc_id", "page_no"))
    return found.withColumn("labels", F.array_join("labels", ","))


@query(
    f"""with {SQL_PAGES}, i as (select doc_id, page_no as page, length(text) as n, case when (doc_id + page_no) % 50 = 0 then 'timeout' end as e from page)
    select doc_id, page, 0 as seq, 'page ' || page || ': low content (' || n || ' chars)' as issue from i where n < 30
    union all select doc_id, page, case when n < 30 then 1 else 0 end, 'page ' || page || ': ' || e from i where e is not null"""
)
def low_content_issues(spark, d):
    error = F.when((F.col("doc_id") + F.col("page_no")) % 50 == 0, "timeout")
    return report.issues(_pages(spark, d).select("doc_id", F.col("page_no").alias("page"), F.length("text").alias("chars"), error.alias("error")))


@query(
    f"""with {SQL_PAGES}, i as (select doc_id, page_no as page, length(text) as n, (doc_id * 7 + page_no) % 40 / 8.0::double as s, case when (doc_id + page_no) % 50 = 0 then 'timeout' end as e from page),
    t as (select doc_id, page, s, list_filter([case when n < 30 then 'page ' || page || ': low content (' || n || ' chars)' end, 'page ' || page || ': ' || e], lambda x: x is not null) as x from i)
    select doc_id, case when sum(len(x)) > 0 then 'warn' else 'ok' end as status, round_even(sum(round_even(s, 1)), 1) as total_time, count(*) as pages,
        nullif(string_agg(array_to_string(x, '; '), '; ' order by page) filter (len(x) > 0), '') as issues from t group by 1"""
)
def status_report(spark, d):
    error = F.when((F.col("doc_id") + F.col("page_no")) % 50 == 0, "timeout")
    seconds = (F.col("doc_id") * 7 + F.col("page_no")) % 40 / F.lit(8.0)
    return report.run_report(_pages(spark, d).select("doc_id", F.col("page_no").alias("page"), F.length("text").alias("chars"), seconds.alias("time"), error.alias("error")))


@query("select doc_id, unnest([1, 2, 3]) as page, 'audit' as engine, round_even((doc_id % 100) / 3.0::double, 1) as time, (length(text) // 3)::bigint as chars from documents")
def page_info_batch(spark, d):
    seconds = (F.col("doc_id") % 100).cast("double")
    return report.page_info(_docs(spark, d).select("doc_id", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("pages"), F.lit("audit").alias("engine"), seconds.alias("seconds"), "text"))


@query(
    f"""with {SQL_PAGES}, t as (select doc_id, page_no, case when (doc_id + page_no) % 9 = 0 then '' else text end as out, text from page),
    c as (select doc_id, page_no, out, round_even(length({sql_squeeze("out")})::double / nullif(length({sql_strip("text")}), 0), 3) as coverage from t)
    select doc_id, page_no, coverage, case when doc_id % 31 = 0 then 'encrypted' when length({sql_squeeze("out")}) = 0 then 'empty' when coverage < 0.85 then 'coverage' else 'ok' end as verdict from c"""
)
def extraction_gate(spark, d):
    out = F.when((F.col("doc_id") + F.col("page_no")) % 9 == 0, "").otherwise(F.col("text"))
    covered = _pages(spark, d).select("doc_id", "page_no", out.alias("out"), evaluation.coverage(out, F.col("text")).alias("coverage"))
    return covered.select("doc_id", "page_no", "coverage", evaluation.gate(F.col("out"), F.col("coverage"), F.col("doc_id") % 31 == 0).alias("verdict"))


@query(
    """select doc_id, case when length(t) = 0 then 'empty' when contains(t, '�') then 'garbled' when length(t) * 2 <= n then 'shrunk' else 'accept' end as verdict
    from (select doc_id, length(text) as n, case doc_id % 4 when 0 then '' when 1 then translate(text, 'é', '�') when 2 then left(text, (length(text) // 3)::int) else text end as t from documents)"""
)
def rerun_acceptance(spark, d):
    new = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.translate("text", "é", "�")).when(F.col("doc_id") % 4 == 2, F.left("text", F.floor(F.length("text") / 3).cast("int"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", evaluation.rerun_verdict(F.length("text"), new, T.garbled(new)).alias("verdict"))


@query(
    f"""with {SQL_PAGES}, s as (select doc_id, page_no, (case when contains(text, '|') then 3 else 0 end + case when regexp_matches(text, '[0-9]') then 2 else 0 end + case when length(text) < 100 then 1 else 0 end)::int as priority from page)
    select doc_id, page_no, priority from s where priority > 0 qualify row_number() over (partition by doc_id order by priority desc, page_no) <= 5"""
)
def keyword_triage(spark, d):
    t = F.col("text")
    score = F.when(t.contains("|"), 3).otherwise(0) + F.when(t.rlike("[0-9]"), 2).otherwise(0) + F.when(F.length(t) < 100, 1).otherwise(0)
    found = _pages(spark, d).select("doc_id", "page_no", score.alias("priority")).where("priority > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("priority").desc(), "page_no"))
    return found.withColumn("place", place).where("place <= 5").drop("place")


@query()
def text_similarity(spark, d):
    """Two versions of every page, whole: the second has each third line in capitals and lacks each seventh."""
    second = "array_join(filter(transform(split(text, '\\n'), (x, i) -> struct(if(i % 3 = 2, upper(x), x) as x, i as i)), y -> y.i % 7 <> 6).x, '\\n')"
    both = _pages(spark, d).select("doc_id", "page_no", evaluation.compared(F.col("text"), F.expr(second)).alias("q"))
    return both.select("doc_id", "page_no", "q.chars_a", "q.chars_b", F.round("q.ratio", 6).alias("ratio"), "q.changed_lines")


@query(f"with {SQL_PAGES} select doc_id, string_agg('<!-- PAGE ' || page_no || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_no) as md from page group by 1")
def page_concat(spark, d):
    return evaluation.concatenated(_pages(spark, d))


@query(
    """select doc_id, case when coalesce(text, '') = '' then '' else chr(10) || chr(10) || '<!-- PAGE' ||
        case doc_id % 3 when 0 then ' ' || (doc_id % 10 + 1) else 'S ' || (doc_id % 10 + 1) || '-' || (doc_id % 10 + 1 + doc_id % 3) end || ' -->' || chr(10) || chr(10) || text end as md from documents"""
)
def batch_envelope(spark, d):
    first = F.col("doc_id") % 10 + 1
    return _docs(spark, d).select("doc_id", evaluation.page_envelope(F.sequence(first, first + F.col("doc_id") % 3), F.col("text")).alias("md"))
