"""Queries on lines, blocks, matrices and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwright.operators import boxjoin, evaluation, layout, recognition
from leafwright.sources.driver_tables import PAGE_WIDTH, SQL_BLOCKS, SQL_OCR, ctc_matrices, layout_blocks, ocr_lines, table

from .registry import query


def _lines(spark, d):
    return ocr_lines(table(spark, d, "documents"))


def _blocks(spark, d):
    return layout.kept_blocks(layout_blocks(table(spark, d, "documents")))


def _widths(blocks):
    return blocks.select("doc_id", "page_no").distinct().withColumn("page_w", F.lit(float(PAGE_WIDTH)))


KEPT = f"{SQL_OCR}, {SQL_BLOCKS}, kept as (select * from blocks where score >= 0.3)"
RATIO = f"""{KEPT}, ratio as (select o.doc_id, o.page_no, o.line_id, block_idx,
    greatest(0.0::double, least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(0.0::double, least(o.y1, k.y1) - greatest(o.y0, k.y0)) / greatest(1e-6, (o.x1 - o.x0) * (o.y1 - o.y0)) as r
    from ocr o join kept k using (doc_id, page_no)),
    best as (select * from ratio where r > 0 qualify row_number() over (partition by doc_id, page_no, line_id order by r desc, block_idx) = 1),
    placed as (select o.*, case when r >= 0.7 then block_idx end as block_idx, coalesce(r, 0)::double as r from ocr o left join best using (doc_id, page_no, line_id))"""


@query(f"with {SQL_OCR}, {SQL_BLOCKS} select doc_id, page_no, block_idx, label, score, x0, y0, x1, y1 from blocks where score >= 0.3")
def layout_kept(spark, d):
    return _blocks(spark, d).select("doc_id", "page_no", "block_idx", "label", "score", "bbox.*")


@query(f"with {RATIO} select doc_id, page_no, line_id, block_idx, round(r, 9) as overlap from ratio where r > 0")
def overlap_ratio(spark, d):
    a, b = _lines(spark, d).alias("a"), _blocks(spark, d).alias("b")
    pairs = a.join(b, F.expr("a.doc_id = b.doc_id and a.page_no = b.page_no"))
    return pairs.select("a.doc_id", "a.page_no", "line_id", "block_idx", F.round(layout.overlap(F.col("a.bbox"), F.col("b.bbox")), 9).alias("overlap")).where("overlap > 0")


@query(f"with {RATIO} select doc_id, page_no, line_id, block_idx, round(r, 9) as overlap from placed")
def line_assign(spark, d):
    return layout.assigned(_lines(spark, d), _blocks(spark, d)).select("doc_id", "page_no", "line_id", "block_idx", F.round("overlap", 9).alias("overlap"))


@query(f"with {RATIO} select doc_id, page_no, line_id, block_idx, round(r, 9) as overlap from placed")
def line_assign_grid(spark, d):
    return boxjoin.assigned_by_grid(_lines(spark, d), _blocks(spark, d)).select("doc_id", "page_no", "line_id", "block_idx", F.round("overlap", 9).alias("overlap"))


def _scroll(rows, number, of_page):
    """A document as one long page: its pages stand below each other, and numbers go on."""
    low = F.col("page_no") * 1000
    box = F.col("bbox").withField("y0", F.col("bbox.y0") + low).withField("y1", F.col("bbox.y1") + low)
    return rows.withColumns({"bbox": box, number: (F.col("page_no") * of_page + F.col(number)).cast("int"), "page_no": F.lit(1)})


@query(f"with {RATIO} select doc_id, 1 as page_no, (page_no * 10 + line_id)::int as line_id, (page_no * 8 + block_idx)::int as block_idx, round(r, 9) as overlap from placed")
def line_assign_scroll(spark, d):
    """Whole documents as pages: the long ones go by the grid, the others by rows."""
    lines, blocks = _scroll(_lines(spark, d), "line_id", 10), _scroll(_blocks(spark, d), "block_idx", 8)
    return boxjoin.assigned_by_size(lines, blocks, pairs=2000).select("doc_id", "page_no", "line_id", "block_idx", F.round("overlap", 9).alias("overlap"))


@query(f"with {RATIO} select doc_id, page_no, line_id, text from placed where block_idx is null")
def orphan_lines(spark, d):
    return layout.assigned(_lines(spark, d), _blocks(spark, d)).where("block_idx is null").select("doc_id", "page_no", "line_id", "text")


@query(f"with {RATIO} select doc_id, page_no, count(block_idx) as assigned, count(*) - count(block_idx) as orphans from placed group by 1, 2")
def assign_counts(spark, d):
    return layout.assigned(_lines(spark, d), _blocks(spark, d)).groupBy("doc_id", "page_no").agg(F.count("block_idx").alias("assigned"), F.count_if(F.col("block_idx").isNull()).alias("orphans"))


FULL = """fw as (select *, x1 - x0 >= 0.7 * 1200 as is_full from kept),
    seg as (select a.doc_id, a.page_no, a.block_idx, any_value(a.is_full) as is_full,
        (count(b.block_idx) filter (where b.y0 < a.y0 or (a.is_full and b.y0 = a.y0 and b.block_idx < a.block_idx)) + max(a.is_full::int))::int as segment
        from fw a left join fw b on a.doc_id = b.doc_id and a.page_no = b.page_no and b.is_full group by 1, 2, 3)"""


@query(f"with {KEPT}, {FULL} select * from seg")
def full_width_segments(spark, d):
    blocks = _blocks(spark, d)
    return layout.reading_order(blocks, _widths(blocks)).select("doc_id", "page_no", "block_idx", "is_full", "segment")


# With two columns at most a column is a distinct left edge, which SQL can number.
COLUMN = f"{KEPT}, {FULL}, col as (select doc_id, page_no, block_idx, is_full, segment, x0, y0, case when is_full then -1 else dense_rank() over (partition by doc_id, page_no, segment, is_full order by x0) - 1 end::int as col from seg join kept using (doc_id, page_no, block_idx))"


@query(f'with {COLUMN} select doc_id, page_no, segment, block_idx, col as "column" from col where not is_full')
def column_clusters(spark, d):
    blocks = _blocks(spark, d)
    return layout.reading_order(blocks, _widths(blocks)).where("not is_full").select("doc_id", "page_no", "segment", "block_idx", "column")


POSITION = f"{COLUMN}, pos as (select *, row_number() over (partition by doc_id, page_no order by segment, (not is_full)::int, col, y0, x0, block_idx)::int as position from col)"


@query(f"with {POSITION} select doc_id, page_no, block_idx, position from pos")
def reading_order(spark, d):
    blocks = _blocks(spark, d)
    return layout.reading_order(blocks, _widths(blocks)).select("doc_id", "page_no", "block_idx", "position")


MARK = layout.ORPHANS.replace("'", "''")


RENDERED = f"""with {RATIO}, {POSITION.split("kept as (select * from blocks where score >= 0.3), ", 1)[1]},
    txt as (select doc_id, page_no, block_idx, string_agg(text, chr(10) order by y0, x0, line_id) as t from placed group by 1, 2, 3),
    part as (select p.doc_id, p.page_no, position, case
        when label = 'table' then '<!-- table structure unavailable (bbox=[' || k.x0 || ', ' || k.y0 || ', ' || k.x1 || ', ' || k.y1 || ']) -->' || coalesce(chr(10) || chr(10) || t, '')
        when label = 'figure' then '<!-- figure bbox=[' || k.x0 || ', ' || k.y0 || ', ' || k.x1 || ', ' || k.y1 || '] -->' || coalesce(chr(10) || chr(10) || t, '')
        when label = 'formula' then coalesce('$$' || chr(10) || t || chr(10) || '$$', '<!-- formula bbox=[' || k.x0 || ', ' || k.y0 || ', ' || k.x1 || ', ' || k.y1 || '] -->')
        when label = 'title' then '## ' || t when label = 'header' then '### ' || t else t end as s
        from pos p join kept k using (doc_id, page_no, block_idx) left join txt using (doc_id, page_no, block_idx)
        union all select doc_id, page_no, 999999, '{MARK}' || chr(10) || chr(10) || t from txt where block_idx is null)
    select doc_id, page_no, coalesce(string_agg(s, chr(10) || chr(10) order by position), '') as text, count(*) filter (where position < 999999) as blocks,
        (select count(*) from placed q where q.doc_id = part.doc_id and q.page_no = part.page_no and q.block_idx is null) as orphans from part group by 1, 2"""


@query(RENDERED)
def render_page_md(spark, d):
    blocks = _blocks(spark, d)
    return layout.markdown(_lines(spark, d), blocks, _widths(blocks)).select("doc_id", "page_no", "text", "blocks", "orphans")


@query(
    f"""with {KEPT} select doc_id, page_no, block_idx, n as crop_no, printf('page%04d_crop%03d_%s.png', page_no, n, label) as name
    from (select *, (row_number() over (partition by doc_id order by page_no, block_idx) - 1)::int as n from kept where label in ('table', 'figure', 'formula'))"""
)
def crop_plan(spark, d):
    return layout.crop_plan(_blocks(spark, d))


@query(
    f"""with {KEPT}, e as (select doc_id, 'page 1: no image' as error from documents where doc_id % 13 = 0),
    c as (select doc_id, count(*) as b, count(*) filter (where label in ('table', 'figure', 'formula')) as n from kept group by 1)
    select doc_id, case when error is null then 'ok' else 'error' end as status, coalesce(b, 0)::bigint as total_blocks, coalesce(n, 0)::bigint as total_crops, error as errors, case when error is null then 0 else 1 end as exit_code
    from c full join e using (doc_id)"""
)
def layout_report(spark, d):
    errors = table(spark, d, "documents").where("doc_id % 13 = 0").select("doc_id", F.lit("page 1: no image").alias("error"))
    return layout.layout_report(_blocks(spark, d), errors)


@query(
    """select p_partkey, case when k < 2 then trunc(a)::int when k = 2 then trunc(least(a, b))::int end as x0, case when k < 2 then trunc(b)::int when k = 2 then trunc(least(a, b))::int end as y0,
        case when k < 2 then trunc(a + 9.7)::int when k = 2 then trunc(greatest(a, b) + 3.5)::int end as x1, case when k < 2 then trunc(b + 9.7)::int when k = 2 then trunc(greatest(a, b) + 3.5)::int end as y1
    from (select p_partkey, p_partkey % 4 as k, (p_partkey % 91 - 40.9)::double as a, (p_partkey % 37 - 11.3)::double as b from part)"""
)
def box_normalise(spark, d):
    a, b = (F.col("p_partkey") % 91 - 40.9).cast("double"), (F.col("p_partkey") % 37 - 11.3).cast("double")
    k = F.col("p_partkey") % 4
    four = F.when(k < 2, F.array(a, b, a + 9.7, b + 9.7)).otherwise(F.array(a))
    low, high = F.least(a, b), F.greatest(a, b) + 3.5
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    poly = F.when(k == 2, F.array(point(low, low), point(high, low), point(high, high), point(low, high))).otherwise(F.array(point(low, low)))
    return table(spark, d, "part").select("p_partkey", layout.int_box(four, poly).alias("q")).select("p_partkey", "q.x0", "q.y0", "q.x1", "q.y1")


CTC = """step as (select vec_id as line_id, t, list_position(v, list_max(v)) - 1 as k, list_max(v)::double as p from (select vec_id, t, embedding[t * 8 + 1:t * 8 + 8] as v from embeddings, range(8) r(t))),
    seen as (select *, lag(k) over (partition by line_id order by t) as before from step),
    keep as (select * from seen where k <> 0 and k is distinct from before),
    ids as (select distinct line_id from step)"""


def _ctc(spark, d):
    chars = F.array(*map(F.lit, recognition.dictionary(list("abcdefg"))[:8]))
    return ctc_matrices(table(spark, d, "embeddings")).select("line_id", recognition.ctc(F.col("matrix"), chars).alias("q"))


@query(f"with {CTC} select i.line_id, coalesce(string_agg(substr(' abcdefg', k::int + 1, 1), '' order by t), '') as text, count(k)::int as kept from ids i left join keep k on k.line_id = i.line_id group by 1")
def ctc_decode(spark, d):
    return _ctc(spark, d).select("line_id", "q.text", "q.kept")


@query(f"with {CTC} select i.line_id, round(coalesce(avg(p), 0), 6) as conf from ids i left join keep k on k.line_id = i.line_id group by 1")
def ctc_confidence(spark, d):
    return _ctc(spark, d).select("line_id", F.round("q.conf", 6).alias("conf"))


@query(
    """with s as (select p_partkey, (p_partkey * 37 % 5200 + 20)::double as h, (p_partkey * 53 % 4700 + 20)::double as w from part),
    g as (select *, case when least(h, w) < 736 then 736.0::double / least(h, w) else 1 end as r from s), f as (select p_partkey, floor(h * r) as h, floor(w * r) as w from g),
    c as (select *, case when greatest(h, w) > 4000 then 4000.0::double / greatest(h, w) else 1 end as r from f)
    select p_partkey, greatest(round_even(floor(h * r) / 32.0::double, 0)::int * 32, 32) as h, greatest(round_even(floor(w * r) / 32.0::double, 0)::int * 32, 32) as w from c"""
)
def resize_plan(spark, d):
    h, w = (F.col("p_partkey") * 37 % 5200 + 20).cast("double"), (F.col("p_partkey") * 53 % 4700 + 20).cast("double")
    return table(spark, d, "part").select("p_partkey", recognition.detector_size(h, w).alias("q")).select("p_partkey", "q.h", "q.w")


@query(
    """with s as (select p_partkey, (p_partkey * 7 % 90 + 8)::double as h, (p_partkey * 131 % 7000 + 8)::double as w from part),
    r as (select *, floor(48 * greatest(320 / 48.0::double, w / h))::int as width, ceil(48.0::double * w / h)::int as need from s)
    select p_partkey, case when width > 3200 then 3200 else width end as width, case when width > 3200 then 3200 else least(width, need) end as resized from r"""
)
def rec_width_plan(spark, d):
    h, w = (F.col("p_partkey") * 7 % 90 + 8).cast("double"), (F.col("p_partkey") * 131 % 7000 + 8).cast("double")
    return table(spark, d, "part").select("p_partkey", recognition.recogniser_width(h, w).alias("q")).select("p_partkey", "q.width", "q.resized")


@query(
    """select p_partkey, case p_partkey % 4 when 1 then y when 2 then 199 - x when 3 then 199 - y else x end as x, case p_partkey % 4 when 1 then 99 - x when 2 then 99 - y when 3 then x else y end as y
    from (select p_partkey, p_partkey % 50 as x, p_partkey % 70 as y from part)"""
)
def rotation_map_back(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", recognition.turned_back(k % 50, k % 70, k % 4, F.lit(100), F.lit(200)).alias("q")).select("p_partkey", "q.x", "q.y")


@query(
    """with r as (select p_partkey, t, (case when (p_partkey * 7 + t * 3) % 5 < 2 then (p_partkey + t) % 9 else 0 end)::bigint as found from part, range(4) x(t))
    select p_partkey as image, coalesce(min(t) filter (where found > 0), 0)::int as turn, coalesce(arg_min(found, t) filter (where found > 0), 0)::bigint as found from r group by 1"""
)
def best_rotation(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    found = F.when((F.col("image") * 7 + F.col("turn") * 3) % 5 < 2, (F.col("image") + F.col("turn")) % 9).otherwise(0)
    return recognition.best_turn(rows.withColumn("found", found))


@query(
    f"""with {SQL_OCR} select doc_id, page_no, string_agg(text, chr(10) order by floor(y0 / 20), x0, line_id) as text, round_even(round(avg(conf), 9), 2) as mean_conf, round_even(min(conf), 2) as min_conf, count(*) as lines_kept
    from ocr where conf >= 0.5 group by 1, 2"""
)
def ocr_page_text(spark, d):
    return recognition.page_text(recognition.confident(_lines(spark, d)))


@query(f"with {SQL_OCR} select doc_id, page_no, line_id, row_number() over (partition by doc_id, page_no order by floor(y0 / 20), x0, line_id)::int as place from ocr")
def line_order(spark, d):
    from pyspark.sql.window import Window

    keys = recognition.line_order(F.col("bbox.x0"), F.col("bbox.y0"))
    return _lines(spark, d).select("doc_id", "page_no", "line_id", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(*keys, "line_id")).alias("place"))


@query(
    """select x.vec_id as a, y.vec_id as b, round(list_sum(list_transform(range(1, 65), lambda i: abs(x.embedding[i]::double - y.embedding[i]::double))) / 64, 4) as distance
    from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_sum(list_transform(range(1, 65), lambda i: abs(x.embedding[i]::double - y.embedding[i]::double))) / 64 < 0.125"""
)
def vector_mad_pairs(spark, d):
    return evaluation.near_vectors(table(spark, d, "embeddings"), 0.125).select("a", "b", F.round("distance", 4).alias("distance"))


@query(f"with {KEPT} select label, count(*) as blocks, count(*) filter (where score < 0.5) as weak from kept group by 1")
def block_census(spark, d):
    return _blocks(spark, d).groupBy("label").agg(F.count("*").alias("blocks"), F.count_if(F.col("score") < 0.5).alias("weak"))


@query(
    """with b as (select page_id, k, ['header', 'title', 'display_formula', 'formula_number', 'text', 'text'][k + 1] as label, case when k = 4 and page_id % 3 = 0 then '  ' else ' ' || url || k || ' ' end as content,
        case when k = 5 then '' else 'bbox=[' || k || ', ' || (2 * k) || ', ' || (k + 9) || ', ' || (page_id % 50) || ']' end as box from pages, range(6) r(k)),
    p as (select page_id, k, case label when 'header' then '<!-- ' || box || ' -->' || chr(10) || '### ' || trim(content) when 'title' then '<!-- ' || box || ' -->' || chr(10) || '## ' || trim(content)
        when 'display_formula' then '$$' || trim(content) || '$$ <!-- ' || box || ' -->' when 'formula_number' then '(' || trim(content) || ') <!-- ' || box || ' -->' else trim(content) || ' <!-- ' || box || ' -->' end as s
        from b where trim(content) <> '')
    select page_id as doc_id, 1 as page_no, string_agg(s, chr(10) || chr(10) order by k) as text from p group by 1"""
)
def vl_render(spark, d):
    k = F.col("block_idx")
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), "url", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("block_idx"))
    label = F.get(F.array(*map(F.lit, ("header", "title", "display_formula", "formula_number", "text", "text"))), k)
    content = F.when((k == 4) & (F.col("doc_id") % 3 == 0), "  ").otherwise(F.concat(F.lit(" "), "url", k.cast("string"), F.lit(" ")))
    box = F.when(k == 5, F.array().cast("array<int>")).otherwise(F.array(k, 2 * k, k + 9, (F.col("doc_id") % 50).cast("int")))
    return layout.vl_markdown(rows.select("doc_id", "page_no", "block_idx", label.alias("label"), content.alias("content"), box.alias("bbox")))


@query(
    """select p_partkey, (case when k = 0 then 'd' || p_partkey || '_output/d' || p_partkey || '_p1-3.md' when k = 1 then 'd' || p_partkey || '_output/d' || p_partkey || '.txt' else 'd' || p_partkey || '_output/d' || p_partkey || '_p2.html' end) as path
    from (select p_partkey, p_partkey % 3 as k from part)"""
)
def output_names(spark, d):
    k = F.col("p_partkey") % 3
    suffix = F.when(k == 0, "p1-3").when(k == 1, "").otherwise("p2")
    extension = F.when(k == 0, "md").when(k == 1, "txt").otherwise("html")
    return table(spark, d, "part").select("p_partkey", layout.output_path(F.concat(F.lit("d"), F.col("p_partkey").cast("string")), suffix, extension).alias("path"))


@query(
    f"""with {SQL_OCR}, p as (select doc_id, page_no, string_agg(text, chr(10) order by line_id) as text from ocr group by 1, 2)
    select doc_id, page_no, text, null::varchar as error, case when text = '' then 3 else 1 end::int as tries from p"""
)
def recognise_double(spark, d):
    """The engine boundary with the test double, which decodes bytes and is no recogniser: a page's "image" is its lines."""
    lines = F.array_sort(F.collect_list(F.struct("line_id", "text")))
    images = _lines(spark, d).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(lines, lambda x: x.text), "\n").cast("binary").alias("image"))
    return recognition.recognise(images, "double")


@query(f"with {KEPT} select doc_id, page_no, max(x1)::double as page_w from kept group by 1, 2")
def page_width(spark, d):
    """Pages whose image tells no width are as wide as their furthest block."""
    return layout.page_widths(_blocks(spark, d))


@query(
    """select page_id as doc_id, 1::int as page_no from pages where 100 + page_id % 40 > 80 and page_id % 3 <> 0 and page_id % 5 <> 0"""
)
def two_column_pages(spark, d):
    """Words set in two columns, in one, or across the gap, from page ids."""
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.explode(F.sequence(F.lit(0), F.lit(199) + (k % 40).cast("int"))).alias("i"))
    left = (F.col("i") * 7 % 300).cast("double") + 60
    x0 = F.when(F.col("doc_id") % 3 == 0, left).when(F.col("i") % 2 == 0, left).otherwise(left + 600)
    x0 = F.when((F.col("doc_id") % 5 == 0) & (F.col("i") % 10 == 0), F.lit(600.0)).otherwise(x0)
    return evaluation.two_column(rows.select("doc_id", "page_no", x0.alias("x0"), F.lit(float(PAGE_WIDTH)).alias("page_w")))


@query("select page_id as doc_id, 1::int as page_no from pages where page_id % 8 >= 4")
def table_line_pages(spark, d):
    """Strokes from page ids: some long and level, the others short or slanting."""
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    level = F.col("i") < F.col("doc_id") % 8
    y0 = (F.col("i") * 20).cast("double")
    x1 = F.when(level, 800.0).when(F.col("i") % 2 == 0, 150.0).otherwise(900.0)
    y1 = F.when(level | (F.col("i") % 2 == 0), y0 + 0.5).otherwise(y0 + 40)
    return evaluation.ruled(rows.select("doc_id", "page_no", F.lit(0.0).alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(float(PAGE_WIDTH)).alias("page_w")))
