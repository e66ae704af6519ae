"""Boxes, line-to-block assignment, reading order and Markdown.

Everything is per page. A page's lines and its blocks each become one array by
one shuffle on the page; matching, ordering and rendering are then expressions
on that row, so no plan here shuffles a line or a block twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")
OVERLAP = 0.7  # share of a line within a block from which it belongs to it
FULL_WIDTH = 0.7  # share of the page's width from which a block spans it
BLOCKS = "array<struct<block_idx: int, label: string, bbox: struct<x0: int, y0: int, x1: int, y1: int>>>"
#: Labels that are cropped, shown as figures, or headings.
CROPPED = ("table", "figure", "formula", "image", "chart", "seal", "stamp", "figure_caption", "table_caption")
FIGURES = ("figure", "image", "chart", "seal", "stamp")
HEADINGS = {"doc_title": "#", "title": "##", "header": "###"}


def polygon_box(poly: Column) -> Column:
    """Bounding box of an array of points; null if there is none."""
    xs, ys = F.transform(poly, lambda p: p.x), F.transform(poly, lambda p: p.y)
    return F.when(F.size(poly) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def int_box(coordinate: Column, polygon: Column) -> Column:
    """Four numbers cut to integers; else a polygon of four points or more, bounded; else null."""
    direct = F.struct(*(F.get(coordinate, k).cast("int").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))
    bound = polygon_box(polygon)
    return F.when(F.size(coordinate) == 4, direct).when(F.size(polygon) >= 4, F.struct(*(bound[n].cast("int").alias(n) for n in ("x0", "y0", "x1", "y1"))))


def kept_blocks(blocks: DataFrame, min_score: float = 0.3) -> DataFrame:
    return blocks.where((F.col("score") >= min_score) & F.col("bbox").isNotNull())


def overlap(line: Column, block: Column) -> Column:
    """Share of the line's area within the block; 0 if either has no box."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(line[b], block[b].cast("double")) - F.greatest(line[a], block[a].cast("double")))
    area = F.greatest(F.lit(1e-6), (line.x1 - line.x0) * (line.y1 - line.y0))
    return F.coalesce(F.when(line.isNotNull() & block.isNotNull(), side("x0", "x1") * side("y0", "y1") / area), F.lit(0.0))


def _blocks_by_page(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_idx", "label", "bbox"))).alias("blocks"))


def _best(line: Column, blocks: Column) -> Column:
    """struct(i, r): the block of the largest overlap; of equal ones the first, so the lowest index; none at 0."""
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("r"))

    def step(best: Column, block: Column) -> Column:
        r = overlap(line.bbox, block.bbox)
        return F.when(r > best.r, F.struct(block.block_idx.alias("i"), r.alias("r"))).otherwise(best)

    return F.when(line.bbox.isNotNull(), F.aggregate(F.coalesce(blocks, F.array().cast(BLOCKS)), start, step)).otherwise(start)


def assigned(lines: DataFrame, blocks: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Each line with block_idx (null: an orphan) and overlap, that of its best block; of equal ones the lowest index wins."""
    held = lines.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in lines.columns if c not in PAGE])).alias("lines"))
    rows = held.join(_blocks_by_page(blocks), list(PAGE), "left")
    matched = F.transform("lines", lambda x: F.struct(x.alias("x"), _best(x, F.col("blocks")).alias("m")))
    out = rows.select(*PAGE, F.explode(matched).alias("q")).select(*PAGE, "q.x.*", "q.m")
    return out.select(*lines.columns, F.when(F.col("m.r") >= least, F.col("m.i")).alias("block_idx"), F.col("m.r").alias("overlap"))


def page_widths(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page, page_w): the image's width, else the furthest block edge, else 1."""
    edge = blocks.groupBy(*PAGE).agg(F.max("bbox.x1").cast("double").alias("edge"))
    if pages is None:
        return edge.select(*PAGE, F.coalesce("edge", F.lit(1.0)).alias("page_w"))
    return pages.select(*PAGE, "page_w").join(edge, list(PAGE), "left").select(*PAGE, F.coalesce("page_w", "edge", F.lit(1.0)).alias("page_w"))


#: Columns of one segment by a fold over its blocks, left to right: a block joins the first column that covers more than half of it.
_FITS = "least(b.bbox.x1, {c}.x1) - greatest(b.bbox.x0, {c}.x0) > 0.5D * greatest(1, b.bbox.x1 - b.bbox.x0)"
_MEMBER = "struct(b.bbox.y0 as y, b.bbox.x0 as x, b.block_idx as i)"
_FOLD = f"""reduce(
    array_sort({{blocks}}, (p, q) -> case when p.bbox.x0 < q.bbox.x0 then -1 when p.bbox.x0 > q.bbox.x0 then 1 else p.block_idx - q.block_idx end),
    cast(array() as array<struct<x0: int, x1: int, m: array<struct<y: int, x: int, i: int>>>>),
    (cols, b) -> if(
        exists(cols, c -> {_FITS.format(c="c")}),
        transform(cols, (c, k) -> if(
            k = array_position(transform(cols, d -> {_FITS.format(c="d")}), true) - 1,
            struct(least(c.x0, b.bbox.x0) as x0, greatest(c.x1, b.bbox.x1) as x1, concat(c.m, array({_MEMBER})) as m), c)),
        concat(cols, array(struct(b.bbox.x0 as x0, b.bbox.x1 as x1, array({_MEMBER}) as m)))))"""


def placed(blocks: DataFrame, widths: DataFrame) -> DataFrame:
    """(page, blocks, ordered): a page's blocks and their reading order, entries (segment, is_full, column, i).

    A block of full width stands before its segment, which is how many of them
    start strictly above a block; within a segment columns go left to right (of
    equal left edges in the order in which they were opened), and a column top
    to bottom.
    """
    rows = _blocks_by_page(blocks).join(widths, list(PAGE))
    wide = f"b.bbox.x1 - b.bbox.x0 >= {FULL_WIDTH}D * page_w"
    rows = rows.withColumn("tops", F.expr(f"array_sort(transform(filter(blocks, b -> {wide}), b -> struct(b.bbox.y0 as y, b.block_idx as i)))"))
    rows = rows.withColumn("rest", F.expr(f"transform(filter(blocks, b -> not ({wide})), b -> struct(size(filter(tops, t -> t.y < b.bbox.y0)) as s, b.block_idx as block_idx, b.bbox as bbox))"))
    rows = rows.withColumn("cols", F.expr(f"transform(sequence(0, size(tops)), s -> {_FOLD.format(blocks='filter(rest, r -> r.s = s)')})"))
    inner = """flatten(transform(array_sort(transform(c, (q, k) -> struct(q.x0 as x0, k as k, q.m as m))), (q, k) ->
        transform(array_sort(q.m), z -> struct(s as segment, false as is_full, k as column, z.i as i))))"""
    head = "if(s = 0, array(), array(struct(s as segment, true as is_full, -1 as column, get(tops, s - 1).i as i)))"
    return rows.select(*PAGE, "blocks", F.expr(f"flatten(transform(cols, (c, s) -> concat({head}, {inner})))").alias("ordered"))


def reading_order(blocks: DataFrame, widths: DataFrame) -> DataFrame:
    """(page, block_idx, label, bbox, segment, is_full, column, position): position is 1-based on the page."""
    rows = placed(blocks, widths).select(*PAGE, "blocks", F.posexplode("ordered").alias("p", "o"))
    block = F.get(F.filter("blocks", lambda b: b.block_idx == F.col("o.i")), F.lit(0))
    return rows.select(*PAGE, block.alias("b"), "o", "p").select(*PAGE, "b.*", "o.segment", "o.is_full", "o.column", (F.col("p") + 1).alias("position"))


def lines_text(lines: Column) -> Column:
    """Lines by (y, x), joined by newlines; a line without a box counts as at the origin."""
    key = lambda v: F.struct(F.coalesce(v.bbox.y0, F.lit(0.0)).alias("y"), F.coalesce(v.bbox.x0, F.lit(0.0)).alias("x"), v.line_id.alias("n"), v.text.alias("t"))
    return F.array_join(F.transform(F.array_sort(F.transform(lines, key)), lambda v: v.t), "\n")


def _lines_by_page(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.collect_list(F.struct("line_id", "text", "bbox")).alias("lines"))


def page_text(lines: DataFrame) -> DataFrame:
    """(page, text): all of a page's lines by (y, x)."""
    return _lines_by_page(lines).select(*PAGE, lines_text(F.col("lines")).alias("text"))


#: Fixed value: the marker in front of lines that belong to no block.
ORPHANS = "<!-- orphan-lines: 未达归块阈值，按 (y,x) 附于末尾 -->"


def box_text(bbox: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *(bbox[n].cast("string") for n in ("x0", "y0", "x1", "y1"))), F.lit("]"))


def block_parts(label: Column, bbox: Column, text: Column) -> Column:
    """The parts that a block gives to its page's Markdown."""
    has, note = F.coalesce(F.length(text), F.lit(0)) > 0, lambda what: F.concat(what, F.lit("bbox="), box_text(bbox))
    lone = lambda c: F.when(has, F.array(c)).otherwise(F.array().cast("array<string>"))
    both = lambda c: F.when(has, F.array(c, text)).otherwise(F.array(c))
    head = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    return (
        F.when(label == "table", both(F.concat(F.lit("<!-- table structure unavailable ("), note(F.lit("")), F.lit(") -->"))))
        .when(label.isin(*FIGURES), both(F.concat(F.lit("<!-- "), note(F.concat(label, F.lit(" "))), F.lit(" -->"))))
        .when(label == "formula", F.array(F.when(has, F.concat(F.lit("$$\n"), text, F.lit("\n$$"))).otherwise(F.concat(F.lit("<!-- "), note(F.lit("formula ")), F.lit(" -->")))))
        .when(label.isin(*HEADINGS), lone(F.concat_ws(" ", F.try_element_at(head, label), text)))
        .otherwise(lone(text))
    )


def markdown(lines: DataFrame, blocks: DataFrame, widths: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(page, text, blocks, orphans): the page's Markdown by reading order, orphans at the end."""
    rows = _lines_by_page(lines).join(placed(blocks, widths), list(PAGE), "full_outer")
    matched = F.transform(F.coalesce("lines", F.array().cast("array<struct<line_id: int, text: string, bbox: struct<x0: double, y0: double, x1: double, y1: double>>>")), lambda x: F.struct(x.alias("x"), _best(x, F.col("blocks")).alias("m")))
    rows = rows.withColumn("got", F.transform(matched, lambda q: F.struct(F.when(q.m.r >= least, q.m.i).alias("i"), q.x.alias("x"))))
    rows = rows.withColumn("lost", F.transform(F.filter("got", lambda g: g.i.isNull()), lambda g: g.x))

    def parts(entry: Column) -> Column:
        block = F.get(F.filter("blocks", lambda b: b.block_idx == entry.i), F.lit(0))
        return block_parts(block.label, block.bbox, lines_text(F.transform(F.filter("got", lambda g: g.i == entry.i), lambda g: g.x)))

    body = F.coalesce(F.flatten(F.transform("ordered", parts)), F.array().cast("array<string>"))
    tail = F.when(F.size("lost") > 0, F.array(F.lit(ORPHANS), lines_text(F.col("lost")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.filter(F.concat(body, tail), lambda p: ~F.regexp_like(p, F.lit(r"^(?U)\s*$"))), "\n\n")
    return rows.select(*PAGE, text.alias("text"), F.coalesce(F.size("ordered"), F.lit(0)).cast("long").alias("blocks"), F.size("lost").cast("long").alias("orphans"))


def vl_markdown(blocks: DataFrame, keep_blank: bool = False) -> DataFrame:
    """(page, text): blocks of a vision model as Markdown, each behind a comment of its box."""
    from leafwright.functions.text import is_blank, strip

    body = strip(F.coalesce("content", F.lit("")))
    box = F.when(F.size("bbox") > 0, F.concat(F.lit("bbox=["), F.array_join(F.transform("bbox", lambda x: x.cast("string")), ", "), F.lit("]"))).otherwise("")
    note = F.concat(F.lit("<!-- "), box, F.lit(" -->"))
    shown = (
        F.when(F.col("label") == "header", F.concat(note, F.lit("\n### "), body))
        .when(F.col("label") == "title", F.concat(note, F.lit("\n## "), body))
        .when(F.col("label") == "display_formula", F.concat(F.lit("$$"), body, F.lit("$$ "), note))
        .when(F.col("label") == "formula_number", F.concat(F.lit("("), body, F.lit(") "), note))
        .otherwise(F.concat(body, F.lit(" "), note))
    )
    rows = blocks if keep_blank else blocks.where(~is_blank(F.col("content")))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", shown.alias("p")))), lambda x: x.p), "\n\n").alias("text"))


def crop_plan(blocks: DataFrame, cropped: Column | None = None) -> DataFrame:
    """(doc_id, page_no, block_idx, crop_no, name): crops numbered through the document; those that failed take no number."""
    wanted = blocks.where(F.col("label").isin(*CROPPED) if cropped is None else cropped)
    numbered = wanted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "block_idx", "label"))).alias("all"))
    rows = numbered.select("doc_id", F.posexplode("all").alias("crop_no", "x"))
    return rows.select("doc_id", "x.page_no", "x.block_idx", "crop_no", F.format_string("page%04d_crop%03d_%s.png", "x.page_no", "crop_no", "x.label").alias("name"))


def output_path(stem: Column, suffix: Column, extension: Column) -> Column:
    """``stem_output/stem[_suffix].extension``."""
    return F.concat(stem, F.lit("_output/"), F.concat_ws("_", stem, F.nullif(suffix, F.lit(""))), F.lit("."), extension)


def layout_report(blocks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(doc_id, status, total_blocks, total_crops, errors, exit_code)."""
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks"), F.count_if(F.col("label").isin(*CROPPED)).alias("total_crops"))
    if errors is not None:
        counts = counts.join(errors.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors")), "doc_id", "full_outer")
    else:
        counts = counts.withColumn("errors", F.lit(None).cast("string"))
    ok = F.col("errors").isNull()
    return counts.select(
        "doc_id", F.when(ok, "ok").otherwise("error").alias("status"), F.coalesce("total_blocks", F.lit(0)).cast("long").alias("total_blocks"),
        F.coalesce("total_crops", F.lit(0)).cast("long").alias("total_crops"), "errors", F.when(ok, 0).otherwise(1).alias("exit_code"),
    )
