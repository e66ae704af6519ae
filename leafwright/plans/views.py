"""The SQL surface: canonical relations and operators' results as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leafwright.operators import layout, selection
from leafwright.sources import driver_tables as d


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temporary views over a folder of tables: page, ocr_line, layout_block, detection, line_block, reading_order, attempt."""
    docs = d.table(spark, sf_dir, "documents")
    pages, lines, blocks = d.pages(docs), d.ocr_lines(docs), layout.kept_blocks(d.layout_blocks(docs))
    views = {
        "page": pages, "ocr_line": lines, "layout_block": blocks, "detection": selection.detection(pages), "line_block": layout.assigned(lines, blocks),
        "reading_order": layout.reading_order(blocks, layout.page_widths(blocks, pages)), "attempt": d.attempts(d.table(spark, sf_dir, "events")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
