"""Tables as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import let


def cell_text(cell: Column) -> Column:
    """A cell on one line; null as empty."""
    return F.regexp_replace(F.coalesce(cell, F.lit("")), "\n", "<br>")


def row_key(row: Column) -> Column:
    return F.array_join(F.transform(row, cell_text), " | ")


def first_rows(rows: Column) -> Column:
    """Rows of an array of rows, each key's first only."""
    return let(F.transform(rows, row_key), lambda keys: F.filter(rows, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1))


def deduped(cells: DataFrame) -> DataFrame:
    """(table_id, row_no, key) of the rows that stay, from long (table_id, row_no, col_no, cell)."""
    rows = cells.groupBy("table_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", cell_text(F.col("cell")).alias("c")))), lambda x: x.c), " | ").alias("key"))
    return rows.groupBy("table_id", "key").agg(F.min("row_no").alias("row_no")).select("table_id", "row_no", "key")


def markdown(rows: Column) -> Column:
    """Markdown of an array of rows: the first is the header, others are filled up or cut to its width; a lone row is its joined cells."""
    def made(kept: Column) -> Column:
        wide = F.size(F.get(kept, F.lit(0)))
        full = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), wide - F.size(r)))), F.lit(1), wide)
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(full(r), cell_text), " | "), F.lit(" |\n"))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), wide), "|"), F.lit("|\n"))
        body = F.array_join(F.transform(F.slice(kept, 2, F.greatest(F.lit(0), F.size(kept) - 1)), line), "")
        return F.when(F.size(kept) == 0, "").when(F.size(kept) == 1, row_key(F.get(kept, F.lit(0)))).otherwise(F.concat(line(F.get(kept, F.lit(0))), rule, body))

    return let(first_rows(rows), made)


#: Markers of a document made from its text layer.
STRUCTURED, REFERENCE, TABLES = "<!-- PDFMUX OUTPUT (structured, from text layer) -->\n\n", "\n\n<!-- PYMUPDF + PDFPLUMBER REFERENCE -->\n", "\n\n[TABLES]\n\n"


def text_documents(pages: DataFrame, structured: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, total_tables) from (doc_id, page_no, text, tables): marked pages in order, each with its tables.

    ``structured`` (doc_id, content) goes in front where a document has any.
    """
    shown = F.array_join(F.transform("tables", lambda t: F.concat(markdown(t), F.lit("\n"))), "")
    n = F.coalesce(F.when(F.size("tables") > 0, F.size("tables")), F.lit(0))
    body = F.concat(F.lit("\n\n<!-- PAGE "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), F.coalesce("text", F.lit("")), F.when(n > 0, F.concat(F.lit(TABLES), shown)).otherwise(""))
    each = pages.select("doc_id", "page_no", body.alias("body"), n.alias("n"))
    docs = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "body"))), lambda x: x.body), "").alias("body"), F.sum("n").alias("total_tables"))
    if structured is None:
        return docs.select("doc_id", F.col("body").alias("text"), "total_tables")
    front = F.when(F.length("content") > 0, F.concat(F.lit(STRUCTURED), "content", F.lit(REFERENCE))).otherwise("")
    return docs.join(structured, "doc_id", "left").select("doc_id", F.concat(F.coalesce(front, F.lit("")), "body").alias("text"), "total_tables")
