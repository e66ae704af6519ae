"""Assignment of lines to blocks on dense pages: a join of boxes by a grid.

A row per page, as ``layout.assigned`` has it, compares each line with each
block of its page. Here boxes are cut into cells and only boxes of one cell
meet. Cells have the sizes of the boxes: a block lies in the cells of its own
class, the powers of two that its width and height come to (and at least those
of the page's mean line), so it has four cells at most, and a line is looked
up in the cells of the classes that its page's blocks have. Two boxes that meet in
several cells are compared in one, that of their common part's corner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import OVERLAP, PAGE, assigned, overlap

#: Cells of one class in which a line is looked up; longer ones meet all of that class's blocks on their page.
CELLS = 256


def _power(length: Column, least: Column) -> Column:
    """The exponent of the smallest power of two that holds ``length`` and ``least``."""
    return F.ceil(F.log2(F.greatest(length.cast("double"), least, F.lit(1.0)))).cast("int")


def _span(low: Column, high: Column, power: Column) -> Column:
    """Numbers of the cells between two coordinates."""
    at = lambda c: F.floor(c.cast("double") / F.pow(F.lit(2.0), power))
    return F.sequence(at(low), at(high))


def _cells(box: Column, kx: Column, ky: Column) -> Column:
    xs, ys = _span(box.x0, box.x1, kx), _span(box.y0, box.y1, ky)
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(kx.alias("kx"), ky.alias("ky"), x.alias("cx"), y.alias("cy")))))


def _solid(box: Column) -> Column:
    """Boxes with an area; others overlap nothing."""
    return F.coalesce((box.x1 > box.x0) & (box.y1 > box.y0), F.lit(False))


def candidates(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of one page that share a cell, each once: all columns of ``lines``, then block_idx and r, their overlap.

    Lines that overlap no block do not come. Lines must be told apart by their columns.
    """
    lines = lines.where(_solid(F.col("bbox")))
    mean = lines.groupBy(*PAGE).agg(F.avg(F.col("bbox.x1") - F.col("bbox.x0")).alias("w"), F.avg(F.col("bbox.y1") - F.col("bbox.y0")).alias("h"))
    held = blocks.where(_solid(F.col("bbox"))).join(mean, list(PAGE))
    kx, ky = _power(F.col("bbox.x1") - F.col("bbox.x0"), F.col("w")), _power(F.col("bbox.y1") - F.col("bbox.y0"), F.col("h"))
    held = held.select(*PAGE, "block_idx", F.col("bbox").alias("box"), kx.alias("kx"), ky.alias("ky"))
    edges = F.struct(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
    classes = held.groupBy(*PAGE, "kx", "ky").agg(edges.alias("edge"))
    classes = classes.groupBy(*PAGE).agg(F.collect_list(F.struct("kx", "ky", "edge")).alias("classes"))
    # What of a line lies within the blocks of a class is what is looked up.
    line, edge = F.col("bbox"), F.col("k.edge")
    part = F.struct(
        F.greatest(line.x0, edge.x0.cast("double")).alias("x0"), F.greatest(line.y0, edge.y0.cast("double")).alias("y0"),
        F.least(line.x1, edge.x1.cast("double")).alias("x1"), F.least(line.y1, edge.y1.cast("double")).alias("y1"),
    )
    asked = lines.join(classes, list(PAGE)).select(*lines.columns, F.explode("classes").alias("k")).select(*lines.columns, "k.kx", "k.ky", part.alias("part")).where(_solid(F.col("part")))
    count = reduce(lambda a, b: a * b, ((F.col(f"part.{b}") - F.col(f"part.{a}")) / F.pow(F.lit(2.0), k) + 2 for a, b, k in (("x0", "x1", "kx"), ("y0", "y1", "ky"))))
    few = asked.where(count <= CELLS).select(*lines.columns, F.explode(_cells(F.col("part"), F.col("kx"), F.col("ky"))).alias("cell"))
    cut = held.select(*PAGE, "block_idx", "box", F.explode(_cells(F.col("box"), F.col("kx"), F.col("ky"))).alias("cell"))
    # The corner of the common part lies in one cell.
    corner = lambda low, k: F.floor(F.greatest(F.col(f"bbox.{low}"), F.col(f"box.{low}").cast("double")) / F.pow(F.lit(2.0), k))
    owner = (corner("x0", F.col("cell.kx")) == F.col("cell.cx")) & (corner("y0", F.col("cell.ky")) == F.col("cell.cy"))
    r = overlap(F.col("bbox"), F.col("box")).alias("r")
    met = few.join(cut, [*PAGE, "cell"]).where(owner).select(*lines.columns, "block_idx", r)
    wide = asked.where(count > CELLS).join(held, [*PAGE, "kx", "ky"]).select(*lines.columns, "block_idx", r)
    return met.unionByName(wide).where("r > 0")


def assigned_by_grid(lines: DataFrame, blocks: DataFrame, least: float = OVERLAP) -> DataFrame:
    """What ``layout.assigned`` gives, by a grid.

    Only pages and boxes go through the grid, each box of a page once; what else a
    line has meets its box's result in the end.
    """
    key = [*PAGE, "bbox"]
    best = candidates(lines.select(*key).distinct(), blocks).groupBy(*key).agg(F.max(F.struct("r", (-F.col("block_idx")).alias("i"))).alias("_best"))
    found = best.select(*(F.col(c).alias(f"_{c}") for c in key), "_best")
    # Lines without a box have no result and are not equal to any; so plain equality will do.
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in key))
    out = lines.join(found, same, "left")
    r = F.coalesce("_best.r", F.lit(0.0))
    return out.select(*lines.columns, F.when(r >= least, -F.col("_best.i")).alias("block_idx"), r.alias("overlap"))


def assigned_by_size(lines: DataFrame, blocks: DataFrame, least: float = OVERLAP, pairs: int = 1_000_000) -> DataFrame:
    """``layout.assigned``, for pages of more than ``pairs`` lines times blocks by the grid; the result is the same."""
    counts = lines.groupBy(*PAGE).agg(F.count("*").alias("l")).join(blocks.groupBy(*PAGE).agg(F.count("*").alias("b")), list(PAGE))
    dense = counts.where(F.col("l") * F.col("b") > pairs).select(*PAGE)
    light = assigned(lines.join(dense, list(PAGE), "left_anti"), blocks.join(dense, list(PAGE), "left_anti"), least)
    return light.unionByName(assigned_by_grid(lines.join(dense, list(PAGE), "left_semi"), blocks.join(dense, list(PAGE), "left_semi"), least))
