"""Recognition: resize plans, CTC decoding, box arithmetic and the engine boundary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import let

#: Defaults of the detector and the recogniser.
SHORT_SIDE, LONG_SIDE, STEP = 736, 4000, 32
HEIGHT, BASE_WIDTH, WIDEST = 48, 320, 3200
TRIES = 3


def detector_size(h: Column, w: Column) -> Column:
    """struct(h, w): short sides grown to 736, long ones then cut to 4000, both rounded half-even to multiples of 32."""
    short = F.least(h, w)
    grow = F.when(short < SHORT_SIDE, F.lit(float(SHORT_SIDE)) / short).otherwise(1.0)
    h1, w1 = F.floor(h * grow), F.floor(w * grow)
    most = F.greatest(h1, w1)
    cut = F.when(most > LONG_SIDE, F.lit(float(LONG_SIDE)) / most).otherwise(1.0)
    side = lambda x: F.greatest(F.bround(F.floor(x * cut) / F.lit(float(STEP)), 0).cast("int") * STEP, F.lit(STEP))
    return F.struct(side(h1).alias("h"), side(w1).alias("w"))


def recogniser_width(h: Column, w: Column) -> Column:
    """struct(width, resized): the batch width and what a crop is scaled to; both 3200 where the width would be more."""
    ratio = F.greatest(F.lit(BASE_WIDTH / HEIGHT), w / h)
    width = F.floor(HEIGHT * ratio).cast("int")
    need = F.ceil(F.lit(float(HEIGHT)) * w / h).cast("int")
    over = width > WIDEST
    return F.struct(F.when(over, WIDEST).otherwise(width).alias("width"), F.when(over, WIDEST).otherwise(F.least(width, need)).alias("resized"))


def ctc(matrix: Column, dictionary: Column, offset: int = 0, trim: int = 0) -> Column:
    """struct(text, conf) of greedy decoding: the first best class of each step; blanks and repeats of the step before are dropped.

    Classes without an entry in the dictionary are dropped too, after that test.
    """
    best = lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).cast("int").alias("k"), F.array_max(r).cast("double").alias("p"))
    known = lambda s: (s.k + offset >= 0) & (s.k + offset < F.size(dictionary) - trim)

    def kept(steps: Column) -> Column:
        return F.filter(F.filter(steps, lambda s, i: (s.k != 0) & (F.coalesce(F.get(steps, i - 1).k, F.lit(-1)) != s.k)), known)

    def decoded(steps: Column) -> Column:
        text = F.array_join(F.transform(steps, lambda s: F.get(dictionary, s.k + offset)), "")
        total = F.aggregate(steps, F.lit(0.0), lambda t, s: t + s.p)
        return F.struct(text.alias("text"), F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(0.0).alias("conf"), F.size(steps).alias("kept"))

    return let(let(F.transform(matrix, best), kept), decoded)


def dictionary(lines: list[str]) -> list[str]:
    """Classes of a character file: blank first, then its entries that are not empty, then a space."""
    return ["blank", *(line for line in lines if line), " "]


def turned_back(x: Column, y: Column, turns: Column, h: Column, w: Column) -> Column:
    """A point of an image turned by quarter turns, in the image as it was (h x w)."""
    return (
        F.when(turns == 1, F.struct(y.alias("x"), (h - 1 - x).alias("y")))
        .when(turns == 2, F.struct((w - 1 - x).alias("x"), (h - 1 - y).alias("y")))
        .when(turns == 3, F.struct((w - 1 - y).alias("x"), x.alias("y")))
        .otherwise(F.struct(x.alias("x"), y.alias("y")))
    )


def best_turn(results: DataFrame) -> DataFrame:
    """(image, turn, found) from (image, turn, found): turns are tried in order up to the first that finds anything."""
    return results.groupBy("image").agg(
        F.coalesce(F.min(F.when(F.col("found") > 0, F.col("turn"))), F.lit(0)).alias("turn"), F.coalesce(F.min_by("found", F.when(F.col("found") > 0, F.col("turn"))), F.lit(0)).alias("found")
    )


def line_order(x: Column, y: Column) -> list[Column]:
    """Sort keys of lines: bands of 20 pixels, then left to right."""
    return [F.floor(y / 20), x]


def confident(lines: DataFrame, least: float = 0.5) -> DataFrame:
    return lines.where(F.col("conf") >= least)


def page_text(lines: DataFrame) -> DataFrame:
    """(page, text, mean_conf, min_conf, lines_kept) of lines in reading order; confidences to two places, half to even."""
    from leafwright.functions.text import cleaned

    key = F.struct(F.floor(F.col("bbox.y0") / 20).alias("band"), F.col("bbox.x0").alias("x"), "line_id", cleaned(F.col("text")).alias("t"))
    return lines.groupBy("doc_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda v: v.t), "\n").alias("text"),
        F.bround(F.round(F.avg("conf"), 9), 2).alias("mean_conf"), F.bround(F.min("conf"), 2).alias("min_conf"), F.count("*").alias("lines_kept"),
    )


Recogniser = Callable[[bytes, str], tuple[str, dict]]
ENGINES: dict[str, Callable[[dict], Recogniser]] = {}


def register(name: str):
    """Register a factory: options -> recognise(image, prompt) -> (text, stats)."""

    def add(factory):
        ENGINES[name] = factory
        return factory

    return add


@register("double")
def double(options: dict) -> Recogniser:
    """A test double: it "reads" an image by decoding its bytes as UTF-8. It is no recogniser."""

    def recognise(image: bytes, prompt: str = "") -> tuple[str, dict]:
        return image.decode("utf-8", "replace"), {"confidence": 1.0}

    return recognise


_LOADED: dict[tuple, Recogniser] = {}


def recognise(images: DataFrame, engine: str, options: dict | None = None, tries: int = TRIES, wait: float = 0.0) -> DataFrame:
    """(doc_id, page_no, text, error, tries) from (doc_id, page_no, image): up to ``tries`` calls until there is text.

    One model for each worker, engine and set of options; a failure is a row's
    error, not the job's. Images go through in Arrow batches.
    """
    import time

    import pyarrow as pa

    factory, options = ENGINES[engine], dict(options or {})
    key = (engine, tuple(sorted((k, str(v)) for k, v in options.items())))

    def run(batches):
        if key not in _LOADED:
            _LOADED[key] = factory(options)
        read = _LOADED[key]
        for batch in batches:
            rows = []
            for image in batch.column(2).to_pylist():
                text, error, n = "", None, 0
                while n < tries and not text:
                    if n and wait:
                        time.sleep(wait)
                    n += 1
                    try:
                        text, stats = read(image, options.get("prompt", ""))
                        error = stats.get("error")
                    except Exception as e:  # noqa: BLE001 - an engine's failure is data
                        text, error = "", f"{type(e).__name__}: {e}"
                rows.append((text, error, n))
            text, error, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.string()), pa.array(n, pa.int32())], ["doc_id", "page_no", "text", "error", "tries"]
            )

    return images.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), F.col("image").cast("binary")).mapInArrow(run, "doc_id long, page_no int, text string, error string, tries int")


def recognise_documents(images: DataFrame, engine: str, options: dict | None = None) -> DataFrame:
    """(doc_id, pages, text, error): all pages of a document in one request, in page order; the engine gets their images as a list.

    A document's images are in one row, as the request has them; ask for page ranges where documents are long.
    """
    import pandas as pd

    factory, options = ENGINES[engine], dict(options or {})

    def run(batches):
        read = factory(options)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    text, stats = read([bytes(i) for i in r.images], options.get("prompt", ""))
                    out.append((r.doc_id, list(r.pages), text, stats.get("error")))
                except Exception as e:  # noqa: BLE001 - an engine's failure is data
                    out.append((r.doc_id, list(r.pages), "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "pages", "text", "error"])

    held = F.array_sort(F.collect_list(F.struct("page_no", "image")))
    rows = images.groupBy("doc_id").agg(held.alias("h")).select("doc_id", F.col("h.page_no").alias("pages"), F.col("h.image").alias("images"))
    return rows.mapInPandas(run, "doc_id long, pages array<int>, text string, error string")
