"""Result files of services: JSON lines, logs and dumps of recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.schemas import JSONL_RESULT


def jsonl_texts(lines: DataFrame) -> DataFrame:
    """(job, text, error) from (job, seq, line): texts of sound lines in order, empty ones too, joined by a blank line; bad lines are skipped, and a job without any text has an error."""
    parsed = lines.withColumn("r", F.from_json("line", JSONL_RESULT, {"mode": "PERMISSIVE"})).withColumn(
        "texts", F.filter(F.transform("r.result.layoutParsingResults", lambda x: x.markdown.text), lambda t: t.isNotNull())
    )
    held = F.array_sort(F.collect_list(F.when(F.size("texts") > 0, F.struct("seq", "texts"))))
    text = F.array_join(F.flatten(F.transform(held, lambda x: x.texts)), "\n\n")
    return parsed.groupBy("job").agg(text.alias("text"), F.when(F.size(held) == 0, "empty result").alias("error"))


LOG = r"prompt eval time = *([0-9.]+) ms / *([0-9]+) tokens[^\n]*\n[^\n]*?eval time = *([0-9.]+) ms / *([0-9]+) tokens"


def log_timings(log: Column) -> Column:
    """Array of (prompt_ms, prompt_tokens, decode_ms, decode_tokens) of the requests in a server's log."""
    part = lambda k: F.regexp_extract_all(log, F.lit(LOG), k)
    return F.transform(
        F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")),
        lambda x: F.struct(x["a"].cast("double").alias("prompt_ms"), x["b"].cast("long").alias("prompt_tokens"), x["c"].cast("double").alias("decode_ms"), x["d"].cast("long").alias("decode_tokens")),
    )


def dumped_lines(dumps: DataFrame) -> DataFrame:
    """Lines of ``x0,y0,x1,y1 | text`` dumps as boxes and text; other lines are left out."""
    p = r"^\s*(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+) \| (.*)$"
    number = lambda k: F.regexp_extract("value", p, k).cast("double")
    box = F.struct(*(number(k + 1).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))
    return dumps.where(F.col("value").rlike(p)).select(*[c for c in dumps.columns if c != "value"], box.alias("bbox"), F.regexp_extract("value", p, 5).alias("text"))


def character_file(spark, path: str) -> DataFrame:
    """(path, characters): entries of character files that are not empty, whole whatever their length, in file order."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("path"))
    return files.select("path", F.filter(F.split("value", "\n", -1), lambda x: x != "").alias("characters"))
