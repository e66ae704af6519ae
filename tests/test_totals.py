"""Totals observed while rows are written equal those of the report, in one pass, in batches and on streams."""

import time

from pyspark.sql import functions as F

from leafwright.operators import report
from leafwright.streaming import totals

PAGES = "doc_id long, page int, chars long, time double, error string"
ROWS = [(1, 1, 500, 0.25, None), (1, 2, 3, 1.31, "timeout"), (2, 1, 29, 0.35, None), (3, 1, 30, None, None), (3, 2, None, 2.0, "broken")]


def by_report(pages):
    per = report.run_report(pages).agg(F.round(F.sum("total_time"), 1).alias("t"), F.sum("pages").alias("p")).first()
    return per.t, per.p, report.issues(pages).count()


def test_observed_totals_equal_the_report(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    rows, seen = totals.observed(pages)
    rows.write.parquet(str(tmp_path / "out"))
    (got,) = totals.told(spark, seen).collect()
    assert tuple(got) == ("warn", 3.9, 5, 2, 4, 562) and (got.total_time, got.pages, got.issues) == by_report(pages)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and "Exchange" not in plan
    rows, seen = totals.observed(pages.limit(0))
    rows.collect()
    assert tuple(totals.told(spark, seen).first()) == ("ok", 0.0, 0, 0, 0, 0)


def test_progress_of_a_stream(spark, tmp_path):
    source, told = str(tmp_path / "in"), totals.Progress("run")
    for k in range(3):
        spark.createDataFrame(ROWS[k : k + 2], PAGES).coalesce(1).write.mode("append").parquet(source)
    spark.streams.addListener(told)
    try:
        stream = told.watched(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(50):
            if len(told.batches) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    assert told.totals() == ("warn", 3.6, 6, 2, 6, 594)
    assert told.totals()[4] == report.issues(spark.read.parquet(source)).count() and len(told.batches) == 3
