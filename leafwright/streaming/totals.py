"""Totals of a run while its result is written: observed metrics, in batches and on streams, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from leafwright.operators.report import LOW

TOTALS = "status string, total_time double, pages long, errors long, issues long, chars long"


def metrics() -> list[Column]:
    """What is observed of rows (chars, time, error): sums, so that parts of a run add up."""
    low, error = F.coalesce(F.col("chars") < LOW, F.lit(False)), F.col("error").isNotNull()
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    found = {"seconds": F.sum(F.bround("time", 1)), "pages": F.count(F.lit(1)), "errors": some(error), "issues": some(low) + some(error), "chars": F.sum("chars")}
    return [F.coalesce(c, F.lit(0)).alias(n) for n, c in found.items()]


def row(seen: dict) -> tuple:
    """One row of ``TOTALS``; a run without any rows is ok."""
    issues = int(seen["issues"] or 0)
    return "warn" if issues else "ok", round(float(seen["seconds"] or 0), 1), *(int(seen[n] or 0) for n in ("pages", "errors")), issues, int(seen["chars"] or 0)


def observed(pages: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and what will tell their totals once an action has run over all of them."""
    seen = Observation()
    return pages.observe(seen, *metrics()), seen


def told(spark: SparkSession, seen: Observation) -> DataFrame:
    return spark.createDataFrame([row(seen.get)], TOTALS)


class Progress(StreamingQueryListener):
    """Totals of the streams whose rows went through ``watched`` with this name, micro-batch by micro-batch."""

    def __init__(self, name: str):
        self.name, self.seen, self.batches = name, dict.fromkeys(("seconds", "pages", "errors", "issues", "chars"), 0), set()

    def watched(self, pages: DataFrame) -> DataFrame:
        return pages.observe(self.name, *metrics())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found, batch = event.progress.observedMetrics.get(self.name), (str(event.progress.id), event.progress.batchId)
        if found is not None and batch not in self.batches:  # a batch is told once, run again or not
            self.batches.add(batch)
            for n, x in found.asDict().items():
                self.seen[n] += x or 0

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> tuple:
        return row(self.seen)
