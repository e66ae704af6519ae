"""Jobs of a service as a state machine on a stream of their events.

A job starts with its first event. It ends with its first ``done`` or
``failed`` within ``wait`` of the start; without one it fails by a timer once the
watermark has passed that time. Events after the end change nothing. What
a job keeps are the earliest start and the earliest end, so its states do not
depend on how events are cut into micro-batches or come in within the watermark's delay.
A second timer forgets the job ``keep`` after its time is over; only then its name is that of a new job.

State is held by job, or by shard of jobs: the former touches only the jobs of a micro-batch, the latter costs a
few calls a shard and not a job, and reads and writes all jobs of the shards that have events.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDS = ("done", "failed")
NO_RESULT, TIMEOUT = "done without a result", "timeout"
STATES = "job string, revision long, state string, cause string, started timestamp, ended timestamp"
KEPT = "started long, end long, seq long, state string, cause string, revision long, closed boolean"
FIELDS = [x.split()[0] for x in KEPT.split(", ")]
SHARD = "shards int, timer long, jobs string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(state: Column, message: Column, url: Column) -> tuple[Column, Column]:
    """(state, cause) of an event: a result that is done has to say where it is."""
    lost = (state == "done") & (F.length(F.coalesce(url, F.lit(""))) == 0)
    return F.when(lost, "failed").otherwise(state), F.when(lost, NO_RESULT).when(state == "failed", F.coalesce(message, F.lit("")))


class Machine(StatefulProcessor):
    """One job: rows have at (microseconds), seq, state and cause."""

    def __init__(self, wait: int, keep: int):
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("job", KEPT)

    def close(self) -> None:
        pass

    def _row(self, key, held: dict) -> Iterator[Row]:
        """The job's state, if it is another than the last one told."""
        until = held["started"] + self.wait
        if held["end"] is not None and held["end"] < until:
            now = (held["state"], held["cause"], held["end"])
        elif held["closed"]:
            now = ("failed", TIMEOUT, until)
        else:
            now = ("open", None, None)
        return (*now, held["started"])

    def _due(self, held: dict) -> int:
        """When the job's one timer fires: at the end of its time, or once it has ended by an event or that timer, when it is forgotten."""
        until = held["started"] + self.wait
        over = held["closed"] or (held["end"] is not None and held["end"] < until)
        return -(-until // 1000) + (self.keep // 1000 if over else 0)

    def _gone(self, held: dict, watermark: Callable[[], int]) -> bool:
        """Whether its time to be forgotten has come with this batch: the name is a new job's."""
        due = self._due(held)
        return due >= -(-(held["started"] + self.wait) // 1000) + self.keep // 1000 and watermark() >= due

    @staticmethod
    def _fed(held: dict | None, at: int, seq: int, state: str, cause: str | None) -> dict:
        """The job, which is changed, after an event."""
        if held is None:
            held = dict.fromkeys(FIELDS) | {"started": at, "revision": 0, "closed": False}
        held["started"] = min(held["started"], at)
        if state in ENDS and (held["end"] is None or (at, seq) < (held["end"], held["seq"])):
            held.update(end=at, seq=seq, state=state, cause=cause)
        return held

    def _get(self) -> dict | None:
        held = self.held.get()
        return None if held is None else dict(zip(FIELDS, held))

    def _told(self, key, before, held: dict) -> Iterator[Row]:
        now = self._row(key, held)
        if before != now:
            held["revision"] += 1
            yield Row(job=key[0], revision=held["revision"], state=now[0], cause=now[1], started=now[3], ended=now[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call of the state or a timer is a message to another process and back, so none is made that changes nothing.
        old = held = self._get()
        due = None if held is None else self._due(held)
        if held is not None and self._gone(held, timerValues.getCurrentWatermarkInMs):
            held = None
        before, held = (None, None) if held is None else (self._row(key, held), dict(held))
        for r in rows:
            held = self._fed(held, r.at, r.seq, r.state, r.cause)
        if (now := self._due(held)) != due:  # an earlier start or an end moves the timer, a new job has no old one
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(now)
        yield from self._told(key, before, held)
        if held != old:
            self.held.update(tuple(held[x] for x in FIELDS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._get()
        due, at = self._due(held), expiredTimerInfo.getExpiryTimeInMs()
        over = due > -(-(held["started"] + self.wait) // 1000) or held["closed"]
        if over and at >= due:
            self.held.clear()
            return
        before = self._row(key, held)
        held["closed"] = True
        self.handle.registerTimer(self._due(held))
        yield from self._told(key, before, held)
        self.held.update(tuple(held[x] for x in FIELDS))


class Shard(Machine):
    """All jobs of a shard: rows have job, too. There is one timer, the earliest that a job would have."""

    def __init__(self, wait: int, keep: int, shards: int):
        super().__init__(wait, keep)
        self.shards = shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("shard", SHARD)

    def _load(self) -> tuple[int | None, dict[str, dict]]:
        shards, timer, jobs = self.held.get() or (self.shards, None, "[]")
        if shards != self.shards:
            raise ValueError(f"the stream was started with {shards} shards, not {self.shards}")
        return timer, {job: dict(zip(FIELDS, held)) for job, *held in json.loads(jobs)}

    def _save(self, timer: int | None, jobs: dict[str, dict]) -> None:
        due = min(map(self._due, jobs.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if jobs:
            self.held.update((self.shards, due, json.dumps([(job, *held.values()) for job, held in jobs.items()], ensure_ascii=False)))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs
        (timer, jobs), before = self._load(), {}
        for _, job, _, at, seq, state, cause in rows:
            held = jobs.get(job)
            if job not in before:
                if held is not None and self._gone(held, watermark):
                    held = None
                before[job] = None if held is None else self._row(job, held)
            jobs[job] = self._fed(held, at, seq, state, cause)
        for job, was in before.items():
            yield from self._told((job,), was, jobs[job])
        self._save(timer, jobs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (_, jobs), now = self._load(), timerValues.getCurrentWatermarkInMs()
        for job, held in jobs.items():
            if self._due(held) <= now and (was := self._row(job, held))[0] == "open":
                held["closed"] = True
                yield from self._told((job,), was, held)
        self._save(None, {job: held for job, held in jobs.items() if self._due(held) > now})  # the timer that has come is deleted by Spark


def _events(events: DataFrame) -> DataFrame:
    """(job, at, seq, state, cause) from (job, at, seq, state, message, url)."""
    state, cause = outcome(F.col("state"), F.col("message"), F.col("url"))
    return events.where("job is not null and at is not null").select(F.col("job").cast("string"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long"), state.alias("state"), cause.alias("cause"))


def states(events: DataFrame, wait: float = 300, late: str = "0 seconds", keep: float = 3600, shards: int | None = None) -> DataFrame:
    """Changes of jobs' states, columns as in ``STATES``, from a stream of events (job, at, seq, state, message, url).

    ``wait`` and ``keep`` are seconds. Revisions number a job's changes. ``shards``: state is held by that many shards of
    jobs, each of which a task holds in memory, and not by job; a stream keeps the number that it was started with.
    """
    timed = _events(events).withWatermark("at", late).select("job", "at", F.unix_micros("at").alias("micros"), "seq", "state", "cause")
    keyed = timed.select("job", F.col("at").alias("time"), F.col("micros").alias("at"), "seq", "state", "cause")
    raw, spans = STATES.replace("timestamp", "long"), (int(wait * 1e6), int(keep * 1e6))
    if shards is None:
        rows = keyed.groupBy("job").transformWithState(Machine(*spans), raw, "Update", "eventTime")
    else:
        dealt = keyed.select(F.pmod(F.xxhash64("job"), F.lit(shards)).alias("shard"), "*").groupBy("shard")
        rows = dealt.transformWithState(Shard(*spans, shards), raw, "Update", "eventTime")
    return rows.select("job", "revision", "state", "cause", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"))


def follow(spark: SparkSession, source: Callable[[SparkSession], DataFrame], sink: str, progress: str, **options) -> None:
    """Run what is new of ``source``, a stream of events in a session given to it, into ``sink``; ``progress`` keeps state and offsets.

    Each micro-batch is a folder, written over if it is run again.
    """
    own = spark.newSession()  # timers need this store of states; other streams keep theirs
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = states(source(own), **options).writeStream.outputMode("update").foreachBatch(put)
    stream.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """Each job's last state."""
    rows = spark.read.schema(f"{STATES}, batch long").parquet(sink)
    last = rows.groupBy("job").agg(F.max_by(F.struct("state", "cause", "started", "ended"), F.struct("batch", "revision")).alias("x"))
    return last.select("job", "x.*")


def replayed(events: DataFrame, now: Column, wait: float = 300) -> DataFrame:
    """(job, state, cause, started, ended) of all events as of the watermark ``now``, in one batch."""
    ended = F.col("state").isin(*ENDS)
    end = F.min(F.when(ended, F.struct("at", "seq", "state", "cause")))
    jobs = _events(events).groupBy("job").agg(F.min("at").alias("started"), end.alias("end"))
    until = F.timestamp_micros(F.unix_micros("started") + int(wait * 1e6))
    ok, over = F.coalesce(F.col("end.at") < until, F.lit(False)), until <= now
    return jobs.select(
        "job",
        F.when(ok, F.col("end.state")).when(over, "failed").otherwise("open").alias("state"),
        F.when(ok, F.col("end.cause")).when(over, TIMEOUT).alias("cause"),
        "started",
        F.when(ok, F.col("end.at")).when(over, until).alias("ended"),
    )
