"""The job state machine on a stream against a replay of all events in one batch."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from leafwright.streaming import jobs

EVENTS = "job string, at timestamp, seq long, state string, message string, url string"
START = datetime.datetime(2024, 1, 1)


def made(count=60, seed=5):
    """Events of jobs that end well, badly, twice, too late, without a result or not at all."""
    r, rows, seq = random.Random(seed), [], 0
    for k in range(count):
        at = START + datetime.timedelta(seconds=r.uniform(0, 3000))
        steps = [("submit", 0.0)] + [("poll", r.uniform(0, 290)) for _ in range(r.randrange(4))]
        steps += r.choice([[("done", 100.0)], [("failed", 50.0)], [("done", 120.0), ("failed", 60.0)], [("done", 301.0)], [("done", 300.0)], [("done", 299.999999)], [], [("done", 80.0), ("poll", 200.0), ("poll", 400.0)]])
        for state, after in steps:
            seq += 1
            url = "" if k % 5 == 0 else "http://x"
            rows.append((f"j{k}", at + datetime.timedelta(seconds=after), seq, state, "broken" if state == "failed" else None, url))
    rows.append(("open", START + datetime.timedelta(seconds=3700), seq + 1, "submit", None, None))
    return rows


def put(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def shown(df):
    return sorted(map(tuple, df.select("job", "state", "cause", "started", "ended").collect()), key=repr)


def test_states_equal_a_replay_over_batches_and_a_restart(spark, tmp_path):
    rows = sorted(made(), key=lambda x: x[1])
    source, sink, progress = (str(tmp_path / x) for x in ("events", "states", "progress"))
    read = lambda s: s.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    cuts = [0, 40, 41, 90, 150, len(rows)]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        put(spark, random.Random(k).sample(rows[i:j], j - i), source)  # out of order within a file
        if k in (2, 4):  # stopped after three files, started again with two more
            jobs.follow(spark, read, sink, progress, wait=300, late="1 second")
            now = F.lit(rows[j - 1][1] - datetime.timedelta(seconds=1))
            want = jobs.replayed(spark.createDataFrame(rows[:j], EVENTS), now)
            assert shown(jobs.latest(spark, sink)) == shown(want)
    final = jobs.latest(spark, sink)
    causes = {r.cause for r in final.collect()}
    assert {"timeout", "done without a result", "broken", None} <= causes and final.where("state = 'open'").count() > 0
    changes = spark.read.parquet(sink)
    assert changes.groupBy("job", "revision").count().where("count > 1").count() == 0
    assert changes.select("batch").distinct().count() >= 4
    again = changes.count()
    jobs.follow(spark, read, sink, progress, wait=300, late="1 second")  # nothing new, nothing changes
    assert spark.read.parquet(sink).count() == again


def test_a_job_is_forgotten_after_its_time(spark, tmp_path):
    source, sink, progress = (str(tmp_path / x) for x in ("events", "states", "progress"))
    read = lambda s: s.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    at = lambda s: START + datetime.timedelta(seconds=s)
    put(spark, [("a", at(0), 1, "submit", None, None), ("b", at(0), 2, "submit", None, None), (None, at(0), 3, "done", None, "u"), ("n", None, 4, "done", None, "u")], source)
    put(spark, [("clock", at(350), 5, "submit", None, None)], source)
    put(spark, [("a", at(360), 6, "done", None, "u")], source)  # late: the job has failed by its timer
    put(spark, [("clock", at(1000), 7, "poll", None, None)], source)
    put(spark, [("b", at(1001), 8, "submit", None, None), ("b", at(1002), 9, "done", None, "u")], source)  # a new run
    jobs.follow(spark, read, sink, progress, wait=300, keep=600)
    got = {r.job: (r.state, r.cause) for r in jobs.latest(spark, sink).collect()}
    assert got["a"] == ("failed", "timeout") and got["b"] == ("done", None) and set(got) == {"a", "b", "clock"}


def test_outcomes(spark):
    rows = [("j", START, 1, "submit", None, None), ("j", START + datetime.timedelta(seconds=5), 2, "done", None, None), ("k", START, 3, "failed", None, None)]
    got = shown(jobs.replayed(spark.createDataFrame(rows, EVENTS), F.lit(START)))
    assert [x[:3] for x in got] == [("j", "failed", "done without a result"), ("k", "failed", "")]


class Counted:
    """A store of one job's state and timers that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "registerTimer":
                self.timers.add(*args)
            elif name == "deleteTimer":
                self.timers.remove(*args)
            elif name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            return {"getValueState": self, "get": self.value, "exists": self.value is not None, "listTimers": sorted(self.timers), "getCurrentWatermarkInMs": 0, "getExpiryTimeInMs": min(self.timers, default=0)}.get(name)

        return call


def test_calls_of_the_store_are_few():
    """A new job takes three calls, an event that changes nothing one, one that ends it four; an ended job has one timer, its last."""
    from types import SimpleNamespace as Event

    store, machine = Counted(), jobs.Machine(300_000_000, 600_000_000)
    machine.init(store)
    taken = []
    for at, state in ((0, "submit"), (1000, "poll"), (2000, "done")):
        before = store.calls
        list(machine.handleInputRows(("j",), [Event(at=at, seq=at, state=state, cause=None)], Event(getCurrentWatermarkInMs=lambda: 0)))
        taken.append(store.calls - before)
    assert taken == [3, 1, 4] and store.timers == {900_000}
    assert list(machine.handleExpiredTimer(("j",), None, Event(getExpiryTimeInMs=lambda: 900_000))) == [] and store.value is None


def fed(spark, tmp_path, name, **options):
    """Follow the made events in five files, stopped after three; all changes told and the folder of progress."""
    rows = sorted(made(), key=lambda x: x[1])
    source, sink, progress = (str(tmp_path / name / x) for x in ("events", "states", "progress"))
    read = lambda s: s.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    cuts = [0, 40, 41, 90, 150, len(rows)]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        put(spark, random.Random(k).sample(rows[i:j], j - i), source)
        if k in (2, 4):
            jobs.follow(spark, read, sink, progress, wait=300, late="1 second", **options)
    return sorted(map(tuple, spark.read.parquet(sink).select("batch", *(x.split()[0] for x in jobs.STATES.split(", "))).collect()), key=repr), read, sink, progress


def test_shards_tell_what_jobs_tell(spark, tmp_path):
    """Every change in every micro-batch, over a restart, and each of few or many shards; another number of shards is refused."""
    want = fed(spark, tmp_path, "jobs", keep=600)[0]
    assert fed(spark, tmp_path, "many", keep=600, shards=97)[0] == want
    got, read, sink, progress = fed(spark, tmp_path, "few", keep=600, shards=2)
    assert got == want and len({x[0] for x in want}) >= 4
    put(spark, [("open", START + datetime.timedelta(seconds=3701), 999, "poll", None, None)], str(tmp_path / "few" / "events"))
    with pytest.raises(StreamingQueryException, match="started with 2 shards, not 1"):
        jobs.follow(spark, read, sink, progress, wait=300, late="1 second", keep=600, shards=1)


def test_shards_forget_and_take_what_is_odd(spark, tmp_path):
    """A forgotten job's name is a new job's; a text with quotes, a long number or none as seq come back as they are."""
    source, sink, progress = (str(tmp_path / x) for x in ("events", "states", "progress"))
    read = lambda s: s.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    at = lambda s: START + datetime.timedelta(seconds=s, microseconds=1)
    odd = 'j" \\\n\U0001f600'
    put(spark, [("b", at(0), 2, "submit", None, None), (odd, at(0), None, "submit", None, None), (None, at(0), 3, "done", None, "u"), ("n", None, 4, "done", None, "u")], source)
    # Equal times: the smallest seq is the end, told apart beyond 2^53.
    put(spark, [(odd, at(9), 2**53 + 1, "done", None, "u"), (odd, at(9), 2**53, "failed", 'm" \\', None), (odd, at(10), None, "done", None, "u"), ("clock", at(350), 5, "submit", None, None)], source)
    put(spark, [("b", at(299), 6, "done", None, "u")], source)  # late
    put(spark, [("clock", at(1000), 7, "poll", None, None)], source)
    put(spark, [("b", at(1001), 8, "submit", None, None), ("b", at(1002), 9, "done", None, "u")], source)  # a new run
    jobs.follow(spark, read, sink, progress, wait=300, keep=600, shards=1)
    got = {r.job: tuple(r)[1:] for r in jobs.latest(spark, sink).select("job", "state", "cause", "started", "ended").collect()}
    assert got == {"b": ("done", None, at(1001), at(1002)), odd: ("failed", 'm" \\', at(0), at(9)), "clock": ("failed", "timeout", at(350), at(650))}


def test_calls_of_the_store_do_not_grow_with_jobs():
    """A thousand new jobs of a shard take three calls, their ends four, their time-outs and their end three and two."""
    from types import SimpleNamespace as Some

    store, machine, count = Counted(), jobs.Shard(300_000_000, 600_000_000, 1), 1000
    machine.init(store)
    told, taken = [], []
    now = lambda ms: Some(getCurrentWatermarkInMs=lambda: ms)
    rows = lambda n, at, state: [(0, f"j{k}", None, at, 1, state, None) for k in range(n)]
    steps = [
        lambda: machine.handleInputRows((0,), iter(rows(count, 0, "submit") + rows(count, 1000, "poll")), now(0)),
        lambda: machine.handleInputRows((0,), iter(rows(count // 2, 2000, "done")), now(0)),
        lambda: machine.handleExpiredTimer((0,), now(300_000), None),
        lambda: machine.handleExpiredTimer((0,), now(900_000), None),
    ]
    for step in steps:
        before = store.calls
        told.append(len(list(step())))
        taken.append(store.calls - before)
        if step in steps[2:]:
            store.timers.discard(min(store.timers))  # as Spark does
    assert told == [count, count // 2, count // 2, 0] and max(taken) <= 4
    assert store.value is None and not store.timers


def test_the_query_holds_its_jobs_by_shards(spark, sf, monkeypatch):
    """Python calls for each job would take hours over tens of millions of them."""
    from leafwright.plans import QUERIES

    seen, real = [], jobs.states
    monkeypatch.setattr(jobs, "states", lambda events, **options: seen.append(options["shards"]) or real(events, **options))
    assert QUERIES["job_states_stream"](spark, sf).count() > 0
    assert seen and seen[0] >= 1024
