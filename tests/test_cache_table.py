"""The versioned cache: snapshots, buckets, compaction, crashes and two writers."""

import pytest
from pyspark.sql import functions as F

from leafwright.options import ExtractOptions
from leafwright.plans import extract
from leafwright.sources.cache_table import CacheTable, Conflict
from leafwright.streaming import ingest


def frame(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, text string")


def held(df):
    return {r.cache_key: r.text for r in df.collect()}


def test_versions(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "cache"), buckets=8)
    assert held(table.snapshot()) == {}
    first = {f"k{i}": f"a{i}" for i in range(100)}
    assert table.upsert(frame(spark, [*first.items(), ("none", None), ("empty", ""), (None, "x")])) == 1
    second = {"k3": "new", "k200": "more"}
    old = table.snapshot(1)
    assert table.upsert(frame(spark, [*second.items(), ("k3", "lesser")])) == 2
    assert held(old) == first == held(table.snapshot(1)) and held(table.snapshot()) == first | second
    # Only the buckets of the keys have new files; those of the others are the same.
    a, b = table.manifest(1)["files"], table.manifest(2)["files"]
    touched = {r[0] for r in frame(spark, second.items()).select(table._bucket(F.col("cache_key"))).collect()}
    assert {int(x) for x in b if a.get(x) != b[x]} == touched and len(touched) <= 2
    # Compaction changes no row, and no older version.
    assert table.compact() == 3 and held(table.snapshot()) == first | second and held(table.snapshot(1)) == first
    assert all(len({v for _, v in x}) == 1 for x in table.manifest()["files"].values()) and table.compact() == 3
    table.upsert(frame(spark, [("k3", "third")]))
    assert held(table.snapshot())["k3"] == "third" and held(table.snapshot(3))["k3"] == "new"
    assert CacheTable(spark, table.path, buckets=99).buckets == 8


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "cache"), buckets=32)
    table.upsert(frame(spark, [(f"k{i}", "t") for i in range(500)]))
    keys = spark.createDataFrame([("k7", 1), ("k9", 2), ("lost", 3), (None, 4)], "cache_key string, n int")
    got = table.lookup(keys)
    assert {r.n: r.cached_text for r in got.collect()} == {1: "t", 2: "t", 3: None, 4: None}
    assert len(got.inputFiles()) <= 3


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    table = CacheTable(spark, str(tmp_path / "cache"), buckets=4)
    table.upsert(frame(spark, [("a", "1")]))
    with monkeypatch.context() as m:
        m.setattr(CacheTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(frame(spark, [("a", "2"), ("b", "2")]))
    assert held(table.snapshot()) == {"a": "1"} and table.versions() == [0, 1]
    table.upsert(frame(spark, [("a", "3")]))
    assert held(table.snapshot()) == {"a": "3"}
    assert table.vacuum(keep=2) == 1 and held(table.snapshot()) == {"a": "3"} and held(table.snapshot(1)) == {"a": "1"}


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (CacheTable(spark, str(tmp_path / "cache"), buckets=2) for _ in range(2))
    one.upsert(frame(spark, [("a", "0"), ("b", "0")]))
    with pytest.raises(Conflict):
        one._commit(one.manifest(1))
    # The second writer's manifest is read, then the first one commits: it starts anew and nothing is lost.
    plain, fired = CacheTable._commit, []

    def late(self, manifest):
        if not fired:
            fired.append(1)
            two.upsert(frame(spark, [("b", "two")]))
        return plain(self, manifest)

    with monkeypatch.context() as m:
        m.setattr(CacheTable, "_commit", late)
        one.upsert(frame(spark, [("a", "one")]))
    assert held(one.snapshot()) == {"a": "one", "b": "two"}
    fired.clear()
    with monkeypatch.context() as m:  # an upsert during a compaction stays
        m.setattr(CacheTable, "_commit", late)
        one.compact()
    assert held(one.snapshot()) == {"a": "one", "b": "two"} and one.versions()[-1] == 5


def test_ingest_puts_a_batch_once(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = CacheTable(spark, str(tmp_path / "cache"), buckets=2)
    for k in range(2):
        frame(spark, [(f"k{k}", f"t{k}"), ("both", f"t{k}")]).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_into(spark, source, frame(spark, []).schema, lambda b: b, table, state)
    assert held(table.snapshot()) == {"k0": "t0", "k1": "t1", "both": "t1"} and table.versions() == [0, 1, 2]
    assert table.upsert(frame(spark, [("both", "again")]), tag=(source, 1)) == 2 and held(table.snapshot())["both"] == "t1"


def test_extract_cached(spark, tmp_path):
    table, calls = CacheTable(spark, str(tmp_path / "cache"), buckets=2), []
    pages = spark.createDataFrame([("a", 1, "ov"), ("b", 2, "ov"), ("c", 3, "audit"), ("d", 4, "ov")], "cache_key string, page int, engine string")

    def read(misses):
        calls.append(sorted(r.cache_key for r in misses.collect()))
        return misses.select("*", F.when(F.col("cache_key") != "d", F.concat("cache_key", F.lit(str(len(calls))))).alias("text"), F.when(F.col("cache_key") == "d", "broken").alias("error"))

    run = lambda **o: {r.cache_key: (r.text, r.error, r.cache) for r in extract.extract_cached(pages, read, table, ExtractOptions(engine="ov", **o)).collect()}
    assert run() == {"a": ("a1", None, None), "b": ("b1", None, None), "c": ("c1", None, None), "d": (None, "broken", None)}
    assert run() == {"a": ("a1", None, "hit"), "b": ("b1", None, "hit"), "c": ("c2", None, None), "d": (None, "broken", None)}
    assert run(no_cache=True)["a"] == ("a3", None, None) and run()["a"] == ("a1", None, "hit")
    assert run(refresh=True)["a"] == ("a5", None, None) and run()["a"] == ("a5", None, "hit")
    assert calls == [["a", "b", "c", "d"], ["c", "d"], ["a", "b", "c", "d"], ["c", "d"], ["a", "b", "c", "d"], ["c", "d"]]


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """An upsert deals its rows out once; a snapshot of several versions groups no rows; each version is right."""
    table, plans = CacheTable(spark, str(tmp_path / "cache"), buckets=2), []
    plain = CacheTable._written
    monkeypatch.setattr(CacheTable, "_written", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or plain(self, rows))
    want = {}
    for v in range(1, 7):
        new = {f"k{i}": f"{v}" for i in range(0, 60, v)}
        table.upsert(frame(spark, list(new.items())))
        want |= new
        assert held(table.snapshot()) == want and table.snapshot().count() == len(want)
        assert v > 4 or "Aggregate" not in table.snapshot()._jdf.queryExecution().executedPlan().toString()
    assert all(x.count("Exchange") == 1 for x in plans)
    assert table.compact() == 7 and held(table.snapshot()) == want and table.snapshot().count() == len(want)
