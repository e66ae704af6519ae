"""The source and sink of files by document: filters choose files before they are opened, writes come whole or not at all."""

import os
import time

import pytest
from pyspark.sql import functions as F

from leafwright.sources import document_files, results


@pytest.fixture
def folder(tmp_path):
    for stem in ("a", "b", "c_p"):
        for page in (1, 2, 30):
            (tmp_path / f"{stem}_p{page}.lines").write_text(f"0,0,5,5 | {stem} {page}\nnoise\n1.5,2,3,4 | next")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "whole.jsonl").write_text('{"result": {"layoutParsingResults": [{"markdown": {"text": "T"}}]}}\n\nbad')
    (tmp_path / "_hidden_p1.lines").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    return tmp_path


def unreadable(path):
    """A file that is an error when it is opened: a link to itself."""
    os.remove(path)
    os.symlink(path, path)


def names(df):
    return sorted((r.stem, r.page, r.ext) for r in df.select("stem", "page", "ext").collect())


def test_read_all(spark, folder):
    got = document_files.read(spark, str(folder))
    want = [(s, p, "lines") for s in ("a", "b", "c_p") for p in (1, 2, 30)] + [("empty", None, "txt"), ("whole", None, "jsonl")]
    assert sorted(names(got), key=repr) == sorted(want, key=repr)
    dump = results.dumped_lines(document_files.lines(got.where("ext = 'lines' and page = 30 and stem = 'a'")))
    assert [(r.stem, r.page, r.text, r.bbox.x1) for r in dump.orderBy("seq").collect()] == [("a", 30, "a 30", 5.0), ("a", 30, "next", 3.0)]
    texts = results.jsonl_texts(document_files.lines(got.where("ext = 'jsonl'")).select(F.col("stem").alias("job"), "seq", F.col("value").alias("line")))
    assert [(r.job, r.text) for r in texts.collect()] == [("whole", "T")]


FILTERS = ["page = 2", "page in (2, 7)", "page > 1 and page <= 2", "page >= 2 and page < 30", "stem = 'a' and page between 2 and 5", "stem like 'a%' and page = 2", "page <=> 2", "page = 2 and length(text) > 3"]


@pytest.mark.parametrize("where", FILTERS)
def test_filters_choose_files_before_they_are_opened(spark, folder, where):
    want = names(document_files.read(spark, str(folder)).where(where))
    assert want and all(p == 2 for _, p, _ in want)
    for name in os.listdir(folder):
        if name.endswith(".lines") and not name.endswith("_p2.lines"):
            unreadable(str(folder / name))
    document = str(folder / "deep" / "whole.jsonl")
    unreadable(document)
    assert names(document_files.read(spark, str(folder)).where(where)) == want


def test_other_filters_are_left_to_spark(spark, folder):
    got = document_files.read(spark, str(folder))
    assert names(got.where("page = 2 or stem = 'empty'")) == sorted([("a", 2, "lines"), ("b", 2, "lines"), ("c_p", 2, "lines"), ("empty", None, "txt")], key=repr)
    assert names(got.where("page is null and size > 0")) == [("whole", None, "jsonl")]


def rows(spark, given):
    return spark.createDataFrame(given, "doc_id long, stem string, text string")


def left(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


def test_write_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    given = rows(spark, [(1, "x", "one\f"), (2, "y", None), (3, "x", "é\n" * 5), (4, "z_p7", "seven")]).repartition(3)
    document_files.write(document_files.apart(given, "stem", "doc_id"), path, "txt")
    assert left(path) == ["x-1_output/x-1.txt", "x-3_output/x-3.txt", "y_output/y.txt", "z_p7_output/z_p7.txt"]
    got = {r.stem: (r.page, r.text) for r in document_files.read(spark, path).collect()}
    assert got == {"x-1": (None, "one\f"), "x-3": (None, "é\n" * 5), "y": (None, ""), "z": (7, "seven")}
    document_files.write(given.where("doc_id = 2").withColumn("suffix", F.lit("layout")), path, "md")
    assert "y_output/y_layout.md" in left(path)


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    document_files.write(rows(spark, [(1, "kept", "1")]), path, "txt")
    bad = F.udf(lambda x: x if x != "3" else 1 / 0)
    for given in (
        rows(spark, [(k, f"s{k}", str(k)) for k in range(8)]).repartition(4).withColumn("text", bad("text")),  # a task fails
        rows(spark, [(1, "same", "1"), (2, "same", "2")]).repartition(2),  # two rows, one name
        rows(spark, [(1, "new", "1"), (2, "kept", "2")]),  # a name that is there
        rows(spark, [(1, "../out", "1")]), rows(spark, [(1, None, "1")]), rows(spark, [(1, "..", "1")]),
    ):
        with pytest.raises(Exception):
            document_files.write(given, path, "txt")
        until = time.monotonic() + 10  # tasks that ran on when the job was given up
        while len(os.listdir(path)) > 1 and time.monotonic() < until:
            time.sleep(0.2)
        assert left(path) == ["kept_output/kept.txt"] and os.listdir(path) == ["kept_output"]
    document_files.write(rows(spark, [(1, "other", "1")]), path, "txt", mode="overwrite")
    assert left(path) == ["other_output/other.txt"]
    document_files.write(rows(spark, []), path, "txt")
    assert left(path) == ["other_output/other.txt"]


def test_the_driver_moves_and_lists_no_files(spark, tmp_path, monkeypatch):
    """Files are moved by tasks, and of many folders the driver lists none."""
    path, n = str(tmp_path / "out"), 300
    monkeypatch.setattr(document_files.ThreadPoolExecutor, "map", lambda *_: 1 / 0)
    document_files.write(spark.range(n).select(F.concat(F.lit("s"), "id").alias("stem"), F.col("id").cast("string").alias("text")), path, "txt")
    document_files.write(spark.range(n).select(F.concat(F.lit("s"), "id").alias("stem"), F.lit("m").alias("text")), path, "md")
    parts = document_files.Reader({"path": path}).partitions()
    assert len(os.listdir(path)) == n and sum(len(p.folders) for p in parts) == n and not any(p.files for p in parts)
    got = document_files.read(spark, path).where("ext = 'txt'")
    assert {(r.stem, r.text) for r in got.collect()} == {(f"s{k}", str(k)) for k in range(n)} and document_files.read(spark, path).count() == 2 * n
