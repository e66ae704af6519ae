"""Files of documents and pages as a data source: read with filters that choose files, written one for a document.

A name says what a file holds: ``{stem}_p{page}.{ext}`` is a page, ``{stem}.{ext}``
a document. Filters on stem, page and ext are told from the listing, before a
file is opened; of many folders each is listed by the task that reads it. Written files come as ``{stem}_output/{stem}[_suffix].{ext}``:
tasks write to a staging folder, tasks of a second job move what they wrote, and a job
that fails before that leaves nothing behind. Any file system that pyarrow opens will do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

FORMAT = "document_files"
READ = "stem string, page int, ext string, path string, size long, text string"
WRITTEN = "stem string, suffix string, ext string, text string"
NAME = re.compile(r"(?P<stem>.+?)(?:_p(?P<page>[0-9]{1,9}))?\.(?P<ext>[^./]+)")
#: Bytes and files of one partition.
PART_BYTES, PART_FILES = 16 << 20, 512
MOVES = 32  # files that a commit moves at a time
FOLDERS = 64  # from so many folders on, tasks list them


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def named(name: str) -> dict | None:
    """stem, page and ext of a file's name; None if it is none of ours."""
    m = NAME.fullmatch(name)
    return m and {"stem": m["stem"], "page": None if m["page"] is None else int(m["page"]), "ext": m["ext"]}


#: What a filter says of a value, which is not null but for the last two.
HOLDS = {
    EqualTo: lambda x, f: x == f.value,
    In: lambda x, f: x in f.value,
    GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value,
    LessThan: lambda x, f: x < f.value,
    LessThanOrEqual: lambda x, f: x <= f.value,
    StringStartsWith: lambda x, f: x.startswith(f.value),
    IsNotNull: lambda x, f: True,
}


def passes(held: dict, f: Filter) -> bool:
    x = held[f.attribute[0]]
    if isinstance(f, (IsNull, EqualNullSafe)):
        return x == getattr(f, "value", None)
    return x is not None and HOLDS[type(f)](x, f)


@dataclass
class Part(InputPartition):
    """Files as they were listed, and folders whose files are yet to be."""

    files: list[tuple[dict, str, int]]
    folders: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in {*HOLDS, IsNull, EqualNullSafe} and len(f.attribute) == 1 and f.attribute[0] in ("stem", "page", "ext"):
                self.filters.append(f)
            else:
                yield f

    def _listed(self, store: fs.FileSystem, folder: str, infos: list[fs.FileInfo]) -> list[tuple[dict, str, int]]:
        """The files below ``folder`` that pass the filters, in the order of their paths."""
        found = []
        for x in infos:
            hidden = any(p[:1] in "._" for p in x.path[len(folder) :].split("/") if p)
            held = None if hidden or not x.is_file else named(x.base_name)
            if held and all(passes(held, f) for f in self.filters):
                found.append((held, x.path, x.size))
        return sorted(found, key=lambda x: x[1])

    def partitions(self) -> list[Part]:
        """The files that pass the filters, dealt by size; many folders are dealt as they are."""
        store, root = opened(self.options["path"])
        infos = store.get_file_info(fs.FileSelector(root))
        folders = sorted(x.path for x in infos if not x.is_file and x.base_name[:1] not in "._")
        if len(folders) < FOLDERS:
            infos, folders = store.get_file_info(fs.FileSelector(root, recursive=True)), []
        each = max(1, min(PART_FILES, len(folders) // FOLDERS))
        parts, size = [Part([], folders[i : i + each]) for i in range(0, len(folders), each)] + [Part([], [])], 0
        for file in self._listed(store, root, infos):
            if size + file[2] > PART_BYTES or len(parts[-1].files) >= PART_FILES:
                parts, size = [*parts, Part([], [])] if parts[-1].files else parts, 0
            parts[-1].files.append(file)
            size += file[2]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.options["path"])
        names = ["stem", "page", "ext", "path", "size", "text"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows, held_bytes = [], 0
        below = (x for f in partition.folders for x in self._listed(store, f, store.get_file_info(fs.FileSelector(f, recursive=True))))
        for held, path, size in (x for files in (partition.files, below) for x in files):
            with store.open_input_stream(path) as stream:
                text = stream.readall().decode("utf-8", "replace")
            rows.append((held["stem"], held["page"], held["ext"], path, size, text))
            held_bytes += len(text)
            if len(rows) >= PART_FILES or held_bytes >= PART_BYTES:
                yield batch(rows)
                rows, held_bytes = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder; the names of its files, by number, lie in it."""

    folder: str


NAMES, TASKS = "names.json", "tasks.json"


def put(store: fs.FileSystem, path: str, held: list) -> None:
    with store.open_output_stream(path) as out:
        out.write(json.dumps(held).encode())


def got(store: fs.FileSystem, path: str) -> list:
    with store.open_input_stream(path) as stream:
        return json.loads(stream.readall())


def staged(store: fs.FileSystem, root: str, folder: str) -> tuple[list[str], list[str]]:
    """Where a task's files are and where they go."""
    names = got(store, f"{root}/{folder}/{NAMES}")
    return [f"{root}/{folder}/{k}" for k in range(len(names))], [f"{root}/{x}" for x in names]


def moved(store: fs.FileSystem, source: str, target: str) -> None:
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    try:
        store.move(source, target)
    except FileNotFoundError:  # an earlier try of this task moved it
        if store.get_file_info(target).type != fs.FileType.File:
            raise


def emptied(store: fs.FileSystem, root: str) -> None:
    """Delete what earlier writes left at ``root``."""
    for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if x.base_name.endswith("_output") and not x.is_file:
            store.delete_dir(x.path)


SAME, THERE = "two rows have one file's name: tell their stems apart with apart()", "a file of that name is there already"


class Writer(DataSourceWriter):
    """One file for each row; the staging folder's name is told to the tasks with the writer.

    With the option ``staging``, that folder's name, the commit leaves the files there and says which tasks' are whole.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.staging = self.options.get("staging") or f"_staging-{uuid.uuid4().hex}"
        store, root = opened(self.options["path"])
        store.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.options["path"])
        folder, names = f"{self.staging}/{uuid.uuid4().hex}", []
        mine = f"{root}/{folder}"
        store.create_dir(mine, recursive=False)  # fails once the job has been given up
        try:
            for row in iterator:
                if not row.stem or "/" in row.stem or row.stem in (".", "..") or "/" in (row.suffix or "") or "/" in row.ext:
                    raise ValueError(f"no name for a file: {row.stem!r}, {row.suffix!r}, {row.ext!r}")
                with store.open_output_stream(f"{mine}/{len(names)}") as out:
                    out.write((row.text or "").encode())
                names.append(f"{row.stem}_output/{row.stem}{'_' + row.suffix if row.suffix else ''}.{row.ext}")
            put(store, f"{mine}/{NAMES}", names)
        except BaseException:
            if store.get_file_info(mine).type != fs.FileType.NotFound:
                store.delete_dir(mine)
            raise
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.options["path"])
        folders = [m.folder for m in messages if m]
        if "staging" in self.options:
            return put(store, f"{root}/{self.staging}/{TASKS}", folders)
        try:
            pairs = [x for f in folders for x in zip(*staged(store, root, f))]
            targets = [x[1] for x in pairs]
            if len(set(targets)) < len(targets):
                raise ValueError(SAME)
            if self.overwrite:
                emptied(store, root)
            elif any(x.type != fs.FileType.NotFound for x in store.get_file_info(targets)):
                raise FileExistsError(THERE)
            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(lambda x: moved(store, *x), pairs))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.options["path"])
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class DocumentFiles(DataSource):
    """Option ``path``: the folder. Rows read are as in ``READ``, rows written as in ``WRITTEN``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known and filters sent to it."""
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format(FORMAT).option("path", path).load()


def lines(files: DataFrame) -> DataFrame:
    """(stem, page, path, seq, value): a file's lines, as the parsers of dumps and JSON lines take them."""
    return files.select("stem", "page", "path", F.posexplode(F.split("text", "\r?\n", -1)).alias("seq", "value"))


def apart(docs: DataFrame, stem: str, key: str) -> DataFrame:
    """``docs`` with stems that repeat told apart by their key: ``stem-key``; equal keys and stems still meet."""
    many = docs.groupBy(stem).agg(F.count("*").alias("_n")).where("_n > 1").select(stem, F.lit(True).alias("_many"))
    told = F.when(F.col("_many"), F.concat_ws("-", F.col(stem), F.col(key).cast("string"))).otherwise(F.col(stem))
    return docs.join(many, stem, "left").withColumn(stem, told).select(*docs.columns)


def write(rows: DataFrame, path: str, ext: str | Column, mode: str = "append") -> None:
    """Write (stem, text) and, if it is there, suffix: a file each. A name that is there already is an error unless ``mode`` is overwrite.

    Names are compared and files are moved by tasks; the driver sees a name for each task.
    """
    ext = F.lit(ext) if isinstance(ext, str) else ext
    suffix = F.col("suffix") if "suffix" in rows.columns else F.lit(None).cast("string")
    spark, staging = registered(rows.sparkSession), f"_staging-{uuid.uuid4().hex}"
    store, root = opened(path)
    try:
        rows.select("stem", suffix.alias("suffix"), ext.alias("ext"), "text").write.format(FORMAT).mode("append").option("path", path).option("staging", staging).save()
        folders = got(store, f"{root}/{staging}/{TASKS}")
        if not folders:
            if mode == "overwrite":
                emptied(store, root)
            return
        tasks = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders), "folder")

        def told(batches):
            store, root = opened(path)
            for batch in batches:
                for f in batch.column("folder").to_pylist():
                    targets = staged(store, root, f)[1]
                    there = [x.type != fs.FileType.NotFound for x in store.get_file_info(targets)]
                    yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(there, pa.bool_())], ["target", "there"])

        def moving(batches):
            store, root = opened(path)
            for batch in batches:
                for f in batch.column("folder").to_pylist():
                    for pair in zip(*staged(store, root, f)):
                        moved(store, *pair)
                yield batch

        names = tasks.mapInArrow(told, "target string, there boolean")
        most, there = names.groupBy("target").agg(F.count("*").alias("n"), F.max("there").alias("there")).agg(F.max("n"), F.max("there")).first()
        if (most or 0) > 1:
            raise ValueError(SAME)
        if mode == "overwrite":
            emptied(store, root)
        elif there:
            raise FileExistsError(THERE)
        tasks.mapInArrow(moving, "folder string").write.format("noop").mode("overwrite").save()
    finally:
        if store.get_file_info(f"{root}/{staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{staging}")
