"""WARC archives of pages, and their external index by loser-tree merging.

Each task writes the records of its pages as archive files of a bounded count of
bytes; the captures of one file, sorted by URL key and timestamp, are a run.
All writing and reading goes through Spark, so archives can lie in any store,
and payloads go from the pages to the archives without a shuffle. The index
deals the runs out by range of (URL key, timestamp, page), which splits a URL key
of any size, and each task merges its slices of the runs with a loser tree: as
many ranges as the count of captures asks for, so a task's slice has a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST, looked_up, removed, saved, shared_path

CRLF = "\r\n"
LEAST = 100  # bytes of a payload that can be revisited
FILE_BYTES = 32 << 20  # of records in an archive file; a larger record has a file of its own
SPAN = 1_000_000_000  # seconds over which capture times are dealt out
SLICE = 200_000  # index rows of a merging task
INDEX = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string,"
    " archive string, record_offset long, record_length long"
)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query, lower case, no scheme, fragment, port or www."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(plain, "#.*$", ""), "^[a-z][a-z0-9+.-]*://(www[0-9]*\\.)?", "")
    host = F.regexp_replace(F.regexp_extract(plain, "^([^/?]*)", 1), ":[0-9]+$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_replace(plain, "^[^/?]*", ""))


def records(pages: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Pages with what their records say: payload, its size and digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("string")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    first = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Digests that repeat, with the rows they have: the most common ones are broadcast, and without others nothing is shuffled.
    first = saved(first.where("n > 1"))
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return looked_up(base, first, "payload_digest", "n", "left", most).select(
        *base.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def captured(start: str = "2024-01-01", span: int = SPAN) -> Column:
    """A page's capture time: ``start`` and a second for each page id, counted round after ``span`` seconds."""
    seconds = F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(span))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write(recorded: DataFrame, path: str, file_bytes: int = FILE_BYTES, start: str = "2024-01-01", span: int = SPAN) -> None:
    """Archive files at ``path`` of about ``file_bytes`` at most, or one record.

    Records fall in classes by the power of four that bounds their bytes; a
    task's n-th row is in part n * bound / file_bytes of its class, so a part
    has file_bytes / bound records at most, and each part is a file of a task.
    """
    safe = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    at = captured(start, span)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), "record_type", F.lit(CRLF + "WARC-Record-ID: <urn:x-page:"), name, F.lit(">" + CRLF + "WARC-Date: "), at,
        F.lit(CRLF + "WARC-Target-URI: "), safe, F.lit(CRLF + "X-URL-Key: "), F.regexp_replace(url_key(F.col("url")), r"[\x00-\x20\x7F]", "%20"),
        F.lit(CRLF + "WARC-Payload-Digest: sha256:"), "payload_digest", F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF),
        F.when(
            F.col("record_type") == "revisit",
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: <urn:x-page:"),
                F.col("refers_to").cast("string"), F.lit(">" + CRLF),
            ),
        ).otherwise(""),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    size = F.octet_length("value")
    bound = F.greatest(F.lit(1 << 16), F.pow(F.lit(4.0), F.ceil(F.log(4.0, size.cast("double")))).cast("long"))
    rows = recorded.select(head.alias("value"), row.alias("row")).select("value", bound.alias("bound"), F.floor(F.col("row") * bound / file_bytes).alias("part"))
    rows.write.partitionBy("bound", "part").option("lineSep", CRLF + CRLF).text(path)


FIELD = re.compile(rb"([A-Za-z0-9-]+): ?(.*?)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int, int]]:
    """(headers, record offset, record length, payload start, payload stop) of an archive's records."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        stop = data.index(b"\r\n\r\n", at) + 2
        headers = {m[1].decode().lower(): m[2].decode("utf-8", "replace") for m in FIELD.finditer(data, data.index(b"\r\n", at) + 2, stop)}
        start = stop + 2
        end = start + int(headers["content-length"])
        body = data.index(b"\r\n\r\n", start, end) + 4
        headers |= {"http-" + m[1].decode().lower(): m[2].decode() for m in FIELD.finditer(data, data.index(b"\r\n", start) + 2, body - 2)}
        yield headers, at, end - at, body, end
        at = end + 4


def _arrow(kind: str) -> pa.Schema:
    return pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in kind.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all records in the archives at ``path``, each file's in order, a run; payloads are measured, not believed."""

    def page(urn: str) -> int | None:
        value = urn.rpartition(":")[2].rstrip(">")
        return None if value == "null" else int(value)

    schema = _arrow(INDEX)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, data, file = [], batch.column(1)[k].as_py(), batch.column(0)[k].as_py()
                view = memoryview(data)
                for h, at, size, body, end in parse(data):
                    full = h["warc-type"] == "response"
                    rows.append(
                        (
                            page(h["warc-record-id"]), end - body if full else int(h["http-content-length"]),
                            hashlib.sha256(view[body:end]).hexdigest() if full else h["warc-payload-digest"].removeprefix("sha256:"),
                            h["warc-type"], None if full else page(h["warc-refers-to"]), h["x-url-key"], h["warc-date"], file, at, size,
                        )
                    )
                rows.sort(key=lambda r: (*in_order(r[5], r[6], r[0]), r[8]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


def in_order(key: str, at: str, page: int | None) -> tuple:
    """Order of captures; a null page comes first, as in Spark."""
    return key, at, page is not None, page or 0


class LoserTree:
    """Merge of sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i, True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.key(x), a) < (self.key(y), b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:  # waits for the other side of this match
                self.losers[node] = winner
                return
            if other >= 0 and self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (row := self.heads[w := self.losers[0]]) is not None:
            yield row
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merged(index: DataFrame, rows: int = SLICE) -> DataFrame:
    """The index in global order, with ``history``, a capture's place from 1: it rises with URL key, timestamp and page.

    ``index`` is at rest. A task merges about ``rows`` captures, whatever their count.
    """
    order = ["url_key", "captured", "page_id"]
    ranges = max(1, -(-index.count() // rows))
    dealt = index.repartitionByRange(ranges, *order, "archive", "record_offset")
    kind = INDEX + ", task int, place long"
    schema = _arrow(INDEX).append(pa.field("task", pa.int32())).append(pa.field("place", pa.int64()))

    def run(batches):
        held = pa.Table.from_batches(batches, _arrow(INDEX)).combine_chunks()
        keys = [held.column(c).to_pylist() for c in (*order, "archive", "record_offset")]
        runs: dict[str, list] = {}
        for k, (key, at, page, archive, offset) in enumerate(zip(*keys)):
            runs.setdefault(archive, []).append((*in_order(key, at, page), archive, offset, k))
        # A run mostly comes as it lies in its archive's index, in order: then this is one look at it.
        tree = LoserTree([iter(sorted(x)) for x in runs.values()], lambda r: r)
        ahead = [r[-1] for r in tree]
        task = TaskContext.get().partitionId()
        held = held.take(pa.array(ahead, pa.int64())) if ahead else held
        held = held.append_column("task", pa.array([task] * len(ahead), pa.int32())).append_column("place", pa.array(range(1, len(ahead) + 1), pa.int64()))
        yield from held.cast(schema).to_batches(8192)

    out = saved(dealt.mapInArrow(run, kind))
    # What lies before a task's slice: a row for each task.
    sizes = sorted(map(tuple, out.groupBy("task").count().collect()))
    ends = accumulate((n for _, n in sizes), initial=0)
    before = index.sparkSession.createDataFrame([(task, end) for (task, _), end in zip(sizes, ends)], "task int, before long")
    return out.join(F.broadcast(before), "task").select(*(x.split()[0] for x in INDEX.split(", ")), (F.col("before") + F.col("place")).alias("history"))


def round_trip(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Archive ``pages`` at ``path`` and give the captures' history as read back, a row for each page.

    A null html is an empty payload. Equal payloads of ``least`` bytes or more
    revisit the one of the smallest page_id; rows that repeat that id too are
    responses, and so are null ids where no row has one. Other columns are not
    read. An empty table writes no record and gives no rows.
    """
    spark = pages.sparkSession
    write(records(pages, least), path)
    return merged(saved(read(spark, path)))


def histories(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``round_trip`` by way of archives that are deleted once they are read."""
    path = shared_path(pages.sparkSession, "warc")
    try:
        return round_trip(pages, path, least)
    finally:
        removed(pages.sparkSession, path)
