"""Substring dedup by paragraph MinHash banding.

Texts are cut at line ends and at every sentence end, whatever stands around, so
the sentences of a passage are cut alike wherever it stands; only where it starts
or stops within a sentence are words of others glued to it. Copies of a passage
are one node by hash. Distinct ones meet where a band of their MinHash values is equal;
each is verified against the least of its bucket by exact Jaccard similarity of
word shingles, and where one fails there, against the whole bucket in tiles.
Components of verified links are the classes; a class found in two places is
repeated text, and all but its first place is for removal.

One pass over the documents writes places, nodes and bands to the shared folder;
buckets, classes and stretches come from there. A second pass makes shingle sets
of the passages that are to be verified. Sieves, bitmaps of a size that follows
the count of what is wanted up to a bound, thin out what a join reads; joins after
them are exact, so they bound what is shuffled, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST, Store, components, looked_up, passes, sieve, tuples
from .packing import blocks


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` values by which a pair at the threshold meets with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


_random = np.random.default_rng(5)
LETTERS = _random.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
PLACES = _random.integers(1, 1 << 63, 1 << 16, np.uint64) | np.uint64(1)
SPACE, STOP = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STOP[list(b".!?")] = True
LETTERS[SPACE] = 0


class Batch:
    """Passages of a run of texts, hashed together, every word in one passage, a sentence or the rest of a line.

    All is done on the texts' bytes in lower case, which has the code points of
    the texts one by one: ``ids``, ``no``, ``start`` and ``stop`` say where a
    passage is, in code points, ``keys`` what it is, and ``hashes`` has its words'.
    """

    def __init__(self, ids: pa.Array, texts: pa.Array, size: int, chunk: int = 1 << 20):
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, n = ends - ends[0], int(ends[-1] - ends[0])
        # A piece ends with a line, with the marks that end a sentence, and with a text.
        line, stop = data == 10, STOP[data]
        last = line | stop & ~np.append(stop[1:] | line[1:], False)
        last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
        space = SPACE[data]
        first = ~space & np.append(True, space[:-1] | last[:-1])[:n]
        at = np.flatnonzero(first)  # of words
        stops = np.flatnonzero(last) + 1  # of pieces
        piece = np.searchsorted(stops, at, "right")
        count = np.bincount(piece, minlength=len(stops)) if len(stops) else np.zeros(0, int)
        some = np.flatnonzero(count)
        starts = np.append(0, stops[:-1])[some] if len(stops) else some
        stops, self.counts = stops[some], count[some]
        self.doc = np.searchsorted(ends[1:], starts, "right")
        self.no = np.arange(len(some)) - np.searchsorted(self.doc, self.doc)
        letters = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
        self.start, self.stop = (letters[x] - letters[ends[self.doc]] for x in (starts, stops))
        self.ends = np.cumsum(self.counts)
        self.ids = ids.take(pa.array(self.doc))
        self.begins = self.ends - self.counts
        self.hashes, self.size = self._words(data, at, chunk), size
        # The whole sequence's hash, place by place.
        h = self.hashes
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(self.begins, self.counts).astype(np.uint64)
        whole = np.add.reduceat(_mix(h + _mix(place + np.uint64(1))), self.begins) if len(h) else np.zeros(0, np.uint64)
        self.keys = _mix(whole + self.counts.astype(np.uint64))

    @staticmethod
    def _words(data: np.ndarray, at: np.ndarray, chunk: int) -> np.ndarray:
        """Hashes of the words that start ``at``; white space counts as nothing."""
        out, k, n = np.zeros(len(at), np.uint64), 0, len(at)
        while k < n:
            j = max(k + 1, int(np.searchsorted(at, at[k] + chunk)))
            a, b = at[k], at[j] if j < n else len(data)
            lengths = np.diff(np.append(at[k:j], b))
            place = np.arange(b - a) - np.repeat(at[k:j] - a, lengths)
            out[k:j] = np.add.reduceat(LETTERS[data[a:b]] * PLACES[place & 0xFFFF], at[k:j] - a)
            k = j
        return _mix(out)

    def shingled(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, where each passage's start); a passage shorter than a shingle is one shingle, its own hash."""
        h, size = self.hashes, self.size
        mixed = h.copy()
        for k in range(1, min(size, len(h))):  # a shingle that would cross a passage's end is dropped below
            mixed[: len(h) - k] = _mix(mixed[: len(h) - k]) + h[k:]
        n = np.maximum(1, self.counts - size + 1)
        first = np.cumsum(n) - n
        shingles = _mix(mixed[np.arange(n.sum()) - np.repeat(first - self.begins, n)]) if len(h) else mixed
        short = self.counts < size
        shingles[first[short]] = self.keys[short]
        return shingles, first

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """An array (passages, bands) of bucket keys."""
        seeds = np.random.default_rng(17).integers(1, 1 << 63, bands * rows, np.uint64)
        out = np.zeros((len(self.keys), bands), np.uint64)
        if not len(out):
            return out
        shingles, first = self.shingled()
        for k, seed in enumerate(seeds):
            least = np.minimum.reduceat(_mix(shingles ^ seed), first)
            out[:, k // rows] = _mix(out[:, k // rows] + least + np.uint64(k))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sifted(df: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose ``column`` the sieve lets through."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(at).to_numpy().view(np.uint64))))

    return df.mapInArrow(run, df.schema)


class Source:
    """Passes over the documents, each for what its step needs."""

    def __init__(self, docs: DataFrame, size: int, bands: int, rows: int, threshold: float):
        self.keys = ["doc_id", *(c for c in docs.columns if c == "of_text")]
        self.docs = docs.select("text", *(F.col(c).cast("long") for c in self.keys))
        self.size, self.bands, self.rows, self.threshold = size, bands, rows, threshold

    def _run(self, emit, schema: str) -> DataFrame:
        size = self.size

        def run(batches):
            seen = set()
            for batch in batches:
                texts = batch.column(0)
                for i, j in blocks(texts, 1 << 20):
                    made = Batch(batch.column(1)[i:j], texts[i:j], size)
                    if len(made.keys):
                        yield emit(made, [c[i:j] for c in batch.columns[2:]], seen)

        return self.docs.mapInArrow(run, schema)

    def passages(self) -> DataFrame:
        """The documents' keys, and (no, start, stop, n_words, node, bands) of all passages, bands being their bucket keys."""
        bands, rows, names = self.bands, self.rows, self.keys
        few = self.threshold / (1 - self.threshold) - 1e-6 if self.threshold < 1 else np.inf

        def emit(b, own, seen):
            keys, of = b.bands(bands, rows), pa.array(b.doc)
            # Sets of under ``few`` shingles reach the threshold with equal sets only, and those meet in any band.
            on = (b.counts - b.size + 1 >= few)[:, None] | (np.arange(bands) == 0)
            held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(on.sum(1))), pa.int32()), pa.array(keys[on].view(np.int64)))
            columns = [b.ids, *(c.take(of) for c in own), *(pa.array(x, pa.int32()) for x in (b.no, b.start, b.stop, b.counts)), pa.array(b.keys.view(np.int64)), held]
            return pa.RecordBatch.from_arrays(columns, [*names, "no", "start", "stop", "n_words", "node", "bands"])

        return self._run(emit, "".join(f"{c} long, " for c in names) + "no int, start int, stop int, n_words int, node long, bands array<long>")

    def shingles(self, bitmap) -> DataFrame:
        """(node, shingles) of passages that the sieve lets through; repeats within a task mostly once."""
        shared = self.docs.sparkSession.sparkContext.broadcast(bitmap)

        def emit(b, own, seen):
            if len(seen) > 200_000:
                seen.clear()
            keep = []
            for i in np.flatnonzero(passes(shared.value, b.keys)).tolist():
                node = int(b.keys[i])
                if node not in seen:
                    seen.add(node)
                    keep.append(i)
            shingles, first = b.shingled()
            ends = np.append(first[1:], len(shingles))
            sets = [np.unique(shingles[first[i] : ends[i]]).view(np.int64) for i in keep]
            return pa.RecordBatch.from_arrays([pa.array(b.keys[keep].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

        return self._run(emit, "node long, shingles array<long>")


def _members(passages: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(bucket, node) of what the sieve lets through, repeats included."""
    shared = passages.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            bands = batch.column(1)
            nodes = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(bands).to_numpy())
            keys = bands.flatten().to_numpy()
            on = passes(shared.value, keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(nodes[on])], ["bucket", "node"])

    return passages.select("node", "bands").mapInArrow(run, "bucket long, node long")


SIMILARITY = "size(array_intersect(a, b)) / (size(a) + size(b) - size(array_intersect(a, b)))"


def verified(source: Source, passages: DataFrame, store: Store, tile: int = 256) -> DataFrame:
    """Links (u, v) of distinct passages at the threshold; they connect what all links found by the bands connect."""
    spark, threshold = source.docs.sparkSession, source.threshold
    met = passages.select("node", F.explode("bands").alias("bucket")).groupBy("bucket")
    met = store(met.agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most").select("bucket", "least", "n"))
    # Repeats go before the join, in partial aggregates: then a common passage is one row of its buckets.
    members = looked_up(store(_members(passages, sieve(met, "bucket")).distinct()), met, "bucket", "n")
    members = store(members.where("node != least").select("bucket", "node", "least"))
    star = store(members.select("node", "least").distinct())
    wanted = store(star.select("node").unionByName(star.select(F.col("least").alias("node"))).distinct())
    sets = source.shingles(sieve(wanted, "node")).groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = store(sets.join(wanted, "node", "left_semi"))
    # A least passage meets as many members as its buckets have: its set goes out once for every ``tile`` of them.
    fans = store(star.groupBy("least").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / tile)))
    star = looked_up(star, fans, "least", "n").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    b = fans.join(sets.withColumnRenamed("node", "least"), "least").select("least", F.col("shingles").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    star = star.join(sets.select("node", F.col("shingles").alias("a")), "node").join(b, ["least", "part"])
    star = store(star.select("node", "least", (F.expr(SIMILARITY) >= threshold).alias("good")))
    links = star.where("good").select(F.col("node").alias("u"), F.col("least").alias("v"))
    # A member that its bucket's least one does not link may link another member: those buckets are compared in tiles.
    failed = members.join(star.where("not good"), ["node", "least"], "left_semi").select("bucket", "node").withColumn("failed", F.lit(True))
    open_buckets = members.groupBy("bucket").agg((F.count("*") + 1).alias("n")).where("n > 2")
    open_buckets = store(open_buckets.join(failed.select("bucket").distinct(), "bucket", "left_semi").withColumn("parts", F.ceil(F.col("n") / tile)))
    if open_buckets.isEmpty():
        return links
    rows = (
        members.join(open_buckets, "bucket")
        .join(failed, ["bucket", "node"], "left")
        .select("bucket", "parts", "node", F.coalesce("failed", F.lit(False)).alias("failed"), F.pmod(F.xxhash64("node"), "parts").alias("part"))
        .join(sets, "node")
    )
    tiles = store(rows.groupBy("bucket", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("node", "failed", "shingles")).alias("held")))
    left = tiles.where("exists(held, x -> x.failed)").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = left.select("bucket", "other", F.col("held").alias("mine")).join(tiles.select("bucket", F.col("part").alias("other"), "held"), ["bucket", "other"])

    def compare(batches):
        for batch in batches:
            for mine, held in zip(*tuples(batch, "mine", "held")):
                # A spanning forest: what is connected already is not compared again.
                root = {x["node"]: x["node"] for x in [*mine, *held]}

                def find(n):
                    while root[n] != n:
                        root[n] = n = root[root[n]]
                    return n

                u, v = [], []
                others = [(y["node"], set(y["shingles"])) for y in held]
                for x in mine:
                    if x["failed"]:
                        s = set(x["shingles"])
                        for node, t in others:
                            if find(node) != find(x["node"]):
                                both = len(s & t)
                                if both >= threshold * (len(s) + len(t) - both):
                                    root[find(node)] = find(x["node"])
                                    u.append(x["node"])
                                    v.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    more = pairs.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(compare, "u long, v long")
    return links.unionByName(more)


def _told_apart(docs: DataFrame, store: Store, most: int = MOST) -> DataFrame:
    """(doc_id, text) of rows with an id and, if ids repeat, of_text: the text's hash where the id has other rows, else 0.

    Rows alike in id and text are one document, rows of one id with other texts are several.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = store(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= most else again
    many = rows.join(again, "doc_id", "left_semi").withColumn("of_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(again, "doc_id", "left_anti").withColumn("of_text", F.lit(0).cast("long")).unionByName(store(many.dropDuplicates(["doc_id", "of_text"])))


def repeated(docs: DataFrame, run_words: int = 25, size: int = 5, threshold: float = 0.8, rows: int = 2, recall: float = 0.99) -> DataFrame:
    """Repeated stretches: (doc_id, start, stop, n_words, class_id, remove, of_text), start and stop in code points.

    A run of a document's passages that all stand in another place too (another
    document, or the same one elsewhere in its text) is told if it
    has ``run_words`` words at least together. Its rows are parts of it: passages
    whose classes stand side by side, in this order, in every place told are one
    part, others are parts of their own, so a part may have fewer words. Equal
    parts have the same class_id, that of their first passage; remove says that
    the part has an earlier place, in order of (doc_id, of_text, position). Null and
    wordless texts have no passages, null ids no place. Rows that repeat an id and
    a text are one document; rows that repeat an id with other texts are documents of
    their own, told apart by of_text, their texts' hash, which is 0 for all
    others. Other columns are not read. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "substring")
    source = Source(_told_apart(docs, store), size, bands_for(threshold, rows, recall), rows, threshold)
    keys = source.keys
    me = F.col("doc_id") if len(keys) == 1 else F.struct(*keys)
    passages = store(source.passages())
    classes = components(verified(source, passages, store), "u", "v", store=store).withColumnRenamed("component", "class_id")
    nodes = passages.groupBy("node").agg(F.min(me).alias("first"), F.count("*").alias("n"))
    nodes = nodes.join(classes, "node", "left").where("n > 1 or class_id is not null")
    nodes = store(nodes.withColumn("class_id", F.coalesce("class_id", "node")))
    spread = store(nodes.groupBy("class_id").agg(F.min("first").alias("first"), F.sum("n").alias("all"), F.count("*").alias("of")).where("all > 1"))
    shared = store(looked_up(nodes.select("node", "class_id", "n"), spread.select("class_id", "first", "of"), "class_id", "of"))
    found = store(sifted(passages.drop("bands"), "node", sieve(shared, "node")))
    # Dealt once, by document: what follows has its rows together already.
    found = looked_up(found, shared, "node", "n").repartition(*keys)
    found = found.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(*keys).orderBy("no")))
    of_run = Window.partitionBy(*keys, "run").orderBy("no")
    whole_run = of_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumns({"told": F.sum("n_words").over(whole_run) >= run_words, "before": F.lag("class_id").over(of_run), "after": F.lead("class_id").over(of_run)})
    found = found.withColumns({c: F.when(F.col("told"), F.col(c)) for c in ("before", "after")})
    found = store(found)
    # What stands in front of a class, or after it, in all places told; null if that differs or is nothing.
    told = F.count(F.when(F.col("told"), 1))
    only = lambda c: F.when((F.count(c) == told) & (F.min(c) == F.max(c)), F.min(c))
    first_no = F.min(F.when(me == F.col("first"), F.col("no")))
    ways = found.groupBy("class_id").agg(only("before").alias("only_before"), only("after").alias("only_after"), first_no.alias("first_no"), F.count("*").alias("n"))
    told = looked_up(found.where("told").drop("before", "after", "told"), store(ways), "class_id", "n")
    ahead = lambda c: F.lag(c).over(of_run)
    # Two neighbours stay together if they do so in every place, their first ones included.
    joined = (
        (F.col("only_before") == ahead("class_id")) & (ahead("only_after") == F.col("class_id")) & (ahead("first") == F.col("first")) & (ahead("first_no") + 1 == F.col("first_no"))
    )
    told = told.withColumn("starts", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("part", F.sum("starts").over(of_run))
    later = (me > F.col("first")) | (F.col("no") > F.col("first_no"))
    parts = told.groupBy(*keys, "run", "part").agg(
        F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"), F.sum("n_words").alias("n_words"),
        F.min_by("class_id", "no").alias("class_id"), F.min(later).alias("remove"),
    )
    of_text = F.col("of_text") if "of_text" in keys else F.lit(0).cast("long")
    parts = parts.select("doc_id", "start", "stop", "n_words", "class_id", "remove", of_text.alias("of_text"))
    parts = Store(docs.sparkSession, "repeated")(parts)
    store.close()
    return parts


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with stretches for removal cut out of text and n_chars made to fit; all rows and columns stay.

    Null and empty texts, and texts without a stretch, stay as they are; rows
    without an id are never cut. Of rows that repeat an id each is cut by its own text's stretches. An empty table stays empty.
    """
    spans = repeated(docs, **options).where("remove").groupBy("doc_id", "of_text").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_cut"))
    kept = """concat(substr(text, 1, cast(_cut[0].start as int)), array_join(transform(_cut, (x, i) ->
        substr(text, cast(x.stop + 1 as int), cast(coalesce(get(_cut, i + 1).start, length(text)) - x.stop as int))), ''))"""
    out = docs.join(spans.where("of_text = 0").drop("of_text"), "doc_id", "left")
    others = spans.where("of_text <> 0").select("doc_id", F.col("of_text").alias("_of"), F.col("_cut").alias("_other"))
    if not others.isEmpty():  # rows that repeat an id: each text by its own stretches
        out = out.withColumn("_of", F.xxhash64(F.coalesce("text", F.lit("")))).join(others, ["doc_id", "_of"], "left").withColumn("_cut", F.coalesce("_cut", "_other"))
    out = out.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.expr(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
