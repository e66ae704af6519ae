"""Benchmark decontamination by template windows and slot consistency.

Numbers, names and units become typed placeholders, so that an item and a
re-parameterised copy have the same template. Hashes of a document's template
windows are joined with those of the items; an item whose windows a stretch of
the document holds at the threshold or above is a candidate, and its slots are
then paired: the same value in the item has to stand against the same value in
the document.

The documents are read once whatever the benchmark's size: a sieve of bounded
size lets through the windows that items may have. A document that holds enough
of an item's windows has one of any few of them, so candidates come from the
item's rarest ones, and common phrases of a benchmark join nothing by themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MOST, Store, looked_up, passes, sieve, tuples

#: Units of measure that follow a number.
UNITS = frozenset(
    b"% cm dm ft g gb ghz h hz kb kg khz km km/h kwh l lb lbs m mb mg mhz mi min ml mm mph ms oz s sec tb w"
    b" cents day days dollars euros feet foot gram grams hour hours inch inches kilograms kilometers kilometres litres liters meters metres"
    b" miles minute minutes month months percent pounds second seconds week weeks yard yards year years".split()
)
NUMBER = re.compile(rb"[+-]?[0-9][0-9.,:/]*")
MEASURE = re.compile(rb"([+-]?[0-9][0-9.,:/]*)([a-z%][a-z/%]*)")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"
ENDS, NUM, NAME, UNIT = 1, 2, 4, 8  # flags of a word; ENDS: it ends a sentence
NOTHING = 16
SLOTS = np.uint64([0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D])  # hashes of the placeholders
FACTORS = np.uint64([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5])


class Words(dict):
    """Bounded memo of words: 56 bits of the canonical form's hash, then flags."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        core = word.decode("utf-8", "replace").strip(EDGE)
        flags = ENDS if word.rstrip(b"\"')]}*#$&%")[-1:] in (b".", b"!", b"?", b":") else 0
        low = core.lower().encode()
        if not core:
            flags |= NOTHING
            if word == b"%":
                flags = UNIT
        elif NUMBER.fullmatch(low) or (m := MEASURE.fullmatch(low)) and m[2] in UNITS:
            flags |= NUM
        elif low in UNITS:
            flags |= UNIT
        elif core[:1].isupper() and core[1:].islower():
            flags |= NAME
        found = self[word] = xxhash.xxh64_intdigest(low, 3) >> 8 << 8 | flags
        return found

    def canonical(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template hashes, plain hashes, which are slots) of the text's words; words of punctuation alone are left out."""
        words = (text or b"").split()
        if len(self) > self.most:
            self.clear()
        both = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        both = both[both & np.uint64(NOTHING) == 0]
        flags, plain = (both & np.uint64(255)).astype(np.uint8), both >> np.uint64(8)
        ends = np.append(True, (flags[:-1] & ENDS) > 0)[: len(flags)]
        number = flags & NUM > 0
        name = (flags & NAME > 0) & ~ends  # a sentence's first word is upper case whatever it is
        unit = (flags & UNIT > 0) & np.append(False, number[:-1])[: len(flags)]
        template = plain.copy()
        for slot, on in zip(SLOTS, (number, name, unit)):
            template[on] = slot
        return template, plain, number | name | unit


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        x = tokens[k : k + n] + np.uint64(k + 1)
        x = (x ^ x >> np.uint64(29)) * FACTORS[k % len(FACTORS)] + np.uint64(k)
        total = (total ^ x) * FACTORS[3]
    return total ^ total >> np.uint64(32)


def _paired(i, d, shift: int, width: int, original: np.ndarray, plain: dict[int, int]) -> list[tuple[int, int]]:
    """(item word, document word) of matched windows, one to one: nearest the shift first, then equal words."""
    near = sorted({(abs(int(b) - int(a) - shift), original[int(a) + j] != plain[int(b) + j], int(a) + j, int(b) + j) for a, b in zip(i, d) for j in range(width)})
    pairs, used = {}, set()
    for _, _, a, b in near:
        if a not in pairs and b not in used:
            pairs[a] = b
            used.add(b)
    return sorted(pairs.items())


ITEMS = "item long, item_id long, width int, at int, total int, hash long"
WINDOWS = "doc long, doc_id long, hash long, at int, plain array<long>"
LEAKS = "doc_id long, item_id long, containment double, n_windows long, n_matched long, n_slots long, n_consistent long, verbatim boolean, first_word long, last_word long"


def _telling(text: bytes | None, words: Words, size: int):
    """(plain hashes, slots, width, places of windows that count, their hashes by form); None for a text without any.

    Windows that are slots but for one word tell nothing and do not count.
    """
    template, plain, slots = words.canonical(text)
    width = min(size, len(plain))
    if not width:
        return None
    telling = np.convolve(~slots, np.ones(width, int), "valid") >= min(2, width)
    if not telling.any():
        return None
    # With names as words too: a copy in one case all through shows no names.
    caseless = np.where(template == SLOTS[1], plain, template)
    return plain, slots, width, np.flatnonzero(telling), [windows(form, width)[telling] for form in (template, caseless)]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text) of distinct rows; ``item`` tells them apart."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    return rows.select(F.xxhash64(F.coalesce("item_id", F.lit(-1)), "text").alias("item"), "item_id", "text")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """A row for each form of each window that counts, columns as in ``ITEMS``."""
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in ITEMS.split(", ")])

    def run(batches):
        words = Words()
        for batch in batches:
            for item, name, text in zip(*tuples(batch, "item", "item_id", "text")):
                held = _telling(text, words, size)
                if held:
                    _, _, width, at, forms = held
                    hashes, ats = np.concatenate(forms).view(np.int64), np.concatenate([at, at])
                    n = len(ats)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([item] * n, [name] * n, [width] * n, ats, [len(at)] * n, hashes), schema)], schema=schema)

    return items.mapInArrow(run, ITEMS).distinct()


def document_windows(docs: DataFrame, widths: list[int], bitmap: np.ndarray) -> DataFrame:
    """Windows of documents that the sieve lets through, columns as in ``WINDOWS``: their hash, place and plain words."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    text = F.col("text").cast("binary")
    keyed = docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def run(batches):
        words = Words()
        for batch in batches:
            rows, sizes, hashes, places, held = [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                template, plain, _ = words.canonical(text)
                for width in widths:
                    w = windows(template, width)
                    at = np.flatnonzero(passes(shared.value, w))
                    if len(at):
                        rows.append(np.full(len(at), k))
                        sizes.append(np.full(len(at), width))
                        hashes.append(w[at].view(np.int64))
                        places.append(at)
                        held.append(plain[at[:, None] + np.arange(width)].view(np.int64).ravel())
            if rows:
                of = pa.array(np.concatenate(rows))
                ends = np.append(0, np.cumsum(np.concatenate(sizes)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held)))
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places), pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "doc_id", "hash", "at", "plain"])

    return keyed.mapInArrow(run, WINDOWS)


class Pair:
    """One document and one item: matched windows by the document's place, without a list of all of them.

    ``d`` has the places in the document, ascending, ``of`` the number of each
    one's hash, ``ways`` the places of each hash in the item.
    """

    def __init__(self, d: np.ndarray, of: np.ndarray, ways: list[np.ndarray], plain: np.ndarray, original: np.ndarray, slots: np.ndarray, width: int, total: int):
        self.d, self.of, self.ways, self.plain = d, of, ways, plain
        self.original, self.slots, self.width, self.total = original, slots, width, total
        self.slack = max(width, len(original) // 4)
        self.seen: dict[bytes, tuple] = {}

    def matches(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shift, item place, number of the document's place) of matches with a shift in [low, high), by shift, then item place."""
        first, last = np.searchsorted(self.d, [low, high + len(self.original)])
        if first == last:
            return (np.zeros(0, np.int64),) * 3
        i = np.concatenate([self.ways[k] for k in self.of[first:last]])
        at = np.repeat(np.arange(first, last), [len(self.ways[k]) for k in self.of[first:last]])
        shift = self.d[at] - i
        on = (shift >= low) & (shift < high)
        shift, i, at = shift[on], i[on], at[on]
        order = np.lexsort((i, shift))
        return shift[order], i[order], at[order]

    def stretches(self, threshold: float, most: int = 1 << 20):
        """(matched, on, shift, item places, document places) of each shift around which enough windows match, matches with the same shifts once.

        Shifts come in blocks of about ``most`` matches, each with what lies ``slack`` around it.
        """
        each = max(1.0, float(np.mean([len(self.ways[k]) for k in self.of[:: max(1, len(self.of) // 1000)]])))
        step, start, end = max(64, int(most / each)), int(self.d[0]) - len(self.original), int(self.d[-1]) + 1
        while start < end:
            shift, i, at = self.matches(start - self.slack, start + step + self.slack)
            mine = np.unique(shift[(shift >= start) & (shift < start + step)])
            if not len(mine) and len(self.d):  # on to the next place
                after = np.searchsorted(self.d, start + step)
                start = max(start + step, int(self.d[after]) - len(self.original)) if after < len(self.d) else end
                continue
            lows, highs = np.searchsorted(shift, mine - self.slack), np.searchsorted(shift, mine + self.slack, "right")
            ons = np.searchsorted(shift, mine, "right") - np.searchsorted(shift, mine)
            counts, matched, a, b = np.zeros(len(self.original), np.int64), 0, 0, 0
            for s, low, high, on in zip(mine.tolist(), lows.tolist(), highs.tolist(), ons.tolist()):
                for k in range(b, high):
                    matched += counts[i[k]] == 0
                    counts[i[k]] += 1
                for k in range(a, low):
                    counts[i[k]] -= 1
                    matched -= counts[i[k]] == 0
                a, b = low, high
                if matched >= threshold * self.total:
                    yield int(matched), on, s, i[low:high], at[low:high]
            start += step

    def told(self, s: int, i: np.ndarray, at: np.ndarray) -> tuple:
        """(same, pairs with document places from ``s``) of one stretch; stretches that look alike are paired once."""
        d = self.d[at] - s
        words = self.plain[at]
        key = i.astype(np.int32).tobytes() + d.astype(np.int32).tobytes() + words.tobytes()
        if key not in self.seen:
            if len(self.seen) >= 4096:
                self.seen.clear()
            plain = {int(p) + k: int(x) for p, row in zip(d, words) for k, x in enumerate(row)}
            pairs = _paired(i, d, 0, self.width, self.original, plain)
            same = all(self.original[a] == plain[b] for a, b in pairs)
            stands: dict[int, dict[int, int]] = {}
            for a, b in pairs:
                if self.slots[a]:
                    sides = stands.setdefault(int(self.original[a]), {})
                    sides[plain[b]] = sides.get(plain[b], 0) + 1
            n = sum(sum(x.values()) for x in stands.values())
            agree = sum(max(x.values()) for x in stands.values())
            self.seen[key] = same, n, agree, min(b for _, b in pairs), max(b for _, b in pairs)
        return self.seen[key]

    def best(self, threshold: float) -> tuple | None:
        """(n_matched, n_slots, n_consistent, verbatim, first_word, last_word): a copy word by word first, then the most matches, of those whose slots agree."""
        # If the stretch of the most matches is a copy word by word, no other ranks before it.
        most = None
        for x in self.stretches(threshold):
            if most is None or x[:2] > most[:2]:
                most = x
                if x[:2] == (self.total, self.total):
                    break
        if most is None:
            return None
        matched, on, s, i, at = most
        same, n, agree, first, last = self.told(s, i, at)
        if same:
            return matched, n, agree, same, first + s, last + s
        top, found = None, None
        for matched, on, s, i, at in self.stretches(threshold):
            if top and top >= (True, matched, on, -s):  # no stretch like it can be better
                continue
            same, n, agree, first, last = self.told(s, i, at)
            rank = (same, matched, on, -s)
            if (same or not n or agree >= threshold * n) and (top is None or rank > top):
                top, found = rank, (matched, n, agree, same, first + s, last + s)
        return found


def judged(i: np.ndarray, d: np.ndarray, plain: dict[int, int], original: np.ndarray, slots: np.ndarray, width: int, total: int, threshold: float) -> tuple | None:
    """``Pair.best`` of matched windows ``i`` in the item, ``d`` in the document, whose plain words are ``plain``."""
    places = np.unique(d)
    ways = [np.unique(i[d == p]) for p in places]
    words = np.array([[plain[int(p) + k] for k in range(width)] for p in places], np.uint64)
    return Pair(places, np.arange(len(places)), ways, words, original, slots, width, total).best(threshold)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, threshold: float, most: int = MOST) -> DataFrame:
    """``LEAKS`` and ``doc``, which tells rows of ``docs`` with other ids or texts apart."""
    store = Store(docs.sparkSession, "decontaminate")
    items = _items(benchmark)
    index = store(item_windows(items, window))
    widths = sorted(r.width for r in index.select("width").distinct().collect())
    held = store(document_windows(docs, widths, sieve(index, "hash")))
    # Candidates: of each item as many of its rarest places as no document can miss that holds enough of it.
    common = index.groupBy("hash").agg(F.count_distinct("item").alias("f"))
    places = index.join(common, "hash").groupBy("item", "at", "total").agg(F.max("f").alias("f"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("f", "at"))
    seeds = places.withColumn("r", rank).where(F.col("r") <= F.col("total") - F.ceil(threshold * F.col("total")) + 1).select("item", "at")
    seeds = store(index.join(seeds, ["item", "at"], "left_semi").select("item", "hash").distinct())
    few = seeds.count() <= most
    met = held.select("doc", "hash").distinct().join(F.broadcast(seeds) if few else seeds, "hash").select("doc", "item").distinct()
    met = store(met)
    # Places of an item's windows in a document: a window of an item that many documents have is no hot key.
    wanted = store(index.select(F.xxhash64("item", "hash").alias("key")).distinct())
    left = held.join(met, "doc").withColumn("key", F.xxhash64("item", "hash"))
    if wanted.count() <= most:
        left = left.join(F.broadcast(wanted), "key", "left_semi")
    else:
        left = store(left)
        left = looked_up(left, store(left.groupBy("key").agg(F.count("*").alias("n")).join(wanted, "key")), "key", "n", "left_semi", most)
    pairs = left.groupBy("doc", "doc_id", "item").agg(F.collect_set(F.struct("at", "hash", "plain")).alias("places"))
    texts = store(items.join(met.groupBy("item").agg(F.count("*").alias("n")), "item").dropDuplicates(["item"]))
    pairs = looked_up(pairs, texts, "item", "n", most=most)

    def run(batches):
        words, known = Words(), {}
        for batch in batches:
            rows = []
            docs_, ids, names_, texts_ = tuples(batch, "doc", "doc_id", "item_id", "text")
            items_ = batch.column(batch.schema.get_field_index("item")).to_pylist()
            lists = batch.column(batch.schema.get_field_index("places"))
            for row, (doc, doc_id, item, item_id, text) in enumerate(zip(docs_, ids, items_, names_, texts_)):
                if item not in known:
                    if len(known) >= 1000:
                        known.clear()
                    original, slots, width, at, forms = _telling(text, words, window)
                    hashes, of = np.unique(np.concatenate(forms), return_inverse=True)
                    ats = np.concatenate([at, at])
                    known[item] = original, slots, width, len(at), hashes, [np.unique(ats[of == k]) for k in range(len(hashes))]
                original, slots, width, total, hashes, ways = known[item]
                places = lists[row].values
                sizes = places.field("plain").value_lengths().to_numpy()
                hash_ = places.field("hash").to_numpy().view(np.uint64)
                of = np.minimum(np.searchsorted(hashes, hash_), len(hashes) - 1)
                ok = np.flatnonzero((hashes[of] == hash_) & (sizes == width))
                if not len(ok):
                    continue
                d = places.field("at").to_numpy().astype(np.int64)
                ok = ok[np.argsort(d[ok], kind="stable")]
                if len(np.unique(np.concatenate([ways[k] for k in np.unique(of[ok])]))) < threshold * total:
                    continue
                offsets = places.field("plain").offsets.to_numpy()
                flat = places.field("plain").values.to_numpy().view(np.uint64)
                plain = flat[offsets[ok][:, None] + np.arange(width)]
                best = Pair(d[ok], of[ok], ways, plain, original, slots, width, total).best(threshold)
                if best:
                    rows.append((doc, doc_id, item_id, best[0] / total, total, *best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kind = "doc long, " + LEAKS
    names = [x.split()[0] for x in kind.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in kind.split(", ")]
    out = Store(docs.sparkSession, "leaks")(pairs.mapInArrow(run, kind))
    store.close()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row for each document and item whose template it holds, columns as in ``LEAKS``.

    Words are counted without those of punctuation alone. Null and empty texts
    hold nothing; null and wordless items, and items that are all slots, match
    nothing; items shorter than the window match whole. Rows that repeat, of
    either table, count once; other columns are not read. Empty tables give no rows.
    """
    return _found(docs, benchmark, window, threshold).drop("doc")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 5, threshold: float = 0.8, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were.

    Rows are judged by id and text, so rows that repeat go or stay together;
    null texts and ids stay unless the text holds an item. An empty table gives
    no rows, an empty benchmark all.
    """
    bad = _found(docs, benchmark, window, threshold).select(F.col("doc").alias("_doc")).distinct()
    bad = F.broadcast(bad) if bad.count() <= most else bad
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text").cast("binary"))
    return docs.withColumn("_doc", key).join(bad, "_doc", "left_anti").select(*docs.columns)
