"""Quality classifier: naive-Bayes-scaled n-gram indicators under a linear hinge loss.

Indicators of words, word pairs, word shapes and shape pairs are hashed to a
fixed width and scaled by the log ratio of their class counts; the hinge loss
is fitted by dual coordinate descent. A logistic curve on the margins of the
training rows gives scores from 0 to 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, tuples

#: Labelled rows that a fit takes at most, those of the lowest hash of doc_id.
SAMPLE = 6000
#: Bytes of their indicators that reach the driver at most: of longer texts a fit takes fewer rows.
SAMPLE_BYTES = 128 << 20


class Features(dict):
    """Sorted distinct hashed n-grams of a text; the dict is a bounded memo of words' and their shapes' hashes."""

    CLASSES = bytes(
        ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c if 33 <= c < 127 else ord("?")
        for c in range(256)
    )

    def __init__(self, bits: int = 18, most: int = 200_000):
        super().__init__()
        self.mask, self.most = np.uint32((1 << bits) - 1), most
        self.seen = np.zeros(1 << bits, bool)

    def __missing__(self, word: bytes) -> int:
        shape = word.translate(self.CLASSES)
        found = self[word] = zlib.crc32(word, 1) << 32 | zlib.crc32(shape[:1] + shape[-4:], 2)
        return found

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self) > self.most:
            self.clear()
        both = np.fromiter(map(self.__getitem__, words), np.uint64, len(words)).view(np.uint32)
        word, shape = both[1::2], both[0::2]
        out = [both]
        if len(words) > 1:
            out += [(x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)) >> np.uint32(7) for x in (word, shape)]
            # Pairs of a word with itself are one n-gram whatever the word; how common they are tells repeated text.
            out.append(np.uint32([0xA511 + 64 * int(8 * (word[1:] == word[:-1]).mean())]))
        found = np.concatenate(out) & self.mask
        if len(words) < 200:
            return np.unique(found).astype(np.int64)
        self.seen[found] = True
        distinct = np.flatnonzero(self.seen)
        self.seen[distinct] = False
        return distinct


@dataclass
class Model:
    bits: int
    weights: np.ndarray  # of indicators, the log ratio included
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        # The margin is that of an indicator vector of unit length, so long texts weigh no more than short ones.
        margin = self.bias + (self.weights[features].sum() / np.sqrt(len(features)) if len(features) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def descend(rows, values, y: np.ndarray, cost: np.ndarray, width: int, rounds: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge loss by dual coordinate descent; the bias is one more weight, of a unit value."""
    square = np.array([v @ v for v in values]) + 1.0
    w, b, dual = np.zeros(width), 0.0, np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + b) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[x] += step * v
                b += step
                dual[i] = new
    return w, b, dual


def _hinge(rows: list[np.ndarray], y: np.ndarray, width: int, alpha: float, c: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights of indicators (log ratios included) and bias, by dual coordinate descent."""
    up, down = (y > 0).sum(), (y < 0).sum()
    counts = {s: np.full(width, alpha) for s in (1, -1)}
    for x, s in zip(rows, y):
        counts[int(s)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    ratio[(counts[1] + counts[-1]) < 2 * alpha + 2] = 0.0  # seen once: says nothing about other texts
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    cost = np.where(y > 0, c * len(y) / (2 * up), c * len(y) / (2 * down))
    w, b, _ = descend(rows, values, y, cost, width, rounds, seed)
    return w * ratio, b


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = 18, alpha: float = 1.0, c: float = 1.0, rounds: int = 12, seed: int = 7, folds: int = 3) -> Model:
    """Classes are weighted so that both have the same say; a single class gives a constant score.

    The logistic curve is fitted to margins of rows that the weights behind them
    have not seen (``folds`` cross-fits), as seen rows all lie beyond the margin.
    """
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    up, down = (y > 0).sum(), (y < 0).sum()
    width = 1 << bits
    if not up or not down:
        return Model(bits, np.zeros(width), 0.0, 1.0, 2.0 if up else -2.0 if down else 0.0)
    w, b = _hinge(rows, y, width, alpha, c, rounds, seed)
    margin = np.zeros(len(y))
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    for k in range(folds):
        own = np.flatnonzero(fold != k)
        wk, bk = _hinge([rows[i] for i in own], y[own], width, alpha, c, rounds, seed) if len(set(y[own])) == 2 else (w, b)
        for i in np.flatnonzero(fold == k):
            margin[i] = wk[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bk
    # Platt's curve, by Newton steps.
    target, weight = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2)), np.where(y > 0, len(y) / (2 * up), len(y) / (2 * down))
    a = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a[0] * margin + a[1], -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p)
        step = np.linalg.solve([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]], [g @ margin, g.sum()])
        a -= np.clip(step, -2, 2)
    return Model(bits, w, float(b), float(a[0]), float(a[1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = 18, most: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows that are not held out, ``sample`` at most by hash of doc_id, and no more of them than ``most`` bytes of indicators hold.

    Rows with a null doc_id or quality are left out; of repeated ids one row is
    taken. ``labels`` serves for the fit alone. Without a row, or with one class
    alone, the model gives a constant score.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def featurize(batches):
        of = Features(bits)
        for batch in batches:
            ids, qs, ts = tuples(batch, "doc_id", "quality", "text")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(qs, pa.int32()), pa.array([of(t).astype("<i4").tobytes() for t in ts], pa.binary())], ["doc_id", "quality", "features"]
            )

    ranked = chosen.join(texts.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    ranked = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = texts.join(F.broadcast(ranked), "doc_id").mapInArrow(featurize, "doc_id long, quality int, features binary")
    # A row for each id, whatever repeats it: what reaches the driver has the sample's bounds, in rows and in bytes.
    few = few.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("features").alias("features"))
    store = Store(docs.sparkSession, "sample")
    try:
        few = store(few)
        if (few.agg(F.sum(F.octet_length("features"))).first()[0] or 0) > most:
            sizes = few.select("doc_id", F.octet_length("features").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
            ends = np.cumsum([r.n for r in sizes])
            few = few.where(F.col("doc_id").isin([r.doc_id for r in sizes[: max(1, int((ends <= most).sum()))]]))
        rows = sorted(few.collect(), key=lambda r: r.doc_id)
    finally:
        store.close()
    return fit([np.frombuffer(r.features, "<i4").astype(np.int64) for r in rows], np.array([r.quality for r in rows]), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    A null or empty text gets the score of no indicators; a null doc_id is not
    held out. Repeated rows each give a row; lang, source, labels and other
    columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        of = Features(model.bits)
        for batch in batches:
            ids, texts = tuples(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model.score(of(t)) for t in texts], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts as of good quality, all columns as they were.

    A null or empty text has the score of no indicators and stays or goes by
    it. Repeated rows and null ids are judged like others, further columns pass
    through unread. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        of = Features(model.bits)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([model.score(of(t)) >= 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
