"""Packing by Karmarkar-Karp multiway differencing.

Each document is tokenized whole and ends with id 0. Whole windows are cut off
its front; what is left over goes to a differencing pool. The pool starts as
partial partitions of one piece each; the two of the widest spread are merged,
the largest windows of one with the smallest of the other, until one partition
of k near-equal windows is left. k starts at the least count that could hold the
pool and rises as long as a window exceeds the capacity.

A task packs its own rows in pools of a fixed count, so nothing is shuffled and
memory is bounded by a pool and the longest document of an Arrow batch.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, those of ``tokenizers`` for the vocabulary file at ``path``.

    The split pattern opens a new piece at a space before a character that is
    not white space, so a text's ids are those of its chunks at spaces, and a
    block of texts needs each distinct chunk but once; those go through the
    same vocabulary's ranks. Texts with other white space at a chunk's start go
    in whole, and texts that hold a special token's string go to ``tokenizers``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.special = [t["content"] for t in held.get("added_tokens", [])]
        letters, vocabulary = byte_letters(), held["model"]["vocab"]
        ranks = {bytes(map(letters.__getitem__, word)): i for word, i in vocabulary.items() if word not in self.special}
        self.reference = Tokenizer.from_file(path)
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for w, i in ranks.items() if w[:1] == b" "]] = True

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.reference.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts = pc.split_pattern(texts, " ")
        base = parts.offsets[0].as_py()
        offsets = parts.offsets.to_numpy() - base
        codes = parts.values[base : base + offsets[-1]].dictionary_encode()
        chunks, codes = codes.dictionary, codes.indices.to_numpy()
        first = codes[offsets[:-1]]
        head = pc.utf8_slice_codeunits(chunks, 0, 1)
        odd = pc.or_(pc.equal(head, ""), pc.utf8_is_space(head)).to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~odd))
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), " ")[0].as_py()
        ids = np.array(self.bpe.encode_ordinary(" " + line), "<u4")
        at = np.flatnonzero(self.spaced[ids]).astype(np.int32)
        if len(at) != len(plain):  # a lone space, if no chunk is plain, or a split not foreseen
            return [self.whole(t) for t in texts.to_pylist()]
        begin, size = np.zeros(len(chunks), np.int32), np.zeros(len(chunks), np.int32)
        begin[~odd], size[~odd] = at, np.diff(at, append=np.int32(len(ids)))
        sizes = size[codes]
        sizes[offsets[:-1]] = 0  # a text's first chunk has no space before it
        ends = np.cumsum(sizes, dtype=np.int32)
        spread = ids[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(begin[codes] - (ends - sizes), sizes)]
        odd = odd[codes]
        odd[offsets[:-1]] = False
        strange = np.add.reduceat(odd, offsets[:-1]) > 0 if len(odd) else np.zeros(len(texts), bool)
        for token in self.special:
            strange |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cuts = np.append(0, ends)[offsets]
        return [
            self.whole(texts[k].as_py()) if strange[k] else self.whole(chunks[int(first[k])].as_py()) + spread[cuts[k] : cuts[k + 1]].tobytes()
            for k in range(len(texts))
        ]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` windows of near-equal sums."""
    if not sizes:
        return []
    one = np.arange(windows)
    heap = [(-size, i, np.array([size] + [0] * (windows - 1), np.int64), i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    # A merge remembers where each window's two halves were; members are listed once, at the end.
    while len(heap) > 1:
        _, i, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        order = (-sums).argsort(kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), i, sums, (left, right, order)))
    held: list[list[int]] = [[] for _ in range(windows)]
    todo = [(heap[0][3], one)]
    while todo:
        node, place = todo.pop()
        if isinstance(node, int):
            held[int(place[0])].append(node)
            continue
        left, right, order = node
        at = np.empty(windows, np.int64)
        at[order] = place
        todo += [(left, at), (right, at[::-1])]
    return held


def pool_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of ``sizes`` that hold ``capacity`` at most; their count rises until they do."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        held = differencing(sizes, k)
        most = max((sum(sizes[i] for i in w) for w in held), default=0)
        if most <= capacity:
            return [w for w in held if w]
        k += 1


def blocks(texts: pa.Array, most: int = 16 << 20):
    """(start, stop) of runs of rows with about ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, piece: int = 256, pool: int = 1024) -> DataFrame:
    """One row for each piece, columns as in ``SCHEMA``; ``vocabulary``: path of the ``tokenizers`` file, on every machine.

    What is left of a document after its whole windows is cut into pieces of
    ``piece`` ids and one of what remains, sizes that differencing can balance
    well; a pool has about ``pool`` pieces. A null or empty text is the single id 0. Rows with a null
    doc_id or a repeated one are packed as documents of their own. Sequence ids
    are unique: the task's partition is in the high bits. Other columns are not
    read. An empty table gives no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        encoder = Encoder(vocabulary, pattern)
        base, made = TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []
        rows: list[tuple] = []

        def flush():
            nonlocal made
            for window in pool_windows([h[2] for h in held], capacity):
                at = 0
                for i in window:
                    rows.append((*held[i], base + made, at))
                    at += held[i][2]
                made += 1
            held.clear()

        def out():
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in blocks(texts):
                for doc, data in zip(ids[i:j].to_pylist(), encoder.encode(texts[i:j])):
                    data += b"\0\0\0\0"
                    total = len(data) // 4
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        rows.append((doc, start, capacity, zlib.crc32(data[4 * start : 4 * (start + capacity)]), total, base + made, 0))
                        made += 1
                    for a in range(whole, total, piece):
                        b = min(a + piece, total)
                        held.append((doc, a, b - a, zlib.crc32(data[4 * a : 4 * b]), total))
                    if len(held) >= pool:
                        flush()
                yield out()
        flush()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
