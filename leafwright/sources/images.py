"""Image files and rendered pages as rows: decoders and renderers are registries, and a file that can't be read is a row with an error."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By the bytes a file starts with: file -> (height, width, 3) array in red, green, blue.
DECODERS: dict[bytes, Callable[[bytes], np.ndarray]] = {}
#: By name: (document, page number from 1, dpi) -> image file.
RENDERERS: dict[str, Callable[[bytes, int, int], bytes]] = {}
MOST_PIXELS = 1 << 28


def _sized(h: int, w: int) -> None:
    if not 0 < h * w <= MOST_PIXELS:
        raise ValueError(f"{w} x {h} pixels")


def netpbm(data: bytes) -> np.ndarray:
    """Binary grey or colour maps of eight bits."""
    at, fields = 2, []
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        stop = at
        while data[stop : stop + 1].isdigit():
            stop += 1
        fields.append(int(data[at:stop]))
        at = stop
    w, h, top = fields
    if not 0 < top < 256:
        raise ValueError("more than eight bits")
    _sized(h, w)
    n = 3 if data[:2] == b"P6" else 1
    x = np.frombuffer(data, np.uint8, h * w * n, at + 1).reshape(h, w, n)
    return np.repeat(x, 3 // n, axis=2)


def png(data: bytes) -> np.ndarray:
    """PNG files of eight bits a channel that aren't interlaced; transparency is dropped."""
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    w, h, bits, colour, _, _, interlaced = head
    if bits != 8 or interlaced:
        raise ValueError("only eight bits, not interlaced")
    _sized(h, w)
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    most = h * (w * n + 1)
    rows = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), most), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h + 1, w + 1, n), np.uint8)
    for y, row in enumerate(rows):
        kind, x = row[0], row[1:].reshape(w, n)
        above = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = x
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(x, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = x + above
        elif kind in (3, 4):
            _each(kind, x, out[y], out[y + 1])
        else:
            raise ValueError(f"filter {kind}")
    x = out[1:, 1:]
    if colour == 3:
        return palette[x[..., 0]]
    return np.repeat(x[..., :1], 3, axis=2) if n < 3 else x[..., :3]


def _each(kind: int, x: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    """Rows whose pixels hang on the one before: the average of left and above, or the nearest of three."""
    for k in range(x.shape[1]):
        left, corner = 0, 0
        ups, given = above[1:, k].tolist(), x[:, k].tolist()
        got = []
        for up, v in zip(ups, given):
            if kind == 3:
                guess = (left + up) // 2
            else:
                guess = min((left, up, corner), key=lambda c: abs(left + up - corner - c))
            left, corner = (v + guess) & 255, up
            got.append(left)
        out[1:, k] = got


DECODERS |= {b"P5": netpbm, b"P6": netpbm, b"\x89PNG": png}


def decoded(data: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(pixels, error): one of them is null."""
    try:
        for start, decoder in DECODERS.items():
            if (data or b"").startswith(start):
                return decoder(data), None
        return None, "cannot read image: unknown format"
    except Exception as e:  # noqa: BLE001 - a file that can't be read is data
        return None, f"cannot read image: {type(e).__name__}: {e}"


IMAGE = "height int, width int, pixels binary, error string"


def read_images(images: DataFrame, column: str = "content") -> DataFrame:
    """``images`` with height, width, pixels (rows of red, green, blue) and error in place of the file in ``column``.

    One image at a time is decoded, so memory is bounded by one image beside the
    batch. Null and empty files have an error; columns named like the new ones are replaced.
    """
    kept = [c for c in images.columns if c not in (column, "height", "width", "pixels", "error")]
    schema = ", ".join([*(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept), IMAGE])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, error = decoded(batch.column(len(kept))[k].as_py())
                given = [batch.column(j).slice(k, 1) for j in range(len(kept))]
                h, w = x.shape[:2] if x is not None else (None, None)
                new = [pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([None if x is None else np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*given, *new], [*kept, "height", "width", "pixels", "error"])

    return images.select(*kept, column).mapInArrow(run, schema)


def image_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, height, width, pixels, error) of image files."""
    return read_images(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


def rendered(documents: DataFrame, renderer: str, dpi: int = 150) -> DataFrame:
    """(doc_id, page_no, image, error) from (doc_id, page_no, content): a page of a document as an image file by a registered renderer."""
    draw = RENDERERS[renderer]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image, error = None, None
                try:
                    image = draw(batch.column(2)[k].as_py(), batch.column(1)[k].as_py(), dpi)
                except Exception as e:  # noqa: BLE001 - a page that can't be drawn is data
                    error = f"cannot render: {type(e).__name__}: {e}"
                new = [pa.array([image], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *new], ["doc_id", "page_no", "image", "error"])

    return documents.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), F.col("content").cast("binary")).mapInArrow(run, "doc_id long, page_no int, image binary, error string")
