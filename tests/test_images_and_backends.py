"""Image sources, box reading, backends, and the other ways of operators that have two."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.operators import backends, evaluation, reading, recognition
from leafwright.options import ExtractOptions, PageRangeError, page_runs
from leafwright.plans import extract
from leafwright.sources import images


def png_file(x, kinds):
    """A PNG of ``x`` with the given filters, row by row."""
    h, w, n = x.shape
    body, x = b"", x.astype(int)
    for y in range(h):
        kind = kinds[y % len(kinds)]
        up = x[y - 1] if y else np.zeros((w, n), int)
        left = np.vstack([np.zeros((1, n), int), x[y][:-1]])
        corner = np.vstack([np.zeros((1, n), int), up[:-1]])
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        near = np.choose(d.argmin(0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, near][kind]
        body += bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png(n):
    x = np.random.default_rng(n).integers(0, 256, (11, 7, n), np.uint8)
    got, error = images.decoded(png_file(x, [0, 1, 2, 3, 4]))
    assert error is None and (got == (x if n == 3 else x[..., :3] if n == 4 else np.repeat(x[..., :1], 3, 2))).all()


def test_read_images(spark):
    x = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    files = [(1, b"P6\n# note\n3 2\n255\n" + x.tobytes()), (2, b"P5 3 2 255\n" + bytes(6)), (3, None), (4, b""), (5, b"P6 9999999 9999999 255\n"), (6, b"\x89PNG\r\n\x1a\n")]
    rows = {r.image: r for r in images.read_images(spark.createDataFrame(files, "image long, content binary").withColumn("error", F.lit(1))).collect()}
    assert bytes(rows[1].pixels) == x.tobytes() and (rows[1].height, rows[1].width, rows[1].error) == (2, 3, None)
    assert bytes(rows[2].pixels) == bytes(18)
    assert all(rows[k].pixels is None and rows[k].error.startswith("cannot read image") for k in (3, 4, 5, 6))
    assert images.read_images(spark.createDataFrame([], "image long, content binary")).count() == 0


def test_rendered(spark):
    def draw(document, page, dpi):
        if page > 2:
            raise IndexError(page)
        return document + bytes([page, dpi])

    images.RENDERERS["made"] = draw
    pages = spark.createDataFrame([(1, 1, b"a"), (1, 3, b"a")], "doc_id long, page_no int, content binary")
    rows = {r.page_no: r for r in images.rendered(pages, "made", 72).collect()}
    assert bytes(rows[1].image) == b"a\x01H" and rows[1].error is None and rows[3].image is None and "IndexError" in rows[3].error


def test_line_tensor_widths(spark):
    for h, w in ((7, 50), (8, 8), (20, 400), (10, 4000), (48, 320), (33, 221)):
        x = reading.line_tensor(np.full((h, w, 3), 255, np.uint8))
        if h < 8:
            assert x is None
            continue
        want = spark.range(1).select(recognition.recogniser_width(F.lit(h), F.lit(w)).alias("s")).select("s.*").first()
        assert x.shape == (1, 3, 48, want.width) and (x[..., : want.resized] == 1).all() and (x[..., want.resized :] == 0).all()


def test_resized_keeps_and_halves():
    x = np.random.default_rng(1).integers(0, 256, (6, 8, 3), np.uint8)
    assert (reading.resized(x, 6, 8) == x).all()
    assert (reading.resized(x, 3, 4) == np.round(x.reshape(3, 2, 4, 2, 3).astype(float).mean((1, 3)))).all()


def test_decoded_as_column(spark):
    steps, characters = np.random.default_rng(2).random((40, 6)), ["blank", *"abcd", " "]
    c = recognition.ctc(F.col("m"), F.array(*map(F.lit, characters)))
    want = spark.createDataFrame([(steps.tolist(),)], "m array<array<double>>").select(c.alias("s")).select("s.*").first()
    text, conf = reading.decoded(steps, characters)
    assert text == want.text and conf == pytest.approx(want.conf)


def test_read_boxes(spark):
    def model(options):
        def run(x):
            if x[..., :10].max() <= -1:
                raise ValueError("black")
            out = np.full((2, 3), 0.1)
            out[0, 1 if x[0, 0, 24, 10] > 0 else 0] = 0.87654
            out[1, 0] = 0.9
            return out

        return run

    reading.MODELS["made"] = model
    x = np.zeros((40, 90, 3), np.uint8)
    x[:20] = 255
    box = lambda y, h: [-2.0, y, 60.0, y, 60.0, y + h, -2.0, y + h]
    rows = [(1, 40, 90, x.tobytes(), [box(0.0, 15.0), box(0.0, 2.0), box(0.0, 7.0)]), (2, 40, 90, bytes(x.size), [box(5.0, 20.0)]), (3, None, None, None, [box(0.0, 9.0)]), (4, 40, 90, x.tobytes(), [])]
    frame = spark.createDataFrame(rows, "image long, height int, width int, pixels binary, boxes array<array<double>>")
    got = {(r.image, r.box_no): r for r in reading.read_boxes(frame, "made", ["blank", "a", "b"]).collect()}
    assert set(got) == {(1, 0), (2, None), (3, None)}
    r = got[1, 0]
    assert (r.text, r.conf, r.x, r.y, r.error) == ("a", 0.8765, 0, 0, None) and r.box == [0, 0, 60, 0, 60, 15, 0, 15]
    assert "black" in got[2, None].error


def test_backends(tmp_path):
    def broken():
        raise OSError("no device")

    assert backends.load("gpu", {"gpu": broken, "cpu": lambda: 1}) == ("cpu", 1, ["gpu: OSError: no device"])
    assert backends.load("cpu", {"cpu": lambda: 2}) == ("cpu", 2, [])
    with pytest.raises(OSError):
        backends.load("openvino", {"openvino": broken, "cpu": broken})
    (tmp_path / "server").touch()
    found = backends.facts({"exe": "server", "model": str(tmp_path / "none"), "port": 1}, str(tmp_path))
    assert found["exe"] and not found["model"] and not found["mmproj"] and not found["listening"] and found["need_mib"] == 3000


def test_phrases_by_join(spark):
    texts = [(1, "the quick  brown fox"), (1, "the quick  brown fox"), (1, "other"), (2, None), (3, "aaaa é long tail of words that goes on and on for a while")]
    phrases = ["quick brown", "a", "é", "quick brown", "absent", "", None, "tail of words that goes on and on for a while", "brown fox"]
    texts, phrases = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    small, large = (sorted(map(tuple, evaluation.phrase_hits(texts, phrases, n).collect())) for n in (1 << 20, 1))
    assert small == large and (1, 3, 7) in small and (2, 0, 7) in small and (3, 3, 7) in small


def test_page_runs(spark):
    assert page_runs("4, 1-2,3,9-3000000000") == [(1, 4), (9, 3000000000)]
    for bad in ("", "0", "3-1", "1-2-3", "x"):
        with pytest.raises(PageRangeError):
            page_runs(bad)
    pages = spark.createDataFrame([(1, k) for k in (1, 2, 3)] + [(2, 1)], "doc_id long, page_no int")
    faults = extract.selection_faults(pages, ExtractOptions(pages="1,2-9")).collect()
    assert [(r.doc_id, r.pages) for r in faults] == [(2, 1)]
    assert extract.selection_faults(pages, ExtractOptions()).count() == 0
