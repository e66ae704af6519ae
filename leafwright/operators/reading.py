"""From text boxes of an image to recognised lines: crop, resize, model, greedy decoding."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .detector import crop
from .recognition import BASE_WIDTH, HEIGHT, WIDEST

LOWEST = 8  # rows below which a crop isn't read
Model = Callable[[np.ndarray], np.ndarray]
#: Name -> factory(options) of a model: (1, 3, h, w) tensor to (steps, classes) probabilities.
MODELS: dict[str, Callable[[dict], Model]] = {}


def onnx(options: dict) -> Model:
    """A model file run by onnxruntime; options: path."""
    import onnxruntime

    session = onnxruntime.InferenceSession(options["path"])
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x})[0][0]


MODELS["onnx"] = onnx


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres at halves; edges are held."""

    def at(n, m):
        x = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, m - 1), x - low

    (y0, y1, fy), (x0, x1, fx) = at(height, image.shape[0]), at(width, image.shape[1])
    px, fx, fy = image.astype(float), fx[None, :, None], fy[:, None, None]
    rows = px[y0] * (1 - fy) + px[y1] * fy
    return np.round(rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(image.dtype)


def line_tensor(image: np.ndarray, height: int = HEIGHT) -> np.ndarray | None:
    """A crop scaled to ``height`` in its proportions and padded with zeros to the batch's width; None if it is too low."""
    h, w = image.shape[:2]
    if h < LOWEST:
        return None
    wide = min(WIDEST, int(height * max(BASE_WIDTH / height, w / h)))
    use = min(wide, math.ceil(height * w / h))
    out = np.zeros((1, 3, height, wide), np.float32)
    out[0, :, :, :use] = resized(image, height, use).transpose(2, 0, 1).astype(np.float32) / 127.5 - 1
    return out


def decoded(steps: np.ndarray, characters: list[str], offset: int = 0, trim: int = 0) -> tuple[str, float]:
    """(text, confidence): as ``recognition.ctc``, on an array."""
    best = steps.argmax(-1)
    fresh = (best != 0) & (best != np.append(-1, best[:-1]))
    k = best - offset
    on = np.flatnonzero(fresh & (k >= 0) & (k < len(characters) - trim))
    return "".join(characters[i] for i in k[on]), float(steps[on, best[on]].mean()) if len(on) else 0.0


def read_box(image: np.ndarray, corners: np.ndarray, model: Model, characters: list[str], offset: int = 0, trim: int = 0, upside_down: Callable[[np.ndarray], bool] | None = None) -> dict | None:
    """box (clipped to the image), text, conf (four places), x and y of a text box; None if it is too small or holds no text."""
    part = crop(image, corners)
    if part is not None and upside_down is not None and upside_down(part):
        part = part[::-1, ::-1]
    x = None if part is None else line_tensor(part)
    text, conf = ("", 0.0) if x is None else decoded(model(x), characters, offset, trim)
    if not text:
        return None
    box = np.clip(corners, 0, [image.shape[1] - 1, image.shape[0] - 1])
    return {"box": box.astype(float).tolist(), "text": text, "conf": round(conf, 4), "x": int(box[:, 0].min()), "y": int(box[:, 1].min())}


def read_boxes(images: DataFrame, model: str, characters: list[str], options: dict | None = None, offset: int = 0, trim: int = 0) -> DataFrame:
    """(image, box_no, box, text, conf, x, y, error) from (image, height, width, pixels, boxes): boxes are flat arrays of eight numbers.

    Boxes without text give no row. An image without pixels, or one on which the
    model fails, is a row with an error alone. One model for each task.
    """
    factory, options = MODELS[model], dict(options or {})

    def run(batches):
        use = factory(options)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    pixels = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), 3)
                    found = [(k, read_box(pixels, np.asarray(b, float).reshape(4, 2), use, characters, offset, trim)) for k, b in enumerate(r.boxes)]
                    rows += [(r.image, k, sum(f["box"], []), f["text"], f["conf"], f["x"], f["y"], None) for k, f in found if f]
                except Exception as e:  # noqa: BLE001 - an image that can't be read is data
                    rows.append((r.image, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["image", "box_no", "box", "text", "conf", "x", "y", "error"])
            yield out.astype({c: "Int32" for c in ("box_no", "x", "y")})

    schema = "image long, box_no int, box array<double>, text string, conf double, x int, y int, error string"
    return images.select("image", "height", "width", "pixels", "boxes").mapInPandas(run, schema)
