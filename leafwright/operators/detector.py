"""From a detector's probability map to text boxes, crops and tensors, with numpy alone.

Regions over a threshold become least-area rectangles; those whose mean
probability is high enough are grown outwards and scaled back to the image.
A rectangle grown by a distance with round corners has as its least rectangle
itself, wider by that distance on every side, so growing is closed form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

THRESHOLD, BOX_SCORE, GROWTH, CANDIDATES, LEAST_SIDE = 0.2, 0.45, 1.4, 3000, 3
#: Channel means and deviations of the detector's input.
MEAN, DEVIATION = np.float32([0.485, 0.456, 0.406]), np.float32([0.229, 0.224, 0.225])


def normalised(image: np.ndarray) -> np.ndarray:
    """An (h, w, 3) image of bytes as a (1, 3, h, w) tensor."""
    x = (image.astype(np.float32) / 255 - MEAN) / DEVIATION
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None])


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (x, y) of each 8-connected region, by union of the rows' runs; regions from the bottom up."""
    root: list[int] = []

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    runs, before = [], []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now = []
        for a, b in zip(edge[::2], edge[1::2]):
            k = len(root)
            root.append(k)
            for c, d, m in before:
                if c <= b and a <= d:
                    root[find(k)] = find(m)
            now.append((a, b, k))
            runs.append((y, a, b, k))
        before = now
    held: dict[int, list[np.ndarray]] = {}
    for y, a, b, k in runs:
        x = np.arange(a, b)
        held.setdefault(find(k), []).append(np.stack([x, np.full_like(x, y)], 1))
    return [np.concatenate(v) for v in held.values()][::-1]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counterclockwise in a frame whose y grows upwards."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, float)

    def half(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1], float)


def least_rectangle(points: np.ndarray, grow: float = 0.0) -> tuple[np.ndarray, tuple[float, float]]:
    """Corners and sides of the rectangle of least area around points; one side lies along a hull edge."""
    h = hull(points)
    edges = np.diff(np.vstack([h, h[:1]]), axis=0) if len(h) > 1 else np.array([[1.0, 0.0]])
    edges = edges[np.hypot(*edges.T) > 0]
    best = None
    for u in edges / np.hypot(*edges.T)[:, None]:
        v = np.array([-u[1], u[0]])
        a, b = h @ u, h @ v
        box = (a.min() - grow, a.max() + grow, b.min() - grow, b.max() + grow)
        area = (box[1] - box[0]) * (box[3] - box[2])
        if best is None or area < best[0] - 1e-9:
            best = (area, u, v, box)
    _, u, v, (a0, a1, b0, b1) = best
    return np.array([a * u + b * v for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1))]), (a1 - a0, b1 - b0)


def ordered(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: the two leftmost by height, the two rightmost by height."""
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    (tl, bl), (tr, br) = (sorted(pair.tolist(), key=lambda p: p[1]) for pair in (by_x[:2], by_x[2:]))
    return np.array([tl, tr, br, bl])


def mean_inside(map_: np.ndarray, corners: np.ndarray) -> float:
    """Mean of the map over the pixels within a convex box."""
    h, w = map_.shape
    x0, y0 = (int(np.clip(np.floor(v), 0, m - 1)) for v, m in zip(corners.min(0), (w, h)))
    x1, y1 = (int(np.clip(np.ceil(v), 0, m - 1)) for v, m in zip(corners.max(0), (w, h)))
    ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    c = np.trunc(corners)
    side = np.array([(b[0] - a[0]) * (ys - a[1]) - (b[1] - a[1]) * (xs - a[0]) for a, b in zip(c, np.roll(c, -1, axis=0))])
    inside = (side >= 0).all(0) | (side <= 0).all(0)
    return float(map_[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def boxes(map_: np.ndarray, width: int, height: int) -> list[tuple[np.ndarray, tuple[int, int, int, int]]]:
    """(corners, bounds) of the text boxes of a probability map, in an image of ``width`` x ``height``."""
    scale = np.array([width / map_.shape[1], height / map_.shape[0]])
    found = []
    for pixels in regions(map_ > THRESHOLD)[:CANDIDATES]:
        corners, sides = least_rectangle(pixels)
        if min(sides) < LEAST_SIDE or mean_inside(map_, ordered(corners)) < BOX_SCORE:
            continue
        reach = sides[0] * sides[1] * GROWTH / (2 * sum(sides))
        corners, sides = least_rectangle(pixels, reach)
        if min(sides) < LEAST_SIDE + 2:
            continue
        box = np.clip(np.round(ordered(corners) * scale), 0, [width, height]).astype(np.float32)
        x0, y0 = np.maximum(box.min(0).astype(int), 0).tolist()
        x1, y1 = np.minimum(box.max(0).astype(int), [width - 1, height - 1]).tolist()
        if x1 > x0 and y1 > y0:
            found.append((box, (x0, y0, x1, y1)))
    return found


def crop(image: np.ndarray, corners: np.ndarray) -> np.ndarray | None:
    """The box straightened, by a bilinear look-up through its perspective; None where a side is under three pixels."""
    side = lambda i, j: float(np.hypot(*(corners[i] - corners[j])))
    w, h = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if w < 3 or h < 3:
        return None
    at = [(0, 0), (w, 0), (w, h), (0, h)]
    rows, right = [], []
    for (u, v), (x, y) in zip(at, corners):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w]
    x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]).astype(float), 1)
    x, y = np.clip(x / z, 0, image.shape[1] - 1), np.clip(y / z, 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    px = image.reshape(*image.shape[:2], -1).astype(float)
    out = (px[y0, x0] * (1 - fx) + px[y0, x1] * fx) * (1 - fy) + (px[y1, x0] * (1 - fx) + px[y1, x1] * fx) * fy
    return np.round(out).astype(image.dtype).reshape(h, w, *image.shape[2:])


def detect(maps: DataFrame) -> DataFrame:
    """(image, box_no, x0, y0, x1, y1) from (image, map, map_w, width, height): the map as a flat array of rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                grid = np.asarray(r.map, np.float32).reshape(-1, r.map_w)
                rows += [(r.image, k, *bounds) for k, (_, bounds) in enumerate(boxes(grid, r.width, r.height))]
            yield pd.DataFrame(rows, columns=["image", "box_no", "x0", "y0", "x1", "y1"])

    return maps.select("image", "map", "map_w", "width", "height").mapInPandas(run, "image long, box_no int, x0 int, y0 int, x1 int, y1 int")
