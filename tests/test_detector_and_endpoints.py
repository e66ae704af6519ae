import json

import numpy as np
import pytest

from leafwright.operators import detector, endpoints
from leafwright.plans.views import register_views


def test_boxes_of_a_made_map(spark):
    grid = np.zeros((60, 100), np.float32)
    grid[10:20, 10:60] = 0.9  # a line of text
    grid[40:42, 5:9] = 0.9  # too thin
    grid[50:58, 50:90] = 0.3  # over the threshold, but too weak
    got = detector.boxes(grid, 200, 120)
    assert len(got) == 1
    x0, y0, x1, y1 = got[0][1]
    reach = 49 * 9 * 1.4 / (2 * (49 + 9))
    assert abs(x0 - 2 * (10 - reach)) <= 1 and abs(x1 - 2 * (59 + reach)) <= 1 and abs(y0 - 2 * (10 - reach)) <= 1 and abs(y1 - 2 * (19 + reach)) <= 1
    df = spark.createDataFrame([(7, grid.ravel().tolist(), 100, 200, 120)], "image long, map array<float>, map_w int, width int, height int")
    assert [tuple(r) for r in detector.detect(df).collect()] == [(7, 0, x0, y0, x1, y1)]


def test_turned_rectangle():
    u = np.array([3.0, 4.0]) / 5
    v = np.array([-u[1], u[0]])
    points = np.array([a * u + b * v for a in np.linspace(0, 50, 60) for b in np.linspace(0, 10, 15)])
    _, sides = detector.least_rectangle(points)
    assert sorted(np.round(sides, 6)) == [10, 50]
    assert len(detector.regions(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))) == 2


def test_crop_and_tensor():
    image = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    box = np.float32([[5, 4], [15, 4], [15, 9], [5, 9]])
    assert (detector.crop(image, box) == image[4:9, 5:15]).all() and detector.crop(image, box[[0, 0, 3, 3]]) is None
    x = detector.normalised(image)
    assert x.shape == (1, 3, 20, 30) and np.allclose(x[0, 1, 2, 3], (image[2, 3, 1] / 255 - 0.456) / 0.224)


def test_chat():
    seen = {}

    def send(method, url, headers, body):
        seen.update(json.loads(body), url=url)
        return 200, json.dumps({"choices": [{"message": {"content": "text"}}]}).encode()

    assert endpoints.chat({"endpoint": "http://h/v1/", "transport": send, "message_order": "text-first", "max_tokens": 0})(b"png", "read") == ("text", {})
    assert seen["url"] == "http://h/v1/chat/completions" and [p["type"] for p in seen["messages"][0]["content"]] == ["text", "image_url"] and seen["max_tokens"] == 4096
    assert endpoints.chat({"endpoint": "http://h", "transport": lambda *a: (500, b"no")})(b"")[1]["error"].startswith("HTTP 500")
    assert "error" in endpoints.chat({"endpoint": "http://h", "transport": lambda *a: (200, b"{}")})(b"")[1]


@pytest.mark.parametrize(
    "states, text, error",
    [(["run", None, "done"], "a\n\nb", None), (["failed"], "", "failed: bad"), (["run"] * 99, "", "timeout"), (["lost"], "", "done without a result")],
)
def test_job(states, text, error):
    left = iter(states)

    def send(method, url, headers, body):
        if method == "POST":
            return 200, b'{"data": {"jobId": "7"}}'
        if url == "http://result":
            return 200, b'{"result": {"layoutParsingResults": [{"markdown": {"text": "a"}}]}}\nbad\n\n{"result": {"layoutParsingResults": [{"markdown": {"text": "b"}}]}}'
        state = next(left)
        if state is None:
            raise OSError("network")
        return 200, json.dumps({"data": {"state": "done" if state == "lost" else state, "errorMsg": "bad", "resultUrl": {"jsonUrl": "http://result"} if state == "done" else {}}}).encode()

    got = endpoints.job({"endpoint": "http://j", "transport": send, "pause": 0.01, "max_wait": 0.2})(b"x")
    assert got[0] == text and got[1].get("error") == error


def test_views(spark, sf):
    register_views(spark, sf)
    assert spark.sql("select count(*) from line_block where block_idx is null").first()[0] > 0
    assert spark.sql("select count(distinct is_image) from detection").first()[0] >= 1
