"""The ratio of two texts by runs, against difflib."""

import difflib
import random
import time

from leafwright.functions import similar

ALPHABETS = ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz  eee\n", "日本語abc𝄞")


def made(r):
    letters = r.choice(ALPHABETS)
    a = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 50, 199, 200, 201, 700])))
    b = list(a)
    for _ in range(r.randrange(30)):
        x = r.randrange(len(b) + 1)
        b[x : x + r.randrange(20)] = r.choice(["", r.choice(letters), "new " * 5])
    return (a, "".join(b)) if r.random() < 0.7 else ("".join(b), a[::-1])


def test_ratio_is_difflibs(monkeypatch):
    r = random.Random(2)
    for k in range(600):
        a, b = made(r)
        if k == 500:
            monkeypatch.setattr(similar, "PAIRS", 0)
        assert similar.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_is_quick():
    """Pages of words of which every third line is in capitals: under half of difflib's time."""
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(r.randrange(2, 9))) for _ in range(900)]
    pages = [[" ".join(r.choice(words) for _ in range(30)) for _ in range(10)] for _ in range(60)]
    pairs = [("\n".join(p), "\n".join(x.upper() if i % 3 == 2 else x for i, x in enumerate(p) if i % 7 != 6)) for p in pages]
    times = []
    for f in (lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(), similar.ratio):
        start = time.process_time()
        out = [f(a, b) for a, b in pairs]
        times.append((time.process_time() - start, out))
    assert times[0][1] == times[1][1] and times[1][0] < times[0][0] / 2
