"""Stretches and slots of one document and one item against a plain version; long repetitive texts in linear time and memory."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from leafwright.llm import decontaminate as D

SIZE, THRESHOLD = 5, 0.8


def plain_verdict(item: str, text: str):
    """Every shift by itself: windows that match around it, words paired one to one, slots held against each other."""
    words = D.Words()
    form, original, slots = (x.tolist() for x in words.canonical(item.encode()))
    shown, values, _ = (x.tolist() for x in words.canonical(text.encode()))
    width = min(SIZE, len(original))
    caseless = [p if f == int(D.SLOTS[1]) else f for f, p in zip(form, original)]
    telling = [a for a in range(len(original) - width + 1) if sum(not x for x in slots[a : a + width]) >= min(2, width)]
    match = [(a, b) for a in telling for b in range(len(shown) - width + 1) if shown[b : b + width] in (form[a : a + width], caseless[a : a + width])]
    slack, best = max(width, len(original) // 4), None
    for s in {b - a for a, b in match}:
        near = [(a, b) for a, b in match if abs(b - a - s) <= slack]
        matched, on = len({a for a, _ in near}), sum(b - a == s for a, b in near)
        if matched < THRESHOLD * len(telling):
            continue
        pairs, used = {}, set()
        for _, _, a, b in sorted((abs(b - a - s), original[a + k] != values[b + k], a + k, b + k) for a, b in near for k in range(width)):
            if a not in pairs and b not in used:
                pairs[a] = b
                used.add(b)
        same, sides = all(original[a] == values[b] for a, b in pairs.items()), {}
        for a, b in pairs.items():
            if slots[a]:
                sides.setdefault(original[a], []).append(values[b])
        n, agree = sum(map(len, sides.values())), sum(max(map(x.count, x)) for x in sides.values())
        rank = (same, matched, on, -s)
        if (same or not n or agree >= THRESHOLD * n) and (best is None or rank > best[0]):
            best = rank, (matched, n, agree, same, min(pairs.values()), max(pairs.values()))
    return best and best[1]


def pair(item: str, text: str):
    words = D.Words()
    held = D._telling(item.encode(), words, SIZE)
    if not held:
        return None
    original, slots, width, at, forms = held
    template, plain, _ = words.canonical(text.encode())
    seen = D.windows(template, width)
    hashes, of = np.unique(np.concatenate(forms), return_inverse=True)
    ways = [np.unique(np.concatenate([at, at])[of == k]) for k in range(len(hashes))]
    place = np.minimum(np.searchsorted(hashes, seen), len(hashes) - 1)
    ok = np.flatnonzero(hashes[place] == seen)
    return D.Pair(ok, place[ok], ways, plain[ok[:, None] + np.arange(width)], original, slots, width, len(at)) if len(ok) else None


def problems(r):
    names, things = ["Anna", "Tom", "Eve", "Bob"], ["apples", "pears", "stones"]
    clause = lambda: f"{r.choice(names)} buys {r.randrange(2, 5)} red {r.choice(things)}"
    item = ", ".join(clause() for _ in range(r.randrange(1, 4))) + ". How many does she have now?"
    swap = {n: r.choice(names) for n in names} | {str(k): str(r.randrange(2, 9)) for k in range(2, 5)}
    copy = item if r.random() < 0.3 else "".join(swap.get(w, w) for w in __import__("re").split(r"(\W+)", item))
    words = copy.split()
    if r.random() < 0.4:
        words.insert(r.randrange(len(words)), "really")
    text = " ".join(["so we read"] * r.randrange(3) + words * r.choice([1, 1, 2, 4]) + [clause() for _ in range(r.randrange(3))])
    return item, text


def test_verdicts_equal_a_plain_version():
    r = random.Random(21)
    kinds = {True: 0, False: 0, None: 0}
    for _ in range(400):
        item, text = problems(r)
        want, p = plain_verdict(item, text), pair(item, text)
        got = p.best(THRESHOLD) if p else None
        assert got == want, (item, text)
        kinds[want and want[3]] += 1
    assert min(kinds.values()) > 20


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_blocks_of_shifts_change_nothing(most):
    r = random.Random(4)
    for _ in range(60):
        item, text = problems(r)
        p = pair(item, text + " and so on" * 40 + " " + text)
        if p:
            kept = [(m, on, s, i.tolist(), p.d[at].tolist()) for m, on, s, i, at in p.stretches(THRESHOLD, most)]
            assert kept == [(m, on, s, i.tolist(), p.d[at].tolist()) for m, on, s, i, at in p.stretches(THRESHOLD)]


LONG = {
    "an item over and over": ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", 14),
    "one word over and over": ("spam " * 12, 12),
    "a long item of one word": ("spam " * 600, 600),
    "with numbers": ("Anna has 3 red apples and Tom has 4 green pears in the box of 12 now", 16),
}


@pytest.mark.parametrize("name", LONG)
def test_long_repetitive_texts(name):
    item, n = LONG[name]
    text = " ".join([item.replace("3", "5")] * (200_000 // n))
    tracemalloc.start()
    start = time.process_time()
    p = pair(item, text)
    got = p.best(THRESHOLD)
    took, (_, peak) = time.process_time() - start, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got and got[0] == p.total and peak < 200 << 20 and took < 60
