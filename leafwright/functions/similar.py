"""difflib's ratio of two texts by runs of equal characters, which are found once and cut as the texts are."""

from __future__ import annotations

import difflib

import numpy as np

#: Pairs of equal characters that are held at once (some 100 MB at most); beyond that difflib itself goes over the texts. Runs of fewer are plain tuples.
PAIRS, FEW = 1 << 22, 48


def _runs(a: str, b: str) -> np.ndarray | None:
    """(start in a, end in a, place in b less place in a) of all runs of characters that are not too common in b."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    order = np.argsort(y, kind="stable")
    held = y[order]
    low = np.searchsorted(held, x)
    times = np.searchsorted(held, x, "right") - low
    if len(y) >= 200:
        times[times > len(y) // 100 + 1] = 0
    total = int(times.sum())
    if total > PAIRS:
        return None
    i = np.repeat(np.arange(len(x)), times)
    at = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    code = np.sort((order[at] - i + len(x)) * (len(x) + 1) + i)
    new = np.flatnonzero(np.diff(code, prepend=-2) != 1)
    lengths = np.diff(np.append(new, total))
    d, s = np.divmod(code[new], len(x) + 1)
    return np.stack([s, s + lengths, d - len(x)])


def ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``.

    A window's longest run is that of the least end, then the least place in b;
    it grows over equal characters that are common, and what lies before and after it in both texts are windows again.
    """
    if not a or not b:
        return 0.0 if a or b else 1.0
    runs = _runs(a, b)
    if runs is None:
        return difflib.SequenceMatcher(None, a, b).ratio()
    matches, windows = 0, [(0, len(a), 0, len(b), runs)]
    while windows:
        alo, ahi, blo, bhi, runs = windows.pop()
        plain = isinstance(runs, list)
        if not plain and runs.shape[1] < FEW:
            runs, plain = list(zip(*runs.tolist())), True
        i, j, k = alo, blo, 0
        if plain:
            best = None
            for run in runs:
                n = run[1] - run[0]
                if n > k or n == k and run < best:
                    best, k = run, n
            if best:
                i, j = best[0], best[0] + best[2]
        else:
            length = runs[1] - runs[0]
            k = int(length.max())
            some = np.flatnonzero(length == k)
            some = some[runs[0, some] == runs[0, some].min()]
            i = int(runs[0, some[0]])
            j = i + int(runs[2, some].min())
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        if not k:
            continue
        matches += k
        if alo < i and blo < j:
            if plain:
                left = [(s, t, d) for s, e, d in runs if s < (t := min(e, i, j - d))]
            else:
                ends = np.minimum(np.minimum(runs[1], i), j - runs[2])
                left = np.stack([runs[0], ends, runs[2]])[:, runs[0] < ends]
            windows.append((alo, i, blo, j, left))
        p, q = i + k, j + k
        if p < ahi and q < bhi:
            if plain:
                right = [(t, e, d) for s, e, d in runs if (t := max(s, p, q - d)) < e]
            else:
                starts = np.maximum(np.maximum(runs[0], p), q - runs[2])
                right = np.stack([starts, runs[1], runs[2]])[:, starts < runs[1]]
            windows.append((p, ahi, q, bhi, right))
    return 2.0 * matches / (len(a) + len(b))
