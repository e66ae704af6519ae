"""Stretches, classes and removal against a plain version of the docstring, on small tables with repeated, null and clashing rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafwright.llm import substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, of_text long, run long, part long, first long"


def passages(text):
    """(start, stop, words) of each line's sentences that have words."""
    out, at = [], 0
    for piece in re.findall(r"[^\n.!?]*(?:[.!?]+\n?|\n|$)", text):
        start, stop = at, at + len(piece)
        at = stop
        words = [(m.start() + start, m.end() + start) for m in re.finditer(r"[^\x20\x09-\x0D]+", piece)]
        if words:
            out.append((start, stop, tuple(text[a:b].lower() for a, b in words)))
    return out


def shingles(words):
    return {words[k : k + 5] for k in range(len(words) - 4)} or {words}


def plain(rows, run_words):
    """{(doc_id, text): {(start, stop, n_words, class number, remove)}}: documents by (id, hash of text)."""
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    cut = {d: passages(d[1]) for d in docs}
    kinds = sorted({w for p in cut.values() for _, _, w in p})
    parent = {k: k for k in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kinds:
        for b in kinds:
            x, y = shingles(a), shingles(b)
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                parent[find(b)] = find(a)
    return docs, cut, find


def of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 9, 9, 9, 9) for i, t in rows], DOCS)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)) + "."


def tables(seed):
    r = random.Random(seed)
    shared = [sentence(r, r.choice([6, 9, 14, 30])) for _ in range(6)]
    rows = []
    for k in range(14):
        text = []
        for _ in range(r.randrange(1, 6)):
            text += [r.choice(shared)] if r.random() < 0.6 else [sentence(r, r.randrange(1, 20))]
            if r.random() < 0.3:
                text += [shared[0], shared[1]]
        rows.append((r.choice([k, k, 3]), r.choice([" ", "\n"]).join(text)))
    near = shared[3].split()
    near[0] = "other"
    rows += [(40, " ".join(near)), (None, shared[0] * 3), (41, None), (42, ""), rows[0], rows[1], (3, shared[2] + " " + shared[5])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "run_words"), [(1, 0), (2, 25), (3, 12), (4, 25), (5, 0)])
def test_stretches_classes_and_removal(spark, seed, run_words):
    rows = tables(seed)
    docs, cut, find = plain(rows, run_words)
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    many = Counter(i for i, _ in rows if i is not None)
    key = {d: (d[0], hashed[d[1]] if many[d[0]] > 1 else 0) for d in docs}
    places = defaultdict(list)
    for d in docs:
        for no, (_, _, words) in enumerate(cut[d]):
            places[find(words)].append((*key[d], no))
    got = substring.repeated(of(spark, rows), run_words=run_words).collect()
    told = defaultdict(list)
    for g in got:
        told[g.doc_id, g.of_text].append(g)
    classes = {}
    for d in docs:
        # Runs of passages that stand in another place too, long enough together.
        common = [no for no, (_, _, w) in enumerate(cut[d]) if len(places[find(w)]) > 1]
        runs = []
        for no in common:
            runs[-1].append(no) if runs and runs[-1][-1] == no - 1 else runs.append([no])
        runs = [x for x in runs if sum(len(cut[d][no][2]) for no in x) >= run_words]
        mine = sorted(told.pop(key[d], []), key=lambda g: g.start)
        covered = [no for x in runs for no in x]
        parts = [[no for no in covered if g.start <= cut[d][no][0] < g.stop] for g in mine]
        assert [no for p in parts for no in p] == covered, "the rows cover the runs, in order"
        for g, p in zip(mine, parts):
            assert p == list(range(p[0], p[-1] + 1)) and (g.start, g.stop) == (cut[d][p[0]][0], cut[d][p[-1]][1])
            assert g.n_words == sum(len(cut[d][no][2]) for no in p)
            first = {no: min(places[find(cut[d][no][2])]) for no in p}
            later = {no: first[no] != (*key[d], no) for no in p}
            assert set(later.values()) == {g.remove}
            # Equal parts have one class, that of their first passage.
            assert classes.setdefault(find(cut[d][p[0]][2]), g.class_id) == g.class_id
    assert not told and len(set(classes.values())) == len(classes)


def cut_by_hand(spark, rows, run_words):
    spans = defaultdict(list)
    for g in substring.repeated(of(spark, rows), run_words=run_words).where("remove").collect():
        spans[g.doc_id, g.of_text].append((g.start, g.stop))
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    out = []
    for i, t in rows:
        for a, b in sorted(spans.get((i, 0), []) + spans.get((i, hashed[t or ""]), []), reverse=True):
            t = t[:a] + t[b:]
        out.append((i, t, None if t is None else len(t)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "run_words"), [(2, 25), (6, 0)])
def test_removal_cuts_each_text_by_its_own_stretches(spark, seed, run_words):
    rows = tables(seed)
    got = substring.without_repeats(of(spark, rows), run_words=run_words)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=repr) == cut_by_hand(spark, rows, run_words)


def test_rows_that_repeat_an_id_keep_their_texts(spark):
    r = random.Random(8)
    passage, other = " ".join(sentence(r, 15) for _ in range(4)), " ".join(sentence(r, 15) for _ in range(5))
    rows = [(1, passage), (2, "zero one two three. " + passage), (2, other), (2, other)]
    got = {t for i, t in ((r.doc_id, r.text) for r in substring.without_repeats(of(spark, rows)).collect()) if i == 2}
    assert got == {"zero one two three.", other}
