"""The training-data operators against brute force, round trips and held-out rows, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leafwright.llm import bayes_svm, decontaminate, html_text, packing, pii, quality_rules, queries, secrets, simhash, substring, warc
from leafwright.llm.common import components, looked_up, shared_path, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, component long, node long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def made(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2) for i, t in zip(ids, texts)], DOCS)


AWKWARD = [None, "", " \n\t ", "one", "a b c", "same text here again and again", "same text here again and again", "é " * 50_000, "x" * 200_000, "tok " * 5000]


@pytest.fixture(scope="module")
def awkward(spark):
    return made(spark, AWKWARD, [0, 1, 2, 3, 4, 5, 5, 7, 8, None])


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2100)] + [(3, None), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 1: quality rules


def base_by_hand(text):
    words = WORDS.findall(text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered, seen, again = collections.Counter(runs), set(), set(), 0
    for i, x in enumerate(runs):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_rules_base(spark, awkward, texts):
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op1_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: base_by_hand(t) for i, t in texts.items()}
    rows = quality_rules.judged(awkward).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(map(base_by_hand, AWKWARD)) and all(r.base_failed and not r.kept for r in rows if r.doc_id in (0, 1, 2, 3, 4))
    assert quality_rules.judged(awkward.limit(0)).count() == 0


def test_rules_verdict_follows_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality_rules.judged(docs).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2: SimHash


def fingerprint_by_hand(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(fps):
    """doc -> smallest doc reachable over links of 4 bits."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf, texts):
    fps = {i: fingerprint_by_hand(t) for i, t in texts.items()}
    want = groups_by_hand(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_simhash_links_in_small_tiles(spark):
    """Chains, dense groups and pairs over tile borders; tiles much smaller than the groups."""
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(300)]
    for _ in range(3):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.append(x)
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    got = {row.node: row.component for row in components(simhash.links(df, 4, 16), "u", "v").collect()}
    want = groups_by_hand(dict(enumerate(fps)))
    classes = collections.defaultdict(set)
    for k, f in enumerate(fps):
        classes[want[k]].add(signed[f])
    assert {frozenset(v) for v in classes.values() if len(v) > 1} == {frozenset(x for x in got if got[x] == c) for c in set(got.values())}


def test_simhash_awkward(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0} and all(r.fingerprint == "0" * 16 for r in rows if r.doc_id in (0, 1, 2))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(awkward).select("doc_id").collect())
    assert kept.count((False, 5)) == 1 and (False, 0) in kept and (False, 1) not in kept and (True, 0) in kept
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0 and simhash.keep_one(awkward.limit(0)).count() == 0
    assert simhash.keep_one(awkward).columns == awkward.columns


# 3: secrets


def test_secrets(spark, sf, texts):
    got = {(r.doc_id, r.start, r.stop, r.secret_sha256) for r in queries.op3_secret_scan(spark, sf).collect()}
    planted = {(i, m.start(1), m.end(1), hashlib.sha256(m[1].encode()).hexdigest()) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert planted <= got and len(got - planted) <= 0.05 * max(20, len(got))
    plan = secrets.scan(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_held_out(spark):
    findings = secrets.findings(seed=99, count=400)
    docs = made(spark, [b + c + a for b, c, a, _ in findings])
    hits = {r.doc_id for r in secrets.scan(docs).collect()}
    label = np.array([f[3] for f in findings])
    said = np.array([k in hits for k in range(len(findings))])
    assert said[label == 1].mean() > 0.95 and said[label == 0].mean() < 0.05


def test_secrets_candidates_by_hand(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("aB3/=- \n\"é") for _ in range(r.randint(0, 400))) for _ in range(150)] + AWKWARD
    want = {(k, m.start(), m.group()) for k, t in enumerate(texts) for m in re.finditer(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}", t or "")}
    got = {(row.doc_id, row.x.start, row.x.c) for row in secrets.candidates(made(spark, texts)).select("doc_id", F.explode("found").alias("x")).collect()}
    assert got == want
    assert secrets.scan(made(spark, AWKWARD)).count() == 0 and secrets.scan(made(spark, [])).count() == 0


def test_secrets_behind_long_names(spark):
    """What stands around a candidate is the text by position, other candidates included."""
    value = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    names = ["AWS_SECRET_ACCESS_KEY", "GITHUB_ACCESS_TOKEN", "STRIPE_SECRET_KEY", "token"]
    texts = [f'We set {n} = "{value}" there, then went on.' for n in names] + [f"The file_checksum_sha256 = {value} is a hash."]
    for row in secrets.candidates(made(spark, texts)).select("doc_id", F.explode("found").alias("x")).collect():
        t, x = texts[row.doc_id], row.x
        assert x.b == t[max(0, x.start - 40) : x.start] and x.a == t[x.start + len(x.c) :][:8]
    got = {(r.doc_id, r.secret) for r in secrets.scan(made(spark, texts)).collect()}
    assert {(k, value) for k in range(4)} <= got and (4, value) not in got


# 4: decontamination


def test_decontamination_finds_all_passages(spark, texts, sf):
    plain = lambda s: " ".join(re.findall(r"\w+", s.lower()))
    items = {r.item_id: plain(r.text) for r in table(spark, sf, "benchmark").collect()}
    want = {(i, k) for i, t in texts.items() for k, item in items.items() if item in plain(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op4_benchmark_decontamination(spark, sf).collect()}
    assert want <= got and len(got - want) <= 1


def test_decontamination_by_brute_force(spark):
    """Every document against every item, windows compared one by one; planted copies word by word, with other values, and torn ones."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7)))
    vocabulary = [word() for _ in range(60)]
    names, units = ["Anna", "Ben", "Carl", "Dora", "Emil", "Fay"], ["kg", "km", "hours", "%"]

    def item():
        kinds = [r.choice("wwwwwnNu") for _ in range(r.choice((3, 8, 20, 40)))]
        return "first " + " ".join({"w": r.choice(vocabulary), "n": str(r.randint(1, 99)), "N": r.choice(names), "u": f"{r.randint(1, 9)} {r.choice(units)}"}[k] for k in kinds)

    def other(text):
        """The same template with other values, alike for alike."""
        values: dict[str, str] = {}
        swap = lambda w: values.setdefault(w, str(int(w) + 100) if w.isdigit() else names[(names.index(w) + 1) % 6] if w in names else units[(units.index(w) + 1) % 4] if w in units else w)
        return " ".join(map(swap, text.split()))

    items = [item() for _ in range(40)]
    filler = lambda: " ".join(r.choice(vocabulary) for _ in range(30))
    torn = lambda t: " ".join(w for w in t.split() if r.random() > 0.1)
    copies = [t for k in range(40) for t in (items[k], other(items[k]), torn(items[k]), items[k].upper())]
    docs = [f"{filler()} {t} {filler()}" for t in copies] + [filler() for _ in range(20)]
    got = decontaminate.leaks(made(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()

    words, want = decontaminate.Words(), {}
    for k, text in enumerate(docs):
        template, plain, _ = words.canonical(text.encode())
        for n, it in enumerate(items):
            form, original, slots = words.canonical(it.encode())
            width = min(5, len(original))
            telling = [a for a in range(len(original) - width + 1) if sum(not s for s in slots[a : a + width]) >= min(2, width)]
            caseless = np.where(form == decontaminate.SLOTS[1], original, form)
            pairs = [(a, b) for b in range(len(template) - width + 1) for a in telling if any(list(x[a : a + width]) == list(template[b : b + width]) for x in (form, caseless))]
            if telling and len({a for a, _ in pairs}) >= 0.8 * len(telling):
                best = decontaminate.judged(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), dict(enumerate(plain.tolist())), original, slots, width, len(telling), 0.8)
                if best:
                    want[k, n] = (len(telling), *best)
    assert {(x.doc_id, x.item_id): tuple(x)[3:] for x in got} == want
    whole = {(4 * k + j, k) for k in range(40) for j in (0, 1) if any(n == k for _, n in want)}
    assert len(whole & set(want)) >= 0.9 * len(whole)  # recall of planted copies


def test_decontamination_parallel_clauses(spark):
    """Copies of items whose template windows repeat: verbatim ones, and one with other values; mixed-up values are none."""
    items = [
        "Anna buys 3 red apples, Tom buys 4 red apples, Eve buys 5 red apples.",
        "On day 1 the shop sold 12 small boxes, on day 2 the shop sold 15 small boxes, on day 3 the shop sold 19 small boxes. How many boxes were sold?",
    ]
    other = "On day 4 the shop sold 22 small boxes, on day 6 the shop sold 25 small boxes, on day 8 the shop sold 29 small boxes. How many boxes were sold?"
    around = "Some words stand in front of it here. {} And more words follow after it."
    docs = made(spark, [around.format(items[0]), around.format(items[1]), around.format(other), around.format("No item is in this one.")])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.verbatim, x.n_consistent == x.n_slots) for x in decontaminate.leaks(docs, bench).collect()}
    assert got == {(0, 0): (True, True), (1, 1): (True, True), (2, 1): (False, True)}
    assert [x.doc_id for x in decontaminate.clean(docs, bench).collect()] == [3]


def test_decontamination_slots(spark):
    item = "If Alice buys 3 apples and Bob buys 5 pears for 12 dollars then Alice has 3 apples in a bag of 2 kg total weight today."
    twin = "so it goes. If Carol buys 7 apples and Dave buys 9 pears for 30 dollars then Carol has 7 apples in a bag of 4 kg total weight today."
    mixed = twin.replace("then Carol has 7", "then Erin has 8").replace("of 4 kg", "of Zed kg")
    docs = made(spark, ["x y z. " + item, twin, item.upper(), mixed, "If it rains then the bag of apples is here today.", None, ""])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "7 8 9")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) - {3} == {0, 1, 2} and got[1].verbatim is False and got[2].verbatim is True and got[1].n_consistent == got[1].n_slots > 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [d for d in (3, 4, 5, 6) if d not in got]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(made(spark, AWKWARD), bench).count() == len(AWKWARD)


# 5: PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_hand(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii_base(spark, sf, texts):
    field, r = pii.trained(), random.Random(4)
    noise = ["".join(r.choice("a@.1+ ()-2|4\n") for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["1" * 50_000 + "." + "a@" * 20_000, "+" * 5000 + "1 " * 5000]
    for t in [*texts.values(), *noise[:-2]]:
        assert pii.base_spans(t) == {k: [s[1:] for s in spans_by_hand(t) if s[0] == k] for k in PATTERNS}
    for t in noise[-2:]:
        pii.find(t, field)  # ends soon
    got = {row.doc_id: row for row in queries.op5_pii(spark, sf).collect()}
    for i, t in texts.items():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans_by_hand(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_pii_field_on_held_out_sentences():
    field = pii.trained()
    hit = total = wrong = 0
    for text, gold in pii.examples(123, 400):
        got = {s for a, b in pii.islands(text) for s in field.decode(pii.Island(text, a, b))}
        hit, total, wrong = hit + len(got & set(gold)), total + len(gold), wrong + len(got - set(gold))
    assert hit > 0.95 * total and wrong < 0.05 * total
    assert pii.find("cards 7536784127813050 4845168114407329 here", field)[1]


def test_pii_decoding_is_the_best_of_all(spark):
    """The dynamic program against every segmentation of small islands."""
    field = pii.trained()
    for text in ("a@b.co 12", "1234567 8", "+1 23 4567890"):
        island = pii.Island(text, 0, len(text))
        scores = island.x @ field.weights.T + island.barred
        best = (-np.inf, None)

        def walk(at, last, score, spans):
            nonlocal best
            if at == len(island.tokens):
                best = max(best, (score, spans), key=lambda b: b[0])
                return
            walk(at + 1, 0, score + field.change[last, 0], spans)
            for k, (i, j) in enumerate(island.segments):
                if i == at:
                    for t in range(len(pii.KINDS)):
                        walk(j, t + 1, score + field.change[last, t + 1] + scores[k, t], [*spans, (pii.KINDS[t], *island.of(k))])

        walk(0, 0, 0.0, [])
        assert field.decode(island) == best[1]


def test_pii_letters_are_no_number():
    """Hex tokens hold no card or phone, whatever their digits."""
    r, field = random.Random(31), pii.trained()
    for _ in range(300):
        token = "".join(r.choice("0123456789012345678901234567890123456789ab") for _ in range(40))
        if not token.isdigit():
            spans = pii.find(f'token = "{token}" and more', field)[1]
            assert all(k not in ("card", "phone", "ssn") or token[a - 9 : b - 9].isdigit() for k, a, b in spans)
    assert any(k == "iban" for k, _, _ in pii.find("my IBAN: DE89370400440532013000 now", field)[1])


def test_pii_redaction(spark, awkward):
    docs = made(spark, ["call +1 (804) 555-2652 or mail jo.b@mail.example.com now", None])
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[0].text == "call <PHONE> or mail <EMAIL> now" and rows[0].n_chars == len(rows[0].text) and rows[1].text is None
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD) and pii.detect(awkward).count() == len(AWKWARD) and pii.detect(awkward.limit(0)).count() == 0


# 6: HTML


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
    <header><p>site name</p></header><div class="ad">buy &amp; buy this long advert text now please do</div><article><header><h1>A  &amp;
    title</h1></header><p><b>First long paragraph of the text that goes on for a while.<br><p>Of.</p><p>Second paragraph, also with some length to it, and <i>more</i>.</p>
    <div class="comments"><p>reader says hello</p></div><form><p>name</p></form></article><aside>side</aside><div id="cookie-notice">we use cookies</div><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "A & title\n\nFirst long paragraph of the text that goes on for a while.\n\nOf.\n\nSecond paragraph, also with some length to it, and more."
    plain = "<body><div id=nav><a>x</a> <a>y</a></div><div><p>" + "long text " * 20 + "</p><p>short</p><p>" + "more text " * 20 + "</p></div></body>"
    assert html_text.main_text(plain).split("\n\n")[1] == "short"
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "<script>x", "<!-- c")] == [""] * 5
    odd = spark.createDataFrame([(1, "u", page, "t"), (None, None, None, "t"), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(odd).collect())[0] == 0 and html_text.extract(odd).count() == 3 and html_text.extract(odd.limit(0)).count() == 0


LONG = ["The first paragraph goes on for quite a while, so that nobody takes it for a menu.", "The second paragraph has as much to say, and says it at some length as well.", "And a third one closes the article with words enough to be told from its surroundings."]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
TEXT = "\n\n".join(LONG)


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="page has-sidebar"><nav><a>x</a></nav><div>{BODY}</div></div></body>', TEXT),
        (f'<body><div class="with-sidebar"><article>{BODY}</article></div><div class="sidebar"><p>side</p></div></body>', TEXT),
        (f'<body><form><nav><ul><li><a>one</a></li></ul></nav><div>{BODY}</div><input></form></body>', TEXT),
        (f'<body><article><p class="notice-board">{LONG[0]}</p><h2 class="share-price">Price</h2><p>{LONG[1]}</p><div class="comments"><p>{LONG[2]}</p></div></article></body>', f"{LONG[0]}\n\nPrice\n\n{LONG[1]}"),
        (f"<body><main>{BODY}</main><article><p><a>Read on here</a></p></article></body>", TEXT),
        (f"<body><div><section>{BODY}</section><section><p>{LONG[1]}</p><p>{LONG[2]}</p></section></div></body>", f"{TEXT}\n\n{LONG[1]}\n\n{LONG[2]}"),
        (f'<html><title>T</title><body><div class="post-header"><h1>Title</h1></div><div>{BODY}</div></body>', f"Title\n\n{TEXT}"),
        (f"<html><head><title>T</title><body><div>{BODY}</div></body>", TEXT),
        (f"<body><div><p>{LONG[0]}</p><blockquote>{LONG[1]}</blockquote><table><tr><td>{LONG[2]}</td></tr></table></div></body>", TEXT),
        (f"<body><div><a>one</a><br><a>two</a></div><div>{BODY}<p>Of.</p></div><div><a>three</a></div></body>", f"{TEXT}\n\nOf."),
    ],
)
def test_html_shapes(page, want):
    assert html_text.main_text(page) == want


def test_html_clusters_decide(monkeypatch):
    """Threshold and smoothing change what is taken from a page without any name or tag that tells."""
    links = "<div>" + "".join(f"<p>entry {k}</p>" for k in range(40)) + "</div>"
    page = f"<body>{links}<div>{BODY}</div></body>"
    assert html_text.main_text(page) == TEXT
    assert html_text.main_text(page, factor=0.0) != TEXT and html_text.main_text(page, factor=4.0) != html_text.main_text(page, factor=0.0)
    monkeypatch.setattr(html_text, "smooth", lambda r, sigma: np.zeros(len(r)))
    assert html_text.main_text(page) != TEXT


def test_html_deep_pages_are_linear():
    import time
    import tracemalloc

    for part in ("<div>", "<b>", "<div><b></i>", "<p>x<b>"):
        tracemalloc.start()
        begin = time.process_time()
        html_text.main_text(part * 20_000 + "some text that is there")
        took, (_, peak) = time.process_time() - begin, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert took < 20 and peak < 100 << 20
    assert html_text.main_text("<div>" * 100_000 + "some text that is there") == "some text that is there"


def test_html_on_pages(spark, sf):
    import html as entities

    for r in queries.op6_html_extraction(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\x01", article)).split("\x01")
        assert r.text == "\n\n".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))
        assert r.n_chars == len(r.text)


# 7: WARC


def test_loser_tree():
    r = random.Random(5)
    for _ in range(200):
        runs = [sorted(r.randrange(30) for _ in range(r.randrange(8))) for _ in range(r.randrange(9))]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(v for x in runs for v in x)


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 100
    rows = [(1, "http://b.example.com/x?q#f", body), (2, "http://a.example.com/", body), (3, "HTTPS://www.a.example.com:80/", body), (4, "u\r\nX: y", "WARC/1.1\r\n\r\nshort"), (5, "v", "WARC/1.1\r\n\r\nshort"), (6, None, None), (7, "w", "")]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = shared_path(spark, "warc-test")
    got = {r.page_id: r for r in warc.round_trip(pages, path).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), **{k: ("response", None) for k in (4, 5, 6, 7)}}
    history = [(r.url_key, r.captured, r.page_id) for r in sorted(got.values(), key=lambda r: r.history)]
    assert history == sorted(history) and got[2].url_key == got[3].url_key == "com,example,a)/"
    files = spark.read.format("binaryFile").load(path).collect()
    for f in files:
        for h, at, size, _, _ in warc.parse(bytes(f.content)):
            assert bytes(f.content)[at : at + 8] == b"WARC/1.1" and size > 0 and h["warc-type"] in ("response", "revisit")
    assert warc.round_trip(pages.limit(0), shared_path(spark, "warc-none")).count() == 0


def test_warc_awkward(spark):
    """Ids of 2^62 and below zero, null and repeated ids, a page of 50 MB, many revisits, an empty table, and files and slices much smaller than the whole."""
    body, common = "<p>" + "x" * 120, "<p>" + "y" * 300
    rows = [(1 << 62, "http://a.example.com/", body), (10**13, "http://a.example.com/", body), (-5, "b", body), (None, "c", body), (None, "c", "z" * 200), (7, "d", "é" * 25_000_000), (7, "d", common)]
    rows += [(100 + k, f"http://h{k % 7}.example.com/{k}", common if k % 3 else "w" * k) for k in range(300)] + [(100, "http://h0.example.com/0", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = shared_path(spark, "warc-test")
    warc.write(warc.records(pages, most=1), path, file_bytes=1 << 17)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) > 3 and sum(f.length > 1 << 17 for f in files) == 1
    index = warc.merged(warc.saved(warc.read(spark, path)), rows=37).collect()
    once = warc.histories(pages).collect()
    assert collections.Counter(r[:7] for r in index) == collections.Counter(r[:7] for r in once) and len(index) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None and len(html.encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = collections.Counter()
    for i, _, html in rows:
        f = first.get(html)
        again = f is not None and (i is None or i > f)
        want[(i, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", f if again else None)] += 1
    assert collections.Counter(tuple(r[:5]) for r in index) == want and any(k[3] == "revisit" for k in want)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(index, key=lambda r: r.history)]
    assert order == sorted(order) and sorted(r.history for r in index) == list(range(1, len(rows) + 1)) and all(len(r.captured) == 20 for r in index)
    assert warc.histories(pages.limit(0)).count() == 0


def test_lookups_agree(spark):
    """Keys by broadcast, by shuffle, and by both."""
    r = random.Random(13)
    left = [(r.choice((1, 1, 1, r.randrange(40))), k) for k in range(300)]
    counts = collections.Counter(k for k, _ in left)
    keys = spark.createDataFrame([(k, n, -k) for k, n in counts.items() if k % 2 or k > 20], "k long, n long, v long")
    rows = spark.createDataFrame(left, "k long, x long")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, rows.join(keys.drop("n"), "k", how).collect()))
        for most in (1, 5, 100):
            assert sorted(map(str, looked_up(rows, keys, "k", "n", how, most).collect())) == want


# 8: classifier


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_awkward(spark, awkward):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (7, 1), (8, 0), (3, 1)], "doc_id long, quality int")
    model = bayes_svm.train(awkward, labels)
    assert bayes_svm.score(awkward, model).count() == len(AWKWARD) and bayes_svm.accepted(awkward, model).columns == awkward.columns
    none = bayes_svm.train(awkward, labels.limit(0))
    assert {r.score for r in bayes_svm.score(awkward, none).collect()} == {0.5}
    only = bayes_svm.train(awkward, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in bayes_svm.score(awkward, only).collect())
    assert bayes_svm.score(awkward.limit(0), none).count() == 0


def test_classifier_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Of long texts fewer rows are taken, in the order of the sample's hash; with room for all, all are."""
    texts = [(k, " ".join(f"w{k}x{i}" for i in range(200))) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    took = []
    monkeypatch.setattr(bayes_svm, "fit", lambda rows, y, bits: took.append(sum(4 * len(r) for r in rows)) or len(rows))
    free = sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(40))
    assert bayes_svm.train(docs, labels) == free and took[0] > 20_000
    assert 1 < bayes_svm.train(docs, labels, most=20_000) < free and took[1] <= 20_000
    assert bayes_svm.train(docs, labels, most=1) == 1


def test_dual_coordinate_descent_closes_the_gap():
    """The primal and the dual value meet at the optimum."""
    r = np.random.default_rng(6)
    rows = [np.unique(r.integers(0, 40, 6)) for _ in range(120)]
    values = [r.normal(size=len(x)) for x in rows]
    y, cost = r.choice([-1.0, 1.0], 120), r.uniform(0.1, 1.0, 120)
    w, b, dual = bayes_svm.descend(rows, values, y, cost, 64, 400, 1)
    length = 0.5 * (w @ w + b * b)
    primal = length + sum(c * max(0.0, 1 - t * (w[x] @ v + b)) for x, v, t, c in zip(rows, values, y, cost))
    assert (dual >= 0).all() and (dual <= cost).all() and abs(primal - (dual.sum() - length)) < 1e-3 * primal


# 9: substring dedup


def passages_by_hand(text):
    """(start, stop, words): pieces end with a line or with the marks of a sentence; those without words are left out."""
    found = []
    for m in re.finditer(r"[^.!?\n]*[.!?]*\n?", text or ""):
        words = re.findall(r"[^\x20\x09-\x0D]+", m[0].lower())
        if words:
            found.append((m.start(), m.end(), words))
    return found


def test_passages_by_hand(texts):
    r = random.Random(14)
    some = [*texts.values(), *AWKWARD, *("".join(r.choice("aBé. !?\n\t中🙂") for _ in range(r.randint(0, 80))) for _ in range(300))]
    ids = pa.array(range(len(some)))
    for chunk in (1 << 20, 7):
        b = substring.Batch(ids.slice(0, len(some)), pa.array(some), 5, chunk)
        got = list(zip(b.ids.to_pylist(), b.no.tolist(), b.start.tolist(), b.stop.tolist(), b.counts.tolist()))
        want = [(k, i, x[0], x[1], len(x[2])) for k, t in enumerate(some) for i, x in enumerate(passages_by_hand(t))]
        assert got == want
        words = [tuple(x[2]) for t in some for x in passages_by_hand(t)]
        assert len(set(words)) == len(set(zip(words, b.keys.tolist()))) == len(set(b.keys.tolist()))
    assert len(substring.Batch(pa.array([], pa.int64()), pa.array([], pa.string()), 5).keys) == 0


def test_repeated_passages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    sentence = lambda: (" ".join(word() for _ in range(r.randint(6, 18))) + ".").capitalize()
    text = lambda n: " ".join(sentence() for _ in range(n))
    shared = [" ".join(sentence() for _ in range(7)) for _ in range(3)]
    docs = {k: text(12) for k in range(60)}
    for k in range(10):
        at = docs[k].split(" ")
        docs[k] = " ".join([*at[:20], shared[k % 3], *at[20:]])
    docs[10] = docs[11] = text(20)
    edited = docs[12].split(" ")
    edited[len(edited) // 2] = "changed"
    docs[13] = " ".join(edited)
    got = substring.repeated(made(spark, list(docs.values()))).collect()
    assert {x.doc_id for x in got} == set(range(14))
    for x in got:
        if x.doc_id < 10:
            assert len(set(docs[x.doc_id][x.start : x.stop].split()) & set(shared[x.doc_id % 3].split())) > 15
    assert {x.doc_id for x in got if not x.remove} >= {0, 1, 2, 10, 12}
    out = {x.doc_id: x.text for x in substring.without_repeats(made(spark, list(docs.values()))).collect()}
    assert len(out) == 60 and out[20] == docs[20] and out[11] == "" and len(out[3]) < len(docs[3])


@pytest.mark.parametrize("lengths", [(55,), (62,), (30, 28), (26, 26), (13, 14, 12, 16), (6, 7, 5, 8, 6, 9, 7, 6)])
def test_passages_among_short_sentences_are_found(spark, lengths):
    """Passages of 50 to 62 words in the middle of lines of short sentences, against the places they were put at."""
    r = random.Random(str(lengths))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    line = lambda: [sentence(r.randint(2, 8)) for _ in range(r.randint(5, 9))]
    shared = [" ".join(sentence(n) for n in lengths) for _ in range(8)]
    docs, places = [], []
    for k in range(24):
        before, after = " ".join([*line(), ""]), " ".join(["", *line()])
        docs.append(before + shared[k // 3] + after)
        places.append((len(before), len(before) + len(shared[k // 3])))
    covered = {k: set() for k in range(24)}
    for x in substring.repeated(made(spark, docs)).collect():
        covered[x.doc_id] |= set(range(x.start, x.stop))
    for k, (a, b) in enumerate(places):
        assert covered[k] >= set(range(a, b)) and len(covered[k]) <= b - a + 1


def test_neighbouring_passages_keep_their_classes(spark):
    """Each passage of a run keeps all its places, and goes wherever it has an earlier one."""
    r = random.Random(18)
    sentence = lambda: (" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)) + ".").capitalize()
    a, b, c = [" ".join(sentence() for _ in range(2)) for _ in range(3)]
    own = [sentence() for _ in range(6)]
    docs = [f"{a}\n{own[0]}", f"{own[1]}\n{a}\n{b}", f"{b}\n{own[2]}", f"{c}\n{b}\n{c}\n{own[3]}", own[4], f"{a}\n{b}"]
    places = {}
    for x in substring.repeated(made(spark, docs)).collect():
        places.setdefault(x.class_id, set()).add((x.doc_id, docs[x.doc_id][x.start : x.stop].strip(), x.remove))
    want = [{(0, a, False), (1, a, True), (5, a, True)}, {(1, b, False), (2, b, True), (3, b, True), (5, b, True)}, {(3, c, False), (3, c, True)}]
    assert sorted(map(sorted, places.values())) == sorted(map(sorted, want))
    out = {x.doc_id: x.text.split() for x in substring.without_repeats(made(spark, docs)).collect()}
    assert [out[k] for k in range(6)] == [t.split() for t in (docs[0], f"{own[1]} {b}", own[2], f"{c} {own[3]}", own[4], "")]


def test_verified_links_lose_nothing(spark):
    """Links against brute force over the same passages, with a bucket whose least member fails."""
    r = random.Random(9)
    base = [f"w{r.randrange(60)}" for _ in range(60)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(60)] = f"z{r.randrange(9)}"
        texts.append(" ".join(words) + ".")
    docs = made(spark, texts)
    # With one value a band and many bands almost all pairs meet, so the tiles must say which are links.
    source, store = substring.Source(docs, 5, 40, 1, 0.8), substring.Store(spark, "links-test")
    got = {(x.u, x.v) for x in substring.verified(source, store(source.passages()), store, tile=7).collect()}
    batch = substring.Batch(pa.array(range(60)), pa.array(texts), 5)
    shingles, first = batch.shingled()
    sets = {int(k): frozenset(shingles[a:b].tolist()) for k, a, b in zip(batch.keys.view(np.int64), first, np.append(first[1:], len(shingles)))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}

    def classes(pairs):
        root = {x: x for x in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(x for x in sets if find(x) == c) for c in map(find, sets)}

    assert classes(got) == classes(want) and all(tuple(sorted(p)) in want for p in got)


def test_substring_awkward(spark, awkward):
    assert substring.repeated(awkward.limit(0)).count() == 0
    out = substring.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)


# 10: packing


def encoder():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return packing.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN), lambda t: reference.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(texts):
    own, reference = encoder()
    r = random.Random(10)
    odd = [None, "", " ", "a  b", " a", "a ", "a \nb", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b  c", "<|endof text|>", "it's 12  34 é　b c\xa0 d", "don 't go 's"] + ["".join(r.choice("aé '1.\n\t  s") for _ in range(r.randint(0, 30))) for _ in range(400)]
    for some in (odd, list(texts.values())[:60], [" "], ["one"], []):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(some, pa.string()))] == [reference(t) for t in some]


def check_packing(rows, ids_of):
    at, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in at.items():
        ids, place = ids_of[doc], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == place and p.doc_tokens == len(ids)
            place += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : place], "<u4").tobytes())
        assert place == len(ids)
    for pieces in sequences.values():
        place = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == place
            place += p.length
        assert place <= 1024
    return sum(r.length for r in rows) / (1024 * len(sequences))


def test_packing(spark, sf, texts):
    _, reference = encoder()
    rows = queries.op10_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert check_packing(rows, {i: [*reference(t), 0] for i, t in texts.items()}) > 0.93


def test_packing_awkward(spark, awkward):
    import public_tokenizers as P

    args = (P.path("byte_bpe_50k.json"), P.PATTERN)
    rows = packing.pack(awkward, *args).collect()
    _, reference = encoder()
    assert sum(r.length for r in rows) == sum(len(reference(t)) + 1 for t in AWKWARD)
    assert packing.pack(awkward.limit(0), *args).count() == 0


def test_differencing():
    r = random.Random(11)
    for n, k in ((1, 1), (5, 3), (40, 7), (200, 30)):
        sizes = [r.randint(1, 200) for _ in range(n)]
        held = packing.differencing(sizes, k)
        assert sorted(i for w in held for i in w) == list(range(n)) and len(held) == k
    sums = [sum(sizes[i] for i in w) for w in held]
    assert max(sums) - min(sums) <= 60
    windows = packing.pool_windows(sizes, 256)
    assert all(sum(sizes[i] for i in w) <= 256 for w in windows) and packing.differencing([], 3) == []


# all


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_oracle(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark, sf, texts):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]
    docs, path, seen = table(spark, sf, "documents"), shared_path(spark, "pipeline-test"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen.append(docs.collect())
    quality, dedup, clean, private, packed = seen
    groups = groups_by_hand({r.doc_id: fingerprint_by_hand(r.text) for r in quality})
    assert {r.doc_id for r in dedup} == {i for i, g in groups.items() if i == g}
    assert {r.doc_id for r in clean} <= {r.doc_id for r in dedup} and len(private) == len(clean)
    assert not any(spans_by_hand(r.text) for r in private)
    _, reference = encoder()
    check_packing(packed, {r.doc_id: [*reference(r.text), 0] for r in private})
    assert c.run(spark, sf).count() == len(packed)
