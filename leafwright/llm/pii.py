"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns. The field looks at islands, runs of words
with a digit or an at sign: every segment of bounded length that could be an
entity is scored by features of the whole span (digit counts, checksums, form,
separators, what stands before), and dynamic programming chooses boundaries and
types together. Text outside islands cannot hold an entity, so leaving it out is
exact. The field is fitted here on sentences made by rule. Its spans are added
where they meet no base span; base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuples

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
LETTERLESS = ("ip", "card", "phone", "ssn")  # a span with a letter is none of these
LONGEST = 24  # tokens of a segment

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each base kind, those dropped that fail its test."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    at, free = text.find("@"), 0
    while at >= 0:
        # A match's local part is the run of its characters right before the at sign.
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found["email"].append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                found["phone"].append(m.span())
    return found


def islands(text: str) -> list[tuple[int, int]]:
    """Runs of words, one space apart, that each have a digit or an at sign."""
    found: list[tuple[int, int]] = []
    m = ANCHOR.search(text)
    while m:
        floor = found[-1][1] if found else 0
        start = m.start()
        while start > floor and not text[start - 1].isspace():
            start -= 1
        stop = (n.start() if (n := SPACE.search(text, m.start())) else len(text))
        if found and start == found[-1][1] + 1 and text[start - 1] == " ":
            found[-1] = (found[-1][0], stop)
        else:
            found.append((start, stop))
        m = ANCHOR.search(text, stop)
    return found


CUES = {
    "email": ("mail", "email", "e-mail", "courriel", "correo", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "ring"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security", "taxpayer", "insurance"),
}
NAMES = (
    "bias at dots_at octets octets_ok d4-6 d7-9 d10-11 d12-13 d14-15 d16-19 d20+ luhn plus paren groups3 groups4x4 ssn_form iban_form iban_ok letters"
    " hyphen space comma odd short_groups lone_run cue_email cue_ip cue_card cue_phone cue_iban cue_ssn long zero_lead phone_form"
).split()
PLACE = {n: k for k, n in enumerate(NAMES)}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FORM_PHONE = re.compile(r"\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}")
FORM_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
FORM_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def features(span: str, before: list[str]) -> np.ndarray:
    """Features of one whole candidate span; ``before``: up to three words in front of it, lower case."""
    on = ["bias"]
    digits = "".join(DIGIT.findall(span))
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    n = len(digits)
    if "@" in span:
        on += ["at"] + ["dots_at"] * bool(EMAIL.fullmatch(span))
    if IP.fullmatch(span):
        on += ["octets"] + ["octets_ok"] * all(len(p) <= 3 and int(p) <= 255 for p in span.split("."))
    for low, high in ((4, 6), (7, 9), (10, 11), (12, 13), (14, 15), (16, 19)):
        if low <= n <= high:
            on.append(f"d{low}-{high}")
    on += ["d20+"] * (n >= 20) + ["luhn"] * (16 <= n <= 19 and luhn(digits)) + ["plus"] * (span[0] == "+") + ["paren"] * ("(" in span)
    on += ["groups3"] * (len(groups) == 3) + ["groups4x4"] * (groups == [4, 4, 4, 4]) + ["ssn_form"] * bool(FORM_SSN.fullmatch(span))
    if FORM_IBAN.fullmatch(span):
        plain = span.replace(" ", "")
        on += ["iban_form"] + ["iban_ok"] * (int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    on += ["letters"] * any(c.isalpha() for c in span) + ["hyphen"] * ("-" in span) + ["space"] * (" " in span) + ["comma"] * ("," in span)
    on += ["odd"] * bool(re.search(r"[^A-Za-z0-9 +().@%_-]", span)) + ["short_groups"] * (bool(groups) and max(groups) <= 2) + ["lone_run"] * (len(groups) == 1 and span.isdigit())
    on += ["phone_form"] * bool(FORM_PHONE.fullmatch(span)) + ["long"] * (len(span) > 40) + ["zero_lead"] * (digits[:1] == "0")
    on += [f"cue_{k}" for k, words in CUES.items() if not set(words).isdisjoint(before)]
    x = np.zeros(len(NAMES))
    x[[PLACE[o] for o in on]] = 1
    return x


class Island:
    """An island's tokens and the features of its admissible segments; all else is outside."""

    def __init__(self, text: str, start: int, stop: int, longest: int = LONGEST):
        self.tokens = [(m.start() + start, m.end() + start) for m in TOKEN.finditer(text[start:stop])]
        before = [w.strip(".,:;()|\"'=#").lower() for w in text[max(0, start - 60) : start].split()[-3:]]
        self.segments: list[tuple[int, int]] = []
        rows = []
        starts = [t[0] for t in self.tokens]
        stops = [t[1] for t in self.tokens]
        for i, a in enumerate(starts):
            c = text[a]
            # An entity starts at a letter, a digit, a plus or a bracket and is no part of a longer word.
            if not (c.isalnum() or c in "+(") or (c.isalnum() and a and text[a - 1].isalnum()):
                continue
            for j in range(i, min(len(stops), i + longest)):
                b = stops[j]
                if not text[b - 1].isalnum() or (b < len(text) and text[b].isalnum()):
                    continue
                span = text[a:b]
                if "@" in span or sum(map(span.count, "0123456789")) >= 7:
                    self.segments.append((i, j + 1))
                    rows.append(features(span, before))
        self.x = np.array(rows).reshape(-1, len(NAMES))
        # Added to scores: types that a segment cannot have.
        self.barred = self.x[:, [PLACE["letters"]]] * np.array([-1e9 if k in LETTERLESS else 0.0 for k in KINDS])

    def of(self, k: int) -> tuple[int, int]:
        i, j = self.segments[k]
        return self.tokens[i][0], self.tokens[j - 1][1]


class Field:
    """Scores: weights[type] . features of a segment, plus a change from the type before (0: outside)."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), len(NAMES)))
        self.change = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _by_end(self, island: Island):
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(island.segments):
            ends.setdefault(j, []).append(k)
        return ends

    def decode(self, island: Island) -> list[tuple[str, int, int]]:
        if not island.segments:
            return []
        scores, ends, n, y = island.x @ self.weights.T + island.barred, self._by_end(island), len(island.tokens), len(KINDS) + 1
        best = np.full((n + 1, y), -np.inf)
        best[0, 0] = 0.0
        back: list[list] = [[None] * y for _ in range(n + 1)]
        for j in range(1, n + 1):
            into = best[j - 1] + self.change[:, 0]
            p = int(into.argmax())
            best[j, 0], back[j][0] = into[p], (j - 1, p, None)
            for k in ends.get(j, ()):
                i = island.segments[k][0]
                into = best[i][:, None] + self.change[:, 1:] + scores[k]
                p = into.argmax(0)
                for t in range(y - 1):
                    if into[p[t], t] > best[j, t + 1]:
                        best[j, t + 1], back[j][t + 1] = into[p[t], t], (i, int(p[t]), k)
        out, j, t = [], n, int(best[n].argmax())
        while j:
            i, p, k = back[j][t]
            if k is not None:
                out.append((KINDS[t - 1], *island.of(k)))
            j, t = i, p
        return out[::-1]

    def _gradient(self, island: Island, gold: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood; gold: segment -> type."""
        scores, n, y = island.x @ self.weights.T + island.barred, len(island.tokens), len(KINDS) + 1
        ends = self._by_end(island)
        starts: dict[int, list[int]] = {}
        for k, (i, _) in enumerate(island.segments):
            starts.setdefault(i, []).append(k)
        forward = np.full((n + 1, y), -np.inf)
        forward[0, 0] = 0.0
        for j in range(1, n + 1):
            forward[j, 0] = np.logaddexp.reduce(forward[j - 1] + self.change[:, 0])
            for k in ends.get(j, ()):
                into = np.logaddexp.reduce(forward[island.segments[k][0]][:, None] + self.change[:, 1:], axis=0) + scores[k]
                forward[j, 1:] = np.logaddexp(forward[j, 1:], into)
        backward = np.full((n + 1, y), -np.inf)
        backward[n] = 0.0
        for i in range(n - 1, -1, -1):
            backward[i] = self.change[:, 0] + backward[i + 1, 0]
            for k in starts.get(i, ()):
                out = np.logaddexp.reduce(self.change[:, 1:] + scores[k] + backward[island.segments[k][1], 1:], axis=1)
                backward[i] = np.logaddexp(backward[i], out)
        total = backward[0, 0]
        dw, dt = np.zeros_like(self.weights), np.zeros_like(self.change)
        for j in range(n):
            dt[:, 0] -= np.exp(forward[j] + self.change[:, 0] + backward[j + 1, 0] - total)
        for k, (i, j) in enumerate(island.segments):
            p = np.exp(forward[i][:, None] + self.change[:, 1:] + scores[k] + backward[j, 1:] - total)
            dt[:, 1:] -= p
            dw -= p.sum(0)[:, None] * island.x[k]
        at, last = 0, 0
        for k, t in sorted(gold.items(), key=lambda g: island.segments[g[0]]):
            i, j = island.segments[k]
            for _ in range(at, i):
                dt[last, 0] += 1
                last = 0
            dt[last, t + 1] += 1
            dw[t] += island.x[k]
            at, last = j, t + 1
        for _ in range(at, n):
            dt[last, 0] += 1
            last = 0
        return dw, dt


def examples(seed: int, count: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences made by rule, with their entities, and with numbers that are none."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(good=True):
        while True:
            d = number(r.choice((16, 16, 16, 19)))
            if luhn(d) == good:
                return d if r.random() < 0.6 or len(d) > 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def iban():
        land, body = r.choice(("DE", "FR", "ES", "GB")), number(r.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        plain = f"{land}{check:02d}{body}"
        return plain if r.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))

    def phone():
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 {number(2)} {c} {number(4)}", f"+{number(2)} {a} {b} {c}"))

    make = {
        "email": lambda: f"{word()}{r.choice(('.', '_', ''))}{number(2)}{r.choice(('@', '@', '@', ' @ '))}{word()}{number(1)}.{r.choice(('com', 'org', 'example.net'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
        "iban": iban,
        "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
    }
    none = [
        lambda: card(False), lambda: number(r.randint(1, 15)), lambda: f"{number(1)}.{number(1)}.", lambda: f"{r.randint(1900, 2040)}-{number(2)}-{number(2)}",
        lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f'"{hashlib.sha1(number(9).encode()).hexdigest()}"', lambda: f"{number(3)},{number(3)},{number(3)}",
        lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"{r.randint(256, 999)}.{number(3)}.{number(3)}.{number(3)}", lambda: "@" + word(), lambda: number(r.randint(20, 40)),
        lambda: f"{number(2)}/{number(2)}/{r.randint(1900, 2040)}", lambda: f"ISBN 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: " ".join(number(r.randint(1, 4)) for _ in range(r.randint(3, 8))), lambda: f"{number(4)}-{number(4)}", lambda: f"{number(1)}e-{number(2)} {number(7)}",
    ]
    made = []
    for _ in range(count):
        text, gold = " ".join(word() for _ in range(r.randint(1, 4))) + " ", []
        kind = r.choice(KINDS) if r.random() < 0.6 else None
        if kind:
            if r.random() < 0.35:
                text += r.choice(CUES[kind]) + r.choice((": ", " ", " is "))
            value = make[kind]()
            gold.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += r.choice(none)()
        text += r.choice(("", ".", ",", " ")) + " " + word()
        made.append((text, gold))
    return made


@lru_cache(maxsize=4)
def trained(seed: int = 11, count: int = 500, rounds: int = 6, rate: float = 0.5, decay: float = 1e-3) -> Field:
    field = Field()
    rows = []
    for text, gold in examples(seed, count):
        for start, stop in islands(text):
            island = Island(text, start, stop)
            spans = {island.of(k): k for k in range(len(island.segments))}
            if island.segments:
                rows.append((island, {spans[g[1:]]: KINDS.index(g[0]) for g in gold if g[1:] in spans}))
    order = random.Random(seed)
    sums = [np.full_like(field.weights, 1e-2), np.full_like(field.change, 1e-2)]
    for _ in range(rounds):
        order.shuffle(rows)
        for island, gold in rows:
            steps = field._gradient(island, gold)
            for w, g, s in zip((field.weights, field.change), steps, sums):
                g = g - decay * w
                s += g * g
                w += rate * g / np.sqrt(s)
    return field


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind, then start; offsets in code points."""
    base = [(k, a, b) for k, spans in base_spans(text).items() for a, b in spans]
    taken = sorted((a, b) for _, a, b in base)
    added, k = [], 0
    for start, stop in islands(text):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        near, i = [], k
        while i < len(taken) and taken[i][0] < stop:
            near.append(taken[i])
            i += 1
        if len(near) == 1 and near[0][0] - start <= 1 and stop - near[0][1] <= 3:
            continue  # a base span fills the island: nothing is left to add
        for kind, a, b in field.decode(Island(text, start, stop)):
            if all(b <= c or d <= a for c, d in near):
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _line(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; counts are of base spans.

    A null text is empty and has no spans. Repeated rows and null ids each give
    a row; other columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        field = shared.value
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        for batch in batches:
            ids, texts = tuples(batch, "doc_id", "text")
            counts, digests, lines = [[] for _ in BASE], [], []
            for text in texts:
                base, spans = find(text or "", field)
                for c, k in zip(counts, BASE):
                    c.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(spans))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(lines, pa.string())], names)

    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def masked(text: str, field: Field) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the union by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(find(text, field)[1], key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in text masked, n_chars made to fit; all columns and rows stay.

    Null and empty texts stay as they are. Null ids and repeated rows are masked
    like others, further columns pass through. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    at = docs.columns.index("text")

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = [t if t is None else masked(t, field) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
