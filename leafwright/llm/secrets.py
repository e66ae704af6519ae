"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

The forest is fitted on labelled findings (made by rule here, or given) on the
driver, whose count is bounded, and becomes a Catalyst expression: sums of
nested CASEs that run in the scan's own stage, next to the text, with no
shuffle and no Python.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A candidate: a whole run of 16 or more of the characters that keys have.
CANDIDATE = r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+={0,2}"
#: Text in front of a candidate, then the candidate; \G keeps a scan that finds no more from starting over.
SPLIT = rf"(?s)\G(.*?)({CANDIDATE})"
#: Words whose letters in a candidate speak for prose or paths.
DICTIONARY = (
    "the and tion ing ent ation for with that this from have able ment http https www com org net html index page image user home src lib bin usr var etc"
    " test example sample dummy placeholder changeme config data file name value version license public general private class public static void"
    " lich keit heit ung ver sch ein der die que elle eau aux ment ción mente ado"
).split()
KEYWORDS = r"(?i)(key|token|secret|passwd|password|pwd|credential|auth|bearer|apikey|access|private)[a-z_]*[\x22']?\s*(=>|[:=]|is)?\s*[\x22']?$"
BENIGN = r"(?i)(sha1|sha256|sha|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|integrity|example|sample|id)[a-z_]*[\x22']?\s*[:=]?\s*[\x22']?$"

#: Feature -> SQL over a struct x of c (candidate), b (up to 40 characters before) and a (up to 8 after).
FEATURES = {
    "length": "cast(length(x.c) as double)",
    "digits": "regexp_count(x.c, '[0-9]') / length(x.c)",
    "uppers": "regexp_count(x.c, '[A-Z]') / length(x.c)",
    "changes": "regexp_count(x.c, '[a-z](?=[0-9A-Z])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])') / length(x.c)",
    "vowels": "regexp_count(x.c, '[aeiouAEIOU]') / (1 + regexp_count(x.c, '[A-Za-z]'))",
    "pairs": "regexp_count(x.c, '(?i)[bcdfghjklmnpqrstvwxz](?=[aeiou])|[aeiou](?=[bcdfghjklmnpqrstvwxz])') / length(x.c)",
    "distinct": "array_size(array_distinct(split(x.c, ''))) / least(length(x.c), 40)",
    "repeats": r"regexp_count(x.c, '(.)(?=\\1)') / length(x.c)",
    "hex": "cast(regexp_like(x.c, '^([0-9a-f]+|[0-9A-F]+)$') as double)",
    "words": f"1 - length(regexp_replace(lower(x.c), '{'|'.join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))}', '')) / length(x.c)",
    "path": "cast(regexp_like(x.c, '[/.][A-Za-z_-]+[/.]|^/|[.][a-z]{2,4}$') or regexp_like(x.b, '[/@]$') as double)",
    "uuid": "cast(regexp_like(x.c, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') as double)",
    "separators": "regexp_count(x.c, '[/_.-]') / length(x.c)",
    "keyword": f"cast(regexp_like(x.b, r\"{KEYWORDS}\") as double)",
    "benign": f"cast(regexp_like(x.b, r\"{BENIGN}\") as double)",
    "quoted": "cast(regexp_like(x.b, r\"[\\x22'`]$\") and regexp_like(x.a, r\"^[\\x22'`]\") as double)",
    "prefix": "cast(regexp_like(x.c, '^(AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ)') as double)",
}


def findings(seed: int = 23, count: int = 1200) -> list[tuple[str, str, str, int]]:
    """Labelled findings made by rule: (before, candidate, after, 1 for a secret)."""
    r = random.Random(seed)
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    syllables = "an ber ca de el fi gra hon in ja kel la mo nt or pre qui re so th un ver wh xi you zu tion ing ent lich".split()
    word = lambda n=4: "".join(r.choice(syllables) for _ in range(r.randint(2, n)))
    hexa = lambda n: some("0123456789abcdef", n)
    secrets = [
        lambda: hexa(r.choice((32, 40, 48, 64))), lambda: hexa(40).upper(), lambda: some(low + up + digit, r.randint(20, 48)), lambda: some(low + up + digit + "+/", r.choice((40, 44, 64, 88))),
        lambda: "AKIA" + some(up + digit, 16), lambda: "ghp_" + some(low + up + digit, 36), lambda: "sk_live_" + some(low + up + digit, 24), lambda: "xoxb-" + some(digit, 12) + "-" + some(low + up + digit, 24),
        lambda: "AIza" + some(low + up + digit + "_-", 35), lambda: "eyJ" + some(low + up + digit, 60) + "." + some(low + up + digit + "_-", 43),
    ]
    named = ("token", "api_key", "secret", "password", "access_token", "auth", "private_key", "apikey", "client_secret", "TOKEN", "SECRET_KEY")
    plain = [
        lambda: word(9) + word(9), lambda: (word(9) + word(9)).upper(), lambda: "/".join(word() for _ in range(r.randint(3, 6))), lambda: "-".join(word() for _ in range(r.randint(3, 7))),
        lambda: "_".join(word() for _ in range(r.randint(3, 7))), lambda: ".".join(word() for _ in range(3)) + r.choice((".com", ".org", ".html")), lambda: some("=-_.", 1) * r.randint(16, 60),
        lambda: some(digit, r.randint(16, 24)), lambda: "x" * r.randint(16, 40), lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))), lambda: word() + "-" + some(digit, 4) + "-" + word() + "-" + some(digit, 2),
        lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: "your-" + r.choice(("api-key", "secret", "token")) + "-goes-here", lambda: "example" + some(digit, 4) + "placeholder",
    ]
    assigned = lambda names: r.choice(names) + r.choice((" = ", ": ", "=", '="', ' = "', ': "'))
    made = []
    for _ in range(count):
        before, kind = word() + " " + word() + " ", r.random()
        if kind < 0.4:
            before, value, label = before + assigned(named), r.choice(secrets)(), 1
        elif kind < 0.45:
            value, label = r.choice(secrets[4:])(), 1
        elif kind < 0.62:
            before, value, label = before + assigned(("sha1", "commit", "checksum", "md5", "etag", "uuid", "revision", "id")), r.choice((hexa(40), hexa(32), hexa(64), plain[11]())), 0
        elif kind < 0.72:
            before, value, label = before + assigned(named), r.choice(plain)(), 0
        else:
            before, value, label = before + r.choice(("", "/", "www.", "(")), r.choice(plain)(), 0
        made.append((before[-40:], value, ('"' if before.endswith('"') else r.choice(" ,.")) + " " + word(), label))
    return made


@lru_cache(maxsize=4)
def _examples(seed: int) -> tuple[tuple[str, str, str, int], ...]:
    return tuple(findings(seed))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int):
    """A tree: a share of secrets, or (feature, threshold, tree up to it, tree above). Gini splits over ``tried`` features."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (2.0,)
    for f in rng.permutation(x.shape[1])[:tried]:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        left = np.cumsum(t)[:-1]
        right = t.sum() - left
        p, q = left / n, right / (len(t) - n)
        gini = (n * p * (1 - p) + (len(t) - n) * q * (1 - q)) / len(t)
        gini[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = 2.0
        k = int(gini.argmin())
        if gini[k] < best[0]:
            best = (gini[k], f, float(np.round((v[k] + v[k + 1]) / 2, 6)))
    if len(best) == 1:
        return float(y.mean())
    _, f, cut = best
    on = x[:, f] <= cut
    if on.all() or not on.any():
        return float(y.mean())
    return (int(f), cut, grow(x[on], y[on], rng, depth - 1, least, tried), grow(x[~on], y[~on], rng, depth - 1, least, tried))


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        made.append(grow(x[own], y[own], rng, depth, least, max(1, round(x.shape[1] ** 0.5))))
    return made


def as_sql(trees: list, names: list[str]) -> str:
    """The forest's mean as SQL over feature columns ``names``."""

    def one(tree) -> str:
        if isinstance(tree, float):
            return f"{tree:.6f}D"
        f, cut, low, high = tree
        return f"case when {names[f]} <= {cut:.6f}D then {one(low)} else {one(high)} end"

    return f"({' + '.join(map(one, trees))}) / {len(trees)}"


def _struct(more: str = "") -> str:
    """SQL of a struct of all features of x."""
    return f"struct({more}{', '.join(f'cast({sql} as double) as {name}' for name, sql in FEATURES.items())})"


@lru_cache(maxsize=8)
def _fitted(rows: tuple, seed: int) -> str:
    spark = SparkSession.active()
    table = spark.createDataFrame([(k, r[:3], r[3]) for k, r in enumerate(rows)], "k int, x struct<b: string, c: string, a: string>, secret int").coalesce(1)
    got = sorted(table.select("k", "secret", F.expr(_struct()).alias("f")).collect())
    return as_sql(forest(np.array([r.f for r in got], float), np.array([r.secret for r in got], float), seed=seed), [f"y.{n}" for n in FEATURES])


def fitted(labelled: DataFrame | None = None, sample: int = 5000, seed: int = 3) -> str:
    """The forest's SQL, fitted on ``labelled`` (before, candidate, after, secret), ``sample`` rows at most, or on findings made by rule."""
    if labelled is None:
        return _fitted(_examples(23), seed)
    rows = labelled.select("before", "candidate", "after", F.col("secret").cast("int")).dropna().orderBy(F.xxhash64("before", "candidate", "after"), "candidate").limit(sample)
    return _fitted(tuple(tuple(r) for r in rows.collect()), seed)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): found has all candidates of a text, with places in code points and what stands around; texts without are left out."""
    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    found = found.select("*", F.regexp_extract_all("text", F.lit(SPLIT), 1).alias("gaps"), F.regexp_extract_all("text", F.lit(SPLIT), 2).alias("runs"))
    # ends[i]: where the candidates before the i-th and the text in front of them end.
    sizes = "zip_with(gaps, runs, (g, c) -> length(g) + length(c))"
    found = found.select("*", F.expr(f"aggregate({sizes}, array(0), (t, x) -> concat(t, array(element_at(t, -1) + x)))").alias("ends"))
    each = """transform(runs, (c, i) -> struct(get(ends, i) + length(get(gaps, i)) as start, c as c,
        substring(text, greatest(1, get(ends, i) + length(get(gaps, i)) - 39), least(40, get(ends, i) + length(get(gaps, i)))) as b, substring(text, get(ends, i + 1) + 1, 8) as a))"""
    return found.select("doc_id", F.expr(each).alias("found"))


def scan(docs: DataFrame, expression: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Secrets: (doc_id, start, stop, secret, score), start and stop in code points.

    A null or empty text has none; null ids and repeated rows are scanned like
    others; other columns are not read. An empty table gives no rows.
    """
    # Features and forest stay within the row's array: a filter on a column would be pushed into them and write each feature out at each node.
    scored = candidates(docs).select("doc_id", F.expr(f"transform(found, x -> {_struct('x.start as start, x.c as c, ')})").alias("found"))
    scored = scored.select("doc_id", F.expr(f"transform(found, y -> struct(y.start as start, y.c as c, {expression or fitted()} as score))").alias("found"))
    scored = scored.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    return scored.where(F.col("score") >= threshold).select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("c")).cast("long").alias("stop"),
        F.col("c").alias("secret"),
        F.round("score", 6).alias("score"),
    )
