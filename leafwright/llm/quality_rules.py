"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gives two histograms: of its characters by class, and of the
common words of its language among its words. Both are held against those of
all documents of the language by Jensen-Shannon distance. A document too short
for its histograms to mean anything is left to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Character classes, each a pattern; what no pattern counts is the last class (small letters and the rest).
CLASSES = (r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", "[.,;:?'\"()-]", "!", "[#*$%&|<>]", r"[^\x00-\x7F]")
#: Common words of the languages that have references.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "en": "the of and to in a is that for it was on are as with his they at be this have from or by".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus ne se pas il avec".split(),
}
CONTRACT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
RUN = 8  # words of a window for repeats


def _measured(docs: DataFrame) -> DataFrame:
    """Counts of each document; every array has a column of its own, so that none is computed twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lists = F.create_map(*[x for lang, words in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    hashes = f"""case when n >= {RUN} then transform(sequence(0, n - {RUN}), i -> xxhash64({", ".join(f"get(words, i + {k})" for k in range(RUN))})) else array() end"""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    df = df.select("*", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), F.expr(r"filter(split(text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"))
    df = df.select(
        "doc_id", "lang", "words",
        F.length("text").cast("long").alias("n_chars"),
        *(F.regexp_count("text", F.lit(c)).cast("long").alias(f"c{k}") for k, c in enumerate(CLASSES)),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").alias("n"),
        F.transform("words", F.lower).alias("low"),
        F.try_element_at(lists, F.col("lang")).alias("common"),
    )
    df = df.select("*", F.expr(hashes).alias("h"), F.expr("filter(low, x -> array_contains(common, x))").alias("hits"))
    df = df.select("*", F.expr("case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> struct(x, i))) else array() end").alias("s"))
    df = df.select("*", F.expr("sort_array(transform(filter(s, (x, i) -> coalesce(x.x = get(s, i - 1).x, false) or coalesce(x.x = get(s, i + 1).x, false)), x -> x.i))").alias("p"))
    others = "n_chars" + "".join(f" - c{k}" for k in range(len(CLASSES)))
    return df.select(
        "doc_id", "lang", "n_chars",
        F.col("n").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("c0")).alias("word_chars"),
        F.col("c5").alias("n_symbols"),
        "n_dup_lines",
        F.expr(f"aggregate(p, 0L, (t, x) -> t + {RUN}) - aggregate(transform(p, (x, i) -> greatest(0, {RUN} - coalesce(get(p, i + 1) - x, {RUN}))), 0L, (t, x) -> t + x)").alias("n_repeat_words"),
        F.array(*(F.col(f"c{k}") for k in range(len(CLASSES))), F.expr(others)).alias("chars"),
        F.expr("concat(transform(common, w -> cast(size(hits) - size(array_remove(hits, w)) as long)), array(cast(n - size(hits) as long)))").alias("tally"),
    )


def _distance(counts: str, reference: str) -> str:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts."""
    total, whole = f"aggregate({counts}, 0D, (t, x) -> t + x)", f"aggregate({reference}, 0D, (t, x) -> t + x)"
    half = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0D end"
    terms = f"zip_with(transform({counts}, x -> x / {total}), transform({reference}, x -> x / {whole}), (a, b) -> {half('a', 'b')} + {half('b', 'a')})"
    return f"sqrt(greatest(0D, aggregate({terms}, 0D, (t, x) -> t + x) / 2))"


#: Limits of the distances, see ``judged``.
LIMITS = {"most_chars": 0.16, "most_words": 0.12, "slack_chars": 1.2, "slack_words": 1.8, "least_chars": 100, "least_words": 40}


def judged(
    docs: DataFrame,
    most_chars: float = LIMITS["most_chars"],
    most_words: float = LIMITS["most_words"],
    slack_chars: float = LIMITS["slack_chars"],
    slack_words: float = LIMITS["slack_words"],
    least_chars: int = LIMITS["least_chars"],
    least_words: int = LIMITS["least_words"],
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) and the two distances.

    A distance is null where the guard or the language leaves no comparison:
    texts of fewer than ``least_chars`` characters or ``least_words`` words, and
    languages without a word list; null distances pass. The limits fall with
    length as the distance that chance alone gives does: ``most`` and ``slack``
    over the root of the count of words. References are sums over
    all documents over the guards, at most one row for each listed language. A
    null text has no words and fails the base rules; repeated rows and null ids
    each give a row; other columns are not read. An empty table gives no rows.
    """
    each = saved(_measured(docs))
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[k]) for k in range(n)))
    sized = (F.col("n_chars") >= least_chars) & (F.col("n_words") >= least_words)
    languages = each.where(sized & F.col("lang").isin(*COMMON)).groupBy("lang").agg(
        sums("chars", len(CLASSES) + 1).alias("all_chars"), sums("tally", len(next(iter(COMMON.values()))) + 1).alias("all_words")
    )
    base: Column = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = each.join(F.broadcast(languages), "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        F.when(sized, F.expr(_distance("chars", "all_chars"))).alias("chars_distance"),
        F.when(sized, F.expr(_distance("tally", "all_words"))).alias("words_distance"),
    )
    root = F.sqrt(F.greatest(F.lit(1), "n_words"))
    near = (F.coalesce("chars_distance", F.lit(0.0)) <= most_chars + slack_chars / root) & (F.coalesce("words_distance", F.lit(0.0)) <= most_words + slack_words / root)
    return far.select(*far.columns[:7], (~F.col("base_failed") & near).alias("kept"), "chars_distance", "words_distance")


def oracle() -> str:
    """DuckDB SQL for the columns of ``CONTRACT``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    n = len(CLASSES)
    counts = ", ".join(f"len(regexp_extract_all(text, {quoted(c)}))" for c in CLASSES)
    lists = " ".join(f"when {quoted(lang)} then [{', '.join(map(quoted, words))}]" for lang, words in COMMON.items())
    distance = """sqrt(greatest(0, list_sum(list_transform(range(1, len({c}) + 1), lambda i: (
        case when {c}[i] > 0 then ({c}[i] / list_sum({c})) * log2(2 * ({c}[i] / list_sum({c})) / ({c}[i] / list_sum({c}) + {r}[i] / list_sum({r}))) else 0 end
        + case when {r}[i] > 0 then ({r}[i] / list_sum({r})) * log2(2 * ({r}[i] / list_sum({r})) / ({c}[i] / list_sum({c}) + {r}[i] / list_sum({r}))) else 0 end))) / 2))"""
    sums = lambda name, k: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(k)) + "]"
    v = LIMITS
    return f"""
    with a as (
        select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {quoted(WORD)}) as w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {quoted(WORD)})) as lines,
            case lang {lists} end as common
        from documents
    ), b as (
        select *, len(w) as n, length(text) as n_chars, [{counts}] as part,
            case when len(w) >= {RUN} then list_transform(range(1, len(w) - {RUN} + 2), lambda i: array_to_string(w[i:i + {RUN - 1}], ' ')) else [] end as g
        from a
    ), occurs as (select doc_id, unnest(g) as x, generate_subscripts(g, 1) as i from b),
    twice as (select doc_id, i from occurs qualify count(*) over (partition by doc_id, x) > 1),
    gaps as (select doc_id, least({RUN}, coalesce(lead(i) over (partition by doc_id order by i) - i, {RUN})) as d from twice),
    repeats as (select doc_id, sum(d) as d from gaps group by 1),
    m as (
        select b.doc_id, lang, n_chars, n::bigint as n_words, (n_chars - part[1])::bigint as word_chars, part[6]::bigint as n_symbols,
            (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(d, 0)::bigint as n_repeat_words,
            list_append(part, n_chars - list_sum(part)) as chars,
            list_append(list_transform(common, lambda c: len(list_filter(w, lambda x: lower(x) = c))), len(list_filter(w, lambda x: not list_contains(common, lower(x))))) as tally,
            n_chars >= {v["least_chars"]} and n >= {v["least_words"]} as sized, common
        from b left join repeats using (doc_id)
    ), r as (
        select lang, {sums("chars", n + 1)} as all_chars, {sums("tally", len(COMMON["en"]) + 1)} as all_words from m where sized and common is not null group by 1
    ), k as (
        select m.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
            case when sized then {distance.format(c="chars", r="all_chars")} end as dc, case when sized then {distance.format(c="tally", r="all_words")} end as dw
        from m left join r using (lang)
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and coalesce(dc, 0) <= {v["most_chars"]} + {v["slack_chars"]} / sqrt(greatest(1, n_words))
            and coalesce(dw, 0) <= {v["most_words"]} + {v["slack_words"]} / sqrt(greatest(1, n_words)) as kept
    from k"""
