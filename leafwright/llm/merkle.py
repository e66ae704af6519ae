"""Merkle manifest of a dataset: digests, roots and inclusion proofs of documents.

Each document is a leaf. The leaves of a language stand in the order of their
ids; every ``fanout`` consecutive nodes have one parent, up to the language's
root, and the languages' roots have parents in the same way.

A node's place is the rank of its leaves, and ranks come without a global
sort: histograms of the ids' digits, highest digit first, go on within the
buckets that hold more than ``most`` rows, and the counts of the buckets before
a bucket are added up within its parent. Ids, then digests, then row numbers
give the digits, so that no bucket stays large, whatever repeats. A rank in
base ``fanout`` is its leaf's way through the trie: leaves that share all but
the last digits meet in one row, that row gives one node of the next table,
and so on. Proofs go down the same tables.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Store, looked_up

#: Bits of a digit of an id.
DIGIT = 8

TEXTS = pa.list_(pa.string())
WAYS = pa.schema([("g", pa.string()), ("c", pa.int64()), ("root", pa.string()), ("lefts", TEXTS), ("rights", TEXTS)])
PROOF = pa.schema([("doc_id", pa.int64()), *((x, pa.string()) for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def lifted(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes, and those of each of ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def steps(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """For the node ``at`` of the lowest level: the siblings before and after it, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def folded(node: str, ways: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in ways:
        node = digest(left, node, right)
    return node


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a document's columns, each with its length in bytes; null is told from empty."""

    def told(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(told, (doc_id, source, lang, n_chars, text))), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def number_digits(column: str, rows: DataFrame) -> Iterator[Column]:
    """Digits of a long column, null before all numbers, from the highest bit in which two values differ."""
    least, most = rows.agg(F.min(column), F.max(column)).first()
    width = ((least or 0) + (1 << 63) ^ (most or 0) + (1 << 63)).bit_length()
    bits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    for shift in range(max(0, width - DIGIT), -DIGIT, -DIGIT):
        digit = F.shiftrightunsigned(bits, max(0, shift)).bitwiseAND(F.lit((1 << min(DIGIT, DIGIT + shift)) - 1))
        yield F.coalesce(digit + 1, F.lit(0).cast("long"))


def text_digits(column: str, size: int) -> Iterator[Column]:
    """Digits of a string column of at most ``size`` bytes, two bytes each, in the order of its bytes."""
    code = F.hex(F.encode(F.col(column), "UTF-8"))
    for k in range(0, size, 2):
        pair = F.substring(code, 2 * k + 1, 4)
        yield F.conv(F.rpad(pair, 4, "0"), 16, 10).cast("long") * 3 + (F.length(pair) / 2).cast("long")


def ranked(rows: DataFrame, group: str, digits: Iterable[Column], order: list[Column], store: Store, most: int = 16384) -> DataFrame:
    """``rows`` with ``r``, the place in the group from 0, and ``n``, the group's rows.

    ``rows`` lies in a table, ``group`` is a string and never null; ``digits``
    give the same order as ``order``, which has no ties. A histogram has a row
    for each digit that occurs; its counts are added up within one parent bucket only.
    """
    names, done, left = rows.columns, [], rows.select("*", F.col(group).alias("bucket"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("n"))
    for k, digit in enumerate(digits):
        counts = left.withColumn("digit", digit.cast("string")).groupBy("bucket", "base", "n", "digit").agg(F.count("*").alias("held"))
        parent = Window.partitionBy("bucket")
        before = F.coalesce(F.sum("held").over(parent.orderBy(F.col("digit").cast("long")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.concat("bucket", F.lit("."), "digit").alias("bucket")
        total = F.sum("held").over(parent) if k == 0 else F.col("n")
        buckets = store(counts.select(own, (F.col("base") + before).alias("base"), total.alias("n"), "held", F.col("held").alias("rows")))
        placed = looked_up(left.withColumn("digit", digit.cast("string")).select(*names, own), buckets, "bucket", "rows")
        done.append(placed.where(F.col("held") <= most))
        left = None if buckets.where(F.col("held") > most).isEmpty() else store(placed.where(F.col("held") > most).drop("held"))
        if left is None:
            break
    if left is not None:
        done.append(left.withColumn("held", F.lit(0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return out.select(*names, (F.col("base") + place - 1).alias("r"), "n")


def climbed(leaves: DataFrame, kept: list[str], fanout: int, digits: int, store: Store) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the trie, lowest first, and the root of each group as (g, node).

    ``leaves`` has g, r, n, node and the columns ``kept``. A row of a table is
    the nodes under one prefix, ``fanout ** digits`` at most: (g, c, n, nodes).
    """
    span, tables, level, top = fanout**digits, [], 0, 1

    def up(level):
        def run(batches):
            for batch in batches:
                n, nodes = batch.column("n").to_pylist(), batch.column("node").to_pylist()
                tops = [lifted(x, max(0, min(digits, height(m, fanout) - level)), fanout)[-1][0] for m, x in zip(n, nodes)]
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("c"), batch.column("n"), pa.array(tops, pa.string())], ["g", "r", "n", "node"])

        return run

    while level < top:
        nodes = leaves.groupBy("g", F.expr(f"r div {span}").alias("c")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("r", "node", *kept))).alias("nodes"))
        tables.append(store(nodes))
        if level == 0:
            top = height(tables[0].agg(F.max("n")).first()[0] or 1, fanout)
        leaves, kept = tables[-1].select("g", "c", "n", F.col("nodes.node").alias("node")).mapInArrow(up(level), "g string, r long, n long, node string"), []
        level += digits
    return tables, store(leaves.select("g", "node"))


def descended(tables: list[DataFrame], ways: DataFrame, fanout: int, digits: int, store: Store) -> DataFrame:
    """Ways from the rows of the lowest table to the top: (g, c, root, lefts, rights), from those of the groups' roots."""

    def down(level):
        def run(batches):
            for batch in batches:
                out = []
                for g, n, first, nodes, root, lefts, rights in zip(*(batch.column(x).to_pylist() for x in ("g", "n", "first", "node", "root", "lefts", "rights"))):
                    levels = lifted(nodes, max(0, min(digits, height(n, fanout) - level)), fanout)
                    for k in range(len(nodes)):
                        own = steps(levels, k, fanout)
                        out.append((g, first + k, root, [x for x, _ in own] + lefts, [y for _, y in own] + rights))
                yield pa.RecordBatch.from_pylist([dict(zip(("g", "c", "root", "lefts", "rights"), x)) for x in out], WAYS)

        return run

    ways = ways.withColumn("c", F.lit(0).cast("long"))
    for k in range(len(tables) - 1, 0, -1):
        rows = tables[k].select("g", "c", "n", F.col("nodes")[0]["r"].alias("first"), F.col("nodes.node").alias("node"))
        ways = store(rows.join(ways, ["g", "c"]).mapInArrow(down(k * digits), "g string, c long, root string, lefts array<string>, rights array<string>"))
    return ways


def manifest(docs: DataFrame, found: Column | None = None, fanout: int = 8, digits: int = 3, most: int = 16384) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``found`` is the text whose membership is verified against the manifest of
    ``docs``; it is each row's own text if not given. Nulls are fields of their
    own; a null doc_id stands before all ids, a null lang before all languages.
    Rows that repeat an id stand in the order of their digests, and rows alike
    in all columns are leaves next to each other. A group of one leaf has that
    leaf as its root. An empty table gives no rows. Other columns are not read.
    """
    store = Store(docs.sparkSession, "merkle")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    given = docs.select(*columns, "text", (F.col("text") if found is None else found).alias("seen"), leaf(*columns, F.col("text")).alias("node"))
    rows = store(
        given.select(
            F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"),
            F.col("doc_id").cast("long").alias("doc_id"),
            "node",
            F.when(F.col("seen").eqNullSafe(F.col("text")), F.col("node")).otherwise(leaf(*columns, F.col("seen"))).alias("seen"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    digits_of = itertools.chain(number_digits("doc_id", rows), text_digits("node", 64), number_digits("row", rows))
    leaves = ranked(rows, "g", digits_of, [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("row")], store, most)
    tables, roots = climbed(leaves, ["doc_id", "seen"], fanout, digits, store)

    longest = roots.agg(F.max(F.octet_length("g"))).first()[0] or 1
    tops = store(roots.withColumnRenamed("g", "name").withColumn("g", F.lit("")))
    tops = ranked(tops, "g", text_digits("name", longest), [F.col("name")], store, most)
    above, root = climbed(tops, ["name"], fanout, digits, store)
    root = (root.first() or {"node": ""})["node"]
    nothing = F.array().cast("array<string>")
    ways = descended(above, docs.sparkSession.range(1).select(F.lit("").alias("g"), F.lit("").alias("root"), nothing.alias("lefts"), nothing.alias("rights")), fanout, digits, store)

    def named(batches):
        for batch in batches:
            out = []
            for n, nodes, lefts, rights in zip(*(batch.column(x).to_pylist() for x in ("n", "nodes", "lefts", "rights"))):
                levels = lifted([x["node"] for x in nodes], min(digits, height(n, fanout)), fanout)
                for k, x in enumerate(nodes):
                    own = steps(levels, k, fanout)
                    out.append({"g": x["name"], "root": x["node"], "lefts": [a for a, _ in own] + lefts, "rights": [b for _, b in own] + rights})
            yield pa.RecordBatch.from_pylist(out, pa.schema([f for f in WAYS if f.name != "c"]))

    ways = store(above[0].join(ways.drop("root"), ["g", "c"]).mapInArrow(named, "g string, root string, lefts array<string>, rights array<string>"))
    ways = descended(tables, ways, fanout, digits, store)
    store.only(tables[0], ways)

    def proved(batches):
        for batch in batches:
            for n, nodes, subroot, lefts, rights in zip(*(batch.column(x).to_pylist() for x in ("n", "nodes", "root", "lefts", "rights"))):
                levels = lifted([x["node"] for x in nodes], min(digits, height(n, fanout)), fanout)
                above, shared = list(zip(lefts, rights)), "".join(a + b for a, b in zip(lefts, rights))
                whole, out = folded(levels[-1][0], above), []
                for k, x in enumerate(nodes):
                    own = steps(levels, k, fanout)
                    top = folded(x["seen"], own)
                    end = whole if top == levels[-1][0] else folded(top, above)
                    out.append((x["doc_id"], x["node"], subroot, root, digest(*(a + b for a, b in own), shared), end, end == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PROOF.types)], schema=PROOF)

    return tables[0].join(ways, ["g", "c"]).select("n", "nodes", "root", "lefts", "rights").mapInArrow(proved, from_arrow_schema(PROOF))


def oracle(levels: int = 7, tops: int = 2) -> str:
    """The contract's query in SQL, for languages of at most ``8 ** levels`` documents."""
    digits = "list_transform(range(8), lambda i: i)"
    crc = f"""xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
        lambda h, c: list_reduce(list_prepend(xor(h, c), list_transform({digits}, lambda i: 0::ubigint)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)))"""
    told = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(told, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def trie(name: str, depth: int) -> str:
        """Levels name0 .. of (g, r, n, node), each with the siblings before and after; a group of one node stays."""
        out = ""
        for k in range(depth + 1):
            out += f"""{name}{k}s as (
                select *, coalesce(string_agg(node, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
                    coalesce(string_agg(node, '') over (w rows between 1 following and unbounded following), '') as t
                from {name}{k} window w as (partition by g, r // 8 order by r)
            ), """
            if k < depth:
                out += f"""{name}{k + 1} as (
                    select g, r // 8 as r, cast(ceil(any_value(n) / 8) as bigint) as n, case when any_value(n) > 1 then sha256(string_agg(node, '' order by r)) else any_value(node) end as node
                    from {name}{k} group by g, r // 8
                ), """
        return out

    ways = lambda name, depth: [(f"{name}{k}", f"{name}{k}s") for k in range(depth)]
    joins = " ".join(f"join a{k}s on a{k}s.g = d.g and a{k}s.r = d.r // {8**k}" for k in range(levels + 1))
    above = " ".join(f"join b{k}s on b{k}s.r = s.r // {8**k}" for k in range(tops + 1))
    steps = [t for t, _ in ways("a", levels)] + [t for t, _ in ways("b", tops)]
    proof = " || ".join(f"case when {t}s.n > 1 then {t}s.l || {t}s.t else '' end" for t in steps)
    folds, last = "", "f"
    for k, t in enumerate(steps):
        folds += f"y{k} as (select *, case when {t}n > 1 then sha256({t}l || x || {t}t) else x end as x2 from {last}), z{k} as (select * exclude (x, x2), x2 as x from y{k}), "
        last = f"z{k}"
    wide = ", ".join(f"{t}s.n as {t}n, {t}s.l as {t}l, {t}s.t as {t}t" for t in steps)
    return f"""
        with d as (
            select doc_id, coalesce('=' || lang, '') as g, {leaf("text")} as node, case when {crc} % 3 = 0 then {leaf(lowered)} else {leaf("text")} end as seen,
                row_number() over (partition by lang order by doc_id nulls first) - 1 as r, count(*) over (partition by lang) as n
            from documents
        ), a0 as (select g, r, n, node from d), {trie("a", levels)}
        s as (select g, row_number() over (order by g) - 1 as r, node from a{levels}),
        b0 as (select '' as g, r, (select count(*) from s) as n, node from s), {trie("b", tops)}
        f as (
            select d.doc_id, d.node as leaf, s.node as subroot, b{tops}s.node as root, sha256({proof}) as proof_sha256, d.seen as x, {wide}
            from d {joins} join s on s.g = d.g {above}
        ), {folds.rstrip(", ")}
        select doc_id, leaf, subroot, root, proof_sha256, x as folded_root, x = root as verified from {last}"""
