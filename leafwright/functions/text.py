"""Column functions on text; lengths are code points, white space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the math header of HTML results.
MATHJAX = (
    "<script>\n"
    'MathJax = { tex: { inlineMath: [["$", "$"], ["\\\\(", "\\\\)"]], displayMath: [["$$", "$$"], ["\\\\[", "\\\\]"]] } };\n'
    "</script>\n"
    '<script src="https://cdn.jsdelivr.net/npm/mathjax@3/es5/tex-chtml.js"></script>\n'
)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with value computed once: a lambda's variable is, a column used in a lambda or many times need not be."""
    return F.get(F.transform(F.array(value), lambda x: of(x)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def squeezed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(squeezed(text)), F.lit(0)) == 0


def count_of(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def garbled(text: Column) -> Column:
    """Private-use and replacement characters."""
    return F.regexp_count(text, F.lit("[\uE000-\uF8FF\uFFFD]")).cast("long")


def cleaned(text: Column) -> Column:
    """Replacement characters as spaces."""
    return F.translate(text, "\uFFFD", " ")


def masked(text: Column) -> Column:
    """Values after ``api_key:`` as stars, an opening quote left in place."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"""(api_key\s*:\s*["']?)([^"'\s]+)""", "$1***")


def plain_no_proxy(value: Column) -> Column:
    """A comma list trimmed, without blank and bracketed items."""
    items = F.transform(F.split(value, ","), strip)
    return F.array_join(F.filter(items, lambda x: (x != "") & ~(x.startswith("[") & x.endswith("]"))), ",")


def unfenced(text: Column) -> Column:
    """Stripped text without the code fence around it."""
    opened = lambda t: F.when(t.startswith("```html"), F.substr(t, F.lit(8))).when(t.startswith("```"), F.substr(t, F.lit(4))).otherwise(t)
    closed = lambda t: strip(F.when(t.endswith("```"), F.left(t, F.length(t) - 3)).otherwise(t))
    return let(let(strip(text), lambda t: strip(opened(t))), closed)


def with_mathjax(text: Column) -> Column:
    """HTML with the math header after its first head tag, else body tag, else in front."""
    header = F.lit(MATHJAX)

    def after(t: Column, tag: str) -> Column:
        end = F.instr(t, tag) + len(tag) - 1
        return F.concat(F.left(t, end), F.lit("\n"), header, F.substr(t, end + 1))

    def made(t: Column) -> Column:
        inside = F.when(F.instr(t, "<head>") > 0, after(t, "<head>")).when(F.instr(t, "<body>") > 0, after(t, "<body>"))
        return F.when(t.startswith("<html"), F.coalesce(inside, F.concat(header, t))).otherwise(F.concat(header, t))

    return let(unfenced(text), made)
