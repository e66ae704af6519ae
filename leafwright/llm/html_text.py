"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser gives events; block tags cut them into lines, and
containers are numbered, each with its parent, so a line costs one number
however deep it lies. A line's ratio is its text, without that of links, to its tags, nothing for
text in menus, adverts and the like, and no more than ``FULL``. The ratios are
smoothed with a Gaussian; runs of lines over a threshold, a multiple of the ratios'
deviation, are the content clusters, which grow over the next lines of half that
height. The clusters choose: a container most of whose text is in them is
content as it stands, short paragraphs and headings included; of any other only
the lines of clusters are, and what lies between them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuples

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of the page.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist button textarea".split())
#: Furniture by tag; a header within an article holds its heading and stays.
FURNITURE = frozenset("nav aside footer form menu dialog search".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Containers that a stray end tag of inline text cannot close.
CONTAINER = BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd"}
#: Furniture by class, id or role: names that say so alone, and words that may stand with them.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies"
    " disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended recommendations related"
    " replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset(
    "area bar block bottom box buttons container content form global inner item left links list main page panel post posts reader right section site slot"
    " text thread top unit user wrap wrapper".split()
)
HEADER = frozenset(("header", "masthead", "banner"))
TITLED = frozenset(("content", "post", "posts", "text"))  # a header of these holds a title
WORDS = re.compile(r"[a-z]+")
#: Words that are written as one: commentlist, navlinks.
JOINED = re.compile("(?:" + "|".join(sorted(NAMES | BESIDE, key=len, reverse=True)) + ")+")
PART = re.compile("|".join(sorted(NAMES | BESIDE, key=len, reverse=True)))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def furnished(names: str) -> set[str]:
    """Furniture names among class, id and role: of tokens all of whose words are such names or stand beside them."""
    found: set[str] = set()
    for token in names.lower().split():
        words = {part for word in WORDS.findall(token) for part in (PART.findall(word) if word not in NAMES | BESIDE and JOINED.fullmatch(word) else [word])}
        if words and words <= NAMES | BESIDE and (HEADER.isdisjoint(words) or TITLED.isdisjoint(words)):
            found |= words & NAMES
    return found


class Lines(HTMLParser):
    """Lines of a page: (text parts, characters of link text, tags, container, furniture container or 0, tag of the block)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, container, unseen, furniture container
        self.open: dict[str, list[int]] = {}  # tag -> where it is in the stack
        self.walls: list[int] = []  # where containers are in the stack
        self.parent, self.tag = [0], [""]  # of containers, by number
        self.titled: set[int] = set()  # header containers with a first heading
        self.lines: list[tuple[list[str], int, int, int, int, str]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.whole = 0  # whole: open article and main tags

    def cut(self):
        if self.parts or self.tags:
            tag, at, _, furniture = self.stack[-1] if self.stack else ("", 0, False, 0)
            self.lines.append((self.parts, self.linked, self.tags, at, furniture, tag))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
            self._close("head")  # a block tag ends a head that was left open
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "p":
            self._close("p")
        elif tag in ("li", "dt", "dd", "tr", "option"):
            self._close(tag)
        _, at, unseen, furniture = self.stack[-1] if self.stack else ("", 0, False, 0)
        names = furnished(" ".join(v for k, v in attrs if v and k in ("class", "id", "role")))
        own = tag in FURNITURE or tag not in ("html", "body", "article", "main") and bool(names - HEADER if self.whole else names)
        own |= tag == "header" and not self.whole
        if tag in CONTAINER or own:
            self.parent.append(at)
            self.tag.append(tag)
            at = len(self.parent) - 1
            furniture = furniture or (at if own else 0)
        self.whole += tag in ("article", "main")
        if tag == "h1" and furniture and self.tag[furniture] == "header":
            self.titled.add(furniture)
        if tag in CONTAINER:
            self.walls.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, at, unseen or tag in UNSEEN, furniture))
        if tag in ("td", "th"):
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag):
        """Close the innermost ``tag`` and what is open in it; an end of inline text does not reach through a container."""
        places = self.open.get(tag)
        if not places or tag not in CONTAINER and self.walls and self.walls[-1] > places[-1]:
            return
        place = places[-1]
        while len(self.stack) > place:
            gone = self.stack.pop()[0]
            self.open[gone].pop()
            self.whole -= gone in ("article", "main")
        while self.walls and self.walls[-1] >= place:
            self.walls.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len("".join(data.split()))


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, "edge"), kernel / kernel.sum(), "valid")


def clusters(ratios: np.ndarray, sigma: float, factor: float) -> tuple[set[int], set[int]]:
    """Lines that are content by themselves, and all lines of the clusters.

    A cluster is lines whose smoothed ratio reaches ``factor`` deviations of the
    ratios, and neighbours within the Gaussian's reach while they have half of
    that; those whose own ratio reaches it too are content by themselves. A line
    without a ratio is in no cluster. If no line reaches the threshold the one
    of the greatest ratio is all there is.
    """
    even, least, reach = smooth(ratios, sigma), factor * ratios.std(), int(np.ceil(3 * sigma))
    core = {int(k) for k in np.flatnonzero((even >= least) & (ratios > 0))}
    if not core and ratios.any():
        core = {int(ratios.argmax())}
    grown = set(core)
    for k in core:
        for step in (1, -1):
            at = k + step
            while abs(at - k) <= reach and 0 <= at < len(ratios) and ratios[at] > 0 and even[at] >= least / 2:
                grown.add(at)
                at += step
    return {k for k in core if ratios[k] >= least}, grown


class Regions:
    """What the clusters choose; ``where`` is each line's container, ``sizes`` its text without links, ``links`` whether it has link text alone."""

    def __init__(self, parent: list[int], tag: list[str], where: list[int], sizes: list[int], links: list[bool], strong: set[int], grown: set[int]):
        self.parent, self.tag, self.strong, self.grown = parent, tag, strong, grown
        self.lines: list[list[int]] = [[] for _ in parent]  # that lie in a container directly
        self.children: list[list[int]] = [[] for _ in parent]
        self.first, self.last = [None] * len(parent), [-1] * len(parent)
        self.free, self.held, self.sure, self.linked, self.solid = ([0] * len(parent) for _ in range(5))
        for k, w in enumerate(where):
            if sizes[k] or links[k]:
                self.lines[w].append(k)
                self.free[w] += sizes[k]
                self.held[w] += sizes[k] if k in grown else 0
                self.sure[w] += k in strong
                self.linked[w] += links[k]
                self.solid[w] += not links[k]
                self.first[w] = k if self.first[w] is None else self.first[w]
                self.last[w] = k
        for k in range(len(parent) - 1, 0, -1):  # numbers grow inwards
            p = parent[k]
            if self.last[k] >= 0:
                self.children[p].append(k)
                for mass in (self.free, self.held, self.sure, self.linked, self.solid):
                    mass[p] += mass[k]
                self.first[p] = self.first[k] if self.first[p] is None else min(self.first[p], self.first[k])
                self.last[p] = max(self.last[p], self.last[k])

    def whole(self, top: int, menus: bool) -> list[int]:
        """All lines of a container; with ``menus``, but for containers of several lines that are links alone."""
        out, todo = [], [top]
        while todo:
            c = todo.pop()
            out += self.lines[c]
            todo += [x for x in self.children[c] if not (menus and self.linked[x] > 1 and not self.solid[x])]
        return out

    def _outermost(self, tag: str) -> list[int]:
        """The outermost containers of a tag that hold a line of a cluster."""
        inside, out = [False] * len(self.parent), []
        for k in range(1, len(self.parent)):
            inside[k] = inside[self.parent[k]] or self.tag[k] == tag
            if inside[k] and not inside[self.parent[k]] and self.held[k]:
                out.append(k)
        return out

    def chosen(self) -> list[int]:
        # A page that says what its main part or its articles are is taken at its word, if the clusters lie there.
        for tag in ("main", "article"):
            some = self._outermost(tag)
            if some and 2 * sum(self.held[c] for c in some) >= self.held[0]:
                return sorted(k for c in some for k in self.whole(c, False))
        out, todo = set(), [(0, True)]
        while todo:
            c, page = todo.pop()
            page = page and self.tag[c] in ("", "html", "body")
            most = 2 * self.held[c] >= self.free[c]
            if most and any(k in self.grown for k in self.lines[c]):
                out.update(self.whole(c, page))
                continue
            some = [x for x in self.children[c] if self.sure[x] or self.held[x] and 2 * self.held[x] >= self.free[x]]
            own = [k for k in self.lines[c] if k in (self.grown if most else self.strong)]
            ends = [self.first[x] for x in some] + [self.last[x] for x in some] + own
            if ends:  # what stands between is of the same region
                low, high = min(ends), max(ends)
                out.update(k for k in self.lines[c] if low <= k <= high)
                for x in self.children[c]:
                    if x not in some and low < self.first[x] < high and self.solid[x]:
                        out.update(self.whole(x, page))
            todo += [(x, page) for x in some]
        return sorted(out)


def closed(html: str) -> str:
    """The page without a comment or a tag that never ends; the parser would look for its end again and again."""
    at = html.find("<!--", html.rfind("-->") + 1)
    html = html[:at] if at >= 0 else html
    last = html.rfind(">") + 1
    open_tag = OPEN.search(html, last)
    return html[: open_tag.start()] if open_tag else html


OPEN = re.compile(r"<[a-zA-Z/!?]")
FULL = 100.0  # characters to a tag from which a line is text, however long


def main_text(html: str | None, sigma: float = 1.0, factor: float = 1.0, most: float = 0.5) -> str:
    """The article's blocks, in order, with two newlines between; empty if there is none.

    ``sigma`` and ``factor``: width of the Gaussian in lines, and threshold in
    deviations of the ratios. What is named as furniture is none if all text of
    the page but other furniture's lies in it, a form is none from a share
    ``most`` of the page's text on, and a header is none that holds the first heading and no links.
    """
    parser = Lines()
    parser.feed(closed(html or ""))
    parser.close()
    parser.cut()
    parent, tag = parser.parent, parser.tag
    texts = [" ".join("".join(x[0]).split()) for x in parser.lines]
    where, furniture = [x[3] for x in parser.lines], [x[4] for x in parser.lines]
    # A form around most of the page, or a named container that nearly all else lies in, is a wrapper.
    total, mass, links = sum(map(len, texts)), [0] * len(parent), [0] * len(parent)
    for text, f, x in zip(texts, furniture, parser.lines):
        mass[f] += len(text)
        links[f] += x[1]
    free = mass[0]
    wrapper = {f for f in set(furniture) if f and (mass[f] > most * total if tag[f] == "form" else mass[f] > 0.9 * (mass[f] + free))}
    wrapper |= {f for f in parser.titled if not links[f]}
    if wrapper:  # what is furniture within it still is
        inner = [0] * len(parent)
        for k in range(1, len(parent)):
            inner[k] = inner[parent[k]] or (k if k not in wrapper and tag[k] in FURNITURE - {"form"} else 0)
        furniture = [inner[w] if f in wrapper else f for w, f in zip(where, furniture)]
    plain = [0 if f else max(0, len(t) - t.count(" ") - x[1]) for t, f, x in zip(texts, furniture, parser.lines)]
    ratios = np.array([min(FULL, n / max(1, x[2])) for n, x in zip(plain, parser.lines)])
    linked = [bool(t) and not f and not n for t, f, n in zip(texts, furniture, plain)]
    if not any(plain):  # links alone
        return "\n\n".join(t for t, f in zip(texts, furniture) if t and not f)
    # Lines of tags alone stand between no others.
    some = np.flatnonzero([bool(t) for t in texts])
    strong, grown = ({int(some[k]) for k in x} for x in clusters(ratios[some], sigma, factor))
    held = Regions(parent, tag, where, plain, linked, strong, grown).chosen()
    # The heading above, with what stands between it and the text.
    first = [k for k in range(held[0] if held else 0) if plain[k] and parser.lines[k][5] == "h1"]
    if first and not any(parser.lines[k][5] == "h1" for k in held):
        held = [k for k in range(first[-1], held[0]) if plain[k]] + held
    return "\n\n".join(texts[k] for k in held)


def extract(pages: DataFrame, sigma: float = 1.0, factor: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) for each row.

    Null, empty and textless html give an empty text; repeated rows and null
    ids each give a row. Pages of any length are parsed whole, one at a time;
    other columns are not read. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            ids, urls, pages = tuples(batch, "page_id", "url", "html")
            texts = [main_text(h, sigma, factor) for h in pages]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
