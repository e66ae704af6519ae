"""What the clusters choose on pages without telling tags; whole articles; time in proportion to a page's length."""

import re
import time

import numpy as np
import pytest

from leafwright.llm import html_text
from leafwright.llm.common import table

LONG = ["The first paragraph goes on for quite a while, so that nobody takes it for a menu.", "The second paragraph has as much to say, and says it at some length as well.", "And a third one closes the article with words enough to be told from its surroundings."]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
TEXT = "\n\n".join(LONG)
SITE = '<div class="page"><nav><a href="/">Home</a></nav>{}<footer>me</footer></div>'
ENTRIES = "".join(f"<p>entry {k}</p>" for k in range(40))

SHAPES = {
    "a short section after": (f"<div><section><p>{LONG[0]}</p><p>{LONG[1]}</p></section><section><p>Only six words stand in it.</p></section></div>", f"{LONG[0]}\n\n{LONG[1]}\n\nOnly six words stand in it."),
    "an end in its own div": (f"<div>{BODY}</div><div><p>The end.</p></div>", f"{TEXT}\n\nThe end."),
    "a lead before": (f'<div class=lead>A few words ahead.</div><div class="text">{BODY}</div>', f"A few words ahead.\n\n{TEXT}"),
    "three articles of a main": (f"<main><article>{BODY}</article><article><p>{LONG[0]}</p></article><article><p>Three short words.</p></article></main>", f"{TEXT}\n\n{LONG[0]}\n\nThree short words."),
    "a header with heading and byline": (SITE.format(f'<header><h1>Head</h1><p class="byline">By X</p></header><div>{BODY}</div>'), f"Head\n\nBy X\n\n{TEXT}"),
    "the same above an article": (SITE.format(f'<header><h1>Head</h1><p class="byline">By X</p></header><article>{BODY}</article>'), f"Head\n\nBy X\n\n{TEXT}"),
    "a site's header with links": (SITE.format(f'<header><h1>Site</h1><a href="/">start</a></header><div><h1>Head</h1>{BODY}</div>'), f"Head\n\n{TEXT}"),
    "nothing around": (f"<h1>Head</h1><p>Of.</p>{BODY}<p>Yes.</p>", f"Head\n\nOf.\n\n{TEXT}\n\nYes."),
    "reader comments in a list": (SITE.format(f'<div>{BODY}</div><ol class="commentlist"><li>{LONG[0]}</li></ol>'), TEXT),
    "recommended": (SITE.format(f'<div>{BODY}</div><div class="recommended"><p>{LONG[1]}</p></div>'), TEXT),
    "a list between": (f"<div><p>{LONG[0]}</p><ul>" + "<li>one</li>" * 15 + f"</ul><p>{LONG[1]}</p></div>", f"{LONG[0]}\n\n" + "one\n\n" * 15 + LONG[1]),
    "a list between sections": (f"<div><section><p>{LONG[0]}</p></section><ul>" + "<li>one</li>" * 15 + f"</ul><section><p>{LONG[1]}</p></section></div>", f"{LONG[0]}\n\n" + "one\n\n" * 15 + LONG[1]),
    "a list at the end": (f"<div>{BODY}<ul>" + "<li>one</li>" * 15 + "</ul></div>", TEXT + "\n\none" * 15),
    "short entries beside": (f"<div>{ENTRIES}</div><div>{BODY}</div><div>{ENTRIES}</div>", TEXT),
    "short entries around, no container": (ENTRIES + BODY + ENTRIES, TEXT),
    "links beside": (f"<ul><li><a>one</a></li><li><a>two</a></li></ul>{BODY}<ul><li><a>three</a></li><li><a>four</a></li></ul>", TEXT),
    "one giant": (f"<div>{BODY}<p>{'word ' * 4000}</p>{BODY}</div>", f"{TEXT}\n\n{('word ' * 4000).strip()}\n\n{TEXT}"),
    "an advert inside": (f'<div><p>{LONG[0]}</p><div class="ad">{LONG[2]}</div><p>{LONG[1]}</p></div>', f"{LONG[0]}\n\n{LONG[1]}"),
    "links alone": ("<p><a>one</a></p><p><a>two</a></p>", "one\n\ntwo"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, want = SHAPES[name]
    assert html_text.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == want


def pages(spark, tag):
    return [(re.sub(r"<(/?)article>", f"<\\1{tag}>" if tag else "", r.html), r.html) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]


@pytest.mark.parametrize("tag", ["div", "section", ""])
def test_pages_without_article_are_whole(spark, tag):
    for page, whole in pages(spark, tag):
        assert html_text.main_text(page) == html_text.main_text(whole)


@pytest.mark.parametrize("noise", [lambda r, s, g: g.random(len(r)), lambda r, s, g: g.normal(0, 1, len(r)) * r.std(), lambda r, s, g: np.ones(len(r))])
def test_smoothing_decides(spark, monkeypatch, noise):
    rng, given = np.random.default_rng(3), pages(spark, "div")
    want = [html_text.main_text(p) for p, _ in given]
    monkeypatch.setattr(html_text, "smooth", lambda r, s: noise(r, s, rng))
    assert sum(html_text.main_text(p) != w for (p, _), w in zip(given, want)) > len(given) / 2


def test_clusters_grow_over_half_height():
    ratios = np.array([0, 2, 2, 2, 40, 40, 40, 4, 0, 0, 2.0])
    strong, grown = html_text.clusters(ratios, 1.0, 1.0)
    assert strong == {4, 5, 6} and grown == {3, 4, 5, 6, 7}
    assert html_text.clusters(np.zeros(3), 1.0, 1.0) == (set(), set()) and html_text.clusters(np.array([5.0]), 1.0, 1.0) == ({0}, {0})


PARTS = ["<a ", "</div><a ", "<!--", "<!", "<?", "</", "<![CDATA[", "<a x=\"", "<a b='", "<a/", "&#", "<div><p>x", "</div>", "<form><nav>", "<h1><header>", '<p class="commentlist">', "<ul><li><a>x"]


@pytest.mark.parametrize("part", PARTS)
def test_time_is_linear(part):
    def took(n, end):
        start = time.process_time()
        html_text.main_text(part * n + end)
        return time.process_time() - start

    for end in ("", "<a " * 20_000, '">text</a>'):
        assert took(20_000, end) < 12


def test_what_never_ends_is_no_text():
    assert html_text.main_text("<p>text</p><a href='x") == "text" and html_text.main_text("<p>1 < 2") == "1 < 2"
    assert html_text.main_text("<p>text <!-- a --> more<!-- <b>never ends</b>") == "text more"
    assert html_text.main_text(f"<p class='{'commentlist' * 5000}x'>{LONG[0]}") == LONG[0]
