import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from iolens.llm import html_extract as H
from iolens.llm.html_extract import extract, lines, main_text

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var t='</p><article>no';</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- <article>ad</article> --><div class=\"ad\">Buy.</div>"
    "<aside>side</aside><article><header><h1>Title &eacute;</h1></header><p>One <b>two\n three.<br><p>four&nbsp;five &am x &amp y"
    "<div class='cookie-notice'>Cookies!</div><form><label>name</label><input></form><ul><li>a<li>b</ul></article>"
    "<section id=comments><p>First! A comment that is long enough to look like a paragraph of text, and then some more words.</p></section><footer>&copy; me</footer></body></html>"
)


def test_article():
    assert main_text(PAGE) == "Title é One two three. four five &am x & y a b"


def test_without_marks():
    long = "A sentence of a paragraph that goes on for a while, as they do in articles. "
    page = f"<div><a href=1>Home</a> | <a href=2>News</a></div><div id=x><h2>Head</h2><p>{long * 2}</p><p>Short.</p><p>{long}</p></div><div>ok</div><div class='comment-list'>{long}</div><div>end</div>"
    text = main_text(page)
    assert text.startswith("Head A sentence") and "Short. A sentence" in text and "Home" not in text
    assert text.count("A sentence") == 3


def test_names_of_classes():
    page = "<body class='has-sidebar ad-free'><article class='post with-comments'><h1 class='entry-header'>H</h1><p>One.</p><div class='related-posts'>More</div><section id='comment-3'>No</section><p class=lead>Two.</p></article></body>"
    assert main_text(page) == "H One. Two."
    assert main_text(f"<div class='site-header'>{'Head words. ' * 30}</div><p>{'Body words. ' * 30}</p>") == ("Body words. " * 30).strip()


def plain_text(page):
    """The rule of the module once more, over its lines: all windows of each sequence, without a running state."""
    found = [x for x in lines(page) if x.factor]
    got = []
    for key in dict.fromkeys((x.article, x.factor) for x in found):
        at = [i for i, x in enumerate(found) if (x.article, x.factor) == key]
        w = [found[i].weight() for i in at]
        window = {k: sum(w[max(k, 0) : k + H.WINDOW]) for k in range(1 - H.WINDOW, len(w))}  # by its first line
        part = []
        for k in range(len(w)):
            # a line is in a run if a window over it, and one over each line from there to a heavy line on both sides, has weight
            before = next((j for j in range(k, -1, -1) if w[j]), None)
            after = next((j for j in range(k, len(w)) if w[j]), None)
            if before is not None and after is not None and after - before <= H.WINDOW:
                part.append(k)
        runs, last = [], None
        for k in part:
            if last is None or k != last + 1 or not any(window[j] for j in range(last, k + 1)):
                runs.append([])
            runs[-1].append(k)
            last = k
        got += [([at[k] for k in r], max(s for j, s in window.items() if j + H.WINDOW > r[0] and j <= r[-1])) for r in runs]
    top = max((s for _, s in got), default=0)
    first = [found[r[0]] for r, _ in got]
    floor = [0 if f.article else min(H.SURGE, top) if f.factor == 1 else H.SURGE * f.factor * (H.MISNAMED if f.factor <= H.NAMED else 1) for f in first]
    key = lambda i: (found[i].article, found[i].factor, found[i].parent)
    strong = [r for (r, s), f in zip(got, floor, strict=True) if s >= max(f, H.SHARE * top)]
    beside = {key(i) for r in strong for i in r}
    keep = {i for r in strong for i in r} | {i for r, _ in got if all(key(j) in beside for j in r) for i in r}
    return " ".join(found[i].text for i in sorted(keep))


LONG = "A sentence of a paragraph that goes on for a while, as they do in articles. "
MARKED_PAGES = {
    "comment articles": f"<article><h1>T</h1><p>{LONG * 3}</p><p>Of.</p></article><article class='comment'>{LONG * 5}</article><article id=comment-7>{LONG}</article>",
    "promotion inside": f"<main><article><h1>T</h1><p>{LONG * 3}</p><article class='related promo'>{LONG * 2}</article><p>Of.</p></article></main>",
    "teasers": f"<article><h1>T</h1><p>{LONG * 3}</p><p>Of.</p></article><article><a href=1>Next</a> A short teaser.</article><article>Another teaser.</article>",
    "list of links": f"<article><h1>T</h1><p>{LONG * 3}</p><ul><li><a>One of the other stories</a><li><a>Two</a><li><a>Three</a><li><a>Four</a></ul><p>Of.</p></article>",
    "notice": f"<div role=alert>{LONG}</div><article><h1>T</h1><p>{LONG * 3}</p><div class='cookie-notice'>{LONG}</div><p>Of.</p></article>",
    "aside": f"<article><h1>T</h1><p>{LONG * 3}</p><aside>{LONG}</aside><form>{LONG}</form><p>Of.</p></article>",
}


@pytest.mark.parametrize("name", MARKED_PAGES)
def test_windows_decide_in_marked_articles(name):
    assert main_text(MARKED_PAGES[name]) == f"T {LONG * 3}Of."


def test_a_link_between_paragraphs_stays():
    assert main_text(f"<article><p>{LONG}</p><p><a>All of this is a link</a></p><p>{LONG}</p></article>") == f"{LONG}All of this is a link {LONG}".strip()


def test_unlucky_names():
    assert main_text(f"<nav>x</nav><div class='ad-hoc share-price'><h2>T</h2><p>{LONG * 2}</p></div><div class=ad>Buy this now.</div>") == f"T {LONG * 2}".strip()
    assert main_text(f"<article><h2 id='share-prices'>T</h2><section id='cookie-recipes'>{LONG}</section></article>") == f"T {LONG}".strip()
    assert main_text("<div class=ad>Buy this now, it is the best thing that was ever on sale.</div><article></article>") == ""


def test_short_ends_after_boilerplate():
    boxes = "<div class=ad>Buy.</div>" * 5
    assert main_text(f"<div><p>{LONG * 9}</p>{boxes}<p>The end.</p></div>") == f"{LONG * 9}The end."


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</span>" * 40_000, "<p><button>" + "<b>" * 40_000 + "<div></div>" * 40_000, "<b>" * 40_000 + "<p>x" * 40_000, "<li>" * 40_000 + "<tr>" * 40_000])
def test_damaged_pages_take_a_moment(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("page", [None, "", " \n", "<p>", "<!-- x", "<script>a", "<style>x</style>", "<nav>menu</nav>", "<a href='"])
def test_nothing(page):
    assert main_text(page) == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<li>", "</div>", "<div class=ad>", "<b", ">", "&lt;", "text", " ", "<!--", "-->", "<script>", "</script>", '"', "=", "<td>", "</table>", "é", "<main>", "</main>", "<a>", "</a>", "<p>linked <a>here</a>", "<p>" + "words " * 20, "<div class='ad-hoc'>", "<article class=comment>"]), max_size=40).map("".join))
def test_any_markup(page):
    text = main_text(page)
    assert text == " ".join(text.split()) == plain_text(page)
    assert all(t == " ".join(t.split()) and t for t, *_ in lines(page))


def test_long_and_deep():
    assert main_text("<article>" + "<div>x " * 3000 + "</article>") == " ".join(["x"] * 3000)
    assert len(main_text("<main><p>" + "word " * 200_000)) == 999_999


def test_rows_and_whole_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, text int")
    rows = extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, main_text(PAGE), 46)] * 2 + [(2, "", 0), (None, "", 0)]
    assert extract(df.limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, p in zip(extract(pages).collect(), pages.collect(), strict=True):
        inner = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
