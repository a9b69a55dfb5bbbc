"""HTML extraction: pages of many shapes whose article is known, malformed and extreme input, edge rows, the query on the whole table."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from pumpwise.llm.html_text import content_paths, extract_text, main_text, op11_html_text

P = [
    "The first paragraph speaks of rivers, of bridges, and of the towns that grew beside them over centuries.",
    "A second one follows; it is shorter, yet it has commas, too.",
    "Short.",
    "The third, which is the longest of them all, goes on about mills, about grain, about the wheels that turned day and night, and so on.",
]
ARTICLE = "".join(f"<p>{x}</p>" for x in P)
TEXT = " ".join(P)
MENU = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Contact", "About us")) + "</ul>"
LONG_COMMENT = "I do not agree with a word of it, honestly, and I have lived there, by the river, for forty years. " * 8

PAGES = {
    "article": (f"<body><nav>{MENU}</nav><article><h1>Title</h1>{ARTICLE}</article><footer>&copy; all, of it.</footer></body>", f"Title {TEXT}"),
    "article header": (
        f"<header>Site name, with a claim.</header><article><header><h1>Title</h1><p>By A. Writer, today.</p></header>{ARTICLE}"
        "<footer>Filed under: rivers.</footer></article>", f"Title {TEXT}"
    ),
    "comments in the article": (
        f"<article><h1>Title</h1>{ARTICLE}<section class='comments'><h2>Comments</h2><article><p>{LONG_COMMENT}</p></article></section></article>",
        f"Title {TEXT}"
    ),
    "nested article": (f"<main><article>{ARTICLE}<article><p>{LONG_COMMENT}</p></article></article></main>", TEXT),
    "comments beside it": (f"<main><article>{ARTICLE}</article></main><div id='comments'><p>{LONG_COMMENT}</p></div>", TEXT),
    "divs": (
        f"<div id=top>{MENU}</div><div class=content><h2>Title</h2>{ARTICLE}</div><div class='right sidebar'><p>Read this, and that, too.</p></div>"
        "<div class=site-footer>Imprint, privacy.</div>", f"Title {TEXT}"
    ),
    "divs without names": (f"<div>{MENU}</div><div><h2>Title</h2>{ARTICLE}</div><div><div>Imprint</div><div>Privacy</div></div>", f"Title {TEXT}"),
    "main": (f"<div role=navigation>{MENU}</div><div role=main>{ARTICLE}</div>", TEXT),
    "notice": (f"<div class='cookie-notice'><p>{LONG_COMMENT}</p></div><article>{ARTICLE}</article>", TEXT),
    "form and advert": (
        f"<article>{P[0]}<div class=ad>Buy this, now.</div><p>{P[1]}</p><form><label>Name</label><input><button>Send</button></form>"
        f"<aside><p>Related, of course.</p></aside><p>{P[2]}<p>{P[3]}</article>", TEXT
    ),
    "links in text": (f"<article><p>See <a href=x>the <i>map</i></a>, and <a href=y>the list</a>.</p><ul><li><a href=z>One</a></li></ul>{ARTICLE}</article>",
                      f"See the map, and the list. One {TEXT}"),
    "inline": ("<article><p>a<b>b</b>c<br>d<span> e </span>\n\t f&nbsp;g</p><pre>x\n  y</pre></article>", "abc d e f g x y"),
    "entities": ("<article><p>&lt;b&gt; &amp;amp; &#233;&#xe9; &am &copy &unknown; 1 < 2 & 3</p></article>", "<b> &amp; éé &am © &unknown; 1 < 2 & 3"),
    "scripts": (
        "<script>if (a < b) document.write('<p>no</p>');</script><article><p>yes<script>var x = '</p>';</script> it is</p>"
        "<style>p > a {}</style><noscript>Turn it on</noscript><textarea>typed</textarea></article>", "yes it is"
    ),
    "attributes": ("<article><p title='a > b' data-x=it's>one</p><p class=\"x\">two</p></article>", "one two"),
    "comments and declarations": ("<!DOCTYPE html><!-- <p>no</p> --><article><p>o<!-->ne</p><?php x ?><p>two<!-- a -- b --></p></article>", "one two"),
    "open ends": (f"<article><h1>Title<p>{P[0]}<p><b>{P[1]}<p>{P[2]}</b><p>{P[3]}", f"Title {TEXT}"),
    "table": ("<article><table><tr><td>a<td>b<tr><th>c</table><dl><dt>d<dd>e</dl></article>", "a b c d e"),
    "lists in lists": ("<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul></article>", "a b c d"),
    "hidden": ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    "layout table": (f"<table><tr><td>{MENU}</td><td><h1>Title</h1>{ARTICLE}</td><td class=ads>Buy, buy.</td></tr></table>", f"Title {TEXT}"),
    "text only": ("just  some\ntext", "just some text"),
    "comment only": ("<!-- nothing -->", ""),
    "cut": ("<article><p>one</p><p cla", "one"),
    "cut script": ("<article><p>one</p><script>var", "one"),
    "upper case": (f"<BODY><NAV>{MENU}</NAV><ARTICLE><P>{P[0]}</P></ARTICLE></BODY>", P[0]),
    "stray ends": (f"</div></p><article>{ARTICLE}</section></span></article></b>", TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_shapes(name):
    source, want = PAGES[name]
    assert main_text(source) == want


def test_paths_by_ratio():
    # Ten short menu entries without punctuation, six paragraphs, one line of a footer.
    of = [1] * 10 + [2] * 6 + [3]
    got = content_paths(of, [6] * 10 + [80, 300, 120, 10, 250, 90] + [30], [0] * 10 + [2, 6, 3, 1, 5, 2] + [1])
    assert got.tolist() == [False] * 10 + [True] * 6 + [False]
    assert content_paths([], [], []).tolist() == [] and content_paths([1], [5], [0]).tolist() == [True]


@pytest.mark.parametrize("source", [
    "<div>" * 50_000 + "x", "<p>a" * 50_000, "</p>" * 50_000, "<b>" * 20_000 + "x" + "</b>" * 20_000, '<a href="' * 20_000, "<a b='\"" * 20_000, "<" * 100_000,
    "&" * 100_000, "<!--" * 50_000, "<p>" + "word " * 400_000, "<script>" * 20_000, "<li>" * 30_000, "<table><tr><td>" * 10_000 + "x", "<b><p></b>" * 10_000,
    "<a =" * 20_000,
])
def test_extreme_pages_take_little_time(source):
    began = time.process_time()
    main_text(source)
    assert time.process_time() - began < 8


def test_edge_rows(spark):
    rows = [(1, None), (1, ""), (2, "<article><p>aé\U0001f600</p></article>"), (None, "plain"), (3, "plain"), (3, "plain")]
    df = spark.createDataFrame([(i, h, "old", 5, None, 7) for i, h in rows], "page_id bigint, html string, text string, `a.b` int, c0 string, N_CHARS int")
    got = extract_text(df)
    assert got.columns == ["page_id", "a.b", "c0", "text", "n_chars"]
    found = sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=str)
    assert found == sorted([(1, "", 0), (1, "", 0), (2, "aé\U0001f600", 3), (None, "plain", 5), (3, "plain", 5), (3, "plain", 5)], key=str)
    assert extract_text(df.limit(0)).count() == 0


def test_query(spark):
    """All pages of the smallest table against their article's blocks cut out by pattern."""
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op11_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").where(F.col("html").isNotNull()).collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.DOTALL)[1]
        blocks = [re.sub(r"</?b>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", article)]
        want = " ".join(" ".join(html.unescape(x).split()) for x in blocks if x.strip())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url
