"""Main text of pages: the given template against a plain cut, and pages of other shapes by hand."""

import html
import re

import pytest

from leafwright.llm import op11_main_text as op

PROSE = [
    "The first paragraph of the story is long enough, and it has commas, stops, and an end.",
    "A second one follows; it speaks of other things, and it ends here. Then one more sentence comes.",
    "The third paragraph closes the story, with a last remark, some names, and a full stop at the end.",
]
TEXT = " ".join(PROSE)
P = "".join(f"<p>{x}</p>" for x in PROSE)
NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul>'


def plain(source):
    """The article of the given pages, by patterns for this one template."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    pieces = re.split(r"</?(?:p|h1|br)>", re.sub(r"<[^>]*\Z", "", body))
    found = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in pieces)
    return " ".join(x for x in found if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in op.extract(pages).collect()}
    for r in pages.collect():
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (plain(r.html), len(plain(r.html)), r.url)


SHAPES = {
    "no article element": f'<body><div id="top">{NAV}</div><div class="main-col"><h1>A title</h1>{P}</div><div class="sidebar"><p>Read our other stories, they are good, and many.</p></div><div id="footer">© Site, all rights reserved.</div></body>',
    "names that say nothing": f'<body><div class="x1">{NAV}</div><div class="x2"><h1>A title</h1>{P}</div><div class="x3"><a href="#">One</a> <a href="#">Two</a></div></body>',
    "comments as articles": f'<body><article><h1>A title</h1>{P}<section class="comments"><article class="comment"><p>{PROSE[0]}</p></article></section></article></body>',
    "comments under their heading": f'<main><h1>A title</h1>{P}</main><div class="z"><h3>3 Comments</h3><div><p>{PROSE[1]}</p></div><p>{PROSE[0]}</p></div>',
    "forms, notices, adverts inside": f'<article><div class="cookie-notice">We use cookies, as all do.</div><h1>A title</h1><p>{PROSE[0]}</p><div class="ad-slot">Buy this, now, cheap.</div><p>{PROSE[1]}</p><form><label>Mail</label><input><button>Go</button></form><p>{PROSE[2]}</p><aside>Related, perhaps.</aside></article>',
    "page header and footer": f'<header><p>The site of all sites, since 1900.</p>{NAV}</header><article><header><h1>A title</h1><span>By someone</span></header>{P}<footer>Tags, and more.</footer></article><footer><p>All rights, reserved.</p></footer>',
    "layout names": f'<body class="has-sidebar no-comments"><div class="sidebar-layout wrapper"><div class="content with-sidebar"><h1>A title</h1>{P}</div></div></body>',
    "tables": f'<table><tr><td>{NAV}<td><h1>A title</h1>{P}</table>',
    "unclosed blocks": f'<article><h1>A title</h1><p>{PROSE[0]}<p>{PROSE[1]}<p>{PROSE[2]}</article>',
    "inline tags": f'<article><h1>A <em>title</em></h1><p>{PROSE[0].replace("story", "<a href=x>st</a><b>ory</b>")}</p><p>{PROSE[1]}</p>\n<p>{PROSE[2]}</p></article>',
    "scripts, styles, comments, hidden": f'<article><h1>A title</h1><script>if (a < b) document.write("<p>no</p>")</script><style>p > a {{}}</style><!-- <p>{TEXT}</p> --><p>{PROSE[0]}</p><p hidden>{PROSE[1]}</p><div style="display: none">{TEXT}</div><p>{PROSE[1]}</p><noscript><p>{PROSE[0]}</p></noscript><p>{PROSE[2]}</p></article>',
    "odd attributes": f'<article data-x="a > b" title=\'<p>\' class=story><h1 id=t>A title</h1><p title="5\' tall" >{PROSE[0]}</p><p class=\'a"b\'>{PROSE[1]}</p><p x=">">{PROSE[2]}</p></article>',
    "roles": f'<div role="banner">The site, and its motto.</div><div role="main"><h1>A title</h1>{P}</div><div role="complementary">{PROSE[0]}</div>',
    "title beside the text": f'<div class="x"><h1>A title</h1><div class="y">{P}</div></div><div class="z"><h1>Not this</h1></div>',
    "title in the article's header": f'<header class="site-header"><a href="/">Site</a></header><article><header class="entry-header"><h1>A title</h1><p>Posted by me, today.</p></header><div class="entry-content">{P}</div><footer class="entry-footer">Tags: a, b</footer></article>',
    "title before the article's text": f'<main><div>{NAV}</div><article><h1>A title</h1><div><div>{P}</div></div></article></main>',
    "comment list": f'<div id="content"><div class="post"><h2>A title</h2>{P}</div><ol class="commentlist"><li id="comment-1"><p>{PROSE[0]}</p></li></ol></div>',
    "comments heading inside": f'<article><h1>A title</h1>{P}<h2>Comments (2)</h2><div><p>{PROSE[0]}</p></div><p>{PROSE[2]}</p></article>',
    "related, shared, signed up": f'<article><h1>A title</h1><div class="social-share"><a href="x">Tweet</a></div>{P}<div class="newsletter-signup"><p>Subscribe, it is free, and good.</p></div><div class="related-posts">{NAV}</div></article>',
    "paragraphs in the body": f'<body><div class="nav">{NAV}</div><h1>A title</h1>{P}<div class="footer">(c) 2020, all rights reserved.</div></body>',
    "longer comments": f'<div class="post"><h1>A title</h1>{P}</div><div id="disqus_thread">{P}{P}{P}</div>',
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    assert op.main_text(SHAPES[name]) == f"A title {TEXT}"


def test_blocks_and_references():
    page = "<article><h2>Q&amp;A&nbsp;&mdash; caf&eacute; &#x41;&#66;</h2><p>  one,\n\ttwo&lt;three&gt; &amp &unknown; x&#8212;y  </p><ul><li>first, item<li>second, <a href=x>item</a></ul><pre>a\n  b, c</pre><table><tr><td>cell, one<td>cell, two</table></article>"
    assert op.main_text(page) == "Q&A — café AB one, two<three> & &unknown; x—y first, item second, item a b, c cell, one cell, two"


def test_cut_off():
    whole = f"<html><body><nav>{NAV}</nav><article><h1>A title</h1>{P}</article></body></html>"
    start = whole.index("<article>")
    for at in range(start + 9, len(whole)):
        text = op.main_text(whole[:at])
        assert f"A title {TEXT}".startswith(text)
    assert op.main_text(whole[: whole.index("</article>") + 4]) == f"A title {TEXT}"


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "<!--", "<a href='", "</", "<script>x", f"<nav>{NAV}</nav>", "<p></p>", "<html><head><title>t</title></head></html>"])
def test_nothing(page):
    assert op.main_text(page) == ""


def test_long_pages():
    many = "".join(f"<p>{PROSE[k % 3]}</p>" for k in range(20_000))
    assert len(op.main_text(f"<body><nav>{NAV}</nav><div>{many}</div></body>")) == sum(len(PROSE[k % 3]) + 1 for k in range(20_000)) - 1
    deep = "<div>" * 50_000 + P
    assert op.main_text(deep) == TEXT
    assert op.main_text("<p>" + "a\" <b '>" * 50_000 + PROSE[0]).endswith(PROSE[0])


def test_table(spark):
    rows = [(1, "u", SHAPES["tables"], "x"), (1, "u", SHAPES["tables"], "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = [(1, "u", f"A title {TEXT}", len(TEXT) + 8)] * 2 + [(2, "v", "", 0), (None, None, "", 0)]
    assert sorted((tuple(r) for r in op.extract(pages).collect()), key=str) == sorted(want, key=str)
    assert op.extract(pages.limit(0)).count() == 0
