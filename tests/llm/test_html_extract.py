import pytest

from braidpath.llm import html_extract
from braidpath.llm.html_extract import main_text

PROSE = "The house on the hill was sold to a man who had come from the north, and he was said to be the last of them."
MORE = "It was the first of the letters that he had written to her, and in all of them there was a word of the sea."
LINKS = "<ul><li><a href=/a>The first of the links</a></li><li><a href=/b>And the other one of them</a></li></ul>"

CASES = {
    "plain article": (f"<body><nav>{LINKS}</nav><article><h1>Of</h1><p>{PROSE}<p>Be.</article><footer>&copy; the site</footer>", f"Of\n\n{PROSE}\n\nBe."),
    "odd words": ("<article><h1>X1%%%</h1><p>De%%% êeux*** ouier###</p></article>", "X1%%%\n\nDe%%% êeux*** ouier###"),
    "null": (None, ""),
    "empty": ("", ""),
    "no text": ("<html><head><title>Only a title</title></head><body><script>var t='</p>';</script></body></html>", ""),
    "references once": ("<article><p>a &amp;amp; b &lt;p&gt; &quot;c&#233;&#x41;&nbsp;d&am</p></article>", 'a &amp; b <p> "céA d&am'),
    "white space": ("<article><p>  a\t\n b<br>c <b>d</b>e f </p></article>", "a b c de f"),
    "raw elements": (f"<article><p>{PROSE}</p><script>if (a<b) '</p>'</script><style>p{{}}</style><svg><text>no</text></svg><p>end</p></article>", f"{PROSE}\n\nend"),
    "comment": ("<article><p>a<!-- <p>no</p> -->b</p></article>", "ab"),
    "cut in a tag": ("<article><p>one</p><p>two</p><p cla", "one\n\ntwo"),
    "cut in a script": ("<article><p>one</p><script>var x", "one"),
    "cut in a comment": ("<article><p>one</p><!-- two", "one"),
    "no tag": ("<article><p>a < b and c > d <3</p></article>", "a < b and c > d <3"),
    "aside and form": (f"<main><p>{PROSE}</p><aside><p>{MORE}</p></aside><form><p>{MORE}</p></form><p>so.</p></main>", f"{PROSE}\n\nso."),
    "named parts": (
        "<body>" + "".join(f"<div class='{c}'><p>{MORE}</p></div>" for c in ("ad", "sidebar-left", "siteMenu", "cookie_notice", "post comments", "x newsletter-box", "share")) + f"<article class='post with-sidebar'><p>{PROSE}</p></article>",
        PROSE,
    ),
    "reader comments": (f"<article><p>{PROSE}</p></article><section id=comments><article class=comment><p>{MORE}</p></article></section>", PROSE),
    "hidden": (f"<article><p hidden>{MORE}</p><p style='display: none'>{MORE}</p><p>{PROSE}</p></article>", PROSE),
    "roles": (f"<div role=banner>{MORE}</div><div role=main><p>{PROSE}</p></div><div role='contentinfo'>{MORE}</div>", PROSE),
    "own header": (f"<header><p>{MORE}</p></header><article><header><h1>Title</h1></header><p>{PROSE}</p></article>", f"Title\n\n{PROSE}"),
    "own header by name": (f"<div class='site-header'>{MORE}</div><article><div id='postHeader'><h1>Title</h1></div><p>{PROSE}</p></article>", f"Title\n\n{PROSE}"),
    "links in the article": (f"<article><p>{PROSE}</p><p>{MORE}</p><h2>See also</h2>{LINKS}</article>", f"{PROSE}\n\n{MORE}"),
    "a link in prose": (f"<article><p>{PROSE} <a href=x>here</a></p></article>", f"{PROSE} here"),
    "unmarked": (f"<body><div>Home</div>{LINKS}<div><h2>Of the sea</h2><p>{PROSE}</p><p>So.</p><p>{MORE}</p></div>{LINKS}<div>2020</div>", f"Of the sea\n\n{PROSE}\n\nSo.\n\n{MORE}"),
    "unmarked without text": (f"<body>{LINKS}<p>Short</p>", ""),
    "form around a page": (f"<form id=f><div class=menu>{LINKS}</div><main><p>{PROSE}</p></main></form>", PROSE),
    "open head": (f"<html><head><title>T</title><meta charset=x><body><article><p>{PROSE}</p></article>", PROSE),
    "outside the article": (f"<div><p>{MORE}</p></div><article><p>{PROSE}</p></article>", PROSE),
    "quotes in tags": (f"<article><p title='a > b' data-x=\"<p>\">{PROSE}</p></article>", PROSE),
    "upper case": (f"<NAV>{LINKS}</NAV><ARTICLE><P>{PROSE}</P></ARTICLE>", PROSE),
    "cells": ("<article><table><tr><td>a<td>b</tr></table></article>", "a\n\nb"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_two_passes():
    """What density decides, and what its neighbours decide."""
    found = html_extract.blocks(f"<body><p>Top</p>{LINKS}<h3>Head</h3><p>{PROSE}</p><p>{'zxq ' * 40}</p><p>Tail</p><ul><li><a href=x>more of the same</a></li></ul>")
    html_extract._first_pass(found)
    assert [b.label for b in found] == [None, False, False, None, True, None, None, False]
    html_extract._second_pass(found)
    assert [b.label for b in found] == [False, False, False, True, True, True, False, False]


def test_table(spark):
    rows = [(k, f"http://x/{k}", page, "x") for k, (page, _) in enumerate(CASES.values())] + [(None, None, None, "x"), (0, "u", "<p>" * 3, "y"), (0, "u", "<p>" * 3, "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    got = {(r["page_id"], r["url"]): r for r in html_extract.extract(pages).collect()}
    for k, (_, want) in enumerate(CASES.values()):
        r = got[k, f"http://x/{k}"]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert got[None, None]["text"] == "" and html_extract.extract(pages).count() == len(rows)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<" * 300_000, "<p>" * 100_000, "<svg>" * 100_000, "<script>" * 50_000, '<p "' * 50_001, "<!--" * 100_000, "<div>" * 3_000 + "x", "&" * 300_000, "<article><p>" + "word " * 400_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 5, page[:10]


def test_planted_pages(spark):
    """The article of each generated page comes out whole."""
    import html
    import re

    from tests.conftest import DATA

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("(?s)<article>(.*?)(</article>|$)", r["html"])[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)
