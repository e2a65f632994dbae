import html
import re
import time
import tracemalloc

import pytest

from quillmark.llm import html_text
from quillmark.llm.common import table

PAGE = """<html><head><title>x</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies, many of them and more of them.</div><ul class="menu"><li><a href=1>one</a></ul>
<div class="post-content-{0}"><h1>Title &amp; more</h1><p>First   para with <b>bo</b>ld text that is long enough, {0}.</p><div class="ad">Buy now, this is good, very good indeed</div>
<p>Second para, with more text, and commas, so many.<ul><li>item one<li>item two</ul><form>Search <input name=q></form><script>var a = "<p>no</p>";</script></div>
<aside>side text long enough to be scored as well, maybe</aside><section class="comments"><div class="comment"><p>A reader says, at length, that this is a very long comment
indeed, with lots of words, more than the article has in all, so that it would win by length alone, if it could, but it cannot.</p></div></section><footer>&copy; me</footer></body>"""


def test_consensus_path_wins_over_a_page_of_its_own(spark):
    odd = '<html><body class="has-sidebar"><div class="post-content-9">Short.</div><div class="widget-area-text"><p>Something else, long, and longer, and even longer than that, in a box.</p></div></body>'
    rows = [(k, f"http://h.example/{k}", PAGE.format(k)) for k in range(5)] + [(9, "https://H.example:80/9", odd)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k].text == f"Title & more First para with bold text that is long enough, {k}. Second para, with more text, and commas, so many. item one item two"
        assert got[k].n_chars == len(got[k].text)
    assert got[9].text == "Short."


def test_articles_of_the_table(spark):
    rows = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = html_text.main_text(table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert len(got) == len(rows)
    for r in got:
        part = re.search(r"<article>(.*?)(?:</article>|\Z)", rows[r.page_id], re.S)[1]
        want = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", part)))
        assert r.text == " ".join(want.split())


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a/", "<p>text only"), (3, "http://a/", "plain text, no markup"), (4, "not a url", "<div><p>unclosed <b>tags &amp; half &am"), (4, "not a url", "<div><p>unclosed <b>tags &amp; half &am"), (5, "http://a", "<<<>>><p"), (6, "http://a", "<script>x")]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = [(r.page_id, r.text) for r in html_text.main_text(frame).collect()]
    assert len(got) == len(rows)
    assert {k: t for k, t in got if k in (1, 2, 3, 6)} == {1: "", 2: "", 3: "plain text, no markup", 6: ""}
    assert got.count((4, "unclosed tags & half &am")) == 2 and (None, "text only") in got
    assert html_text.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["post-comments", "article-footer", "main-nav", "page-header", "post-share", "content-sidebar", "entry-related", "sidebar-content", "text-ad", "comments", "cookieNotice", "widget_area"])
def test_boilerplate_names(name):
    page = f'<body><div class="content"><p>{"An article of some length. " * 9}</p><div class="{name}">{"Not a part of it, whatever its length. " * 30}</div></div></body>'
    assert html_text.extract(page, [])[0] == ("An article of some length. " * 9).strip()


@pytest.mark.parametrize("name", ["has-sidebar", "content-with-ads", "layout sidebar-left", "page header-fixed", "no-comments"])
def test_wrapper_names(name):
    page = f'<body><div class="{name}"><h1>Title</h1><div class="entry-header"><h2>Heading</h2>by me</div><p>{"An article of some length. " * 9}</p></div></body>'
    assert html_text.extract(page, [])[0] == "Title Heading " + ("An article of some length. " * 9).strip()


def test_articles_in_parts():
    text = "Words of a part, some and more and more. " * 4
    page = f'<body><nav>Menu</nav><div class="c"><div class="part"><p>{text}</p></div><section class="x"><p>{text}</p></section><div class="links"><a>{text}</a></div></div><div>Unnamed, {text}</div></body>'
    path = ">body>div.c>div.part"
    assert html_text.vote(page.replace("section", "i"))[0].startswith(">body>div.c")
    assert html_text.extract(page, [path]) == ((text + text).strip(), path)
    # Paths that the host's other pages voted for count as well, but neither around nor inside of what is taken.
    assert html_text.extract(page, [path, ">body>div.c", ">body>div"]) == (f"{text}{text}Unnamed, {text}".strip(), f"{path} >body>div")


@pytest.mark.parametrize("markup", ["<div>", '<div class="a">', "<b>", '<a "', "<a x='", "<p><b>", "<i></b>", "<!--", "<", "</div>", "<script>", "<li><span>"])
def test_long_markup_takes_linear_time_and_memory(markup):
    page = "<p>First words of the page.</p>" + markup * 100_000
    began = time.process_time()
    assert html_text.extract(page, [">body>div"])[0].startswith("First words of the page.")
    assert time.process_time() - began < 6
    tracemalloc.start()
    html_text.parse(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
