"""Wrapper inference and extraction."""

import html
import re

from assetlens.llm import queries, wrappers
from fixtures import SF


def plain_article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
    return "\n".join(b for b in blocks if b)


def test_op7_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op7_wrapper_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_wrappers_are_union_free():
    pages = ["<body><nav>x</nav><div class='content'><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div></body>", "<body><div class='content'><h2>a</h2><p>b</p></div><form>q</form></body>"]
    one, two = map(wrappers.skeleton, pages)
    assert wrappers.expression(one) == "<body><nav>x</nav><div.content>(<h2>#TEXT</h2><p>#TEXT</p>)+</div></body>"
    assert "|" not in wrappers.expression(wrappers.merge(one, two))
    assert wrappers.expression(wrappers.merge(one, two)).startswith("<body>(<nav>x</nav>)?<div.content>")


FULL = """<body><header class=site>H</header><div id="main"><div class="content post"><h1>T &amp; x</h1><p>one <a href=q>two</a>
 three<p>3 &lt; 4 &eacute;<div class="share">sh</div><form><p>f</p></form><ul><li>a<li>b</ul><p>four</p><section id=comments><p>cm</p></section></div>
<aside>s</aside></div><div class="cookie-notice">c</div><div class="ad">ad</div><footer>f</footer><script>var t="</p>";</script><!-- <p>no</p> --></body>"""


def test_furniture_is_left_out():
    path = wrappers.main_path(wrappers.skeleton(FULL))
    assert wrappers.extract(FULL, path).split("\n") == ["T & x", "one two three", "3 < 4 é", "a", "b", "four"]


def test_headers_belong_to_the_text_only_inside_it():
    page = "<body><div class='site-header'>S</div><article><header><h1>T</h1></header><div class='article-header'>by x</div><p>one</p></article></body>"
    assert wrappers.extract(page, ["body", "article"]).split("\n") == ["T", "by x", "one"]
    assert wrappers.extract(page, ["nowhere"]).split("\n") == ["T", "by x", "one"]


def test_op7_odd_pages(spark):
    deep = "<div>" * 3000 + "hi" + "</div>" * 10
    rows = [(1, "http://a.b/x", FULL), (2, "http://a.b/y", None), (3, None, "<p>a<p>b"), (4, "no url", ""), (5, "http://a.b/z", deep), (6, "http://c.d", "text only"), (6, "http://c.d", "text only"), (7, "http://e", "<p unclosed"), (8, "http://f", "<a href='x>y</a> z")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, path string")
    out = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert out[1].startswith("T & x") and out[2] == "" and out[3] == "a\nb" and out[4] == "" and out[5] == "hi" and out[6] == "text only"
    assert wrappers.main_text(pages).count() == len(rows) and wrappers.main_text(pages.limit(0)).count() == 0


def test_article_text_is_kept_whatever_its_ids_mention(spark):
    """Ids made from the words of a heading name no furniture; whole furniture names still do."""
    inside = [
        '<h2 id="comments-on-the-proof">k1</h2>', '<p class="share-price">k2</p>', '<section id="related-work"><p>k3</p></section>', '<div id="search-algorithms">k4</div>',
        '<h2 id="notice-period">k5</h2>', '<p id="comments">k6</p>', '<h3 class="share">k7</h3>', '<div class="cookie-dough recipe">k8</div>', "<p>a <span class=ad>b</span> c</p>",
    ]
    out = ['<div class="cookie-notice">x</div>', '<section id="comments">x</section>', '<div class="post share-buttons">x</div>', '<ul class="related_posts-2">x</ul>', '<div class="ad">x</div>', '<div id="comment-12">x</div>', "<nav>x</nav>"]
    page = "<body><header>x</header><article>" + "".join(a + b for a, b in zip(inside, out + ["", ""])) + "</article><footer>x</footer></body>"
    pages = spark.createDataFrame([(i, f"http://host{i % 2}.example/{i}", page) for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(pages).collect()} == {"k1\nk2\nk3\nk4\nk5\nk6\nk7\nk8\na b c"}
