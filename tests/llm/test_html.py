import math
import time

import numpy as np
import pytest

from sylvan.llm import html
from tests.llm import odd

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="ad-page">
<header><a href="/">Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy</div><!-- <p>hidden</p> -->
<article><h1>A &amp; B</h1><p>First  <b>bo</b>ld
 text &lt;here&gt;.<br>more<p>Second &eacute;&#233;.</p><ul><li>one<li>two</ul><form>Name <input></form><footer>by me</footer></article>
<aside>Also</aside><div id="comments"><article class="comment"><p>Nice post, a long comment that goes on and on and on.</p></article></div>
<footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "A & B\nFirst bold text <here>. more\nSecond éé.\none\ntwo"),
        (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain &amp; simple", "plain & simple"), ("<script>x", ""), ("<!-- x", ""), ("a<b", "a"),
        ("<p>a<p>b<!-- x --><script>var a='<p>z'</script>c", "a\nbc"),
        ("<div><div class='sidebar'>menu here</div><div class=content><h2>Head</h2><p>Some text in here.</p></div></div>", "Head\nSome text in here."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p title='a > b' hidden>no</p><p data-x=\"</p>\">yes", "yes"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><p>Top</p><div class='layout has-sidebar'><article><p>Some text in here.</p></article></div>", "Some text in here."),
        ("<body><p>Top</p><div class='post sidebar'><h1>Head</h1><p>Some text in here, and more of it.</p></div>", "Head\nSome text in here, and more of it."),
        ("<div class='ad'>Buy this, it is longer than the article.</div><article><p>Short.</p></article>", "Short."),
        ("<section id='main-search'><p>Some text in here.</p></section>", "Some text in here."),
        ("<article><h2 id='related-work'>Related</h2><p>Some text.</p><h2 id='navigation'>Ways</h2><p class='notice'>Mind this.</p></article>", "Related\nSome text.\nWays\nMind this."),
        ("<article><p>Some text in here, long enough to stand.</p><ul><li><a href='x'>First source</a><li><a href='y'>Second source</a></ul></article>", "Some text in here, long enough to stand.\nFirst source\nSecond source"),
        ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> holds.</p></article>", "If x=2 holds."),
    ],
)
def test_main_text_isnt_dropped_by_name(page, text):
    assert html.main_text(page) == text


def test_deep_and_long_pages_end():
    assert html.main_text("<div>" * 50_000 + "x") == "x"
    assert len(html.main_text("<p>word</p>" * 100_000)) == 5 * 100_000 - 1
    assert html.main_text("<a b=\"" * 2000) == ""


def test_table(spark):
    pages = spark.createDataFrame([(1, None, PAGE, "c"), (1, None, PAGE, "c"), (None, "u", None, "c"), (3, "u", odd.LONG, "c")], "page_id long, url string, html string, text string")
    rows = html.extract(pages).collect()
    assert len(rows) == 4 and rows[0] == rows[1] and rows[2].text == "" and rows[3].n_chars == len(" ".join(odd.LONG.split()))
    assert html.extract(pages.where("false")).count() == 0


def test_of_an_articles_header_the_headings_stay():
    page = "<body><header>Site</header><article><header><div><h1>Title</h1> <span>Share on social</span></div><h2>Sub</h2></header><p>" + "All of the text. " * 9 + "</p></article></body>"
    assert html.main_text(page) == "Title\nSub\n" + " ".join(["All of the text."] * 9)


LONG_TEXT = "All of the text that makes up this article. " * 6


@pytest.mark.parametrize("name", ["comments-area", "post-comments", "newsletter-signup", "cookie-notice", "postComments", "share_buttons", "related-posts", "ad-slot", "comments"])
def test_compound_names_in_and_before_an_article(name):
    said = "What a reader or a firm says here isn't the text. " * 20  # longer than the text itself
    for attr in ("class", "id"):
        for page in (
            f"<body><article><h1>Title</h1><p>{LONG_TEXT}</p><div {attr}='{name}'><p>{said}</p></div></article></body>",
            f"<body><div {attr}='box {name}'><p>{said}</p></div><div class='content'><h1>Title</h1><p>{LONG_TEXT}</p></div></body>",
            f"<body><div class='layout has-sidebar with-comments'><div {attr}='{name}'>{said}</div><h1>Title</h1><p>{LONG_TEXT}</p></div></body>",
        ):
            assert html.main_text(page) == "Title\n" + LONG_TEXT.strip()


def test_raw_elements_end_where_the_page_says():
    """Letters that grow in lower case before a script move nothing."""
    page = "<body><p>" + "\u0130" * 30 + "</p><SCRIPT>var a = '<p>no</p>';</Script ><p>The next paragraph is whole.</p></body>"
    assert html.main_text(page) == "\u0130" * 30 + "\nThe next paragraph is whole."
    assert html.main_text("<p>a</p><script>x</\u017fcript><p>b</p></script><p>c</p>") == "a\nc"


def timed(page):
    began = time.process_time()
    html.main_text(page)
    return time.process_time() - began


@pytest.mark.parametrize(
    "made",
    [
        lambda n: "<b>" * n + "</p>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<center>" * n + "x", lambda n: "<div class='sidebar'>word " * n,
        lambda n: "<div class='sidebar'>word word<div class='widget'>" * n, lambda n: "<p><b>" * n, lambda n: "<li><b>" * n, lambda n: "<table><tr><td>" * n + "x</td>" * n, lambda n: "<script>x" * n, lambda n: "<a href='" * n,
    ],
)
def test_time_grows_with_the_page(made):
    small = min(timed(made(4000)) for _ in range(2))
    assert timed(made(16_000)) < 9 * small + 0.2


def plain_density(node, share):
    """Density of a nested (tag, children) by the formula alone; children are texts or such pairs."""
    own = [c for c in node[1] if not isinstance(c, str)]
    chars = lambda n: sum(len("".join(c.split())) if isinstance(c, str) else chars(c) for c in n[1])
    tags = lambda n: sum(1 + tags(c) for c in n[1] if not isinstance(c, str))
    links = lambda n: chars(n) if n[0] == "a" else sum(links(c) for c in n[1] if not isinstance(c, str))
    link_tags = lambda n: (n[0] == "a") + sum(link_tags(c) for c in n[1] if not isinstance(c, str))
    c, t, lc, lt = chars(node), tags(node), links(node), link_tags(node)
    share = lc / max(c, 1) if share is None else share
    density = 0.0
    if c:
        inner = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        density = c / max(t, 1) * math.log(1 + c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(1 + inner)
    below = [plain_density(k, share) for k in own]
    return node[0], density, sum(b[1] for b in below), below


def made_tree(r, depth):
    children = []
    for _ in range(r.integers(1, 5)):
        kind = r.integers(0, 4)
        children.append(made_tree(r, depth - 1) if depth and kind else "word " * int(r.integers(1, 9)))
    return (str(r.choice(["div", "section", "span", "a", "em"])), children)


def as_html(node):
    return f"<{node[0]}>" + "".join(c if isinstance(c, str) else as_html(c) for c in node[1]) + f"</{node[0]}>"


def test_densities_and_sums_by_the_formula():
    r = np.random.default_rng(5)
    for _ in range(40):
        tree = ("body", [made_tree(r, 3) for _ in range(2)])
        root = html.parse(as_html(tree))
        html.measure(root)
        todo = [(root.children[0], plain_density(tree, None))]
        while todo:
            got, (tag, density, total, below) = todo.pop()
            assert got.tag == tag and got.density == pytest.approx(density) and got.total == pytest.approx(total)
            kids = [c for c in got.children if not isinstance(c, str)]
            assert len(kids) == len(below)
            todo += zip(kids, below)
