"""Main text: built pages against what they were built from, odd markup, sites."""

import html as html_lib
import random
import re

from threadloom.llm import main_text as M
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def article_of(page):
    """The article of a page of the test tables, whose markup is known: blocks are h1 and p."""
    body = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    blocks = re.split(r"</?(?:p|h1)>", body)
    lines = (" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op6_site_templates"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert r["url"] == page["url"] and r["text"] == article_of(page["html"]) and r["n_chars"] == len(r["text"])


def text(page):
    return M.Page(page).text()


def test_markup():
    assert text("") == "" and text("plain &amp; simple\n text") == "plain & simple text"
    assert text("<p>a<p>b <b>c<br>d</p></b></div>e") == "a\nb c d\ne"
    assert text("<h1>T</h1><script>var a='</p><p>x';</script><style>p{}</style><p>x<!-- <p>no</p> -->y</p>") == "T\nxy"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a\nb\nc\nd\ne"
    assert text("<p title='a>b'>x</p><p title=\"open>y</p>") == "x\ny"
    assert text("<nav>n</nav><header>h</header><p>x &lt;b&gt; &#233;&nbsp;y</p><footer>f</footer>") == "x <b> é y"
    assert text("a < b and c > d <3") == "a < b and c > d <3"
    assert text("<p>" * 3000 + "x" + "<div>" * 3000 + "y") == "x\ny"


def test_parts_around_and_inside_an_article():
    page = """<body class="has-sidebar"><header>Site</header><div class="cookie-notice">Cookies</div>
      <div class="layout sidebar-left"><aside>Side</aside><main><article><header><h1>Title</h1><nav>crumbs</nav></header>
      <p>One <span class="ad">Buy</span> two.</p><div class="share-buttons">Share</div><form>Mail <input></form><p>Three.</p>
      <section id="comments"><article class="comment"><p>Nice</p></article></section></article></main></div>
      <p>stray</p><footer>End</footer></body>"""
    assert text(page) == "Title\nOne two.\nThree."
    assert text('<div class="ad">Unclosed <article><p>Text</p></article>') == "Text"


def site(rng, n, host, extra="", shared=0):
    """Pages without marked parts: only recurrence tells the template."""
    menu = "<div><span>Home</span> <span>News</span></div>"
    rows = []
    for i in range(n):
        body = " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(40))
        title = "copy" if i < shared else f"title {i}"
        content = "same words all over " * 5 if i < shared else body
        rows.append((f"http://{host}/{i}", f"<title>{title}</title>{menu}<div><h2>{title}</h2><p>{content}</p></div>{extra}", content, title))
    return rows


def test_templates_of_a_site_go_and_copies_stay(spark):
    rng = random.Random(1)
    made = site(rng, 20, "a.org", "<div>Impressum</div>", shared=8) + site(rng, 3, "small.org")
    rows = [(i, u, h, "x", 1) for i, (u, h, _, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, gone int")
    out = {r["page_id"]: r["text"] for r in M.report(df).collect()}
    assert len(out) == len(rows)
    for i, (_, _, content, title) in enumerate(made):
        main = f"{title}\n{content.strip()}"
        assert out[i] == (main if i < 20 else f"Home News\n{main}")


def test_recurrence_decides_before_marks(spark):
    subtrees = M.Page("<nav>Home</nav><article><h1>T</h1><p>Long enough text</p><ul><li>a</ul></article>").subtrees
    assert len(subtrees) == 2
    rows = [(i, f"http://b.org/{i}", f"<nav>Home</nav><article><p>own text of page {i}</p><ul><li>Buy</ul></article>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in M.report(df).collect()} == {i: f"own text of page {i}" for i in range(6)}


def test_a_dropped_parent_wins_over_an_article_in_it():
    aside = "<aside class=related><article>teaser</article></aside>"
    assert text(f"<div>The text of the page</div>{aside}") == "The text of the page"
    assert text(f"<article>The text of the page{aside}</article>{aside}") == "The text of the page"
    assert text("<form><article>Text</article></form><footer>f</footer>") == "Text"


def test_pages_are_counted_by_their_own_text(spark):
    rows = []
    for i in range(300):  # no titles; a notice on 2 per cent of the pages
        notice = "<div>Section notice</div>" if i < 6 else ""
        rows.append((i, "http://c.org/", f"<div>Menu</div>{notice}<div><p>what page {i} says of number {i}</p></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in M.report(df).collect()} == {i: f"what page {i} says of number {i}" for i in range(300)}


def test_a_class_never_drops_the_text_of_a_page():
    body = "<h1>T</h1><p>The whole text of the page, which is long enough.</p>"
    want = "T\nThe whole text of the page, which is long enough."
    assert text(f'<div class="layout has-sidebar">{body}</div>') == want
    assert text(f'<section class="no-comments">{body}</section>') == want
    assert text(f'<div class="post social-studies">{body}</div><div>1 May</div>') == f"{want}\n1 May"
    assert text(f'<div class="sidebar-layout">{body}<div class="ad-box">Buy</div></div><div class="share-bar">Share</div>') == want
    assert text(f'<div class="sidebar">Links</div>{body}') == want
    assert text(f'<div class="promo">{body}</div><article>The article</article>') == "The article"


def test_near_copies_keep_their_text(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))
    long, part = words(60), words(30)
    rows = [(i, "http://d.org/", f"<div><p>edition {i}</p><p>{long}</p><section><p>{part}</p></section></div>") for i in range(5)]
    rows += [(10 + i, "http://d.org/", f"<div>Menu</div><div><p>{words(40)}</p></div>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in M.report(df).collect()}
    assert all(got[i] == f"edition {i}\n{long}\n{part}" for i in range(5))
    assert not any("Menu" in got[10 + i] for i in range(9))


def test_deep_markup_is_read_in_a_time_that_grows_with_it():
    import time

    for piece, end in (("<div>", "</div>"), ("<div>", "</i>"), ("<nav>", "</nav>"), ("<i>", "<hr>"), ("<form><article>", "</b>")):
        n = 1_000_000 // (len(piece) + len(end))
        start = time.process_time()
        M.Page(piece * n + "x" + end * n)
        assert time.process_time() - start < 15, piece


def test_odd_inputs(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://h/", None), (4, None, "<p>x"), (None, "http://h/", "<p>y"),
            (4, None, "<p>x"), (5, "no host", "<" * 2000), (6, "http://h/", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in M.report(df).collect() if r["page_id"] != 2)
    assert [(k, n) for k, _, n in out] == [(0, 1), (1, 0), (3, 0), (4, 1), (4, 1), (5, 2000), (6, 199_999)]
    assert M.report(df.limit(0)).count() == 0
