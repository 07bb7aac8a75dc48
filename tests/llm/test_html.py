"""Operator 12: main text of pages."""

import html as entities
import random
import re
import time

from milepost.llm import html_text
from milepost.llm.html_text import article_text, distribution, surges
from milepost.llm.registry import LLM_QUERIES

LONG = "A sentence of the article that is long enough to stand out from the menus around it, clearly."
OTHER = "Another paragraph, with a comma, a number 3 and enough words for a surge of its own in the page."


def page(body, head="<title>T &amp; t</title><style>p{}</style><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html lang=en><head>{head}</head><body class='has-sidebar'>{body}</body></html>"


MARKED = page(
    f"""<header class="site-header"><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice"><p>{OTHER}</p><button>OK</button></div><div id="breadcrumbs"><a href="/a">A</a> / B</div>
<main><article class="post has-comments"><header><h1>The title</h1><p class="byline">By me</p></header>
<p>{LONG}</p><p>Short.</p><aside><p>{OTHER}</p></aside>
<div class="ad">Buy {OTHER}</div><h2>Part</h2><ul><li>one</li><li>two <a href="x">linked</a></li></ul>
<form action="/s"><label>Mail</label><input name=m></form>
<blockquote>Quoted<br>twice</blockquote><p>The &lt;end&gt; &#233;&nbsp;&nbsp;x  <b>bo</b>ld\n  y.</p></article>
<section id="comments"><h3>2 Comments</h3><article class="comment"><p>{LONG}</p></article></section>
<article class="teaser"><p>{OTHER}</p></article></main>
<div class="sidebar"><p>{OTHER}</p></div><footer>&copy; {LONG}</footer>"""
)
MARKED_TEXT = f"The title\n{LONG}\nShort.\nPart\none\ntwo linked\nQuoted\ntwice\nThe <end> é x bold y."


def test_article_between_everything_else():
    assert article_text(MARKED) == MARKED_TEXT
    # Another marker.
    assert article_text(f"<div><p>{OTHER}</p></div><div itemprop='articleBody'><p>{LONG}</p></div><p>{OTHER}</p>") == LONG


def test_page_without_markers():
    bare = page(
        f"""<div><ul><li><a href=1>Home</a></li><li><a href=2>News and more news of the day here</a></li></ul></div>
<div class="banner"><p>{OTHER}</p></div>
<div id="content"><h1>Title</h1><div><p>{LONG}</p></div><p>No.</p><div class="promo-box"><p>{OTHER}</p></div><p>{OTHER}</p></div>
<table><tr><td><a href=3>Left</a></td><td><a href=4>Right</a></td></tr></table>
<div id="respond"><p>{LONG}</p></div>"""
    )
    assert article_text(bare) == f"Title\n{LONG}\nNo.\n{OTHER}"
    assert article_text("<p>only a few words</p>") == "only a few words"
    assert article_text(f"<form id=f><p>{LONG}</p></form>") == LONG


def test_surge_and_dive():
    weights = [0, 5, 0, 0, 0, 0, 40, 60, 0, 3, 0, 0, 0, 0, 90]
    sums = distribution(weights, 3)
    assert sums == [sum(weights[i : i + 3]) for i in range(len(weights))]
    assert surges(sums, 86) == [(4, 10), (12, 15)]
    assert surges(sums, 1000) == [(4, 10)]  # none exceeds it: the highest
    assert surges([0, 0], 5) == [] and surges([], 5) == []


def test_slips_and_edges():
    for nothing in (None, "", " \n", "<nav>x</nav>", "<script>x", "<!-- x", "<title>t</title>", "<style>p</style><p", "<div hidden><p>x</p></div>"):
        assert article_text(nothing) == ""
    assert article_text("<article><p>a<p><b>b<br>c<p>d") == "a\nb\nc\nd"
    assert article_text('<article><a title="x > y">l</a> m <p class="notice">n<div>o</div></article>') == "l m\no"
    assert article_text("<article><p>1 < 2 & 3 &amp; &am &quot;q&quot; &#x41;</p><![CDATA[<p>z</p>]]></article>") == '1 < 2 & 3 & &am "q" A'
    assert article_text("<article>a</p></div>b</span></article>") == "a\nb"
    assert article_text("<article><span class=ad>x<span>y</span>z</span><p>k</p></article>") == "k"
    assert article_text("<ARTICLE><P>Upper</P><SCRIPT>x</SCRIPT></ARTICLE>") == "Upper"


def test_long_and_deep_pages_take_linear_time():
    for part in ("<div>", '<p "', "<p a='>", "<b>x</i>", "<li><p>y", "<script>", "</div>", "<article>", "<", "&", "<!--"):
        spent = []
        for n in (20_000, 80_000):
            start = time.process_time()
            article_text(part * n + "x")
            spent.append(time.process_time() - start)
        assert spent[1] < 10 * spent[0] + 1.5, part


def test_generated_pages_give_back_their_paragraphs():
    rng = random.Random(6)
    for _ in range(60):
        blocks = [" ".join(rng.choices(["word", "längere", "a<b", "x&y", "été."], k=rng.choice([1, 3, 30]))) for _ in range(rng.randint(1, 9))]
        noise = [
            f"<div class='{rng.choice(['ad', 'newsletter-signup', 'share-buttons', 'related-posts'])}'><p>{OTHER}</p></div>",
            f"<aside>{LONG}</aside>",
            "<!-- note --><script>if (a < b) {}</script>",
        ]
        body = "".join(f"<p>{entities.escape(b)}</p>{rng.choice(noise) if rng.random() < 0.4 else ''}" for b in blocks)
        around = f"<nav>{'<a href=x>menu</a>' * 5}</nav>{noise[0]}<article>{body}</article><footer><p>{LONG}</p></footer>"
        assert article_text(page(around)) == "\n".join(blocks)


def test_pages_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, other string"
    rows = [(1, "u", MARKED, "old", 1, "o"), (1, "u", MARKED, "old", 1, "o"), (None, None, None, None, None, None), (3, "v", "", "t", 2, "p")]
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = html_text.with_text(df)
    assert out.columns == ["page_id", "url", "other", "text", "n_chars"]
    got = sorted(out.collect(), key=str)
    assert [(r.page_id, r.other, r.text, r.n_chars) for r in got].count((1, "o", MARKED_TEXT, len(MARKED_TEXT))) == 2
    assert {(r.page_id, r.text, r.n_chars) for r in got if r.page_id != 1} == {(None, "", 0), (3, "", 0)}
    assert html_text.report(df.limit(0)).count() == 0


def test_articles_of_the_pages(spark):
    """All given pages: the blocks of their article element, decoded."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = LLM_QUERIES["op12_html"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        blocks = (" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
