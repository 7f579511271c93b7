import random
import re
import time
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage_jobs.llm import html_text as H


class Article(HTMLParser):
    """Plain reading of the blocks inside <article>."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.now = False, [], []

    def end(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "h2", "li", "div"):
            self.end()
        if tag == "br":
            self.now.append(" ")
        self.inside = self.inside or tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "li", "div"):
            self.end()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_whole_table_against_plain_reading(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = {r.page_id: r for r in H.extracted(pages).collect()}
    for page in pages.collect():
        plain = Article()
        plain.feed(page.html)
        plain.end()
        assert got[page.page_id].text == "\n".join(plain.blocks) and got[page.page_id].n_chars == len(got[page.page_id].text)


def test_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(*sorted(rng.sample(range(n), 2)), rng.uniform(0, 2)) for _ in range(rng.randrange(0, 3 * n))] if n > 1 else []

        def cost(sides):
            return sum(-min(s, 0) if x else max(s, 0) for s, x in zip(scores, sides, strict=True)) + sum(w for a, b, w in edges if sides[a] != sides[b])

        assert cost(H.minimum_cut(scores, edges)) == pytest.approx(min(map(cost, product((False, True), repeat=n))))


PAGE = """<html><body class="with-sidebar"><header><h1>Site</h1><ul class=menu><li><a href=x>Home</a><li><a href=y>News</a></ul></header>
<div id="cookie-notice">We use cookies to make this site better for you. Agree?</div>
<div class="content"><h2>A &amp; B</h2><p>First   paragraph of the text, which is long enough&nbsp;to be read.<p>Short.
<form><label>Your mail</label><input></form><blockquote>Quoted words in the text.</blockquote><script>if (a < b) { "</p>" }</script></div>
<section class="comments"><article class="comment"><p>I liked this very much, thank you for writing it down for all of us here.</p></article></section>
<aside>More</aside><footer>&copy; us"""


def test_mixed_page():
    assert H.main_text(PAGE).split("\n") == ["A & B", "First paragraph of the text, which is long enough to be read.", "Short.", "Quoted words in the text."]


def test_headers_of_articles_stay():
    page = '<div class="page-header">Site</div><div class="article-header"><h1>Title here</h1></div><article><header><h2>Second</h2></header><p>Words.</p><button>Share this</button></article>'
    assert H.main_text(page).split("\n") == ["Title here", "Second", "Words."]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<article", "<article><p class='x", "&#1114112;&bogus;<!--", "<p>" * 3000, "<b a='" * 2000, "</div>" * 50])
def test_broken_pages_do_not_fail(page):
    assert isinstance(H.main_text(page), str)


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>a b.</p></article>"), (1, None, None), (2, "v", "<main>" + "<p>word word.</p>" * 20_000 + "</main>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = {(r.page_id, r.url): r for r in H.extracted(pages).collect()}
    assert rows[None, "u"].text == "a b." and rows[1, None].text == "" and rows[2, "v"].n_chars == 20_000 * 11 - 1
    assert H.extracted(pages).count() == 4 and H.extracted(pages.limit(0)).count() == 0


def bare(page):
    """The page without article, nav and footer elements and without class names."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", page))


def test_cut_matters_on_pages_without_marks(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    x = np.concatenate([[H.features(b, e[b.at]) for b in blocks] for blocks, e in map(H.blocks_of, pages)])
    weights = H.fitted(x)
    blocks = changed = right = 0
    for page in pages:
        own, elements = H.blocks_of(bare(page))
        leaning = H.leanings(own, elements, weights)
        cut = H.minimum_cut(leaning, H.ties(own, elements))
        marked, of = H.blocks_of(page)
        blocks, changed = blocks + len(own), changed + sum((s > 0) != c for s, c in zip(leaning, cut, strict=True))
        right += sum((of[b.at].home == 1) == c for b, c in zip(marked, cut, strict=True))
    assert changed > 0 and right / blocks > 0.97, (changed, right, blocks)


def test_short_blocks_follow_their_neighbours():
    long = "A long sentence of the text, which goes on, and on, and says one thing after another, until its end." + " And so on." * 40
    page = f"<div><div>Sign up today</div><div><div>{long}</div><div>So</div><div>{long}</div></div><div><a href=1>one</a> <a href=2>two</a></div></div>"
    blocks, elements = H.blocks_of(page)
    assert [s > 0 for s in H.leanings(blocks, elements)] == [False, True, False, True, False]
    assert H.main_text(page).split("\n") == [long, "So", long]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div class='page has-sidebar'><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Some words, and more.</p></article><div class=sidebar>More</div></div>", ["Title", "Some words, and more."]),
        ("<form><div class=menu><a>Home</a></div><div class='with-comments'><article class='post has-comments'><p>Some words, and more of it.</p><p>Yes.</p></article></div><div class=comments><article><p>I like this text very much.</p></article></div></form>", ["Some words, and more of it.", "Yes."]),
        ("<article><p>Long words of the text, which goes on.</p><p class='related-work'>Some related work, which is cited in the text here.</p><p>The end of the article here.</p><p class=advert>Buy now, it is cheap.</p></article>", ["Long words of the text, which goes on.", "Some related work, which is cited in the text here.", "The end of the article here."]),
    ],
)
def test_marks_are_evidence(page, want):
    assert H.main_text(page).split("\n") == want


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 40_000 + "word word. " + "</section>" * 40_000 + "<li>" * 5000
    begun = time.time()
    assert H.main_text(deep) is not None and H.main_text("<p>Word word word, word word word.</p><div><a>link</a></div>" * 20_000) is not None
    assert time.time() - begun < 60


def test_fit_without_both_kinds_is_fixed(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert (H.fit(none) == H.FIXED).all() and (H.fitted(np.zeros((3, H.N_FEATURES))) == H.FIXED).all()


@pytest.mark.parametrize("between", ['<svg width="1"/>', '<svg width="1">', "<svg><text>no</text></svg>", '<object data="x">', "<object data='x'></object>", "<select>", "<select><option>no</select>"])
def test_nothing_is_lost_after_elements_without_end(between):
    said = [f"{n} paragraph of the article, which says something at some length and ends." for n in ("First", "Second", "Third")]
    page = f"<article><p>{said[0]}</p>{between}<p>{said[1]}</p><p>{said[2]}</p></article>"
    assert H.main_text(page) == "\n".join(said)


def test_noscript_and_template_are_elements():
    article = "<p>" + "A sentence of the article that is long enough to count. " * 3 + "</p>"
    assert "sentence" in H.main_text(f"<noscript><article>{article}</article></noscript>")
    assert H.main_text(f"<article>{article}<noscript>Please enable scripts</noscript></article>").count("enable") == 0


@pytest.mark.parametrize("part", ["<svg ", "<svg>", "<select>", "<script ", "<p><svg>", "<template>", "<!", "<object data='", '<a title="'])
def test_a_megabyte_of_unclosed_tags_is_linear(part):
    begun = time.process_time()
    H.blocks_of(part * (1_000_000 // len(part)))
    assert time.process_time() - begun < 2


def test_a_large_page_leaves_the_others_in_the_fit(spark):
    page = "<article>" + "<p>A sentence of the article, which is long enough and ends.</p>" * 5 + "</article><nav><a href=x>Home</a><p>More</p></nav>"
    rows = [(i, f"u{i}", page) for i in range(20)]
    small = H.fit(spark.createDataFrame(rows, "page_id long, url string, html string"), max_blocks=300)
    large = [(i + 100, f"v{i}", page * 100) for i in range(5)]
    mixed = H.fit(spark.createDataFrame(rows + large, "page_id long, url string, html string"), max_blocks=300)
    assert not np.allclose(mixed, H.FIXED) and np.allclose(mixed, small)
