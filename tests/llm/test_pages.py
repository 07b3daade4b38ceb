"""Main text of pages: element roles, differencing, edge cases, the whole table."""

import html
import re

import numpy as np
import pytest

from reviewloom.llm import pages, queries

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"


@pytest.fixture
def texts(spark):
    def run(*rows, schema=SCHEMA, **options):
        found = pages.main_texts(spark.createDataFrame(list(rows), schema), **options).collect()
        return {r["page_id"]: r["text"] for r in found}

    return run


def test_only_the_article_is_kept(texts):
    source = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>note</p> -->
    <div class="cookie-notice">accept</div><aside>side</aside>
    <article><h1>Title</h1><p>One &amp; <b>two</b>
      lines<br>after</p><div class="ad-slot">buy <div>now</div></div><form><input value=1>send</form>
    <p>caf&#233;</p><section id="comments"><p>first!</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert texts((1, "http://a/b", source)) == {1: "Title\nOne & two lines\nafter\ncafé"}


def test_unclosed_elements(texts):
    source = "<body><article><p><b>Head<br><p>x < y<p>end</article><footer>f"
    assert texts((1, "http://a/b", source)) == {1: "Head\nx < y\nend"}


def test_a_menu_that_is_never_closed_ends_at_the_article(texts):
    assert texts((1, "http://a/b", "<body><nav><a>menu</a><article><p>text</p></article>")) == {1: "text"}
    closed = "<article><p>text</p></article><aside><p>side</p><article><p>teaser</p></article></aside>"
    assert texts((1, "http://a/b", closed)) == {1: "text"}


def test_parts_of_the_article_stay(texts):
    source = ("<header class='site-header'>site</header><article><div class='header'>bar</div>"
              "<h2 class='section-header'>Part</h2><figure><img src=x><figcaption>a view</figcaption></figure>"
              "<section class='discussion'><p>we discuss</p></section><p class='related-work'>others</p></article>")
    assert texts((1, "http://a/b", source)) == {1: "Part\na view\nwe discuss\nothers"}


def test_shared_lines_of_unmarked_pages_go(texts):
    def page(*lines):
        return "".join(f"<div>{line}</div>" for line in lines)

    got = texts(
        (1, "http://a/x/1", page("Site", "first story of the day", "Imprint")),
        (2, "http://a/x/2", page("Site", "another story of the day", "Imprint")),
        (3, "http://b/x/2", page("Site", "on another host", "Imprint")))
    assert got == {1: "first story of the day", 2: "another story of the day", 3: "Site\non another host\nImprint"}


def test_copies_and_articles_keep_their_lines(texts):
    same = "<div>one</div><div>two</div>"
    assert texts((1, "http://a/1", same), (2, "http://a/2", same)) == {1: "one\ntwo", 2: "one\ntwo"}
    marked = "<article><p>Site</p><p>%s</p></article>"
    assert texts((1, "http://a/1", marked % "long first text"), (2, "http://a/2", marked % "second long text")) == {
        1: "Site\nlong first text", 2: "Site\nsecond long text"}


def test_edge_cases(texts):
    got = texts((1, None, "<p>a</p>"), (2, "http://a/b", None), (3, "", ""), (None, "http://a/b", "<p>z</p>"),
                (4, "http://a/b", "<"), (5, "http://a/b", "<p>" + "long word " * 200_000), (6, "x", "a<!--"))
    assert got[1] == "a" and got[2] == "" and got[3] == "" and got[None] == "z" and got[6] == "a"
    assert len(got[5]) == 2_000_000 - 1
    assert texts(schema=SCHEMA) == {}
    assert texts((1, "http://a/b", "<p>a</p>", "extra"), schema=SCHEMA + ", text string") == {1: "a"}


def test_repeated_rows_stay(spark):
    rows = [(1, "http://a/b", "<p>a</p>")] * 3
    found = pages.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(1, "http://a/b", "a", 1)] * 3


def test_shared_lines_is_a_longest_common_subsequence():
    a, b = list("abcbdab"), list("bdcaba")
    assert len(pages.shared_lines(a, b)) == 4
    assert pages.shared_lines(list("xay"), list("xby")) == [0, 2]
    assert pages.shared_lines([], ["a"]) == []


def test_alignment_in_a_small_table_is_as_long():
    def longest(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, one in enumerate(x, 1):
            for j, other in enumerate(y, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if one == other else max(table[i - 1][j], table[i][j - 1])
        return table[-1][-1]

    draw = np.random.default_rng(4)
    for _ in range(200):
        x, y = (draw.integers(0, 5, draw.integers(0, 30)) for _ in "xy")
        for cells in (4, 40, 10_000):
            rows = pages._common_rows(x, y, cells)
            assert rows == sorted(set(rows)) and len(rows) == longest(x, y)
            rest = iter(y.tolist())
            assert all(value in rest for value in x[rows].tolist())  # a subsequence of y


def test_whole_table(spark):
    """Brute force: the article of each page, all tags taken off."""
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries.QUERIES["op1_main_text"](spark, SF_DIR).collect()
    assert sorted(r["page_id"] for r in found) == sorted(sources)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", sources[r["page_id"]], re.S)[1]
        words = html.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        assert r["text"].split() == words
        assert r["n_chars"] == len(r["text"])
