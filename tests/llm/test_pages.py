from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest

from kestrelog.llm import alignment, blocks, common, pages


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(600):
        k = rng.choice([1, 2, 4, 30])
        a, b = (np.array([rng.randrange(k) for _ in range(rng.randrange(40))], np.int64) for _ in range(2))
        hit = alignment.shared(a, b)
        rest = iter(b.tolist())
        assert all(any(x == y for y in rest) for x in a[hit].tolist())  # a subsequence of b
        assert hit.sum() == slow_lcs(a.tolist(), b.tolist())


def test_alignment_of_long_lists():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50, 6_000)
    b = np.delete(a, rng.choice(6_000, 600, replace=False))
    assert alignment.shared(a, b).sum() == 5_400
    assert alignment.shared(np.arange(3_000), np.arange(3_000)[::-1]).sum() == 1


PAGES = [
    ("<p>a &amp; b&lt;c &nbsp; d<p>two<br>lines <b>bold</b>er", [("a & b<c d", 0), ("two lines bolder", 0)]),
    ("<nav><ul><li>x<li>y</ul></nav><article><h1>T</h1><p>one<p>two</article>tail", [("x", 3), ("y", 3), ("T", 2), ("one", 2), ("two", 2), ("tail", 0)]),
    ("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no --><p>yes</p><title>no</title>", [("yes", 0)]),
    ("<main><p>m<div class='sidebar-left'><p>s</div>n</main>", [("m", 1), ("s", 3), ("n", 1)]),
    ("<article><header><h1>Head</h1>by me</header>x<footer>f</footer><section id=comments><article>c</article></section></article>", [("Head", 2), ("by me", 3), ("x", 2), ("f", 3), ("c", 3)]),
    ("<article><p>x <span class=ad>buy</span> y</p><article>reader</article></article>", [("x y", 2), ("buy", 3), ("reader", 3)]),
    ("<div itemprop='articleBody'>b<form>f<input value='>'>g</form></div><div hidden>h</div>", [("b", 2), ("fg", 3), ("h", 3)]),
    ("a < b and 3<4 <p title=\"x>y\">q</p></div>r<di", [("a < b and 3<4", 0), ("q", 0), ("r", 0)]),
    ("<p>cut &am<p>&amp", [("cut &am", 0), ("&", 0)]),
    ("<table><tr><td>1<td>2<tr><td>3</table><p title=\"never closed>q</p>", [("1", 0), ("2", 0), ("3", 0), ("q", 0)]),
    ("<header>top</header><div class=download>kept</div><div class='cookie-notice'>no</div><div id=adBox>no</div>", [("top", 3), ("kept", 0), ("no", 3), ("no", 3)]),
    ("", []),
    ("  \n ", []),
    ("<article></article>", []),
]


@pytest.mark.parametrize("page,expected", PAGES)
def test_lines_and_zones(page, expected):
    assert blocks.lines(page) == expected


def test_broken_and_long_pages_take_linear_time():
    for page in ('<a "' * 60_000, "<" * 200_000, "<p><b>" * 30_000, "&" * 100_000, "<div>" * 3_000 + "x" + "</div>" * 3_000, "<!--" * 50_000, "<p title='" * 50_000, "<b>" * 50_000 + "</b>" * 50_000, "<i>" * 50_000 + "<p>x" * 5_000):
        began = time.process_time()
        blocks.lines(page)
        assert time.process_time() - began < 5
    assert len(blocks.lines("<p>word " * 100_000)) == 100_000


def template(body, k):
    return f"<div>Menu {k % 2}</div><div>Home</div><p>Buy now</p>{body}<div>All rights kept</div>"


def test_neighbours_lose_shared_lines_and_articles_keep_them(spark):
    rows = [
        (1, "http://h.example/a/1", template("<p>First story told at length here", 0)),
        (2, "http://h.example/a/2", template("<p>Another tale that is quite its own", 1)),
        (3, "http://h.example/b/9", template("<p>Third and last of them, far away", 0)),
        (4, "http://h.example/a/2?x=1", template("<p>Another tale that is quite its own", 1)),  # a copy of 2
        (5, "http://other.example/a/1", template("<p>Alone on its host", 0)),
        (6, None, "<p>no address"),
        (7, "http://m.example/1", "<p>Top</p><article><p>Shared passage<p>Mine</article>"),
        (8, "http://m.example/2", "<p>Top</p><article><p>Shared passage<p>Yours</article>"),
        (9, "http://m.example/3", None),
        (None, "http://c.example/1", "<p>A long text of which nearly all is the same on both pages of this host, word by word, to the end.<p>1"),
        (None, "http://c.example/2", "<p>A long text of which nearly all is the same on both pages of this host, word by word, to the end.<p>2"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, row int")
    got = {(r.page_id, r.url): r for r in pages.page_texts(frame.repartition(4)).collect()}
    text = {k[0]: r.text for k, r in got.items() if k[0]}
    assert text[1] == "Menu 0\nFirst story told at length here"
    assert text[2] == text[4] == "Menu 1\nAnother tale that is quite its own"
    assert text[3] == "Menu 0\nThird and last of them, far away"
    assert text[5] == "Menu 0\nHome\nBuy now\nAlone on its host\nAll rights kept"
    assert (text[6], text[7], text[8], text[9]) == ("no address", "Shared passage\nMine", "Shared passage\nYours", "")
    assert [got[None, f"http://c.example/{k}"].text[-2:] for k in (1, 2)] == ["\n1", "\n2"]
    assert (got[1, rows[0][1]].partner_id, got[3, rows[2][1]].partner_id, got[4, rows[3][1]].n_shared) == (2, 2, 3)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert pages.page_texts(frame.limit(0)).count() == 0


def test_hot_page_with_many_copies(spark):
    rows = [(i, f"http://h.example/x/{i}", template("<p>The same story on every page", 0)) for i in range(300)]
    rows += [(1_000 + i, f"http://h.example/y/{i}", template(f"<p>Story of number {i}", 0)) for i in range(40)]
    got = {r.page_id: r.text for r in pages.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 340
    assert {got[i] for i in range(300)} == {"The same story on every page"}
    assert all(got[1_000 + i] == f"Story of number {i}" for i in range(40))


def test_given_pages_give_their_articles(spark):
    given = {r.page_id: r.html for r in common.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    for r in pages.op12_html_text(spark, "/root/testdata/sf0.01").collect():
        (article,) = re.findall(r"<article>(.*?)</article>", given[r.page_id], re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)
