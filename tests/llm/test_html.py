import html as entities
import time

import numpy as np
import pytest

from motorlake.llm.html_blocks import FEATURES, blocks, extract, features, kept, main_text, train, trained
from motorlake.llm.html_labelled import labelled_pages

TREE = trained()
LONG = "This paragraph has a good number of words so that it reads like the prose of an article and not like a label."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Te.</p></article><footer>&copy; us</footer>", f"Title\n{LONG}\nTe."),
        (f"<script>var t='</p>';</script><article><p>{LONG}</p><!-- <p>no</p> --><style>p{{}}</style><p>a&amp;b &lt;c&gt;</p></article>", f"{LONG}\na&b <c>"),
        (f"<div class='sidebar'><p>{LONG}</p></div><main><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form></main>", LONG),
        (f"<article><p>{LONG}</p><section class=comments><p>{LONG} said a reader</p></section></article>", LONG),
        (f"<div class=\"ad\">{LONG}</div><article><p><b>{LONG}<br><p>Second  \n one.</p></article>", f"{LONG}\nSecond one."),
        (f"<article><p>{LONG}</p><p>cut off he", f"{LONG}\ncut off he"),
        (f"<article><p>{LONG}</p><p>1 < 2 & 3</p></article>", f"{LONG}\n1 < 2 & 3"),
        (f"<article class='social-science'><p>{LONG}</p></article>", LONG),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<article><p>{LONG}</p><p class='related-topic'>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<article><h1>T</h1><p class=byline>By A. B.</p><p>{LONG}</p><address>Long Road 4</address></article>", f"T\nBy A. B.\n{LONG}\nLong Road 4"),
        (f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", f"{LONG}\nso x=2 holds"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>One source</a><li><a href=2>Another</a></ul></article>", f"{LONG}\nOne source\nAnother"),
        (f"<main><article><p>{LONG}</p></article><div class=comments><article><p>{LONG} {LONG}</p></article></div></main>", LONG),
        (f"<article><p>{LONG} {LONG}</p></article><article><p>I agree with that.</p></article>", f"{LONG} {LONG}"),
        (f"<div class='page has-sidebar'><nav><a href=x>Home</a></nav><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='content header-fixed'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>{LONG}</div>", f"{LONG}\n{LONG}\n{LONG}"),
        (f"<article aria-label='Social policy'><p>{LONG}</p></article>", LONG),
        (f"<form id=aspnetForm><div class=menu><a href=1>Home</a></div><article><p>{LONG}</p></article></form>", LONG),
        (f"<form><div class=menu><a href=1>Home</a></div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></form>", f"{LONG}\n{LONG}\n{LONG}"),
        (f"<nav>{LONG}</nav><div class=ad>Zu und. Der.</div><article><h1>Title</h1><p>{LONG}</p></article><footer>&copy; x &middot; {LONG}</footer>", f"Title\n{LONG}"),
        (f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"{LONG}\nShort.\n{LONG}"),
        (f"<article><p>{LONG}</p><div style='display:none'>{LONG}</div><p hidden>{LONG}</p></article>", LONG),
        ("", ""),
        ("<p", ""),
        ("<nav><a href=x>only a menu</a></nav>", ""),
    ],
)
def test_pages(page, text):
    assert main_text(page, TREE) == text


def test_blocks_count_links():
    found = blocks("<p>one <a href=x>two three</a> four</p><p><a href=y>five</a></p>")
    assert [(b.words, b.link_words) for b in found] == [(4, 2), (1, 1)]


def test_rows(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        inside = raw[r["page_id"]].partition("<article>")[2].partition("</article>")[0].partition("<footer")[0]
        for tag in ("h1", "p", "b", "br", "/h1", "/p", "/b"):
            inside = inside.replace(f"<{tag}>", "\n" if tag not in ("b", "/b") else "")
        want = "\n".join(x for x in (" ".join(entities.unescape(line).split()) for line in inside.replace("\r", " ").split("\n")) if x)
        assert " ".join(r["text"].split()) == " ".join(want.split())


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 50_000), (3, "u", "<p>" + "word " * 50_000), (None, "u", "x")], "page_id bigint, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in extract(pages).collect())
    assert got[1:] == [(1, 0), (2, 0), (3, 249_999), (3, 249_999)]
    assert extract(pages.limit(0)).count() == 0


def test_labelled_table():
    """Each page has a label for each block, and the tree has learned nearly all of them."""
    found = [(blocks(page), keep) for page, keep in labelled_pages()]
    assert all(len(b) == len(keep) for b, keep in found) and sum(len(keep) for _, keep in found) > 180
    right = [kept(TREE, row) == k for b, keep in found for row, k in zip(features(b), keep)]
    assert sum(right) > 0.93 * len(right)


def test_tree_on_pages_it_has_not_seen():
    """Left-one-out: each page of the table by a tree trained on the others."""
    found = [(features(blocks(page)), np.array(keep)) for page, keep in labelled_pages()]
    right = 0
    for i, (x, y) in enumerate(found):
        rest = [f for j, f in enumerate(found) if j != i]
        tree = train(np.concatenate([a for a, _ in rest]), np.concatenate([b for _, b in rest]))
        right += sum(kept(tree, row) == k for row, k in zip(x, y))
    assert right > 0.85 * sum(len(y) for _, y in found)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "own", 7)], "page_id bigint, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extract(pages).collect()] == [(1, "u", LONG, len(LONG))]


@pytest.mark.parametrize("page", ['<div class="menu item">word ' * 20_000, "<div>word </b></section>" * 20_000, "<p>word<li>" * 20_000], ids=["nested", "unopened", "unclosed"])
def test_deep_nesting_takes_linear_time(page):
    began = time.perf_counter()
    found = blocks(page)
    assert len(features(found)) == len(found) >= 20_000
    assert time.perf_counter() - began < 10


def test_elements_hand_down_what_they_say():
    page = '<div class="menu"><p>one</p><form><p>two</p></form></div><article><h1>three</h1><div class="related"><p>four five six</p></div></article><p>seven</p>'
    found = blocks(page)
    rows = {b.text: dict(zip(FEATURES, f, strict=True)) for b, f in zip(found, features(found).tolist(), strict=True)}
    assert [rows[t]["in_content"] for t in ("one", "three", "four five six", "seven")] == [0, 1, 1, 0]
    assert [rows[t]["marks"] for t in ("one", "two", "four five six", "seven")] == [2, 2, 2, 0]
