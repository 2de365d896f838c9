import re
import sys
from html import unescape
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from churnspark.llm import html, queries, recurrent
from churnspark.llm.blocks import parse
from churnspark.llm.layouts import Layouts
from churnspark.llm.tables import table

POOL = "alpha beta gamma delta one two three word text other thing more".split()


@pytest.fixture(scope="module")
def model():
    return html.fit(POOL)


@pytest.mark.parametrize("page, texts", [
    ("", []), (None, []), ("plain  text", ["plain text"]), ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p>one <b>bold</b>word &amp; &lt;x&gt;&nbsp;y", ["one boldword & <x> y"]), ("a<br>b", ["a b"]),
    ("<script>var t='</p>';</script><style>p{}</style>x<!-- <p>no -->y", ["xy"]), ("<title>t</title><ul><li>a<li>b</ul>", ["a", "b"]),
    ("<script>never ends <p>a", []), ("<!-- never ends <p>a", []), ("a < b <3 c", ["a < b <3 c"]), ("</div>x</p>", ["x"]),
    ('<a href="x>y">z</a><a title="un>closed>w', ['zclosed>w']), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("&#x41;&#66;&eacute;&bogus;", ["ABé&bogus;"]),
])
def test_blocks(page, texts):
    assert [b.text for b in parse(page)] == texts


def test_path_names_classes():
    block = parse('<div class="Cookie-Notice wide"><section id=main><p>x</section></div>')[0]
    assert block.path == ["div", ".cookie-notice", ".cookie", ".notice", ".wide", "section", ".main", "p"]


def test_gradients_like_differences():
    rng = np.random.default_rng(1)
    pages = [html.labelled(Layouts(POOL, k).page()) for k in range(4)]
    pages = [p for p in pages if p[0]]
    rows, main = html.rows_of([b for b, _ in pages]), np.array([m for _, ms in pages for m in ms], float)
    model = html.Labeller()

    def loss():
        p = model.chances(rows)
        return -(main * np.log(p) + (1 - main) * np.log(1 - p)).mean()

    grads = model.learn(rows, main)
    for name, g in grads.items():
        flat = model.w[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(g.reshape(-1)), 3):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-5 == pytest.approx(g.reshape(-1)[k], rel=1e-3, abs=1e-7)


def test_steps_reach_every_row():
    sizes = np.array([3, 1, 4])
    for reverse in (False, True):
        assert sorted(np.concatenate(recurrent.steps(sizes, reverse)).tolist()) == list(range(8))


def test_unseen_layouts(model):
    pages = [html.labelled(Layouts(POOL, 77).page()) for _ in range(1)]
    maker = Layouts(POOL, 77)
    pages = [p for p in (html.labelled(maker.page()) for _ in range(300)) if p[0]]
    chances = model.chances(html.rows_of([b for b, _ in pages]))
    assert ((chances >= 0.5) == np.array([m for _, ms in pages for m in ms])).mean() > 0.97


def test_common_furniture_goes(model):
    page = (
        "<html><head><title>T</title></head><body><div class='cookie-notice'><p>We use cookies.</p></div><header><h1>Site</h1></header>"
        "<nav><a href=/a>Home</a></nav><main><article><h1>Title &amp; more</h1><p>One <b>bold</b>word.</p><div class=ad>Buy now</div>"
        "<p>Two&nbsp;three</p><ul><li>a<li>b</ul></article><section id=comments><h2>Comments</h2><div class=comment><p>No</p></div></section>"
        "</main><aside class=sidebar><p>Popular</p></aside><form><label>Name</label><button>Send</button></form><footer>© x</footer></body></html>"
    )
    assert model.main_text([page]) == ["Title & more One boldword. Two three a b"]


def test_query_gives_the_articles(spark, sf):
    """The pages of the table have one article each; the labeller does not know that."""
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = queries.op2_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    right = 0
    for r in rows:
        page = pages[r.page_id].html
        article = page[page.index("<article>"):page.index("</article>")]
        want = " ".join(unescape(re.sub(r"</?(?:b|i|em|strong|span)>", "", re.sub(r"<(?!/?(?:b|i|em|strong|span)>)[^>]*>", " ", article))).split())
        right += r.text == want
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert right >= 0.99 * len(rows)


def test_edge_rows(spark, model):
    pages = spark.createDataFrame(
        [(1, None, "u", "x"), (2, "", None, "x"), (3, "<nav><a>x</a></nav>", "u", "x"), (4, "<article>" + "<p>long text here</p>" * 5000 + "</article>", "u", "x"),
         (None, "<article><p>a</p></article>", "u", None), (3, "<nav><a>x</a></nav>", "u", "x")],
        "page_id long, html string, url string, text string",
    ).withColumnRenamed("url", "a.b")
    rows = html.extract(pages, model).collect()
    assert len(rows) == 6
    by_id = {r.page_id: r.text for r in rows}
    assert by_id[1] == by_id[2] == "" and by_id[4] == " ".join(["long text here"] * 5000)
    assert html.extract(pages.limit(0), model).collect() == []
    assert html.train(pages.limit(0)).main_text([None, ""]) == ["", ""]


def test_deep_pages_cost_what_they_open():
    """100,000 open elements: shared paths, one step per depth; stray and crossing end tags cost nothing."""
    import time

    start = time.perf_counter()
    page = "".join(f"<div class='k{k}'>word <b>" for k in range(50_000)) + "</i></b>" * 50_000
    found = parse(page)
    rows = html.rows_of([found])
    assert len(found) == 50_000 and len(rows.above) == 100_000 - 1
    assert html.Labeller(1).chances(rows).shape == (50_000,)
    assert time.perf_counter() - start < 60
    assert found[2].path == ["div", ".k0", "b", "div", ".k1", "b", "div", ".k2", "b"]


def test_shared_paths_sum_like_whole_paths():
    """The bag of a block is made of the distinct names on its path and the last two once more."""
    page = "<div class='a b'><section class=a>one<p class=c>two</section>three<a href=x><div class='d'>four</div></a></div>five"
    found = parse(page)
    rows = html.rows_of([found, parse("<ul><li>six<li>seven</ul>")])
    weights = np.random.default_rng(1).normal(size=(html.PATH_BUCKETS, 3))
    for block, bag in zip([*found, *parse("<ul><li>six<li>seven</ul>")], html._path_bags(rows, weights)):
        names = [*dict.fromkeys(block.path), *("last " + n for n in block.path[-2:])]
        right = sum((weights[html._hash(n) % html.PATH_BUCKETS] for n in names), np.zeros(3)) / max(1, len(names)) ** 0.5
        np.testing.assert_allclose(bag, right, atol=1e-12)
