"""The block labeller: leaf blocks as HTML has them, the network against plain loops, held-out pages, and whole tables."""

import math

import numpy as np
import pytest
from docquarry.llm import html_blocks as H

PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><div class="cookie-notice">We use cookies. <button>Accept</button></div>
<script>var x = "<p>no</p>";</script><!-- <p>no</p> --><article><h1>One &lt;title&gt;</h1><p>First
   paragraph with <b>bold</b>&nbsp;and <a href="#">a link</a>.<p><b>Second &amp;amp; last<br><div class="ad">Buy now</div><p>Third</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I don't agree.</p></div></section><form><label>Mail</label><button>Send</button></form>
<footer>&copy; us"""


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    assert texts(PAGE) == [
        "Home", "About us", "We use cookies.", "Accept", "One <title>", "First paragraph with bold and a link.", "Second &amp; last", "Buy now", "Third", "Comments", "I don't agree.", "Mail", "Send", "© us",
    ]
    assert texts(None) == texts("") == texts("<p> &nbsp;</p>") == []
    assert texts("plain") == ["plain"] and texts("a < b and c > d") == ["a < b and c > d"]
    assert texts("<p>one<p>two</p></p>three<br>four") == ["one", "two", "three four"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("a<p title='x > y'>b</p><p title=\"1>2>c") == ["a", "b", "2>c"]
    assert texts("a<!-- never ends <p>b") == ["a"] and texts("a<script>b") == ["a"] and texts("a<b") == ["a"]
    assert texts("<p>x&ampy &#65;&#x42; &bogus; &am</p>") == ["x&y AB &bogus; &am"]
    assert texts("x" * 3_000_000 + "<p>y") == ["x" * 3_000_000, "y"]
    assert texts("<a" * 200_000) == texts("<" + '"<a ' * 100_000) == [] or len(texts("<a" * 200_000)) < 2
    deep = H.blocks("<div class=c>" * 20_000 + "<p>in" + "</div>" * 20_000 + "<p>out")
    assert [b.text for b in deep] == ["in", "out"] and len(deep[0].path) > len(deep[1].path)


def test_the_network_by_plain_loops():
    w, r = H.new_weights(3), np.random.default_rng(1)
    found = [r.normal(size=(n, H.PATH_DIM + H.WORD_DIM + H.PLAIN)).astype(np.float32) for n in (1, 7, 3, 40)]
    sig = lambda x: 1 / (1 + math.exp(-x))
    for x, got in zip(found, H.scores(found, w), strict=True):
        total = [float(w["bias_out"])] * len(x)
        for way, steps in (("on", range(len(x))), ("back", range(len(x) - 1, -1, -1))):
            h, c = [0.0] * H.CELL, [0.0] * H.CELL
            for t in steps:
                z = [float(w[f"bias_{way}"][j] + sum(x[t][i] * w[f"in_{way}"][i, j] for i in range(len(x[t]))) + sum(h[i] * w[f"own_{way}"][i, j] for i in range(H.CELL))) for j in range(4 * H.CELL)]
                gate = lambda k, j: sig(z[k * H.CELL + j])
                c = [gate(1, j) * c[j] + gate(0, j) * math.tanh(z[3 * H.CELL + j]) for j in range(H.CELL)]
                h = [gate(2, j) * math.tanh(c[j]) for j in range(H.CELL)]
                total[t] += sum(h[j] * w[f"out_{way}"][j] for j in range(H.CELL))
        assert np.allclose(got, total, atol=1e-4)


def test_the_gradient_by_differences():
    data = [(H.Inputs(b), y) for b, y in H.layouts(9, 3)]
    w = {k: v.astype(np.float64) for k, v in H.new_weights(2).items()}
    xs, ys, r = [x for x, _ in data], [y for _, y in data], np.random.default_rng(0)
    _, got = H.gradient(xs, ys, w)
    for name in w:
        flat = got[name].reshape(-1)
        for at in (int(np.argmax(np.abs(flat))), int(r.integers(flat.size))):
            step = 1e-3
            sides = []
            for s in (step, -step):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name].reshape(-1)[at] += s
                sides.append(H.gradient(xs, ys, moved)[0])
            assert abs((sides[0] - sides[1]) / (2 * step) - flat[at]) < 2e-3


def test_held_out_pages():
    w = H.trained()
    data = list(H.layouts(77, 300))
    right = [(z > 0) == (y > 0) for z, (_, y) in zip(H.scores([H.Inputs(b).vectors(w) for b, _ in data], w), data, strict=True)]
    assert np.concatenate(right).mean() > 0.99 and np.mean([x.all() for x in right]) > 0.9


def test_a_page_with_all_kinds_of_blocks():
    (page,) = H.labelled([PAGE], H.trained())
    assert [t for t, p in page if p > H.SURE] == ["One <title>", "First paragraph with bold and a link.", "Second &amp; last", "Third"]


def test_whole_table(spark):
    """Every page's text is that of its article element, found by a plain cut of the page's source."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in cut if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize("split", [1, 3])
def test_edges(spark, split):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", PAGE, 0), (4, "u", PAGE, 0), (4, "u", PAGE, 0), (5, "u", "<nav>a</nav>", 0), (6, "u", "<article>" + "<p>long text here.</p>" * 9000 + "</article>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(split)
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in H.extract_text(df).collect()), key=str)
    body = "One <title>\n\nFirst paragraph with bold and a link.\n\nSecond &amp; last\n\nThird"
    long = "\n\n".join(["long text here."] * 9000)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", body, len(body)), (4, "u", body, len(body)), (4, "u", body, len(body)), (5, "u", "", 0), (6, "u", long, len(long))], key=str)
    assert H.extract_text(df.limit(0)).count() == 0
    named = df.selectExpr("page_id as k", "url as v", "html as h", "page_id as html")
    assert {len(r["blocks"]) for r in H.label_blocks(named, "k", "v", "h").where("page_id = 4").collect()} == {14}
