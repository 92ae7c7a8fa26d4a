import itertools
import time

import numpy as np
import pytest

from latchgraph.llm import op5_html_extraction as op
from latchgraph.llm._pages import labelled_pages

WORDS = "Some words stand in this paragraph, and more of them follow here. They make a second sentence, too. "


def page(inside: str) -> str:
    return f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul></nav>{inside}<footer>&copy; someone &middot; all rights</footer></body></html>"


@pytest.fixture(scope="module")
def model():
    return op.trained()


def text(html, model):
    return op.main_texts([html], model)[0]


def test_article(model):
    html = page(f"<script>var a='</p>'</script><div class='ad'>Buy this now.</div><article><h1>A title</h1><p><b>{WORDS}<br><p>{WORDS} a &lt;b&gt; &amp;amp;</p>\n<p>  x \n y </p></article>")
    assert text(html, model) == "\n".join(["A title", WORDS.strip(), WORDS.strip() + " a <b> &amp;", "x y"])


def test_parts_that_go(model):
    extra = f"<aside class='sidebar'><h3>More</h3><p>Read this as well.</p></aside><div class='cookie notice'>We use cookies.</div><form><label>Name</label><button>Go</button></form><section id='comments'><h3>Comments</h3><div class='comment'><p>I think so.</p></div></section>"
    got = text(page(f"<article><h1>A title</h1><p>{WORDS}</p><p>{WORDS}</p></article>{extra}"), model)
    assert got == "\n".join(["A title", WORDS.strip(), WORDS.strip()])


def test_broken(model):
    cut = page(f"<article><h1>A title</h1><p>{WORDS}</p><p>{WORDS}")[: -len("</footer></body></html>")]
    assert text(cut, model).startswith("A title\n" + WORDS.strip())
    for bad in ("", "<", "<p", "</", "<a href='x", "<!-- open", "<script>x", "<p>" * 3000 + "deep", "&#0;&#xD800;&bad;", "<![CDATA[x]]>", "\x00<p>\x01"):
        assert isinstance(text(bad, model), str)
    assert text(None, model) == ""


def test_decoding_is_consistent(model):
    for html, _ in labelled_pages(40, 5):
        p = op.Page(html)
        chosen = p.decode(model[1].scores(p.features(model[0])))
        for i, node in enumerate(p.nodes[1:], 1):
            assert not chosen[i] or chosen[p.index[id(node.parent)]]


def test_held_out_pages(model):
    right = total = 0
    for html, mark in labelled_pages(120, 31):
        p = op.Page(html)
        chosen = p.decode(model[1].scores(p.features(model[0])))
        for node, c, own in zip(p.nodes, chosen, p.own):
            if own:
                total += 1
                right += c == any(isinstance(x, str) and mark in x for x in node.items)
    assert right / total > 0.97


def test_rows(spark, model):
    rows = [(1, "u", page(f"<article><h1>T</h1><p>{WORDS}</p></article>"), "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", page(f"<article><p>{WORDS * 400}</p></article>"), "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"]): r for r in op.extract(frame).collect()}
    assert op.extract(frame).count() == 5
    assert got[1]["text"] == "T\n" + WORDS.strip() and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["n_chars"] == len((WORDS * 400).strip())
    assert op.extract(frame.limit(0)).count() == 0


def test_deep_and_broken_nesting_takes_linear_time():
    for html in ("<div>" * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<b>" * 50_000 + "<p>x" * 50_000, "<table>" + "<tr><td>x" * 50_000):
        began = time.process_time()
        op.parse(html)
        assert time.process_time() - began < 3


def test_decoding_is_the_best_consistent_choice():
    """Against all choices: a dropped node drops all below it, and leaving a kept parent has a price."""
    r = np.random.default_rng(2)
    for trial in range(30):
        html = "".join(["<div>aa", "<p>bbbb</p>", "<div>c<p>dd</p>", "<ul><li>eee</li>", "<p>f</p></ul></div>"][: 2 + trial % 4])
        p = op.Page(html)
        n = len(p.nodes)
        scores = r.normal(size=n) * 4
        weight = np.sqrt(p.own) + 1
        weight = weight * np.clip(scores, -6, 6)
        up = [p.index.get(id(x.parent)) if x.parent else None for x in p.nodes]

        def value(choice, weight=weight, up=up):
            total = 0.0
            for i, c in enumerate(choice):
                if i and c and not choice[up[i]]:
                    return -np.inf
                total += weight[i] if c else -weight[i]
                total -= op.PRICE if i and not c and choice[up[i]] else 0
            return total

        best = max(value(c) for c in itertools.product([False, True], repeat=n))
        assert value(p.decode(scores)) == pytest.approx(best)


def test_references_and_formulas(model):
    html = page(f"<article><p>{WORDS}</p><p>{WORDS}&am<!-- x -->p; &lt;<i>&amp;</i></p><p>{WORDS}<math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>")
    got = text(html, model).split("\n")
    assert got[1] == WORDS + "&amp; <&" and got[2] == WORDS + "x=2"
