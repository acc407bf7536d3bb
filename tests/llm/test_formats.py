"""Chat trees and page extraction: round trips and odd input."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.llm import chat, html

TEXT = st.text(alphabet="a\\#</turn>:ht \n", max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_template_is_reversible(turns):
    assert chat.parse("".join("".join(chat.turn_parts(role, text)) for role, text in turns)) == turns


def test_prefix_tree(spark):
    pytest.importorskip("tokenizers")
    talks = {
        1: ["hi", "hello", "how", "fine"], 2: ["hi", "hello", "why", "because"], 3: ["hi", "hello", "how", "bad"], 4: ["hi"], 5: ["other", "\\### user: </turn>"],
        6: ["hi", "hello", "how", "fine"], 7: ["hi", "hello", "how"],
    }
    rows = [(i, t, "assistant" if t % 2 else "user", x) for i, texts in talks.items() for t, x in enumerate(texts)] + [(8, None, None, "x"), (9, 0, "user", "dup"), (9, 0, "user", "dup")]
    rows += [(None, 0, "user", "nobody"), (None, 0, "user", "nobody"), (None, 1, "assistant", None), (None, 0, "user", "hi")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as tree")
    turns = chat.formatted_turns(frame)
    trees = chat.prefix_trees(turns)
    nodes = trees.toPandas()
    assert nodes.node.is_unique and len(nodes) == 7 + 2 + 2 + 1 + 2
    assert max(len(x) for x in nodes.attends) <= 3  # ancestors that follow each other are one interval
    for _, tree in nodes.groupby("tree"):
        tree = tree.sort_values("start")
        assert tree.start.tolist() == [0, *tree.length.cumsum()[:-1]]  # every token once, without a gap
        spans = {(r.start, r.start + r.length): r for r in tree.itertuples()}
        for r in tree.itertuples():
            seen = sum(x["to"] - x["from"] for x in r.attends)
            assert seen == r.position and all(x["to"] <= r.start for x in r.attends)
            covered = sorted(k for k in spans for x in r.attends if x["from"] <= k[0] and k[1] <= x["to"])
            assert sum(b - a for a, b in covered) == seen and len(covered) == r.depth - 1
    back = chat.read_back(trees, turns).collect()
    out = {r["conv_id"]: r for r in back}
    assert len(back) == 13 and out[9]["n_turns"] == 2 and sorted(r["formatted_chars"] for r in back if r["conv_id"] is None) == [20, 23, 24, 24]
    for i, texts in talks.items():
        said = "".join(f"{'assistant' if t % 2 else 'user'}\n{x or ''}\n" for t, x in enumerate(texts))
        loss = "".join(x or "" for x in texts[1::2])
        assert out[i]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (out[i]["loss_chars"], out[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = chat.formatted_turns(frame.limit(0))
    assert chat.read_back(chat.prefix_trees(empty), empty).count() == 0


def test_prefix_tree_of_a_hot_first_turn(spark):
    """Hundreds of second turns, each with several continuations: every node is emitted once."""
    pytest.importorskip("tokenizers")
    talks = [["hi", f"second {i}", f"third {j}", "fourth"][: 3 + j % 2] for i in range(300) for j in range(3)]
    rows = [(n, t, "assistant" if t % 2 else "user", x) for n, texts in enumerate(talks) for t, x in enumerate(texts)]
    turns = chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    trees = chat.prefix_trees(turns)
    nodes = trees.drop("ids").toPandas().sort_values("start")
    assert nodes.node.is_unique and len(nodes) == 1 + 300 + 900 + 300
    assert nodes.start.tolist() == [0, *nodes.length.cumsum()[:-1]]
    assert all(sum(x["to"] - x["from"] for x in r.attends) == r.position for r in nodes.itertuples())
    out = {r["conv_id"]: r for r in chat.read_back(trees, turns).collect()}
    for n, texts in enumerate(talks):
        said = "".join(f"{'assistant' if t % 2 else 'user'}\n{x}\n" for t, x in enumerate(texts))
        assert (out[n]["n_turns"], out[n]["turns_sha256"]) == (len(texts), hashlib.sha256(said.encode()).hexdigest())


def test_three_shared_turns_spread_over_buckets(spark):
    """Conversations that share three turns are sorted in many buckets, and a long one costs no more than its turns."""
    pytest.importorskip("tokenizers")
    talks = [["system", "hi", "hello", f"question {i}", f"answer {i}"] for i in range(400)] + [[f"turn {i % 7} {i}" for i in range(2_000)]]
    rows = [(n, t, "assistant" if t % 2 else "user", x) for n, texts in enumerate(talks) for t, x in enumerate(texts)]
    turns = chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sizes = chat.ordered_paths(turns).groupBy("bucket").count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 250
    trees = chat.prefix_trees(turns)
    assert trees.count() == 3 + 800 + 2_000 and trees.select("node").distinct().count() == 2_803
    assert {r["n_turns"] for r in chat.read_back(trees, turns).collect()} == {5, 2_000}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    "<div class='ad'>Buy &amp; go</div><article><h1>Head &amp;&#33;</h1><p><b>First</b> part<br>goes on\n here.<p>Second &lt;one&gt;.</p></article><footer>&copy; me</footer>"
)


def test_blocks():
    found = html.blocks(PAGE)
    assert [b.text for b in found] == ["Menu", "Buy & go", "Head &!", "First part goes on here.", "Second <one>.", "© me"]
    assert html.teacher(found) == [0, 0, 1, 1, 1, 0]
    assert html.blocks("") == [] and html.blocks("<<<>") != None  # noqa: E711
    assert html.blocks("<p>a<!-- never closed") [0].text == "a"


def test_self_closed_svg():
    """A self-closed svg ends with its own tag; an open one with its closing tag."""
    for svg in ('<svg class="i"/>', "<SVG title='a > b' />", "<svg/>"):
        assert [b.text for b in html.blocks(f"<p>One</p>{svg}<p>Two</p><svg><path d='x'/>no</svg><p>Three</p>")] == ["One", "Two", "Three"]
    assert [b.text for b in html.blocks("<p>One</p><svg class='i'><path/><text>no</text></svg><p>Two</p>")] == ["One", "Two"]


@pytest.mark.parametrize(("page", "texts"), [
    ("<p title=don't>Hello</p><p>it's fine</p>", ["Hello", "it's fine"]),
    ('<p>keep</p><a title="unclosed>text</a><p>more</p>', ["keep", "text", "more"]),
    ("<p>a</p><svg><p>b</p>rest of page", ["a", "b", "rest of page"]),
    ('<a b="x>y">in</a><!-->shown<!-- never', ["inshown"]),
    ("<p>x</p></ bogus><!-- c --><!doctype q>y<?php a?>z < 3 &amp;amp; <title>q", ["x", "yz < 3 &amp; q"]),
    ("<div>one<script src='x'/>p()</script> two<style>p{}", ["one two"]),
])
def test_odd_markup(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


@pytest.mark.parametrize("bad", ['<a title="', "<a title='x\" ", "<!--", "<svg>", "<a ", "<iframe>", "<b>", "<li>", "<b></li>", "<p a='"])
def test_long_pages_take_linear_time(bad):
    page = bad * (1_000_000 // len(bad))
    start = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - start < 5


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    shapes = [(2, html.N_IN, 4 * html.N_HIDDEN), (2, html.N_HIDDEN, 4 * html.N_HIDDEN), (2, 4 * html.N_HIDDEN), (2 * html.N_HIDDEN + 1,)]
    model = html.Lstm(*(rng.normal(0, 0.3, shape) for shape in shapes))
    x, mask = rng.normal(size=(4, 3, html.N_IN)), np.arange(4)[:, None] < np.array([[4, 2, 1]])
    gold = (rng.random((4, 3)) < 0.5) * mask
    grads = html.gradients(model, x, mask, gold)
    for weights, grad in zip(model, grads):
        for at in zip(*(rng.integers(0, n, 12) for n in weights.shape)):
            kept, step = weights[at], 1e-5
            weights[at] = kept + step
            above = html.loss(model, x, mask, gold)
            weights[at] = kept - step
            below = html.loss(model, x, mask, gold)
            weights[at] = kept
            assert np.isclose(grad[at], (above - below) / (2 * step), atol=1e-7)


def test_network_learns_and_padding_is_silent():
    """The labels are learnt, and long and short pages give the same chances alone and together."""
    rng = np.random.default_rng(1)
    pages = [rng.normal(size=(n, html.N_IN)).astype(np.float32) for n in (3, 7, 1)]
    model = html.train(pages, [[1, 0, 1], [0, 1, 0, 1, 1, 0, 0], [1]], rounds=60)
    together = html.predict(model, pages)
    for page, p, y in zip(pages, together, ([1, 0, 1], [0, 1, 0, 1, 1, 0, 0], [1])):
        assert np.allclose(html.predict(model, [page])[0], p, atol=1e-5)
        assert ((p > 0.5) == np.array(y, bool)).all()


@pytest.fixture(scope="module")
def labeller(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    lot = "xxhash64(page_id, 'half') % 2 = 0"
    return html.fit(pages.where(lot)), [html.blocks(r["html"]) for r in pages.where(f"not {lot}").collect() if r["html"]]


def test_pages_with_meaningless_names(labeller):
    """Without telling names the article is found by structure, text and context."""
    model, pages = labeller
    rng, right, total = np.random.default_rng(5), 0, 0
    for page in pages:
        gold = np.array(html.teacher(page), bool)
        hidden = html.nameless(page, rng)
        assert not html.TELLING & {html.tag_of(x) for b in hidden for x in b.path}
        right += ((html.predict(model, [html.vectors(hidden)])[0] >= 0.5) == gold).sum()
        total += len(page)
    assert total > 100 and right >= 0.9 * total


def test_handmade_page_with_meaningless_names(labeller):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(rng.choice(list("abdegilmnorstu"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."
    article = [say(n) for n in (60, 45, 80, 30, 55, 70)]
    menu = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8))
    page = f"<body><div class=q1><ul>{menu}</ul></div><div class=q2>{say(8)}</div><div class=q3><h1>{say(6)}</h1>{''.join(f'<p>{x}</p>' for x in article)}</div><div class=q4>{say(9)}</div>"
    found = html.blocks(page)
    chances = html.predict(labeller[0], [html.vectors(found)])[0]
    gold = [b.text in article or b.path[-1] == "h1" for b in found]
    assert ((chances >= 0.5) == gold).mean() >= 0.9


#: Layouts labelled by hand: {m:n} is text of the article with n words, {o:n} is not.
LAYOUTS = (
    "<nav><ul><li><a href=1>{o:1}</a><li><a href=2>{o:1}</a></ul></nav><main><h1>{m:6}</h1><p>{m:50}<p>{m:40}<p>{m:60}<h2>{m:4}</h2><ul><li>{m:9}<li>{m:7}</ul><p>{m:50}<p>{m:45}</main><footer><p>{o:6}</footer>",
    "<div><ul><li><a href=1>{o:1}</a><li><a href=2>{o:1}</a></ul></div><div><h1>{m:6}</h1><p>{m:50}<p>{m:40}<ul><li>{m:9}<li>{m:12}</ul><p>{m:50}<p>{m:45}</div><div><p>{o:6}</div>",
    "<nav><a href=1>{o:1}</a></nav><article><header><h1>{m:6}</h1><p class=byline>{m:3}</p></header><p>{m:25}<blockquote>{m:20}</blockquote><table><tr><td>{m:3}<td>{m:2}</table><pre>{m:12}</pre><aside>{o:10}</aside></article><footer>{o:5}</footer>",
    "<article><header><h1>{m:6}</h1></header><p>{m:40}<p>{m:50}<p>{m:60}<p>{m:30}</article>",
    "<header><h1>{o:3}</h1></header><div class=content><h2>{m:5}</h2><p>{m:70}<ol><li>{m:15}<li>{m:11}<li>{m:18}</ol><p>{m:33}</div><div class=sidebar><p>{o:12}</div>",
    "<div class=cookie><p>{o:14}</div><main><article><h1>{m:7}</h1><figure><figcaption>{m:9}</figcaption></figure><p>{m:55}<p>{m:65}</article></main><div class=comments><div class=comment><p>{o:22}</div><div class=comment><p>{o:9}</div></div>",
    "<form><label>{o:3}</label><button>{o:1}</button></form><article><p>{m:20}<p>{m:30}</article><footer>{o:8}</footer>",
    "<div class=x1><a href=1>{o:2}</a></div><div class=x2><h3>{m:5}</h3><p>{m:44}<dl><dt>{m:2}<dd>{m:16}<dt>{m:2}<dd>{m:21}</dl><p>{m:37}</div><div class=x3>{o:7}</div>",
    "<div class=post><h1>{m:8}</h1><p>{m:35}<h2>{m:3}</h2><p>{m:48}<h2>{m:4}</h2><p>{m:29}<div class=ad>{o:6}</div><p>{m:52}</div><div class=related><ul><li>{o:5}<li>{o:6}</ul></div>",
    "<main><section><h2>{m:5}</h2><p>{m:41}</section><section><h2>{m:4}</h2><p>{m:63}<table><tr><td>{m:4}<td>{m:5}<tr><td>{m:3}<td>{m:6}</table></section></main><aside><p>{o:15}</aside>",
)


def test_pages_labelled_by_hand(labeller):
    """Lists, tables, quotations, inner headers and short articles, 60 pages; no label comes from the teacher."""
    rng = np.random.default_rng(21)
    right = total = kept = articles = 0
    for layout in LAYOUTS * 6:
        gold = {}

        def said(m, gold=gold):
            text = " ".join("".join(rng.choice(list("abdegilmnorstu"), rng.integers(2, 9))) for _ in range(int(m[2]))).capitalize()
            gold[text + "." * (int(m[2]) > 8)] = m[1] == "m"
            return text + "." * (int(m[2]) > 8)

        page = html.blocks(f"<body>{re.sub(r'{([mo]):(\d+)}', said, layout)}</body>")
        found = html.predict(labeller[0], [html.vectors(page)])[0] >= 0.5
        truth = np.array([gold[b.text] for b in page])
        right, total = right + (found == truth).sum(), total + len(page)
        kept, articles = kept + (found & truth).sum(), articles + truth.sum()
    assert total >= 400 and right >= 0.9 * total and kept >= 0.9 * articles, (right, total, kept, articles)


def test_teacher_without_names():
    long = "<p>" + "words of the article follow here. " * 20 + "</p>"
    page = html.blocks(f"<div><a href=x>one</a><a href=y>two</a></div><div><h2>Head</h2>{long}{long}</div><div>short remark</div>")
    assert html.teacher(page) == [0, 1, 1, 1, 0]


def test_extract(spark):
    base = spark.createDataFrame([(i, f"u{i}", PAGE.replace("Second", f"Text {i} of the page")) for i in range(60)], "page_id long, url string, html string")
    model = html.fit(base)
    odd = spark.createDataFrame([(1, "a", None), (2, None, ""), (None, "b", PAGE), (3, "c", PAGE), (3, "c", PAGE)], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as lot", "3 as n_chars", "4 as blocks")
    out = html.extract(odd, model).toPandas()
    assert len(out) == 5
    assert out[out.page_id == 3].text.tolist() == ["Head &!\nFirst part goes on here.\nSecond <one>."] * 2
    assert out[out.page_id == 1].text.tolist() == [""] and out[out.page_id == 2].n_chars.tolist() == [0]
    assert html.extract(odd.limit(0), model).count() == 0
