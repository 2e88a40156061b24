import html
import re

import pytest
from pyspark.sql import functions as F

from revisit.llm import html_crf as crf

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def field():
    return crf.default_field()


def test_given_pages(spark, field):
    """The test pages keep their text in one article; that gives the expected text."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r for r in crf.extract(pages, field).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1].replace("<br>", " ").replace("<b>", "")
        parts = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:h1|p)>", inner)]
        want = "\n".join(filter(None, parts))
        r = got[p.page_id]
        assert r.text == want and r.n_chars == len(want) and r.url == p.url


def test_held_out_accuracy(field):
    right = n = kept = 0
    for page, labels in crf.labelled_pages(200, seed=77):
        out = field.decode(crf.features(crf.blocks(page)))
        right, n, kept = right + sum(a == b for a, b in zip(out, labels)), n + len(labels), kept + sum(labels)
    assert right / n > 0.99 and 0.3 < kept / n < 0.9


def test_decode_is_the_best_sequence(field):
    """Viterbi against all label sequences."""
    import itertools
    rows = crf.features(crf.blocks(crf.labelled_pages(1, seed=9)[0][0]))[:9]

    def value(labels):
        s = sum(field.weights[[field.names[f] for f in r if f in field.names], y].sum() for r, y in zip(rows, labels))
        return s + field.start[labels[0]] + sum(field.moves[a, b] for a, b in itertools.pairwise(labels))
    assert field.decode(rows) == list(max(itertools.product((0, 1), repeat=len(rows)), key=value))


def test_gradient_reaches_a_maximum():
    """No small change of the weights raises the penalised likelihood of the training pages."""
    import itertools
    pages = [(crf.features(crf.blocks(p)), y) for p, y in crf.labelled_pages(6, seed=3)]
    pages = [(r[:6], y[:6]) for r, y in pages if r]
    f = crf.train(pages, steps=1500, rate=0.05, decay=0.05)

    def goal(w, moves, start):
        out = -0.025 * ((w ** 2).sum() + (moves ** 2).sum() + (start ** 2).sum())
        for rows, labels in pages:
            s = [w[[f.names[x] for x in r]].sum(axis=0) for r in rows]
            score = lambda y: start[y[0]] + sum(a[b] for a, b in zip(s, y)) + sum(moves[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
            import numpy as np
            out += (score(labels) - np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(rows))])) / len(pages)
        return out
    best = goal(f.weights, f.moves, f.start)
    for i in range(0, len(f.weights), 9):
        for step in (-0.05, 0.05):
            w = f.weights.copy()
            w[i, 1] += step
            assert goal(w, f.moves, f.start) < best + 1e-6


def test_other_layouts(field):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
      <header><div class=logo>Site</div><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header>
      <div id="cookie-banner"><p>We use cookies to improve things.</p><button>OK</button></div>
      <main><article><h1>A &amp; B</h1><p>First paragraph with <a href="/x">a link</a> and <b>bold</b>&nbsp;words.
      <p>One.<p>Second<br>line here, it goes on for a while and then it stops.
      <script>if (a < b) document.write("<p>no</p>")</script><ul><li>item one<li>item two</ul>
      <div class="ad">Buy this now, it is cheap and good.</div><blockquote>Quoted words stand here.</blockquote></article></main>
      <aside><h3>Related</h3><ul><li><a href=/r>Other story</a></ul></aside>
      <section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all.</p></div></section>
      <form><label>Mail</label><input><p>Subscribe to our letter today.</p></form><footer>&copy; 2024 Site &middot; Imprint</footer></body></html>"""
    assert crf.main_text(page, field).split("\n") == [
        "A & B", "First paragraph with a link and bold words.", "One.", "Second line here, it goes on for a while and then it stops.",
        "item one", "item two", "Quoted words stand here."]


def test_odd_pages(rows, field):
    data = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "<script>x"), (6, "u", "<article><p>a &am"), (7, "u", "<article><p>x &lt;b&gt; &#233; &#x1F600;"),
            (8, "u", "<article>" + "<p>word word word.</p>" * 30_000 + "</article>"), (9, "u", "<div " * 5000), (10, "u", "<a b='" + "x" * 100_000), (None, None, "<article><p>A b.</p>"),
            (None, None, "<article><p>A b.</p>"), (11, "u", "</p></div><article><p>Deep." + "<div>" * 3000), (12, "u", "<article><p>1 < 2 and 3 > 2.</p>")]
    df = rows(data, SCHEMA).withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    got = crf.extract(df, field).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(data) and all(r.n_chars == len(r.text) for r in got)
    assert [text[i] for i in (1, 2, 4, 5)] == ["", "", "", ""] and text[6] == "a &am" and text[7] == "x <b> é 😀"
    assert text[8].count("\n") == 29_999 and text[None] == "A b." and text[12] == "1 < 2 and 3 > 2."
    assert crf.extract(rows([], SCHEMA), field).collect() == []


@pytest.mark.parametrize("markup", ['<a href="/hidden-valley">', "<a href=/hidden>", "<a title='the hidden side'>", '<a data-hidden="false">',
                                    '<a alt="x style=display:none">', '<a data-aria-hidden="true" data-style="display:none">'])
def test_only_whole_attribute_names_hide(markup):
    assert [b[0] for b in crf.blocks(f"<body><p>before {markup}inside</a> after</p></body>")] == ["before inside after"]


def test_hidden_elements_and_hints():
    for markup in ("hidden", 'HIDDEN=""', "aria-hidden=true", "style='display: none'", 'title="a" hidden', "data-x hidden"):
        assert [b[0] for b in crf.blocks(f"<p>before <b {markup}>inside</b> after</p>")] == ["before after"]
    assert crf._named("div", ' data-id="sidebar" data-class="nav" data-role="x"') == ([], False)
    assert crf._named("div", ' ID=sidebar CLASS="nav" role=main')[0] == ["role:main", "hint:nav", "hint:side"]


def test_formulas_and_objects_are_text():
    page = "<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds</p><object data=x><p>a description</p></object>"
    assert [b[0] for b in crf.blocks(page)] == ["so E=m holds", "a description"]


def test_a_quote_that_nothing_closes_ends_with_its_tag():
    texts = lambda page: [b[0] for b in crf.blocks(page)]
    assert texts('<article><p title="x>Hello you all</p><p>Next one</p></article>') == ["Hello you all", "Next one"]
    assert texts("<p title='x>It is so</p><p>Next</p>") == ["It is so", "Next"]
    assert texts('<p title="hidden>Seen text</p>') == ["Seen text"]
    assert texts('<p title="a > b">Whole value</p>') == ["Whole value"]
    assert texts("<p>" + "<b x='" * 3 + "end") == []
    assert texts("<p " * 20_000 + '"' + "<p>" * 20_000 + "last") == ["last"]
