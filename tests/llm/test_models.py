"""The models against enumeration, plain versions and pages that no generator wrote."""

import time
from collections import Counter
from itertools import product

import numpy as np
import pytest

pytest.importorskip("relsat.llm.registry")

from relsat.llm import html_extract, language, quality


@pytest.fixture(scope="module")
def chain():
    return html_extract.trained()


def test_chain_equals_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        s, t, first, last = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2)
        readings = list(product((0, 1), repeat=n))
        score = np.array([first[y[0]] + last[y[-1]] + sum(s[i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:])) for y in readings])
        z, p, pair = html_extract.marginals(s, t, first, last)
        weight = np.exp(score - z)
        assert abs(weight.sum() - 1) < 1e-9
        for i in range(n):
            assert abs(p[i, 1] - sum(w for w, y in zip(weight, readings) if y[i])) < 1e-9
        for a, b in product((0, 1), repeat=2):
            assert abs(pair[a, b] - sum(w * sum(u == (a, b) for u in zip(y, y[1:])) for w, y in zip(weight, readings))) < 1e-9
        c = html_extract.Chain()
        c.index, c.w, c.t, c.first, c.last = {f"f{i}": i for i in range(n)}, s, t, first, last
        assert c.decode([[f"f{i}"] for i in range(n)]) == list(readings[int(score.argmax())])


#: Pages written by hand, with their main texts: layouts, markup and wording of their own.
PAGES = [
    (
        """<html><head><title>Bread</title><link rel=stylesheet href=a.css></head><body><div id="wrapper"><div id="masthead"><a href="/">The Village Baker</a> <a href="/shop">Shop</a> <a href="/about">About us</a></div>
        <div class="post-content"><h1>How to keep a sourdough starter alive</h1><p>A starter is a small community of yeast and bacteria. Feed it every day &mdash; flour and water are enough.</p>
        <p>If you go away, put it in the fridge; it sleeps for <em>two weeks</em> without harm.</p><h3>What you need</h3><ul><li>50 g of rye flour</li><li>50 g of water</li></ul></div>
        <div class="sidebar"><h4>Latest recipes</h4><a href=1>Rolls</a><a href=2>Baguettes</a></div><div id="footer">&copy; 2021 The Village Baker. All rights reserved. <a href=/imprint>Imprint</a></div></div></body></html>""",
        "How to keep a sourdough starter alive A starter is a small community of yeast and bacteria. Feed it every day — flour and water are enough. If you go away, put it in the fridge; it sleeps for two weeks without harm. What you need 50 g of rye flour 50 g of water",
    ),
    (
        """<!doctype html><body><header role=banner><nav><a href=/>News</a><a href=/sport>Sport</a><a href=/weather>Weather</a></nav></header><div class="cookie-banner">We use cookies to improve your visit. <button>Accept</button></div>
        <main><article><h1>River rises after a week of rain</h1><p class="byline">By Anna Holm, 3 May</p><p>The river has risen by two metres since Monday, and the old bridge is closed to traffic.</p><aside class="ad"><a href=x>Cheap boots, this week only</a></aside>
        <p>&quot;We have not seen this since 1987,&quot; said the mayor on Thursday.</p><blockquote>Please stay away from the banks.</blockquote></article></main><section id="comments"><h2>3 comments</h2><div class="comment"><p>My cellar is full of water!</p></div><form><textarea>Write here</textarea><button>Send</button></form></section>
        <footer><p>Contact the editors. Privacy policy.</p></footer></body>""",
        'River rises after a week of rain The river has risen by two metres since Monday, and the old bridge is closed to traffic. "We have not seen this since 1987," said the mayor on Thursday. Please stay away from the banks.',
    ),
    (
        """<HTML><BODY bgcolor=white><TABLE width=100%><TR><TD class="menu"><A HREF="a.html">Home</A><BR><A HREF="b.html">Links</A></TD><TD><DIV CLASS="text"><H2>My trip to the north</H2><P>We left at five in the morning, when the streets were still empty and the lamps were on.
        <P>By noon we had reached the border, and nobody asked for our papers.<P>The ferry was late.</DIV></TD></TR></TABLE><DIV class="footer">Last changed in 1999</DIV></BODY></HTML>""",
        "My trip to the north We left at five in the morning, when the streets were still empty and the lamps were on. By noon we had reached the border, and nobody asked for our papers. The ferry was late.",
    ),
    (
        """<body><nav class="toc"><ol><li><a href=#a>Install</a><li><a href=#b>Use</a></ol></nav><div class="markdown-body"><h1>tinylog</h1><p>A logger of forty lines. It writes to <code>stderr</code> &amp; nowhere else.</p><h2>Install</h2><pre>copy tinylog.c into your tree</pre><h2>Use</h2><p>Call <code>tl_open()</code> first, and then <code>tl_say("hello")</code> as often as you like.</p></div><script>var s = "<p>not text</p>";</script><div class="newsletter"><p>Subscribe to our newsletter for more small tools.</p><input type=email></div>""",
        'tinylog A logger of forty lines. It writes to stderr & nowhere else. Install copy tinylog.c into your tree Use Call tl_open() first, and then tl_say("hello") as often as you like.',
    ),
]


def test_hand_written_pages(chain):
    scores = []
    for html, want in PAGES:
        got, want = Counter(html_extract.main_text(html, chain).split()), Counter(want.split())
        both = sum((got & want).values())
        scores.append(2 * both / (sum(got.values()) + sum(want.values())))
    print("word F1 of hand-written pages:", [round(x, 3) for x in scores])
    assert min(scores) > 0.8 and np.mean(scores) > 0.9


def test_pages_that_try_a_scanner(chain):
    deep = "<article><p>" + "<div class=inner>" * 1000 + "Deep text, in a thousand boxes." + "</div>" * 1000 + "<p>Behind it all.</article>"
    assert [b.text for b in html_extract.blocks(deep)] == ["Deep text, in a thousand boxes.", "Behind it all."]
    assert html_extract.blocks("<div a='x><p>one</p><p>two</p>")[0].text == "one"
    assert [b.text for b in html_extract.blocks('<p title="a > b">c &#99999999999; &#65;</p>')] == ["c � A"]
    assert [b.text for b in html_extract.blocks("x <!-- y --> z<!--")] == ["x z"] and html_extract.blocks("a<b")[0].text == "a"
    long = "We use cookies, " + "and this block of text is long, " * 40
    features = html_extract.block_features(html_extract.blocks(f"<p>{long} subscribe</p>"))[0]
    assert "says cookie long" in features and "says subscribe long" in features
    for bad in ("<a" * 500_000, "<a \">\" " * 140_000, "</script" * 120_000, "<center>" * 60_000 + "</x>" * 60_000, "<b '" * 250_000, "<dd><div>" * 50_000 + "<p></p>" * 50_000):
        began = time.thread_time()
        html_extract.main_text(bad, chain)
        assert time.thread_time() - began < 5, bad[:10]


def test_mixture_equals_plain_iteration():
    rng = np.random.default_rng(3)
    like = np.log(rng.random((400, 4)) ** 3 + 1e-4)
    like[:60, 1] += 2  # mostly one language
    doc = np.repeat([0, 2, 3, 5], [60, 100, 30, 210])
    best, score = language.mixture(like, doc, 7)
    assert best[[1, 4, 6]].tolist() == [-1] * 3 and score[[1, 4, 6]].tolist() == [0] * 3
    for d in (0, 2, 3, 5):
        p = np.exp(like[doc == d])
        n, k = p.shape

        def fit(mask):
            pi = mask / mask.sum()
            for _ in range(5000):
                r = pi * p
                pi = (r / r.sum(1, keepdims=True)).mean(0)
            return pi, np.log((pi * p).sum(1)).sum()

        order = np.argsort(-fit(np.ones(k))[0], kind="stable")
        sets = [fit(np.eye(k)[int(np.log(p).sum(0).argmax())])]
        sets += [fit(np.isin(np.arange(k), order[:m]).astype(float)) for m in range(2, k + 1)]
        value = [f - 0.5 * m * np.log(n + 1) for m, (_, f) in enumerate(sets)]
        pi = sets[int(np.argmax(value))][0]
        assert best[d] == pi.argmax() and abs(score[d] - pi.max()) < 0.03


def test_many_languages_and_one_text(spark):
    rows = [(i, " ".join(["abcdefghijklmnopqrstuvwxyz"[(g * 7 + j * (g + 3)) % 26] * 2 + chr(97 + g % 26) + chr(97 + g // 26) for j in range(30)]), f"l{g:03}") for i, g in enumerate(list(range(300)) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = language.train(docs)
    assert len(langs) == 300 and logs.shape == (language.BUCKETS, 300)
    got = language.detect(docs.limit(300), (langs, logs)).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_letters_are_those_of_unicode(spark):
    model = (["de"], np.zeros((language.BUCKETS, 1), np.float32))
    docs = spark.createDataFrame([(0, "²"), (1, "½ Ⅷ"), (2, "é"), (3, "漢"), (4, "_ 12"), (5, "ª")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.detect(docs, model).collect()}
    assert got == {0: "und", 1: "und", 2: "de", 3: "de", 4: "und", 5: "de"}


def test_preference_gradient_equals_differences():
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(12, 5)), rng.normal(size=5)
    better, worse = rng.integers(0, 6, 40), rng.integers(6, 12, 40)
    loss, g = quality.preferences(z, better, worse, w, 1e-2)
    plain = np.mean([np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in zip(better, worse)]) + 0.005 * w @ w
    assert abs(loss - plain) < 1e-12
    for j in range(5):
        e = np.eye(5)[j] * 1e-6
        slope = (quality.preferences(z, better, worse, w + e, 1e-2)[0] - quality.preferences(z, better, worse, w - e, 1e-2)[0]) / 2e-6
        assert abs(slope - g[j]) < 1e-7


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = ("Some Words and some more words, again words.\n" * 40).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 64)
    assert np.allclose(whole, quality.features(text)) and not quality.features(b" \n ").any()
