"""Fitted operators: held-out accuracy, awkward rows, whole texts; and the pipeline."""

import html as html_lib
import re

import pytest

from pairloom.llm import html_main, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = quality.quality_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.quality for r in rows)
    assert hit / len(rows) > 0.97
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_toxicity_on_unseen_rows(tables):
    docs, labels = tables
    known = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    rows = toxicity.toxicity_query(docs, known).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9 and sum(r.predicted for r in clean) / len(clean) < 0.02


@pytest.fixture(scope="module")
def chain(tables):
    docs, labels = tables
    return toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))


def test_chain_by_hand(chain, tables):
    """Every link is a logistic of the text's columns and the probabilities of the links before it."""
    import numpy as np

    texts = [(r.text or "").encode() for r in tables[0].orderBy("doc_id").limit(40).collect()] + [b"", b"You moron, you idiot. " * 3]
    got, _ = chain.score(texts)
    for text, row in zip(texts, got, strict=True):
        columns, before = set(toxicity.features([text])[0].tolist()), []
        for model in chain.models:
            raw = model.bias + sum(w for c, w in zip(model.columns.tolist(), model.w) if c in columns) + sum(d * toxicity.SCALE * p for d, p in zip(model.dense, before))
            before.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
        assert row == pytest.approx(before)


def test_answer_comes_through_earlier_links(chain, tables):
    docs, labels = tables
    toxic = [r.text.encode() for r in docs.join(labels.where("toxic = 1"), "doc_id").limit(200).collect()]
    last = chain.models[-1]
    assert not set(last.columns.tolist()) & set(chain.telling.tolist()) and (found := chain.score(toxic)[0][:, -1] >= 0.5).mean() > 0.9
    kept, last.dense = last.dense, last.dense * 0
    assert (chain.score(toxic)[0][:, -1] >= 0.5).mean() < 0.1 < found.mean()
    last.dense = kept


def test_later_links_learn_from_predictions_out_of_fold():
    import numpy as np

    rng = np.random.default_rng(3)
    label = (rng.random(300) < 0.3).astype(float)
    rows = [np.unique(np.append(rng.integers(100, 400, 30), rng.integers(0, 12, 3) if y else rng.integers(20, 32, 3))) for y in label]
    column, at = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    fitted = toxicity.Chain.fit(column, at, label, folds=3)
    assert fitted.oof.shape == (300, len(toxicity.CATEGORIES))
    group = toxicity.grouped(fitted.telling, column, at, label)
    kind = np.array([bool(y) and bool(set(r.tolist()) & set(fitted.telling[group == 0].tolist())) for y, r in zip(label, rows)], float)
    for k in range(3):  # the first link again, from the other folds alone
        rest, own = np.flatnonzero(fitted.fold != k), np.flatnonzero(fitted.fold == k)

        def part(ids):
            return np.concatenate([rows[i] for i in ids]), np.append(0, np.cumsum([len(rows[i]) for i in ids]))

        c, a = part(rest)
        model = toxicity.Linear(toxicity.chosen(c, a, label[rest], against=False)).fit(c, a, np.zeros((len(rest), 0)), kind[rest])
        c, a = part(own)
        assert fitted.oof[own, 0] == pytest.approx(model.probability(*model.rows(c, a), len(own), np.zeros((len(own), 0))))


def _awkward(spark):
    rows = [(1, None, 0.5, "a"), (2, "", 0.1, "b"), (3, " \n ", 0.0, "c"), (None, "a text without id", 0.2, "d"), (4, "x" * 300000, 0.3, "e"), (4, "x" * 300000, 0.3, "e"), (5, "moron " * 20000, 0.1, "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, p_toxic string")


def test_awkward_rows(spark, tables):
    labels = tables[1]
    docs = _awkward(spark)
    q = quality.quality_query(docs, labels).collect()
    assert len(q) == 7 and all(0 <= r.score <= 1 for r in q)
    assert quality.good_docs(docs, labels).columns == docs.columns
    t = toxicity.toxicity_query(docs, labels).collect()
    assert len(t) == 7
    none = labels.where("false")
    assert quality.quality_query(docs, none).where("score between 0 and 1").count() == 7
    assert toxicity.toxicity_query(docs, none).where("predicted = 0").count() == 7
    empty = docs.where("false")
    assert quality.quality_query(empty, labels).count() == 0 and toxicity.toxicity_query(empty, labels).count() == 0


def test_factorisation_identity():
    import numpy as np

    m = quality.FactorisationMachine(50, 3, seed=1)
    rng = np.random.default_rng(0)
    m.w, m.w0 = rng.normal(size=50), 0.3
    c, x = np.array([3, 7, 9, 20]), rng.normal(size=4)
    pairs = sum(float(m.v[c[i]] @ m.v[c[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.raw(c, x, np.array([0, 4]))[0] == pytest.approx(m.w0 + m.w[c] @ x + pairs)


def test_pages_of_the_tables(spark):
    rows = html_main.html_query(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)[^>]*>|<br>", " ", inside))
        assert r.text == " ".join(html_lib.unescape(inside).split()) and r.n_chars == len(r.text)


def test_page_parts():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies. Please accept them all.</div>
    <aside class="sidebar"><p>A long popular text about other things, nothing of the article at all.</p></aside><main><article><header><h1>Title &lt;here&gt;</h1></header><p>First <b>bold</b>word &amp; text.
    More&nbsp;of it.</p><script>var a = "<p>no</p>";</script><style>p{}</style><div class="ad">Buy this now!</div><ul><li>one<li>two</ul><p>Short.</article><section class="comments"><h2>Comments</h2>
    <p>This article is wrong, because of the reasons given by many others before me.</p></section><form><label>Name</label><input></form></main><footer>&copy; x</footer></body></html>"""
    assert html_main.main_text(page)[0] == "Title <here> First boldword & text. More of it. one two Short."
    assert html_main.main_text("")[0] == "" and html_main.main_text("a plain text")[0] == "a plain text"


_IN_ARTICLE = """<main><article><div class="entry-header"><h1>Title</h1></div><p>First paragraph of the text, with some words.</p><div class="warning">Beware of this.</div>
<p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><div class="ad">Buy now, it is cheap today.</div><p><a href="/s">See also this</a></p><p>Last.</p><ul><li>one</li><li>two</li></ul></article></main>"""
_WITHOUT_ARTICLE = """<html><body><div id="top"><a href=/>Home</a> <a href=/b>Shop</a></div><div class="wrap"><h1>On rivers</h1><p>Rivers carry water from the hills to the sea, and much else besides.</p><p>So it is.</p>
<div><a href="/x">More on hills</a></div><p>They bend where the ground is soft, and cut deep where it is hard.</p></div><div class="related"><h2>Related</h2><ul><li><a href=/1>Lakes</a></li><li><a href=/2>Seas of the north</a></li></ul></div>
<div class="legal">All rights reserved.</div><footer><p>Written by nobody in particular, who keeps all rights to it.</p></footer></body></html>"""


@pytest.mark.parametrize(
    "page,want,turned",
    [
        (_IN_ARTICLE, "Title First paragraph of the text, with some words. Beware of this. The formula x=2 holds. See also this Last. one two", "See also this"),
        (_WITHOUT_ARTICLE, "On rivers Rivers carry water from the hills to the sea, and much else besides. So it is. More on hills They bend where the ground is soft, and cut deep where it is hard.", "More on hills"),
    ],
)
def test_the_cut_decides(page, want, turned):
    """A block whose own cost speaks against it goes with what surrounds it; the blocks alone would lose it."""
    found = html_main.blocks(page)
    unary, edges = html_main.graph(found)
    assert html_main.main_text(page)[0] == want
    alone = [t for (t, _, _), u in zip(found, unary) if u < 0]
    assert turned not in alone and " ".join(alone) != want
    assert " ".join(t for (t, _, _), x in zip(found, html_main.minimum_cut(unary, {})) if x) == " ".join(alone)


@pytest.mark.parametrize("page", ["<a " * 400_000, "<a " * 400_000 + '">"', "<svg>" * 200_000, "<a b='" * 200_000 + ">", "<!" * 400_000, "<b>" * 100_000 + "<p>" * 50_000, "a" * 1_000_000, f"<p {'a' * 1_000_000}>x</p>"])
def test_long_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - began < 20


_PROSE = "A sentence of the usual kind, with a good many words in it, which goes on for a while and then ends as it should, so that it looks like any other text of the page."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")])
@pytest.mark.parametrize(
    "other",
    ["<nav>{}</nav>", "<header><p>{}</p></header>", "<footer><p>{}</p></footer>", "<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', '<div id="cookie-notice"><p>{}</p></div>', '<div class="notice">{}</div>', '<div class="ad">{}</div>',
     '<form><p>{}</p><button>Send</button></form>', '<section class="comments"><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>', '<div role="navigation"><p>{}</p></div>', '<div hidden><p>{}</p></div>', "<script>{}</script>", "<style>{}</style>"],
)
def test_what_is_not_the_article(tags, other):
    """Prose in what is not the article goes, before it and after it; the article's own stays, short lines too."""
    main = f"<h1>On rivers</h1><p>{_PROSE}</p><p>So it is.</p><p>{_PROSE} &amp; more.</p><ul><li>one</li><li>two</li></ul>"
    want = f"On rivers {_PROSE} So it is. {_PROSE} & more. one two"
    part = other.replace("{}", _PROSE.replace("usual", "other"))
    for page in (f"<body>{part}{tags[0]}{main}{tags[1]}</body>", f"<body>{tags[0]}{main}{tags[1]}{part}</body>"):
        assert html_main.main_text(page)[0] == want


def test_open_tags_and_quotes():
    def texts(page):
        return [t for t, _, _ in html_main.blocks(page)]

    assert texts("<p>one<p>two<ul><li>three<li>four</ul>five") == ["one", "two", "three", "four", "five"]
    assert texts('<p title="a > b">x</p><p title=\'"\'>y</p>') == ["x", "y"]
    assert texts("<p>1 < 2 and 3 <4</p>") == ["1 < 2 and 3 <4"]
    assert texts("<p>x</b></div>y") == ["x", "y"] and texts("<p>x <!-- a > b -->y<!-- open") == ["x y"]
    assert texts('<p a="open>x</p><p>y</p>') == ["x", "y"]


_PROSE = ["The first of two sentences has exactly eighteen words in it so that nobody can call it short.", "And the second one is about as long as the first one was, with a few more words."]


@pytest.mark.parametrize("name", "share-price popular-science related-work menu-recipes privacy-law cookie-recipes login-guide notice-of-change comment-on-law".split())
def test_a_part_of_a_name_says_nothing(name):
    page = f'<body><div class="{name}"><h2>A title</h2><p>{_PROSE[0]}</p><p>{_PROSE[1]}</p></div></body>'
    assert html_main.main_text(page)[0] == " ".join(["A title", *_PROSE])


@pytest.mark.parametrize("name", "share share-buttons related-posts site-footer cookie-banner comment-list sidebar-left c-share__item ad-slot newsletter-signup main-nav comment-body".split())
def test_what_a_name_ends_in_speaks(name):
    page = f'<body><div class="story"><p>{_PROSE[0]}</p><p>{_PROSE[1]}</p></div><div class="{name}"><p>Something else that is short</p><p>and more of it here</p></div></body>'
    assert html_main.main_text(page)[0] == " ".join(_PROSE)


def test_prose_between_links_stays():
    assert html_main.main_text(f'<body><div><a href="x">One link</a></div><div><a href="y">Another</a></div><p>{_PROSE[0]}</p></body>')[0] == _PROSE[0]
    assert html_main.main_text('<body><nav><a href="x">One link</a></nav><div class="cookie-banner"><p>We use cookies so that this page works, and you can say no to them below.</p></div></body>')[0] == ""


def test_stray_inline_ends_take_linear_time():
    import time

    n = 60_000
    began = time.process_time()
    html_main.main_text("<b><table>" + "<i>" * n + "</b>" * n)
    assert time.process_time() - began < 5
    # an end tag in a cell does not reach out of it; one after the table does
    assert html_main.blocks("<div><b>x<table><tr><td>y</b>z</td></tr></table>w</b></div>") and [t for t, _, _ in html_main.blocks("<p>a<b>b</p><p>c</b>d</p>")] == ["ab", "cd"]


def test_minimum_cut_against_all_labellings():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 7)
        unary = [r.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 2) for i in range(n) for j in range(i) if r.random() < 0.5}

        def cost(lab):
            return sum(u for u, x in zip(unary, lab) if x) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])

        best = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert cost(html_main.minimum_cut(unary, edges)) == pytest.approx(best)


def test_html_cases(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "y"), (3, None, "<p>Some words of text.</p>", "z"), (3, None, "<p>Some words of text.</p>", "z")], "page_id long, url string, html string, main_text string")
    assert sorted((r.page_id, r.text) for r in html_main.html_query(df).collect()) == [(1, ""), (2, ""), (3, "Some words of text."), (3, "Some words of text.")]
    assert html_main.html_query(df.where("false")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    from pairloom.llm import decontam, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        if i < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        if i == 1:  # no near copies are left
            assert simhash.simhash_query(out).where("doc_id <> component_id").count() == 0
        if i == 2:
            assert decontam.decontam_query(out, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        seen.append(out.count())
        docs = out
    assert seen[0] > seen[1] > seen[2] >= seen[3] and seen[4] == seen[5]
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
