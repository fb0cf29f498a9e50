"""Language ID, quality and HTML extraction: brute force, held-out accuracy, odd rows."""

import hashlib
import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from configlens.llm import html_extract, lang_id, quality, queries
from configlens.llm.labelled_pages import labelled_pages


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("segment", [1, 3, 7, 64])
def test_viterbi_equals_a_plain_loop(segment):
    rng = np.random.default_rng(segment)
    sizes = np.array([0, 1, 2, 7, 8, 50, 0, 129])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 2, (starts[-1], 4))
    path = lang_id.viterbi(scores, starts, 1.5, segment)
    for a, b in zip(starts, starts[1:], strict=False):
        assert path[a:b].tolist() == plain_viterbi(scores[a:b], 1.5)


def plain_viterbi(scores, switch):
    if not len(scores):
        return []
    v, back = scores[0].copy(), []
    for row in scores[1:]:
        best, pointers, new = int(v.argmax()), [], []
        for k in range(len(v)):
            stays = v[k] >= v[best] - switch
            pointers.append(k if stays else best)
            new.append((v[k] if stays else v[best] - switch) + row[k])
        back.append(pointers)
        v = np.array(new)
    path = [int(v.argmax())]
    for pointers in back[::-1]:
        path.append(pointers[path[-1]])
    return path[::-1]


def test_op1_is_accurate_on_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(out) >= 0.97 * len(out)


EN, RU = "the cat and the dog went over the hill with this and that", "кот и собака шли через холм и это было то"
DE = "der hund und die katze gingen über den berg mit dem und das"


def language_docs(spark):
    rows = [(i, f"{t} {i}", lang, 5) for i in range(60) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))]
    return spark.createDataFrame([(k, t, lang, x) for k, (_, t, lang, x) in enumerate(rows)], "doc_id bigint, text string, lang string, lang_pred int")


def test_languages_of_odd_texts(spark):
    model = lang_id.fit(language_docs(spark))
    assert model.languages == ["de", "en", "ru"]
    texts = {1: None, 2: "", 3: "123 !!", 4: EN, 5: "це мова", 6: "漢字", 7: f"{EN}. {DE}. {DE}", 8: EN * 3000}
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, lang_pred string")
    found = lang_id.identify(rows, model)
    got = {r.doc_id: r["_lang_pred"] for r in found.collect()}
    assert found.columns == ["doc_id", "text", "lang_pred", "_lang_pred", "lang_score"]
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en" and got[5] == "ru" and got[6] in model.languages and got[7] == "de" and got[8] == "en"
    spans = [(r.lang, texts[7][r.begin : r.end]) for r in lang_id.spans(rows.where("doc_id = 7"), model).collect()]
    assert [s[0] for s in spans] == ["en", "de"] and spans[0][1] == EN
    assert lang_id.identify(rows.limit(0), model).count() == 0


def test_without_labels_nothing_is_determined(spark):
    docs = language_docs(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    model = lang_id.fit(docs)
    assert {(r.lang_pred, r.lang_score) for r in lang_id.identify(docs.select("doc_id", "text"), model).collect()} == {("und", 0.0)}
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {0.5}


def test_op9_separates_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, "", "word " * 20000, "ok text here", "ok text here"])], "doc_id bigint, text string, quality_score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (3, 1), (3, 0), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and rows[0].asDict().keys() == {"doc_id", "text", "quality_score", "_quality_score", "quality_pred"}
    scores = {r.doc_id: r["_quality_score"] for r in rows}
    assert scores[0] == scores[1] and scores[3] == scores[4]


def test_context_sums_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(f"a{i} b{i % 7} c a{i % 5}",) for i in range(200)], "text string")
    assert np.array_equal(quality.context_sums(docs.repartition(1)), quality.context_sums(docs.repartition(7)))


def plain_words(texts, least):
    """Vectors of words (b"" for rare ones) and the means of texts, by plain loops."""
    word = lambda w: int(quality.Tokens([w.encode()]).words[0])
    index, sums, count = {}, {}, {}
    for w in (w for t in texts for w in (t or "").split()):
        count[w] = count.get(w, 0) + 1
        if w not in index:
            dims, signs = quality.index_vectors(np.array([word(w)]))
            index[w] = np.zeros(quality.SIZE)
            np.add.at(index[w], dims[0], signs[0])
    named = lambda w: w if count[w] >= least else ""
    for t in texts:
        ws = (t or "").split()
        for i, w in enumerate(ws):
            sums[named(w)] = sums.get(named(w), 0) + sum(index[ws[j]] for j in range(max(0, i - 2), min(len(ws), i + 3)) if j != i)
    means = {}
    for t in texts:
        ws = (t or "").split()
        v = quality.word_vectors(np.array([sums[named(w)] for w in ws])) / quality.SCALE if ws else np.zeros((1, quality.SIZE))
        means[t or ""] = v.mean(axis=0)
    return means


@pytest.mark.parametrize(("least", "frequent"), [(1, 3), (1, 10**6), (3, 10**6), (3, 20)])
def test_words_have_vectors_of_their_own(spark, least, frequent):
    """More words than any fixed number of buckets; means against plain loops, with words broadcast and joined, and rare words put together."""
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(20_000)]
    texts = [" ".join(names[i : i + 50]) for i in range(0, 20_000, 50)] + [" ".join(names[i : i + 9]) for i in range(0, 900, 3)] + ["waaaa wbaaa waaaa", "", None, "waaaa wbaaa waaaa"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    wanted = {hashlib.md5(t.encode()).digest(): m for t, m in plain_words(texts, least).items()}
    vectors = quality.learned_vectors(docs, least, frequent)
    assert vectors.more == (frequent < 100)
    got = {bytes(r.key): np.frombuffer(r.mean) for r in quality.pooled(docs, vectors).collect()}
    assert got.keys() == wanted.keys() and all(np.allclose(got[k], wanted[k], atol=1e-9) for k in got)


@pytest.mark.parametrize("frequent", [20, 10**6])
def test_op9_equals_brute_force(spark, sf_dir, frequent):
    """Every score of the query's operator from texts alone: word vectors, means and the network by plain loops."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text", F.lower(F.regexp_replace("text", "[^a-zA-Z]+", " ")))  # words that split() finds as well
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), frequent=frequent)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    means = plain_words(list(texts.values()), quality.LEAST)
    net = model.network
    for r in quality.score(docs, model).collect():
        hidden = np.tanh((means[texts[r.doc_id]] - net.mean) / net.scale @ net.first + net.first_bias)
        p = 1 / (1 + math.exp(-(float(hidden @ net.second) + net.second_bias) / net.temperature))
        assert abs(p - r.quality_score) < 1e-9 and r.quality_pred == int(r.quality_score >= 0.3)


def brute_sum_product(page, tables):
    """Marginals by trying all labellings."""
    own, edges = html_extract.potentials(page, tables)
    n = len(page.parent)
    total, yes = 0.0, np.zeros(n)
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        p = 1.0
        for i in range(n):
            p *= own[i] if y[i] else 1.0
            if i:
                p *= edges[i][2 * y[page.parent[i]] + y[i]]
        total += p
        yes += p * np.array(y)
    return yes / total


@pytest.fixture(scope="module")
def pages():
    model = html_extract.fit()
    return model, html_extract._tables(model)


def test_messages_give_exact_marginals(pages):
    page = html_extract.parse("<body><nav><ul><li><a>x</a></ul></nav><article><h1>T</h1><p>one<p>two</article><div class=ad>b</div>")
    assert len(page.parent) == 9
    assert np.allclose(html_extract.marginals(page, pages[1]), brute_sum_product(page, pages[1]))


CASES = {
    "<article><h1>A  b</h1><p>c<br>d &amp; &lt;e&gt;</p></article><footer>f</footer>": "A b c d & <e>",
    "<nav>n</nav><main><p>x</p><aside>s</aside><p>y</p></main>": "x y",
    "<article><p>a<script>if (a < b) '</p>'</script>b<style>p{}</style></p></article>": "ab",
    "<article><p>a<!-- <p>no</p> -->b</article><section class='comments'><p>me too, a longer remark</p></section>": "ab",
    "<title>t</title><div class='cookie-notice'>We use</div><article><p title='a > b'>q</p></article><form><p>mail</p></form>": "q",
    "": "",
    "<article><p>un<b>closed": "unclosed",
}


@pytest.mark.parametrize(("source", "text"), CASES.items())
def test_main_text(pages, source, text):
    assert html_extract.main_text(source, pages[1]) == text


def test_marginals_on_unseen_labelled_pages(pages):
    right = total = 0
    for source in labelled_pages(120, seed=5):
        page = html_extract.parse(source)
        label, belief = html_extract.given_labels(page), html_extract.marginals(page, pages[1])
        for node, _ in page.texts:
            right += (belief[node] >= 0.5) == label[node]
            total += 1
    assert right >= 0.985 * total


def test_weights_are_where_the_likelihood_has_no_slope():
    """On a few pages, a weight moved either way makes the labels less likely, by the marginals of a brute force."""
    sources = list(labelled_pages(40, seed=2))
    model = html_extract.fit(sources)
    small = [page for page in map(html_extract.parse, sources) if len(page.parent) <= 60]

    def likelihood():
        tables, total = html_extract._tables(model), 0.0
        for page in small:
            own, edges = html_extract.potentials(page, tables)
            label = html_extract.given_labels(page)
            z = [[1.0, x] for x in own]
            for i in range(len(own) - 1, 0, -1):
                for a in (0, 1):
                    z[page.parent[i]][a] *= edges[i][2 * a] * z[i][0] + edges[i][2 * a + 1] * z[i][1]
            total += sum(math.log(x) for x, y in zip(own, label, strict=True) if y) - math.log(sum(z[0]))
            total += sum(math.log(edges[i][2 * label[page.parent[i]] + label[i]]) for i in range(1, len(own)))
        return total

    there = likelihood()
    for weights in model.weights():
        weights *= 0.5
        assert likelihood() < there
        weights *= 2


#: Paragraphs of 100 letters and more; ways in which pages hold them, without and with words of layout.
PARAGRAPHS = [f"paragraph {c} that goes on with a few more words about this and that until it has a hundred letters or more, {c}." for c in "abcdef"]
LAYOUTS = ["content-area with-sidebar", "page-with-sidebar", "post has-social-share", "side-by-side", "ad-free", "article-ad-wrapper", "more-info", "related-content", "discussion", "post-comments-open"]
HOLDERS = {
    **{name: f'<div class="{name}">' + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div>" for name in LAYOUTS},
    "br": "<div>" + "<br><br>".join(PARAGRAPHS) + "</div>",
    "br in body": "<br><br>".join(PARAGRAPHS),
    "divs": "<div>" + "".join(f"<div>{p}</div>" for p in PARAGRAPHS) + "</div>",
    "divs in body": "".join(f"<div>{p}</div>" for p in PARAGRAPHS),
    "center": "<center><font>" + "<br><br>".join(PARAGRAPHS) + "</font></center>",
    "section": "<section><div>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div></section>",
    "table": "<table><tr><td><a href=a>Aboutus</a> <a href=b>Homepage</a><td>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</table>",
}
AROUND = {
    "elements": ("<header>Sitename</header><nav><ul><li><a href=/>Homepage</a><li><a href=/b>Aboutus</a></ul></nav>", "<footer>Copyright someone</footer>"),
    "divs": ('<div class="header">Sitename</div><div class=menu><a href=/>Homepage</a> <a href=/b>Aboutus</a></div>', "<div class=footer>Copyright someone</div>"),
}


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("holder", HOLDERS)
def test_articles_survive_layout(pages, holder, around):
    before, after = AROUND[around]
    found = html_extract.main_text(f"<html><head><title>T</title></head><body>{before}{HOLDERS[holder]}{after}</body></html>", pages[1])
    assert found == " ".join(PARAGRAPHS)


@pytest.mark.parametrize("holder", [name for name in HOLDERS if name != "table"])
def test_articles_alone_on_a_page(pages, holder):
    assert html_extract.main_text(HOLDERS[holder], pages[1]) == " ".join(PARAGRAPHS)


def test_comments_go_however_long(pages):
    comments = "".join(f"<div class=comment><p>{p}</p></div>" for p in PARAGRAPHS)
    for tag in ("section class=comments", "div id=comment-list", 'div class="post-comments"'):
        found = html_extract.main_text(f"<nav><a href=/>Homepage</a></nav><article><h1>Head</h1><p>{PARAGRAPHS[0]}</p></article><{tag}>{comments}</{tag.split()[0]}><footer>Copyright</footer>", pages[1])
        assert found == f"Head {PARAGRAPHS[0]}"


def test_formulas_stay(pages):
    assert html_extract.main_text("<article><p>Where <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math> holds</article>", pages[1]) == "Where x=1 holds"


def test_hints():
    names = list(html_extract.HINTS)
    hints = lambda value: [names[k] for k in html_extract._hints(f' class="{value}"')]
    assert hints("content-area with-sidebar") == ["content"] and hints("ad-free comments-open no-ads") == []
    assert hints("article-ad-wrapper") == ["ad", "content"] and hints("relatedPosts") == ["side", "content"] and hints("") == []


def test_op4_keeps_articles_whole(spark, sf_dir):
    import html
    import re

    rows = {r.page_id: r for r in queries.op4_html_extract(spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))
        expected = " ".join(html.unescape(plain).split())
        assert rows[page.page_id].text == expected and rows[page.page_id].n_chars == len(expected)


def test_extracts_odd_rows(spark, pages):
    table = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "y"), (2, "u", "<div>" * 3000 + "deep", "z"), (2, "u", "<p", "z")], "page_id bigint, url string, html string, text string")
    got = html_extract.extract(table, pages[0]).collect()
    assert [(r.page_id, r.url) for r in got] == [(1, None), (None, "u"), (2, "u"), (2, "u")]
    assert all(r.n_chars == len(r.text) for r in got) and got[0].text == ""
    assert html_extract.extract(table.limit(0), pages[0]).count() == 0


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<head><meta charset=utf-8><p>Article", "Article"),
        ("<html><head><title>T</title><link rel=x>Article <b>goes</b> on", "Article goes on"),
        ("<head><title>T</title></head><body><p>One", "One"),
        ("<head><title>T<body><p>One", "One"),
        ("<p>One <head>two", "One two"),
        *((f"<article><p>One<{tag}>x<p>Two</p>Three</article>Four", "One Two Three Four") for tag in ("button", "select", "object", "svg", "audio", "video", "canvas", "template")),
        ("<article><p>One<button>x</article><p>Two<button>y</button>", "One Two"),
        ("<p>One<button>x<p>y</p><div>z</div></button>two</p>", "One two"),
        ("<p>One<object><video>x</object> two", "One two"),
        ("<div>One<svg><g><text>x</text></g></svg> two</button></svg></div>", "One two"),
        ("<p>One <noscript>two<p>Three", "One two Three"),
        ("<p>One <iframe src=a>two<p>Three<iframe>x</iframe>", "One two Three"),
        ("<p>One<textarea>x<p>Two", "One Two"),
        ("<p>One<script>x<p>y", "One"),
    ],
)
def test_omitted_and_unclosed_tags_hide_nothing_else(source, texts):
    assert " ".join(" ".join(text for _, text in html_extract.parse(source).texts).split()) == texts


@pytest.mark.parametrize("unit", ["<a ", '<a ">" ', "<iframe>", "<svg>", "<!-", "</script ", "<p><caption><h1>", "&#1", "<td>"])
def test_broken_pages_take_linear_time(pages, unit):
    """A megabyte of one broken tag; the quadratic parser took 15 s for 60 KB."""
    began = time.process_time()
    html_extract.main_text(unit * (1_000_000 // len(unit)), pages[1])
    assert time.process_time() - began < 10


@pytest.mark.parametrize("page", ["<title>t</title><p>{}", "<head><meta charset=utf-8><p>{}", "<article><button>x<p>{}</article>", "<article><svg><path d='x'><p>{}</article>", "<article><p>a <select><option>b<p>{}</article>", "<article><p title='>{}</article>"])
def test_articles_survive_unclosed_elements(pages, page):
    article = "words of an article that goes on and on, long enough to be one. " * 12
    found = html_extract.main_text(page.format(article), pages[1])
    assert article.strip() in found
