"""Language ID, page text and shared passages."""

import random
import re
import time
import zlib
from html import unescape

import pytest

from orrery.llm import html, langid, passages
from tests.llm.common import ODD, docs, edited, prose

TONGUES = {"en": "the of and to in that is was for it with as his on be at by had", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein", "fr": "de la le et les des en un du une que est pour qui dans a par plus", "es": "de la que el en y a los se del las un por con no una su para"}


def tongue(rng, lang, n):
    return " ".join(rng.choice(TONGUES[lang].split()) for _ in range(n))


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, tongue(rng, x, rng.randint(8, 60)), x) for i, x in enumerate(rng.choice(list(TONGUES)) for _ in range(600))]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, per_language=60)
    assert model.langs == sorted(TONGUES) and 0.05 <= model.temperature <= 20
    got = {r.doc_id: r for r in langid.identify(df, model, "doc_id", langid.fold(df["doc_id"]).alias("fold")).collect()}
    held = [(got[i], x) for i, _, x in rows if x and got[i].fold == 1]
    assert len(held) > 150 and sum(r.lang_pred == x for r, x in held) >= 0.97 * len(held)
    for i, t in enumerate(ODD):
        r = got[1000 + i]
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))


def test_language_id_does_not_see_the_fold(spark):
    rng = random.Random(2)
    rows = [(i, tongue(rng, "en" if i % 2 else "fr", 20), "en" if i % 2 else "fr") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = df.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'de', lang) as lang")
    a, b = langid.train(df), langid.train(other)
    assert a.langs == b.langs and (a.table == b.table).all() and a.temperature == b.temperature


def test_language_id_without_labels(spark):
    df = docs(spark, ["some text", None], lang=None)
    got = langid.identify(df, langid.train(df), "doc_id").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(df.where("false"), langid.train(df.where("false")), "doc_id").collect() == []


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = random.Random(3)
    model = langid.fit([tongue(rng, x, 30) for x in TONGUES for _ in range(20)], [x for x in TONGUES for _ in range(20)])
    text = tongue(rng, "de", 500)
    want = model.logits(text)
    monkeypatch.setattr(langid, "PIECE", 100)
    assert model.logits(text) == pytest.approx(want)


P1 = "The first settlers came to the valley early, and they built houses of stone; the river gave them water."
P2 = "Later the town grew. Its market drew people from far away, who sold cloth, grain and tools there every week."


@pytest.mark.parametrize("before, after", [
    ('<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav><div class="ad">Buy the best shoes now.</div>', "<footer>&copy; 2020 example.org. All rights reserved.</footer>"),
    ("<header><h2>My site</h2><p>A place for news.</p></header>", '<aside><h3>Related</h3><p>Other things to read, and more of them, are here.</p></aside>'),
    ('<div class="cookie-notice"><p>We use cookies to improve this site. Accept them all.</p></div>', '<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article very much, thank you for it.</p></div></section>'),
    ('<div id="sidebar"><p>Popular posts of this week, chosen by our editors for you.</p></div>', '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>'),
    ("<script>var x = '<p>no</p>';</script><style>p { color: red }</style><!-- <p>no</p> -->", '<div class="newsletter"><p>Subscribe to our newsletter and never miss a post.</p></div>'),
])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div>{}</div>"])
def test_main_text(before, after, frame):
    body = frame.format(f"<h1>A town&nbsp;&amp; its \n river</h1><p>{P1}<p>{P2}<br>And <b>bold</b>   words, too.</p><ul><li>One thing, of many there.</li></ul>")
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{body}{after}</body></html>"
    assert html.main_text(page) == f"A town & its river\n{P1}\n{P2} And bold words, too.\nOne thing, of many there."


def test_page_text_edges(spark):
    pages = [None, "", "<p>", "<html><body><nav><a href='x'>menu</a></nav></body></html>", "plain text of a page, with a sentence. And more of it, too, here.", "<article><p>" + "long text, of words. " * 20_000, "<" * 1000, "&#0;&bogus;&#xD800;"]
    rows = [(i % 7, None, h, "x") for i, h in enumerate(pages)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got)[-1] == len(("long text, of words. " * 20_000).strip())
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_min_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side, gain=gain, edges=edges):
            return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.min_cut(gain, edges)) == pytest.approx(best, abs=1e-6)


def test_passages(spark):
    rng = random.Random(11)
    shared, fuzzy = prose(rng, 60), prose(rng, 90)
    texts = [prose(rng, 300) for _ in range(30)]
    plant = {1: shared, 4: shared.upper(), 9: shared, 12: fuzzy, 15: edited(rng, fuzzy, 0.04), 20: edited(rng, fuzzy, 0.04)}
    for i, p in plant.items():
        texts[i] = prose(rng, 40) + " " + p + "\n" + prose(rng, 70)
    texts[25] = " ".join(texts[24].split(" ")[:30]) + " " + prose(rng, 200)  # too short to count
    got = passages.shared_passages(docs(spark, [*texts, *ODD, texts[2]])).collect()
    found = {r.doc_id for r in got}
    same = {len(texts) + k for k, t in enumerate(ODD) if t and t.startswith("word ")}
    assert found == {*plant, 2, len(texts) + len(ODD)} | (found & same)
    for r in got:
        assert r.identity >= 0.8 and r.doc_id != r.partner_id
        if r.doc_id in (4, 9):
            assert (r.start_word, r.n_words) == (40, 60) and (r.partner_start, r.partner_words, r.partner_id) == (40, 60, 1)
        if r.doc_id == 15:
            assert abs(r.start_word - 40) <= 8 and abs(r.n_words - 90) <= 12
    assert {(r.doc_id, r.partner_id, r.start_word, r.partner_start) for r in got} == {(r.partner_id, r.doc_id, r.partner_start, r.start_word) for r in got}
    assert passages.shared_passages(docs(spark, ["a"]).where("false")).collect() == []


def test_texts_that_repeat_themselves(spark):
    rng = random.Random(22)
    lines = [prose(rng, 7) for _ in range(3)]
    texts = ["again " * 300, "\n".join(lines * 20), prose(rng, 100), "again " * 300, "\n".join(lines * 20), "\n".join(lines * 9)]
    got = passages.shared_passages(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == {0, 1, 3, 4, 5}
    assert max(r.n_words for r in got if r.doc_id == 3) == 300 and max(r.n_words for r in got if r.doc_id == 4) == 420


def test_an_equal_passage_in_an_unlike_chain_is_found(spark):
    rng = random.Random(21)
    base = prose(rng, 60).split(" ")
    rest = [prose(rng, 1) for _ in range(300)]
    loose = [w if k % 12 < 7 else prose(rng, 1) for k, w in enumerate(rest)]
    texts = [" ".join(base + rest), " ".join(base + loose), prose(rng, 200)]
    got = passages.shared_passages(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == {0, 1}
    assert any(r.doc_id == 1 and r.start_word == 0 and r.n_words >= 60 for r in got)
    assert passages.exact_runs([1, 2, 3, 4, 9, 5, 6, 7], [5, 6, 7, 0, 1, 2, 3, 4], 3) == [(0, 4, 4), (5, 0, 3)]


def test_fragments_of_a_passage_are_put_together(spark):
    rng = random.Random(12)
    w = prose(rng, 60).split(" ")
    texts = [prose(rng, 50) + " " + " ".join(w[:32]), prose(rng, 50) + " " + " ".join(w[28:]), prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20)]
    got = passages.shared_passages(docs(spark, texts)).collect()
    assert {r.partner_id for r in got if r.doc_id == 2} == {0, 1}


def test_longest_common_subsequence():
    rng = random.Random(13)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        assert passages.common(a, b) == row[-1]


def test_chains_prefer_order_over_length():
    import numpy as np

    x = np.array([0, 5, 10, 30, 35, 40, 60, 65, 70])
    y = np.array([100, 105, 110, 20, 25, 30, 162, 167, 172])
    assert passages.chain(x, y)[0] == (60, 75, 162, 177) or passages.chain(x, y)[0][0] in (0, 30, 60)
    assert passages.chain(np.array([0, 5, 10, 22, 27, 32]), np.array([50, 55, 60, 74, 79, 84])) == [(0, 37, 50, 89)]


PROSE = "A long paragraph of text about the river, its light and the people who found it there. It goes on for some time, as such texts do, and ends."
ARTICLE = f"<h1>A title of it</h1><p>{PROSE}</p><p>{PROSE} Two.</p>"
PAGES = {
    "head without end": f"<html><head><title>T</title><body>{ARTICLE}</body></html>",
    "text ends the head": f"<html><head><title>T</title>{ARTICLE}</html>",
    "body with a negated name": f"<html><body class='has-sidebar'>{ARTICLE}</body>",
    "body with a bad name": f"<body class='sidebar'><nav>m n</nav>{ARTICLE}<div class=comments><p>{PROSE}</p></div></body>",
    "frame with two names": f"<body><div class='content left-sidebar'>{ARTICLE}</div></body>",
    "post without comments": f"<body><div class='post no-comments'>{ARTICLE}</div><footer>x y</footer></body>",
    "frame of all with a bad name": f"<body><div class='sidebar'>{ARTICLE}</div></body>",
    "svg without end": f"<body><nav><a href='x'>m</a></nav><div><svg><g></div><article>{ARTICLE}</article></body>",
    "svg without end before the text": f"<body><svg><path d='x'>{ARTICLE}</body>",
    "header of the article": f"<body><article><header><h1>A title of it</h1></header><p>{PROSE}</p><p>{PROSE} Two.</p></article><footer>c</footer></body>",
    "more comments than text": f"<article>{ARTICLE}</article><section class='comments'>" + f"<p>{PROSE}</p>" * 5 + "</section>",
    "list items without ends": f"<body><ul><li><a href='x'>a</a><li><a href='y'>b</a></ul><main>{ARTICLE}</main>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_every_make(name):
    assert html.main_text(PAGES[name]) == f"A title of it\n{PROSE}\n{PROSE} Two."


def test_large_pages_take_their_time():
    rng = random.Random(0)
    began = time.process_time()
    html.main_text("".join(f"<p>{PROSE}</p>" if rng.random() < 0.5 else f"<div class='ad'>{PROSE[: rng.randint(5, 90)]}</div>" for _ in range(20_000)))
    n = 20_000
    html.min_cut([rng.uniform(-1, 1) for _ in range(n)], [(i, i + 1, 0.6) for i in range(n - 1)] + [(i, i + rng.randint(2, 9), 0.5) for i in range(0, n - 9, 3)])
    html.main_text("<div>" * n + "x" + "</b>" * n + "<b>" * n + "<h1>x</h1></i>" * n)
    assert time.process_time() - began < 6


def test_query_against_the_articles_of_the_pages(spark):
    """The article of each given page, cut out by patterns; these pages mark it."""
    from orrery.llm.queries import op3_html_text

    sf = "/root/testdata/sf0.01"
    for r in op3_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        found = re.search(r"<article>(.*?)(?:</article>|$)", r.html or "", re.S)
        inner = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", found[1] if found else "", flags=re.S).replace("<br>", " ")
        parts = [unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", inner)]
        assert r.text == "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)
        assert r.n_chars == len(r.text)


def test_the_training_sample_is_bounded(spark):
    rng = random.Random(5)
    rows = [(i, f"{TONGUES['en']} {prose(rng, 5)}", f"label{i % 40:02d}") for i in range(400)]
    rows += [(7, f"{TONGUES['de']} {prose(rng, 3)} {k}", "de") for k in range(300)]  # one doc_id, many texts
    rows += [(8, TONGUES["fr"], "fr")] * 500 + [(9, "x" * 5000, "long"), (10, None, "fr"), (11, "12 34", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = langid.sample(df, per_language=20, languages=5, most=3000)
    assert found == langid.sample(df.repartition(2), per_language=20, languages=5, most=3000)
    by = {y: [t for t, z in found if z == y] for _, y in found}
    assert len(by) <= 5 and "long" not in by and by["fr"] == [TONGUES["fr"]]
    assert all(len(x) <= 20 and sum(len(t.encode()) for t in x) <= 3000 for x in by.values()) and len(by["de"]) > 10


def test_held_out_languages_of_the_query(spark):
    from orrery.llm.queries import op1_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    told = [r for r in got if r.held_out and r.lang is not None]
    assert len(told) > 200 and sum(r.lang_pred == r.lang for r in told) / len(told) > 0.98
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
