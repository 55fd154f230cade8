"""HTML extraction, token counts, rules, language and quality: units, brute force and held-out accuracy."""

import time
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vecshift.llm import html, langid, quality, rules, tokens


# ---------------------------------------------------------------- html
@pytest.mark.parametrize("page, text", [
    ("", ""), ("<html><script>var a='<p>x</p>';</script></html>", ""), ("plain text", "plain text"),
    ("<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<p>Be.</p></article><footer>c</footer>", "T & U\nOne two\nBe."),
    ("<article><p><b>open <br>next<p>second</article><div class='comments'><p>I like this article of the year and that</p></div>", "open next\nsecond"),
    ("<article><p>a &lt; b &#233;&nbsp;&eacute;</p><!-- <p>no</p> --><div class='x ad-slot'><p>buy</p></div><p>end</p>", "a < b é é\nend"),
    ("<article><p>cut off <b", "cut off"), ("<article>5 < 6 and 7 > 2<style>p{}</style></article>", "5 < 6 and 7 > 2"),
    ("<article><div hidden>x</div><aside>y</aside><form>z<input value='q'></form><p title=\"a>b\">kept</p></article>", "kept"),
    ("<article><p>one <span class='share'>Share</span>two <button>b</button>three</p></article>", "one two three"),
    ("<article>one<span class=ad><p>buy</p></span>two</article>", "one\ntwo"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<article><textarea><p>t</textarea><p>kept</p></article>", "kept"),
])
def test_main_text(page, text):
    assert html.main_text(page)[0] == text


def test_short_blocks_inherit_from_the_nearest_decided_neighbour():
    long = "This is a long paragraph of the text and it has all the words that are in such a text of a page."
    page = f"<div class=menu><p>Menu</p></div><div><p>Short.</p></div><div><p>{long}</p></div><div>Also short.</div><div class='footer'>x</div>"
    assert html.main_text(page)[0].split("\n") == [long, "Also short."]
    assert html.inherit([None, 1, None, None, 0], [True, False, False, False, False]) == [1, 1, 1, 0, 0]
    assert html.inherit([None, None], [False, True]) == [1, 1]


def test_links_and_stop_words_decide_outside_articles():
    linked = "<div><a href=a>one of the links that we have on this page</a> <a href=b>and another of the links on it</a></div>"
    names = "<div>" + " ".join(f"Name{i} Place{i}" for i in range(20)) + "</div>"
    assert html.main_text(linked + linked)[0] == ""
    assert [html.classify(b, html.Rules()) for b in html.blocks(linked + names)] == [html.BAD, html.AMBIGUOUS]


PROSE = ("This is a long paragraph of the text and it has all the words that are in such a text of a page, so that it is for the rules to say "
         "what it is; they have its length and the share of the words that are in the list, and the links that it has.")


@pytest.mark.parametrize("page, text", [
    (f"<body class='home has-sidebar search'><article><p>One.</p><p>{PROSE}</p></article></body>", f"One.\n{PROSE}"),
    (f"<body class=search><div><p>{PROSE}</p></div></body>", PROSE),
    (f"<div class='content no-sidebar'><p>{PROSE}</p></div>", PROSE),
    ("<article class='post category-search tag-social'><p>One.</p></article>", "One."),
    ("<article class='post social'><p>One.</p></article>", "One."),
    ("<main role=form class=dialog><p>One.</p></main>", "One."),
    # what holds an article is not marked, also before it
    ("<div class=search><h1>Title</h1><article><p>One.</p></article><p>Two.</p></div>", "Title\nOne.\nTwo."),
    # readers' comments are no articles of the page
    ("<article><p>One.</p></article><div class=comments><article class=comment><p>Me too.</p></article></div>", "One."),
    ("<article><p>One.</p><article class=comment><p>Me too.</p></article></article>", "One."),
    # the block rules decide inside marked elements
    (f"<div class=related><p>{PROSE}</p><p>Short one.</p></div>", PROSE),
    (f"<div class=related><p><a href=x>{PROSE}</a></p></div><article>One.</article>", "One."),
    ("<div id=site-footer><p>All of it is ours.</p></div><article>One.<div class=ad-slot-300x250>buy</div></article>", "One."),
])
def test_words_of_a_class_mark_no_article(page, text):
    assert html.main_text(page)[0] == text


@pytest.mark.parametrize("text", [
    "Il governo italiano presenta oggi una proposta nuova: secondo gli esperti, questa riforma cambia molto nella vita quotidiana degli abitanti.",
    "De regering heeft vandaag nieuwe maatregelen gepresenteerd waarmee gemeenten volgend jaar hun begroting kunnen aanpassen.",
    "Правительство сегодня представило новый проект бюджета, который предусматривает увеличение расходов на образование и науку.",
    "政府今天公布了新的预算方案，计划在明年增加教育和科学研究方面的支出，并减少行政费用。",
    " ".join(f"Name{i} Place{i}" for i in range(20)), "x1 = load(path); y1 = solve(x1, steps=10); assert len(y1) == 10, repr(y1); save(y1, path)",
])
def test_long_blocks_of_any_language_need_no_article(text):
    page = f"<body><nav><a href=a>Home</a></nav><div><p>{text}</p><p>{text}</p></div><footer>x</footer></body>"
    assert html.main_text(page)[0] == f"{text}\n{text}"
    few = f"<body><nav>Home</nav><p>{text[:8]}</p><p>{text} <a href=x>{text[:len(text) // 2]}</a></p><footer>x</footer></body>"
    assert html.main_text(few)[0] == ""  # short, or a third of links: as their neighbours


def test_stop_words_are_a_rule():
    text = "questo è il testo della pagina che non ha parole di altre lingue e che per questo è da tenere"
    block = html.blocks(f"<div>{text}</div>")[0]
    assert html.classify(block, html.Rules()) is html.AMBIGUOUS
    assert html.classify(block, html.Rules(stop_words=frozenset("questo è il della che non di e per da".split()))) == html.GOOD


def test_extract_html_edges(spark):
    rows = [(1, None, "keep"), (2, "", "keep"), (3, "<article><p>x é</p></article>", "keep"), (3, "<article><p>x é</p></article>", "keep")]
    df = spark.createDataFrame(rows, "page_id long, html string, extracted_ string").withColumn("text", F.lit("old"))
    got = html.extract_html(df).orderBy("page_id").collect()
    assert [(r.text, r.n_chars, r.extracted_) for r in got] == [("", 0, "keep"), ("", 0, "keep"), ("x é", 3, "keep"), ("x é", 3, "keep")]
    assert html.extract_html(df.limit(0)).count() == 0


def test_articles_of_all_pages(spark):
    rows = html.extract_html(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).collect()
    for r in rows:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


# ---------------------------------------------------------------- tokens
def brute_tokens(word, scores, longest):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        ends = [(best[j][0] + scores[word[j:i]], -best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
        top = max(s for s, _ in ends)
        best.append((top, min(-n for s, n in ends if s >= top - 1e-9)))
    return best[-1][1]


def test_trie_counts_match_single_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"cab", b"aa", b"aaaa", b"b" * 9]
    random.Random(1).shuffle(pieces)
    vocabulary = tokens.Vocabulary(pieces)
    scores = dict(zip(pieces, tokens.piece_scores(len(pieces))))
    draw = random.Random(2)
    words = list({bytes(draw.choice(b"abcx") for _ in range(draw.randrange(1, 30))) for _ in range(400)} | {b"a" * 300, b"b" * 200, b"\xff\x00"})
    assert vocabulary.counts(words).tolist() == [brute_tokens(w, scores, 9) for w in words]
    with pytest.raises(ValueError):
        tokens.Vocabulary([b"a", b"b"])


def test_pre_tokens_cover_the_text_and_batches_may_be_cut(monkeypatch):
    text = "It's  a café\n\n— 3.14 _x_\t\x00end "
    assert "".join(tokens.PRE_TOKEN.findall(text)) == text
    v = tokens.Vocabulary([bytes([b]) for b in range(256)] + [b" a", b"end"])
    whole = tokens._batch_counts([text, "", text * 50, "end"], v)
    monkeypatch.setattr(tokens, "TRIE_WORDS", 3)
    assert tokens._batch_counts([text, "", text * 50, "end"], v) == whole and whole[1] == (0, 0) and whole[2][1] == 50 * whole[0][1]


def test_long_pre_tokens_count_as_in_the_trie(monkeypatch):
    import time
    v = tokens.Vocabulary(tokens.read_vocabulary())
    draw = random.Random(5)
    words = [bytes(draw.choices(b"abeinrst \xc3\xa9", k=draw.randint(1, 300))) for _ in range(60)] + [b" " * 250, b"a" * 255]
    words = sorted(set(words))
    assert [v.count_long(w) for w in words] == v.counts(words).tolist()
    texts = ["x" * 40_000, "\u6c34" * 20_000, " " * 100_000 + "a", "ab" * 300 + " c", "ab" * 20]
    t0 = time.perf_counter()
    got = tokens._batch_counts(texts, v)
    assert time.perf_counter() - t0 < 10
    assert [n for n, _ in got] == [1, 1, 2, 2, 1]
    monkeypatch.setattr(tokens, "LONG", 10 ** 9)
    assert tokens._batch_counts(texts[3:], v) == got[3:]


def test_count_tokens_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {(r.doc_id, r.n_chars, r.n_pre_tokens, r.n_tokens) for r in tokens.count_tokens(df).collect()}
    assert got == {(1, 0, 0, 0), (2, 0, 0, 0), (None, 3, 2, 2), (3, 3, 2, 2)}
    assert tokens.count_tokens(df.limit(0)).count() == 0


# ---------------------------------------------------------------- rules
def brute_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


@pytest.mark.parametrize("text", ["", " \n\t", "a", "é é é é é é é", "a b c d e a b c d e", "x y z w v u x y z w v q\nx\n x\nx\n\nx",
                                  "a# b* | <c> " * 4, "one two three four\x0bfive\x1csix", "l1 a\nl1 a\r\nl1 a\n"])
def test_base_statistics(text):
    assert rules.statistics(text)[0] == brute_statistics(text)


def test_forest_sets_rare_mixes_apart_and_keeps_clean_texts(spark):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    big = SF_SMALL.replace("0.001", "0.01")
    forest = rules.fit_forest(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    got = rules.apply_rules(docs, forest).join(labels, "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n.get((0, False), 0) >= 4 * n.get((0, True), 0)
    edges = spark.createDataFrame([(1, None), (2, ""), (None, "w " * 30)], "doc_id long, text string").withColumn("kept", F.lit(1))
    assert {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in rules.apply_rules(edges, forest).collect()} == {(1, 0, True, False), (2, 0, True, False), (None, 30, True, False)}
    none = rules.fit_forest(docs, labels.limit(0))
    assert rules.apply_rules(docs, none).filter("kept = base_failed").count() == 0


# ---------------------------------------------------------------- language
def test_windows_cover_the_whole_text():
    text = "".join(random.Random(0).choice("abcdefgh") for _ in range(2000))
    w = langid.windows(text)
    s = langid.SYMBOL[np.frombuffer(text.encode(), np.uint8)]
    step = langid.WINDOW - langid.OVERLAP
    assert all((w[i][:len(s[i * step:i * step + langid.WINDOW])] == s[i * step:i * step + langid.WINDOW]).all() for i in range(len(w)))
    assert (len(w) - 1) * step + langid.WINDOW >= len(s) and langid.windows("").shape == (1, langid.WINDOW)


def test_tables_give_the_filters_responses():
    net = langid.train(["the cat and the dog " * 9, "der hund und die katze " * 9], ["en", "de"], epochs=2)
    rows = langid.windows("the dog und die katze " * 20)
    direct = []
    for w in langid.WIDTHS:
        z = sum(net.filters[w][k][rows[:, k:k + langid.WINDOW - w + 1]] for k in range(w))
        direct.append(z.max(1))
    h = np.maximum(np.concatenate(direct, 1) + net.bias, 0) @ net.dense + net.dense_bias
    p = np.exp(h - h.max(1, keepdims=True))
    assert np.allclose(net.odds(rows), p / p.sum(1, keepdims=True), atol=1e-4)


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    got = langid.identify_language(docs)
    held = got.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() and got.filter("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 !?", "xx"), (None, "the", None)], "doc_id long, text string, lang string")
    found = langid.identify_language(docs.select("doc_id", "text", "lang").limit(60).unionByName(odd).withColumn("predicted_", F.lit(0)))
    assert {r.doc_id for r in found.filter("lang_pred = 'und'").collect()} >= {1, 2, 3} and "predicted_" in found.columns
    assert found.filter("lang_pred = 'xx'").count() == 0
    # signs that are no letters, in training as in prediction; an id that is repeated without end is learned once
    net = langid.fit_language(docs.limit(60), F.lit(True))
    signs = spark.createDataFrame([(1, "\u00b2 \u2460 \u00bd _"), (2, "\u2160"), (3, "\u00aa"), (4, "x")], "doc_id long, text string")
    assert {r.doc_id for r in langid.predict_language(signs, net).filter("lang_pred = 'und'").collect()} == {1, 2}
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "train", lambda texts, langs, **fit: seen.extend(zip(texts, langs)))
        long = "start " + "a" * 50_000 + " middle " + "b" * 50_000 + " end"
        copies = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("xy " * 10).alias("text"), F.lit("en").alias("lang"))
        langid.fit_language(copies.unionByName(spark.createDataFrame([(8, long, "fr")], copies.schema)), F.lit(True))
    assert seen[0] == ("xy " * 10, "en") and len(seen) == 2
    assert seen[1][0].startswith("start aaa") and seen[1][0].endswith("bbb end") and len(seen[1][0]) == 20_000 + 15
    nothing = langid.identify_language(docs.withColumn("lang", F.lit(None).cast("string")).limit(5))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


# ---------------------------------------------------------------- quality
def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(40, 8, replace=False)).astype(np.int32) for _ in range(60)]
    y = np.where([(r < 12).sum() > 2 for r in rows], 1.0, -1.0)
    values, cost = [np.full(8, 0.5) for _ in rows], np.full(60, 1.0)
    w = quality.dual_coordinate_descent(rows, values, y, cost, epochs=400, tol=1e-9)
    dense = np.zeros((60, 41))
    for i, r in enumerate(rows):
        dense[i, r], dense[i, 40] = 0.5, 1.0
    small = np.concatenate((w[:40], w[-1:]))
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (dense @ v)).sum()
    assert all(loss(small) <= loss(small + draw.normal(0, s, 41)) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_quality_held_out_accuracy_and_edges(spark):
    big = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    odd = spark.createDataFrame([(10_000, None), (10_001, ""), (None, "Be.")], "doc_id long, text string")
    got = quality.classify_quality(docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("x")), labels)
    held = got.join(labels, "doc_id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0 and got.count() == docs.count() + 3
    none = quality.classify_quality(docs.limit(3), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.not_held_out(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.fit_quality(docs, x, allowed=quality.not_held_out()) for x in (labels, flipped))
    assert np.array_equal(a.weight, b.weight) and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


# ---------------------------------------------------------------- pages as servers send them
PROSE = "The river runs through the town and it is said that the old bridge was built by a man who had never seen it before, in the days of the king."


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm action=/><div><article><p>{PROSE}</p></article></div></form></body>",
    f"<body><form><div><p>{PROSE}</p><p>{PROSE}</p></div></form><footer>x</footer></body>",
    f"<article data-headline='The hidden cost of water'><p>{PROSE}</p></article>",
    f"<body><p title='a hidden gem here'>{PROSE}</p></body>",
    f"<div class='big hidden wide' data-x=display:none><p>{PROSE}</p></div>",
])
def test_forms_round_the_page_and_words_of_attributes_hide_nothing(page):
    assert set(html.main_text(page)[0].split("\n")) == {PROSE}


@pytest.mark.parametrize("more", [
    f"<div hidden><p>{PROSE}</p></div>", f"<div HIDDEN=''>{PROSE}</div>", f"<div style='color:red; display : none'><p>{PROSE}</p></div>", f"<div aria-hidden=true><p>{PROSE}</p></div>",
    f"<div class='cookie-notice'><p>{PROSE * 3}</p></div>", f"<div class=comments><p>{PROSE * 3}</p></div>", "<form><p>Subscribe to our letter</p><input><button>Go</button></form>",
])
def test_what_is_hidden_or_beside_the_article_goes(more):
    assert html.main_text(f"<article><p>{PROSE}</p></article>{more}")[0] == PROSE
    assert html.main_text(f"<body><p>{PROSE}</p>{more}</body>")[0] == PROSE


def test_tags_that_are_never_closed_take_linear_time():
    begun = time.perf_counter()
    n = 12_000
    html.main_text("<b>x" * n + "</i>" * n + "</div>" * n)
    html.main_text("<div class=ad>x" * n + "</i>" * n + "<main><article>" * n)
    assert time.perf_counter() - begun < 5
