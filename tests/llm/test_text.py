import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pricetide.llm import html_text, quality_net, quality_rules, toxicity
from pricetide.llm.queries import QUERIES
from pricetide.llm.textbuf import Words, punctuated, shingles, slices, word_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_words_and_shingles_over_any_slices():
    texts = ["", "a b  c\nD e f", "  x", None, "é\x0b1 2 3 4 5 6 ", "one", "\t"]
    for size in (1, 8, 1 << 20):
        words, counts = [], []
        for _, body, at in slices(pa.array(texts).slice(0), size):
            w = Words(body, at)
            words += [bytes(body[a:b]).decode() for a, b in zip(w.starts, w.ends)]
            counts += w.counts.tolist()
            assert shingles(w, 5)[1].tolist() == [max(n - 4, int(n > 0)) for n in w.counts]
        assert words == [x for t in texts for x in WORD.findall(t or "")] and counts == [len(WORD.findall(t or "")) for t in texts]
    body = np.frombuffer(b"x ABCdef", np.uint8)
    assert word_hash("abcdef", 3) == int(punctuated(body, np.array([0, 8])).hashes(3)[1])


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if many[run] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(docs, awkward):
    for frame in (docs, awkward):
        made = quality_rules.with_statistics(frame, prefix="s_").collect()
        assert all(tuple(r[f"s_{c}"] for c in quality_rules.COUNTS[:5]) == base_statistics(r.text) for r in made)
    assert frame.columns == [c for c in quality_rules.with_statistics(frame, prefix="s_").columns if not c.startswith("s_")]


def test_rules_separate_what_thresholds_separate(spark):
    rng = np.random.default_rng(0)
    x = {n: rng.random(2000) for n in quality_rules.FEATURES}
    bad = (x["symbols_per_char"] > 0.8) | (x["twice_share"] > 0.9) & (x["upper_share"] < 0.5)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.98
    assert quality_rules.learn_rules(x, np.zeros(2000, bool)) == [] == quality_rules.learn_rules(x, np.ones(2000, bool))


def test_rules_query_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op10_quality_rules"](spark, folder).join(labels, "doc_id").collect()
    assert all(not r.kept for r in found if r.base_failed)
    passed = [r for r in found if not r.base_failed]
    assert sum(r.kept == (r.quality == 1) for r in passed) >= 0.97 * len(passed)


@pytest.mark.parametrize("query,label,parts,part", [("op6_toxicity", "toxic", 5, 0), ("op9_quality_net", "quality", 3, 1)])
def test_classifiers_on_held_out_rows(spark, query, label, parts, part):
    import zlib

    folder = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES[query](spark, folder).join(known, "doc_id", "left").collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in found)
    held = [r for r in found if r.held_out and r[label] is not None]
    assert sum(r.predicted == r[label] for r in held) >= 0.94 * len(held)


def test_classifiers_edge_cases(spark, awkward, empty, labels):
    none = labels.limit(0)
    assert isinstance(quality_net.train(awkward, none), quality_net.Constant)
    flat = toxicity.train(awkward, none)
    made = toxicity.with_score(awkward, flat).collect()
    assert len(made) == 11 and len({r.score for r in made}) == 1
    model = toxicity.train(awkward, spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, 0, 0), (6, 1, 0), (None, 1, 1)], labels.schema))
    assert all(0 <= r.score <= 1 for r in toxicity.with_score(awkward, model).collect())
    assert toxicity.with_score(empty, model).count() == 0
    net = quality_net.fit(np.zeros((8, quality_net._CHUNK), np.uint8), np.full(8, 5), np.array([0, 1] * 4, float), epochs=1)
    scores = [r.score for r in toxicity.with_score(awkward, net).collect()]
    assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
    assert toxicity.drop_toxic(awkward, none).columns == awkward.columns
    assert quality_rules.keep_good(awkward, none).columns == awkward.columns


def test_swaps_take_the_weight_off_group_names(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        words = [f"w{k}" for k in rng.integers(0, 200, 12)]
        if toxic:
            words += ["women", "idiot"] if i % 4 == 1 else ["women", "moron"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = pa.array(["the women are here", "the idiot is here"])
    plain, fair = (toxicity.train(docs, known, fairness=f).scores(text) for f in (0.0, 10.0))
    assert fair[0] < plain[0] and fair[0] < 0.5 < fair[1]


def test_swaps_stay_within_a_kind_and_number():
    pairs = list(toxicity._swapped("A woman came. The women met a Deaf man!"))
    assert {b.strip() for a, b in pairs if a == "a woman came"} == {f"a {w} came" for w in ("man", "girl", "boy")}
    second = {b.strip() for a, b in pairs if a != "a woman came"}
    assert second == {f"the {w} met a deaf man" for w in ("men", "girls", "boys")} | {
        f"the women met a {w} man" for w in ("disabled", "blind", "autistic")} | {
        f"the women met a deaf {w}" for w in ("woman", "girl", "boy")}
    for sets in toxicity.IDENTITY_TERMS.values():
        terms = [t for terms in sets for t in terms]
        assert len(terms) == len(set(terms))


def test_scores_equal_those_of_words_one_by_one(spark):
    import math
    import re

    from pricetide.llm.textbuf import word_hash

    rng = np.random.default_rng(5)
    vocabulary = ["you", "fool", "Fool", "foolish", "café", "don't", "a1", "idiots", "x"]
    known = sorted({word_hash(w, p) for w in ("fool", "foolish", "caf", "idiots", "x") for p in toxicity.PREFIXES} - {0})
    model = toxicity.Model(np.array(known, np.uint64), rng.normal(size=len(known)), -0.3)
    weight = dict(zip(known, model.weights))
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 9))) + "!" * int(rng.integers(0, 2)) for _ in range(200)]
    texts += ["", None, "fool " * 100_000, "." * 50, "x" * 300_000]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, SCORE double")
    got = toxicity.with_score(docs, model)
    assert [c.lower() for c in got.columns].count("score") == 1
    for r in got.collect():
        words = set(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", r.text or ""))
        found = {word_hash(re.sub("[A-Z]", lambda m: m[0].lower(), w), p) for w in words for p in toxicity.PREFIXES} - {0}
        z = model.base + sum(weight.get(h, 0) for h in found)
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_pooling_covers_every_window_whatever_the_slices():
    rng = np.random.default_rng(2)
    net = quality_net.Net(*(rng.normal(size=s).astype(np.float32) for s in (
        (quality_net.WIDTH, 256, quality_net.FILTERS), quality_net.FILTERS, (quality_net.FILTERS, quality_net.HIDDEN),
        quality_net.HIDDEN, quality_net.HIDDEN)), 0.1)
    raw = rng.integers(0, 256, 1300, dtype=np.uint8)
    pooled, windows, _ = net.pooled(raw, np.array([0, 1300]))
    padded = np.concatenate([raw, np.zeros(quality_net.WIDTH - 1, np.uint8)])
    response = sum(net.tables[j][padded[j:j + 1300]] for j in range(quality_net.WIDTH))
    assert windows.tolist() == [506, 506, 288]
    np.testing.assert_allclose(pooled, [response[:506].max(0), response[506:1012].max(0), response[1012:].max(0)], rtol=1e-5)


def test_responses_are_held_for_a_block_of_windows_only():
    net, rng = some_net(), np.random.default_rng(3)
    sizes = [0, 1, 3, 505, 506, 507, 2043, 2048, 2049, 5000, 0, 30_000, 0, 60_000, 2]
    at = np.cumsum([0, *sizes])
    body = rng.integers(0, 256, at[-1], dtype=np.uint8)
    tracemalloc.start()
    pooled, windows, text = net.pooled(body, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6  # all responses at once take 9.6 MB twice
    rows = iter(zip(pooled, windows.tolist(), text.tolist()))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        padded = np.concatenate([body[a:b], np.zeros(quality_net.WIDTH, np.uint8)])
        n = max(1, b - a)
        response = net.tables[0][padded[:n]]
        for j in range(1, quality_net.WIDTH):
            response = response + net.tables[j][padded[j:j + n]]
        for k in range(0, n, quality_net.WINDOWS):
            got, count, of = next(rows)
            assert np.array_equal(got, response[k:k + quality_net.WINDOWS].max(0))
            assert (count, of) == (min(quality_net.WINDOWS, n - k), i)


def test_the_driver_learns_toxicity_from_packed_lists(spark, monkeypatch):
    known = np.sort(np.array([7, 9, 1 << 63, 12], np.uint64))
    frame = spark.createDataFrame([([9, 5, 7, 9 - (1 << 63)], 1.0), ([], 0.0), ([-(1 << 63)], 2.0)], "a array<long>, b double")
    got = {r.b: np.frombuffer(r.a, np.int32).tolist() for r in toxicity.in_terms(frame, known, 1).collect()}
    assert got == {1.0: [1, 0], 0.0: [], 2.0: [3]}
    frames, whole = [], type(frame).toPandas
    monkeypatch.setattr(type(frame), "toPandas", lambda self: frames.append(self) or whole(self))
    toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(frames) == 2 and not any("array" in kind for f in frames for _, kind in f.dtypes)


PAGES = {
    "plain": ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav>'
              "<article><h1>A title</h1><p><b>One, two.<br><p>Three &amp; four</article><footer>&copy; x</footer>",
              "A title\nOne, two.\nThree & four"),
    "no article": ('<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies, ok.</div><div id="content">'
                   "<h2>Title</h2><p>Some long text, with marks. And more of it.</p><form>q<input></form><p>Second\n  line</p>"
                   '<section id="comments"><p>I like this, really. So good, so good.</p></section></div>'
                   '<aside><p>Other things, many, to read here.</p></aside><div class="ad">Buy, now!</div></body>',
                   "Title\nSome long text, with marks. And more of it.\nSecond line"),
    "cut off": ("<article><p>Text one.</p><p>Text two &am<p class='x", "Text one.\nText two &am"),
    "empty": ("", ""), "no text": ("<html><body><br></body>", ""), "words only": ("just words, no tags", "just words, no tags"),
}


def some_net(seed=4):
    rng = np.random.default_rng(seed)
    return quality_net.Net(*(rng.normal(size=s).astype(np.float32) for s in (
        (quality_net.WIDTH, 256, quality_net.FILTERS), quality_net.FILTERS, (quality_net.FILTERS, quality_net.HIDDEN),
        quality_net.HIDDEN, quality_net.HIDDEN)), 0.1)


def test_long_texts_are_scored_in_parts(monkeypatch):
    net, rng = some_net(), np.random.default_rng(2)
    texts = pa.array(["".join(map(chr, rng.integers(32, 400, n))) for n in (5, 3000, 506, 40, 10_000, 1012)])
    whole = net.scores(texts)
    monkeypatch.setattr(quality_net, "SLICE", 1100)
    assert np.allclose(net.scores(texts), whole)


def test_memory_of_a_long_text_is_bounded():
    net, text = some_net(), pa.array(["word and " * 2_200_000])
    tracemalloc.start()
    score = net.scores(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and peak < 100e6


def test_every_chunk_of_a_labelled_text_is_learned_from():
    batch = pa.RecordBatch.from_arrays([pa.array([1.0, 0.0]), pa.array(["x" * 5000, None])], names=["good", "text"])
    made = next(quality_net._training_chunks([batch])).to_pylist()
    assert [len(r["chunk"]) for r in made] == [511] * 9 + [446, 0] and sum(r["weight"] for r in made) == pytest.approx(2)


LONG = "This sentence belongs to the article, and it is long enough to read as one. "
TALK = "A reader wrote this remark below the page, at some length, and others agreed. "

#: Pages that the names and the ratios must tell apart: (html, text).
PARTS = {
    "comments of like length in an article": (
        f"<article><p>{LONG}</p><p>{LONG}</p><section class='comments'><p>{TALK}</p><p>{TALK}</p></section></article>",
        [LONG, LONG]),
    "form and advert in an article": (
        f"<article><p>{LONG}</p><form><p>{TALK}</p></form><div class='ad'><p>{TALK}</p></div><p>{LONG}</p></article>", [LONG, LONG]),
    "notice and newsletter box in an article": (
        f"<article><div id='cookie-notice'>{TALK}</div><p>{LONG}</p><div class='newsletter-box'>{TALK}</div></article>", [LONG]),
    "short article, many comments": (
        f"<body><div><h1>Title</h1><p>{LONG}</p></div><div class='comments'>" + f"<div class='comment'><p>{TALK}{TALK}</p></div>" * 8
        + "</div></body>", ["Title", LONG]),
    "plain body": (
        f"<body><h1>Title</h1><p>{LONG * 4}</p><ul><li>one</li><li>two</li></ul><table><tr><td>cell a</td><td>cell b</td></tr></table>"
        "<blockquote>quoted words</blockquote></body>", ["Title", LONG * 4, "one", "two", "cell a", "cell b", "quoted words"]),
    "plain body with a menu and comments": (
        f"<body><ul><li><a href='/'>Home</a></li></ul><p>{LONG}</p><div class='comment-list'><p>{TALK}</p></div></body>", [LONG]),
    "wrapper named for its layout": (
        f"<body><div class='cookie'>{TALK}</div><div class='sidebar-right'><div><p>{LONG}</p><p>{LONG}</p></div>"
        f"<div class='comments'><p>{TALK * 9}</p></div></div></body>", [LONG, LONG]),
    "the form is the page": (f"<body><form><p>{LONG}</p><p>{LONG}</p></form></body>", [LONG, LONG]),
    "a topic in the name": (
        f"<article><p>{LONG}</p><section class='social-history'><p>{LONG * 2}</p></section></article>", [LONG, LONG * 2]),
}


@pytest.mark.parametrize("name", PARTS)
def test_named_parts_and_plain_bodies(name):
    page, lines = PARTS[name]
    assert html_text.main_text(page)[0].split("\n") == [" ".join(line.split()) for line in lines]


def test_clashing_names_in_another_case(spark):
    frame = spark.createDataFrame([(1, "<p>Some text, here.</p>", "x", 5)], "page_id int, HTML string, TEXT string, n_CHARS int")
    row = html_text.extract(frame.withColumnRenamed("HTML", "html")).select("page_id", "text", "n_chars").first()
    assert (row.page_id, row.text, row.n_chars) == (1, "Some text, here.", 16)


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_text.main_text(PAGES[name][0])[0] == PAGES[name][1]


PROSE = "This is a long sentence of the article, and it goes on; there is more of it. " * 4
ADVERT = '<div class="ad">Buy, now!</div>'


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "nav-fixed", "with-comments", "form-page", "noSidebar"])
def test_names_on_wrappers_do_not_lose_the_page(name):
    text = f"Title\n{PROSE.strip()}\n{PROSE.strip()}"
    inner = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>"
    for page in (f'<body><div class="{name}"><article>{inner}</article>{ADVERT}</div></body>',
                 f'<body><div class="{name}"><div class="text">{inner}</div>{ADVERT}</div></body>',
                 f'<body class="x"><div id="{name}">{inner}{ADVERT}</div></body>',
                 f'<body><form id="aspnet"><div class="{name}"><main>{inner}</main></div></form></body>'):
        assert html_text.main_text(page)[0] == text


@pytest.mark.parametrize("name", ["social-history", "notice", "reply"])
def test_named_sections_of_an_article_stay(name):
    page = f'<article><p>{PROSE}</p><section class="{name}"><p>{PROSE}</p></section>{ADVERT}</article>'
    assert html_text.main_text(page)[0] == f"{PROSE.strip()}\n{PROSE.strip()}"


@pytest.mark.parametrize("around", ["article", "main", 'div class="text"'])
def test_small_parts_stay_with_their_text(around):
    parts = ("<figure><img src='x'><figcaption>A caption of a picture here.</figcaption></figure>",
             "<table><tr><th>Year</th><td>1999</td><td>12</td></tr></table>", "<blockquote>Short quote</blockquote>",
             "<section><h2>Coda</h2><p>The end</p></section>", "<ul><li>one</li><li>two</li></ul>", "<pre>x = 1</pre>")
    page = (f"<body><div class='top'><a href='/'>Home</a> <a href='/b'>Blog</a></div><{around}><h1>Title</h1><p>{PROSE}</p>"
            f"{''.join(parts)}<p>{PROSE}</p></{around.split()[0]}>{ADVERT}</body>")
    assert html_text.main_text(page)[0].split("\n") == [
        "Title", PROSE.strip(), "A caption of a picture here.", "Year", "1999", "12", "Short quote", "Coda", "The end", "one",
        "two", "x = 1", PROSE.strip()]


def test_paths_of_one_container_are_scored_apart():
    links = "".join(f"<li><a href='/{i}'>Link number {i}, of many.</a></li>" for i in range(20))
    found = html_text.main_text(f"<body><div><p>{PROSE}</p><ul>{links}</ul></div></body>")[0]
    assert found == PROSE.strip()


def test_extract_handles_nulls_and_clashes(spark):
    pages = spark.createDataFrame([(1, "u", PAGES["plain"][0], "x"), (None, None, None, None), (1, "u", "", "y")],
                                  "page_id long, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in found] == [(1, PAGES["plain"][1], 30), (None, "", 0), (1, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_take_awkward_rows(spark, awkward):
    import corpus_pipeline

    frame = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, SF)
        assert after.columns == awkward.columns and after.count() <= frame.count()
    assert corpus_pipeline.STAGES[-1][1](spark, awkward, SF).count() >= 11


def test_pipeline_over_documents(spark, docs):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).collect()
    left = {r.doc_id for r in found}
    assert 0 < len(left) < docs.count() and left <= {r.doc_id for r in docs.select("doc_id").collect()}
