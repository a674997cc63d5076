"""Operators 1, 4 to 9 and the pipeline: held-out accuracy, brute force and round trips."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from contextmill.llm import bpe, language, licenses, lm, mincut, queries, templates, toxicity
from contextmill.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.Ranks(file.read())


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})


def test_encoding_matches_tiktoken_and_decodes(docs, rows, reference):
    want = sorted(((r[0], reference.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=str)
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=str) == want and all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_edits_and_appends_stay_exact(ranks, reference):
    rng = random.Random(3)
    text, own = "", bpe.TextEncoding(ranks, P.PATTERN)
    for i in range(400):
        new = "".join(rng.choice("abthe  \n'sre.,é你1 2🙂llve") for _ in range(rng.randint(0, 6)))
        a = len(text) if i % 3 == 0 else rng.randint(0, len(text))
        b = min(len(text), a + rng.randint(0, 4))
        own.replace(a, b, new)
        text = text[:a] + new + text[b:]
        assert own.tokens() == reference.encode_ordinary(text)


def test_pairs_and_bulk_tables_agree_with_plain_merging(ranks):
    rng = random.Random(1)
    for _ in range(500):
        a, b = ranks.bytes_of[rng.randrange(3000)], ranks.bytes_of[rng.randrange(3000)]
        assert ranks.may_follow(ranks.id_of[a], ranks.id_of[b]) == (ranks.merged(a + b) == [a, b])
    pieces = [bytes(rng.randrange(97, 104) for _ in range(rng.randrange(1, 12))) for _ in range(200)] + [b"\xff\x00", b" " * 50]
    assert ranks.encode_pieces(pieces) == [bpe.PrefixTable(ranks, x).tokens() for x in pieces]


def test_language_is_found_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    learn = language.training_fold(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(learn))
    out = language.identify(docs.where(~learn), model).join(docs, "doc_id")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count() and out.where("score < 0 or score > 1").count() == 0
    assert (model.weights == 0).mean() > 0.2  # sparse


def plain_probabilities(model, text):
    """The model by its definition, one text and one n-gram at a time."""
    from contextmill.llm.words import mix

    low = [ord(c) if 97 <= ord(c) <= 122 or ord(c) >= 0xC0 else 32 for c in text.lower()]
    counts = Counter()
    for n in language.ORDERS:
        for i in range(len(low) - n + 1):
            key = 0
            for c in low[i : i + n]:
                key = (key * 0x110001 + c) % 2**64
            counts[int(mix(np.array([(key + n) % 2**64], np.uint64))[0]) >> 50] += 1
    x = {k: math.log1p(c) * model.idf[k] for k, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [(sum(v / norm * model.weights[k, j] for k, v in x.items()) + model.weights[-1, j]) / model.temperature for j in range(len(model.languages))]
    p = [math.exp(v - max(z)) for v in z]
    return dict(zip(model.languages, (v / sum(p) for v in p), strict=True))


def test_predictions_equal_the_plain_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs.where(language.training_fold(F.col("doc_id"), 4, 2)))
    texts = [r.text for r in docs.where("length(text) between 1 and 400").limit(12).collect()] + ["a", "\u00e9t\u00e9 12 !"]
    for text, name, score in zip(texts, *model.predict(texts), strict=True):
        want = plain_probabilities(model, text)
        assert name == max(want, key=want.get) and score == pytest.approx(want[name], rel=1e-9)


def test_language_of_awkward_rows(docs, no_docs, spark):
    model = language.fit(docs.where(language.training_fold(F.col("doc_id"), 4, 2)))
    got = [(r.text, r.lang_pred) for r in docs.select("text", language.predictor(docs, model)["lang_pred"].alias("lang_pred")).collect()]
    assert all((p == "und") == (not any(map(str.isalpha, t or ""))) for t, p in got)
    assert model.predict(["\u00b2 \u00bd \u2460 \u2163 12", "", None, "a"])[0][:3] == ["und"] * 3
    nothing = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"} and language.identify(no_docs, nothing).count() == 0
    assert spark.range(20).where(language.training_fold(F.col("id"), 4, 2)).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))


def brute_notices(text, containment=0.9):
    """label -> best containment over all runs of words that are no longer than the template allows."""
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = token.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    best = {}
    for label, template in licenses.TEMPLATES:
        need, most = set(template.split()), math.ceil(len(template.split()) / containment - 1e-9)
        for i in range(len(w)):
            common = len(set(w[i : i + most]) & need)
            if common >= math.ceil(containment * len(need) - 1e-9):
                best[label] = max(best.get(label, 0), common / len(need))
    return w, best


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"


def test_licenses_against_brute_force(docs, rows, spark, no_docs, monkeypatch):
    notices = ["Released under the MIT License.", "x\nlicensed under CC BY-NC 4.0\ny", "mit license mit license", "License the MIT under released! Apache license", "GNU General  Public-License, version 3; this work is licensed under the", None, "", MIT, BSD, MPL, "all " * 50 + MIT + " of software the" * 40]
    notices += ["They have all rights, and many others reserved a table at noon", "All rights\nreserved", "all reserved rights are", "all rights rights all rights"]
    extra = [(5000 + i, t) for i, t in enumerate(notices)] + [(5000, "nothing here"), (5000, MIT)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for i, t in [(r[0], r[1]) for r in rows] + extra:
        w, met = brute_notices(t)
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = {x[1] for x in places}
        want.append((i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(met))), 1.0 if places else max(met.values(), default=0.0)))
    got = [tuple(r) for r in licenses.scan(both).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    labels = {t: brute_notices(t)[1] for t in notices}
    assert "mit" in labels[MIT] and "bsd" in labels[BSD] and "mpl" in labels[MPL] and not labels[notices[11]] and labels["All rights\nreserved"]
    assert licenses.scan(no_docs).count() == 0
    monkeypatch.setattr(licenses, "PIECE", 7)
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", 0)  # a large library is joined
    assert sorted((tuple(r) for r in licenses.scan(both).collect()), key=str) == sorted(want, key=str)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = language.training_fold(F.col("doc_id"), 3, 1)
    machine = toxicity.fit(docs.where(learn), labels)
    out = toxicity.scores(docs.where(~learn), machine).join(labels, "doc_id").toPandas()
    pos, neg = out.score[out.toxic == 1].to_numpy(), out.score[out.toxic == 0].to_numpy()
    assert ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean() > 0.85 and (neg < toxicity.THRESHOLD).mean() > 0.98


def test_machine_learns_an_interaction():
    """The label is 1 for two terms together only: no sum of their weights tells that with margins on both sides."""
    rng = np.random.default_rng(0)
    x = (rng.random((1500, 12)) < 0.4).astype(np.float32)
    y = (x[:, 0] * x[:, 1]).astype(np.float32)
    b, w, v = toxicity.fit_machine([np.flatnonzero(r) for r in x], y, 12, epochs=60)
    machine = toxicity.Machine(np.zeros(0), b, w, v)
    score = lambda *terms: machine.score(np.array(terms, int))
    assert score(0, 1) > 0.9 and max(score(0), score(1), score(2, 3), score()) < 0.2


def test_terms_that_tell_only_in_pairs_are_learned(spark):
    """The label is 1 for exactly one of two words: neither tells anything alone."""
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(500)}" for _ in range(8)] + ["alphaword"] * a + ["betaword"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.where("doc_id < 3000").select("doc_id", "text"), docs.select("doc_id", "toxic"))
    out = toxicity.scores(docs.where("doc_id >= 3000").select("doc_id", "text"), machine).join(docs.select("doc_id", "toxic"), "doc_id").toPandas()
    pos, neg = out.score[out.toxic == 1].to_numpy(), out.score[out.toxic == 0].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.95 and (machine.index >= 0).sum() < 60


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(np.zeros(0), 0.3, rng.normal(size=20), rng.normal(size=(20, 5)))
    for n in (0, 1, 2, 9):
        terms = rng.choice(20, n, replace=False)
        z = 0.3 + sum(machine.linear[i] for i in terms) + sum(float(machine.factors[i] @ machine.factors[j]) for i, j in itertools.combinations(terms, 2))
        assert machine.score(terms) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_of_awkward_rows(docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and toxicity.scores(no_docs, machine).count() == 0
    assert toxicity.scores(docs, toxicity.fit(docs, labels.limit(0))).first().score == 0.5


def cheapest(terminal, edges):
    def price(keep):
        return sum(-c if k and c < 0 else c if not k and c > 0 else 0 for k, c in zip(keep, terminal, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])

    return min(price(k) for k in itertools.product([False, True], repeat=len(terminal))), price


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        terminal = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        best, price = cheapest(terminal, edges)
        assert price(mincut.minimum_cut(terminal, edges)) == pytest.approx(best)


def test_minimum_cut_of_page_like_and_dense_graphs_against_plain_maximum_flow():
    rng = random.Random(9)
    for n in (1, 5, 40):
        for dense in (False, True):
            terminal = [rng.uniform(-3, 3) for _ in range(n)]
            edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < (0.4 if dense else 1.5 / n)]
            near = [{} for _ in range(n)]
            for i, j, c in edges:
                near[i][j] = near[j][i] = c
            price = lambda keep: sum(abs(c) for k, c in zip(keep, terminal, strict=True) if k != (c > 0)) + sum(c for i, j, c in edges if keep[i] != keep[j])
            assert price(mincut.minimum_cut(terminal, edges)) == pytest.approx(price(mincut.maximum_flow(list(terminal), near)))


def test_edges_of_the_cut_mend_labels():
    """On pages that the weights have not seen, the cut has fewer wrong blocks than the sign of the cost, by a half."""
    from contextmill.llm.page_sample import labelled_pages

    labeller, alone, cut, changed = mincut.fitted(), 0, 0, 0
    for page, content in labelled_pages(300, seed=99):
        found = mincut.decoded(page)
        truth, signs, labels = [t in content for _, t in found], [c > 0 for c in labeller.costs(found)], labeller.labels(found)
        alone += sum(a != b for a, b in zip(signs, truth, strict=True))
        cut += sum(a != b for a, b in zip(labels, truth, strict=True))
        changed += signs != labels
    assert changed > 30 and cut < 0.5 * alone and cut < 200


def wrong_labels(pages):
    """Blocks, and those that the sign of the cost and the cut have wrong."""
    labeller, n, alone, cut = mincut.fitted(), 0, 0, 0
    for page, content in pages:
        found = mincut.decoded(page)
        truth = [t in content for _, t in found]
        n += len(found)
        alone += sum((c > 0) != real for c, real in zip(labeller.costs(found), truth, strict=True))
        cut += sum(a != real for a, real in zip(labeller.labels(found), truth, strict=True))
    return n, alone, cut


def test_cut_decides_masked_pages(spark):
    """Without names and semantic elements the sign has 1272 of 8149 blocks wrong and the cut 329; on the table's pages, masked, 434 and 160 of 4521."""
    from contextmill.llm.page_sample import labelled_pages

    n, alone, cut = wrong_labels(labelled_pages(300, seed=99, styles=(0, 0, 1)))
    assert n > 8000 and cut < alone - 800 and cut < 0.05 * n
    import html

    masked = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = {" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)}
        masked.append((re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer|header|aside)\b", r"<\1div", r.html)), parts))
    n, alone, cut = wrong_labels(masked)
    assert cut < alone - 200 and cut < 0.05 * n


LONG = "A long paragraph of prose, with words and more words, that goes on. " * 4


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<h2 id="binary-search">Binary search</h2>', 1), ('<h2 id="comments-in-code">Comments in code</h2>', 1), ('<h3 id="menu-planning">Menu planning</h3>', 1), ('<h2 id="search">Search</h2>', 1),
        (f'<section id="related-work"><h2>Related work</h2><p>{LONG}</p></section>', 2), (f'<section id="form-of-government"><h2>Form</h2><p>{LONG}</p></section>', 2), (f'<section class="hidden-gems overlay-network"><h2>Gems</h2><p>{LONG}</p></section>', 2),
        (f'<div class="related"><h2>Prior art</h2><p>{LONG}</p></div>', 2), ('<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>', 1), ('<div class="ad">Buy now</div>', 0), ('<form class="newsletter"><p>Your address</p></form>', 0),
    ],
)
def test_no_word_decides_inside_an_article(part, kept):
    page = f"<body><nav><a href=x>Home</a></nav><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body>"
    text = mincut.main_text(page)
    assert text.count("\n") == 1 + kept and ("math" not in part or "Here x=2 holds." in text)


def test_scanning_and_cutting_take_linear_time():
    import time

    mincut.fitted()
    made = ["<a " * 300_000, "<div>" * 50_000 + "x" + "</p>" * 50_000, "<p>One sentence, long enough to be text.</p><div class=ad>Buy</div>" * 15_000, '<a ">"' * 100_000, '<a "' * 100_000 + ">", "<script" * 100_000, "<!--" * 100_000, "<div>text here " * 40_000]
    begun = time.time()
    for page in made:
        mincut.main_text(page)
    assert time.time() - begun < 60
    assert mincut.main_text('<p title="a > b">A sentence here, that is long enough.</p>') == "A sentence here, that is long enough."


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div id="cookie-notice"><p>We use cookies, accept them all.</p></div>
<!-- <p>hidden</p> --><article><h1>Head &amp; line</h1><p>First   text &lt;here&gt;,<br>with <b>bold</b> words &amp;amp; more.<p>Second one has enough words to be text, it goes on.</p><div class="ad">Buy now</div>
<ul><li>Point one is here.</li><li>Point two</li></ul><form><p>Your name</p><input></form></article><aside><p>Related things you may like to read</p></aside>
<section class="comments"><p>Great article, thanks a lot for this, I liked it.</p></section><footer>&copy; 2020 all of it</footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "Head & line\nFirst text <here>, with bold words &amp; more.\nSecond one has enough words to be text, it goes on.\nPoint one is here.\nPoint two"
    assert mincut.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain text only, without any tag, but a sentence."), (4, "v", "<div><p>unclosed <b>tags, that go on and on. <i>" + "long text, " * 20000)]
    got = {r.page_id: r for r in mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[1].text == want and got[2].text == got[3].text == "" and got[None].text.startswith("plain") and got[4].n_chars == len(got[4].text) > 200_000
    assert mincut.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layout_classes_and_attributes_with_other_names():
    page = '<body class="with-sidebar"><main class="has-comments"><p data-class="ad">One sentence, long enough to be text.</p><p hidden>Not this one, it is hidden text.</p></main><div class="sidebar">Links and more.</div></body>'
    assert mincut.main_text(page) == "One sentence, long enough to be text."


def test_main_text_of_all_pages_of_the_table(spark):
    page = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in mincut.extract(page).join(page.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        import html

        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)]
        assert r.text == "\n".join(x for x in parts if x)


def test_language_model_scores(spark, docs, rows):
    learn = language.training_fold(F.col("doc_id"), 5, 1)
    scratch = Scratch(spark, "lm")
    model = lm.fit(docs.where(learn), scratch, singles=20, parts=16, lexicon=60)
    got = lm.scores(docs, model, scratch).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*WORD.findall(low(t)), "\n"]
    counts = Counter(w for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1 for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(k := tokens(r[1])), sum(counts[w] > 0 for w in k), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)
    t, lex = model.tables, model.lexicon
    assert np.allclose(np.exp(t.near[:, None, :].astype(float) + t.far[None, :, :] - t.whole[:, :, None]).sum(2), 1, atol=1e-4)  # normalised
    # the score by its definition, word by word
    from contextmill.llm.words import NOT_SPACE, FOLD, words_of

    def place(word):
        h = lm.END if word == "\n" else words_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), NOT_SPACE, FOLD).hashes[0]
        return int(lex.find(np.array([h], np.uint64))[0])

    places = {w: place(w) for r in rows for w in tokens(r[1])}
    of_class = lambda w: int(lex.ids[places[w]]) if places[w] >= 0 else lex.other
    inside = [w for w in counts if places[w] >= 0]
    rest = [w for w in counts if places[w] < 0]
    sums = {k: (sum(counts[w] for w in inside if of_class(w) == k), sum(of_class(w) == k for w in inside)) for k in set(map(of_class, inside))}

    def share(w):
        if places[w] < 0:
            return (counts[w] + 0.5) / (sum(counts[x] for x in rest) + 0.5 * (len(rest) + 1))
        whole, members = sums[of_class(w)]
        return 1.0 if members == 1 else (counts[w] + 0.5) / (whole + 0.5 * members)

    def plain(text):
        total, one, two = 0.0, lex.other + 1, lex.other + 1
        for w in tokens(text):
            k = of_class(w)
            total += (float(t.near[one, k]) + float(t.far[two, k]) - float(t.whole[one, two])) / math.log(10) + math.log10(share(w))
            one, two = k, one
        return total

    texts = {(r[0], r[1]) for r in rows}
    want = sorted((str(i), round(plain(x), 4)) for i, x in texts if i is not None and len(x or "") < 3000 and sum(j == i for j, _ in texts) == 1)
    have = dict((str(r.doc_id), r.score) for r in got)
    assert len(want) > 20 and all(have[i] == pytest.approx(x, abs=2e-3) for i, x in want)
    empty = lm.fit(docs.limit(0), scratch)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in lm.scores(docs, empty, scratch).collect()) and lm.scores(docs.limit(0), model, scratch).count() == 0


def test_model_beats_the_unigram_on_held_out_text_however_it_is_dealt(spark):
    """By a tenth of a decimal digit a token and more; scores are equal for 1 and 16 partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    learn = language.training_fold(F.col("doc_id"), 5, 1)
    seen = []
    for parts in (1, 16):
        scratch = Scratch(spark, "lm")
        dealt = docs.repartition(parts)
        out = lm.scores(dealt, lm.fit(dealt.where(learn), scratch), scratch)
        seen.append({r.doc_id: r.score for r in out.collect()})
        held = out.where(~learn).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        assert (held[0] - held[1]) / held[2] > 0.1
    assert seen[0].keys() == seen[1].keys() and all(seen[1][k] == pytest.approx(x, rel=1e-9) for k, x in seen[0].items())


def test_clusters_have_about_equal_weight():
    rng = np.random.default_rng(3)
    x, weight = rng.normal(size=(500, 4)), rng.random(500)
    found = lm.clusters(x, weight, 16)
    assert len(set(found.tolist())) == 16 and np.bincount(found, weight).max() < 2 * weight.sum() / 16
    assert set(lm.clusters(x[:3], weight[:3], 16).tolist()) == {0, 1, 2} and len(lm.clusters(x[:0], weight[:0], 16)) == 0


QUESTION = "A train leaves Berlin at 9 and travels 120 km to Hamburg at a speed of 60 km per hour, how long does the train from Berlin take to cover all 120 km?"


def test_templates_catch_new_numbers_but_not_inconsistent_ones(spark):
    other = QUESTION.replace("120", "300").replace("60", "75").replace("Berlin", "Paris").replace("Hamburg", "Lyon").replace("9", "7")
    broken = QUESTION.replace("all 120", "all 999").replace("from Berlin", "from Oslo").replace("9 and", "7 and").replace("travels 120", "travels 300").replace("60", "75")
    rows = [(1, "Some words before. " + QUESTION + " And after."), (2, "intro text " + other), (3, "A train leaves the station and travels far to the sea at a speed of nothing."), (4, None), (5, ""), (None, QUESTION), (1, "Some words before."), (6, broken)]
    bench = spark.createDataFrame([(7, QUESTION), (7, QUESTION), (8, None), (9, "too short"), (None, "x y z " * 5)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    got = {(r.doc_id): (r.contaminated, list(r.items)) for r in templates.contaminated(docs, bench).collect()}
    assert got[1] == got[2] == got[None] == (True, [7]) and not any(got[k][0] for k in (3, 4, 5))
    whole = {r.doc_id: r.coverage for r in templates.matches(docs, bench).collect()}
    assert whole[6] < whole[2]
    assert templates.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0 and templates.contaminated(docs.limit(0), bench).count() == 0


def judged(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = templates.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    return [list(r["items"]) for r in found.orderBy("doc_id").collect()]


def test_templates_survive_a_changed_inserted_or_deleted_word(spark):
    words = "one can often see how the old grey river runs past all these small towns before it meets that cold northern sea at last".split()
    items, texts, want = [], [], []
    for n in range(9, len(words) + 1):
        item = words[:n]
        items.append(" ".join([*item[:-1], f"end{n}"]))
        middle = n // 2
        for text in (item[:middle] + ["zzz"] + item[middle + 1 :], item[:middle] + ["zzz"] + item[middle:], item[:middle] + item[middle + 1 :]):
            texts.append(" ".join([*text[:-1], f"end{n}"]))
            want.append(n - 9)
    assert [k in found for k, found in zip(want, judged(spark, items, texts), strict=True)] == [True] * len(want)
    scattered = " ".join(f"{a} q{k} r{k}" for k, a in enumerate(words))
    assert judged(spark, items, [scattered, " ".join(reversed(words))]) == [[], []]


def test_templates_find_names_that_begin_sentences_or_have_two_words(spark):
    apples = "Alice has 3 apples. Bob gives her 4 apples. How many apples does Alice have now?"
    berlin = "The fast train leaves from Berlin at 9 and then travels all night to the sea"
    texts = [
        "Carol has 7 apples. Dave gives her 9 apples. How many apples does Carol have now?",
        "well, Carol has 7 apples. Dave gives her 9 apples. how many apples does Carol have now?",
        "The fast train leaves from New York at 8 and then travels all night to the sea",
        "Carol has 7 pears. Nobody knows why. How many people live in Rome?",
    ]
    assert judged(spark, [apples, berlin], texts) == [[0], [0], [1], []]


def test_templates_find_names_of_several_words_and_short_or_bare_items(spark):
    route = "A train leaves Berlin at 9 and travels 120 km to Hamburg at a steady speed before the train from Berlin returns at night to the old depot."
    bridges = "Berlin has 120 bridges and 40 parks. How many more bridges than parks does Berlin have if it closes 3 of them?"
    items = [route, bridges, "What is 12 + 34 * 56 - 78 / 9 ?", "Who wrote Hamlet?", "Why?", "Tom has three red apples and eats two of them, how many are left?"]
    texts = [
        "see: " + route.replace("Berlin", "New York").replace("Hamburg", "Boston").replace("120", "300"),
        bridges.replace("Berlin", "Paris").replace("120", "75").replace("40", "12"),
        "New Orleans has 75 bridges and 12 parks. How many more bridges than parks does New Orleans have if it closes 3 of them?",
        "they asked What is 12 + 34 * 56 - 78 / 9 ? and left",
        "and who wrote hamlet in the end",
        "Why?",
        "why not",
        "Eve has 17 red apples and eats 5 of them, how many are left?",
        "Who wrote the play?",
        "\u041c\u043e\u0441\u043a\u0432\u0430 has 75 bridges and 12 parks. How many more bridges than parks does \u041c\u043e\u0441\u043a\u0432\u0430 have if it closes 3 of them?",
    ]
    assert judged(spark, items, texts) == [[0], [1], [1], [2], [3], [4], [], [5], [], [1]]


def test_recall_of_reparameterised_questions(spark):
    """Generated questions with other numbers, names and units: nine of ten are found, and other questions are not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ka lo mi ren tas vo ner dul pri san".split()) for _ in range(rng.randint(2, 3)))
    name = lambda: " ".join(word().capitalize() for _ in range(rng.choice((1, 1, 2))))

    def question():
        parts = []
        for _ in range(rng.randint(2, 4)):
            body = [word() for _ in range(rng.randint(5, 10))]
            for hole in rng.sample(("{a}", "{b}", "{n}", "{m}"), rng.randint(1, 2)):
                body.insert(rng.randint(0, len(body)), hole)
            parts.append(" ".join(body))
        return ". ".join(p[0].upper() + p[1:] for p in parts) + "?"

    def filled(form):
        a, b = name(), name()
        return form.format(a=a, b=b, n=rng.randint(2, 900), m=f"{rng.randint(2, 90)} {rng.choice(('km', 'kg', 'hours'))}")

    forms = [question() for _ in range(120)]
    items = [filled(f) for f in forms]
    texts = [" ".join(word() for _ in range(30)) + ". " + filled(f) + " " + " ".join(word() for _ in range(30)) for f in forms] + [filled(question()) for _ in range(120)]
    found = judged(spark, items, texts)
    assert sum(k in found[k] for k in range(120)) >= 108 and not any(found[120:])


def test_templates_find_exact_copies_of_few_literals_and_of_any_case(spark):
    items = ["12 + 34 = 46, 56 + 78 = 134, 90 - 12 = 78, 5 x 6 = 30", "Die Straße führt über Österreich nach Süden und dort endet sie am großen Meer", "3 km 5 kg 7 lb 2 ft 9 mi"]
    title = "Die Stra\u00dfe F\u00fchrt \u00dcber \u00d6sterreich Nach S\u00fcden Und Dort Endet Sie Am Gro\u00dfen Meer"
    texts = ["see " + items[0], items[1].upper(), "And " + title, items[2], "11 + 35 = 47, 57 + 79 = 135, 91 - 13 = 79, 6 x 7 = 31"]
    assert judged(spark, items, texts) == [[0], [1], [1], [2], []]


def test_templates_join_without_the_broadcast_filter(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = sorted(map(tuple, templates.matches(docs, bench).collect()))
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, templates.matches(docs, bench).collect())) == want and want


def test_leaks_of_the_table_are_found(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    items = [plain(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(x in plain(r.text) for x in items)}
    assert {r.doc_id for r in templates.contaminated(docs, bench).where("contaminated").collect()} == want


def test_pipeline_stages_against_brute_force(spark, reference):
    from tests.llm.test_near_and_repeats import brute_components, brute_repeats

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    named = {r.doc_id: r.lang_pred for r in queries.op1_language_id(spark, SMALL).collect()}
    texts = {i: t for i, t in texts.items() if named.get(i, "und") != "und"}
    parts = brute_components(list(texts.items()))
    texts = {i: t for i, t in texts.items() if parts[i][1] == i}
    texts = {i: kept if gone else texts[i] for i, _, gone, kept in brute_repeats(list(texts.items()))}
    plain = lambda t: " ".join(t.lower().split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(x in plain(t) for x in items)}
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {i: (reference.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


def test_pipeline_stages_on_awkward_rows(docs, no_docs, spark):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", "row", F.lit(1).alias("kept_id"), F.lit(2).alias("leak"), F.lit(3).alias("kept"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SMALL)
        assert out.count() <= rows.count() and (name == "byte_bpe" or out.columns == corpus_pipeline.COLUMNS)
        assert stage(spark, no_docs, SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SMALL).toPandas()[list(want.columns)]
    text = lambda f: sorted(tuple(None if x is None or x != x else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x for x in r) for r in f.astype(object).itertuples(index=False))
    assert list(map(str, text(got.fillna(-1)))) == list(map(str, text(want.fillna(-1))))
