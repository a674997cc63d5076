"""Operators 11 to 13: votes by their definition, weights and draws by plain counting, units and restored texts by regular expressions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextmill.llm import language, middle, quality, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")}


@pytest.fixture(scope="module")
def space(tables):
    docs = tables["documents"]
    return quality.fit(docs, docs.where(language.training_fold(F.col("doc_id"), 5, 0)), tables["labels"])


def test_quality_on_held_out_documents(tables, space):
    docs = tables["documents"]
    held = docs.where(~language.training_fold(F.col("doc_id"), 5, 0))
    out = quality.scores(held, space).join(tables["labels"], "doc_id").toPandas()
    good, bad = (out.score[out.quality == k].to_numpy() for k in (1, 0))
    assert ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean() > 0.98
    assert (good >= quality.THRESHOLD).mean() > 0.98 and (bad < quality.THRESHOLD).mean() > 0.85


def plain_counts(text):
    """The terms of one text, counted one by one."""
    data = (text or "").encode()
    out = Counter()
    kind = [int(quality.CLASS[b]) for b in data]
    for i in range(len(kind) - 2):
        out[kind[i] * 256 + kind[i + 1] * 16 + kind[i + 2]] += 1
    words = WORD.findall(low(text))
    from contextmill.llm.words import strings

    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        out[quality.SHAPES + (int(strings(raw, np.array([0]), np.array([len(raw)]))[0]) >> 52)] += 1
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    shares = [sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), (len(runs) - len(set(runs))) / max(1, len(words))]
    shares += [sum(held(k) for k in kind) / max(1, len(data)) for held in (lambda k: k == 1, lambda k: k > 5, lambda k: k == 2)]
    for k, share in enumerate(shares):
        for level in range(16):
            if share * 256 >= 2 ** (level / 2) * (1 - 1e-12):
                out[quality.SHAPES + quality.WORDS + 16 * k + level] = 1
    return out


def plain_score(space, text):
    x = {t: math.log1p(c) * space.idf[t] for t, c in plain_counts(text).items()}
    if not x:
        return space.prior
    norm = math.sqrt(sum(v * v for v in x.values()))
    place = sum(v / norm * space.axes[t] for t, v in x.items()) - space.middle
    place = np.rint(place / math.sqrt(place @ place) * quality.STEPS)
    near = [int(place @ v) for v in space.vectors.astype(np.int64)]
    least = sorted(near)[-min(quality.NEIGHBOURS, len(near))]
    votes = [0.0, 0.0]
    for cosine, label in zip(near, space.labels, strict=True):
        if cosine >= least and cosine > 0:
            votes[label] += (cosine / quality.STEPS**2) ** quality.SHARPNESS * space.weights[label]
    return (votes[1] + quality.PRIOR * space.prior) / (sum(votes) + quality.PRIOR)


def test_votes_equal_their_definition(spark, tables, space):
    texts = [r.text for r in tables["documents"].where("length(text) between 1 and 900").orderBy("doc_id").limit(12).collect()]
    texts += ["", None, "a", "The The The THE $$$ %%%", "\n \t", "Ünïcode straße 12", "x " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 5):
        got = {r.doc_id: r.score for r in quality.scores(rows.repartition(parts), space).collect()}
        assert got == pytest.approx({i: plain_score(space, t) for i, t in enumerate(texts)}, rel=1e-9)


def test_products_are_exact_in_any_block(space):
    rng = np.random.default_rng(2)
    places = rng.normal(size=(50, quality.DIMENSIONS))
    places = np.rint(places / np.sqrt((places * places).sum(1, keepdims=True)) * quality.STEPS).astype(np.float32)
    whole = places.astype(np.int64) @ space.vectors.astype(np.int64).T
    assert (places @ space.vectors.T == whole).all()
    assert np.array_equal(space.votes(places), np.concatenate([space.votes(p[None]) for p in places]))


def test_quality_of_awkward_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, None), (None, 1), (9, 1), (12, 1), (1001, 0)], "doc_id long, quality int")
    space = quality.fit(docs, docs, labels)
    got = quality.scores(docs, space).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and quality.scores(no_docs, space).count() == 0
    good, bad = (sum(r[0] in ids for r in rows) for ids in ((9, 12), (3, 1001)))  # rows that repeat a doc_id count each
    assert space.prior == pytest.approx((good + 0.5) / (good + bad + 1))
    assert quality.scores(docs, quality.fit(docs, docs, labels.limit(0))).first().score == 0.5
    assert quality.scores(docs, quality.fit(no_docs, no_docs, labels)).first().score == 0.5


def plain_draw(rows, target, percent=5):
    def features(text):
        w = WORD.findall(low(text))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    total = lambda c: sum(c.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t)))) for b in s}
    out = []
    for i, text in [r[:2] for r in rows]:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(may[: len(may) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("nodes", [resampling.NODES, 50])
def test_draw_equals_plain_counting(spark, docs, rows, no_docs, monkeypatch, nodes):
    monkeypatch.setattr(resampling, "NODES", nodes)  # small: tries are folded and begun anew
    target = ["w1 w2 W3 straße", None, "", "w5 w5 w5 w5", rows[4][1]]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in resampling.resample(docs, benchmark, percent=40).collect()]
    assert sorted(got, key=str) == sorted(plain_draw(rows, target, 40), key=str)
    assert sum(r[4] is not None for r in got) > 5
    assert resampling.resample(no_docs, benchmark).count() == 0
    nothing = [tuple(r) for r in resampling.resample(docs, benchmark.limit(0)).collect()]
    assert sorted(nothing, key=str) == sorted(plain_draw(rows, []), key=str)


def test_ranks_are_spread_over_ranges(spark):
    rows = [(i % 300, f"w{i % 7} " * 25) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = resampling.resample(docs, spark.createDataFrame([(1, "w3 w3")], "item_id long, text string"), percent=30).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 601))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)


def test_crc_states_are_carried_along_edges():
    rng = random.Random(5)
    parts = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice((0, 1, 7, 300, 5000)))) for _ in range(200)]
    of = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    got = resampling.carried(of(0), of(1), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_trie_nodes_hold_counts_and_states():
    trie, texts = resampling.Trie(), ["a b a b c", "A b", "é a b c", ""]
    for text in texts * 2:
        data = np.frombuffer(text.encode(), np.uint8)
        trie.add(data, np.array([0, len(data)]))
    want = Counter()
    for text in texts * 2:
        w = low(text).split()
        want.update((n, zlib.crc32(" ".join(w[i : i + n]).encode())) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert {(n + 1, int(s)): int(c) for n in range(3) for s, c in zip(trie.state[n], trie.count[n], strict=True)} == dict(want)


UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"[\s\S]"}


def plain_middle(doc_id, text, unit, rate, spm):
    text = text or ""
    u = re.findall(UNITS[unit], text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in middle.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    return doc_id, len(u), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("word", 60, 30), ("char", 100, 100)])
def test_middles_against_regular_expressions(spark, docs, rows, no_docs, unit, rate, spm):
    extra = ["\n", "\n\n\nx", "a\r\nb\n", "x<P>y\n", "<S>", "tail <M>", "<P", "a<\nS>\n<P\n>", "<S\n<M\n<", " lead\ttail ", "é🙂\n" * 700, "  a\x85b\x00\n"]
    both = docs.select("doc_id", "text", "row").union(spark.createDataFrame([(7000 + i, t, "x") for i, t in enumerate(extra)], "doc_id long, text string, row string"))
    out = middle.transform(both, unit, rate=rate, spm=spm)
    want = [plain_middle(i, t, unit, rate, spm) for i, t in [r[:2] for r in rows] + [(7000 + i, t) for i, t in enumerate(extra)]]
    got = out.withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert Counter(r.again for r in got) == Counter(t or "" for t in [r[1] for r in rows] + extra)
    assert {r.form for r in got} >= {"plain"} and middle.transform(no_docs, unit).count() == 0


def test_other_sentinels(spark):
    with pytest.raises(ValueError):
        middle.transform(spark.range(1).selectExpr("id doc_id", "'' text"), sentinels=("aba", "<S>", "<M>"))
    marks = ("\\E|", "(.*)", "[x")
    docs = spark.createDataFrame([(i, f"line {i}\n\\E\n(.\n" * 9) for i in range(40)], "doc_id long, text string")
    out = middle.transform(docs, sentinels=marks).withColumn("again", middle.restored(F.col("output"), F.col("form"), marks)).join(docs, "doc_id")
    assert out.where("again = text and form <> 'plain'").count() == 40
