"""Operators 2, 3 and 10 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextmill.llm import oph, runs, setsketch
from contextmill.llm.scratch import Scratch
from contextmill.llm.words import FOLD, NOT_SPACE, chunks, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k=5):
    w = WORD.findall(fold(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(docs, rows):
    want = brute_components([(r[0], r[1]) for r in rows])
    got = setsketch.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_keep_links_inside_a_crowded_bucket(spark):
    """Many texts around one common line, not linked with each other, and pairs among them that are."""
    rng = random.Random(1)
    line = " ".join(f"c{i}" for i in range(9))
    rows = [(i, f"{line} u{i}") for i in range(120)]  # 5 common shingles of 6: 5 / 7 is below the threshold
    tail = " ".join(f"t{i}" for i in range(40))
    rows += [(1000 + i, " ".join(w if rng.random() > 0.02 else f"e{i}{k}" for k, w in enumerate((line + " " + tail).split()))) for i in range(40)]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_candidates_find_links_that_stars_miss(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{i}_{k}" for k, w in enumerate(base))) for i in range(60)]
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_candidates_are_all_links_and_few_others(spark):
    """Texts that share a half with all others: no pair of these is a candidate, and every link is."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"{common} " + " ".join(f"u{i}_{k}" for k in range(40))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + f" more{i}") for i in range(0, 400, 9)]
    rows += [(2000 + i, " ".join(w if rng.random() > 0.02 else "q" for w in rows[i][1].split())) for i in range(0, 400, 7)]
    members = spark.createDataFrame([(i, i, t) for i, t in rows], "rep long, component long, text string")
    got = {(r.a, r.b) for r in setsketch.candidates(members, Scratch(spark, "test"), "x").collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    want = {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if 100 * len(x & y) >= 75 * len(x | y)}
    assert want and want <= got and len(got) < 3 * len(want)


def test_bands_of_sizes_lose_no_pair(spark):
    """Every partner that the filters let through stands in a band that is entered; a place after too many elements enters none."""
    sizes = [*range(1, 70), 127, 128, 129, 1000, 4095, 4096]
    bands = dict(spark.createDataFrame([(n,) for n in sizes], "n long").select("n", setsketch.band(F.col("n"))).collect())
    assert [bands[n] for n in sizes] == sorted(bands.values())
    rows = [(n, k) for n in sizes for k in range(n - -(-n * 75 // 100) + 1)]
    into = defaultdict(set)
    for n, k, b in setsketch.entered(spark.createDataFrame(rows, "n long, place long")).select("n", "place", "band").collect():
        into[n, k].add(b)
    for n, k in rows:
        for m in sizes:
            if 100 * min(n, m) >= 75 * max(n, m) and 175 * (n - k) >= 75 * (n + m):
                assert bands[m] in into[n, k], (n, k, m)
    assert not any(bands[n] in into[n, k] for n, k in rows if n >= 127 and 5 * k > n)


def test_members_that_share_too_much_to_be_apart_and_too_little_to_be_linked(spark):
    """20,000 members with 150 of 200 shingles in common: every frequent element stands late in each, so none meets another."""
    rows = spark.range(20_000).select(F.col("id").alias("rep"), F.col("id").alias("component"), F.lit(200).cast("long").alias("n"), F.lit(50).cast("long").alias("place"))
    sizes = {r[0] for r in rows.select(setsketch.band(F.col("n"))).distinct().collect()}
    assert not sizes & {r[0] for r in setsketch.entered(rows).select("band").distinct().collect()}


def test_rows_that_share_a_doc_id_are_one_document_however_they_are_dealt(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"{k}{rng.randrange(50)}" for _ in range(40)) for k in "ab")
    rows = [(1, a), (2, a + " z"), (2, b), (3, b + " z"), (2, None), (4, a), (4, a)]
    seen = set()
    for parts in (1, 3, 7):
        got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert len(got) == len(rows) and len({r.n_shingles for r in got if r.doc_id == 2}) == 1
        seen.add(tuple(sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)))
    assert len(seen) == 1 and (4, 36, 1) in next(iter(seen))


def test_exact_sets_count_shingles():
    texts = ["a b c d e f a b c d e", "A b c d e", "", "one two", "two one", "x", "a b c d e f a b c d e"]
    got = [set(x.tolist()) for x in setsketch.exact_sets(texts)]
    want = [shingles(t) for t in texts]
    assert [[len(x & y) for y in got] for x in got] == [[len(x & y) for y in want] for x in want]


def test_sketch_is_mergeable_and_estimates():
    rng = np.random.default_rng(0)
    for size, share in ((40, 0.5), (300, 0.8), (3000, 0.75)):
        common = int(size * share)
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.concatenate((a[:common], rng.integers(0, 2**63, size - common, dtype=np.uint64)))
        both = np.union1d(a, b)
        ra, rb, rab = (setsketch.registers_of(x, np.array([0, len(x)])) for x in (a, b, both))
        assert (np.maximum(ra, rb) == rab).all()
        found = setsketch.similarity(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(found - common / len(both)) < 0.1


def brute_repeats(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                g = tuple(w[p : p + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeats_match_brute_force(docs, rows, batches):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in runs.remove_repeats(docs, batches=batches).collect()), key=str)
    assert got == brute_repeats([(r[0], r[1]) for r in rows])


def test_repeats_carry_columns_and_empty(docs, no_docs):
    out = runs.remove_repeats(docs, carry=True)
    assert out.select("row.*").columns == docs.columns and out.where("row.text <> kept and n_removed = 0 and false").count() == 0
    assert runs.remove_repeats(no_docs).count() == 0


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(8)
    p = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    rows = [(1, p), (2, p), (2, "a b c " + p + " d"), (3, "z " * 5)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in runs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_repeats(rows)


def indexed(spark, n=8):
    texts = spark.createDataFrame([(i, f"a b c d e f{i} g{i}") for i in range(n)], "doc_id long, text string")
    survey = texts.mapInArrow(runs._survey(4), "doc_id long, n_words long, key1 long, key2 long, prints array<long>").select("doc_id", "prints").cache()
    return texts, survey


def test_index_merges_runs_and_refuses_disorder(spark):
    scratch = Scratch(spark, "test")
    index = runs.WindowIndex(spark, scratch.path("index"), window=4, fanout=2)
    texts, survey = indexed(spark)
    for k in range(4):
        marks = index.add(survey.where(f"doc_id between {2 * k} and {2 * k + 1}"), texts, scratch, f"b{k}")
        assert {r.doc_id for r in marks.collect()} == ({1} if k == 0 else {2 * k, 2 * k + 1})
    assert list(index.runs.values()) == [2] and index.posts().select("doc_id").distinct().count() == 8
    with pytest.raises(ValueError):
        index.add(survey.where("doc_id = 0"), texts, scratch, "again")


def test_a_later_session_goes_on_with_the_index_and_runs_are_not_exchanged(spark):
    scratch = Scratch(spark, "test")
    first = runs.WindowIndex(spark, scratch.path("index"), window=4, fanout=9)
    texts, survey = indexed(spark)
    first.add(survey.where("doc_id < 3"), texts, scratch, "b0")
    first.add(survey.where("doc_id between 3 and 4"), texts, scratch, "b1")
    first.close()
    index = runs.WindowIndex.open(spark.newSession(), scratch.path("index"))
    assert (index.window, index.fanout, index.last, len(index.runs)) == (4, 9, 4, 2)
    texts, survey = (df.sparkSession and index.spark.createDataFrame(df.collect(), df.schema) for df in (texts, survey))
    marks = index.add(survey.where("doc_id between 5 and 6"), texts, Scratch(index.spark, "later"), "b2", compact=False)
    assert {r.doc_id for r in marks.collect()} == {5, 6}
    old, new = list(index.runs)[:2], list(index.runs)[2]
    plan = index.met(new, old)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "Bucketed: true" in plan
    for name in index.runs:  # only prints that met may move, never the posts of a run
        alone = index.run(name).join(index.run(new).groupBy("print").count(), "print", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in alone
    index.compact()
    before = {(r["print"], r.doc_id) for r in index.posts().collect()}
    index.fanout = 3
    index.compact()
    assert list(index.runs.values()) == [1] and {(r["print"], r.doc_id) for r in index.posts().collect()} == before
    with pytest.raises(ValueError):
        index.add(survey.where("doc_id = 0"), texts, Scratch(index.spark, "later"), "again")


@pytest.mark.parametrize("batches", [2, 5])
def test_heavy_fingerprints_beside_the_buckets(docs, rows, monkeypatch, batches):
    """The same result when every fingerprint of a sampled document is heavy."""
    monkeypatch.setattr(runs, "HEAVY_LEAST", 0)
    monkeypatch.setattr(runs, "HEAVY", 10**9)
    monkeypatch.setattr(runs, "FANOUT", 2)
    kept, write = [], runs.WindowIndex._write
    monkeypatch.setattr(runs.WindowIndex, "_write", lambda self, posts, level, heavy=None, prints=(): kept.append(len(prints)) or write(self, posts, level, heavy, prints))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in runs.remove_repeats(docs, batches=batches).collect()), key=str)
    assert got == brute_repeats([(r[0], r[1]) for r in rows]) and max(kept) > 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_under_polynomials_modulo_a_power_of_two_are_told_apart(spark):
    """A Thue-Morse word of 1,024 letters and its complement: equal under any odd base modulo 2**64."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join(f"{w}{k}" for k in range(60))) for i, w in ((1, one), (2, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in runs.remove_repeats(docs).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    words = [(1, " ".join("xy"[bin(i).count("1") & 1] for i in range(2048))), (2, " ".join("yx"[bin(i).count("1") & 1] for i in range(2048)))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in runs.remove_repeats(spark.createDataFrame(words, "doc_id long, text string")).collect())
    assert got == brute_repeats(words)


def test_fingerprints_of_neighbours(docs, rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = oph.neighbours(docs, block_rows=7).collect()
    assert len(got) == len(rows)
    unique = [k for k in range(len(order)) if order[k][0] is not None and sum(o[0] == order[k][0] for o in order) == 1]
    by = {r.doc_id: r for r in got}
    for k in unique:
        text, following = order[k][1], order[(k + 1) % len(order)]
        if sum(o[0] == following[0] for o in order) > 1 and len({o[1] for o in order if o[0] == following[0]}) > 1:
            continue
        r, third = by[order[k][0]], len(text) // 3
        assert r.n_chars == len(text) and r.edited == text[: len(text) - third] + following[1][:third]
        for share, other in ((r.near_edited, r.edited), (r.near_next, following[1])):
            x, y = shingles(text), shingles(other)
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(share - true) < 0.13
    assert oph.neighbours(docs.limit(0)).count() == 0
    assert oph.neighbours(docs.where("doc_id = 0").limit(1)).first().near_next == 1.0


def plain_signature(elements):
    """One permutation: bin and rank of each element; an empty bin takes the value of the first full bin in its probe order."""
    from contextmill.llm.words import U, mix, seeded

    best = {}
    for h in mix(np.array(sorted(elements), np.uint64) ^ U(0x94D049BB133111EB)).tolist():
        best[h >> 55] = min(best.get(h >> 55, 1 << 60), h & ((1 << 55) - 1))
    out = []
    for k in range(oph.BINS):
        at = k if k in best else next(p for p in oph._probe[k].tolist() if p in best)
        with np.errstate(over="ignore"):
            out.append(int(mix(np.array([best[at]], np.uint64) + seeded(oph.BINS, 31)[k : k + 1])[0]) & ((1 << oph.BITS) - 1))
    return out


def test_signatures_equal_the_plain_version():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 500, 4000)]
    got = oph.signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
    assert got.tolist() == [plain_signature(x.tolist()) for x in sets]


def test_neighbours_of_a_doc_id_that_most_rows_have(spark):
    rows = [(None, f"a b c d e f {i}") for i in range(40)] + [(7, f"x y z {i} v w") for i in range(40)] + [(i, f"t {i}") for i in range(20, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda out: sorted((str(r.doc_id), r.n_chars, r.edited, r.near_next) for r in out.collect())
    assert pairs(oph.neighbours(df, block_rows=6)) == pairs(oph.neighbours(df, block_rows=1000)) and oph.neighbours(df, block_rows=6).count() == len(rows)


def test_equal_texts_have_equal_fingerprints(docs):
    prints = defaultdict(set)
    for r in oph.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        prints[r.text or ""].add(bytes(r.fingerprint))
    assert all(len(v) == 1 for v in prints.values()) and prints[""] == {b""}


def test_words_and_chunks_keep_texts_apart():
    texts = ["ab", None, "ab", " a b ", "", "ÉA", "x" * 5000, "ab"]
    seen = []
    for at, to, data, offsets in chunks(pa.array(texts), most=16):
        w = words_of(data, offsets, NOT_SPACE, FOLD)
        seen += [tuple(w.hashes[a:b].tolist()) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        assert to > at
    assert [len(s) for s in seen] == [1, 0, 1, 2, 0, 1, 1, 1] and seen[0] == seen[2] == seen[7] != seen[5]


def test_sha_of_kept_is_of_utf8(spark):
    r = runs.remove_repeats(spark.createDataFrame([(1, "é  ü\tx")], "doc_id long, text string")).first()
    assert hashlib.sha256(r.kept.encode()).hexdigest() == hashlib.sha256("é ü x".encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab É\u00a0\t\n\x0b\x1c.Z", max_size=30), max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, most):
    """Equal words have equal hashes and others do not, wherever they stand and however texts are cut into pieces."""
    hashes = {}
    for at, to, data, offsets in chunks(pa.array(texts, pa.string()), most=most):
        w = words_of(data, offsets, NOT_SPACE, FOLD)
        for text, a, b in zip(texts[at:to], w.offsets[:-1], w.offsets[1:], strict=True):
            found = WORD.findall(fold(text))
            assert len(found) == b - a
            for word, h in zip(found, w.hashes[a:b].tolist(), strict=True):
                assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_query_compacts_its_runs(docs, monkeypatch):
    """After two batches the log has one run of level 1, which the later batches are merge-joined with."""
    seen, add = [], runs.WindowIndex.add

    def watched(self, *args, **kw):
        seen.append(sorted(self.runs.values()))
        return add(self, *args, **kw)

    monkeypatch.setattr(runs.WindowIndex, "add", watched)
    runs.remove_repeats(docs).count()
    assert seen == [[], [0], [1]]


def test_fingerprints_of_the_smallest_doc_id(spark):
    rows = [(-(2**63), "some words of a text"), (2**63 - 1, "other words of a text"), (0, "third words of a text"), (None, "no id")]
    out = oph.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
