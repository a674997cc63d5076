"""Operator 10: near-duplicate classes of documents by SetSketch registers.

Every element of a document's set sends points of a Poisson process, each to a random register; a register keeps its
smallest point, rounded down on an exponential scale and truncated to a byte. So registers are mergeable (the maximum
of two register arrays is the sketch of the union) and equal with a probability near the Jaccard similarity.
Bands of registers give candidate pairs, a joint likelihood over all registers drops hopeless ones, and the rest are
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.llm.components import components
from contextmill.llm.scratch import Scratch
from contextmill.llm.words import FOLD, NOT_SPACE, U, Words, chunks, mix, seeded, signed, spans, windows_of, words_of

REGISTERS = 384
ROWS = 6
BASE = 1.1
SHIFT = 30
SHINGLE = 5
#: Similarity in percent from which documents are linked.
PERCENT = 75
#: Candidates are dropped if their likelihood estimate is so far below the threshold: seven standard errors and more.
MARGIN = 0.16
SMALL = 64
#: Counters of shingles by a part of their hash; they give the order of the prefix filter, any order is exact.
COUNTERS = 1 << 17


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and the offsets of its part."""
    hashes, fits = windows_of(w, size)
    parts, counts = [], np.zeros(len(w.counts), np.int64)
    for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
        if b - a >= size:
            own = np.unique(hashes[a : b - size + 1])
        elif b > a:
            own = spans(w.hashes[a:b], np.array([0]), np.array([b - a]), 0x5851F42D4C957F2D)
        else:
            continue
        parts.append(own)
        counts[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate(([0], np.cumsum(counts)))


def registers_of(elements: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Register bytes of each set: shape (sets, m). An empty set has only zeros."""
    n = len(offsets) - 1
    least = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    state, at = elements.copy(), np.zeros(len(elements))
    while len(state):
        with np.errstate(over="ignore"):
            state = mix(state + U(0x9E3779B97F4A7C15))
        at = at - np.log1p(-(state >> U(11)).astype(np.float64) * 2.0**-53) / m
        where = ((mix(state ^ U(0xD6E8FEB86659FD93)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        np.minimum.at(least, owner * m + where, at)
        # points of a set's element come in ascending order: beyond its largest register they change nothing
        live = at < least.reshape(n, m).max(axis=1)[owner]
        state, at, owner = state[live], at[live], owner[live]
    with np.errstate(divide="ignore"):
        level = np.floor(SHIFT - np.log(least) / np.log(BASE))
    return np.where(np.isfinite(least), np.clip(level, 0, 254) + 1, 0).astype(np.uint8).reshape(n, m)


def bands_of(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each run of ``rows`` registers, shape (sets, bands); the band's place is part of the key."""
    n, m = registers.shape
    out = np.zeros((n, m // rows), U)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = out * U(257) + registers[:, r : m // rows * rows : rows].astype(U) + U(1)
        return mix(out ^ seeded(m // rows, 77)[None, :])


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register arrays with known set sizes.

    The likelihood is joint over registers that are larger on the left, larger on the right and equal.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(x, 1e-300)) + less * np.log(np.maximum(y, 1e-300)) + same * np.log(np.maximum(1 - x - y, 1e-300))

    golden = (np.sqrt(5) - 1) / 2
    for _ in range(24):  # it has one maximum
        c, d = hi - golden * (hi - lo), lo + golden * (hi - lo)
        left = likelihood(c) > likelihood(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        kept, small = [], []
        for at, to, data, offsets in chunks(batch.column("text")):
            elements, parts = shingle_sets(words_of(data, offsets, NOT_SPACE, FOLD))
            sizes = np.diff(parts)
            hard = (sizes < SMALL) & (sizes > 0)
            rows = np.arange(at, to)
            if hard.any():  # sets with few elements need many points; they are done together for the whole batch
                small.append((elements[np.repeat(hard, sizes)], sizes[hard], rows[hard]))
            kept.append((elements[np.repeat(~hard, sizes)], sizes[~hard], rows[~hard]))
        if small:
            kept.append(tuple(np.concatenate(x) for x in zip(*small, strict=True)))
        for elements, sizes, rows in kept:
            parts = np.concatenate(([0], np.cumsum(sizes)))
            registers = registers_of(elements, parts)
            keys = np.zeros((2, len(sizes)), U)
            full = np.flatnonzero(sizes)
            with np.errstate(over="ignore"):
                for k, salt in enumerate((U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3))):
                    if len(full):
                        keys[k, full] = np.add.reduceat(mix(elements * salt + U(k)), parts[:-1][full])
            bands = bands_of(registers)
            yield pa.record_batch(
                [ids.take(pa.array(rows)), batch.column("digest").take(pa.array(rows)), pa.array(sizes), pa.array(signed(keys[0])), pa.array(signed(keys[1])), pa.array([x.tobytes() for x in registers], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(signed(bands.ravel())))],
                ["doc_id", "digest", "n_shingles", "key1", "key2", "sketch", "bands"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles (set size), key1 and key2 (a 128-bit key of the set), sketch (register bytes), bands."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest")).mapInArrow(_features, "doc_id long, digest long, n_shingles long, key1 long, key2 long, sketch binary, bands array<long>")


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            a, b = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("sketch_a", "sketch_b"))
            f = f.assign(estimate=similarity(a, b, f.n_a.to_numpy(float), f.n_b.to_numpy(float)))
            yield f.loc[f.estimate >= PERCENT / 100 - MARGIN, ["a", "b", "estimate"]]


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have shingles of each counter."""
    n = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            elements, _ = shingle_sets(words_of(data, offsets, NOT_SPACE, FOLD))
            n += np.bincount((elements >> U(47)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at), pa.array(n[at])], ["counter", "n"])


def prefixes(elements: np.ndarray, tallies: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The set's prefix and the places of its elements: the rarest n - ceil(n * percent / 100) + 1, rare first.

    Of two sets at the threshold the prefixes have an element in common, as both are in one order.
    """
    order = np.lexsort((elements, tallies[(elements >> U(47)).astype(np.int64)]))
    keep = len(elements) + (-len(elements) * percent // 100) + 1
    return elements[order[:keep]], np.arange(keep)


def _prefix_rows(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = shared.value
        for batch in batches:
            for at, _, data, offsets in chunks(batch.column("text")):
                elements, parts = shingle_sets(words_of(data, offsets, NOT_SPACE, FOLD))
                own = [prefixes(elements[a:b], tallies) for a, b in zip(parts[:-1], parts[1:], strict=True)]
                rows = pa.array(at + np.repeat(np.arange(len(own)), [len(x) for x, _ in own]))
                yield pa.record_batch(
                    [batch.column("rep").take(rows), batch.column("component").take(rows), pa.array(np.repeat(np.diff(parts), [len(x) for x, _ in own])), pa.array(signed(np.concatenate([x for x, _ in own]))), pa.array(np.concatenate([k for _, k in own]))],
                    ["rep", "component", "n", "element", "place"],
                )

    return run


def band(n: Column) -> Column:
    """A number that grows with a size: each up to 15 has its own, then eight share a doubling."""
    shift = F.greatest(F.length(F.bin(n)) - 4, F.lit(0))
    return shift * 16 + F.call_function("shiftright", n.cast("long"), shift).cast("int")


def entered(rows: DataFrame) -> DataFrame:
    """rows (n, place, ...), once for each band of sizes in which a partner may be if their first common element is this one.

    A partner has ``least`` elements or more by the sizes' ratio, and at most ``most`` by what this row has left from its place on.
    """
    least = F.floor((F.col("n") * PERCENT + 99) / 100)
    most = F.floor((F.col("n") * 100 - F.col("place") * (100 + PERCENT)) / PERCENT)
    return rows.where(least <= most).withColumn("band", F.explode(F.sequence(band(least), band(most))))


def candidates(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): pairs of members (rep, component, text) of different components that may reach the threshold; none that does is missing.

    An exact prefix-filter join: the rarest quarter of each member's shingles is joined, with length and positional filters.
    The join's key is an element and a band of sizes, and a member meets only the bands that its place leaves open: members
    that share a frequent element but too little besides meet nobody there.
    """
    tallied = members.select("text").mapInArrow(_tallies, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    tallies = np.zeros(COUNTERS, np.int64)
    tallies[tallied["counter"].to_numpy()] = tallied["n"].to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(tallies)
    rows = scratch.save(members.select("rep", "component", "text").mapInArrow(_prefix_rows(shared), "rep long, component long, n long, element long, place long"), f"{name}-prefixes")
    # of an element's members most may be of one component: the others are paired with all, and these never with each other
    held = rows.groupBy("element", "component").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("element").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("element", "most")
    mixed = scratch.save(rows.join(most, "element"), f"{name}-postings")  # written, so that Spark can split the join with a frequent element
    x, y = (df.select("element", "most", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "component", "n", "place"))) for df, k in ((entered(mixed.where("component <> most")), "a"), (mixed.withColumn("band", band(F.col("n"))), "b")))
    met = x.drop("most").join(y.drop("most"), ["element", "band"]).where("component_a <> component_b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    # a pair's first common element has all of them at its place or after it, so one of the pair's elements passes this
    met = met.where(f"{100 + PERCENT} * least(n_a - place_a, n_b - place_b) >= {PERCENT} * (n_a + n_b)")
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def exact_sets(texts: list[str]) -> list[np.ndarray]:
    """Shingle sets of the texts as numbers that are equal for equal shingles only: words are compared by their bytes."""
    known: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    ids = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        whole = FOLD[data].tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            ids.append(np.array([known.setdefault(w, len(known)) for w in whole[a:b].split()], np.int64))
    every, size = np.concatenate(ids) if ids else np.zeros(0, np.int64), len(known) + 1
    ranks = lambda x: np.unique(x, return_inverse=True)[1]
    two = ranks(every[:-1] * size + every[1:])
    four = ranks(two[:-2] * (len(two) + 1) + two[2:]) if len(two) > 2 else two[:0]
    five = four[: max(0, len(every) - 4)] * size + every[4:]
    out, at = [], 0
    for own in ids:
        n = len(own)
        out.append(np.unique(five[at : at + n - SHINGLE + 1]) if n >= SHINGLE else np.array([-1 - short.setdefault(tuple(own), len(short))] if n else [], np.int64))
        at += n
    return out


def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for s in range(0, len(frame), 2048):
            f = frame.iloc[s : s + 2048]
            ids, texts = pd.concat((f.a, f.b)), pd.concat((f.text_a, f.text_b))
            first = ~ids.duplicated()
            sets = dict(zip(ids[first], exact_sets(texts[first].tolist()), strict=True))
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(f.a, f.b, strict=True)], np.int64)
            size = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(f.a, f.b, strict=True)], np.int64) - both
            yield f.loc[100 * both >= PERCENT * size, ["a", "b"]]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. texts: rep, text."""
    with_b = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of docs.

    Texts are lower-cased in A-Z and cut into words at white space; the set of a document is its distinct shingles of
    five words, or its whole sequence if it is shorter. Null, empty and blank texts have an empty set and are linked
    with nothing. Documents with 100 * intersection >= 75 * union are linked; component_id is the smallest doc_id that
    links reach, class_id the smallest with an equal set. Rows that repeat a doc_id are one document: its text is the one
    with the smallest 64-bit hash, and each of its rows gets that text's values. A null doc_id stays alone with component
    null and kept true. Other columns are ignored. Empty input: no rows.

    Documents with equal sets are one class, so copies never pair. A bucket (members of a band key) links each member
    with the smallest one, so a large group of near copies costs one pair a member; members that this leaves in different
    components are joined by an exact prefix filter, so no link is lost to the bucket's size and work is for candidates.
    Confirmed links compare shingles by their words' bytes. With 64 bands of 6 registers a pair at the threshold shares no
    bucket with a probability of about four in a million; its estimate is more than MARGIN too low, seven standard errors,
    with a probability below one in ten billion.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    all_rows = scratch.save(sketches(docs), "sketches")
    spread = all_rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select(F.col("doc_id").alias("id"), "least")
    if repeated := not spread.isEmpty():
        spread = scratch.save(spread, "spread")  # documents of several texts

    def single(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
        """Without rows of a document whose text does not stand for it."""
        if not repeated:
            return df
        return df.join(spread, (F.col(doc_id) == F.col("id")) & (F.col("digest") != F.col("least")), "left_anti")

    known = single(all_rows.where("n_shingles > 0 and doc_id is not null"))
    # written, so that Spark can split the joins with it at a set that very many documents have
    classes = scratch.save(known.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "classes")
    owners = scratch.save(known.select("doc_id", "n_shingles", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "rep"), "owners")
    reps = scratch.save(known.join(owners.where("doc_id = rep").select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "bands"), "reps")
    members = reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    pivots = members.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pivots = scratch.save(pivots, "pivots")  # a join of written tables: Spark can split a key that very many documents have
    buckets = scratch.save(members.join(pivots, "key").select("key", "rep", "n", "pivot", "size"), "buckets")
    slim = reps.select("rep", "n", "sketch")
    a, b = (slim.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    fits = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
    stars = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    likely = scratch.save(stars.join(b, "b").join(a, "a").where(fits).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInPandas(_estimates, "a long, b long, estimate double"), "likely")
    # texts of documents that share a bucket, written once: later steps move only these
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    texts = single(texts, "rep").drop("digest")
    texts = scratch.save(texts.join(buckets.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"]), "texts")

    def asked(pairs: DataFrame) -> DataFrame:
        """Texts of the documents in pairs; equal sets of one doc_id make any of its rows fit."""
        return texts.join(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "rep", "left_semi")

    best = likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b")
    best = scratch.save(best, "best")
    links = scratch.save(confirmed(best, asked(best)), "links-1")
    found = components(links, scratch, "first")

    def placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
        return nodes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        x, y = (found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab")
        return pairs.join(x, "a", "left").join(y, "b", "left").where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")

    open_pairs = scratch.save(apart(likely.join(best, ["a", "b"], "left_anti"), found), "open")
    if not open_pairs.isEmpty():
        links = links.union(scratch.save(confirmed(open_pairs, asked(open_pairs)), "links-2"))
        found = components(links, scratch, "second")
    # buckets of three and more whose members lie in different components: candidates among all such members
    crowded = placed(buckets.where("size > 2").select("key", "rep"), found)
    mixed = crowded.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    members = crowded.join(mixed, "key", "left_semi").select("rep", "component").distinct()
    members = scratch.save(members.join(texts, "rep"), "crowded")
    if not members.isEmpty():
        close = scratch.save(candidates(members, scratch, "crowded"), "close")
        links = links.union(scratch.save(confirmed(close, asked(close)), "links-3"))
        found = components(links, scratch, "third")
    found = scratch.save(found, "found")
    rows = all_rows.select("doc_id", "n_shingles", "key1", "key2")
    if repeated:
        chosen = single(all_rows.join(spread, F.col("doc_id") == F.col("id"), "left_semi")).dropDuplicates(["doc_id"])
        chosen = scratch.save(chosen.select(F.col("doc_id").alias("of"), F.struct("n_shingles", "key1", "key2").alias("its")), "chosen")
        rows = rows.join(chosen, F.col("doc_id") == F.col("of"), "left").select("doc_id", *(F.coalesce(F.col(f"its.{c}"), F.col(c)).alias(c) for c in ("n_shingles", "key1", "key2")))
    scratch.keep("sketches", "classes", "found", "chosen")  # the result reads these alone
    out = rows.join(classes, ["key1", "key2"], "left")
    out = out.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    out = out.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
