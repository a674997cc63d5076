"""Operator 6: toxicity by a factorization machine over hashed terms.

Terms are words and their first four and five bytes, lower-cased in A-Z and hashed. Class counts of all terms over all
training documents choose the terms that tell the classes apart alone; a bounded sample adds those that tell them apart in
pairs, by the contrast of the four cases of two terms. The machine learns a weight and a short vector for each of these on
the sample, so that two terms together can say more than the sum of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch
from contextmill.llm.templates import _TOKEN
from contextmill.llm.words import FOLD, U, chunks, seeded, spans, words_of

BUCKETS = 1 << 18
#: A term must stand in so many training documents.
LEAST_DOCUMENTS = 2
FACTORS = 8
#: Labelled documents of each class that the machine is fitted on, about.
SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.7
#: Terms whose pairs are counted in one product.
BLOCK = 1024
#: Label rows up to this number (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each term occurrence."""
    w = words_of(data, offsets, _TOKEN, FOLD)
    values = seeded(256, 1)[FOLD][data]
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    size = w.end - w.start
    keys, owners = [w.hashes], [owner]
    for n in (4, 5):
        long = size > n
        keys.append(spans(values, w.start[long], w.start[long] + n, 0x2545F4914F6CDD1D) ^ U(n))
        owners.append(owner[long])
    return (np.concatenate(keys) >> U(46)).astype(np.int64), np.concatenate(owners)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        np.add.at(n, toxic, 1)
        for at, to, data, offsets in chunks(batch.column("text")):
            bucket, owner = terms_of(data, offsets)
            once = np.unique(owner * BUCKETS + bucket)
            np.add.at(df, (toxic[at + once // BUCKETS], once % BUCKETS), 1)
    at = np.flatnonzero(df.any(0))
    yield pa.record_batch([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([n[0]], df[0, at]))), pa.array(np.concatenate(([n[1]], df[1, at])))], ["bucket", "clean", "toxic"])


@dataclass
class Machine:
    index: np.ndarray  # bucket -> term number or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        """Probability of the label 1 for a set of term numbers."""
        return float(self.scores(np.asarray(terms, np.int64), np.array([len(terms)]))[0])

    def scores(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of each text, whose term numbers follow each other."""
        z = np.full(len(sizes), self.bias, np.float64)
        held = np.flatnonzero(sizes)
        if len(held):
            first = (np.cumsum(sizes) - sizes)[held]
            v = self.factors[terms]
            total = np.add.reduceat(v, first)
            z[held] += np.add.reduceat(self.linear[terms], first) + 0.5 * ((total * total).sum(1) - np.add.reduceat((v * v).sum(1), first))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_machine(x: list[np.ndarray], y: np.ndarray, terms: int, epochs: int = 30, batch: int = 64, rate: float = 0.05, decay: float = 2e-4, seed: int = 9) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of so many terms for texts x (term numbers of each) and labels y, by AdaGrad on the logistic
    loss with L2 decay. A step touches the terms of its texts only."""
    rng = np.random.default_rng(seed)
    b, w, v = 0.0, np.zeros(terms, np.float32), rng.normal(0, 0.02, (terms, FACTORS)).astype(np.float32)
    gb, gw, gv = 1e-6, np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            met, place = np.unique(np.concatenate([x[i] for i in own]), return_inverse=True)
            rows = np.zeros((len(own), len(met)), np.float32)
            rows[np.repeat(np.arange(len(own)), [len(x[i]) for i in own]), place] = 1
            vm, wm = v[met], w[met]
            xv = rows @ vm
            z = b + rows @ wm + 0.5 * ((xv * xv).sum(1) - rows @ (vm * vm).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)).astype(np.float32)
            db, dw = float(g.sum()), rows.T @ g + decay * wm
            dv = rows.T @ (g[:, None] * xv) - vm * (rows.T @ g)[:, None] + decay * vm
            gb += db * db
            gw[met] += dw * dw
            gv[met] += dv * dv
            b -= rate * db / np.sqrt(gb)
            w[met] = wm - rate * dw / np.sqrt(gw[met])
            v[met] = vm - rate * dv / np.sqrt(gv[met])
    return b, w, v


def telling_pairs(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets of terms that tell the classes apart together with another, by more than each does alone.

    Of two terms the four cases (both, either, none) have a share of label 1 each; their contrast (both + none - one - other)
    is 0 for terms that only add up. Half the square of its standard score has to exceed the logarithm of the number of
    pairs, as by chance some pair is always that far. A contrast of n texts can reach that only where twice the bound's number
    of texts has both, so rarer terms take no part. x has the buckets of each text; copies count once, as they would make
    pairs of all their terms.
    """
    once = {(t.tobytes(), float(label)): i for i, (t, label) in enumerate(zip(x, y, strict=True))}
    x, y = [x[i] for i in once.values()], y[list(once.values())]
    n = len(x)
    every = np.concatenate(x) if n else np.zeros(0, np.int64)
    counts = np.bincount(every, minlength=1)
    able = np.flatnonzero(counts > 1)
    bound = 2 * np.log(max(2, len(able)))  # grows with the number of terms, and that shrinks with the bound
    able = np.flatnonzero(counts >= 2 * bound)
    bound = 2 * np.log(max(2, len(able)))
    index = np.full(len(counts), -1, np.int64)
    index[able] = np.arange(len(able))
    held = np.zeros((len(able), n), bool)
    for i, terms in enumerate(x):
        at = index[terms]
        held[at[at >= 0], i] = True
    mean = float(y.mean()) if n else 0.0
    label, spread, out = y.astype(np.float32), max(mean * (1 - mean), 1e-9), np.zeros(len(able), bool)
    for a in range(0, len(able), BLOCK):
        p = held[a : a + BLOCK].astype(np.float32)
        for c in range(a, len(able), BLOCK):
            q = held[c : c + BLOCK].astype(np.float32)
            both, both_of = p @ q.T, (p * label) @ q.T
            one, one_of = p.sum(1)[:, None] - both, (p @ label)[:, None] - both_of
            other, other_of = q.sum(1)[None, :] - both, (q @ label)[None, :] - both_of
            none, none_of = n - both - one - other, label.sum() - both_of - one_of - other_of
            share = lambda k, m: (k + 0.5 * mean) / (m + 0.5)
            contrast = share(both_of, both) + share(none_of, none) - share(one_of, one) - share(other_of, other)
            least = np.minimum(np.minimum(both, none), np.minimum(one, other)) >= 1
            z2 = contrast**2 / (spread * (1 / (both + 0.5) + 1 / (one + 0.5) + 1 / (other + 0.5) + 1 / (none + 0.5)))
            met = least & (z2 / 2 > bound)
            out[a : a + BLOCK] |= met.any(1)
            out[c : c + BLOCK] |= met.any(0)
    return able[out]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Machine:
    """Learns from docs (doc_id, text) that labels (doc_id, toxic) mark; null labels are left out, and a document with
    both labels is toxic. Class counts of terms cover all of them; about ``sample`` documents of each class reach the
    driver as lists of terms that two training documents have. The bias is set back to the classes' shares among all. Without labels: score 0.5."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marks, "doc_id").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    counts = scratch.save(rows.select("text", "toxic").mapInArrow(_class_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "counts")
    head = counts.where("bucket < 0").first()
    clean, toxic = (int(head["clean"]), int(head["toxic"])) if head else (0, 0)
    index = np.full(BUCKETS, -1, np.int32)
    if not clean + toxic:
        return Machine(index, 0.0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    prior = float(np.log((toxic + 0.5) / (clean + 0.5)))
    # log-likelihood ratio of a term's share among toxic and clean documents
    share = F.expr(f"toxic * ln((toxic + 0.5) * {clean + 1} / ((clean + 0.5) * {toxic + 1})) + clean * ln((clean + 0.5) * {toxic + 1} / ((toxic + 0.5) * {clean + 1}))")
    tried = counts.where(f"bucket >= 0 and clean + toxic >= {LEAST_DOCUMENTS}").withColumn("gain", share)
    # of so many terms some differ between the classes by chance; a gain beyond the logarithm of their number is no chance
    noise = float(np.log(max(1, tried.count())))
    alone = tried.where(F.col("gain") > noise).select("bucket").toPandas()["bucket"].to_numpy(np.int64)  # BUCKETS at most
    known = np.zeros(BUCKETS, bool)
    known[tried.select("bucket").toPandas()["bucket"].to_numpy(np.int64)] = True
    scratch.drop()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                terms, sizes = _held(data, offsets, np.where(shared.value, np.arange(BUCKETS), -1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(terms.astype(np.int32)))
                yield pa.record_batch([batch.column("toxic").slice(at, to - at), batch.column("turn").slice(at, to - at), lists], ["toxic", "turn", "terms"])

    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("toxic") == 1, min(1.0, sample / max(toxic, 1))).otherwise(min(1.0, sample / max(clean, 1)))
    rows = rows.where(draw < limit).select("text", "toxic", F.xxhash64("doc_id", "text").alias("turn"))
    seen = rows.mapInArrow(run, "toxic int, turn long, terms array<int>").toArrow().sort_by([("toxic", "ascending"), ("turn", "ascending")])  # they come in any order
    y, x = seen.column("toxic").to_numpy().astype(np.float32), [t.values.to_numpy() for t in seen.column("terms")]
    chosen = np.union1d(alone, telling_pairs(x, y))
    index[chosen] = np.arange(len(chosen), dtype=np.int32)
    bias, linear, factors = fit_machine([t[t >= 0] for t in (index[t] for t in x)], y, len(chosen))
    bias += prior - float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return Machine(index, bias, linear, factors)


def _held(data: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers that index gives the terms of each text, text by text, and how many each has; -1 is none."""
    bucket, owner = terms_of(data, offsets)
    term = index[bucket]
    held = term >= 0
    once = np.unique(owner[held] * BUCKETS + term[held])
    return once % BUCKETS, np.bincount(once // BUCKETS, minlength=len(offsets) - 1)


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row of docs, from its whole text; null and empty texts have the score of no terms.

    Repeated rows and null doc_ids are rows like others; other columns are ignored. Empty input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                found = known.scores(*_held(data, offsets, known.index))
                yield pa.record_batch([batch.column("doc_id").slice(at, to - at), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
