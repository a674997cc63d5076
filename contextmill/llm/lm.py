"""Operator 8: language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Counts of all words come from all training documents. The probability of a word is that of its class after the two words
before it, times the word's share of its class. The most frequent words are classes of their own; the others are
clustered by the company they keep (which frequent words stand beside them), so that rare words of one kind share their
vectors; words beyond the lexicon are one class more. Logits are sums of two terms, one for each word of context, so one
matrix product of their exponentials gives the normaliser of every context, and a token's log-probability is look-ups.

Training documents are dealt by a hash into cells of a shard and a round; the number of shards follows the number of
tokens, never that of partitions. In each round every shard learns from its cell, from the mean parameters of the round
before; sums are of integers, so the result is the same however Spark partitions the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.llm.scratch import Scratch
from contextmill.llm.words import FOLD, NOT_SPACE, U, chunks, seeded, signed, words_of

#: Frequent words that are classes of their own, and clusters of other words; tables have the square of their sum, 4 MB each.
SINGLES = 767
CLUSTERS = 256
#: So many of the most frequent words are in the lexicon, which is broadcast (16 bytes each); the counts of others are joined.
LEXICON = 1 << 18
#: Numbers that describe the company of a word.
COMPANY = 8
#: Tokens that a shard learns from, about, in all rounds together.
SHARD_TOKENS = 1 << 21
ROUNDS = 4
#: Tokens that are mixed before they are learned from.
MIXED = 1 << 16
#: A corpus with fewer training tokens is learned from several times, at most six.
ENOUGH_TOKENS = 1 << 22
WIDTH = 24
NOISE = 16
BATCH = 4096
END = seeded(1, 65537)[0]


@dataclass
class Lexicon:
    """The most frequent words, by hash: count, class, and log10 of the share of the class."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    ids: np.ndarray
    shares: np.ndarray
    other: int  # the class of all other words

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def classes(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.ids[at], self.other) if len(self.ids) else np.full(len(at), self.other)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and one end, and the offsets of the texts among them."""
    w = words_of(data, offsets, NOT_SPACE, FOLD)
    n = len(w.counts)
    ends = w.offsets + np.arange(n + 1)
    out = np.empty(len(w.hashes) + n, U)
    out[np.arange(len(w.hashes)) + np.repeat(np.arange(n), w.counts)] = w.hashes
    out[ends[1:] - 1] = END
    return out, ends


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [tokens_of(data, offsets)[0] for _, _, data, offsets in chunks(batch.column("text"))]
        if parts:
            word, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array(signed(word)), pa.array(n.astype(np.int64))], ["word", "n"])


def _contexts(ids: np.ndarray, offsets: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word before each token and of the one before that; ``begin`` where the text begins."""
    one, two = np.full(len(ids), begin), np.full(len(ids), begin)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    first = offsets[:-1]
    one[first] = two[first] = begin
    second = first[np.diff(offsets) > 1] + 1
    two[second] = begin
    return one, two


@dataclass
class Parameters:
    """context: vectors of context words; near, far: matrices of the two places; target and bias: of predicted words."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def first(cls, shares: np.ndarray, seed: int = 3) -> Parameters:
        rng = np.random.default_rng(seed)
        n = len(shares)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(n + 1, WIDTH), np.eye(WIDTH, dtype=np.float32) * 0.5, np.eye(WIDTH, dtype=np.float32) * 0.3, draw(n, WIDTH), np.log(shares).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.near, self.far, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def of(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*out)


class Trainer:
    """Noise-contrastive estimation by AdaGrad: a batch shares its noise words, drawn by their frequency."""

    def __init__(self, start: Parameters, gain: Parameters, shares: np.ndarray, seed: int | list[int], rate: float = 0.08):
        self.p = start.of(start.flat())
        self.gain = gain.of(gain.flat()).parts()
        self.rate, self.rng = rate, np.random.default_rng(seed)
        self.total, self.log = np.cumsum(shares), np.log(NOISE * shares).astype(np.float32)

    def _step(self, k: int, rows: np.ndarray | None, grad: np.ndarray) -> None:
        x, gain = self.p.parts()[k], self.gain[k]
        if rows is not None:  # rows come several times: their gradients add up
            order = np.argsort(rows, kind="stable")
            own = rows[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows, grad = own[first], np.add.reduceat(grad[order], first, axis=0)
            gain[rows] += grad * grad
            x[rows] -= self.rate * grad / np.sqrt(gain[rows])
        else:
            gain += grad * grad
            x -= self.rate * grad / np.sqrt(gain)

    def learn(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.total, self.rng.random(NOISE) * self.total[-1]), len(self.total) - 1)
        x, y = p.context[one], p.context[two]
        r = x @ p.near + y @ p.far
        good = (r * p.target[word]).sum(1) + p.bias[word] - self.log[word]
        bad = r @ p.target[noise].T + p.bias[noise] - self.log[noise]
        n = np.float32(1 / len(word))
        g = -n / (1 + np.exp(np.clip(good, -30, 30)))
        h = n / (1 + np.exp(-np.clip(bad, -30, 30)))
        dr = g[:, None] * p.target[word] + h @ p.target[noise]
        words = np.concatenate((word, noise))
        grads = (np.concatenate((g[:, None] * r, h.T @ r)), np.concatenate((g, h.sum(0))))
        dnear, dfar, dx, dy = x.T @ dr, y.T @ dr, dr @ p.near.T, dr @ p.far.T
        self._step(3, words, grads[0])
        self._step(4, words, grads[1])
        self._step(0, np.concatenate((one, two)), np.concatenate((dx, dy)))
        self._step(1, None, dnear)
        self._step(2, None, dfar)


@dataclass
class Tables:
    """Log-probability of word w after words a (before it) and b (before that): near[a, w] + far[b, w] - whole[a, b]."""

    near: np.ndarray
    far: np.ndarray
    whole: np.ndarray

    @classmethod
    def of(cls, p: Parameters) -> Tables:
        near = (p.context @ p.near @ p.target.T).astype(np.float64)
        far = (p.context @ p.far @ p.target.T + p.bias).astype(np.float64)
        top, high = near.max(1, keepdims=True), far.max(1, keepdims=True)
        whole = np.log(np.exp(near - top) @ np.exp(far - high).T) + top + high.T
        return cls(near.astype(np.float32), far.astype(np.float32), whole.astype(np.float32))

    def log10(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (self.near[one, word].astype(np.float64) + self.far[two, word] - self.whole[one, two]) / np.log(10)


@dataclass
class Model:
    lexicon: Lexicon
    tables: Tables
    counts: DataFrame  # (word, n) of all training words
    tokens: int
    distinct: int
    other_tokens: int
    other_distinct: int


def clusters(x: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """Numbers of at most ``parts`` groups of about equal weight: the heaviest is cut along its widest direction, again and again."""
    found = np.zeros(len(x), np.int64)
    groups = [(float(weight.sum()), np.arange(len(x)))] if len(x) else []
    done = []
    while groups and len(groups) + len(done) < parts:
        k = max(range(len(groups)), key=lambda i: groups[i][0])
        total, own = groups.pop(k)
        w = weight[own] / total
        centred = x[own] - w @ x[own]
        _, turned = np.linalg.eigh((centred * w[:, None]).T @ centred)
        order = np.argsort(centred @ turned[:, -1], kind="stable")
        cut = int(np.searchsorted(np.cumsum(w[order]), 0.5)) + 1
        if cut >= len(own):
            cut = len(own) - 1
        if cut < 1:
            done.append(own)
            continue
        for part in (own[order[:cut]], own[order[cut:]]):
            groups.append((float(weight[part].sum()), np.sort(part)))
    for number, own in enumerate([*done, *(g[1] for g in groups)]):
        found[own] = number
    return found


def _beside(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens before and after each, -1 where the text ends."""
    before, after = np.full(len(ids), -1), np.full(len(ids), -1)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[ends[:-1]] = after[ends[1:] - 1] = -1
    return before, after


def _described(texts: DataFrame, hashes: np.ndarray, singles: int) -> np.ndarray:
    """Company of each word of the lexicon (most frequent first), shape (words, COMPANY), from all texts.

    The frequent words are described by the leading directions of the square roots of their shares of each other's
    neighbours; a word's company is the mean of these over its neighbours.
    """
    order = np.argsort(hashes)
    shared = texts.sparkSession.sparkContext.broadcast((hashes[order], order))

    def ids_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, place = shared.value
        found, ends = tokens_of(data, offsets)
        at = np.minimum(np.searchsorted(words, found), len(words) - 1)
        return np.where(words[at] == found, place[at], -1), ends

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(singles * singles, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                ids, _ = own = ids_of(data, offsets)
                after = _beside(*own)[1]
                near = (ids >= 0) & (ids < singles) & (after >= 0) & (after < singles)
                met += np.bincount(ids[near] * singles + after[near], minlength=len(met))
        at = np.flatnonzero(met)
        yield pa.record_batch([pa.array(at), pa.array(met[at])], ["place", "n"])

    met = texts.mapInArrow(pairs, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(singles * singles)
    m[met["place"].to_numpy()] = met["n"].to_numpy()
    m = m.reshape(singles, singles)
    m = m + m.T
    whole = max(1.0, m.sum())
    u, size, _ = np.linalg.svd(np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1)) - np.sqrt(m.sum(0) / whole))
    wide = min(COMPANY, singles)
    vectors = np.zeros((singles, COMPANY), np.int64)
    vectors[:, :wide] = np.rint(u[:, :wide] * size[:wide] * (1 << 20))
    told = texts.sparkSession.sparkContext.broadcast(vectors)

    def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(hashes), np.int64), np.zeros((len(hashes), COMPANY), np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                ids, _ = own = ids_of(data, offsets)
                for near in _beside(*own):
                    ok = np.flatnonzero((ids >= 0) & (near >= 0) & (near < singles))
                    ok = ok[np.argsort(ids[ok], kind="stable")]
                    if len(ok):
                        word = ids[ok]
                        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                        total[word[first]] += np.add.reduceat(told.value[near[ok]], first, axis=0)
                        n[word[first]] += np.diff(np.concatenate((first, [len(ok)])))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at]), *(pa.array(total[at, k]) for k in range(COMPANY))], ["word", "n", *(f"x{k}" for k in range(COMPANY))])

    columns = ["n", *(f"x{k}" for k in range(COMPANY))]
    sums = texts.mapInArrow(company, "word long, " + ", ".join(f"{c} long" for c in columns)).groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((len(hashes), COMPANY))
    for k, c in enumerate(columns[1:]):
        out[sums["word"].to_numpy(), k] = sums[c].to_numpy() / (1 << 20) / (sums["n"].to_numpy() + 1)
    return out


def fit(training: DataFrame, scratch: Scratch, singles: int = SINGLES, parts: int = CLUSTERS, lexicon: int = LEXICON, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Learns from all rows of training (doc_id, text); each token is learned from once, or up to six times if there are
    fewer than ENOUGH_TOKENS. Words are told apart by a 64-bit
    hash of their folded bytes. The result does not depend on the partitions of training."""
    spark = training.sparkSession
    texts = training.select(F.col("text").cast("string").alias("text"))
    counts = scratch.save(texts.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the smallest count that at most ``lexicon`` words reach: so no task sends more of them than there are in all
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    least = sizes.withColumn("so_far", F.sum("words").over(W.orderBy(F.desc("n")))).where(F.col("so_far") <= lexicon).agg(F.min("n")).first()[0]
    known = F.col("word") == int(signed(np.array([END]))[0])
    top = counts.where(known if least is None else known | (F.col("n") >= least)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    hashes, n = top["word"].to_numpy().view(U), top["n"].to_numpy()
    alone = min(singles, len(hashes))
    ids = np.arange(len(hashes))
    if len(hashes) > alone:
        company = _described(texts, hashes, alone)[alone:]
        ids[alone:] = alone + clusters(company, n[alone:].astype(float), parts)
    other = int(ids.max()) + 1 if len(ids) else 0
    of_class = np.bincount(ids, n, other).astype(np.float64)
    members = np.bincount(ids, minlength=other)
    shares = np.where(members[ids] > 1, np.log10((n + 0.5) / (of_class[ids] + 0.5 * members[ids])), 0.0)
    order = np.argsort(hashes)
    lex = Lexicon(hashes[order], n[order], ids[order], shares[order], other)
    outside = int(whole["n"]) - int(n.sum())
    mass = np.concatenate((of_class, [outside + 0.5]))
    mass /= mass.sum()
    start = Parameters.first(mass)
    gain = start.of(np.full(len(start.flat()), 1e-3))
    shards, again = -(-int(whole["n"]) // shard_tokens), 1 + min(5, ENOUGH_TOKENS // max(1, int(whole["n"])))
    place = F.xxhash64(F.col("doc_id").cast("long"), "text")
    dealt = training.select(F.pmod(place, F.lit(max(1, shards))).alias("shard"), F.pmod(F.shiftrightunsigned(place, 40), F.lit(rounds)).alias("round"), place.alias("turn"), F.col("text").cast("string").alias("text"))
    for step in range(rounds if shards else 0):
        shared = spark.sparkContext.broadcast((lex, start, gain, mass, step))

        def train(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lexicon, start, gain, mass, step = shared.value
            total, learned = None, 0
            trainer, shard, held, size = None, None, [], 0

            def learn() -> None:
                if size:
                    ids, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
                    for _ in range(again):
                        turn = trainer.rng.permutation(len(ids))
                        for s in range(0, len(turn), BATCH):
                            own = turn[s : s + BATCH]
                            trainer.learn(ids[own], one[own], two[own])
                held.clear()

            def finish() -> np.ndarray:
                learn()
                flat = np.concatenate((trainer.p.flat(), np.concatenate([x.ravel() for x in trainer.gain])))
                fixed = np.rint(flat.astype(np.float64) * (1 << 24)).astype(np.int64)
                return fixed if total is None else total + fixed

            for batch in batches:
                shards = batch.column("shard").to_numpy()
                for at, _, data, offsets in chunks(batch.column("text")):
                    hashes, ends = tokens_of(data, offsets)
                    ids = lexicon.classes(lexicon.find(hashes))
                    one, two = _contexts(ids, ends, lexicon.other + 1)
                    for k in range(len(ends) - 1):
                        if shards[at + k] != shard:
                            if trainer:
                                total, learned = finish(), learned + 1
                            shard, size = shards[at + k], 0
                            trainer = Trainer(start, gain, mass, [11, step, int(shard)])
                        own = slice(ends[k], ends[k + 1])
                        held.append((ids[own], one[own], two[own]))
                        size += ends[k + 1] - ends[k]
                        if size >= MIXED:
                            learn()
                            size = 0
            if trainer:
                total, learned = finish(), learned + 1
                yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), learned))], ["place", "value", "weight"])

        rows = dealt.where(F.col("round") == step).repartition("shard").sortWithinPartitions("shard", "turn", "text").select("shard", "text")
        sums = rows.mapInArrow(train, "place long, value long, weight long").groupBy("place").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).toArrow().sort_by("place")
        if len(sums):
            mean = sums["value"].to_numpy() / sums["weight"].to_numpy() / (1 << 24)
            start, gain = start.of(mean[: len(mean) // 2]), gain.of(mean[len(mean) // 2 :])
    return Model(lex, Tables.of(start), counts, int(whole["n"]), int(whole["v"]), outside, int(whole["v"]) - len(hashes))


def scores(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs, from its whole text.

    Tokens are the words, lower-cased in A-Z, and one end. base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1)));
    score is the model's log10 probability: a word of a cluster has the probability of the cluster times
    (c + 0.5) / (N' + 0.5 V'), where N' and V' count the cluster's tokens and words; outside the lexicon that of the last
    class times (c + 0.5) / (N' + 0.5 (V' + 1)). Null and empty texts have one end. Repeated
    rows and null doc_ids are rows like others; other columns are ignored. Empty input: no rows. Nothing learned: every
    count is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, tables = shared.value
        weight = np.log10(lexicon.counts + 0.5)
        for batch in batches:
            for lo, to, data, offsets in chunks(batch.column("text")):
                hashes, ends = tokens_of(data, offsets)
                at = lexicon.find(hashes)
                held = at >= 0
                ids = lexicon.classes(at)
                lm = tables.log10(ids, *_contexts(ids, ends, lexicon.other + 1))
                if len(weight):
                    lm += np.where(held, lexicon.shares[at], 0.0)
                logs = np.where(held, weight[at], 0.0) if len(weight) else np.zeros(len(at))
                total = lambda x: np.add.reduceat(x, ends[:-1])
                rare, times, sizes = [], [], [0]
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    word, n = np.unique(hashes[a:b][~held[a:b]], return_counts=True)
                    rare.append(word)
                    times.append(n.astype(np.int32))
                    sizes.append(sizes[-1] + len(word))
                place = pa.array(np.array(sizes, np.int32))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, to - lo), pa.array(np.diff(ends)), pa.array(total(held.astype(np.int64))), pa.array(total((~held).astype(np.int64))), pa.array(total(lm)), pa.array(total(logs)),
                     pa.ListArray.from_arrays(place, pa.array(signed(np.concatenate(rare)))), pa.ListArray.from_arrays(place, pa.array(np.concatenate(times)))],
                    ["doc_id", "n_tokens", "n_frequent", "n_other", "lm", "logs", "rare", "times"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = chosen.mapInArrow(run, "doc_id long, n_tokens long, n_frequent long, n_other long, lm double, logs double, rare array<long>, times array<int>")
    partial = scratch.save(partial.withColumn("row", F.monotonically_increasing_id()), "partial")  # written, so that row numbers stay
    rare = partial.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(model.counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    out = partial.drop("rare", "times").join(met, "row", "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    spread: Column = F.lit(float(np.log10(model.tokens + 0.5 * (model.distinct + 1))))
    inner: Column = F.lit(float(np.log10(model.other_tokens + 0.5 * (model.other_distinct + 1))))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * spread).alias("base_score"), (F.col("lm") + more - F.col("n_other") * inner).alias("score"),
    )
