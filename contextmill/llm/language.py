"""Operator 1: language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies cover all training documents. The weights are fitted by follow-the-regularised-leader (proximal)
with an elastic net on a bounded sample, and the probabilities are calibrated by one temperature on a part of that
sample which the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.llm.words import U, mix

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Documents of each language that the weights and the temperature are fitted on, about.
SAMPLE_PER_LANGUAGE = 500
#: Labels up to this number are broadcast with their shares; with more the join shuffles.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"


def counts_of(texts: list[str], orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """How often each text has n-grams of each bucket, shape (texts, BUCKETS): lower case, other characters than letters as one blank each."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    points, size = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array([len(p) for p in parts], np.int64)
    points = np.where((points < 97) | ((points > 122) & (points < 0xC0)), np.uint32(32), points).astype(U)
    owner = np.repeat(np.arange(len(parts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    out, key = np.zeros(len(parts) * BUCKETS, np.int32), np.zeros(len(points), U)
    with np.errstate(over="ignore"):
        for n in range(1, max(orders) + 1):
            if len(points) < n:
                break
            key = key[: len(points) - n + 1] * U(0x110001) + points[n - 1 :]
            if n in orders:
                own = left[: len(key)] >= n
                out += np.bincount(owner[: len(key)][own] * BUCKETS + (mix(key[own] + U(n)) >> U(50)).astype(np.int64), minlength=len(out)).astype(np.int32)
    return out.reshape(len(parts), BUCKETS)


def batches_of(texts: list[str | None], rows: int = 24, most: int = 1 << 18) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and n-gram counts of the texts that have a letter, a few at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if has_letter(text):
            held.append(i)
            size += len(text)
            if len(held) == rows or size > most:
                yield held, counts_of([texts[k] for k in held])
                held, size = [], 0
    if held:
        yield held, counts_of([texts[k] for k in held])


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of Unicode's letter categories."""
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def training_fold(doc_id: Column, parts: int, held: int) -> Column:
    """True for documents to learn from; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for held, counts in batches_of(batch.column("text").to_pylist()):
            n += len(held)
            df += (counts > 0).sum(0)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([n], df[at])))], ["bucket", "n"])


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for held, counts in batches_of(f.text.tolist()):
            own = f.iloc[held]
            at = [np.flatnonzero(c) for c in counts]
            yield pd.DataFrame({"lang": own.lang, "part": own.part, "turn": own.turn, "buckets": [a.astype(np.int32) for a in at], "counts": [c[a] for c, a in zip(counts, at, strict=True)]})


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets + 1, languages); the last row is the bias
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        """Of each row of counts: the sparse rows' products with the weights, summed row by row."""
        row, bucket = np.nonzero(counts)
        x = np.log1p(counts[row, bucket]) * self.idf[bucket]
        first = np.searchsorted(row, np.arange(len(counts)))
        norm = np.sqrt(np.add.reduceat(x * x, first))
        return np.add.reduceat(x[:, None] * self.weights[bucket], first) / norm[:, None] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.languages:
            for held, counts in batches_of(texts):
                z = self.logits(counts) / self.temperature
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, k, row in zip(held, p.argmax(1).tolist(), p, strict=True):
                    names[i], scores[i] = self.languages[k], float(row[k])
        return names, scores


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 6, batch: int = 16, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 5) -> np.ndarray:
    """Weights (buckets + 1, classes) by FTRL-proximal with per-coordinate rates and an elastic net."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.default_rng(seed)

    def weights() -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) > l1, w, 0)

    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            rows = np.zeros((len(own), BUCKETS + 1))
            rows[:, -1] = 1
            for r, k in enumerate(own):
                rows[r, x[k][0]] = x[k][1]
            w = weights()
            score = rows @ w
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            g = rows.T @ p / len(own)
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
    return weights()


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from rows (doc_id, text, lang). About ``sample`` documents of each language, chosen by a hash of doc_id,
    reach the driver as n-gram counts; document frequencies come from all rows."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    stats = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(stats.loc[stats.bucket == -1, "n"].sum())
    df = np.zeros(BUCKETS)
    known = stats[stats.bucket >= 0]
    df[known.bucket.to_numpy()] = known.n.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = rows.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))).select("lang", "share")
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    shares = rows.join(F.broadcast(sizes) if few else sizes, "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = shares.where(draw < F.col("share")).select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).alias("part"), F.xxhash64("doc_id", "text").alias("turn"))
    seen = chosen.mapInPandas(_vectors, "lang string, part long, turn long, buckets array<int>, counts array<int>").toPandas()
    seen = seen.assign(buckets=seen.buckets.map(np.asarray), counts=seen.counts.map(np.asarray)).sort_values(["lang", "part", "turn"])
    languages = sorted(seen.lang.unique())
    if not languages:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    y = seen.lang.map({k: i for i, k in enumerate(languages)}).to_numpy()
    x = []
    for b, c in zip(seen.buckets, seen.counts, strict=True):
        v = np.log1p(c) * idf[b]
        x.append((np.asarray(b), v / np.sqrt((v * v).sum())))
    fitting = np.flatnonzero(seen.part.to_numpy() != 0)
    model = Model(languages, idf, ftrl([x[i] for i in fitting], y[fitting], len(languages)), 1.0)
    held = np.flatnonzero(seen.part.to_numpy() == 0)
    if len(held):
        z = np.array([v @ model.weights[b] + model.weights[-1] for b, v in (x[i] for i in held)])
        def loss(t: float) -> float:
            s = z / t
            top = s.max(1)
            return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(held)), y[held]]).mean())
        model.temperature = min(np.geomspace(0.02, 10, 120), key=loss)
    return model


def predictor(docs: DataFrame, model: Model) -> Column:
    """The prediction of docs.text as a struct (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        names, scores = known.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from its whole text.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. A tie goes to the language that
    comes first. Repeated rows and null doc_ids are rows like others; other columns are ignored. Empty input: no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predictor(docs, model).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose language is determined: all but those that get ``und``."""
    return docs.where(predictor(docs, model)["lang_pred"] != UNKNOWN)
