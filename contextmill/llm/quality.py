"""Operator 11: quality by the votes of labelled neighbours in a latent-semantic space.

A text's terms are its words, the shapes of its three-character runs, and levels of some shares: words that repeat the one
before, three-word windows met before in the text, capitals, symbols, digits. TF-IDF vectors of a bounded labelled sample are
reduced by a truncated singular value decomposition; the sample's reduced vectors and labels are broadcast. Every text is
folded into the same space, its cosines with all labelled vectors are computed block by block, and the nearest ones vote
with the weight of their similarity.

Coordinates are whole multiples of 2**-11, so that a cosine is a sum of integers below 2**24, which single precision holds
exactly: the votes do not depend on blocks, partitions or the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.templates import _TOKEN
from contextmill.llm.words import FOLD, U, chunks, windows_of, words_of

#: Terms: shapes of three characters, hashed words, levels of shares.
SHAPES, WORDS, LEVELS = 16**3, 4096, 5 * 16
TERMS = SHAPES + WORDS + LEVELS
#: Labelled documents of each class that stand in the space, about.
SAMPLE_PER_CLASS = 1500
DIMENSIONS = 64
#: So many nearest labelled documents vote, and all others as near as the last of them.
NEIGHBOURS = 24
#: A vote weighs the similarity to this power.
SHARPNESS = 8
#: Weight of the classes' shares among all labelled documents, in votes.
PRIOR = 0.05
THRESHOLD = 0.3
#: A coordinate is a multiple of 1 / STEPS.
STEPS = 1 << 11
#: Texts in one dense block of counts, and bytes of text in it unless one text is longer.
ROWS, BYTES = 64, 1 << 18
#: Label rows up to this number (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000


def _classes() -> np.ndarray:
    """Class of a byte: lower case, capital, digit, not ASCII, blank, line end, and ten of punctuation and the rest."""
    out = np.array([6 + b % 10 for b in range(256)], np.int64)
    for k, held in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), (9, 11, 12, 32), (10, 13))):
        out[list(held)] = k
    return out


CLASS = _classes()


def _levels(share: np.ndarray) -> np.ndarray:
    """How many of 16 levels a share reaches: from 1/256 on, each the square root of two above the one before."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(2 * np.log2(share * 256)) + 1, 0, 16).astype(np.int64)


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text has each term, shape (texts, TERMS)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = CLASS[data]
    out = np.zeros(n * TERMS, np.int64)
    if len(data) > 2:
        whole = owner[:-2] == owner[2:]
        shape = kind[:-2] * 256 + kind[1:-1] * 16 + kind[2:]
        out += np.bincount(owner[:-2][whole] * TERMS + shape[whole], minlength=len(out))
    w = words_of(data, offsets, _TOKEN, FOLD)
    of = np.repeat(np.arange(n), w.counts)
    out += np.bincount(of * TERMS + SHAPES + (w.hashes >> U(52)).astype(np.int64), minlength=len(out))
    out = out.reshape(n, TERMS)
    again = np.zeros(len(of), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
    window, fits = windows_of(w, 3)
    at = np.flatnonzero(fits)
    order = at[np.lexsort((window[at], of[at]))]
    seen = np.zeros(len(of), bool)
    seen[order[1:]] = (window[order[1:]] == window[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    words, letters = np.maximum(1, w.counts), np.maximum(1, size)
    of_bytes = lambda held: np.bincount(owner[held], minlength=n) / letters
    shares = [np.bincount(of[again], minlength=n) / words, np.bincount(of[seen], minlength=n) / words, of_bytes(kind == 1), of_bytes(kind > 5), of_bytes(kind == 2)]
    for k, share in enumerate(shares):
        first = SHAPES + WORDS + 16 * k
        out[:, first : first + 16] = np.arange(16) < _levels(share)[:, None]
    return out


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, end and counts of a few texts at a time."""
    for first in range(0, len(column), ROWS):
        for at, to, data, offsets in chunks(column.slice(first, ROWS), BYTES):
            yield first + at, first + to, counts_of(data, offsets)


def sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and dampened count of all counts that are not zero, row by row."""
    row, term = np.nonzero(counts)
    return row, term, np.log1p(counts[row, term])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(TERMS, np.int64)
    for batch in batches:
        for at, to, counts in blocks(batch.column("text")):
            n += to - at
            df += (counts > 0).sum(0)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([n], df[at])))], ["term", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, counts in blocks(batch.column("text")):
            row, term, value = sparse(counts)
            ends = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (term.astype(np.int32), value.astype(np.float32))]
            yield pa.record_batch([batch.column("quality").slice(at, to - at), batch.column("turn").slice(at, to - at), *lists], ["quality", "turn", "terms", "counts"])


@dataclass
class Space:
    idf: np.ndarray
    middle: np.ndarray  # projected mean of the sample
    axes: np.ndarray  # (terms, dimensions)
    vectors: np.ndarray  # (labelled documents, dimensions), in steps
    labels: np.ndarray  # of the labelled documents
    weights: np.ndarray  # documents that a labelled document of either class stands for
    prior: float

    def folded(self, counts: np.ndarray) -> np.ndarray:
        """Coordinates of each row of counts in steps, as unit vectors; zero for texts without terms."""
        row, term, value = sparse(counts)
        return self.placed(len(counts), row, term, value)

    def placed(self, n: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros((n, self.axes.shape[1]))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            x = value * self.idf[term]
            norm = np.sqrt(np.add.reduceat(x * x, first))
            out[row[first]] = np.add.reduceat(x[:, None] * self.axes[term], first) / norm[:, None] - self.middle
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return np.rint(out / np.maximum(length, 1e-12) * STEPS).astype(np.float32)

    def votes(self, places: np.ndarray) -> np.ndarray:
        """Score of each row of coordinates, from its exact products with all labelled vectors."""
        if not len(self.labels):
            return np.full(len(places), self.prior)
        near = places @ self.vectors.T  # whole numbers, exact in any order
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
        near = np.where(near >= least[:, None], np.maximum(near, 0), 0).astype(np.float64) / STEPS**2
        weight = near**SHARPNESS
        bad = (weight * (self.labels == 0)).sum(1) * self.weights[0]
        good = (weight * (self.labels == 1)).sum(1) * self.weights[1]
        return (good + PRIOR * self.prior) / (good + bad + PRIOR)


def axes_of(x: np.ndarray, dimensions: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start; terms are rows."""
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(x.shape[1], min(*x.shape, dimensions + 16))).astype(np.float32)
    for _ in range(6):
        y, _ = np.linalg.qr(x.T @ (x @ y))
    turn = np.linalg.svd(x @ y, full_matrices=False)[2]
    return (y @ turn.T)[:, :dimensions].astype(np.float64)


def fit(docs: DataFrame, learn: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Space:
    """The space of labelled documents: rows of learn (doc_id, text) that labels (doc_id, quality) mark; null labels are left
    out, and a document with both labels is of quality 0.

    Document frequencies cover all rows of docs. About ``sample`` documents of each class, chosen by a hash of doc_id, reach
    the driver as lists of terms; each stands for its class's size over its sample. Without labels every score is 0.5.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    stats = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total, known = int(stats.loc[stats.term < 0, "n"].sum()), stats[stats.term >= 0]
    df = np.zeros(TERMS)
    df[known.term.to_numpy(np.int64)] = known.n.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1
    ids = learn.select("doc_id").join(marks, "doc_id")
    sizes = {bool(r.label): r["n"] for r in ids.groupBy((F.col("quality") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(False, 0), sizes.get(True, 0)
    empty = Space(idf, np.zeros(DIMENSIONS), np.zeros((TERMS, DIMENSIONS)), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.ones(2), (good + 0.5) / (bad + good + 1))
    if not bad + good:
        return empty
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("quality") > 0, min(1.0, sample / max(good, 1))).otherwise(min(1.0, sample / max(bad, 1)))
    rows = learn.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marks, "doc_id").where(draw < limit)
    chosen = rows.select("text", (F.col("quality") > 0).cast("int").alias("quality"), F.xxhash64("doc_id", "text").alias("turn"))
    seen = chosen.mapInArrow(_vectors, "quality int, turn long, terms array<int>, counts array<float>").toArrow().sort_by([("quality", "ascending"), ("turn", "ascending")]).combine_chunks()
    if not len(seen):
        return empty
    y = seen.column("quality").to_numpy()
    flat = [seen.column(c).combine_chunks() for c in ("terms", "counts")]
    row = np.repeat(np.arange(len(y)), np.diff(flat[0].offsets.to_numpy()))
    term, value = flat[0].flatten().to_numpy(), flat[1].flatten().to_numpy().astype(np.float64)
    x = np.zeros((len(y), TERMS), np.float32)
    x[row, term] = value * idf[term]
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    mean = x.mean(0)
    x -= mean
    axes = axes_of(x, DIMENSIONS)
    space = Space(idf, mean.astype(np.float64) @ axes, axes, empty.vectors, y, np.array([bad, good]) / np.maximum(1, np.bincount(y, minlength=2)), empty.prior)
    space.vectors = np.concatenate([space.placed(n, row[a:b] - at, term[a:b], value[a:b]) for at, n, a, b in _parts(row, len(y))])
    return space


def _parts(row: np.ndarray, rows: int) -> Iterator[tuple[int, int, int, int]]:
    """First row, number of rows and range of entries of pieces of a sparse matrix."""
    for at in range(0, rows, ROWS):
        n = min(ROWS, rows - at)
        a, b = np.searchsorted(row, (at, at + n))
        yield at, n, int(a), int(b)


def scores(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, score for every row of docs, from its whole text: the estimated probability of the label 1.

    Null and empty texts have no place in the space; they get the classes' share among the labelled documents. Repeated rows
    and null doc_ids are rows like others; other columns are ignored. Empty input: no rows. The broadcast is bounded by
    TERMS x DIMENSIONS and the labelled sample (5 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, to, counts in blocks(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(at, to - at), pa.array(known.votes(known.folded(counts)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
