"""Operator 12: resampling by importance towards a target distribution of hashed n-grams.

Each partition grows a trie of words: a node is a run of one to three words, and holds how often the run was met and the
CRC-32 of its bytes, which an edge carries on from the parent's. A node's CRC gives its bucket, so nodes fold into bucket
totals, the only thing that leaves a partition. The totals of corpus and target give each bucket a gain; in a second walk
nodes get the gains of their buckets, and a text's weight is the sum over the nodes it passes. Weights plus seeded Gumbel
noise rank the texts, which draws without replacement in proportion to the exponentials of the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch
from contextmill.llm.templates import _TOKEN
from contextmill.llm.words import FOLD, U, chunks, words_of
from contextmill.operators.folds import running

BUCKETS = 10_000
#: Longest run of words.
ORDER = 3
#: Texts with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: A weight is a sum of thousandths.
SCALE = 1000
#: A trie with more nodes is folded into its bucket totals and begun anew; about 40 bytes a node.
NODES = 1 << 20


@cache
def _shifts() -> list[np.ndarray]:
    """Table k carries a CRC-32 over 2**k more bytes of zero: one row of 256 for each byte of the state."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [byte[state & 255] ^ (state >> 8)]
    for _ in range(40):
        tables.append(_shift(tables[-1], tables[-1]))
    return tables


def _shift(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


def carried(state: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined byte strings, from that of the first part, that of the second and the second's length."""
    for k in range(int(length.max(initial=0)).bit_length()):
        on = (length >> k) & 1 > 0
        state = np.where(on, _shift(_shifts()[k], state), state)
    return state ^ more


class Trie:
    """Runs of one to ``order`` words. Nodes are numbered level by level; ``count`` and ``state`` have an entry for each."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.clear()

    def clear(self) -> None:
        of = lambda kind: [np.zeros(0, kind) for _ in range(self.order)]
        self.keys, self.number, self.count, self.state = of(U), of(np.int64), of(np.int64), of(np.uint32)
        self.edge, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # of a word after a blank

    def __len__(self) -> int:
        return sum(map(len, self.keys))

    def _enter(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers of keys at a level, and places in keys where a new node is met first, by number."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        have = self.keys[level]
        at = np.searchsorted(have, unique)
        known = at < len(have)
        known[known] = have[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        number = np.empty(len(unique), np.int64)
        number[known] = self.number[level][at[known]]
        number[new] = len(have) + np.arange(len(new))
        self.keys[level] = np.insert(have, at[new], unique[new])
        self.number[level] = np.insert(self.number[level], at[new], number[new])
        self.count[level] = np.concatenate((self.count[level], np.zeros(len(new), np.int64)))
        return number[inverse], first[new]

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text, and for each level the texts and node numbers of all its runs; new paths are added."""
        w = words_of(data, offsets, _TOKEN, FOLD)
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        word, new = self._enter(0, w.hashes)
        folded = FOLD[data]
        bytes_of = [folded[a:b].tobytes() for a, b in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)]
        self.state[0] = np.concatenate((self.state[0], np.array([zlib.crc32(b) for b in bytes_of], np.uint32)))
        self.edge = np.concatenate((self.edge, np.array([zlib.crc32(b" " + b) for b in bytes_of], np.uint32)))
        self.length = np.concatenate((self.length, np.array([len(b) + 1 for b in bytes_of], np.int64)))
        paths, node = [(text, word)], word
        for level in range(1, self.order):
            held = np.flatnonzero(text[level:] == text[:-level]) if len(text) > level else np.zeros(0, np.int64)
            parent, last = node[held], word[held + level]
            node = np.zeros(len(word), np.int64)
            node[held], new = self._enter(level, (parent.astype(U) << U(32)) | last.astype(U))
            state = carried(self.state[level - 1][parent[new]], self.edge[last[new]], self.length[last[new]])
            self.state[level] = np.concatenate((self.state[level], state.astype(np.uint32)))
            paths.append((text[held], node[held]))
        return w.counts, paths

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """Counts the runs of some texts."""
        for level, (_, node) in enumerate(self.walk(data, offsets)[1]):
            self.count[level] += np.bincount(node, minlength=len(self.count[level]))

    def totals(self, buckets: int) -> np.ndarray:
        """Runs met in each bucket."""
        out = np.zeros(buckets, np.int64)
        for count, state in zip(self.count, self.state, strict=True):
            np.add.at(out, state % buckets, count)
        return out


def totals(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """bucket, n: runs of words of all rows of texts by bucket; null texts have none. A partition gives a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(order), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                trie.add(data, offsets)
                if len(trie) > NODES:
                    out += trie.totals(buckets)
                    trie.clear()
        out += trie.totals(buckets)
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at), pa.array(out[at])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of its share in target over that in corpus, each count one higher, floored."""
    s, t = (totals(x, buckets, order).withColumnRenamed("n", name) for x, name in ((corpus, "s"), (target, "t")))
    both = s.join(t, "bucket", "full").na.fill(0)
    own = both.select("bucket", "s", "t").toPandas()  # a row a bucket at most
    sums = own[["s", "t"]].sum()
    out = np.zeros((2, buckets))
    out[0, own.bucket], out[1, own.bucket] = own.s, own.t
    return np.floor(SCALE * np.log((out[1] + 1) * (float(sums.s) + buckets) / ((out[0] + 1) * (float(sums.t) + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of docs: the sum of the gains of all its runs of words."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gain = Trie(order), shared.value
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                words, paths = trie.walk(data, offsets)
                n, weight = np.zeros(to - at, np.int64), np.zeros(to - at, np.int64)
                for state, (text, node) in zip(trie.state, paths, strict=True):
                    attached = gain[state % len(gain)]  # of every node
                    n += np.bincount(text, minlength=to - at)
                    weight += np.bincount(text, attached[node], to - at).astype(np.int64)  # whole numbers below 2**53
                yield pa.record_batch([batch.column("doc_id").slice(at, to - at), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
                if len(trie) > NODES:
                    trie.clear()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text), towards the texts of target.

    rank is 1, 2, 3 ... along falling scores, ties to the smaller doc_id, for floor(percent * N / 100) of the N rows with at
    least so many words, else null. Null and empty texts have weight 0 and no rank. Rows that repeat a doc_id are drawn each
    on its own, with the same noise; a null doc_id has the noise of the empty string and stands last among ties. An empty
    target or corpus has totals of 0. Other columns are ignored. Empty input: no rows.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise).withColumn("place", F.monotonically_increasing_id())
    scored = scratch.save(scored, "scored")
    may = F.col("n_words") >= least
    drawn = scored.where(may).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    # place tells rows with one doc_id and score apart, so that ranges can split them
    ranked = running(scored.where(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")], F.lit(1), "rank")
    rest = scored.where(~may).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest)
