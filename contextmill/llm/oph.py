"""Operator 3: document fingerprints by one-permutation MinHash.

Each shingle is hashed once: the upper part of the hash is its bin, the rest its rank, and a bin keeps the smallest. Empty
bins borrow from a full bin that a fixed random order of bins, one for each bin, meets first (optimal densification). Of
each bin's value, hashed with the bin, the low 4 bits are packed; the likeness of two fingerprints is the share of equal bins less the share that
chance gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch
from contextmill.llm.setsketch import shingle_sets
from contextmill.llm.words import FOLD, NOT_SPACE, U, chunks, mix, seeded, words_of

BINS = 512
BITS = 4
#: Rows of a block of neighbouring documents, about.
BLOCK_ROWS = 2000
#: Beyond so many blocks they grow instead (1 GB each at 100 TB): a block is sorted and read as a stream, so its size costs no memory.
MOST_BLOCKS = 100_000
#: Rows of the sample that the cuts between blocks come from, for each block: 16 bytes a row reach the driver.
SAMPLED = 10
_probe = np.argsort(seeded(BINS * BINS, 4242).reshape(BINS, BINS), axis=1)


def signatures(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Low bits of the filled bins, shape (sets, BINS); -1 throughout for an empty set."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    h = mix(elements ^ U(0x94D049BB133111EB))
    least = np.full(n * BINS, ~U(0))
    np.minimum.at(least, owner * BINS + (h >> U(55)).astype(np.int64), h & U((1 << 55) - 1))
    least = least.reshape(n, BINS)
    full = least != ~U(0)
    base, out = least, least.copy()
    row, col = np.nonzero(~full & full.any(1)[:, None])
    for t in range(48):
        if not len(row):
            break
        source = _probe[col, t]
        hit = full[row, source]
        out[row[hit], col[hit]] = base[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r in np.unique(row):  # few full bins: the rest of each order at once
        cols = col[row == r]
        out[r, cols] = base[r, _probe[cols, full[r][_probe[cols]].argmax(1)]]
    # a borrowed value is hashed with its new bin, so that chance hits one bin of a small set and not all that borrow
    with np.errstate(over="ignore"):
        low = (mix(out + seeded(BINS, 31)) & U((1 << BITS) - 1)).astype(np.int64)
    low[~full.any(1)] = -1
    return low


def pack(signature: np.ndarray) -> list[bytes]:
    """Fingerprints of signatures: two bins a byte; no bytes for an empty set."""
    both = (np.maximum(signature, 0)[:, 0::2] << 4 | np.maximum(signature, 0)[:, 1::2]).astype(np.uint8)
    return [b"" if s[0] < 0 else x.tobytes() for s, x in zip(signature, both, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signatures, corrected for bins that are equal by chance: 0 to 1.

    Two empty sets have 1, an empty and another 0.
    """
    chance = 2.0**-BITS
    share = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    empty = (a[:, 0] < 0).astype(int) + (b[:, 0] < 0)
    return np.where(empty == 2, 1.0, np.where(empty == 1, 0.0, share))


def signatures_of(texts: list[str]) -> np.ndarray:
    out = [np.zeros((0, BINS), np.int64)]
    for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        out.append(signatures(*shingle_sets(words_of(data, offsets, NOT_SPACE, FOLD))))
    return np.concatenate(out)


def edited(text: str, following: str) -> str:
    """The text with its last third, rounded down, replaced by as many characters from the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # the last row so far; its next one may come with the next batch

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[3] for r in rows]
        own = signatures_of(texts)
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if pairs:
            new = [edited(texts[i], texts[i + 1]) for i in pairs]
            other = signatures_of(new)
            following = own[np.array(pairs) + 1]
            own = own[pairs]
            yield pa.record_batch(
                [pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()), pa.array(new, pa.string()), pa.array(pack(own), pa.binary()), pa.array(pack(other), pa.binary()),
                 pa.array(likeness(own, other)), pa.array(likeness(own, following))],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    for batch in batches:
        block, tail, ids, texts = (batch.column(c) for c in ("block", "tail", "doc_id", "text"))
        size = 0
        for i in range(batch.num_rows):
            held.append((block[i].as_py(), tail[i].as_py(), ids[i].as_py(), texts[i].as_py()))
            size += len(held[-1][3])
            if size > 1 << 20:
                yield from done(held)
                held, size = held[-1:], 0
        if len(held) > 1:
            yield from done(held)
            held = held[-1:]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary) for every row of docs: see ``neighbours`` for the cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(pack(signatures_of(texts)), pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def neighbours(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every row of docs: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    A set is the distinct shingles of five words, lower-cased in A-Z, or the whole sequence if it is shorter. The next
    document is the one with the next smaller doc_id, after the last the first; a null doc_id comes last, and rows that
    repeat a doc_id follow each other by a hash of their texts and the texts themselves. Null texts are empty; texts
    without words have an empty fingerprint. A single row is its own next one. Other columns are ignored. Empty input:
    no rows.

    Rows are dealt by ranges of this order (doc_id, then hash of the text), so only the first row of each range is sent
    twice, and an id that many rows have, null too, is cut like others. Only rows equal in id and text stay together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    count = rows.select("doc_id").count()
    parts = max(1, min(count // block_rows, MOST_BLOCKS))
    share = min(1.0, SAMPLED * parts / max(1, count))
    turned = [F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("id"), F.col("h")]  # ascending
    sample = rows.select(*turned).where(F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).toPandas() if parts > 1 else pd.DataFrame({"none": [], "id": [], "h": []})
    keys = sample.to_numpy(np.int64).T
    keys = keys[:, np.lexsort(keys[::-1])]
    bounds = spark.sparkContext.broadcast(keys[:, [len(keys[0]) * k // parts for k in range(1, parts)]] if len(keys[0]) >= parts else keys)

    @F.pandas_udf("long")
    def block_of(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        cuts = bounds.value
        none, ids, hashes = (np.concatenate((c, x.to_numpy(np.int64))) for c, x in zip(cuts, (none, ids, hashes), strict=True))
        order = np.lexsort((np.arange(len(ids)) >= cuts.shape[1], hashes, ids, none))
        passed = np.cumsum(order < cuts.shape[1])  # cuts that are not behind the row
        out = np.zeros(len(order), np.int64)
        out[order] = passed
        return pd.Series(out[cuts.shape[1] :])

    dealt = rows.withColumn("block", block_of(*turned))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("a"), F.col("h").alias("b"), F.col("text").alias("c"))
    firsts = dealt.groupBy("block").agg(F.min(place).alias("first"))
    heads = scratch.save(firsts.select("block", F.bitwise_not("first.a").alias("doc_id"), F.col("first.c").alias("text")), "heads")
    turn = heads.select("block").toPandas()["block"].sort_values().tolist()  # one number for each block
    after = spark.createDataFrame([(b, turn[k - 1]) for k, b in enumerate(turn)], "block long, goes_to long")
    tails = heads.join(after, "block").select("doc_id", "text", F.col("goes_to").alias("block"), F.lit(True).alias("tail"))
    both = dealt.select("doc_id", "text", "block", F.lit(False).alias("tail")).union(tails)
    ordered = both.repartition(parts, "block").sortWithinPartitions("block", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return ordered.select("block", "tail", "doc_id", "text").mapInArrow(_compare, "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")
