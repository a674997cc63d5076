"""Operator 2: removal of repeated passages with a log-structured index of window fingerprints.

The fingerprint of a window of 50 words is the smallest hash of its 12-word grams, so a repeated window has the same
fingerprint wherever it stands, while neighbouring windows share it and the index holds a few per cent of the positions.
Each batch of documents becomes one immutable run: a table bucketed and sorted by fingerprint. The batch is merge-joined,
bucket by bucket, with the runs before it, which are never exchanged; for fingerprints that meet, whole windows are
compared by a cryptographic digest of their bytes. The few fingerprints that very many documents of a batch have are kept
beside the buckets, in files of equal size, and are met by a broadcast of themselves. Runs of one level are merged into a run of the next level, again bucket
by bucket, once there are ``fanout`` of them. The index lives in a folder and can be opened by a later session.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch
from contextmill.llm.words import U, Words, chunks, signed, windows_of, words_of

WINDOW = 50
GRAM = 12
FANOUT = 2
#: Two batches make a run of the next level, so that the third meets a compacted one.
BATCHES = 3
#: Fingerprints with more than this part of a batch's posts, so no more of them than this, are heavy: no bucket has them.
HEAVY = 256
#: Posts of a fingerprint in the sample of a sixteenth of the documents from which it can be heavy.
HEAVY_LEAST = 32
_TAG = 0x7FFFFFFF
#: In place of a mark's first word: all words of the text.
_ALL = 0xFFFFFFFF


def fingerprints(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the window from each word on, and whether the window lies in its text."""
    least, fits = windows_of(w, min(gram, window))
    least[~fits] = ~U(0)
    span, width = window - min(gram, window) + 1, 1
    while width * 2 <= span:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        by = span - width
        least[:-by] = np.minimum(least[:-by], least[by:])
    left = np.repeat(w.offsets[1:], w.counts) - np.arange(len(w.hashes))
    return least, left >= window


def sequences(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The words of each text."""
    whole = data.tobytes()
    return [whole[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def key_of(words: list[bytes]) -> bytes:
    """16 bytes that stand for the word sequence."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _tag(key: bytes) -> int:
    return int.from_bytes(key[:4], "little") & _TAG


_DIGEST = np.dtype([("w1", "<i8"), ("w2", "<i4")])


def digests(words: list[bytes], where: np.ndarray, window: int) -> np.ndarray:
    """12-byte digests of the ``window`` words from each place on."""
    whole = b" ".join(words)
    start = np.concatenate(([0], np.cumsum([len(x) + 1 for x in words])))
    spans = zip(start[where].tolist(), (start[where + window] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join(hashlib.blake2b(whole[a:b], digest_size=12).digest() for a, b in spans), _DIGEST)


def _survey(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                w = words_of(data, offsets)
                least, fits = fingerprints(w, window)
                new = fits.copy()
                new[1:] &= (least[1:] != least[:-1]) | ~fits[:-1]
                own = [np.unique(least[a:b][new[a:b]]) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
                keys = np.frombuffer(b"".join(map(key_of, sequences(data, offsets))), np.int64)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, to - at), pa.array(w.counts.astype(np.int64)), pa.array(keys[0::2]), pa.array(keys[1::2]), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(own))))],
                    ["doc_id", "n_words", "key1", "key2", "prints"],
                )

    return run


def _windows(window: int):
    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["w1", "w2", "doc_id", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            shared = batch.column("prints")
            for at, to, data, offsets in chunks(batch.column("text")):
                w = words_of(data, offsets)
                least, fits = fingerprints(w, window)
                wanted = np.zeros(len(least), bool)
                for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
                    wanted[a:b] = np.isin(least[a:b], shared[at + i].values.to_numpy().view(U))
                wanted &= fits
                for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
                    where = np.flatnonzero(wanted[a:b])
                    if not len(where):
                        continue
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    tag, doc = _tag(key_of(words)) << 32, batch.column("doc_id")[at + i].as_py()
                    for s in range(0, len(where), 1 << 16):
                        part = where[s : s + (1 << 16)]
                        found = digests(words, part, window)
                        held.append((found["w1"], found["w2"], np.full(len(part), doc), tag | part))
                        size += len(part)
                        if size >= 1 << 16:
                            yield rows(held)
                            held, size = [], 0
            if held:
                yield rows(held)
                held, size = [], 0

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("marks")
            for at, to, data, offsets in chunks(batch.column("text")):
                n_words, n_removed, kept = [], [], []
                for i in range(to - at):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    n, own = len(words), marks[at + i].values
                    gone = 0
                    if own is not None and len(own):
                        own = own.to_numpy()
                        start = own[own >> 32 == _tag(key_of(words))] & _ALL
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, start[start != _ALL], 1)
                        np.add.at(edge, start[start != _ALL] + window, -1)
                        keep = (np.cumsum(edge)[:n] == 0) & ~(start == _ALL).any()
                        gone, words = n - int(keep.sum()), list(compress(words, keep))
                    n_words.append(n)
                    n_removed.append(gone)
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                out = {"doc_id": batch.column("doc_id").slice(at, to - at), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())}
                if "row" in batch.schema.names:
                    out["row"] = batch.column("row").slice(at, to - at)
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


class WindowIndex:
    """Fingerprints of all batches added so far, as runs in a folder that driver and executors share.

    Batches must come in ascending ranges of doc_id; ``add`` raises ValueError otherwise, since "earlier" is decided by
    doc_id alone. The manifest, a small table, is written anew after each change, so a driver that dies between leaves the
    state before. ``open`` goes on with an index of an earlier session.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.window, self.fanout = spark, path.rstrip("/"), window, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, int] = {}
        self.heavy: dict[str, list[int]] = {}
        self.last: int | None = None
        self.version = 0
        self.tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> WindowIndex:
        at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        found = [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
        versions = sorted(int(x.split("-")[1]) for x in found if x.startswith("manifest-"))
        for version in reversed(versions):
            rows = spark.read.parquet(f"{path.rstrip('/')}/manifest-{version}").collect()
            if rows:
                out = cls(spark, path, rows[0].window, rows[0].fanout, rows[0].buckets)
                out.last, out.version, out.runs, out.heavy = rows[0].last, version, {r.name: r.level for r in rows}, {r.name: list(r.heavy) for r in rows}
                return out
        raise ValueError(f"no index in {path}")

    def _record(self) -> None:
        rows = [(name, level, self.window, self.fanout, self.buckets, self.last, self.heavy[name]) for name, level in self.runs.items()]
        self.spark.createDataFrame(rows, "name string, level int, window int, fanout int, buckets int, last long, heavy array<long>").coalesce(1).write.parquet(f"{self.path}/manifest-{self.version + 1}")
        self._delete(f"manifest-{self.version}")
        self.version += 1

    def _delete(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _write(self, posts: DataFrame, level: int, heavy: DataFrame | None = None, prints: list[int] = ()) -> str:
        """A run of posts that are dealt by fingerprint already, each bucket a sorted file, and of those of heavy fingerprints."""
        name = f"run-{uuid.uuid4().hex}"
        posts.select("print", "doc_id").write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "print").sortBy("print").saveAsTable(f"windows_{name[4:]}")
        if prints:
            heavy.select("print", "doc_id").write.option("compression", "zstd").parquet(f"{self.path}/heavy-{name}")
        self.tables[name], self.heavy[name] = f"windows_{name[4:]}", list(prints)
        self.runs[name] = level
        return name

    def _heavy_prints(self, posts: DataFrame) -> list[int]:
        """Fingerprints of more than a HEAVY-th of the posts of some documents: where they are kept changes no result."""
        counts = posts.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).groupBy("print").agg(F.count(F.lit(1)).alias("n"))
        whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return sorted(r["print"] for r in counts.where(F.col("n") > max(HEAVY_LEAST, whole // HEAVY)).collect())

    def _few(self, prints: list[int]) -> DataFrame:
        """Heavy fingerprints as a table to broadcast: at most HEAVY of each batch."""
        return F.broadcast(self.spark.createDataFrame([(p,) for p in prints], "print long"))

    def heavy_posts(self, name: str) -> DataFrame:
        """The posts of a run's heavy fingerprints."""
        schema = "print long, doc_id long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/heavy-{name}") if self.heavy[name] else self.spark.createDataFrame([], schema)

    def run(self, name: str) -> DataFrame:
        """The posts (print, doc_id) of a run; Spark knows how it is bucketed."""
        if name not in self.tables:
            table = f"windows_{name[4:]}_{uuid.uuid4().hex[:8]}"
            self.spark.sql(f"CREATE TABLE {table} (print LONG, doc_id LONG) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def posts(self) -> DataFrame:
        return reduce(DataFrame.union, [*map(self.run, self.runs), *map(self.heavy_posts, self.runs)])

    def close(self) -> None:
        """Forgets the tables' names; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}

    def met(self, new: str, old: list[str]) -> DataFrame:
        """(print, doc_id): posts of all runs whose fingerprint is in the new run and in another document of any run."""
        own = self.run(new)
        prints = own.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        before = [self.run(name).join(prints.hint("merge"), "print", "left_semi") for name in old]
        shared = prints.where("first < last").select("print")
        both = reduce(DataFrame.union, [x.select("print") for x in before], shared)
        mine, out = self.heavy[new], before
        for name in old:  # heavy fingerprints are few: both ways by a broadcast of them
            if mine:
                out = [*out, self.run(name).join(self._few(mine), "print", "left_semi")]
            if theirs := self.heavy[name]:
                light = prints.select("print").join(self._few(theirs), "print", "left_semi")
                both = both.union(light)
                known = light if not mine else light.union(self._few(mine).join(self._few(theirs), "print", "left_semi"))
                out = [*out, self.heavy_posts(name).join(F.broadcast(known.distinct()), "print", "left_semi")]
        out = [*out, own.join(both, "print", "left_semi")]
        return reduce(DataFrame.union, out if not mine else [*out, self.heavy_posts(new)])

    def add(self, batch: DataFrame, texts: DataFrame, scratch: Scratch, name: str, compact: bool = True) -> DataFrame:
        """Adds a batch (doc_id, prints) and returns (doc_id, marks): its windows that start in an earlier document too.

        texts (doc_id, text) has the documents of this batch and of all before it; only those with a fingerprint that
        meets are cut into windows. A mark is a window's first word with a tag of its text above bit 31.
        """
        edge = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        if edge[0] is None:
            return self.spark.createDataFrame([], "doc_id long, marks array<long>")
        if self.last is not None and edge[0] <= self.last:
            raise ValueError(f"batches must ascend: {edge[0]} comes after {self.last}")
        old = list(self.runs)
        posts = batch.select(F.explode("prints").alias("print"), "doc_id")
        prints = self._heavy_prints(posts)
        light = posts.join(self._few(prints), "print", "left_anti") if prints else posts
        heavy = posts.join(self._few(prints), "print", "left_semi").distinct().hint("rebalance") if prints else None
        new = self._write(light.repartition(self.buckets, "print").distinct(), 0, heavy, prints)
        self.last = edge[1]
        self._record()
        asked = self.met(new, old).groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
        windows = texts.join(asked, "doc_id").select("doc_id", "text", "prints").mapInArrow(_windows(self.window), "w1 long, w2 int, doc_id long, mark long")
        windows = scratch.save(windows, f"{name}-windows")
        firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
        firsts = scratch.save(firsts, f"{name}-firsts")  # a join of written tables: Spark can split a window that very many documents have
        late = windows.where(F.col("doc_id") >= edge[0]).join(firsts, ["w1", "w2"]).where("doc_id > first")
        marks = scratch.save(late.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), f"{name}-marks")
        scratch.drop(f"{name}-windows", f"{name}-firsts")
        if compact:
            self.compact()
        return marks

    def compact(self) -> None:
        """Merges the runs of a level into one of the next level wherever there are ``fanout``: bucket by bucket, without an exchange."""
        while True:
            levels = list(self.runs.values())
            level = min((k for k in levels if levels.count(k) >= self.fanout), default=None)
            if level is None:
                return
            old = [n for n, k in self.runs.items() if k == level]
            prints = sorted({p for n in old for p in self.heavy[n]})
            self._write(reduce(DataFrame.union, map(self.run, old)), level + 1, reduce(DataFrame.union, map(self.heavy_posts, old)), prints)
            for n in old:
                del self.runs[n], self.heavy[n]
            self._record()
            for n in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(n)}")
                self._delete(n)
                self._delete(f"heavy-{n}")


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs; with ``carry`` also row, a struct of all its columns.

    Words are runs of bytes other than space and \\t to \\r, unchanged. Each word that a window of ``window`` words covers
    whose word sequence also starts in a document with a smaller doc_id is removed; windows are judged on the input.
    kept joins the other words by one space. Null and empty texts have no words and an empty kept. Rows that repeat a
    doc_id never remove each other's words; a null doc_id is left whole and removes nothing. Other columns are ignored.
    Empty input: no rows.

    Documents with equal word sequences beyond the first lose all words at once, since each of their windows starts in
    the first too; so only the first of each sequence enters the index, in ``batches`` ranges of doc_id with about as many
    documents each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.save(texts.mapInArrow(_survey(window), "doc_id long, n_words long, key1 long, key2 long, prints array<long>"), "survey")
    able = found.where(f"n_words >= {window} and doc_id is not null")
    # written, so that Spark can split the join with it at a sequence that very many documents have
    firsts = scratch.save(able.groupBy("key1", "key2").agg(F.min("doc_id").alias("first")), "sequences")
    marked = able.join(firsts, ["key1", "key2"])
    copies = marked.where("doc_id > first").select("doc_id", F.expr(f"array(shiftleft(key1 & {_TAG}L, 32) | {_ALL}L)").alias("marks"))
    reps = scratch.save(marked.where("doc_id = first").select("doc_id", "prints"), "first")
    index, marks = WindowIndex(spark, scratch.path("index"), window), []
    cuts = sorted(set(reps.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        batch, seen = reps, texts
        if low is not None:
            batch = batch.where(F.col("doc_id") > int(low))
        if high is not None:
            batch, seen = batch.where(F.col("doc_id") <= int(high)), seen.where(F.col("doc_id") <= int(high))
        marks.append(index.add(batch, seen, scratch, f"batch-{k}", compact=high is not None))
    index.close()
    scratch.drop("index")
    scratch.keep("survey", "sequences", *(f"batch-{k}-marks" for k in range(len(marks))))  # the result reads these alone
    decided = reduce(DataFrame.union, marks, copies).groupBy("doc_id").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")] + [F.struct(*docs.columns).alias("row")] * carry
    chosen = docs.select(*own)
    out = chosen.join(decided, "doc_id", "left").select(*chosen.columns, F.coalesce("marks", F.array().cast("array<long>")).alias("marks"))
    kind = f", row {chosen.schema['row'].dataType.simpleString()}" if carry else ""
    return out.mapInArrow(_cut(window), f"doc_id long, n_words long, n_removed long, kept string{kind}")
