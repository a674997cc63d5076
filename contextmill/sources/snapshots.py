"""Scans that go on from the one before: versioned snapshots of a folder's file records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.operators import state
from contextmill.sources import scan as scans

RECORD = "path string, size long, stamp timestamp, kind string, content_hash string, line_count long, preview string, symbols array<string>, imports array<string>"
#: Up to so many changed files are opened by their paths; more are met in one pass over the folder. The records are the same.
BY_PATH = 10_000


class ScanIndex:
    """Generations of file records below a folder, each under the digest of the settings that it was scanned with.

    A refresh lists the folder, carries over the records of files whose size and time are as they were, reads the others
    and writes the next generation. Another digest voids what is there. A generation that its writer did not finish is not
    seen. One writer at a time; a file that goes between listing and reading fails the refresh, which can be run again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def generations(self) -> list[tuple[int, str]]:
        """(number, digest) of the finished generations, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/g=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [f.getPath().getParent().getName()[2:] for f in found or []]
        return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names)

    def read(self, number: int | None = None) -> DataFrame:
        """The records of a generation, by default the newest; none if there is none."""
        known = dict(self.generations())
        number = max(known, default=None) if number is None else number
        if number is None:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(f"{self.root}/g={number}-{known[number]}")

    def refresh(self, folder: str, ignore: tuple[str, ...] = (), max_bytes: int = 1 << 20, most: int | None = 50_000) -> DataFrame:
        """(path, change): added, updated, removed or reused since the generation before. Its records become the newest generation."""
        digest = scans.fingerprint({"folder": folder, "ignore": sorted(ignore), "max_bytes": max_bytes, "most": most})
        known = self.generations()
        fits = bool(known) and known[-1][1] == digest
        old = self.read() if fits else self.spark.createDataFrame([], RECORD)
        listed = scans.listing(self.spark, folder, ignore, max_bytes, most)
        kept, todo = state.carried_records(listed, old)
        read = self.spark.read.format("binaryFile")
        few = [r.file for r in todo.select("file").limit(BY_PATH + 1).collect()]
        if not few:
            fresh = scans.described(listed.where("kind is not null"), self.spark.createDataFrame([], "file string, content binary"))
        else:
            literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", f) for f in few]  # names are no patterns
            texts = read.load(literal) if len(few) <= BY_PATH else read.option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= max_bytes)
            left = todo.unionByName(listed.where("kind is not null"))
            fresh = scans.described(left, texts.select(F.col("path").alias("file"), "content"))
        number = known[-1][0] + 1 if known else 0
        columns = [c.split()[0] for c in RECORD.split(", ")]
        fresh.select(*columns).withColumn("line_count", F.col("line_count").cast("long")).unionByName(kept.select(*columns)).write.mode("overwrite").parquet(f"{self.root}/g={number}-{digest}")
        return state.snapshot_diff(old, self.read())

    def forget(self, keep: int = 1) -> None:
        """Deletes all generations but the newest ones."""
        conf = self.spark._jsc.hadoopConfiguration()
        for number, digest in self.generations()[: -keep or None]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/g={number}-{digest}")
            path.getFileSystem(conf).delete(path, True)
