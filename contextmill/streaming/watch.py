"""A watched folder: each trigger compares a scan with the one before and keeps the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contextmill.operators import state


def watch(spark: SparkSession, scan, snapshots: str, changes: str, seconds: float = 2.0) -> StreamingQuery:
    """Starts a query that scans every so many seconds and appends what changed (path, change, batch) to the table ``changes``.

    scan is a function without arguments that gives (path, size, stamp). A file stream tells of new files only, so a clock
    drives the scans; the snapshot of each scan that found a change is written below ``snapshots``, and the first one
    counts every file as added. A batch without changes writes nothing. A restart goes on from the last snapshot.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(_: DataFrame, batch: int) -> None:
        new = scan().select("path", "size", "stamp")
        found = compare(spark, new, snapshots)
        moved = found.where("change <> 'reused'").withColumn("batch", F.lit(batch).cast("long"))
        moved = moved.persist()
        if not moved.isEmpty():
            moved.write.mode("append").parquet(changes)
            new.write.parquet(f"{snapshots}/s={next_snapshot(spark, snapshots)}")
        moved.unpersist()

    return clock.writeStream.foreachBatch(step).trigger(processingTime=f"{seconds} seconds").start()


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/s=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getName()[2:]) for f in found or [])


def next_snapshot(spark: SparkSession, root: str) -> int:
    return max(_snapshots(spark, root), default=-1) + 1


def compare(spark: SparkSession, new: DataFrame, root: str) -> DataFrame:
    """(path, change) of a scan against the newest snapshot; without one every file is added."""
    known = _snapshots(spark, root)
    old = spark.read.schema(new.schema).parquet(f"{root}/s={known[-1]}") if known else spark.createDataFrame([], new.schema)
    return state.snapshot_diff(old, new)
