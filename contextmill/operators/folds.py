"""Ordered work on tables that neither a window nor an aggregate can spread: folds along a key's rows, and global ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from contextmill.sources.scratch import Scratch


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], object], step: Callable[[object, tuple], tuple | None], out: str, tasks: int | None = None) -> DataFrame:
    """``step(state, row)`` along the rows of each key in order; what it returns, unless None, is a row after the key.

    rows has the keys, then the columns that step gets; out names the result's columns after the keys. Rows are dealt and
    sorted by key and streamed through a task with one state at a time: a long key costs time but no memory. With tasks, so
    many partitions are dealt, whatever their size.
    """
    n = len(keys)
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *T.StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    key, state = row[:n], start()
                got = step(state, row[n:])
                if got is not None:
                    made.append(key + got)
            if made:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of a value from the first row in the order to each, over the whole table.

    Rows are dealt by ranges of the order and written; ranges are summed, and each range goes on from the sum of those
    before it, so no task sees more than its range. Rows equal in the order stay in one range and follow each other by chance.
    """
    scratch = Scratch(rows.sparkSession, "running")
    placed = scratch.save(rows.withColumn("_value", value.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "placed")
    sums = placed.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))  # one row a range
    own = F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_value", "_own", "_before")
