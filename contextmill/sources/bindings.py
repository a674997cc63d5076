"""The driver's tables read as what the operators work on: files, packed entries, runs, history and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, *names: str, rows: int = 100_000) -> int:
    """Partitions for an exchange of these tables' rows: their number grows with the tables, so that a task's share does not."""
    return max(1, -(-sum(table(spark, sf_dir, n).count() for n in names) // rows))  # of Parquet, counts are read from the footers


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text of each document as a file."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


SQL_FILES = "files AS (SELECT doc_id, lang || '/' || source || '/doc_' || doc_id AS path, coalesce(text, '') AS text FROM documents)"


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, position, path, original and compressed tokens, strategy, cache_status, score of each packed entry."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    path: Column = F.concat("p_type", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"), path.alias("path"), (F.col("l_quantity") * 20).cast("long").alias("original"),
        F.floor(F.col("l_quantity") * 20 * (1 - F.col("l_discount"))).alias("compressed"), F.when(F.col("l_returnflag") == "R", "symbol").when(F.col("l_returnflag") == "A", "summary").otherwise("full").alias("strategy"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), "reused").otherwise("").alias("cache_status"), F.round(F.col("l_tax") * 100).cast("long").alias("score"),
    )


SQL_PACKED = """packed AS (SELECT l_orderkey AS run, l_linenumber AS position, l_partkey AS part, p_type || '/' || replace(p_brand, '#', '_') || '/' || replace(p_name, ' ', '_') AS path,
  CAST(l_quantity * 20 AS BIGINT) AS original, CAST(floor(l_quantity * 20 * (1 - l_discount)) AS BIGINT) AS compressed,
  CASE l_returnflag WHEN 'R' THEN 'symbol' WHEN 'A' THEN 'summary' ELSE 'full' END AS strategy,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'reused' ELSE '' END AS cache_status, CAST(round(l_tax * 100) AS BIGINT) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: run, generated_at, repo, command, input, saved (token sums), n_files."""
    sums = packed(spark, sf_dir).groupBy("run").agg(F.sum("compressed").alias("input"), F.sum(F.greatest(F.col("original") - F.col("compressed"), F.lit(0))).alias("saved"), F.count(F.lit(1)).alias("n_files"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("generated_at"), F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("command")).join(sums, "run")


SQL_RUNS = f"""{SQL_PACKED}, runs AS (SELECT o_orderkey AS run, o_orderdate AS generated_at, o_custkey AS repo, o_orderpriority AS command, input, saved, n_files FROM orders
  JOIN (SELECT run, CAST(sum(compressed) AS BIGINT) AS input, CAST(sum(greatest(original - compressed, 0)) AS BIGINT) AS saved, count(*) AS n_files FROM packed GROUP BY run) s ON o_orderkey = run)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: id, generated_at, task, repo, tokens."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("generated_at"), F.col("event_type").alias("task"), F.col("user_id").alias("repo"), F.floor(F.col("value") * 100).alias("tokens"))


SQL_HISTORY = "history AS (SELECT event_id AS id, ts AS generated_at, event_type AS task, user_id AS repo, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn: session, turn, role, text, tokens."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))


SQL_TURNS = "turns AS (SELECT conv_id AS session, turn, role, coalesce(text, '') AS text, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM conversations)"
