"""Stores: run history, caches and the control plane as Parquet tables that are appended to or rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.operators import state

HISTORY = "id long, generated_at timestamp, task string, repo string, selected array<string>, ignored array<string>, tokens long, artifacts map<string,string>"


class History:
    """Run history below a folder. Appends add files; trimming, pruning and merging write a new version beside the old."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getName()[2:]) for f in found or [])

    def read(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(HISTORY).parquet(f"{self.root}/v={versions[-1]}") if versions else self.spark.createDataFrame([], HISTORY)

    def append(self, rows: DataFrame, keep: int | None = None) -> None:
        versions = self._versions()
        rows.select(*[c.split()[0] for c in HISTORY.split(", ")]).write.mode("append").parquet(f"{self.root}/v={versions[-1] if versions else 0}")
        if keep is not None and self.read().count() > keep:
            self._replace(self.read().orderBy(F.desc("generated_at"), F.desc("id")).limit(keep))

    def prune(self, now, days: int) -> None:
        self._replace(state.prune(self.read(), now, days))

    def merge_artifacts(self, updates: DataFrame) -> None:
        """Adds artifacts (generated_at, more: map) to the newest row of that time; later values win."""
        rows = self.read()
        newest = rows.groupBy("generated_at").agg(F.max("id").alias("id")).join(updates, "generated_at").select("id", "more")
        kept = F.map_filter(F.coalesce("artifacts", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("more"), k))
        out = rows.join(newest, "id", "left").withColumn("artifacts", F.when(F.col("more").isNotNull(), F.map_concat(kept, "more")).otherwise(F.col("artifacts")))
        self._replace(out.select(*rows.columns))

    def _replace(self, rows: DataFrame) -> None:
        versions = self._versions()
        rows.write.parquet(f"{self.root}/v={versions[-1] + 1 if versions else 0}")


def control_plane(orgs: DataFrame, projects: DataFrame, repos: DataFrame, runs: DataFrame, slug: str | None = None, project: int | None = None, repo: int | None = None) -> DataFrame:
    """Runs with their repository, project and organisation, of those asked for. Links are keys; runs without one are left out."""
    own = orgs.where(F.col("slug") == slug) if slug is not None else orgs
    some = projects.where(F.col("project") == project) if project is not None else projects
    held = repos.where(F.col("repo") == repo) if repo is not None else repos
    return runs.join(held, "repo").join(some, "project").join(own, "org")


class Table:
    """Rows of one kind (records, feeds, observations) below a folder: append, read, and keep the newest."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def append(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("append").json(self.root)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.root)

    def newest(self, n: int, at: str = "at") -> DataFrame:
        return self.read().orderBy(F.desc(at)).limit(n)

    def export(self, to: str, n: int, at: str = "at") -> None:
        """The newest n rows as one JSON lines file: what a feed shows."""
        self.newest(n, at).coalesce(1).write.mode("overwrite").json(to)


def settings(text: str, section: str, defaults: dict) -> dict:
    """A section of a TOML file over the defaults; keys that the defaults lack are an error."""
    import tomllib

    found = tomllib.loads(text).get(section, {})
    if unknown := set(found) - set(defaults):
        raise ValueError(f"unknown keys in [{section}]: {', '.join(sorted(unknown))}")
    return {**defaults, **found}


def cached(requests: DataFrame, cache: DataFrame, namespace: str, now=None, ttl_seconds: int | None = None) -> DataFrame:
    """Requests (key, ...) with the value of the cache (namespace, key, value, at), newest first, and whether they hit.

    With a lifetime, values older than it are misses.
    """
    own = cache.where(F.col("namespace") == namespace)
    if ttl_seconds is not None:
        own = own.where(F.col("at") >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    own = own.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return requests.join(own, "key", "left").withColumn("hit", F.col("value").isNotNull())


def merged_cache(*caches: DataFrame) -> DataFrame:
    """Caches of several writers (namespace, key, value, at) as one: the newest value of each key, the largest of equal times."""
    rows = caches[0]
    for more in caches[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("namespace", "key").agg(F.max(F.struct("at", "value")).alias("x")).select("namespace", "key", "x.value", "x.at")


def aggregate_savings(commands: DataFrame) -> DataFrame:
    """One row: runs, raw and compressed tokens of recorded command runs."""
    zero = F.lit(0)
    return commands.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("raw_tokens"), zero).alias("raw_tokens"), F.coalesce(F.sum("compressed_tokens"), zero).alias("compressed_tokens"))


def alerts(runs: DataFrame, max_tokens: int, drift_pct: float | None = None) -> DataFrame:
    """Rows that a notifier would send: runs over their budget, runs that broke a policy, and (drift_pct given) runs whose drift reaches it."""
    out = runs.where(F.col("input") > max_tokens).select("run", F.lit("budget_overrun").alias("event")).union(runs.where("not passed").select("run", F.lit("policy_violation")))
    return out if drift_pct is None else out.union(runs.where(F.abs("drift_pct") >= drift_pct).select("run", F.lit("drift")))
