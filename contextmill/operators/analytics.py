"""Analytics over run artifacts: entries (run, position, path, original, compressed, strategy, cache_status) and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S


def saved() -> Column:
    return F.greatest(F.col("original") - F.col("compressed"), F.lit(0))


def by_run(entries: DataFrame) -> DataFrame:
    """One row for each path and run: inclusions, token sums, largest."""
    return entries.groupBy("path", "run").agg(F.count(F.lit(1)).alias("inclusions"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.sum(saved()).alias("saved"), F.max("compressed").alias("largest"))


def heatmap(entries: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row a path: inclusions, runs, token sums, largest, averages by inclusion, and the share of all runs.

    runs (run), if given, has the runs of the entries: a narrower table to count them in.
    """
    return _heat(by_run(entries), entries if runs is None else runs)


def _heat(each: DataFrame, runs: DataFrame) -> DataFrame:
    out = each.groupBy("path").agg(
        F.sum("inclusions").alias("inclusions"), F.count(F.lit(1)).alias("runs"), F.sum("original").alias("original_tokens"), F.sum("compressed").alias("compressed_tokens"),
        F.sum("saved").alias("saved_tokens"), F.max("largest").alias("max_compressed"),
    )
    out = out.crossJoin(F.broadcast(runs.agg(F.count_distinct("run").alias("all_runs"))))
    return out.select("path", "inclusions", "runs", "original_tokens", "compressed_tokens", "saved_tokens", "max_compressed", F.round(F.col("compressed_tokens") / F.col("inclusions"), 2).alias("average_compressed"), F.round(F.col("runs") / F.col("all_runs"), 4).alias("inclusion_rate"))


def folder_heatmap(entries: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The same for every folder above the files: an entry counts once for each. Entries of one path and run are summed before."""
    each = by_run(entries).withColumn("path", F.explode(S.folders(F.col("path"))))
    each = each.groupBy("path", "run").agg(*(F.sum(c).alias(c) for c in ("inclusions", "original", "compressed", "saved")), F.max("largest").alias("largest"))
    return _heat(each, entries if runs is None else runs)


def stage_totals(entries: DataFrame) -> DataFrame:
    """Seven stages, always present: entries, tokens before and after, saved."""
    stages = ["cache_reuse", "symbol_extraction", "slicing", "compression", "snippet", "full", "delta"]
    dim = entries.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    sums = entries.withColumn("stage", S.savings_stage(F.col("cache_status"), F.col("strategy"), F.lit(""))).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("original").alias("o"), F.sum("compressed").alias("c"), F.sum(saved()).alias("s"))
    zero = F.lit(0).cast("long")
    return F.broadcast(dim).join(sums, "stage", "left").select("stage", F.coalesce("n", zero).alias("entries"), F.coalesce("o", zero).alias("tokens_before"), F.coalesce("c", zero).alias("tokens_after"), F.coalesce("s", zero).alias("tokens_saved"))


def read_profile(entries: DataFrame) -> DataFrame:
    """One row a run: duplicate, unnecessary (score up to 1, 50 tokens and more) and costly (500 and more) reads, and their waste, which adds up."""
    rows = entries.withColumn("nth", F.row_number().over(W.partitionBy("run", "path").orderBy("position", "original", "compressed")))
    again, idle, costly = F.col("nth") > 1, (F.col("score") <= 1) & (F.col("original") >= 50), F.col("original") >= 500
    count = lambda c: F.sum(c.cast("int")).cast("long")
    tokens = lambda c: F.sum(F.when(c, F.col("original")).otherwise(0)).cast("long")
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("reads"), count(again).alias("duplicates"), count(idle).alias("unnecessary"), count(costly).alias("high_cost"),
        tokens(again).alias("duplicate_waste"), tokens(idle).alias("unnecessary_waste"), (tokens(again) + tokens(idle)).alias("waste"),
    )


def cost_by(runs: DataFrame, key: str) -> DataFrame:
    """Runs, tokens before and after, saved and its share (6 decimals), of each key; runs without tokens are left out."""
    out = runs.where("input + saved > 0").groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("optimised"), F.sum("saved").alias("saved"))
    return out.select(key, "runs", (F.col("optimised") + F.col("saved")).alias("baseline"), "optimised", "saved", F.round(F.col("saved") / (F.col("optimised") + F.col("saved")), 6).alias("savings_share"))


def cost_by_stage(runs: DataFrame) -> DataFrame:
    """Savings by caching (at most what was saved) and by compression (the rest). runs: saved, cache_saved."""
    cache = F.least(F.col("cache_saved"), F.col("saved"))
    sums = runs.agg(F.coalesce(F.sum(cache), F.lit(0)).alias("cache"), F.coalesce(F.sum(F.col("saved") - cache), F.lit(0)).alias("compression"))
    return sums.select(F.expr("stack(2, 'cache', cache, 'compression', compression) AS (stage, tokens_saved)"))


def drift(runs: DataFrame, window: int = 20, threshold: float = 10.0) -> DataFrame:
    """One row a repository: first and last of its newest runs (id, generated_at, repo, tokens, n_files) and the verdict."""
    newest = W.partitionBy("repo").orderBy(F.desc("generated_at"), F.desc("id"))
    last = runs.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= window)
    at = F.struct("generated_at", "id")
    ends = last.groupBy("repo").agg(F.count(F.lit(1)).alias("runs"), F.min_by("tokens", at).alias("first_tokens"), F.max_by("tokens", at).alias("last_tokens"), F.min_by("n_files", at).alias("first_files"), F.max_by("n_files", at).alias("last_files"))
    pct = S.pct_change(F.col("first_tokens"), F.col("last_tokens"))
    return ends.select("repo", "runs", "first_tokens", "last_tokens", pct.alias("token_drift_pct"), S.pct_change(F.col("first_files"), F.col("last_files")).alias("file_drift_pct"), F.when(F.col("runs") < 2, "not_enough_data").otherwise(S.drift_verdict(pct, threshold)).alias("verdict"))


def drift_contributors(runs: DataFrame, files: DataFrame, window: int = 20, top: int = 10) -> DataFrame:
    """Files whose share of runs changed most between the halves of a repository's newest runs. files: id, path."""
    newest = W.partitionBy("repo").orderBy(F.desc("generated_at"), F.desc("id"))
    last = runs.select("repo", "id", "generated_at").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= window)
    sized = last.join(last.groupBy("repo").agg(F.count(F.lit(1)).alias("n")), "repo")
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    placed = sized.withColumn("old", F.col("n") - F.col("k") < half).withColumn("n_old", half).withColumn("n_new", F.col("n") - half)
    share = placed.join(files.distinct(), "id").groupBy("repo", "path").agg(F.round(F.sum(F.when(F.col("old"), 1).otherwise(0)) / F.max("n_old"), 4).alias("before"), F.round(F.coalesce(F.sum(F.when(~F.col("old"), 1).otherwise(0)) / F.nullif(F.max("n_new"), F.lit(0)), F.lit(0.0)), 4).alias("after"))
    moved = share.withColumn("change", F.round(F.col("after") - F.col("before"), 4)).where("abs(change) >= 0.01")
    by = W.partitionBy("repo").orderBy(F.desc(F.abs("change")), "path")
    return moved.withColumn("k", F.row_number().over(by)).where(F.col("k") <= top).select("repo", "path", "before", "after", "change")


def policy(metrics: DataFrame, max_tokens: int, max_files: int, min_savings: float) -> DataFrame:
    """Violations of each run (run, input, saved, n_files) in a sorted list, and whether it passes."""
    pct = F.round(S.reduction_pct(F.col("input") + F.col("saved"), F.col("input")), 3)
    found = F.array_compact(F.array(F.when(F.col("input") > max_tokens, "max_estimated_input_tokens"), F.when(F.col("n_files") > max_files, "max_files_included"), F.when(pct < min_savings, "min_estimated_savings_percentage")))
    return metrics.select("run", pct.alias("savings_pct"), F.array_join(found, ",").alias("violations"), (F.size(found) == 0).alias("passed"))


def insights(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recurring prompts and broad contexts among runs (id, generated_at, repo, task, tokens, scanned) with tokens.

    Recurring: at least three runs of one prompt with 2000 tokens on average. Broad: tokens from max(2000, the lower
    nearest-rank 80th percentile) on, and half of what was scanned, outside recurring prompts. Excess is over the median.
    """
    some = runs.where("tokens > 0").withColumn("prompt", S.normalised_prompt(F.col("task")))
    enough = some.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.floor(F.median("tokens")).alias("middle")).where("n >= 5")
    some = some.join(enough, "repo")
    recurring = some.groupBy("repo", "prompt").agg(F.count(F.lit(1)).alias("runs"), F.floor(F.avg("tokens")).alias("average"), F.max("middle").alias("middle")).where("runs >= 3 and average >= 2000")
    recurring = recurring.select("repo", "prompt", "runs", "average", (F.greatest(F.col("average") - F.col("middle"), F.lit(0)) * F.col("runs")).alias("excess"))
    ranked = some.withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy("tokens", "id")))
    p80 = ranked.where("k = floor(0.8 * (n - 1)) + 1").select("repo", F.greatest(F.col("tokens"), F.lit(2000)).alias("bar"))
    broad = some.join(p80, "repo").where("tokens >= bar and tokens >= 0.5 * scanned").join(recurring, ["repo", "prompt"], "left_anti")
    return recurring, broad.select("repo", "id", "tokens", F.greatest(F.col("tokens") - F.col("middle"), F.lit(0)).alias("excess"))


def advisor(usage: DataFrame, degree: DataFrame, dependencies: DataFrame, runs: int, top: int = 25) -> DataFrame:
    """Suggestions: path, suggestion, impact. usage: path, tokens, frequency; dependencies: path, tokens of what it imports."""
    rows = usage.join(degree, "path", "left").join(dependencies.withColumnRenamed("tokens", "below"), "path", "left").na.fill(0, ["fan_in", "fan_out", "below"])
    wide, large = F.col("fan_in") >= 5, F.col("tokens") >= 500
    kind = F.when(wide & large, "extract_module").when(large, "split_file").when(wide, "extract_module").when(F.col("fan_out") >= 10, "reduce_dependencies")
    impact = F.when(wide, F.col("tokens") * F.col("fan_in")).when(large, F.col("tokens") * F.greatest(F.lit(1), F.round(F.col("frequency") * runs).cast("long"))).otherwise(F.col("below")).cast("long")
    return rows.select("path", kind.alias("suggestion"), impact.alias("impact")).where("suggestion is not null").orderBy(F.desc("impact"), "path").limit(top)


def dashboard(runs: DataFrame, key: str) -> DataFrame:
    """Runs, tokens, saved, and the mean reduction in percent of each key."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("tokens"), F.sum("saved").alias("saved"), F.round(F.avg(S.reduction_pct(F.col("input") + F.col("saved"), F.col("input"))), 2).alias("mean_reduction_pct"))


def selection(picked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a task: share of its ground truth that was picked, tokens, and tokens for each point of coverage."""
    hits = truth.join(picked.select("task", "path", F.lit(1).alias("hit")), ["task", "path"], "left").groupBy("task").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("coverage"))
    used = picked.groupBy("task").agg(F.sum("tokens").alias("tokens"))
    out = hits.join(used, "task", "left").na.fill(0, ["tokens"])
    return out.select("task", F.round(100 * F.col("coverage"), 4).alias("coverage_pct"), "tokens", F.round(F.when(F.col("coverage") > 0, F.col("tokens") / (100 * F.col("coverage"))), 4).alias("tokens_per_point"))


def benchmark(entries: DataFrame) -> DataFrame:
    """Four strategies of each run against reading everything: strategy, tokens, saved, reduction."""
    sums = entries.groupBy("run").agg(F.sum("original").alias("full"), F.sum(F.when(F.col("score") > 0, F.col("original")).otherwise(0)).alias("top"), F.sum("compressed").alias("compressed"), F.sum(F.when(F.col("cache_status") == "reused", 0).otherwise(F.col("compressed"))).alias("cached"))
    rows = sums.select("run", "full", F.expr("stack(4, 'naive_full', full, 'top_ranked', top, 'compressed', compressed, 'cache_assisted', cached) AS (strategy, tokens)"))
    return rows.select("run", "strategy", "tokens", (F.col("full") - F.col("tokens")).alias("saved"), F.round(S.reduction_pct(F.col("full"), F.col("tokens")), 2).alias("reduction_pct"))


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each file's tokens between two states (path, tokens): added, removed, changed or same, and in percent."""
    b, a = before.select("path", F.col("tokens").alias("before")), after.select("path", F.col("tokens").alias("after"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    zero = F.lit(0).cast("long")
    old, new = F.coalesce("before", zero), F.coalesce("after", zero)
    return both.select("path", status.alias("status"), old.alias("before"), new.alias("after"), F.when((old == 0) & (new > 0), 100.0).when(old == 0, 0.0).otherwise(F.round((new - old) / old * 100, 2)).alias("change_pct"))
