"""Records of runs beyond single metrics: costs of one run, effective metrics, datasets, merged histories, payloads, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import analytics as A

#: Order of the risk labels; others have 0.
RISKS = ("low", "medium", "high")


def run_costs(entries: DataFrame, per_million: float) -> DataFrame:
    """Each entry of a run with its tokens saved and what they cost before and after (8 decimals)."""
    usd = lambda c: S.rounded(S.usd(c, per_million), 8)
    return entries.select("run", "position", "path", "strategy", "original", "compressed", A.saved().alias("saved"), usd(F.col("original")).alias("baseline_usd"), usd(F.col("compressed")).alias("optimised_usd"), usd(A.saved()).alias("saved_usd"))


def run_cost(runs: DataFrame, per_million: float, decimals: int = 6) -> DataFrame:
    """One row a run (run, input, saved): tokens before and after, the share saved, costs and what is to note."""
    whole = F.col("input") + F.col("saved")
    usd = lambda c: S.usd(c, per_million)
    notes = F.array_compact(F.array(F.when(whole == 0, "no_tokens"), F.when(F.col("saved") == 0, "no_savings")))
    return runs.select(
        "run", whole.alias("baseline"), F.col("input").alias("optimised"), "saved", F.when(whole > 0, S.rounded(F.col("saved") / whole * 100, 2)).otherwise(0.0).alias("savings_pct"),
        S.rounded(usd(whole), decimals).alias("baseline_usd"), S.rounded(usd(F.col("input")), decimals).alias("optimised_usd"), S.rounded(usd(whole) - usd(F.col("input")), decimals).alias("saved_usd"), F.array_join(notes, ",").alias("notes"),
    )


def effective(runs: DataFrame) -> DataFrame:
    """What each run delivers (run, input, saved, n_files, delta: struct or null): the delta package's numbers if it has one."""
    has = F.col("delta").isNotNull()
    zero = F.lit(0).cast("long")
    pick = lambda a, b: F.coalesce(F.when(has, F.col(f"delta.{a}")).otherwise(F.col(b)), zero)
    return runs.select("run", has.alias("delta_enabled"), pick("tokens", "input").alias("input"), pick("saved", "saved").alias("saved"), F.when(has, F.coalesce("delta.original", zero)).alias("original"), pick("included", "n_files").alias("n_files"), F.when(has, F.coalesce("delta.removed", zero)).otherwise(zero).alias("n_removed"))


def reduction(baseline: Column, optimised: Column) -> Column:
    """Tokens saved in percent of the baseline, not below 0, two decimals."""
    return F.when(baseline <= 0, 0.0).otherwise(S.rounded(F.greatest(F.lit(0.0), (baseline - optimised) / baseline * 100), 2))


def dataset(entries: DataFrame) -> DataFrame:
    """One row for tasks (baseline, optimised): totals, means, and the mean of the tasks' reductions."""
    zero = F.lit(0)
    mean = lambda c: S.rounded(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return entries.agg(
        F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("baseline"), zero).alias("total_baseline"), F.coalesce(F.sum("optimised"), zero).alias("total_optimised"),
        mean("baseline").alias("avg_baseline"), mean("optimised").alias("avg_optimised"), mean(reduction(F.col("baseline"), F.col("optimised"))).alias("avg_reduction_pct"),
    )


def merged_history(artifacts: DataFrame, history: DataFrame) -> DataFrame:
    """Runs of artifacts, and of the history those whose time no artifact has (generated_at, input, saved, files each)."""
    columns = ["generated_at", "input", "saved", "files"]
    more = history.join(artifacts.select("generated_at").distinct(), "generated_at", "left_anti")
    return artifacts.select(*columns, F.lit("artifact").alias("source")).unionByName(more.select(*columns, F.lit("history").alias("source")))


def strongest(suggestions: DataFrame, top: int = 25) -> DataFrame:
    """Of each path the suggestion (path, position, suggestion, impact) with the largest impact, the first of equal ones; then the top ones."""
    best = suggestions.groupBy("path").agg(F.max_by(F.struct("suggestion", "impact"), F.struct("impact", -F.col("position"))).alias("b"))
    return best.select("path", "b.suggestion", "b.impact").orderBy(F.desc("impact"), "path").limit(top)


def ignored(considered: DataFrame, selected: DataFrame) -> DataFrame:
    """Files (run, path) that were ranked and not packed."""
    return considered.select("run", "path").distinct().join(selected.select("run", "path").distinct(), ["run", "path"], "left_anti")


def risk_rank(label: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(label) == r, F.lit(k + 1)) for k, r in enumerate(RISKS)], F.lit(0))


def budget_changes(runs: DataFrame) -> DataFrame:
    """Each run against the one before it of its repository (run, repo, generated_at, input, saved, risk): changes of tokens and of risk."""
    w = W.partitionBy("repo").orderBy("generated_at", "run")
    before = runs.select("run", "repo", "input", "saved", "risk", *(F.lag(c).over(w).alias(f"old_{c}") for c in ("run", "input", "saved", "risk"))).where("old_run is not null")
    return before.select("repo", "run", "old_run", (F.col("input") - F.col("old_input")).alias("input_change"), (F.col("saved") - F.col("old_saved")).alias("saved_change"), (risk_rank(F.col("risk")) - risk_rank(F.col("old_risk"))).cast("long").alias("risk_change"))


def dashboard(runs: DataFrame, key: str) -> DataFrame:
    """Runs, tokens, saved, mean reduction and the share of cache look-ups that hit (hits, misses) of each key."""
    looked = F.sum(F.col("hits") + F.col("misses"))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("tokens"), F.sum("saved").alias("saved"), S.rounded(F.avg(S.reduction_pct(F.col("input") + F.col("saved"), F.col("input"))), 2).alias("mean_reduction_pct"), F.when(looked > 0, S.rounded(F.sum("hits") / looked, 4)).otherwise(0.0).alias("cache_hit_rate"))


def policy(runs: DataFrame, limits: dict) -> DataFrame:
    """Violations of each run (run, input, saved, n_files, risk, bytes) of up to five limits, in a fixed order."""
    whole = F.col("input") + F.col("saved")
    pct = F.when(whole > 0, S.rounded(F.col("saved") / whole * 100, 3)).otherwise(0.0)
    broken = {
        "max_estimated_input_tokens": lambda x: F.col("input") > x, "max_files_included": lambda x: F.col("n_files") > x, "max_quality_risk_level": lambda x: risk_rank(F.col("risk")) > RISKS.index(x) + 1,
        "min_estimated_savings_percentage": lambda x: pct < x, "max_context_size_bytes": lambda x: F.col("bytes") > x,
    }
    found = F.array_compact(F.array(*[F.when(rule(limits[name]), name) for name, rule in broken.items() if limits.get(name) is not None])) if limits else F.array().cast("array<string>")
    return runs.select("run", pct.alias("savings_pct"), F.array_join(found, ",").alias("violations"), (F.size(found) == 0).alias("passed"))


def selection_summary(tasks: DataFrame) -> DataFrame:
    """One row for tasks (coverage_pct, tokens): mean and median coverage, tokens for each point of coverage (null without any)."""
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), S.rounded(F.avg("coverage_pct"), 4).alias("mean_coverage"), S.rounded(F.median("coverage_pct"), 4).alias("median_coverage"), S.rounded(F.when(F.sum("coverage_pct") > 0, F.sum("tokens") / F.sum("coverage_pct")), 4).alias("tokens_per_point"))


def repeat_rate(calls: DataFrame) -> DataFrame:
    """The share of each session's calls (session, argv) whose argv the session had before."""
    each = calls.groupBy("session", "argv").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("session").agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("repeats"), S.rounded(F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("repeat_rate"))


def newest_commands(commands: DataFrame, n: int) -> DataFrame:
    """The newest n command runs (id, at, ...), newest first."""
    return commands.orderBy(F.desc("at"), F.desc("id")).limit(n)


def path_history(entries: DataFrame) -> DataFrame:
    """(path, history): of each file the runs that packed it as (run, compressed), in order, one for each run."""
    each = entries.groupBy("path", "run").agg(F.sum("compressed").alias("compressed"))
    return each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("run", "compressed"))).alias("history"))


def cost_records(artifacts: DataFrame, observed: DataFrame, history: DataFrame) -> DataFrame:
    """Normalised cost records (source, at, key, input, saved) of the three shapes in which runs are recorded."""
    zero = F.lit(0).cast("long")
    shape = lambda df, source, at, key, tokens, saved: df.select(F.lit(source).alias("source"), F.col(at).alias("at"), F.col(key).cast("string").alias("key"), F.coalesce(tokens, zero).alias("input"), F.coalesce(saved, zero).alias("saved"))
    return (
        shape(artifacts, "artifact", "generated_at", "repo", F.col("budget.estimated_input_tokens"), F.col("budget.estimated_saved_tokens"))
        .unionByName(shape(observed, "observe", "timestamp", "repo", F.col("total_tokens"), F.col("tokens_saved")))
        .unionByName(shape(history, "history", "generated_at", "repo", F.col("token_usage.estimated_input_tokens"), F.col("token_usage.estimated_saved_tokens")))
    )


def assembled_runs(starts: DataFrame, ends: DataFrame, hours: int) -> DataFrame:
    """(run_id, name, started, ended, tokens): each run once, with its first end that comes up to so many hours after its start.

    starts: run_id, name, started; ends: run_id, ended, tokens. Repeated events count once; a run without an end has nulls.
    """
    first = starts.groupBy("run_id").agg(F.min(F.struct("started", "name")).alias("a"))
    timely = ends.join(first, "run_id").where((F.col("ended") >= F.col("a.started")) & (F.col("ended") <= F.col("a.started") + F.expr(f"INTERVAL {hours} HOURS")))
    last = timely.groupBy("run_id").agg(F.min(F.struct("ended", "tokens")).alias("b"))
    return first.join(last, "run_id", "left").select("run_id", "a.name", "a.started", "b.ended", "b.tokens")


def payloads(events: DataFrame) -> DataFrame:
    """Telemetry events as JSON: name, schema_version, run_id and a payload with what the kind of event has."""
    part = {
        "pack_completed": F.struct("tokens", "files"), "cache_used": F.struct("hits"), "policy_failed": F.struct("violations"),
    }
    body = F.coalesce(*[F.when(F.col("name") == n, F.to_json(c)) for n, c in part.items()], F.lit("{}"))
    return events.select("run_id", "name", F.lit("1").alias("schema_version"), body.alias("payload"))


def keyword_baseline(files: DataFrame, keys: list[str], path_weight: float = 4.0, most: int = 25) -> DataFrame:
    """(path, score) by keywords alone: path hits weigh four, content hits one and at most 25 a keyword; no score, no row."""
    path, text = F.lower("path"), F.lower("text")
    score = sum((path_weight * S.occurrences(path, k) + F.least(F.lit(most), S.occurrences(text, k)) for k in keys), F.lit(0.0))
    return files.select("path", score.alias("score")).where("score > 0")


def random_baseline(files: DataFrame, seed: int) -> DataFrame:
    """(path, turn): an order by a hash of path and seed; the first by turn are a random selection."""
    return files.select("path", F.xxhash64("path", F.lit(seed)).alias("turn"))


def turn_deltas(turns: DataFrame) -> DataFrame:
    """Files of each turn's pack against the turn before (session, turn, path, tokens, strategy): added, changed, removed.

    The first turn of a session has only added files. Nothing but neighbouring turns is compared.
    """
    order = turns.select("session", "turn").distinct().withColumn("after", F.lead("turn").over(W.partitionBy("session").orderBy("turn")))
    now = turns.select("session", "turn", "path", F.col("tokens").alias("new_tokens"), F.col("strategy").alias("new_strategy"))
    old = turns.join(order.where("after is not null"), ["session", "turn"]).select("session", F.col("after").alias("turn"), "path", F.col("tokens").alias("old_tokens"), F.col("strategy").alias("old_strategy"))
    both = now.join(old, ["session", "turn", "path"], "full_outer")
    same = (F.col("old_tokens") == F.col("new_tokens")) & (F.col("old_strategy") == F.col("new_strategy"))
    status = F.when(F.col("old_tokens").isNull(), "added").when(F.col("new_tokens").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select("session", "turn", "path", status.alias("status"), F.when(status.isin("added", "changed"), F.col("new_tokens")).otherwise(F.lit(0)).cast("long").alias("send_tokens")).where("status <> 'same'")
