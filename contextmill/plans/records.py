"""Queries of run records, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.operators import records as R
from contextmill.plans.analytics import SQL_SELECTION, selection_eval
from contextmill.plans.ranking import KEYS
from contextmill.sources import bindings as B
from contextmill.sources import stores

_PRICE = 2.5
_PCT = "CASE WHEN input + saved <= 0 THEN 0.0 ELSE 100.0::DOUBLE * (1 - input::DOUBLE / (input + saved)) END"
_RISK = "CASE run % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'HIGH' ELSE 'unknown' END"
_RANK = "CASE run % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return B.runs(spark, d).withColumn("risk", F.expr(_RISK))


def effective_metrics(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("run") % 3 == 0, F.struct(F.floor(F.col("input") / 2).alias("tokens"), (F.col("saved") + 1).alias("saved"), F.col("input").alias("original"), F.lit(2).cast("long").alias("included"), F.col("run").alias("removed")))
    return R.effective(B.runs(spark, d).withColumn("delta", delta)).na.fill(-1, ["original"])


def dashboard_merge(spark: SparkSession, d: str) -> DataFrame:
    own = B.runs(spark, d).select("generated_at", "input", "saved", F.col("n_files").alias("files"))
    return R.merged_history(own.where(F.dayofmonth("generated_at") <= 20), own.where(F.dayofmonth("generated_at") >= 10))


def advice_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = B.packed(spark, d).select("path", (F.col("run") * 10 + F.col("position")).alias("position"), F.col("strategy").alias("suggestion"), "original")
    # one row for each place: the table repeats some
    rows = rows.groupBy("path", "position").agg(F.min("suggestion").alias("suggestion"), F.sum("original").alias("impact"))
    return R.strongest(rows)


def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    rows = B.packed(spark, d)
    return R.ignored(rows, rows.where("score >= 3"))


def dashboard_by_repo(spark: SparkSession, d: str) -> DataFrame:
    hits = B.packed(spark, d).groupBy("run").agg(F.count_if(F.col("cache_status") == "reused").alias("hits"), F.count_if(F.col("cache_status") != "reused").alias("misses"))
    return R.dashboard(B.runs(spark, d).join(hits, "run"), "repo")


LIMITS = {"max_estimated_input_tokens": 2000, "max_files_included": 4, "max_quality_risk_level": "medium", "min_estimated_savings_percentage": 5.0, "max_context_size_bytes": 9000}
SQL_POLICY = f"""WITH {B.SQL_RUNS}, p AS (SELECT *, CASE WHEN input + saved > 0 THEN round(saved::DOUBLE / (input + saved) * 100, 3) ELSE 0.0 END AS pct FROM runs),
v AS (SELECT run, pct, list_filter([CASE WHEN input > 2000 THEN 'max_estimated_input_tokens' END, CASE WHEN n_files > 4 THEN 'max_files_included' END, CASE WHEN {_RANK} > 2 THEN 'max_quality_risk_level' END,
CASE WHEN pct < 5.0 THEN 'min_estimated_savings_percentage' END, CASE WHEN input * 4 > 9000 THEN 'max_context_size_bytes' END], lambda x: x IS NOT NULL) AS f FROM p)
SELECT run, pct::DOUBLE AS savings_pct, array_to_string(f, ',') AS violations, len(f) = 0 AS passed FROM v"""


def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.selection_summary(selection_eval(spark, d))


def argv_repeats(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select(F.col("user_id").alias("session"), F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 20).cast("long")).alias("argv"))
    return R.repeat_rate(e)


def recent_commands(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("command"))
    return R.newest_commands(e, 50).select("id", "command")


def cost_records(spark: SparkSession, d: str) -> DataFrame:
    r = B.runs(spark, d)
    artifacts = r.where("run % 3 = 0").select("generated_at", "repo", F.struct(F.col("input").alias("estimated_input_tokens"), F.col("saved").alias("estimated_saved_tokens")).alias("budget"))
    observed = r.where("run % 3 = 1").select(F.col("generated_at").alias("timestamp"), "repo", F.col("input").alias("total_tokens"), F.col("saved").alias("tokens_saved"))
    history = r.where("run % 3 = 2").select("generated_at", "repo", F.struct(F.when(F.col("run") % 2 == 0, F.col("input")).alias("estimated_input_tokens"), F.col("saved").alias("estimated_saved_tokens")).alias("token_usage"))
    out = R.cost_records(artifacts, observed, history)
    return out.groupBy("source", "key").agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("input"), F.sum("saved").alias("saved"))


def telemetry_payloads(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("run") % 4 == 0, "pack_completed").when(F.col("run") % 4 == 1, "cache_used").when(F.col("run") % 4 == 2, "policy_failed").otherwise("run_started")
    return R.payloads(B.runs(spark, d).select(F.col("run").alias("run_id"), name.alias("name"), F.col("input").alias("tokens"), F.col("n_files").alias("files"), F.col("saved").alias("hits"), F.concat(F.lit("v"), F.col("repo")).alias("violations")))


def eval_keyword_baseline(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_baseline(B.files(spark, d).select(F.concat("path", F.lit("_"), F.lit(KEYS[0]), F.col("doc_id") % 2).alias("path"), "text"), KEYS)


_HITS = "CAST((length({0}) - length(replace({0}, '{1}', ''))) / {2} AS BIGINT)"
SQL_BASELINE = f"""WITH {B.SQL_FILES}, f AS (SELECT path || '_{KEYS[0]}' || doc_id % 2 AS path, text FROM files), s AS (SELECT path, ({" + ".join(f"4.0 * {_HITS.format('lower(path)', k, len(k))} + least(25, {_HITS.format('lower(text)', k, len(k))})" for k in KEYS)})::DOUBLE AS score FROM f)
SELECT * FROM s WHERE score > 0"""


def turn_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = B.packed(spark, d).select((F.col("run") % 50).alias("session"), F.floor(F.col("run") / 50).alias("turn"), F.substring_index("path", "/", 2).alias("path"), "compressed", "strategy")
    packs = rows.groupBy("session", "turn", "path").agg(F.sum("compressed").alias("tokens"), F.min("strategy").alias("strategy"))
    return R.turn_deltas(packs)


SQL_TURNS = f"""WITH {B.SQL_PACKED}, p AS (SELECT run % 50 AS session, CAST(floor(run / 50) AS BIGINT) AS turn, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS path, CAST(sum(compressed) AS BIGINT) AS tokens, min(strategy) AS strategy FROM packed GROUP BY ALL),
o AS (SELECT session, turn, lead(turn) OVER (PARTITION BY session ORDER BY turn) AS after FROM (SELECT DISTINCT session, turn FROM p)), b AS (SELECT p.session, after AS turn, path, tokens, strategy FROM p JOIN o USING (session, turn) WHERE after IS NOT NULL),
f AS (SELECT coalesce(n.session, b.session) AS session, coalesce(n.turn, b.turn) AS turn, coalesce(n.path, b.path) AS path, CASE WHEN b.tokens IS NULL THEN 'added' WHEN n.tokens IS NULL THEN 'removed' WHEN n.tokens = b.tokens AND n.strategy = b.strategy THEN 'same' ELSE 'changed' END AS status, n.tokens AS t
FROM p n FULL JOIN b ON n.session = b.session AND n.turn = b.turn AND n.path = b.path) SELECT session, turn, path, status, CASE WHEN status IN ('added', 'changed') THEN t ELSE 0 END AS send_tokens FROM f WHERE status <> 'same'"""


def control_plane_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one organisation: organisation, project, repository and run are linked by keys."""
    t = lambda n: B.table(spark, d, n)
    orgs, projects = t("region").select(F.col("r_regionkey").alias("org"), F.col("r_name").alias("slug")), t("nation").select(F.col("n_nationkey").alias("project"), F.col("n_regionkey").alias("org"))
    repos, runs = t("customer").select(F.col("c_custkey").alias("repo"), F.col("c_nationkey").alias("project")), t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("repo"), F.round("o_totalprice").cast("long").alias("tokens"))
    return stores.control_plane(orgs, projects, repos, runs, slug="EUROPE").select("project", "repo", "run", "tokens")


QUERIES = {
    "cost_run_files": (lambda s, d: R.run_costs(B.packed(s, d), _PRICE), f"WITH {B.SQL_PACKED} SELECT run, position, path, strategy, original, compressed, greatest(original - compressed, 0) AS saved, round(original / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS baseline_usd, round(compressed / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS optimised_usd, round(greatest(original - compressed, 0) / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS saved_usd FROM packed"),
    "cost_single_run": (lambda s, d: R.run_cost(B.runs(s, d), _PRICE, 8), f"""WITH {B.SQL_RUNS} SELECT run, input + saved AS baseline, input AS optimised, saved, (CASE WHEN input + saved > 0 THEN round(saved::DOUBLE / (input + saved) * 100, 2) ELSE 0.0 END)::DOUBLE AS savings_pct, round((input + saved) / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS baseline_usd,
round(input / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS optimised_usd, round((input + saved) / 1000000.0::DOUBLE * 2.5::DOUBLE - input / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS saved_usd, array_to_string(list_filter([CASE WHEN input + saved = 0 THEN 'no_tokens' END, CASE WHEN saved = 0 THEN 'no_savings' END], lambda x: x IS NOT NULL), ',') AS notes FROM runs"""),
    "effective_metrics": (effective_metrics, f"WITH {B.SQL_RUNS} SELECT run, run % 3 = 0 AS delta_enabled, CASE WHEN run % 3 = 0 THEN CAST(floor(input / 2) AS BIGINT) ELSE input END AS input, CASE WHEN run % 3 = 0 THEN saved + 1 ELSE saved END AS saved, CASE WHEN run % 3 = 0 THEN input ELSE -1 END AS original, CASE WHEN run % 3 = 0 THEN 2 ELSE n_files END AS n_files, CASE WHEN run % 3 = 0 THEN run ELSE 0 END AS n_removed FROM runs"),
    "dataset_aggregate": (lambda s, d: R.dataset(B.runs(s, d).select((F.col("input") + F.col("saved")).alias("baseline"), F.col("input").alias("optimised"))), f"""WITH {B.SQL_RUNS} SELECT count(*) AS tasks, sum(input + saved)::BIGINT AS total_baseline, sum(input)::BIGINT AS total_optimised, round(avg(input + saved), 2) AS avg_baseline, round(avg(input), 2) AS avg_optimised,
round(avg(CASE WHEN input + saved <= 0 THEN 0.0 ELSE round(greatest(0.0, saved::DOUBLE / (input + saved) * 100), 2) END), 2) AS avg_reduction_pct FROM runs"""),
    "dashboard_merge": (dashboard_merge, f"""WITH {B.SQL_RUNS}, a AS (SELECT generated_at, input, saved, n_files AS files FROM runs WHERE day(generated_at) <= 20), h AS (SELECT generated_at, input, saved, n_files AS files FROM runs WHERE day(generated_at) >= 10)
SELECT *, 'artifact' AS source FROM a UNION ALL SELECT *, 'history' FROM h WHERE generated_at NOT IN (SELECT generated_at FROM a)"""),
    "advice_dedup": (advice_dedup, f"""WITH {B.SQL_PACKED}, r AS (SELECT path, run * 10 + position AS position, min(strategy) AS suggestion, CAST(sum(original) AS BIGINT) AS impact FROM packed GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY impact DESC, position) AS k FROM r) SELECT path, suggestion, impact FROM k WHERE k = 1 ORDER BY impact DESC, path LIMIT 25"""),
    "ignored_files": (ignored_files, f"WITH {B.SQL_PACKED} SELECT DISTINCT run, path FROM packed EXCEPT SELECT run, path FROM packed WHERE score >= 3"),
    "budget_changes": (lambda s, d: R.budget_changes(_runs(s, d)), f"""WITH {B.SQL_RUNS}, b AS (SELECT repo, run, input, saved, {_RANK} AS k, lag(run) OVER w AS old_run, lag(input) OVER w AS oi, lag(saved) OVER w AS os, lag({_RANK}) OVER w AS ok FROM runs WINDOW w AS (PARTITION BY repo ORDER BY generated_at, run))
SELECT repo, run, old_run, input - oi AS input_change, saved - os AS saved_change, CAST(k - ok AS BIGINT) AS risk_change FROM b WHERE old_run IS NOT NULL"""),
    "dashboard_by_repo": (dashboard_by_repo, f"""WITH {B.SQL_RUNS}, h AS (SELECT run, count(*) FILTER (WHERE cache_status = 'reused') AS hits, count(*) FILTER (WHERE cache_status <> 'reused') AS misses FROM packed GROUP BY run)
SELECT repo, count(*) AS runs, sum(input)::BIGINT AS tokens, sum(saved)::BIGINT AS saved, round(avg({_PCT}), 2) AS mean_reduction_pct, round(sum(hits)::DOUBLE / sum(hits + misses), 4) AS cache_hit_rate FROM runs JOIN h USING (run) GROUP BY repo"""),
    "policy_all_checks": (lambda s, d: R.policy(_runs(s, d).withColumn("bytes", F.col("input") * 4), LIMITS), SQL_POLICY),
    "selection_summary": (selection_summary, f"WITH s AS ({SQL_SELECTION}) SELECT count(*) AS tasks, round(avg(coverage_pct), 4) AS mean_coverage, round(median(coverage_pct), 4) AS median_coverage, round(CASE WHEN sum(coverage_pct) > 0 THEN sum(tokens) / sum(coverage_pct) END, 4) AS tokens_per_point FROM s"),
    "argv_repeats": (argv_repeats, "WITH e AS (SELECT user_id AS session, event_type || ' ' || CAST(floor(value / 20) AS BIGINT) AS argv, count(*) AS n FROM events GROUP BY 1, 2) SELECT session, sum(n)::BIGINT AS calls, sum(n - 1)::BIGINT AS repeats, round(sum(n - 1)::DOUBLE / sum(n), 4) AS repeat_rate FROM e GROUP BY session"),
    "recent_commands": (recent_commands, "SELECT event_id AS id, event_type AS command FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "path_history": (lambda s, d: R.path_history(B.packed(s, d)).select("path", F.size("history").cast("long").alias("runs"), F.to_json("history").alias("history")), f"""WITH {B.SQL_PACKED}, e AS (SELECT path, run, CAST(sum(compressed) AS BIGINT) AS compressed FROM packed GROUP BY 1, 2)
SELECT path, count(*) AS runs, '[' || string_agg('{{"run":' || run || ',"compressed":' || compressed || '}}', ',' ORDER BY run) || ']' AS history FROM e GROUP BY path"""),
    "cost_records": (cost_records, f"WITH {B.SQL_RUNS} SELECT CASE run % 3 WHEN 0 THEN 'artifact' WHEN 1 THEN 'observe' ELSE 'history' END AS source, CAST(repo AS VARCHAR) AS key, count(*) AS runs, sum(CASE WHEN run % 3 = 2 AND run % 2 = 1 THEN 0 ELSE input END)::BIGINT AS input, sum(saved)::BIGINT AS saved FROM runs GROUP BY 1, 2"),
    "telemetry_payloads": (telemetry_payloads, f"""WITH {B.SQL_RUNS} SELECT run AS run_id, CASE run % 4 WHEN 0 THEN 'pack_completed' WHEN 1 THEN 'cache_used' WHEN 2 THEN 'policy_failed' ELSE 'run_started' END AS name, '1' AS schema_version,
CASE run % 4 WHEN 0 THEN '{{"tokens":' || input || ',"files":' || n_files || '}}' WHEN 1 THEN '{{"hits":' || saved || '}}' WHEN 2 THEN '{{"violations":"v' || repo || '"}}' ELSE '{{}}' END AS payload FROM runs"""),
    "eval_keyword_baseline": (eval_keyword_baseline, SQL_BASELINE),
    "turn_deltas": (turn_deltas, SQL_TURNS),
    "control_plane_runs": (control_plane_runs, "SELECT n_nationkey AS project, o_custkey AS repo, o_orderkey AS run, CAST(round(o_totalprice) AS BIGINT) AS tokens FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'"),
}
