"""Queries of run analytics, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextmill.functions import scalar as S
from contextmill.operators import analytics as A
from contextmill.operators import ranking
from contextmill.plans.ranking import _SCORE, KEYS
from contextmill.sources import bindings as B
from contextmill.sources.scratch import Scratch

_HEAT = """SELECT path, count(*) AS inclusions, count(DISTINCT run) AS runs, CAST(sum(original) AS BIGINT) AS original_tokens, CAST(sum(compressed) AS BIGINT) AS compressed_tokens,
CAST(sum(greatest(original - compressed, 0)) AS BIGINT) AS saved_tokens, max(compressed) AS max_compressed, round(sum(compressed)::DOUBLE / count(*), 2) AS average_compressed,
round(count(DISTINCT run)::DOUBLE / (SELECT count(DISTINCT run) FROM packed), 4) AS inclusion_rate FROM {} GROUP BY path"""
_COST = """SELECT {0}, count(*) AS runs, CAST(sum(input) + sum(saved) AS BIGINT) AS baseline, CAST(sum(input) AS BIGINT) AS optimised, CAST(sum(saved) AS BIGINT) AS saved,
round(CAST(sum(saved)::DOUBLE / (sum(input) + sum(saved)) AS DECIMAL(38, 15)), 6)::DOUBLE AS savings_share FROM runs WHERE input + saved > 0 GROUP BY {0}"""
_PCT = "CASE WHEN {0} = 0 THEN CASE WHEN {1} > 0 THEN 100.0 WHEN {1} < 0 THEN -100.0 ELSE 0.0 END ELSE round(CAST(({1} - {0}) / {0}::DOUBLE * 100 AS DECIMAL(38, 10)), 2)::DOUBLE END"


def _run_ids(spark: SparkSession, d: str) -> DataFrame:
    """The runs that have entries: every line has its part."""
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    per = B.packed(spark, d).groupBy("run").agg(F.sum(F.when(F.col("cache_status") == "reused", F.col("original")).otherwise(0)).alias("cache_saved"))
    return B.runs(spark, d).join(per, "run")


def cost_by_run(spark: SparkSession, d: str) -> DataFrame:
    out = B.runs(spark, d).where("input + saved > 0")
    return out.select("run", (F.col("input") + F.col("saved")).alias("baseline"), "input", "saved", F.round(F.col("saved") / (F.col("input") + F.col("saved")), 6).alias("savings_share"), F.round(S.usd(F.col("input"), 2.5), 8).alias("usd"))


def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.runs(spark, d).agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("optimised"), F.sum("saved").alias("saved"), F.round(F.sum("saved") / F.sum(F.col("input") + F.col("saved")), 6).alias("savings_share"), F.round(S.usd(F.sum("saved"), 2.5), 8).alias("usd_saved"))


def roi_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return _cached(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("runs"), F.round(100 * F.avg((F.col("cache_saved") > 0).cast("int")), 1).alias("cache_run_rate"), F.round(S.usd(F.sum("saved"), 2.5), 8).alias("usd_saved"), F.round(100 * F.sum("saved") / F.sum(F.col("input") + F.col("saved")), 1).alias("savings_pct"))


def _drift_runs(spark: SparkSession, d: str) -> DataFrame:
    return B.runs(spark, d).select(F.col("run").alias("id"), "generated_at", "repo", F.col("input").alias("tokens"), "n_files")


def drift_contributors(spark: SparkSession, d: str) -> DataFrame:
    files = B.packed(spark, d).select(F.col("run").alias("id"), "path")
    return A.drift_contributors(_drift_runs(spark, d), files)


_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY generated_at DESC, run DESC) AS k FROM runs) WHERE k <= 20)"
SQL_DRIFT = f"""WITH {B.SQL_RUNS}, {_NEWEST}, e AS (SELECT repo, count(*) AS runs, max_by(input, k) AS a, min_by(input, k) AS b, max_by(n_files, k) AS fa, min_by(n_files, k) AS fb FROM newest GROUP BY repo),
v AS (SELECT *, {_PCT.format('a', 'b')} AS pct, {_PCT.format('fa', 'fb')} AS fpct FROM e)
SELECT repo, runs, a AS first_tokens, b AS last_tokens, pct::DOUBLE AS token_drift_pct, fpct::DOUBLE AS file_drift_pct, CASE WHEN runs < 2 THEN 'not_enough_data' WHEN abs(pct) < 10 THEN 'none' WHEN abs(pct) < 25 THEN 'low'
WHEN abs(pct) < 50 THEN 'moderate' WHEN abs(pct) < 100 THEN 'significant' ELSE 'critical' END AS verdict FROM v"""
SQL_CONTRIBUTORS = f"""WITH {B.SQL_RUNS}, {_NEWEST}, c AS (SELECT repo, count(*) AS n FROM newest GROUP BY repo), p AS (SELECT newest.repo, run, n, greatest(1, n // 2) AS half, n - k < greatest(1, n // 2) AS old FROM newest JOIN c USING (repo)),
f AS (SELECT DISTINCT run, path FROM packed),
s AS (SELECT repo, path, round(count(*) FILTER (WHERE old)::DOUBLE / max(half), 4) AS before, coalesce(round(count(*) FILTER (WHERE NOT old)::DOUBLE / nullif(max(n - half), 0), 4), 0.0) AS after FROM p JOIN f USING (run) GROUP BY repo, path),
m AS (SELECT *, round(after - before, 4) AS change FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY abs(change) DESC, path) AS k FROM m WHERE abs(change) >= 0.01)
SELECT repo, path, before, after, change FROM k WHERE k <= 10"""


def run_diff(spark: SparkSession, d: str) -> DataFrame:
    from contextmill.operators import state

    left, right = _months(spark, d)
    return state.score_changes(left.select("path", "score"), right.select("path", "score"))


def _months(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries of two months, one row a path: of the newest run."""
    rows = B.packed(spark, d).join(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.date_format("o_orderdate", "yyyy-MM").alias("month")), "run")
    by = lambda m: rows.where(F.col("month") == m).groupBy("path").agg(*[F.max_by(c, F.struct("run", "position", "original", "compressed")).alias(c) for c in ("score", "compressed", "strategy")]).withColumnRenamed("compressed", "tokens")
    return by("1996-03"), by("1996-04")


SQL_MONTHS = f"""{B.SQL_PACKED}, m AS (SELECT p.*, strftime(o_orderdate, '%Y-%m') AS month FROM packed p JOIN orders ON o_orderkey = run),
s AS (SELECT month, path, max_by({{'score': score, 'tokens': compressed, 'strategy': strategy}}, (run, position, original, compressed)) AS x FROM m GROUP BY month, path),
l AS (SELECT path, x.score AS score, x.tokens AS tokens, x.strategy AS strategy FROM s WHERE month = '1996-03'), r AS (SELECT path, x.score AS score, x.tokens AS tokens, x.strategy AS strategy FROM s WHERE month = '1996-04')"""


def delta_package(spark: SparkSession, d: str) -> DataFrame:
    from contextmill.operators import state

    return state.delta_package(*_months(spark, d))


def pr_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.audit(*_months(spark, d))


def _insight_runs(spark: SparkSession, d: str) -> DataFrame:
    return B.history(spark, d).withColumn("scanned", F.lit(10_000).cast("long"))


def insights_recurring(spark: SparkSession, d: str) -> DataFrame:
    return A.insights(_insight_runs(spark, d))[0]


def insights_broad(spark: SparkSession, d: str) -> DataFrame:
    """Every third run has a prompt of its own; prompts of the others recur and take their runs out."""
    own = F.when(F.col("id") % 3 == 0, F.concat("task", F.col("id").cast("string"))).otherwise(F.col("task"))
    return A.insights(_insight_runs(spark, d).withColumn("task", own))[1]


_INSIGHT = f"""WITH {B.SQL_HISTORY}, e AS (SELECT *, lower(trim(task)) AS prompt FROM history WHERE tokens > 0), n AS (SELECT repo, count(*) AS n, CAST(floor(median(tokens)) AS BIGINT) AS middle FROM e GROUP BY repo HAVING count(*) >= 5),
s AS (SELECT e.*, n.n, n.middle FROM e JOIN n USING (repo))"""
SQL_BROAD = f"""{_INSIGHT}, k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tokens, id) AS k FROM s), b AS (SELECT repo, greatest(tokens, 2000) AS bar FROM k WHERE k = floor(0.8 * (n - 1)) + 1),
c AS (SELECT repo, prompt FROM (SELECT repo, CASE WHEN id % 3 = 0 THEN prompt || id ELSE prompt END AS prompt, tokens FROM s) GROUP BY repo, prompt HAVING count(*) >= 3 AND floor(avg(tokens)) >= 2000)
SELECT repo, id, tokens, greatest(tokens - middle, 0) AS excess FROM s JOIN b USING (repo) WHERE tokens >= bar AND tokens >= 5000 AND (repo, CASE WHEN id % 3 = 0 THEN prompt || id ELSE prompt END) NOT IN (SELECT (repo, prompt) FROM c)"""


def advisor(spark: SparkSession, d: str) -> DataFrame:
    line = B.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_orderkey")
    part = B.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.round("p_retailprice").cast("long").alias("tokens"))
    edges = Scratch(spark, "advisor").save(line.select("src", "dst").distinct(), "edges")  # read by three parts of the plan
    nodes = part.union(edges.select(F.col("src").alias("path")).distinct().withColumn("tokens", F.lit(100).cast("long")))
    n = B.table(spark, d, "orders").count()
    seen = line.select(F.explode(F.array("src", "dst")).alias("path"), "l_orderkey").groupBy("path").agg((F.count_distinct("l_orderkey") / F.lit(n)).alias("frequency"))
    below = edges.join(part, edges.dst == part.path).groupBy("src").agg(F.sum("tokens").alias("tokens")).withColumnRenamed("src", "path")
    return A.advisor(nodes.join(seen, "path", "left").na.fill(0.0, ["frequency"]), ranking.degrees(edges), below, n)


SQL_ADVISOR = """WITH l AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_orderkey FROM lineitem), e AS (SELECT DISTINCT src, dst FROM l),
n AS (SELECT 'p' || p_partkey AS path, CAST(round(p_retailprice) AS BIGINT) AS tokens FROM part UNION ALL SELECT DISTINCT src, 100 FROM l),
f AS (SELECT path, count(DISTINCT l_orderkey) AS c FROM (SELECT src AS path, l_orderkey FROM l UNION ALL SELECT dst, l_orderkey FROM l) GROUP BY path),
i AS (SELECT dst AS path, count(*) AS i FROM e GROUP BY 1), o AS (SELECT src AS path, count(*) AS o, sum(n.tokens) AS below FROM e JOIN n ON n.path = e.dst GROUP BY 1),
x AS (SELECT n.path, tokens, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(below, 0) AS below, coalesce(c, 0) AS c FROM n LEFT JOIN f USING (path) LEFT JOIN i ON i.path = n.path LEFT JOIN o ON o.path = n.path),
y AS (SELECT path, CASE WHEN i >= 5 AND tokens >= 500 THEN 'extract_module' WHEN tokens >= 500 THEN 'split_file' WHEN i >= 5 THEN 'extract_module' WHEN o >= 10 THEN 'reduce_dependencies' END AS suggestion,
CAST(CASE WHEN i >= 5 THEN tokens * i WHEN tokens >= 500 THEN tokens * greatest(1, c) ELSE below END AS BIGINT) AS impact FROM x)
SELECT * FROM y WHERE suggestion IS NOT NULL ORDER BY impact DESC, path LIMIT 25"""


def selection_eval(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("path"), S.tokens(F.col("text")).alias("tokens"), "text")
    truth = docs.join(B.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("path")).distinct(), "path", "left_semi").select("task", "path")
    picked = docs.where(ranking.content_score(F.coalesce("text", F.lit("")), KEYS) >= 0.5).drop("text")
    return A.selection(picked, truth)


SQL_SELECTION = f"""WITH x AS (SELECT source AS task, doc_id, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens, ({_SCORE}) >= 0.5 AS hit FROM (SELECT source, doc_id, coalesce(text, '') AS text FROM documents)), t AS (SELECT task, doc_id, hit FROM x WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
h AS (SELECT task, avg(hit::INT) AS c FROM t GROUP BY task), u AS (SELECT task, CAST(sum(tokens) AS BIGINT) AS tokens FROM x WHERE hit GROUP BY task)
SELECT task, round(100 * c, 4) AS coverage_pct, coalesce(tokens, 0) AS tokens, round(CASE WHEN c > 0 THEN coalesce(tokens, 0) / (100 * c) END, 4) AS tokens_per_point FROM h LEFT JOIN u USING (task)"""


def benchmark_strategies(spark: SparkSession, d: str) -> DataFrame:
    return A.benchmark(B.packed(spark, d))


SQL_BENCHMARK = f"""WITH {B.SQL_PACKED}, s AS (SELECT run, sum(original) AS f, sum(CASE WHEN score > 0 THEN original ELSE 0 END) AS t, sum(compressed) AS c, sum(CASE WHEN cache_status = 'reused' THEN 0 ELSE compressed END) AS h FROM packed GROUP BY run),
u AS (SELECT run, f, unnest(['naive_full', 'top_ranked', 'compressed', 'cache_assisted']) AS strategy, unnest([f, t, c, h]) AS tokens FROM s)
SELECT run, strategy, CAST(tokens AS BIGINT) AS tokens, CAST(f - tokens AS BIGINT) AS saved, round(CASE WHEN f <= 0 THEN 0.0 ELSE 100.0::DOUBLE * (1 - tokens::DOUBLE / f::DOUBLE) END, 2) AS reduction_pct FROM u"""


def savings_trend(spark: SparkSession, d: str) -> DataFrame:
    """The newest 30 days with runs."""
    return B.runs(spark, d).groupBy(F.date_format("generated_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("saved").alias("saved")).orderBy(F.desc("day")).limit(30)


def pack_risk(spark: SparkSession, d: str) -> DataFrame:
    sums = B.packed(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("original").alias("raw"), F.sum("compressed").alias("packed"), F.sum((F.col("score") == 0).cast("int")).alias("skipped"), F.sum((F.col("strategy") == "summary").cast("int")).alias("degraded"))
    return sums.select("run", S.pack_risk(F.col("skipped"), F.col("n"), F.col("packed"), F.col("raw"), F.col("degraded"), F.col("n"), F.lit(4000)).alias("risk"))


SQL_RISK = f"""WITH {B.SQL_PACKED}, s AS (SELECT run, count(*) AS n, sum(original) AS raw, sum(compressed) AS c, count(*) FILTER (WHERE score = 0) AS k, count(*) FILTER (WHERE strategy = 'summary') AS g FROM packed GROUP BY run),
x AS (SELECT run, c, (0.55::DOUBLE * (k::DOUBLE / n) + 0.45::DOUBLE * greatest(greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, c::DOUBLE / greatest(raw, 1)) - 0.5) / 0.5, CASE WHEN g > 0 THEN least(1.0::DOUBLE, g::DOUBLE / n) ELSE 0.0 END)) / (0.55::DOUBLE + 0.45::DOUBLE) AS r FROM s)
SELECT run, CASE WHEN c > 4000 THEN 'high' WHEN r < 0.25 THEN 'low' WHEN r < 0.5 THEN 'medium' ELSE 'high' END AS risk FROM x"""


QUERIES = {
    "heatmap_files": (lambda s, d: A.heatmap(B.packed(s, d), _run_ids(s, d)), f"WITH {B.SQL_PACKED} " + _HEAT.format("packed")),
    "heatmap_dirs": (lambda s, d: A.folder_heatmap(B.packed(s, d), _run_ids(s, d)), f"WITH {B.SQL_PACKED}, u AS (SELECT split_part(path, '/', 1) AS path, run, original, compressed FROM packed UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), run, original, compressed FROM packed) " + _HEAT.format("u")),
    "savings_by_stage": (lambda s, d: A.stage_totals(B.packed(s, d)), f"""WITH {B.SQL_PACKED}, c AS (SELECT *, CASE WHEN cache_status = 'reused' THEN 'cache_reuse' WHEN strategy = 'symbol' THEN 'symbol_extraction' WHEN strategy = 'summary' THEN 'compression' ELSE 'full' END AS stage FROM packed)
SELECT d.stage, count(c.run) AS entries, coalesce(sum(original), 0)::BIGINT AS tokens_before, coalesce(sum(compressed), 0)::BIGINT AS tokens_after, coalesce(sum(greatest(original - compressed, 0)), 0)::BIGINT AS tokens_saved
FROM (VALUES ('cache_reuse'), ('symbol_extraction'), ('slicing'), ('compression'), ('snippet'), ('full'), ('delta')) d(stage) LEFT JOIN c ON c.stage = d.stage GROUP BY d.stage"""),
    "read_profile": (lambda s, d: A.read_profile(B.packed(s, d)), f"""WITH {B.SQL_PACKED}, r AS (SELECT *, row_number() OVER (PARTITION BY run, path ORDER BY position, original, compressed) AS k FROM packed)
SELECT run, count(*) AS reads, count(*) FILTER (WHERE k > 1) AS duplicates, count(*) FILTER (WHERE score <= 1 AND original >= 50) AS unnecessary, count(*) FILTER (WHERE original >= 500) AS high_cost,
coalesce(sum(original) FILTER (WHERE k > 1), 0)::BIGINT AS duplicate_waste, coalesce(sum(original) FILTER (WHERE score <= 1 AND original >= 50), 0)::BIGINT AS unnecessary_waste,
(coalesce(sum(original) FILTER (WHERE k > 1), 0) + coalesce(sum(original) FILTER (WHERE score <= 1 AND original >= 50), 0))::BIGINT AS waste FROM r GROUP BY run"""),
    "cost_by_repo": (lambda s, d: A.cost_by(B.runs(s, d), "repo"), f"WITH {B.SQL_RUNS} " + _COST.format("repo")),
    "cost_by_run": (cost_by_run, f"WITH {B.SQL_RUNS} SELECT run, input + saved AS baseline, input, saved, round(CAST(saved::DOUBLE / (input + saved) AS DECIMAL(38, 15)), 6)::DOUBLE AS savings_share, round(input / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS usd FROM runs WHERE input + saved > 0"),
    "cost_by_stage": (lambda s, d: A.cost_by_stage(_cached(s, d)), f"""WITH {B.SQL_RUNS}, k AS (SELECT run, sum(CASE WHEN cache_status = 'reused' THEN original ELSE 0 END) AS c FROM packed GROUP BY run), j AS (SELECT least(c, saved) AS cache, saved FROM runs JOIN k USING (run))
SELECT 'cache' AS stage, sum(cache)::BIGINT AS tokens_saved FROM j UNION ALL SELECT 'compression', sum(saved - cache)::BIGINT FROM j"""),
    "cost_summary": (cost_summary, f"WITH {B.SQL_RUNS} SELECT count(*) AS runs, sum(input)::BIGINT AS optimised, sum(saved)::BIGINT AS saved, round(CAST(sum(saved)::DOUBLE / sum(input + saved) AS DECIMAL(38, 15)), 6)::DOUBLE AS savings_share, round(sum(saved)::DOUBLE / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS usd_saved FROM runs"),
    "roi_by_repo": (roi_by_repo, f"""WITH {B.SQL_RUNS}, k AS (SELECT run, sum(CASE WHEN cache_status = 'reused' THEN original ELSE 0 END) AS c FROM packed GROUP BY run)
SELECT repo, count(*) AS runs, round(100 * avg((c > 0)::INT), 1) AS cache_run_rate, round(sum(saved)::DOUBLE / 1000000.0::DOUBLE * 2.5::DOUBLE, 8) AS usd_saved, round(100 * sum(saved)::DOUBLE / sum(input + saved), 1) AS savings_pct FROM runs JOIN k USING (run) GROUP BY repo"""),
    "drift_metrics": (lambda s, d: A.drift(_drift_runs(s, d)), SQL_DRIFT),
    "drift_contributors": (drift_contributors, SQL_CONTRIBUTORS),
    "policy_checks": (lambda s, d: A.policy(B.runs(s, d), 2000, 4, 5.0), f"""WITH {B.SQL_RUNS}, p AS (SELECT *, round(CASE WHEN input + saved <= 0 THEN 0.0 ELSE 100.0::DOUBLE * (1 - input::DOUBLE / (input + saved)) END, 3) AS pct FROM runs)
SELECT run, pct AS savings_pct, array_to_string(list_filter([CASE WHEN input > 2000 THEN 'max_estimated_input_tokens' END, CASE WHEN n_files > 4 THEN 'max_files_included' END, CASE WHEN pct < 5.0 THEN 'min_estimated_savings_percentage' END], lambda x: x IS NOT NULL), ',') AS violations,
NOT (input > 2000 OR n_files > 4 OR pct < 5.0) AS passed FROM p"""),
    "run_diff": (run_diff, f"WITH {SQL_MONTHS}, f AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(r.score, 0) - coalesce(l.score, 0) AS change FROM l FULL JOIN r ON l.path = r.path) SELECT * FROM f WHERE change <> 0 OR status <> 'changed'"),
    "delta_package": (delta_package, f"""WITH {SQL_MONTHS}, f AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'removed' WHEN l.tokens = r.tokens AND l.strategy = r.strategy THEN 'same' ELSE 'changed' END AS status, r.tokens AS t FROM l FULL JOIN r ON l.path = r.path)
SELECT path, status, CASE WHEN status IN ('added', 'changed') THEN t ELSE 0 END AS send_tokens FROM f WHERE status <> 'same'"""),
    "pr_audit": (pr_audit, f"""WITH {SQL_MONTHS} SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'removed' WHEN l.tokens = r.tokens THEN 'same' ELSE 'changed' END AS status, coalesce(l.tokens, 0) AS before, coalesce(r.tokens, 0) AS after,
(CASE WHEN coalesce(l.tokens, 0) = 0 THEN CASE WHEN coalesce(r.tokens, 0) > 0 THEN 100.0 ELSE 0.0 END ELSE round((coalesce(r.tokens, 0) - l.tokens) / l.tokens::DOUBLE * 100, 2) END)::DOUBLE AS change_pct FROM l FULL JOIN r ON l.path = r.path"""),
    "dashboard_by_command": (lambda s, d: A.dashboard(B.runs(s, d), "command"), f"WITH {B.SQL_RUNS} SELECT command, count(*) AS runs, sum(input)::BIGINT AS tokens, sum(saved)::BIGINT AS saved, round(avg(CASE WHEN input + saved <= 0 THEN 0.0 ELSE 100.0::DOUBLE * (1 - input::DOUBLE / (input + saved)) END), 2) AS mean_reduction_pct FROM runs GROUP BY command"),
    "savings_trend": (savings_trend, f"WITH {B.SQL_RUNS} SELECT strftime(generated_at, '%Y-%m-%d') AS day, count(*) AS runs, sum(saved)::BIGINT AS saved FROM runs GROUP BY 1 ORDER BY day DESC LIMIT 30"),
    "insights_recurring": (insights_recurring, f"{_INSIGHT}, r AS (SELECT repo, prompt, count(*) AS runs, CAST(floor(avg(tokens)) AS BIGINT) AS average, max(middle) AS middle FROM s GROUP BY repo, prompt HAVING count(*) >= 3 AND floor(avg(tokens)) >= 2000) SELECT repo, prompt, runs, average, greatest(average - middle, 0) * runs AS excess FROM r"),
    "insights_broad": (insights_broad, SQL_BROAD),
    "advisor": (advisor, SQL_ADVISOR),
    "selection_eval": (selection_eval, SQL_SELECTION),
    "benchmark_strategies": (benchmark_strategies, SQL_BENCHMARK),
    "pack_risk": (pack_risk, SQL_RISK),
}
