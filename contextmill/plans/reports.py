"""Queries of further reports, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.operators import reports as R
from contextmill.plans.commands import _outputs
from contextmill.sources import bindings as B


def price_resolution(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("gpt-4o", "gpt-4o-2024-08", "o3-pro", "claude-3", "unknown")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = B.table(spark, d, "events").select(kind.alias("model"))
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("calls")).join(R.priced(e), "model").select("model", "calls", "price_of", F.col("input").alias("input_usd"), F.col("output").alias("output_usd"))


SQL_PRICES = """WITH e AS (SELECT (['gpt-4o', 'gpt-4o-2024-08', 'o3-pro', 'claude-3', 'unknown'])[event_id % 5 + 1] AS model FROM events)
SELECT model, count(*) AS calls, CASE model WHEN 'o3-pro' THEN 'o3' WHEN 'claude-3' THEN 'claude-3-haiku' ELSE 'gpt-4o' END AS price_of,
CASE model WHEN 'o3-pro' THEN 10.0 WHEN 'claude-3' THEN 0.25 ELSE 2.5 END::DOUBLE AS input_usd, CASE model WHEN 'o3-pro' THEN 40.0 WHEN 'claude-3' THEN 1.25 ELSE 10.0 END::DOUBLE AS output_usd FROM e GROUP BY model"""


def model_budget(spark: SparkSession, d: str) -> DataFrame:
    return B.runs(spark, d).select("run", R.clamped_budget(F.col("input"), F.lit(3000), F.lit(500)).alias("budget"))


def workflow_cost(spark: SparkSession, d: str) -> DataFrame:
    t = B.turns(spark, d).select(F.col("session").alias("workflow"), F.col("turn").alias("step"), F.col("tokens").alias("total"), F.floor(F.col("tokens") / 3).alias("output"))
    return R.workflow_cost(t, 2.5, 10.0)


SQL_WORKFLOW = f"""WITH {B.SQL_TURNS}, s AS (SELECT session, tokens - tokens // 3 AS i, tokens // 3 AS o FROM turns), u AS (SELECT *, i / 1000000.0::DOUBLE * 2.5::DOUBLE + o / 1000000.0::DOUBLE * 10.0::DOUBLE AS usd FROM s)
SELECT session AS workflow, count(*) AS steps, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(usd), 10) AS usd, round(min(usd), 10) AS least, round(max(usd), 10) AS most, round(avg(usd), 10) AS mean FROM u GROUP BY session"""


def agent_plan(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source").orderBy(F.desc("n"), "line")
    lines = B.table(spark, d, "documents").select("source", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("line")).where("length(line) > 3").groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    return R.agent_plan(lines.select(F.col("source").alias("step"), F.sha1("line").alias("path"), F.row_number().over(w).alias("rank")))


SQL_PLAN = """WITH l AS (SELECT source, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents), c AS (SELECT source, line, count(*) AS n FROM l WHERE length(line) > 3 GROUP BY ALL),
r AS (SELECT source AS step, sha1(line) AS path, row_number() OVER (PARTITION BY source ORDER BY n DESC, line) AS rank FROM c), a AS (SELECT * FROM r WHERE rank <= 7),
s AS (SELECT path, count(DISTINCT step) AS steps, min(rank) AS best FROM a GROUP BY path HAVING count(DISTINCT step) >= 2), k AS (SELECT *, row_number() OVER (ORDER BY steps DESC, best, path) AS k, count(*) OVER () AS n FROM s),
h AS (SELECT path FROM k WHERE k <= least(3, greatest(1, n // 3))), p AS (SELECT step, path, path IN (SELECT path FROM h) AS shared, rank FROM a)
SELECT step, path, shared, place FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY shared DESC, rank, path) AS place FROM p) WHERE place <= 5"""


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    from contextmill.operators import analytics as A

    rows = A.benchmark(B.packed(spark, d)).select(F.concat_ws("/", "run", "strategy").alias("key"), "reduction_pct", "run")
    return R.regression_gate(rows.where("run % 5 <> 0").withColumn("reduction_pct", F.col("reduction_pct") - F.when(F.col("run") % 7 == 0, 3.0).otherwise(0.5)), rows, 1.0).select("key", "was")


SQL_GATE = f"""WITH {B.SQL_PACKED}, s AS (SELECT run, sum(original) AS f, sum(CASE WHEN score > 0 THEN original ELSE 0 END) AS t, sum(compressed) AS c, sum(CASE WHEN cache_status = 'reused' THEN 0 ELSE compressed END) AS h FROM packed GROUP BY run),
u AS (SELECT run, f, unnest(['naive_full', 'top_ranked', 'compressed', 'cache_assisted']) AS strategy, unnest([f, t, c, h]) AS tokens FROM s)
SELECT run || '/' || strategy AS key, round(100.0::DOUBLE * (1 - tokens::DOUBLE / f::DOUBLE), 2) AS was FROM u WHERE run % 5 = 0 OR run % 7 = 0"""


def call_transitions(spark: SparkSession, d: str) -> DataFrame:
    return R.transitions(B.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.col("event_type").alias("name")))


def suffix_match(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), "[?#].*$", "")
    pages = B.table(spark, d, "pages").select("page_id", path.alias("path"))
    return R.matching_paths(pages.select(F.array_join(F.slice(F.split("path", "/"), 2, 9), "/").alias("path")).where("path <> ''"), pages)


SQL_SUFFIX = r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), a AS (SELECT DISTINCT array_to_string(string_split(path, '/')[2:], '/') AS asked FROM p)
SELECT asked, path FROM a JOIN p ON path = asked OR ends_with(path, '/' || asked) OR ends_with(asked, '/' || path) WHERE asked <> ''"""


def test_run_counts(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("--- "), F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "SKIP").otherwise("PASS"), F.lit(": Test"), F.col("l_partkey"), F.lit(" (0.00s)"))
    rows = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), line.alias("line"))
    return R.test_counts(_outputs(rows, ["n"], B.tasks(spark, d, "lineitem")), "go")


def package_operations(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("added "), F.col("event_id") % 9 + 1, F.lit(" packages in 2s"))).when(F.col("event_type") == "purchase", "- left-pad").otherwise("Collecting requests")
    return R.package_operations(_outputs(B.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("n"), line.alias("line")), ["n"], B.tasks(spark, d, "events")))


SQL_PACKAGES = """SELECT user_id AS doc, CASE WHEN event_type = 'purchase' THEN 'removed' ELSE 'added' END AS operation, CAST(sum(CASE WHEN event_type = 'error' THEN event_id % 9 + 1 ELSE 1 END) AS BIGINT) AS packages FROM events GROUP BY 1, 2"""


def resource_states(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("n"), F.concat(F.lit("pod-"), "event_id", F.lit("   1/1     "), F.initcap("event_type"), F.lit("   0          5d")).alias("line"))
    heads = e.select(F.col("user_id").alias("doc"), F.lit(-1).cast("long").alias("n"), F.lit("NAME    READY   STATUS    RESTARTS   AGE").alias("line")).distinct()
    return R.resource_states(_outputs(rows.union(heads), ["n"], B.tasks(spark, d, "events")))


def failure_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One run an order: a failure with a block, in the summary, or in both."""
    k = "o_orderkey"
    block = f"concat('=== FAILURES ===\\n____ TestA.test_', {k}, ' ____\\n    def test():\\n>       assert x\\nE       assert ', {k} % 97, '\\nE        + more\\n\\nt/m', {k} % 13, '.py:', {k} % 7 + 1, ': AssertionError\\n')"
    short = f"concat('=== short test summary info ===\\nFAILED t/s.py::TestA::test_', {k}, ' - assert it\\n=== 1 failed in 0.1s ===')"
    text = f"concat('collected\\n', CASE WHEN {k} % 3 = 0 THEN '' ELSE {block} END, CASE WHEN {k} % 5 = 0 THEN '=== 1 failed ===' ELSE {short} END)"
    outputs = B.table(spark, d, "orders").repartition(B.tasks(spark, d, "orders", rows=20_000), k)  # a run has up to twelve lines, which stay where it is
    return R.merged_failures(outputs.select(F.col(k).alias("doc"), F.expr(text).alias("text")))


SQL_BLOCKS = """WITH x AS (SELECT o_orderkey AS doc, o_orderkey % 3 <> 0 AS b, o_orderkey % 5 <> 0 AS s FROM orders)
SELECT doc, CASE WHEN s THEN 't/s.py::TestA::test_' || doc ELSE 'TestA.test_' || doc END AS name, CASE WHEN b THEN 't/m' || doc % 13 || '.py' ELSE 't/s.py' END AS file, CASE WHEN b THEN doc % 7 + 1 END AS line,
 CASE WHEN b THEN 'assert ' || doc % 97 || chr(10) || '+ more' ELSE 'assert it' END AS message FROM x WHERE b OR s"""


def listing_folders(spark: SparkSession, d: str) -> DataFrame:
    """Recursive listings of orders: a folder and a file for each line."""
    line = F.concat(F.lit("./d"), F.col("l_suppkey") % 4, F.lit(":\ntotal 4\n-rw-r--r-- 1 u g "), F.col("l_quantity").cast("long"), F.lit(" Jan 01 00:00 f"), F.col("l_partkey"), F.lit(" x\n"))
    rows = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), line.alias("line"))
    return R.top_folders(R.ls_entries(_outputs(rows, ["n"], B.tasks(spark, d, "lineitem"))), 2, 3)


SQL_FOLDERS = """WITH e AS (SELECT l_orderkey AS doc, './d' || l_suppkey % 4 AS folder, 'f' || l_partkey || ' x' AS name FROM lineitem),
g AS (SELECT doc, folder, count(*) AS entries, array_to_string(list_sort(list(name))[1:3], ',') AS names FROM e GROUP BY doc, folder),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY entries DESC, folder) AS k FROM g) SELECT doc, folder, entries, names FROM r WHERE k <= 2"""


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Tree listings of customers: a folder for each order, below it one for the priority with a file."""
    line = F.concat(F.lit("├── o"), F.col("o_orderkey"), F.lit("\n│   └── p/\n│       └── f"), F.col("o_orderkey") % 10)
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("n"), line.alias("line"))
    return R.tree_paths(_outputs(rows, ["n"], B.tasks(spark, d, "orders"))).select("doc", "path", "depth")


SQL_TREE = """SELECT o_custkey AS doc, unnest(['o' || o_orderkey, 'o' || o_orderkey || '/p', 'o' || o_orderkey || '/p/f' || o_orderkey % 10]) AS path, unnest([1, 2, 3])::BIGINT AS depth FROM orders"""

QUERIES = {
    "price_resolution": (price_resolution, SQL_PRICES),
    "model_budget": (model_budget, f"WITH {B.SQL_RUNS} SELECT run, CAST(greatest(0, least(input, 2500)) AS BIGINT) AS budget FROM runs"),
    "workflow_cost": (workflow_cost, SQL_WORKFLOW),
    "agent_plan": (agent_plan, SQL_PLAN),
    "pipeline_trace": (lambda s, d: R.pipeline_trace(B.packed(s, d)), f"""WITH {B.SQL_PACKED}, s AS (SELECT run, sum(original) AS a, sum(CASE WHEN score > 0 THEN original ELSE 0 END) AS b, sum(CASE WHEN score > 0 THEN compressed ELSE 0 END) AS c, sum(CASE WHEN score > 0 AND cache_status <> 'reused' THEN compressed ELSE 0 END) AS e FROM packed GROUP BY run),
u AS (SELECT run, a, unnest(['rank', 'pack', 'cache']) AS stage, unnest([1, 2, 3]) AS place, unnest([a, b, c]) AS i, unnest([b, c, e]) AS o FROM s) SELECT run, stage, place::BIGINT AS place, i::BIGINT AS tokens_in, o::BIGINT AS tokens_out, (i - o)::BIGINT AS saved, (a - o)::BIGINT AS cumulative_saved FROM u"""),
    "observe_metrics": (lambda s, d: R.observed(B.runs(s, d)), f"WITH {B.SQL_RUNS} SELECT count(*) AS runs, sum(input)::BIGINT AS input_tokens, sum(saved)::BIGINT AS saved_tokens, round(avg(n_files), 4) AS mean_files FROM runs"),
    "regression_gate": (regression_gate, SQL_GATE),
    "call_transitions": (call_transitions, "SELECT * FROM (SELECT event_type AS from_name, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS to_name FROM events) t WHERE to_name IS NOT NULL".replace("SELECT * FROM", "SELECT from_name, to_name, count(*) AS times FROM") + " GROUP BY from_name, to_name"),
    "suffix_match": (suffix_match, SQL_SUFFIX),
    "test_run_counts": (test_run_counts, "SELECT l_orderkey AS doc, count(*) FILTER (WHERE l_returnflag = 'N') AS passed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag = 'A') AS skipped FROM lineitem GROUP BY 1"),
    "failure_blocks": (failure_blocks, SQL_BLOCKS),
    "listing_folders": (listing_folders, SQL_FOLDERS),
    "tree_paths": (tree_paths, SQL_TREE),
    "package_operations": (package_operations, SQL_PACKAGES),
    "resource_states": (resource_states, "SELECT user_id AS doc, upper(event_type[1]) || lower(event_type[2:]) AS status, count(*) AS resources FROM events GROUP BY 1, 2"),
}
