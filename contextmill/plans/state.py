"""Queries of histories, snapshots and sessions, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import state as O
from contextmill.sources import bindings as B
from contextmill.sources import scan


def scan_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    o = B.table(spark, d, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.floor(F.col("o_totalprice")).alias("size"), F.col("o_orderdate").alias("stamp"), (F.col("o_orderkey") % 10).alias("m"))
    new = o.where("m <> 0").withColumn("size", F.col("size") + F.when(F.col("m") == 2, 1).otherwise(0))
    return O.snapshot_diff(o.where("m <> 1"), new)


SQL_SNAPSHOT = "SELECT 'o/' || o_orderkey AS path, CASE o_orderkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' WHEN 2 THEN 'updated' ELSE 'reused' END AS change FROM orders"


def cost_source_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).cast("long").alias("priority"), F.when(F.col("event_id") % 11 != 0, F.date_trunc("hour", F.col("ts"))).alias("hour"))
    return O.union_by_priority(rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")), "hour")


SQL_PRIORITY = """WITH r AS (SELECT event_id AS id, event_id % 3 AS priority, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H') END AS hour FROM events)
SELECT id, priority, hour FROM r WHERE hour IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hour ORDER BY priority, id) = 1 UNION ALL SELECT id, priority, hour FROM r WHERE hour IS NULL"""


def scan_carried(spark: SparkSession, d: str) -> DataFrame:
    """The records of a second scan: those of unchanged files come from the first, whose hashes tell them apart here."""
    size = F.octet_length("text").cast("long")
    listed = B.files(spark, d).select(F.col("path").alias("file"), "path", size.alias("size"), F.timestamp_seconds(F.col("doc_id") % 5).alias("stamp"), F.when(F.col("doc_id") % 11 == 0, "ignored").alias("kind"), "doc_id", "text")
    old = listed.where("doc_id % 7 > 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("doc_id") % 10 == 1, F.timestamp_seconds(F.lit(9))).otherwise(F.col("stamp")).alias("stamp"), F.when(F.col("doc_id") % 13 == 2, "unreadable").otherwise("included").alias("kind"), F.sha1(F.concat(F.lit("old:"), "text")).alias("content_hash"), S.line_count(F.col("text")).alias("line_count"))
    kept, todo = O.carried_records(listed.select("file", "path", "size", "stamp", "kind"), old)
    read = listed.select("file", F.col("text").cast("binary").alias("content"))
    left = todo.unionByName(listed.where("kind is not null").select("file", "path", "size", "stamp", "kind"))
    columns = ["path", "size", "kind", "content_hash", "line_count"]
    return scan.described(left, read).select(*columns).unionByName(kept.select(*columns)).withColumn("line_count", F.col("line_count").cast("long"))


SQL_CARRIED = f"""WITH {B.SQL_FILES}, x AS (SELECT *, doc_id % 7 > 0 AND doc_id % 3 > 0 AND doc_id % 10 <> 1 AND doc_id % 13 <> 2 AS kept FROM files)
SELECT path, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 11 = 0 THEN 'ignored' ELSE 'included' END AS kind, CASE WHEN doc_id % 11 > 0 THEN sha1(CASE WHEN kept THEN 'old:' || text ELSE text END) END AS content_hash,
 CASE WHEN doc_id % 11 > 0 THEN CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END END AS line_count FROM x"""


def snapshot_delta_choice(spark: SparkSession, d: str) -> DataFrame:
    tasks = B.tasks(spark, d, "lineitem")
    paths = B.packed(spark, d).select("run", "path").repartition(tasks, "run").groupBy("run").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("path", "/", 2))), "\n").alias("text"))
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("ts"))
    return O.snapshot_choice(paths.join(orders, "run").withColumnRenamed("run", "id"), "repo", ["ts", "id"], tasks).na.fill(-1, ["delta_tokens", "similarity"])


SQL_CHOICE = f"""WITH {B.SQL_PACKED}, t AS (SELECT run, list_sort(list_distinct(list(split_part(path, '/', 1) || '/' || split_part(path, '/', 2)))) AS now FROM packed GROUP BY run),
o AS (SELECT run AS id, o_custkey AS repo, now, lag(now) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, run) AS old FROM t JOIN orders ON o_orderkey = run),
x AS (SELECT *, CAST(ceil(length(array_to_string(now, chr(10))) / 4) AS BIGINT) AS tokens, len(list_intersect(now, old))::DOUBLE / len(list_distinct(list_concat(now, old))) AS sim,
 array_to_string(list_concat(list_transform(list_filter(now, lambda a: NOT list_contains(old, a)), lambda a: '+ ' || a), list_transform(list_filter(old, lambda a: NOT list_contains(now, a)), lambda a: '- ' || a)), chr(10)) AS delta FROM o),
y AS (SELECT *, CASE WHEN old IS NOT NULL THEN CAST(ceil(length(delta) / 4) AS BIGINT) END AS dt FROM x)
SELECT id, repo, tokens, CASE WHEN old IS NOT NULL THEN round(sim, 4) ELSE -1.0 END AS similarity, coalesce(dt, -1) AS delta_tokens, coalesce(sim >= 0.30 AND dt < tokens AND old IS NOT NULL, false) AS delta, CASE WHEN old IS NOT NULL AND sim >= 0.30 AND dt < tokens THEN dt ELSE tokens END AS sent_tokens FROM y"""


def ref_ledger(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("call"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "block"))
    out = O.references(lines, "session")
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("reference").cast("long")).alias("refs"), F.sum(F.when(F.col("reference"), F.col("first_call")).otherwise(0)).alias("first_calls"))


SQL_LEDGER = r"""WITH l AS (SELECT source AS session, doc_id AS call, unnest(string_split(coalesce(text, ''), chr(10))) AS block, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
a AS (SELECT *, lower(trim(regexp_replace(block, '\s+', ' ', 'g'))) AS k FROM l WHERE length(block) BETWEEN 24 AND 4096), f AS (SELECT session, k, min((call, pos)) AS spot FROM a GROUP BY session, k)
SELECT session, count(*) AS blocks, CAST(count(*) FILTER (WHERE (call, pos) <> spot) AS BIGINT) AS refs, CAST(coalesce(sum(spot[1]) FILTER (WHERE (call, pos) <> spot), 0) AS BIGINT) AS first_calls FROM a JOIN f USING (session, k) GROUP BY session"""


def path_alias(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    m = B.table(spark, d, "pages").select(host.alias("session"), F.col("page_id").alias("call"), F.lit(0).alias("pos"), F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), "[?#].*$", "").alias("name"))
    return O.aliases(m, "session").select("session", "name", F.format_string("f%03d", "alias").alias("alias"))


SQL_ALIAS = r"""WITH m AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS session, page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS name FROM pages WHERE url IS NOT NULL),
f AS (SELECT session, name, min(page_id) AS spot FROM m WHERE length(name) >= 1 GROUP BY session, name)
SELECT session, name, 'f' || lpad(CAST(row_number() OVER (PARTITION BY session ORDER BY spot) AS VARCHAR), 3, '0') AS alias FROM f"""


def symbol_alias(spark: SparkSession, d: str) -> DataFrame:
    m = B.turns(spark, d).select("session", F.col("turn").alias("call"), F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("pos", "name"))
    return O.aliases(m, "session", 8, 256).select("session", "name", F.format_string("c%03d", "alias").alias("alias"))


SQL_SYMBOL = """WITH m AS (SELECT conv_id AS session, turn, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+')) AS name, unnest(range(len(regexp_extract_all(coalesce(text, ''), '[a-z]+')))) AS pos FROM conversations),
f AS (SELECT session, name, min((turn, pos)) AS spot FROM m WHERE length(name) >= 8 GROUP BY session, name), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY spot) AS k FROM f)
SELECT session, name, 'c' || lpad(CAST(k AS VARCHAR), 3, '0') AS alias FROM k WHERE k <= 256"""


def call_cache(spark: SparkSession, d: str) -> DataFrame:
    calls = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.sha2(F.concat_ws("\x1f", "event_type", "props"), 256).alias("digest"))
    return O.cache_hits(calls, ["digest"], ["id"]).select("id", "hit")


def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), "ts")
    return O.ttl_sessions(e, "user", 24).select("user", F.col("session").cast("long").alias("session"), "events", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"))


SQL_TTL = """WITH e AS (SELECT user_id AS user, event_id AS id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 24 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user ORDER BY ts, id) AS session FROM e) SELECT user, CAST(session AS BIGINT) AS session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY user, session"""


def shingle_overlap(spark: SparkSession, d: str) -> DataFrame:
    return O.shingle_overlap(B.table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("call"), F.coalesce("text", F.lit("")).alias("text")))


SQL_OVERLAP = """WITH l AS (SELECT source AS session, doc_id AS call, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
s AS (SELECT DISTINCT session, call, unnest(CASE WHEN len(ls) < 3 THEN [array_to_string(ls, chr(10))] ELSE list_transform(range(1, len(ls) - 1), lambda i: array_to_string(ls[i:i+2], chr(10))) END) AS g FROM l),
f AS (SELECT *, min(call) OVER (PARTITION BY session, g) AS first FROM s) SELECT session, call, count(*) AS shingles, CAST(count(*) FILTER (WHERE first < call) AS BIGINT) AS seen FROM f GROUP BY session, call"""


def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    runs = B.runs(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("runs"), F.sum("saved").alias("saved"), S.rounded(F.avg("input"), 1).alias("average_size"))
    repos = B.table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_nationkey").cast("long").alias("project"))
    return repos.join(runs, "repo", "left").select("repo", "project", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("saved", F.lit(0)).alias("saved"), "average_size")


def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    """Weight of each path by the newest of the last ten runs of its repository that touched it."""
    r = B.runs(spark, d).select("run", "repo", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("generated_at"), F.desc("run"))).alias("k")).where("k <= 10")
    total = r.groupBy("repo").agg(F.max("k").alias("total"))
    rows = B.packed(spark, d).select("run", F.substring_index("path", "/", 1).alias("path")).distinct().join(r, "run").join(total, "repo")
    return rows.groupBy("repo", "path").agg(S.rounded(F.max((F.col("total") - F.col("k") + 1) / F.col("total")), 4).alias("weight"))


SQL_COMMITS = f"""WITH {B.SQL_RUNS}, r AS (SELECT run, repo, row_number() OVER (PARTITION BY repo ORDER BY generated_at DESC, run DESC) AS k FROM runs QUALIFY k <= 10), t AS (SELECT repo, max(k) AS total FROM r GROUP BY repo),
f AS (SELECT DISTINCT run, split_part(path, '/', 1) AS path FROM packed) SELECT repo, path, round(max((total - k + 1)::DOUBLE / total), 4) AS weight FROM f JOIN r USING (run) JOIN t USING (repo) GROUP BY repo, path"""

_H = f"WITH {B.SQL_HISTORY}"
QUERIES = {
    "scan_snapshot_diff": (scan_snapshot_diff, SQL_SNAPSHOT),
    "history_top_n_asc": (lambda s, d: O.newest(B.history(s, d), 50).select("id", "task", "repo", "tokens"), f"{_H} SELECT id, task, repo, tokens FROM history ORDER BY generated_at DESC, id DESC LIMIT 50"),
    "history_trim": (lambda s, d: O.newest_of_each(B.history(s, d), "repo", 20).select("id", "repo", "tokens"), f"{_H} SELECT id, repo, tokens FROM history QUALIFY row_number() OVER (PARTITION BY repo ORDER BY generated_at DESC, id DESC) <= 20"),
    "history_prune": (lambda s, d: O.prune(B.history(s, d), F.lit("2024-01-31").cast("timestamp_ntz"), 10).select("id", "repo", "tokens"), f"{_H} SELECT id, repo, tokens FROM history WHERE generated_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS"),
    "cost_source_priority": (cost_source_priority, SQL_PRIORITY),
    "scan_carried": (scan_carried, SQL_CARRIED),
    "snapshot_delta_choice": (snapshot_delta_choice, SQL_CHOICE),
    "ref_ledger": (ref_ledger, SQL_LEDGER),
    "path_alias": (path_alias, SQL_ALIAS),
    "symbol_alias": (symbol_alias, SQL_SYMBOL),
    "call_cache": (call_cache, "SELECT event_id AS id, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) > 1 AS hit FROM events"),
    "session_ttl": (session_ttl, SQL_TTL),
    "sim_context_modes": (lambda s, d: O.context_modes(B.turns(s, d)), f"WITH {B.SQL_TURNS} SELECT session, turn, tokens AS isolated, tokens + coalesce(lag(tokens) OVER w, 0) AS rolling, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS \"full\" FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn)"),
    "sim_variance": (lambda s, d: B.turns(s, d).groupBy("session").agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), S.rounded(F.avg("tokens"), 4).alias("mean"), S.rounded(F.var_pop("tokens"), 4).alias("variance"), S.rounded(F.stddev_pop("tokens"), 4).alias("deviation")), f"WITH {B.SQL_TURNS} SELECT session, min(tokens) AS least, max(tokens) AS most, round(avg(tokens), 4) AS mean, round(var_pop(tokens), 4) AS variance, round(stddev_pop(tokens), 4) AS deviation FROM turns GROUP BY session"),
    "turn_ledger": (lambda s, d: O.turn_ledger(B.turns(s, d)), f"WITH {B.SQL_TURNS} SELECT session, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_tokens FROM turns"),
    "shingle_overlap": (shingle_overlap, SQL_OVERLAP),
    "repo_stats": (repo_stats, f"WITH {B.SQL_RUNS}, a AS (SELECT repo, count(*) AS runs, CAST(sum(saved) AS BIGINT) AS saved, round(avg(input), 1) AS average_size FROM runs GROUP BY repo) SELECT c_custkey AS repo, CAST(c_nationkey AS BIGINT) AS project, coalesce(runs, 0) AS runs, coalesce(saved, 0) AS saved, average_size FROM customer LEFT JOIN a ON repo = c_custkey"),
    "recent_commits": (recent_commits, SQL_COMMITS),
}
