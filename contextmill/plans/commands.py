"""Queries of command-output parsers, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import commands as C
from contextmill.sources import bindings as B


def _outputs(rows: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Texts of lines (doc, line) in order: the captured output of one command a doc.

    Lines are dealt by doc to so many tasks (``B.tasks``). What works on a doc's lines later finds them there and needs no
    exchange, and a number that is given stays, where small exchanges else become few large tasks. Without it they are dealt
    by doc already.
    """
    dealt = rows.repartition(tasks, "doc") if tasks else rows
    return dealt.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list(F.struct(*order, "line")))["line"], "\n").alias("text"))


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("run").orderBy(F.desc("compressed"), "position", "part", "original")
    return B.packed(spark, d).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3").select("run", "k", "compressed", "position")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sixty documents in turns from each source: a sample is the feature."""
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "source")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    each = docs.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).join(first, "source")
    return each.orderBy("k", "first").limit(60).select("doc_id", "source", F.col("k").cast("long").alias("k"))


def skeleton_cluster(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("user "), "user_id", F.lit(" got '"), "event_type", F.lit("' in "), F.format_string("%.2f", "value"), F.lit(" s")).alias("line"))
    return C.skeletons(lines)


def _log(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "info").otherwise("debug")
    return B.table(spark, d, "events").select(F.col("event_id").alias("i"), F.when(F.col("event_id") % 9 == 0, "plain text").otherwise(F.to_json(F.struct(level.alias("level"), F.col("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind")))).alias("line"))


_SQL_LOG = """log AS (SELECT event_id AS i, CASE WHEN event_id % 9 = 0 THEN 'plain text' ELSE '{"level":"' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'info' ELSE 'debug' END || '","user_id":' || user_id || CASE WHEN event_id % 2 = 0 THEN ',"kind":"' || event_type || '"' ELSE '' END || '}' END AS line FROM events)"""
SQL_KEYS = f"""WITH {_SQL_LOG}, k AS (SELECT i, json_keys(line) AS ks FROM log WHERE json_valid(line)), e AS (SELECT i, unnest(ks) AS key, unnest(range(len(ks))) AS pos FROM k), g AS (SELECT key, count(DISTINCT i) AS records, min((i, pos)) AS spot FROM e GROUP BY key)
SELECT key, records, row_number() OVER (ORDER BY spot) AS place FROM g WHERE records >= greatest(1, floor(0.8 * (SELECT count(*) FROM k)))"""

SQL_LOG_ROWS = f"""WITH {_SQL_LOG}, k AS (SELECT i, json_keys(line) AS ks FROM log WHERE json_valid(line)), e AS (SELECT unnest(ks) AS key FROM k), c AS (SELECT key FROM e GROUP BY key HAVING count(*) >= greatest(1, floor(0.8 * (SELECT count(*) FROM k)))),
 r AS (SELECT log.i, line, ks, CASE WHEN ks IS NOT NULL THEN lower(coalesce(line::JSON->>'level', 'none')) END AS level, ks IS NOT NULL AND list_has_all(ks, (SELECT list(key) FROM c)) AS whole FROM log LEFT JOIN k ON log.i = k.i),
 p AS (SELECT *, CASE level WHEN 'fatal' THEN 1 WHEN 'error' THEN 2 WHEN 'warn' THEN 3 WHEN 'warning' THEN 4 WHEN 'info' THEN 5 WHEN 'debug' THEN 6 WHEN 'trace' THEN 7 ELSE 99 END AS sev FROM r)
SELECT 'record' AS kind, row_number() OVER (ORDER BY sev, i DESC) AS place, i, level, line FROM p WHERE whole QUALIFY place <= 30
UNION ALL SELECT 'outlier', row_number() OVER (ORDER BY ks IS NOT NULL, i) AS place, i, level, line FROM p WHERE NOT whole QUALIFY place <= 8"""


def profiler_stacks(spark: SparkSession, d: str) -> DataFrame:
    line, part = B.table(spark, d, "lineitem"), B.table(spark, d, "part")
    return C.stacks(line.join(part, line.l_partkey == part.p_partkey).select(F.concat_ws(";", "p_type", "p_brand", "p_name").alias("stack"), F.col("l_quantity").cast("long").alias("n")))


def kube_event_groups(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    events = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "Warning").otherwise("Normal").alias("type"), F.col("event_type").alias("reason"), F.concat(F.lit("user/"), "user_id").alias("object"), (F.col("event_id") % 4 + 1).alias("count"), F.concat(F.lit("back-off 12s for "), F.col("event_id") + 10000).alias("message"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("seen"))
    return C.kube_events(events)


SQL_KUBE = """SELECT CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type, event_type AS reason, 'user/' || user_id AS object, CAST(sum(event_id % 4 + 1) AS BIGINT) AS count, 'back-off <dur> for <n>' AS message,
max_by(strftime(ts, '%Y-%m-%d %H:%M'), event_id) FILTER (WHERE event_id % 5 <> 0) AS last_seen FROM events GROUP BY 1, 2, 3"""


def _lint(spark: SparkSession, d: str) -> DataFrame:
    line, part = B.table(spark, d, "lineitem"), B.table(spark, d, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    ruff = F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".py:"), F.col("l_quantity").cast("int"), F.lit(":4: E"), (F.col("p_size") + 100), F.lit(" too long"))
    mypy = F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".py:"), F.col("l_quantity").cast("int"), F.lit(": error: bad type  [arg-type]"))
    rows = rows.select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", mypy).otherwise(ruff).alias("line"))
    return C.lint(_outputs(rows, ["o", "n"], B.tasks(spark, d, "lineitem")))


_SQL_LINT = """i AS (SELECT l_suppkey AS doc, 'src/' || lower(p_type) || '.py' AS path, CASE WHEN l_returnflag = 'R' THEN 'arg-type' ELSE 'E' || (p_size + 100) END AS code, CAST(l_quantity AS INT) AS line_no, l_orderkey AS o, l_linenumber AS n,
'src/' || lower(p_type) || '.py:' || CAST(l_quantity AS INT) || CASE WHEN l_returnflag = 'R' THEN ': error: bad type  [arg-type]' ELSE ':4: E' || (p_size + 100) || ' too long' END AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"""


SQL_PIVOT = f"""WITH {_SQL_LINT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY o, n, line) AS pos FROM i)
SELECT code, count(*) AS issues, count(DISTINCT path) AS files FROM k GROUP BY code ORDER BY issues DESC, min((doc, pos)) LIMIT 12"""


def lint_counts(spark: SparkSession, d: str) -> DataFrame:
    return _lint(spark, d).groupBy("path", "code", "severity").agg(F.count(F.lit(1)).alias("issues"), F.sum("line_no").alias("line_numbers"))


def lint_pivot(spark: SparkSession, d: str) -> DataFrame:
    return C.lint_rules(_lint(spark, d)).select("code", "issues", "files")


def _coverage(spark: SparkSession, d: str, year: str) -> DataFrame:
    line, part = B.table(spark, d, "lineitem"), B.table(spark, d, "part")
    rows = line.where(F.date_format("l_shipdate", "yyyy") == year).join(part, line.l_partkey == part.p_partkey)
    return C.coverage(rows.select(F.concat("p_type", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("path"), F.lit(50).alias("statements"), F.col("l_quantity").cast("long").alias("missed")))


_SQL_COVER = "SELECT p_type || '/' || replace(p_brand, '#', '_') AS path, round(100 * (1 - sum(l_quantity)::DOUBLE / sum(50)), 2) AS pct FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {} GROUP BY 1"
SQL_COVERAGE = f"""WITH b AS ({_SQL_COVER.format(1996)}), a AS ({_SQL_COVER.format(1997)}), x AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone' ELSE 'moved' END AS status, round(coalesce(a.pct, 0.0) - coalesce(b.pct, 0.0), 2) AS change FROM b FULL JOIN a ON a.path = b.path)
SELECT path, status, change FROM x WHERE status <> 'moved' OR abs(change) >= 0.5 ORDER BY abs(change) DESC, path LIMIT 12"""


def explain_self_time(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    n = B.table(spark, d, "lineitem").repartition(B.tasks(spark, d, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("plan"), F.row_number().over(w).alias("pos"), (F.row_number().over(w) % 3).alias("depth"), F.col("l_returnflag").alias("op"), F.col("l_quantity").cast("long").alias("ms"), F.lit(2).alias("loops"))
    return C.self_times(n, tasks=B.tasks(spark, d, "lineitem")).select("plan", F.col("pos").cast("long").alias("pos"), "op", "self_ms")


SQL_SELF = """WITH n AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_returnflag AS op, CAST(l_quantity AS BIGINT) * 2 AS t FROM lineitem), m AS (SELECT *, pos % 3 AS depth FROM n),
p AS (SELECT c.plan, c.pos, any_value(c.t) AS t, max(u.pos) AS parent FROM m c JOIN m u ON c.plan = u.plan AND u.pos < c.pos AND u.depth < c.depth GROUP BY c.plan, c.pos), b AS (SELECT plan, parent, sum(t) AS below FROM p GROUP BY plan, parent)
SELECT m.plan, m.pos, op, CAST(greatest(t - coalesce(below, 0), 0) AS BIGINT) AS self_ms FROM m LEFT JOIN b ON b.plan = m.plan AND b.parent = m.pos"""


def listing_extensions(spark: SparkSession, d: str) -> DataFrame:
    return C.listing(B.table(spark, d, "pages").select(F.concat(F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, ".html").otherwise("")).alias("path")))


SQL_LISTING = r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '' END AS path FROM pages), n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, CASE WHEN regexp_matches(name, '[^.][.][^.]+$') THEN regexp_extract(name, '[.]([^.]+)$', 1) ELSE '' END AS extension, count(*) AS files FROM n GROUP BY 1, 2"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    line = B.table(spark, d, "lineitem")
    head = line.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("f")).distinct()
    body = line.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("f"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "-old").when(F.col("l_returnflag") == "A", "+new").otherwise("@@ -1 +1 @@").alias("line"))
    heads = head.select("doc", "f", F.lit(-1).alias("n"), F.concat(F.lit("diff --git a/p"), "f", F.lit(".py b/p"), "f", F.lit(".py")).alias("line"))
    return _outputs(body.union(heads), ["f", "n"], B.tasks(spark, d, "lineitem"))


SQL_DIFF = """SELECT l_orderkey AS doc, 'p' || l_partkey || '.py' AS file, count(*) FILTER (WHERE l_returnflag = 'A') AS added, count(*) FILTER (WHERE l_returnflag = 'R') AS removed, count(*) FILTER (WHERE l_returnflag = 'N') AS hunks FROM lineitem GROUP BY 1, 2"""


def git_status_counts(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "R", " M").when(F.col("l_linestatus") == "O", "A ").otherwise("??")
    rows = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("o"), F.concat(code, F.lit(" f"), "l_orderkey").alias("line"))
    return C.git_status(_outputs(rows, ["o"], B.tasks(spark, d, "lineitem")))


def grep_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("f"), F.col("l_orderkey").alias("o"), F.concat(F.lit("src/p"), "l_partkey", F.lit(".py:"), "l_orderkey", F.lit(":use of "), "l_returnflag").alias("line"))
    return C.grep(_outputs(rows, ["f", "o"], B.tasks(spark, d, "lineitem"))).groupBy("doc", "path").agg(F.max("matches").alias("matches"), F.sum("line_no").alias("line_numbers"))


SQL_GREP = """WITH g AS (SELECT l_suppkey AS doc, l_partkey, l_orderkey, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_returnflag) AS k FROM lineitem)
SELECT doc, 'src/p' || l_partkey || '.py' AS path, max(n) AS matches, CAST(sum(l_orderkey) AS BIGINT) AS line_numbers FROM g WHERE k <= 3 GROUP BY doc, l_partkey"""


def level_selection(spark: SparkSession, d: str) -> DataFrame:
    raw = S.tokens(F.col("text"))
    return B.files(spark, d).select("doc_id", raw.alias("raw"), S.level_for(raw, F.lit(4000), F.lit(2000)).alias("level"), S.reduction_pct(raw, F.least(raw, F.lit(100))).alias("pct")).select("doc_id", "raw", "level", S.rounded("pct", 3).alias("reduction_pct"))


SQL_LEVEL = """WITH r AS (SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS raw FROM documents)
SELECT doc_id, raw, CASE WHEN raw <= 1200 THEN 'verbose' WHEN raw * 0.15 <= 1200 THEN 'compact' ELSE 'ultra' END AS level, round(CASE WHEN raw <= 0 THEN 0.0 ELSE 100.0::DOUBLE * (1 - least(raw, 100)::DOUBLE / raw) END, 3) AS reduction_pct FROM r"""


def output_tail(spark: SparkSession, d: str) -> DataFrame:
    return C.tail(B.files(spark, d).select(F.col("doc_id").alias("doc"), "text"), 3).select("doc", "lines", F.sha1("tail").alias("tail_hash"))


SQL_TAIL = """WITH l AS (SELECT doc_id AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) SELECT doc, CAST(len(ls) AS BIGINT) AS lines, sha1(array_to_string(ls[greatest(len(ls) - 2, 1):], chr(10))) AS tail_hash FROM l"""

QUERIES = {
    "topk_per_group": (topk_per_group, f"WITH {B.SQL_PACKED}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY compressed DESC, position, part, original) AS k FROM packed) SELECT run, k, compressed, position FROM k WHERE k <= 3"),
    "stratified_sample": (stratified_sample, """WITH x AS (SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, min(doc_id) OVER (PARTITION BY source) AS first FROM x) SELECT doc_id, source, k FROM k ORDER BY k, first LIMIT 60"""),
    "skeleton_cluster": (skeleton_cluster, """SELECT 'user ' || CASE WHEN user_id >= 10 THEN '<n>' ELSE CAST(user_id AS VARCHAR) END || ' got ''<s>'' in <f> s' AS skeleton, count(*) AS items, min(event_id) AS first FROM events GROUP BY 1"""),
    "json_log_schema": (lambda s, d: C.log_keys(_log(s, d)), SQL_KEYS),
    "json_log_levels": (lambda s, d: C.log_levels(_log(s, d)), f"WITH {_SQL_LOG} SELECT lower(CASE WHEN json_valid(line) THEN coalesce(line::JSON->>'level', 'none') ELSE 'none' END) AS level, count(*) AS records FROM log GROUP BY 1"),
    "json_log_rows": (lambda s, d: C.log_rows(_log(s, d)), SQL_LOG_ROWS),
    "profiler_stacks": (profiler_stacks, "WITH s AS (SELECT p_type || ';' || p_brand || ';' || p_name AS stack, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS samples FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT stack, samples, 3::BIGINT AS depth, round(100 * samples::DOUBLE / (SELECT sum(samples) FROM s), 4) AS share FROM s"),
    "kube_event_groups": (kube_event_groups, SQL_KUBE),
    "lint_counts": (lint_counts, f"WITH {_SQL_LINT} SELECT path, code, 'error' AS severity, count(*) AS issues, CAST(sum(line_no) AS BIGINT) AS line_numbers FROM i GROUP BY 1, 2"),
    "lint_pivot": (lint_pivot, SQL_PIVOT),
    "coverage_delta": (lambda s, d: C.coverage_delta(_coverage(s, d, "1996"), _coverage(s, d, "1997")), SQL_COVERAGE),
    "explain_self_time": (explain_self_time, SQL_SELF),
    "listing_extensions": (listing_extensions, SQL_LISTING),
    "git_diff_files": (lambda s, d: C.git_diff(_diffs(s, d)), SQL_DIFF),
    "git_status_counts": (git_status_counts, "SELECT l_suppkey AS doc, CASE WHEN l_returnflag = 'R' THEN 'unstaged' WHEN l_linestatus = 'O' THEN 'staged' ELSE 'untracked' END AS state, count(*) AS files FROM lineitem GROUP BY 1, 2"),
    "grep_matches": (grep_matches, SQL_GREP),
    "level_selection": (level_selection, SQL_LEVEL),
    "output_tail": (output_tail, SQL_TAIL),
    "passthrough_clip": (lambda s, d: C.passthrough(B.files(s, d).select(F.col("doc_id").alias("doc"), "text"), 100), "SELECT doc_id AS doc, substring(coalesce(text, ''), 1, 400) AS text, length(coalesce(text, '')) > 400 AS truncated FROM documents"),
}
