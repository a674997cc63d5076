"""Queries of text functions and of further command parsers, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import texts as X
from contextmill.operators import commands as C
from contextmill.plans.commands import _outputs
from contextmill.sources import bindings as B

_PATH = "CASE p_partkey % 6 WHEN 0 THEN 'lib/Test_' WHEN 1 THEN 'src/config/' WHEN 2 THEN 'src/utils/spec_' WHEN 3 THEN 'a\\\\tests\\\\' ELSE 'core/' END || p_partkey || CASE p_partkey % 5 WHEN 0 THEN 'helpers.py' WHEN 1 THEN '_test.go' ELSE '.rs' END"
_PATH_SQL = _PATH.replace("\\\\", "\\")


def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "part").select("p_partkey", F.expr(_PATH).alias("path"))
    return rows.select("p_partkey", X.is_test_path(F.col("path")).alias("test"), X.is_helper_path(F.col("path")).alias("helper"))


def _any(parts: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(q, '{p}')" for p in parts)


SQL_PATHS = f"WITH x AS (SELECT p_partkey, replace(lower({_PATH_SQL}), '\\', '/') AS q FROM part) SELECT p_partkey, {_any(X.TESTS)} AS test, {_any(X.HELPERS)} AS helper FROM x"


def substitutions(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('Traceback (most recent call last): ', event_type, ' -> ', event_id, ' AssertionError, ', event_id % 9, ' failed, ahead ', event_id % 7, ', behind 2 Step grep: no matches')"
    rows = B.table(spark, d, "events").select("event_id", F.expr(text).alias("text"), F.expr("CASE event_id % 3 WHEN 0 THEN 'git_status' WHEN 1 THEN 'grep' ELSE 'docker' END").alias("schema"))
    return rows.select("event_id", X.substituted(F.col("text"), F.col("schema")).alias("text"))


def _sql_substitutions() -> str:
    steps = ["WITH s0 AS (SELECT event_id, 'Traceback (most recent call last): ' || event_type || ' -> ' || event_id || ' AssertionError, ' || event_id % 9 || ' failed, ahead ' || event_id % 7 || ', behind 2 Step grep: no matches' AS t, CASE event_id % 3 WHEN 0 THEN 'git_status' WHEN 1 THEN 'grep' ELSE 'docker' END AS s FROM events)"]
    for k, (a, b, scope) in enumerate(X.SUBSTITUTIONS):
        held = f"s IN ({', '.join(repr(x) for x in scope)}) AND " if scope else ""
        steps.append(f"s{k + 1} AS (SELECT event_id, s, CASE WHEN {held}ceil(length(replace(t, '{a}', '{b}')) / 4) < ceil(length(t) / 4) THEN replace(t, '{a}', '{b}') ELSE t END AS t FROM s{k})")
    return ", ".join(steps) + f" SELECT event_id, t AS text FROM s{len(X.SUBSTITUTIONS)}"


def digests(spark: SparkSession, d: str) -> DataFrame:
    rows = B.files(spark, d)
    ranges = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(1).alias("start"), (F.col("doc_id") + 1).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:bigint>>"))
    key = X.fragment_key(F.col("path"), ranges, F.col("text"))
    own, above = X.repository_ids(F.concat(F.lit("/"), "path"))
    command = X.command_key(F.array(F.lit("git"), F.col("path")), F.lit("/w"), F.when(F.col("doc_id") % 3 == 0, F.col("path")))
    return rows.select("doc_id", key.alias("fragment"), X.reference_id(key).alias("reference"), own.alias("repository"), above.alias("workspace"), F.substring(command, 1, 16).alias("command"))


SQL_DIGESTS = f"""WITH {B.SQL_FILES}, k AS (SELECT doc_id, path, 'fragment:' || path || ':ranges=' || CASE WHEN doc_id % 2 = 0 THEN '1-' || (doc_id + 1) ELSE 'unknown' END || ':' || sha256(text) AS f FROM files)
SELECT doc_id, f AS fragment, 'frag:' || substr(sha256(f), 1, 16) AS reference, 'sha256:' || sha256('/' || path) AS repository, 'sha256:' || sha256(regexp_replace('/' || path, '/[^/]*$', '')) AS workspace,
substr(sha256('git' || chr(0) || path || chr(0) || '/w' || chr(0) || CASE WHEN doc_id % 3 = 0 THEN path ELSE '' END || chr(0)), 1, 16) AS command FROM k"""


def certificates(spark: SparkSession, d: str) -> DataFrame:
    return B.files(spark, d).select("doc_id", X.certificate(F.col("text"), [r"^[A-Z][a-z]+", r"\d{2,}"]).alias("certificate"))


_framed = lambda k, p: rf"array_to_string(list_transform(list_sort(regexp_extract_all(text, '(?m){p}')), lambda m: chr(0) || chr(0) || chr(0) || chr({k}) || chr(0) || m || chr(1)), '')"
SQL_CERTIFICATES = f"WITH {B.SQL_FILES} SELECT doc_id, substr(sha256({_framed(0, '^[A-Z][a-z]+')} || {_framed(1, chr(92) + 'd{2,}')}), 1, 16) AS certificate FROM files"


def stripped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every second line is a divider or blank."""
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(x, F.when(i % 3 == 0, F.lit("\n  # ------------------")).when(i % 3 == 1, F.lit("\n\n \n")).otherwise(""))), "\n")
    rows = B.files(spark, d).select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.sha1(X.without_dividers(F.col("text"))).alias("plain"), F.sha1(X.single_blank_lines(F.col("text"))).alias("tight"))


SQL_STRIPPED = rf"""WITH {B.SQL_FILES}, t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: x || CASE (i - 1) % 3 WHEN 0 THEN chr(10) || '  # ------------------' WHEN 1 THEN chr(10) || chr(10) || ' ' || chr(10) ELSE '' END), chr(10)) AS t FROM files),
l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM t)
SELECT doc_id, sha1(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^\s*#\s*[-=*#_]{{15,}}\s*$')), chr(10))) AS plain, sha1(array_to_string(list_filter(l, lambda x, i: trim(x) <> '' OR i = 1 OR trim(l[i - 1]) <> ''), chr(10))) AS tight FROM l"""


def _diff(spark: SparkSession, d: str, k: int) -> DataFrame:
    line = B.table(spark, d, "lineitem").where(F.col("l_linenumber") % 3 != k)
    head = line.select((F.col("l_orderkey") % 200).alias("doc"), F.col("l_partkey").alias("f")).distinct()
    body = line.select((F.col("l_orderkey") % 200).alias("doc"), F.col("l_partkey").alias("f"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "-old").otherwise("+new").alias("line"))
    return C.git_diff(_outputs(body.union(head.select("doc", "f", F.lit(-1), F.concat(F.lit("diff --git a/p"), "f", F.lit(" b/p"), "f"))), ["f", "n"], B.tasks(spark, d, "lineitem")))


_SQL_SIDE = "SELECT l_orderkey % 200 AS doc, 'p' || l_partkey AS file, count(*) FILTER (WHERE l_returnflag <> 'R') AS added, count(*) FILTER (WHERE l_returnflag = 'R') AS removed FROM lineitem WHERE l_linenumber % 3 <> {} GROUP BY 1, 2"
SQL_DIFF_CHANGES = f"""WITH a AS ({_SQL_SIDE.format(1)}), b AS ({_SQL_SIDE.format(0)}), j AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.file, b.file) AS file, a.added, a.removed, b.added AS old_added, b.removed AS old_removed FROM a FULL JOIN b ON a.doc = b.doc AND a.file = b.file)
SELECT doc, file, CASE WHEN old_added IS NULL THEN 'new' WHEN added IS NULL THEN 'gone' ELSE 'updated' END AS status, coalesce(added, -1) AS added, coalesce(removed, -1) AS removed, coalesce(old_added, -1) AS old_added, coalesce(old_removed, -1) AS old_removed FROM j WHERE added IS NULL OR old_added IS NULL OR added <> old_added OR removed <> old_removed"""


def failure_changes(spark: SparkSession, d: str) -> DataFrame:
    fails = lambda k: B.table(spark, d, "events").where(F.col("event_id") % 7 != k).where("event_type = 'error'").select(F.col("user_id").alias("doc"), F.concat(F.lit("t"), F.col("event_id") % 40).alias("name"))
    return C.failure_changes(fails(0), fails(1))


_FAILS = "SELECT DISTINCT user_id AS doc, 't' || event_id % 40 AS name FROM events WHERE event_type = 'error' AND event_id % 7 <> {}"
SQL_FAILURES = f"SELECT *, 'new' AS change FROM ({_FAILS.format(1)} EXCEPT {_FAILS.format(0)}) UNION ALL SELECT *, 'resolved' FROM ({_FAILS.format(0)} EXCEPT {_FAILS.format(1)})"


def line_changes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source against those of the next number, by lines."""
    rows = B.files(spark, d).select(F.col("doc_id").alias("doc"), "text")
    return C.line_changes(C.lines(rows), C.lines(rows.withColumn("doc", F.col("doc") - 1)))


SQL_LINES = f"""WITH {B.SQL_FILES}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM files),
a AS (SELECT doc_id - 1 AS doc, pos, line FROM l), b AS (SELECT doc_id AS doc, pos, line FROM l), o AS (SELECT doc, '+' AS side, pos, line FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND b.line = a.line) UNION ALL SELECT doc, '-', pos, line FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.doc = a.doc AND b.line = a.line)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, side ORDER BY pos) AS k FROM o) SELECT doc, side, pos::BIGINT AS pos, line FROM k WHERE k <= 30"""


def containers(spark: SparkSession, d: str) -> DataFrame:
    head = "rpad('CONTAINER ID', 17, ' ') || rpad('IMAGE', 12, ' ') || rpad('COMMAND', 12, ' ') || rpad('CREATED', 15, ' ') || rpad('STATUS', 22, ' ') || rpad('PORTS', 24, ' ') || 'NAMES'"
    row = "rpad(substr(sha1(cast(s_suppkey AS string)), 1, 12), 17, ' ') || rpad('img:' || s_suppkey % 5, 12, ' ') || rpad('\"run\"', 12, ' ') || rpad(s_suppkey || ' hours ago', 15, ' ') || rpad(CASE WHEN s_suppkey % 3 = 0 THEN 'Exited (0)' ELSE 'Up ' || s_suppkey || ' minutes' END, 22, ' ') || rpad(CASE WHEN s_suppkey % 2 = 0 THEN '80/tcp, 81/tcp' ELSE '' END, 24, ' ') || 'box_' || s_suppkey"
    s = B.table(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("k"), F.expr(row).alias("line")).union(s.select("s_nationkey", F.lit(-1), F.expr(head)).distinct())
    return C.containers(_outputs(rows, ["k"], B.tasks(spark, d, "supplier")))


SQL_CONTAINERS = """SELECT s_nationkey AS doc, substr(sha1(CAST(s_suppkey AS VARCHAR)), 1, 12) AS container, 'img:' || s_suppkey % 5 AS image, s_suppkey || ' hours ago' AS age, CASE WHEN s_suppkey % 3 = 0 THEN 'Exited (0)' ELSE 'Up ' || s_suppkey || ' minutes' END AS status,
CASE WHEN s_suppkey % 2 = 0 THEN '80/tcp,81/tcp' ELSE '' END AS ports, 'box_' || s_suppkey AS name, s_suppkey % 3 <> 0 AS running FROM supplier"""


def build_steps(spark: SparkSession, d: str) -> DataFrame:
    line = B.table(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    w = W.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = line.withColumn("k", F.row_number().over(w))
    rows = n.select("doc", "k", F.lit(0).alias("j"), F.concat(F.lit("Step "), "k", F.lit("/99 : RUN p"), "l_partkey").alias("line")).union(n.where("l_returnflag = 'A'").select("doc", "k", F.lit(1), F.lit(" ---> Using cache")))
    return C.build_steps(_outputs(rows, ["k", "j"], B.tasks(spark, d, "lineitem"))).select("doc", F.row_number().over(W.partitionBy("doc").orderBy("pos")).cast("long").alias("step"), "instruction", "cached")


SQL_STEPS = "SELECT doc, step, 'RUN p' || l_partkey AS instruction, l_returnflag = 'A' AS cached FROM (SELECT l_orderkey % 300 AS doc, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey % 300 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS step FROM lineitem)"


def git_branches(spark: SparkSession, d: str) -> DataFrame:
    head = "CASE c_custkey % 4 WHEN 0 THEN concat('## main...origin/main [ahead ', c_custkey, ', behind 2]') WHEN 1 THEN concat('## f', c_custkey, '...origin/f') WHEN 2 THEN '## No commits yet on main' ELSE concat('## b', c_custkey, '...o/b [behind ', c_custkey, ']') END"
    return C.git_branch(B.table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.concat(F.expr(head), F.lit("\n M file.py\n?? x")).alias("text")))


SQL_BRANCHES = """SELECT c_custkey AS doc, CASE c_custkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'f' || c_custkey WHEN 2 THEN 'main' ELSE 'b' || c_custkey END AS branch, coalesce(CASE c_custkey % 4 WHEN 0 THEN 'origin/main' WHEN 1 THEN 'origin/f' WHEN 3 THEN 'o/b' END, '') AS upstream,
CASE c_custkey % 4 WHEN 0 THEN c_custkey ELSE 0 END AS ahead, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 3 THEN c_custkey ELSE 0 END AS behind FROM customer"""


def grep_json(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    event = F.to_json(F.struct(F.when(F.col("event_id") % 4 == 0, "begin").otherwise("match").alias("type"), F.struct(F.struct(F.concat(F.lit("f"), F.col("event_id") % 9).alias("text")).alias("path"), F.struct(F.concat("event_type", F.lit("  \n")).alias("text")).alias("lines"), F.col("event_id").alias("line_number"), F.array(F.struct((F.col("event_id") % 50).alias("start"))).alias("submatches")).alias("data")))
    return C.grep_json(_outputs(e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("k"), event.alias("line")), ["k"], B.tasks(spark, d, "events")))


SQL_JSON = """SELECT doc, path, line_no, col AS "column", text, matches FROM (SELECT user_id AS doc, 'f' || event_id % 9 AS path, event_id AS line_no, event_id % 50 + 1 AS col, event_type AS text, count(*) OVER (PARTITION BY user_id, event_id % 9) AS matches, row_number() OVER (PARTITION BY user_id, event_id % 9 ORDER BY event_id) AS k FROM events WHERE event_id % 4 <> 0) WHERE k <= 3"""


def plan_texts(spark: SparkSession, d: str) -> DataFrame:
    """Own times of plans in text form: an operator a line, deeper ones indented."""
    w = W.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    tasks = B.tasks(spark, d, "lineitem")
    n = B.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc").repartition(tasks, "doc").withColumn("k", F.row_number().over(w))
    line = "concat(repeat('  ', k % 3), '->  ', CASE l_returnflag WHEN 'R' THEN 'Seq Scan' WHEN 'A' THEN 'Hash Join' ELSE 'Index Scan' END, ' on t', l_partkey, '  (cost=0.00..', l_suppkey, '.50 rows=', l_partkey, ' width=8) (actual time=0.1..', cast(l_quantity as bigint), '.000 rows=', l_partkey * 20, ' loops=2)')"
    text = _outputs(n.select("doc", "k", F.expr(line).alias("line")), ["k"])
    own = C.self_times(C.plan_nodes(text), ["rows"], tasks)
    return own.select("plan", "pos", "op", F.round("self_ms", 3).alias("self_ms"), F.when(C.large_scan(), F.col("rows")).otherwise(0).alias("scanned"))


SQL_PLANS = """WITH n AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, CASE l_returnflag WHEN 'R' THEN 'Seq Scan' WHEN 'A' THEN 'Hash Join' ELSE 'Index Scan' END AS op, CAST(l_quantity AS BIGINT) * 2 AS t, l_partkey * 20 AS r FROM lineitem), m AS (SELECT *, k % 3 AS depth FROM n),
p AS (SELECT c.plan, c.k, any_value(c.t) AS t, max(u.k) AS parent FROM m c JOIN m u ON c.plan = u.plan AND u.k < c.k AND u.depth < c.depth GROUP BY c.plan, c.k), b AS (SELECT plan, parent, sum(t) AS below FROM p GROUP BY plan, parent)
SELECT m.plan, m.k - 1 AS pos, op, greatest(t - coalesce(below, 0), 0)::DOUBLE AS self_ms, CASE WHEN op = 'Seq Scan' AND r >= 1000 THEN r ELSE 0 END AS scanned FROM m LEFT JOIN b ON b.plan = m.plan AND b.parent = m.k"""


def diff_changes(spark: SparkSession, d: str) -> DataFrame:
    out = C.diff_changes(_diff(spark, d, 0), _diff(spark, d, 1))
    return out.select("doc", "file", "status", *(F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("added", "removed", "old_added", "old_removed")))


QUERIES = {
    "path_kinds": (path_kinds, SQL_PATHS),
    "substitutions": (substitutions, _sql_substitutions()),
    "digests": (digests, SQL_DIGESTS),
    "certificates": (certificates, SQL_CERTIFICATES),
    "stripped_texts": (stripped_texts, SQL_STRIPPED),
    "diff_changes": (diff_changes, SQL_DIFF_CHANGES),
    "failure_changes": (failure_changes, SQL_FAILURES),
    "line_changes": (line_changes, SQL_LINES),
    "containers": (containers, SQL_CONTAINERS),
    "build_steps": (build_steps, SQL_STEPS),
    "git_branches": (lambda s, d: git_branches(s, d).na.fill("", ["upstream"]), SQL_BRANCHES),
    "grep_json": (grep_json, SQL_JSON),
    "plan_texts": (plan_texts, SQL_PLANS),
}
