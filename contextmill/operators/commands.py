"""Command output as typed rows: one row a line with its place, parsed by expressions, then aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import folds

#: Severity order of log levels.
LEVELS = ("fatal", "error", "warn", "warning", "info", "debug", "trace")


def lines(outputs: DataFrame) -> DataFrame:
    """(doc, pos, line) of outputs (doc, text)."""
    return outputs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def carried(rows: DataFrame, value, name: str) -> DataFrame:
    """The last value that is not null up to each line of a document."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))


def git_diff(outputs: DataFrame) -> DataFrame:
    """(doc, file, added, removed, hunks) of unified diffs."""
    rows = carried(lines(outputs), F.nullif(F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1), F.lit("")), "file").where("file is not null")
    plus, minus = F.col("line").startswith("+") & ~F.col("line").startswith("+++"), F.col("line").startswith("-") & ~F.col("line").startswith("---")
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return rows.groupBy("doc", "file").agg(n(plus).alias("added"), n(minus).alias("removed"), n(F.col("line").startswith("@@")).alias("hunks"))


def git_status(outputs: DataFrame) -> DataFrame:
    """(doc, state, files) of short status lines: two letters, a blank and a path."""
    rows = lines(outputs).select("doc", F.regexp_extract("line", r"^([ MADRCU?!]{2}) (.+)$", 1).alias("code")).where("code <> ''")
    state = F.when(F.col("code") == "??", "untracked").when(F.col("code").contains("U"), "conflicted").when(F.substring("code", 1, 1) != " ", "staged").otherwise("unstaged")
    return rows.groupBy("doc", state.alias("state")).agg(F.count(F.lit(1)).alias("files"))


def git_branch(outputs: DataFrame) -> DataFrame:
    """(doc, branch, upstream, ahead, behind) of the header line of short status output, one row a doc that has it."""
    head = r"^## (?:No commits yet on )?(.+?)(?:\.\.\.(\S+))?(?: \[(.*)\])?$"
    rows = lines(outputs).where(F.col("line").startswith("## "))
    rows = rows.select("doc", "pos", *[F.nullif(F.regexp_extract("line", head, i), F.lit("")).alias(n) for i, n in ((1, "branch"), (2, "upstream"), (3, "tracking"))])
    count = lambda word: S.number(F.nullif(F.regexp_extract("tracking", rf"{word} (\d+)", 1), F.lit("")))
    return rows.groupBy("doc").agg(*[F.max_by(c, "pos").alias(c) for c in ("branch", "upstream", "tracking")]).select("doc", "branch", "upstream", count("ahead").alias("ahead"), count("behind").alias("behind"))


def diff_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, file, status, added, removed, old_added, old_removed): files of two diffs (``git_diff``) that are new, gone or have other counts."""
    b = before.select("doc", "file", F.col("added").alias("old_added"), F.col("removed").alias("old_removed"))
    both = after.select("doc", "file", "added", "removed").join(b, ["doc", "file"], "full_outer")
    status = F.when(F.col("old_added").isNull(), "new").when(F.col("added").isNull(), "gone").otherwise("updated")
    return both.withColumn("status", status).where("status <> 'updated' or added <> old_added or removed <> old_removed").select("doc", "file", "status", "added", "removed", "old_added", "old_removed")


def failure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, name, change): failures (doc, name) that are new or resolved."""
    new = after.select("doc", "name").distinct().join(before, ["doc", "name"], "left_anti").withColumn("change", F.lit("new"))
    return new.union(before.select("doc", "name").distinct().join(after, ["doc", "name"], "left_anti").withColumn("change", F.lit("resolved")))


def line_changes(before: DataFrame, after: DataFrame, most: int = 30) -> DataFrame:
    """(doc, side, pos, line): the first lines (``lines``) of each side that the other lacks; repeated ones all count."""
    def only(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        rows = x.join(y.select("doc", "line").distinct(), ["doc", "line"], "left_anti")
        return rows.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy("pos"))).where(F.col("k") <= most).select("doc", F.lit(side).alias("side"), "pos", "line")

    return only(after, before, "+").union(only(before, after, "-"))


def git_log(outputs: DataFrame) -> DataFrame:
    """(doc, commit, author, subject) of full logs."""
    rows = carried(lines(outputs), F.nullif(F.regexp_extract("line", r"^commit ([0-9a-f]{7,40})", 1), F.lit("")), "commit").where("commit is not null")
    subject = F.when(F.col("line").startswith("    "), F.trim("line"))
    return rows.groupBy("doc", "commit").agg(F.max(F.nullif(F.regexp_extract("line", r"^Author: (.*?)(?: <.*)?$", 1), F.lit(""))).alias("author"), F.min_by(subject, F.when(subject.isNotNull() & (subject != ""), F.col("pos"))).alias("subject"))


def grep(outputs: DataFrame, per_file: int = 3) -> DataFrame:
    """(doc, path, line_no, text, matches) of path:line:text rows, the first few of each file."""
    p = r"^([^:\n]+):(\d+):(.*)$"
    rows = lines(outputs).select("doc", "pos", *[F.regexp_extract("line", p, i).alias(n) for i, n in ((1, "path"), (2, "line_no"), (3, "text"))]).where("path <> ''")
    w = W.partitionBy("doc", "path")
    rows = rows.withColumn("matches", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("pos"))).where(F.col("k") <= per_file)
    return rows.select("doc", "path", F.col("line_no").cast("long").alias("line_no"), "text", "matches")


def grep_json(outputs: DataFrame, per_file: int = 3) -> DataFrame:
    """(doc, path, line_no, column, text, matches) of match events in JSON lines, the first few of each file."""
    get = lambda k: F.get_json_object("line", k)
    rows = lines(outputs).where(get("$.type") == "match").select("doc", "pos", get("$.data.path.text").alias("path"), get("$.data.line_number").try_cast("long").alias("line_no"), (get("$.data.submatches[0].start").try_cast("long") + 1).alias("column"), F.rtrim(F.regexp_replace(get("$.data.lines.text"), r"\n+$", "")).alias("text"))
    rows = rows.where("path is not null and line_no is not null and text is not null")
    w = W.partitionBy("doc", "path")
    rows = rows.withColumn("matches", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("pos"))).where(F.col("k") <= per_file)
    return rows.select("doc", "path", "line_no", "column", "text", "matches")


def containers(outputs: DataFrame) -> DataFrame:
    """(doc, container, image, age, status, ports, name, running) of fixed-width container lists.

    Columns begin where the header's names do, which two blanks and more separate; rows with fewer than six are left out.
    """
    rows = outputs.select("doc", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.get("lines", F.lit(0)).rlike(r"^CONTAINER ID\s+IMAGE"))
    heads = F.regexp_extract_all(F.get("lines", F.lit(0)), F.lit(r"(\S+(?: \S+)*(?:\s{2,}|\s*$))"), F.lit(1))
    starts = F.aggregate(heads, F.array(F.lit(1)), lambda s, h: F.concat(s, F.array(F.element_at(s, -1) + F.length(h))))
    rows = rows.select("doc", starts.alias("starts"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line"))
    n = F.size("starts") - 1
    cut = lambda i: F.trim(F.col("line").substr(F.get("starts", i), F.when(i == n - 1, F.length("line")).otherwise(F.get("starts", i + 1) - F.get("starts", i))))
    cells = F.transform(F.sequence(F.lit(0), n - 1), cut)
    cell = lambda i: F.get("cells", F.lit(i))
    out = rows.withColumn("cells", cells).where("size(cells) >= 6")
    ports = F.array_join(F.filter(F.transform(F.split(cell(5), ","), lambda p: F.trim(p)), lambda p: p != ""), ",")
    return out.select("doc", F.substring(cell(0), 1, 12).alias("container"), cell(1).alias("image"), cell(3).alias("age"), cell(4).alias("status"), ports.alias("ports"), F.element_at("cells", -1).alias("name"), cell(4).startswith("Up").alias("running"))


def build_steps(outputs: DataFrame) -> DataFrame:
    """(doc, pos, instruction, cached, seconds) of image builds in either form; a step counts as cached if a later line says so before the next step."""
    old, new = r"^Step \d+/\d+\s*:\s*(.*)$", r"^\s*(?:#\d*)?\s*(?:=>\s+)?(?:CACHED\s+)?\[(?:\S+\s+)?\d+/\d+\]\s*(.*?)\s+(\d+\.\d+)s\s*$"
    get = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    rows = lines(outputs).withColumn("step", F.coalesce(get(old, 1), get(new, 1)))
    rows = rows.withColumn("k", F.sum(F.col("step").isNotNull().cast("int")).over(W.partitionBy("doc").orderBy("pos"))).where("k > 0")
    hit = F.col("line").contains("---> Using cache") | (get(new, 1).isNotNull() & F.col("line").contains("CACHED"))
    return rows.groupBy("doc", "k").agg(F.min("pos").alias("pos"), F.max("step").alias("instruction"), F.max(hit.cast("int")).alias("hit"), F.max(get(new, 2).try_cast("double")).alias("seconds")).select("doc", "pos", "instruction", (F.col("hit") == 1).alias("cached"), "seconds")


def build_result(outputs: DataFrame) -> DataFrame:
    """(doc, image, tags, success, errors, warnings) of image builds: what failed is no success."""
    n = lambda c: F.count_if(c)
    got = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    image = F.coalesce(got(r"Successfully built\s+([0-9a-f]{6,64})"), got(r"writing image\s+sha256:([0-9a-f]{12,64})"))
    tag = F.coalesce(got(r"Successfully tagged\s+(\S+)"), got(r"naming to\s+(\S+)"))
    done = F.col("line").rlike(r"Successfully built\s+[0-9a-f]{6,64}") | F.col("line").rlike(r"\[\+\]\s+Building\s+\d+\.\d+s\s+\(\d+/\d+\)\s+FINISHED")
    failed = F.col("line").rlike(r"(?i)\[\+\]\s+Building.*\bFAILED\b")
    out = lines(outputs).groupBy("doc").agg(F.substring(F.min_by(image, F.when(image.isNotNull(), F.col("pos"))), 1, 12).alias("image"), F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"), n(done).alias("done"), n(failed).alias("failed"), n(F.col("line").rlike(r"(?i)^error:\s*.")).alias("errors"), n(F.col("line").rlike(r"(?i)^warn(?:ing)?:\s*.")).alias("warnings"))
    return out.select("doc", "image", "tags", ((F.col("done") > 0) & (F.col("failed") == 0)).alias("success"), "errors", "warnings")


def listing(paths: DataFrame) -> DataFrame:
    """(folder, extension, files) of path rows."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(name.rlike(r"[^.]\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1)).otherwise("")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return paths.groupBy(folder.alias("folder"), extension.alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def lint(outputs: DataFrame) -> DataFrame:
    """(doc, pos, path, line_no, severity, code, message) of path:line:col: CODE message or path:line: severity: message [code] lines."""
    ruff, mypy = r"^([^:\n]+):(\d+):\d+: ([A-Z]+\d+) (.*)$", r"^([^:\n]+):(\d+)(?::\d+)?: (error|warning|note): (.*?)(?:\s+\[([\w-]+)\])?$"
    get = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    rows = lines(outputs).select("doc", "pos", F.coalesce(get(ruff, 1), get(mypy, 1)).alias("path"), F.coalesce(get(ruff, 2), get(mypy, 2)).cast("long").alias("line_no"), F.coalesce(F.when(get(ruff, 3).isNotNull(), "error"), get(mypy, 3)).alias("severity"), F.coalesce(get(ruff, 3), get(mypy, 5)).alias("code"), F.coalesce(get(ruff, 4), get(mypy, 4)).alias("message"))
    return rows.where("path is not null")


def lint_rules(issues: DataFrame, top: int = 12) -> DataFrame:
    """(code, issues, files, first): rules by number of issues, ties by first place, each with its first issue's path."""
    at = F.struct("doc", "pos")
    rules = issues.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("path").alias("files"), F.min(at).alias("at"), F.min_by("path", at).alias("first"))
    return rules.orderBy(F.desc("issues"), "at").limit(top).select("code", "issues", "files", "first")


def kube_events(events: DataFrame) -> DataFrame:
    """Groups of (type, reason, object): summed counts, first masked message, last time seen. events: pos, count, message, seen."""
    return events.groupBy("type", "reason", "object").agg(F.sum("count").alias("count"), F.min_by(S.masked(F.col("message"), S.EVENT_MASKS), "pos").alias("message"), F.max_by(F.col("seen"), F.when(F.coalesce("seen", F.lit("")) != "", F.col("pos"))).alias("last_seen"))


def stacks(samples: DataFrame) -> DataFrame:
    """(stack, samples, depth, share) of collapsed stacks (stack, n)."""
    sums = samples.groupBy("stack").agg(F.sum("n").cast("long").alias("samples"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("samples").alias("all")))).select("stack", "samples", F.size(F.split("stack", ";")).cast("long").alias("depth"), S.rounded(100 * F.col("samples") / F.col("all"), 4).alias("share"))


def log_keys(records: DataFrame, share: float = 0.8) -> DataFrame:
    """(key, records, place) of keys in at least so many JSON objects, in order of first appearance. records: i, line."""
    keyed = records.select("i", F.json_object_keys("line").alias("keys")).where("keys is not null")
    need = keyed.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("need"))
    each = keyed.select("i", F.posexplode("keys").alias("k", "key")).groupBy("key").agg(F.count_distinct("i").alias("records"), F.min(F.struct("i", "k")).alias("at"))
    kept = each.crossJoin(F.broadcast(need)).where("records >= need")
    return kept.select("key", "records", F.row_number().over(W.orderBy("at")).cast("long").alias("place"))  # some tens of keys


# fixed values: the keys that hold a record's level, the first that is there counts, and levels from the most severe on
LEVEL_KEYS = ("level", "lvl", "severity", "@level", "log.level")
LEVELS = ("fatal", "error", "warn", "warning", "info", "debug", "trace")


def _log_level() -> Column:
    return F.lower(F.coalesce(*[F.get_json_object("line", f"$['{k}']") for k in LEVEL_KEYS], F.lit("none")))


def log_levels(records: DataFrame) -> DataFrame:
    """(level, records) of lines (i, line), other levels as they are, without one ``none``."""
    return records.groupBy(_log_level().alias("level")).agg(F.count(F.lit(1)).alias("records"))


def log_rows(records: DataFrame, most: int = 30, outliers: int = 8, share: float = 0.8, width: int = 200) -> DataFrame:
    """(kind, place, i, level, line) of the report on lines (i, line): the most severe records, the latest first, and the first lines that are none.

    A record is a JSON object with every key of ``log_keys``; other levels, and none, come after the known ones. Outliers are
    first the lines that are no object, then objects that lack a key; without any common key all objects are outliers
    and other lines are left out. Null and blank lines are no lines. Lines are cut to ``width`` characters, the last three of
    them points. The limits are the report's: each task passes on its own first rows, and no record is sorted twice.
    """
    lines = records.select("i", F.trim("line").alias("line")).where("line <> ''")
    common = log_keys(lines, share).agg(F.collect_list("key").alias("common"))  # one row of some tens of keys
    parted = lines.withColumn("keys", F.json_object_keys("line")).crossJoin(F.broadcast(common))
    whole = F.col("keys").isNotNull() & (F.size("common") > 0) & (F.size(F.array_except("common", "keys")) == 0)
    level = _log_level()
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0))
    rank = F.when(rank == 0, 99).otherwise(rank)
    clipped = F.when(F.length("line") > width, F.concat(F.substring("line", 1, width - 3), F.lit("..."))).otherwise(F.col("line"))
    rows = parted.select("i", F.when(F.col("keys").isNotNull(), level).alias("level"), clipped.alias("line"), rank.alias("rank"), F.coalesce(whole, F.lit(False)).alias("whole"), F.col("keys").isNotNull().alias("object"), (F.size("common") > 0).alias("any"))
    body = rows.where("whole").orderBy("rank", F.desc("i")).limit(most).withColumn("place", F.row_number().over(W.orderBy("rank", F.desc("i"))))
    rest = rows.where("not whole and (any or object)").orderBy("object", "i").limit(outliers).withColumn("place", F.row_number().over(W.orderBy("object", "i")))
    out = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), "i", "level", "line")
    return out(body, "record").unionByName(out(rest, "outlier"))


def coverage(rows: DataFrame) -> DataFrame:
    """(path, statements, missed, pct) of rows (path, statements, missed)."""
    sums = rows.groupBy("path").agg(F.sum("statements").cast("long").alias("statements"), F.sum("missed").cast("long").alias("missed"))
    return sums.withColumn("pct", F.when(F.col("statements") == 0, 100.0).otherwise(S.rounded(100 * (1 - F.col("missed") / F.col("statements")), 2)))


def coverage_delta(before: DataFrame, after: DataFrame, least: float = 0.5, top: int = 12) -> DataFrame:
    """Files that are new, gone, or moved by half a point and more, the largest moves first."""
    b, a = before.select("path", F.col("pct").alias("before")), after.select("path", F.col("pct").alias("after"))
    both = b.join(a, "path", "full_outer").withColumn("change", S.rounded(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 2))
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("moved")
    return both.withColumn("status", status).where((F.col("status") != "moved") | (F.abs("change") >= least)).orderBy(F.desc(F.abs("change")), "path").limit(top).select("path", "status", "change")


def plan_nodes(outputs: DataFrame) -> DataFrame:
    """(plan, pos, depth, op, relation, cost, rows_estimated, ms, rows, loops) of plans (doc, text) in text form.

    Both forms have a node a line: an indent with an arrow, the operator, its cost and rows, and with actual times the total
    and how often it ran. The depth of a node is its indent.
    """
    plain = r"^(\s*)(?:->\s*)?([A-Z][A-Za-z][\w \-/]*?)(?:\s+(?:on|using)\s+(\S+).*?)?\s*\(cost=[\d.]+\.\.([\d.]+)\s+rows=(\d+)[^)]*\)(?:\s*\(actual time=[\d.]+\.\.([\d.]+)\s+rows=(\d+)\s+loops=(\d+)\))?"
    tree = r"^(\s*)(?:->\s*)?([A-Z][A-Za-z][\w \-/]*?)(?:\s+(?:on|using)\s+(\S+).*?)?\s*\(cost=([\d.]+)\s+rows=(\d+)\)(?:\s*\(actual time=(?:[\d.]+\.\.)?([\d.]+)\s+rows=(\d+)\s+loops=(\d+)\))?"
    # each pattern is met once a line: its groups become lines of their own, which no group has within it
    cells = lambda p: F.split(F.regexp_replace("line", p + r"[\s\S]*", "$2\n$3\n$4\n$5\n$6\n$7\n$8"), "\n")
    whole = (F.size("plain") == 7) & ~F.array_contains("plain", "")
    rows = lines(outputs).withColumn("plain", cells(plain)).withColumn("tree", F.when(~whole, cells(tree)))
    cell = lambda c, i: F.when(F.size(c) == 7, F.nullif(F.get(c, F.lit(i - 2)), F.lit("")))
    rows = rows.select("doc", "pos", "line", *[F.coalesce(cell("plain", i), cell("tree", i)).alias(f"c{i}") for i in range(2, 9)])
    return rows.where("c2 is not null").select(
        F.col("doc").alias("plan"), "pos", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("depth"), F.trim("c2").alias("op"), F.col("c3").alias("relation"), F.col("c4").try_cast("double").alias("cost"), F.col("c5").try_cast("long").alias("rows_estimated"),
        F.col("c6").try_cast("double").alias("ms"), F.col("c7").try_cast("long").alias("rows"), F.col("c8").try_cast("long").alias("loops"),
    )


def large_scan(least: int = 1000) -> Column:
    """Whether a node (op, rows) is a whole scan of a table that gave so many rows; null if its rows are not known."""
    return F.lower("op").rlike(r"^(?:parallel )?(?:seq|table|full) scan") & (F.col("rows") >= least)


def plan_warnings(nodes: DataFrame, least: int = 1000) -> DataFrame:
    """(plan, pos, relation, rows): whole scans of tables that gave so many rows."""
    return nodes.where(large_scan(least)).select("plan", "pos", F.coalesce("relation", F.lit("<unknown>")).alias("relation"), "rows")


def self_times(nodes: DataFrame, kept: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Own time of plan nodes (plan, pos, depth, op, ms, loops): total less the children's, not below 0; kept columns follow.

    A node's parent is the nearest earlier one of smaller depth. So from the last node to the first, an ordered fold keeps
    the times of those that have no parent yet, by depth: the next node takes all the deeper ones. One exchange by plan is all.
    """

    def step(open_: list[tuple], row: tuple) -> tuple:
        pos, depth, op, total, *rest = row
        below = 0
        while open_ and open_[-1][0] > depth:
            below += open_.pop()[1]
        mine = total if total is not None else 0
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, open_[-1][1] + mine)
        else:
            open_.append((depth, mine))
        return pos, op, max(mine - below, 0) if total is not None else 0, *rest

    n = nodes.select("plan", F.col("pos").cast("long").alias("pos"), F.col("depth").cast("long").alias("depth"), "op", (F.col("ms") * F.col("loops")).alias("total"), *(kept or []))
    kind = n.schema["total"].dataType.simpleString()
    kind = "bigint" if kind in ("tinyint", "smallint", "int") else kind
    out = ", ".join(["pos long", "op string", f"self_ms {kind}", *(f"{c} {n.schema[c].dataType.simpleString()}" for c in kept or [])])
    return folds.ordered_fold(n, ["plan"], [F.desc("pos")], list, step, out, tasks)


def skeletons(items: DataFrame, rules: list[tuple[str, str]] = S.TRACE_MASKS) -> DataFrame:
    """(skeleton, items, first): lines with the same masked text, in order of first appearance. items: pos, line."""
    return items.groupBy(S.masked(F.col("line"), rules).alias("skeleton")).agg(F.count(F.lit(1)).alias("items"), F.min("pos").alias("first"))


def passthrough(outputs: DataFrame, cap: int) -> DataFrame:
    """Text of a command that no parser knows, cut at four characters a token."""
    return outputs.select("doc", F.substring("text", 1, 4 * cap).alias("text"), (F.length("text") > 4 * cap).alias("truncated"))


def tail(outputs: DataFrame, n: int = 30) -> DataFrame:
    """The last lines of an output that is too large to parse."""
    all_lines = F.split("text", "\n")
    return outputs.select("doc", F.size(all_lines).cast("long").alias("lines"), F.array_join(F.slice(all_lines, F.greatest(F.size(all_lines) - n + 1, F.lit(1)), F.lit(n)), "\n").alias("tail"))
