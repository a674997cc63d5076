"""Further reports: prices, plans, traces, gates, and the outputs of test runners and build tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import folds
from contextmill.operators.commands import carried, lines

#: USD per million tokens (input, output) by model.
PRICES = {
    "claude-opus-4-6": (15.0, 75.0), "claude-sonnet-4-6": (3.0, 15.0), "claude-haiku-4-5": (0.8, 4.0), "claude-3-haiku": (0.25, 1.25), "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4-turbo": (10.0, 30.0), "gpt-4.1": (2.0, 8.0),
    "gpt-4.1-mini": (0.4, 1.6), "o3": (10.0, 40.0), "o4-mini": (1.1, 4.4), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.3),
}
DEFAULT_MODEL = "gpt-4o"


def priced(models: DataFrame) -> DataFrame:
    """(model, price_of, input, output): the model's own price, else that of the longest name that it holds or is held by, else the default's."""
    dim = models.sparkSession.createDataFrame([(k, *v) for k, v in PRICES.items()], "price_of string, input double, output double")
    asked = models.select("model").distinct().withColumn("low", F.lower("model"))
    tried = asked.join(F.broadcast(dim), F.col("low").contains(F.col("price_of")) | F.col("price_of").contains(F.col("low")), "left")  # a fixed list of some tens
    place = F.struct((F.col("low") == F.col("price_of")).alias("exact"), F.length("price_of").alias("length"), F.col("price_of").alias("name"))
    best = tried.groupBy("model").agg(F.max_by(F.struct("price_of", "input", "output"), place).alias("p"))
    i, o = PRICES[DEFAULT_MODEL]
    return best.select("model", F.coalesce("p.price_of", F.lit(DEFAULT_MODEL)).alias("price_of"), F.coalesce("p.input", F.lit(i)).alias("input"), F.coalesce("p.output", F.lit(o)).alias("output"))


def clamped_budget(asked: Column, window: Column, reserve: Column) -> Column:
    """A budget held to the model's window less what is kept for its output."""
    return F.greatest(F.lit(0), F.least(asked, window - reserve)).cast("long")


def workflow_cost(steps: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """One row a workflow (workflow, step, total, output): input is total less output; least, most and mean cost of a step."""
    each = steps.withColumn("usd", S.usd(F.col("total") - F.col("output"), input_price) + S.usd(F.col("output"), output_price))
    return each.groupBy("workflow").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.col("total") - F.col("output")).alias("input_tokens"), F.sum("output").alias("output_tokens"), S.rounded(F.sum("usd"), 10).alias("usd"), S.rounded(F.min("usd"), 10).alias("least"), S.rounded(F.max("usd"), 10).alias("most"), S.rounded(F.avg("usd"), 10).alias("mean"))


def agent_plan(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """(step, path, shared, place): files of each step of a plan. ranked: step, path, rank.

    Candidates are the first limit + 2 of a step. Files that two steps and more have are shared; the first
    min(3, max(1, n // 3)) shared files of all go first, and each step is filled up to the limit.
    """
    able = ranked.where(F.col("rank") <= limit + 2)
    spread = able.groupBy("path").agg(F.count_distinct("step").alias("steps"), F.min("rank").alias("best")).where("steps >= 2")
    cap = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
    best = spread.orderBy(F.desc("steps"), "best", "path").limit(3)  # no more than three are ever taken
    placed = best.withColumn("k", F.row_number().over(W.orderBy(F.desc("steps"), "best", "path"))).crossJoin(F.broadcast(spread.agg(F.count(F.lit(1)).alias("n"))))
    shared = placed.where(F.col("k") <= cap).select("path", F.lit(True).alias("shared"))
    mine = able.join(shared, "path", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    mine = mine.withColumn("place", F.row_number().over(W.partitionBy("step").orderBy(F.desc("shared"), "rank", "path")))
    return mine.where(F.col("place") <= limit).select("step", "path", "shared", F.col("place").cast("long").alias("place"))


def pipeline_trace(entries: DataFrame) -> DataFrame:
    """Tokens into and out of each stage of each run, in one table: scan, rank, pack, cache."""
    sums = entries.groupBy("run").agg(F.sum("original").alias("scan"), F.sum(F.when(F.col("score") > 0, F.col("original")).otherwise(0)).alias("rank"), F.sum(F.when(F.col("score") > 0, F.col("compressed")).otherwise(0)).alias("pack"), F.sum(F.when((F.col("score") > 0) & (F.col("cache_status") != "reused"), F.col("compressed")).otherwise(0)).alias("cache"))
    rows = sums.select("run", "scan", F.expr("stack(3, 1, 'rank', scan, rank, 2, 'pack', rank, pack, 3, 'cache', pack, cache) AS (place, stage, tokens_in, tokens_out)"))
    return rows.select("run", "stage", F.col("place").cast("long").alias("place"), "tokens_in", "tokens_out", (F.col("tokens_in") - F.col("tokens_out")).alias("saved"), (F.col("scan") - F.col("tokens_out")).alias("cumulative_saved"))


def observed(runs: DataFrame) -> DataFrame:
    """One row: runs, tokens, and the mean files of a run."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum("input").alias("input_tokens"), F.sum("saved").alias("saved_tokens"), S.rounded(F.avg("n_files"), 4).alias("mean_files"))


def regression_gate(current: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """Keys whose reduction (key, reduction_pct) fell by more than the tolerance in points, or that are gone."""
    both = baseline.select("key", F.col("reduction_pct").alias("was")).join(current.select("key", F.col("reduction_pct").alias("now")), "key", "left")
    return both.where(F.col("now").isNull() | (F.col("was") - F.col("now") > tolerance)).select("key", "was", "now")


def transitions(calls: DataFrame) -> DataFrame:
    """(from_name, to_name, times): names of calls that follow each other in a session (session, turn, name)."""
    after = F.lead("name").over(W.partitionBy("session").orderBy("turn"))
    return calls.select(F.col("name").alias("from_name"), after.alias("to_name")).where("to_name is not null").groupBy("from_name", "to_name").agg(F.count(F.lit(1)).alias("times"))


def matching_paths(asked: DataFrame, packed: DataFrame) -> DataFrame:
    """(asked, path) where one path ends with the other, by their common last parts: no cross product.

    Every suffix of whole parts of either side is a key; a path has as many as it has parts.
    """
    parts = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    a, p = asked.select(F.col("path").alias("asked")).distinct(), packed.select("path").distinct()
    long_asked = a.select("asked", F.explode(parts(F.col("asked"))).alias("key")).join(p.withColumn("key", F.col("path")), "key").select("asked", "path")
    long_packed = p.select("path", F.explode(parts(F.col("path"))).alias("key")).join(a.withColumn("key", F.col("asked")), "key").select("asked", "path")
    return long_asked.union(long_packed).distinct()


def test_counts(outputs: DataFrame, runner: str) -> DataFrame:
    """(doc, passed, failed, skipped) of test runs, by the last summary of pytest, cargo and jest, and by result lines of go."""
    text, n = F.col("text"), lambda p, t: S.number(F.regexp_extract(t, p, 1))
    last = lambda p: F.coalesce(F.try_element_at(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(p)), F.lit(-1)), F.lit(""))
    if runner == "go":
        count = lambda word: F.regexp_count(text, F.lit(rf"(?m)^--- {word}: ")).cast("long")
        cells = [count("PASS"), count("FAIL"), count("SKIP")]
    else:
        foot = F.when(F.size(F.split("text", "\n")) > 0, {"pytest": last(r"^=+ .*\b(?:passed|failed|error|skipped)\b.* =+$"), "cargo": last("^test result:"), "jest": last(r"^Tests:\s")}[runner])
        cells = [n(r"(\d+) passed", foot), n(r"(\d+) failed", foot), n(r"(\d+) (?:skipped|ignored|todo)", foot)]
    return outputs.select("doc", *[c.cast("long").alias(k) for c, k in zip(cells, ("passed", "failed", "skipped"), strict=True)])


def test_failures(outputs: DataFrame, runner: str) -> DataFrame:
    """(doc, name, file, message) of failed tests. Lines below a failure belong to it until the next one."""
    heads = {"pytest": r"^FAILED ([^\s:]+::\S+)", "cargo": r"^---- (\S+) stdout ----$", "go": r"^--- FAIL: (\S+)", "jest": r"^\s*● (.+)$"}
    rows = lines(outputs)
    if runner == "pytest":
        out = rows.select("doc", F.regexp_extract("line", heads["pytest"], 1).alias("name"), F.regexp_extract("line", r"^FAILED \S+ - (.*)$", 1).alias("message")).where("name <> ''")
        return out.groupBy("doc", "name").agg(F.max("message").alias("message")).select("doc", "name", F.substring_index("name", "::", 1).alias("file"), "message")
    rows = carried(rows, F.nullif(F.regexp_extract("line", heads[runner], 1), F.lit("")), "name")
    if runner == "jest":
        rows = carried(rows, F.nullif(F.regexp_extract("line", r"^FAIL (\S+)", 1), F.lit("")), "file")
        place = F.min_by("file", "pos")
    else:
        place = F.min_by(F.nullif(F.regexp_extract("line", r"(\S+\.(?:rs|go)):\d+", 1), F.lit("")), F.when(F.col("line").rlike(r"\S+\.(?:rs|go):\d+"), F.col("pos")))
    body = F.when((F.trim("line") != "") & ~F.col("line").rlike(heads[runner]), F.col("pos"))
    return rows.where("name is not null").groupBy("doc", "name").agg(place.alias("file"), F.trim(F.min_by("line", body)).alias("message"))


def failure_blocks(outputs: DataFrame) -> DataFrame:
    """(doc, name, file, line, message) of the FAILURES and ERRORS sections of pytest: a block begins at its name between
    underscores and ends with the next one or the section. The message is its lines marked E, the place its first location."""
    section = F.when(F.col("line").rlike(r"^=+ (?:FAILURES|ERRORS) =+\s*$"), True).when(F.col("line").rlike(r"^=+ .* =+\s*$"), False)
    rows = carried(lines(outputs), section, "inside").where("inside")
    head = F.nullif(F.trim(F.regexp_extract("line", r"^_{2,} (.+?) _{2,}\s*$", 1)), F.lit(""))
    rows = carried(rows, head, "name").where(F.col("name").isNotNull() & head.isNull())
    place = r"^(\S+?):(\d+): "
    at = F.when(F.col("line").rlike(place), F.col("pos"))
    told = F.when(F.col("line").rlike(r"^\s*E(?:\s|$)"), F.struct("pos", F.trim(F.regexp_extract("line", r"^\s*E\s*(.*)$", 1)).alias("text")))
    message = F.array_join(F.sort_array(F.collect_list(told))["text"], "\n")
    found = F.min_by(F.struct(F.regexp_extract("line", place, 1).alias("file"), F.regexp_extract("line", place, 2).cast("long").alias("line")), at)
    return rows.groupBy("doc", "name").agg(found.alias("at"), message.alias("message")).select("doc", "name", "at.file", "at.line", "message")


def merged_failures(outputs: DataFrame) -> DataFrame:
    """(doc, name, file, line, message): failure blocks and the short summary as one, by the test's own name.

    A block's name ends with the test's after a point, the summary's after colons. What only one of them has stays; the
    block's message and place come first.
    """
    own = lambda c: F.regexp_extract(c, r"([^.:]+(?:\[.*\])?)$", 1)
    blocks = failure_blocks(outputs).select("doc", own("name").alias("test"), F.col("name").alias("block"), F.col("file").alias("block_file"), "line", F.col("message").alias("block_message"))
    short = test_failures(outputs, "pytest").select("doc", own("name").alias("test"), "name", "file", "message")
    both = blocks.join(short, ["doc", "test"], "full_outer")
    return both.select("doc", F.coalesce("name", "block").alias("name"), F.coalesce("block_file", "file").alias("file"), "line", F.coalesce(F.nullif("block_message", F.lit("")), "message").alias("message"))


def ls_entries(outputs: DataFrame) -> DataFrame:
    """(doc, pos, path, kind, size) of ls output: long lines, names alone, and folders' headers, which hold until a blank line."""
    long = r"^([-dlcbps])[-rwxstST]{9}\S*\s+\S+\s+\S+\s+\S+\s+(\d+)\s+\S+\s+\S+\s+\S+\s+(.+)$"
    part = lambda k: F.nullif(F.regexp_extract("line", long, k), F.lit(""))
    header = ~F.col("line").rlike(long) & F.col("line").rlike(r"^[^:]+:$")
    rows = lines(outputs).withColumn("line", F.rtrim("line"))
    rows = carried(rows, F.when(header, F.regexp_replace("line", r"/*:$", "")).when(F.col("line") == "", F.lit("")), "folder").where((F.col("line") != "") & ~header & ~F.col("line").startswith("total "))
    kind = F.when(part(1) == "d", "dir").when(part(1) == "l", "link").when(part(1).isNotNull(), "file")
    names = F.when(kind.isNotNull(), F.array(part(3))).otherwise(F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    each = rows.select("doc", "pos", "folder", kind.alias("kind"), part(2).cast("long").alias("size"), F.explode(names).alias("name"))
    bare = F.regexp_replace("name", "/+$", "")
    path = F.when(F.coalesce("folder", F.lit("")) == "", bare).otherwise(F.concat("folder", F.lit("/"), bare))
    return each.select("doc", "pos", path.alias("path"), F.coalesce("kind", F.when(F.col("name").endswith("/"), "dir").otherwise("file")).alias("kind"), "size")


def top_folders(entries: DataFrame, folders: int = 30, names: int = 8) -> DataFrame:
    """(doc, folder, entries, names): the folders of each listing (doc, path) with most entries, and the first names of each."""
    split = entries.select("doc", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    first = split.withColumn("k", F.row_number().over(W.partitionBy("doc", "folder").orderBy("name")))
    each = first.groupBy("doc", "folder").agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= names, F.col("name")))), ",").alias("names"))
    return each.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("entries"), "folder"))).where(F.col("k") <= folders).drop("k")


def tree_paths(outputs: DataFrame) -> DataFrame:
    """(doc, pos, path, depth) of tree listings: names under the open folders, which a stack along the lines holds.

    Four columns of drawing are a level; a line that begins with a point is the root, and the line of totals ends the listing.
    """

    def step(state: dict, row: tuple) -> tuple | None:
        pos, name, level, ends = row
        if ends or state["over"]:
            state["over"] = True
            return None
        if name.startswith(".") and not level:
            state["open"] = []
            return None
        above = max(0, level - 1)
        state["open"][above:] = [*[""] * (above - len(state["open"])), name]
        return pos, "/".join(x for x in state["open"] if x), level

    lead = r"^((?:[│|`  ]{4})*(?:[├└|`][─-]{2}[  ])?)"
    ends = F.col("line").rlike(r"\d+ director(?:y|ies), \d+ files?")
    rows = lines(outputs).where(F.trim("line") != "").select("doc", F.col("pos").cast("long").alias("pos"), F.regexp_replace(F.rtrim(F.regexp_replace("line", lead, "")), "/+$", "").alias("name"), F.floor(F.length(F.regexp_extract("line", lead, 1)) / 4).alias("level"), ends.alias("ends"))
    return folds.ordered_fold(rows, ["doc"], ["pos"], lambda: {"open": [], "over": False}, step, "pos long, path string, depth long")


def package_operations(outputs: DataFrame) -> DataFrame:
    """(doc, operation, packages): packages that installers added, removed or updated; a line of totals counts as its number."""
    rows = lines(outputs)
    total = F.regexp_extract("line", r"^(added|removed|changed|updated) (\d+) packages?", 1)
    named = F.when(F.col("line").rlike(r"^(?:\+ |Installing |\s+Compiling |Collecting )\S+"), "added").when(F.col("line").rlike(r"^(?:- |Removing |Uninstalling )\S+"), "removed").when(F.col("line").rlike(r"^(?:~ |Updating )\S+"), "updated")
    listed = F.when(F.col("line").startswith("Successfully installed "), F.size(F.split("line", " ")) - 2)
    operation = F.when(total != "", F.when(total == "changed", "updated").otherwise(total)).when(listed.isNotNull(), "added").otherwise(named)
    n = F.when(total != "", S.number(F.regexp_extract("line", r"^\w+ (\d+) packages?", 1))).when(listed.isNotNull(), listed).otherwise(1)
    return rows.select("doc", operation.alias("operation"), n.cast("long").alias("n")).where("operation is not null").groupBy("doc", "operation").agg(F.sum("n").alias("packages"))


def resource_states(outputs: DataFrame) -> DataFrame:
    """(doc, status, resources) of tables with a header that names a STATUS column, by the header's place of it."""
    rows = carried(lines(outputs), F.when(F.col("line").rlike(r"^NAME\s+.*\bSTATUS\b"), F.col("line")), "header").where("header is not null and line <> header and trim(line) <> ''")
    at = F.array_position(F.split("header", r"\s{2,}|\t"), "STATUS").cast("int")
    return rows.select("doc", F.get(F.split("line", r"\s{2,}|\t"), at - 1).alias("status")).where("status is not null").groupBy("doc", "status").agg(F.count(F.lit(1)).alias("resources"))


def bundle_modules(stats: DataFrame, top: int = 10) -> DataFrame:
    """(doc, name, bytes): the largest modules of bundler statistics (doc, text: JSON with modules or inputs)."""
    parsed = stats.select("doc", F.from_json("text", "struct<modules:array<struct<name:string,size:bigint>>,inputs:map<string,struct<bytes:bigint>>>").alias("j"))
    web = parsed.select("doc", F.explode("j.modules").alias("m")).select("doc", "m.name", F.col("m.size").alias("bytes"))
    es = parsed.select("doc", F.explode("j.inputs").alias("name", "v")).select("doc", "name", F.col("v.bytes").alias("bytes"))
    w = W.partitionBy("doc").orderBy(F.desc("bytes"), "name")
    return web.union(es).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("doc", "name", "bytes")


def tree_depths(outputs: DataFrame) -> DataFrame:
    """(doc, depth, entries) of tree listings, four columns of drawing a level."""
    rows = lines(outputs).select("doc", F.regexp_extract("line", r"^((?:[│|`  ][  ]{2,3})*[├└|`][─-]{2} )", 1).alias("lead")).where("lead <> ''")
    return rows.groupBy("doc", F.floor(F.length("lead") / 4).alias("depth")).agg(F.count(F.lit(1)).alias("entries"))


def quality_floors(results: DataFrame) -> DataFrame:
    """Results (key, level, raw, compressed) below their level's floor, for inputs of 80 tokens and more."""
    floor = F.when(F.col("level") == "verbose", -10.0).when(F.col("level") == "compact", 30.0).otherwise(70.0)
    pct = S.rounded(S.reduction_pct(F.col("raw"), F.col("compressed")), 4)
    return results.where("raw >= 80").withColumn("reduction_pct", pct).where(pct < floor).select("key", "level", "reduction_pct")
