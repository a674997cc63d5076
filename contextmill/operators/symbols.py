"""Symbols of source texts: top-level functions and classes with their lines, scored against a task and chosen under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.operators import folds

#: Weights of symbol types, of a keyword, and of what others can use; symbols below the bar keep their first line only.
TYPE_WEIGHTS = {"function": 2.2, "class": 2.1, "interface": 2.0, "type": 1.9}
KEYWORD_WEIGHT, EXPORT_WEIGHT, STUB_BELOW = 1.75, 0.6, 3.5
#: Opening lines of symbols by language: Python, scripts, Go. Groups: type word, name.
OPENINGS = {
    "python": (r"\.py$", r"^(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", r"^[A-Za-z]"),
    "script": (r"\.(?:tsx?|jsx?|mjs|cjs)$", r"^(?:export\s+)?(?:default\s+)?(?:async\s+|abstract\s+)*(function|class|interface|type)\s*\*?\s+([A-Za-z_$][\w$]*)", r"^export\b"),
    "go": (r"\.go$", r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^(?:func|type)\s+(?:\([^)]*\)\s*)?[A-Z]"),
}


def candidates(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, start, end, type, name, exported, score): top-level symbols of files (path, text), lines from 1.

    A symbol begins at its opening line, or at comments and decorators right above it, and goes on to the last line that is
    not blank before the next line without indent (but for closing brackets). Texts of other languages have none. Found
    by expressions on lines, without a parser: what stands in long strings counts as code.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    opening = lambda g: F.coalesce(*[F.when(F.col("path").rlike(ext), F.nullif(F.regexp_extract("line", p, g), F.lit(""))) for ext, p, _ in OPENINGS.values()])
    rows = lines.withColumn("word", opening(1)).withColumn("name", opening(2))
    lead = F.col("line").rlike(r"^(?:@|#|//)")
    flat = F.col("line").rlike(r"^[^\s)\]}]")
    w = W.partitionBy("path").orderBy("pos")
    # a block is a line without indent and all below it; leading comments belong to the block that they end at
    rows = rows.withColumn("lead", lead).withColumn("cut", (flat & ~(F.coalesce(F.lag(lead).over(w), F.lit(False)))).cast("int"))
    rows = rows.withColumn("block", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    exported = F.coalesce(*[F.when(F.col("path").rlike(ext), F.col("line").rlike(p) if name != "python" else ~F.col("name").startswith("_")) for name, (ext, _, p) in OPENINGS.items()])
    hits = [F.max(F.lower("line").contains(k).cast("int")) for k in keys]
    blocks = rows.groupBy("path", "block").agg(
        F.min("pos").alias("start"), F.max(F.when(F.trim("line") != "", F.col("pos"))).alias("end"), F.min_by("word", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("word"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("name"),
        F.min_by(exported, F.when(F.col("name").isNotNull(), F.col("pos"))).alias("exported"), sum(hits, F.lit(0)).alias("hits"),
    )
    kind = F.when(F.col("word").isin("def", "func", "function"), "function").otherwise(F.col("word"))
    weight = F.coalesce(*[F.when(F.col("type") == t, F.lit(v)) for t, v in TYPE_WEIGHTS.items()], F.lit(1.0))
    out = blocks.where("name is not null").withColumn("type", kind)
    score = weight + KEYWORD_WEIGHT * F.col("hits") + F.when(F.col("exported"), EXPORT_WEIGHT).otherwise(0.0)
    return out.select("path", (F.col("start") + 1).cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"), "type", "name", "exported", F.round(score, 4).alias("score"))


def chosen(symbols: DataFrame, line_budget: int, most: int = 4) -> DataFrame:
    """(path, start, end, name, stub): of each file the best symbols that fit the lines, at most ``most``.

    Best first, exported before others, then by place. One that is longer than what is left is passed over, but for the
    first, which is cut. A symbol below the bar is a stub: its first line alone is shown, and its lines still count.
    """

    def step(state: list[int], row: tuple) -> tuple | None:
        left, taken = state
        _, start, end, name, score = row
        if taken >= most or left <= 0 or (end - start + 1 > left and taken):
            return None
        end = min(end, start + left - 1)
        state[:] = left - (end - start + 1), taken + 1
        return start, end, name, score < STUB_BELOW and end > start

    w = W.partitionBy("path").orderBy(F.desc("score"), F.desc("exported"), "start", "end", "name")
    rows = symbols.select("path", F.row_number().over(w).alias("turn"), "start", "end", "name", "score")
    return folds.ordered_fold(rows, ["path"], ["turn"], lambda: [max(1, line_budget), 0], step, "start long, end long, name string, stub boolean")


def symbol_tier(files: DataFrame, keys: list[str], line_budget: int = 80, most: int = 4) -> DataFrame:
    """(path, tokens) of the form that shows the chosen symbols of each file that has any."""
    picked = chosen(candidates(files, keys), line_budget, most)
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", F.col("pos") + 1)
    shown = lines.join(picked, "path").where(F.col("n").between(F.col("start"), F.when(F.col("stub"), F.col("start")).otherwise(F.col("end"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return shown.groupBy("path").agg(S.tokens(text).alias("tokens"))
