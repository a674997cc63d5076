"""Histories, snapshots and sessions in batch form; ``contextmill.streaming`` has the forms over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.sources.scratch import Scratch


def newest(history: DataFrame, n: int) -> DataFrame:
    """The newest n entries (id, generated_at, ...), to be read oldest first."""
    return history.orderBy(F.desc("generated_at"), F.desc("id")).limit(n).orderBy("generated_at", "id")


def newest_of_each(history: DataFrame, key: str, n: int) -> DataFrame:
    """What trimming to the newest n of each key keeps."""
    return history.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("generated_at"), F.desc("id")))).where(F.col("_k") <= n).drop("_k")


def prune(history: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries of the last days; those without a time stay."""
    return history.where(F.col("generated_at").isNull() | (F.col("generated_at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def union_by_priority(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, of the lowest priority number and then id; rows without a key all stay."""
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("priority", "id")).alias("at"))
    return best.select(F.col("at.id").alias("id"), F.col("at.priority").alias("priority"), key).union(rows.where(F.col(key).isNull()).select("id", "priority", key))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change class of each path between two scans (path, size, stamp): reused if size and stamp are the same."""
    o, n = (df.select("path", F.col("size").alias(f"{k}_size"), F.col("stamp").alias(f"{k}_stamp")) for df, k in ((old, "old"), (new, "new")))
    both = n.join(o, "path", "full_outer")
    same = (F.col("new_size") == F.col("old_size")) & (F.col("new_stamp") == F.col("old_stamp"))
    return both.select("path", F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "removed").when(same, "reused").otherwise("updated").alias("change"))


def carried_records(listed: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a new listing takes from an older scan, and what is left to read.

    The first result has the old records of files whose path, size and stamp are the same; the second the other rows of
    listed (path, size, stamp, kind, ...) whose kind is open. Files that could not be read are tried again.
    """
    known = old.where("kind in ('included', 'binary')")
    same = ["path", "size", "stamp"]
    todo = listed.where("kind is null")
    return known.join(todo.select(*same), same, "left_semi").select(*old.columns), todo.join(known.select(*same), same, "left_anti")


def score_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two rankings (path, score): added, removed or changed by how much; equal scores are left out."""
    a, b = left.select("path", F.col("score").alias("before")), right.select("path", F.col("score").alias("after"))
    both = a.join(b, "path", "full_outer")
    zero = F.lit(0).cast("long")
    change = F.coalesce("after", zero) - F.coalesce("before", zero)
    return both.select("path", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("status"), change.alias("change")).where("change <> 0 or status <> 'changed'")


def delta_package(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a client that has the old pack needs: files (path, tokens, strategy) added, changed or removed, and tokens to send."""
    o, n = (df.select("path", F.col("tokens").alias(f"{k}_tokens"), F.col("strategy").alias(f"{k}_strategy")) for df, k in ((old, "old"), (new, "new")))
    both = n.join(o, "path", "full_outer")
    same = (F.col("old_tokens") == F.col("new_tokens")) & (F.col("old_strategy") == F.col("new_strategy"))
    status = F.when(F.col("old_tokens").isNull(), "added").when(F.col("new_tokens").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select("path", status.alias("status"), F.when(status.isin("added", "changed"), F.col("new_tokens")).otherwise(F.lit(0)).cast("long").alias("send_tokens")).where("status <> 'same'")


def snapshot_choice(calls: DataFrame, key: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """Whether a call's output is shown as a delta against the call before it with the same key.

    The delta has the added and removed lines, each as often as it stands; it is taken if line similarity is 0.30 or more and
    its tokens are fewer. The earlier output is the base whether or not a delta was taken. calls: id (of one row each), key,
    text and the order columns; a null text is empty. Lines are counted by call and line, in time linear in the lines.
    With tasks, calls are dealt to so many partitions by key and then by id, whatever their size.
    """
    w = W.partitionBy(key).orderBy(*order)
    text = F.coalesce("text", F.lit(""))
    number = [tasks] if tasks else []
    rows = calls.repartition(*number, key).select("id", key, text.alias("text"), F.lag(text).over(w).alias("before")).withColumn("tokens", S.tokens(F.col("text")))
    side = lambda c, now: F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("line"), F.lit(now).alias("now")))
    both = F.concat(side("text", 1), F.coalesce(side("before", 0), F.array().cast("array<struct<line:string,now:int>>")))
    call = ["id", key, "tokens", "has"]
    lines = rows.repartition(*number, "id").select("id", key, "tokens", F.col("before").isNotNull().alias("has"), F.explode(both).alias("x"))
    each = lines.groupBy(*call, "x.line").agg(F.sum("x.now").alias("new"), F.count(F.lit(1)).alias("n"))  # dealt by id already
    lone = (F.col("new") == 0) | (F.col("new") == F.col("n"))
    sums = each.groupBy(*call).agg(
        F.count(F.lit(1)).alias("distinct"), F.sum((~lone).cast("long")).alias("common"), F.sum(F.when(lone, F.col("n") * (F.length("line") + 3)).otherwise(0)).alias("chars"))
    size = F.greatest(F.col("chars") - 1, F.lit(0))  # two characters before a line and a line break between two
    rows = sums.withColumn("similarity", F.when(F.col("has"), F.col("common") / F.col("distinct"))).withColumn("delta_tokens", F.when(F.col("has"), F.ceil(size / 4)))
    took = F.coalesce((F.col("similarity") >= 0.30) & (F.col("delta_tokens") < F.col("tokens")), F.lit(False))
    return rows.select("id", key, "tokens", S.rounded("similarity", 4).alias("similarity"), "delta_tokens", took.alias("delta"), F.when(took, F.col("delta_tokens")).otherwise(F.col("tokens")).alias("sent_tokens"))


def references(blocks: DataFrame, session: str) -> DataFrame:
    """Repeated blocks (session, call, pos, block) become references to their first place.

    A block takes part from 24 to 4096 characters and 6 tokens on, by its text with blanks run together.
    """
    able = blocks.where("length(block) between 24 and 4096").where(S.tokens(F.col("block")) >= 6).select(session, "call", "pos", F.sha1(S.normalised_prompt(F.col("block"))).alias("key"))
    able = Scratch(blocks.sparkSession, "references").save(able, "blocks")
    first = able.groupBy(session, "key").agg(F.min(F.struct("call", "pos")).alias("first"))
    return able.join(first, [session, "key"]).select(session, "call", "pos", (F.struct("call", "pos") != F.col("first")).alias("reference"), F.col("first.call").alias("first_call"), F.col("first.pos").alias("first_pos"))


def aliases(mentions: DataFrame, session: str, least: int = 1, most: int | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(session, name, alias): names numbered by where a session first mentions them, but for blocked ones. mentions: session, call, pos, name."""
    able = mentions.where(F.length("name") >= least)
    first = (able.where(~F.col("name").isin(*blocked)) if blocked else able).groupBy(session, "name").agg(F.min(F.struct("call", "pos", "name")).alias("at"))
    out = first.withColumn("alias", F.row_number().over(W.partitionBy(session).orderBy("at"))).select(session, "name", "alias")
    return out if most is None else out.where(F.col("alias") <= most)


def cache_hits(calls: DataFrame, digest: list[str], order: list[str]) -> DataFrame:
    """Whether a call repeats an earlier one's digest."""
    return calls.withColumn("hit", F.row_number().over(W.partitionBy(*digest).orderBy(*order)) > 1)


def ttl_sessions(events: DataFrame, key: str, hours: int) -> DataFrame:
    """Sessions of each key, cut where nothing came for longer than the TTL: start, end, events. events: ts."""
    w = W.partitionBy(key).orderBy("ts", "id")
    cut = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {hours} HOURS")).cast("int"), F.lit(1))
    rows = events.withColumn("cut", cut).withColumn("session", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))


def turn_ledger(turns: DataFrame) -> DataFrame:
    """Tokens of a session so far at each turn."""
    w = W.partitionBy("session").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return turns.select("session", "turn", "tokens", F.sum("tokens").over(w).alias("cumulative_tokens"))


def context_modes(turns: DataFrame) -> DataFrame:
    """Context carried at each turn: isolated, rolling (this and the one before) and full (all so far)."""
    w = W.partitionBy("session").orderBy("turn")
    return turns.select("session", "turn", F.col("tokens").alias("isolated"), (F.col("tokens") + F.coalesce(F.lag("tokens").over(w), F.lit(0))).alias("rolling"), F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("full"))


def shingle_overlap(calls: DataFrame, n: int = 3) -> DataFrame:
    """(session, call, shingles, seen): distinct line shingles of a call, and how many an earlier call of the session has.

    Shingles are cut once and written; a shingle that very many calls have can be split.
    """
    each = calls.select("session", "call", F.explode(F.array_distinct(F.transform(S.shingles(F.split("text", "\n"), n), lambda x: F.sha1(x)))).alias("key"))
    each = Scratch(calls.sparkSession, "shingles").save(each, "each")
    first = each.groupBy("session", "key").agg(F.min("call").alias("first"))
    return each.join(first, ["session", "key"]).groupBy("session", "call").agg(F.count(F.lit(1)).alias("shingles"), F.sum((F.col("first") < F.col("call")).cast("long")).alias("seen"))
