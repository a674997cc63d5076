"""Budgeted packing: duplicates, prefix stop, greedy skip, tiers, and one round of degradation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contextmill.functions import scalar as S
from contextmill.functions import texts as X
from contextmill.operators import folds


def first_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def prefix_stop(ranked: DataFrame, budget: int, pack: list[str] | None = None) -> DataFrame:
    """Rows in order of rank until the first that overflows the budget, of each pack, or of the whole table by ranges. ranked: rank, tokens."""
    if not pack:
        return folds.running(ranked, [F.col("rank")], F.col("tokens"), "used").where(F.col("used") <= budget)
    w = W.partitionBy(*pack).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def best_within(rows: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first rows in the given order whose tokens (one at least in each) fit the budget, with rank and used.

    So no more than ``budget`` rows can be taken: each task passes on its own first ones, and only these are ranked.
    """
    first = rows.where("tokens >= 1").orderBy(*order).limit(budget + 1)
    w = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return first.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long")).withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


class _Room:
    """The most tokens that a row may still have to be taken, after the rows seen of its pack.

    A row of t tokens is taken only while t are left, so every row before it with t or fewer was taken as well. Hence it
    can't be once those and t itself exceed the budget. The bound only falls: rows above it neither pass nor count.
    """

    def __init__(self, budget: int):
        self.budget, self.most, self.total, self.held = budget, budget, 0, []

    def passes(self, t: int) -> bool:
        if t > self.most:
            return False
        if t:  # held rows have at least one token each and fit the budget together
            heappush(self.held, -t)
            self.total += t
            while self.total + self.most > self.budget:
                left = self.budget - self.total
                self.most = left if left >= -self.held[0] else -self.held[0] - 1
                while self.held and -self.held[0] > self.most:
                    self.total += heappop(self.held)
        return True


def _possible(keys: int, least: int, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops rows that can't be taken, of tables sorted by their first columns (keys) and the packs' order; least: the place of the column of smallest tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, room = None, _Room(budget)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(least).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = [pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy() for k in range(keys)]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(t))
            keep = np.ones(len(t), bool)
            whole = np.add.reduceat(t, starts) <= budget  # such a pack has room for all its rows
            whole[[0, -1]] = False  # these may go on in another batch
            for a, b in zip(starts[~whole].tolist(), ends[~whole].tolist(), strict=True):
                key = tuple(batch.column(k)[a].as_py() for k in range(keys))
                if key != last:
                    last, room = key, _Room(budget)
                for s in range(a, b, 1024):
                    part = t[s : min(b, s + 1024)]
                    low = np.flatnonzero(part <= room.most)
                    own = np.zeros(len(part), bool)
                    own[low] = [room.passes(x) for x in part[low].tolist()]
                    keep[s : s + len(part)] = own
            yield batch.filter(pa.array(keep))

    return run


def possible(rows: DataFrame, pack: list[str], order: list[str], least: str, budget: int) -> DataFrame:
    """rows (pack's columns first) without those that no fold along each pack's order can take; without an exchange.

    Each task looks at its own rows of a pack, whichever they are, and leaves of them at most ``budget * (1 + ln(budget))``
    with tokens, and those without any. Memory of a task: ``budget`` numbers. So a pack of any size is worked on by all
    tasks that hold rows of it, and what is folded afterwards grows with their number alone.
    """
    return rows.sortWithinPartitions(*pack, *order).mapInArrow(_possible(len(pack), rows.columns.index(least), budget), rows.schema)


def greedy_skip(ranked: DataFrame, budget: int, pack: list[str]) -> DataFrame:
    """(pack, rank, used) of the rows that fit when rows that overflow are passed over. ranked: pack, rank, tokens.

    Rows that can't be taken go where they are (``possible``); the others of a pack are one ordered fold. Tokens are not
    negative; rows with null tokens are never taken; of rows with the same rank those with fewer tokens come first.
    """

    def step(used: list[int], row: tuple) -> tuple | None:
        if used[0] + row[1] > budget:
            return None
        used[0] += row[1]
        return row[0], used[0]

    rows = ranked.where(F.col("tokens") <= budget).select(*pack, F.col("rank").cast("long").alias("rank"), F.col("tokens").cast("long").alias("tokens"))
    rows = possible(rows, pack, ["rank", "tokens"], "tokens", budget)
    return folds.ordered_fold(rows, pack, ["rank", "tokens"], lambda: [0], step, "rank long, used long")


def best_tiers(ranked: DataFrame, budget: int, pack: list[str]) -> DataFrame:
    """(pack, rank, tier, tokens, used): each row in turn takes its most detailed tier that still fits, or none.

    ranked: pack, rank, tiers (array of tokens, most detailed first). tier counts from 0. As for ``greedy_skip``, rows
    whose smallest tier can't fit any more go before the fold; null tiers never fit; of rows with the same rank the
    smaller array comes first.
    """

    def step(used: list[int], row: tuple) -> tuple | None:
        tier = next((k for k, t in enumerate(row[1]) if t is not None and used[0] + t <= budget), None)
        if tier is None:
            return None
        used[0] += row[1][tier]
        return row[0], tier, row[1][tier], used[0]

    rows = ranked.select(*pack, F.col("rank").cast("long").alias("rank"), F.col("tiers").cast("array<bigint>").alias("tiers"), F.array_min(F.col("tiers").cast("array<bigint>")).alias("least")).where(F.col("least") <= budget)
    rows = possible(rows, pack, ["rank", "tiers"], "least", budget).drop("least")
    return folds.ordered_fold(rows, pack, ["rank", "tiers"], lambda: [0], step, "rank long, tier int, tokens long, used long")


def progressive(ranked: DataFrame, budget: int, pack: str, rounds: int = 1) -> DataFrame:
    """(pack, rank, tier, tokens): best tiers, then degradation of the least relevant to admit what was skipped.

    ranked: pack, rank, relevance, tiers. A pack (one task's ranked files) is one group, without rows that fit in no form:
    what may be exchanged has to be seen together. In each round every skipped row
    takes the first included row, least relevant first, that is not used yet and whose next tier frees enough for some
    tier of the skipped row. What is over the budget at the end goes, least relevant first.
    """

    def fold(items: list) -> list[tuple[int, int, int]]:
        tiers = {x["rank"]: list(x["tiers"]) for x in items}
        worth = {x["rank"]: x["relevance"] for x in items}
        chosen: dict[int, int] = {}
        used = 0
        for r, options in tiers.items():
            k = next((i for i, t in enumerate(options) if used + t <= budget), None)
            if k is not None:
                chosen[r] = k
                used += options[k]
        for _ in range(rounds):
            order = sorted((r for r in chosen if chosen[r] + 1 < len(tiers[r])), key=lambda r: (worth[r], r))
            taken: set[int] = set()
            for r in [r for r in tiers if r not in chosen]:
                for c in order:
                    freed = tiers[c][chosen[c]] - tiers[c][chosen[c] + 1] if c not in taken else 0
                    k = next((i for i, t in enumerate(tiers[r]) if used - freed + t <= budget), None) if freed > 0 else None
                    if k is not None:
                        taken.add(c)
                        chosen[c] += 1
                        chosen[r] = k
                        used += tiers[r][k] - freed
                        break
        for r in sorted(chosen, key=lambda r: (worth[r], -r)):
            if used <= budget:
                break
            used -= tiers[r][chosen.pop(r)]
        return [(r, k, tiers[r][k]) for r, k in sorted(chosen.items())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(key, *x) for key, items in zip(f[pack], f["items"], strict=True) for x in fold(list(items))]
            yield pd.DataFrame(rows, columns=[pack, "rank", "tier", "tokens"])

    kind = ranked.schema[pack].dataType.simpleString()
    item = F.struct(F.col("rank").cast("long").alias("rank"), F.col("relevance").cast("double").alias("relevance"), F.col("tiers").cast("array<bigint>").alias("tiers"))
    packs = ranked.where(F.array_min("tiers") <= budget).groupBy(pack).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return packs.mapInPandas(run, f"{pack} {kind}, rank long, tier int, tokens long")


def keyword_window(files: DataFrame, keys: list[str], hits: int = 6, around: int = 1, most: int = 120) -> DataFrame:
    """(path, start, end): ranges of lines around the first lines with a keyword, merged where they touch."""
    lines = files.select("path", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.where(F.lower("line").rlike("|".join(keys))).withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("pos"))).where(F.col("k") <= hits)
    near = found.select("path", F.explode(F.sequence(F.greatest(F.col("pos") + 1 - around, F.lit(1)), F.least(F.col("pos") + 1 + around, F.col("n")))).alias("line")).distinct()
    by = W.partitionBy("path").orderBy("line")
    near = near.withColumn("i", F.row_number().over(by)).where(F.col("i") <= most)
    return near.groupBy("path", (F.col("line") - F.col("i")).alias("island")).agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("island")


def tier_texts(files: DataFrame, keys: list[str], full_tokens: int = 300, least_score: float = 2.5, hits: int = 6, summary_lines: int = 8) -> DataFrame:
    """(path, place, tier, tokens): the forms in which a file (path, text, score) may be packed, most detailed first.

    full up to 300 tokens; snippet (lines with a keyword and those beside them) from a score of 2.5; always the summary
    (first lines that are not blank, after the file's boilerplate), of one token at least.
    """
    rows = files.select("path", "score", "text", F.split("text", "\n").alias("lines"))
    pattern = "|".join(keys)
    found = F.slice(F.filter(F.transform("lines", lambda x, i: F.when(F.lower(x).rlike(pattern), i)), lambda i: i.isNotNull()), 1, hits)
    rows = rows.withColumn("hits", found).withColumn("skipped", X.boilerplate(F.col("lines")))
    snippet = F.array_join(F.filter("lines", lambda x, i: F.exists("hits", lambda h: F.abs(h - i) <= 1)), "\n")
    summary = F.array_join(F.slice(F.filter(F.filter("lines", lambda x, i: i >= F.col("skipped")), lambda x: F.trim(x) != ""), 1, summary_lines), "\n")
    tier = lambda place, name, text, when, least=0: F.when(when, F.struct(F.lit(place).cast("long").alias("place"), F.lit(name).alias("tier"), F.greatest(S.tokens(text), F.lit(least)).cast("long").alias("tokens")))
    forms = F.array_compact(F.array(tier(0, "full", F.col("text"), S.tokens(F.col("text")) <= full_tokens), tier(1, "snippet", snippet, (F.col("score") >= least_score) & (F.size("hits") > 0)), tier(2, "summary", summary, F.lit(True), 1)))
    return rows.select("path", F.explode(forms).alias("f")).select("path", "f.*")


def first_seen_lines(files: DataFrame, group: str) -> DataFrame:
    """(group, file, pos, line): each distinct line of a group where it is first seen. files: group, file, text."""
    lines = files.select(group, "file", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    first = lines.groupBy(group, "line").agg(F.min(F.struct("file", "pos")).alias("at"))
    return first.select(group, "at.file", "at.pos", "line")
