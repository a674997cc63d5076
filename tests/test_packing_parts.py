"""Packs that several tasks work on, against plain folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contextmill.operators import packing


def plain(rows, budget):
    """{(pack, rank, tier)} of rows (pack, rank, tiers), each taking its first tier that fits."""
    used, out = {}, set()
    for pack, rank, tiers in sorted((r for r in rows if any(t is not None for t in r[2])), key=lambda r: (r[0] is not None, str(r[0]), r[1], [(t is not None, t or 0) for t in r[2]])):
        for k, t in enumerate(tiers):
            if t is not None and used.get(pack, 0) + t <= budget:
                used[pack] = used.get(pack, 0) + t
                out.add((pack, rank, k))
                break
    return out


@pytest.mark.parametrize("most", [3, 40, 400])
def test_pruned_folds_equal_plain_folds(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(3, 60)]), k, rng.choice([rng.randrange(most), rng.randrange(most), 0, None, 10**12])) for k in range(6000)]
    table = spark.createDataFrame(rows, "pack long, rank long, tokens long").repartition(7)
    for budget in (0, 1, 97, 5000):
        got = {(r.pack, r["rank"], 0) for r in packing.greedy_skip(table, budget, ["pack"]).collect()}
        assert got == plain([(p, k, [t]) for p, k, t in rows], budget)
    tiers = F.array("tokens", F.floor(F.col("tokens") / 2), F.floor(F.col("tokens") / 5))
    got = {(r.pack, r["rank"], r.tier) for r in packing.best_tiers(table.select("pack", "rank", tiers.alias("tiers")), 97, ["pack"]).collect()}
    assert got == plain([(p, k, [None if t is None else t // n for n in (1, 2, 5)]) for p, k, t in rows], 97)


def test_equal_ranks_and_empty_tables(spark):
    table = spark.createDataFrame([(1, 1, 9), (1, 1, 4), (1, 2, 3)], "pack long, rank long, tokens long")
    assert sorted((r["rank"], r.used) for r in packing.greedy_skip(table, 10, ["pack"]).collect()) == [(1, 4), (2, 7)]
    assert packing.greedy_skip(table.where("false"), 10, ["pack"]).count() == 0
    tiered = table.select("pack", "rank", F.array("tokens").alias("tiers"))
    assert packing.best_tiers(tiered.where("false"), 10, ["pack"]).count() == 0


def test_one_pack_is_worked_on_by_all_tasks(spark):
    """300,000 rows of one pack over 16 tasks: the fold gets few of them, at most the stated bound a task, and the plain result."""
    budget, n = 2000, 300_000
    rows = spark.range(0, n, 1, 16).select(F.lit("one").alias("pack"), ((F.col("id") * 7919) % n).alias("rank"), (F.col("id") * 31337 % 1499 + 1).alias("tokens"))
    left = packing.possible(rows, ["pack"], ["rank", "tokens"], "tokens", budget)
    assert left.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= budget * (1 + math.log(budget))
    assert left.count() < n / 20  # 6,697, some 420 a task
    got = {(r.pack, r["rank"], 0) for r in packing.greedy_skip(rows, budget, ["pack"]).collect()}
    assert got == plain([("one", r["rank"], [r.tokens]) for r in rows.collect()], budget)
