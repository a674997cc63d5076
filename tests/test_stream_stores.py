"""Stores over streams against their batch forms, in batches of random size; time to live and watermarks."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contextmill.operators import records, state
from contextmill.streaming import stores


@pytest.fixture(scope="module")
def rocks(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": stores.PROVIDER, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, folder, schema, batches, make, pause=None):
    """Rows that a stream gives when the batches come one after the other; with a pause, each to a query that goes on from the last."""
    (folder / "in").mkdir(parents=True)

    def go() -> None:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        query = make(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(**({"once": True} if pause else {"availableNow": True})).start()
        query.awaitTermination(180)
        assert query.exception() is None

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        for file in (folder / "in").glob("*.parquet"):
            if file.stat().st_mtime > 2e9 or file.stat().st_mtime < 1.5e9 + 1e8:
                continue
            os.utime(file, (1.5e9 + 10 * k, 1.5e9 + 10 * k))
        if pause is not None:
            go()
            time.sleep(pause)
    if pause is None:
        go()
    return [tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()]


def cut(rng, rows, n=3):
    at = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


def test_aliases_and_ledger(rocks, tmp_path):
    rng = random.Random(1)
    names = ["x", "alpha", "beta", "gamma", "common", "delta", "omega"]
    rows = [(s, c, p, rng.choice(names)) for c in range(8) for p in range(2) for s in range(3)]
    schema = "session long, call long, pos int, name string"
    got = run(rocks, tmp_path / "a", schema, cut(rng, rows), lambda s: stores.aliases(s, least=2, most=4, blocked=("common",)))
    want = state.aliases(rocks.createDataFrame(rows, schema), "session", least=2, most=4, blocked=("common",)).collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and "common" not in {r[1] for r in got}
    texts = ["A  block of some\tlength that repeats", "a block of some length that repeats", "another block with enough characters", "short", "x" * 5000]
    blocks = [(s, c, p, rng.choice(texts)) for c in range(8) for p in range(2) for s in range(3)]
    schema = "session long, call long, pos int, block string"
    got = run(rocks, tmp_path / "b", schema, cut(rng, blocks), stores.references)
    want = [tuple(r) for r in state.references(rocks.createDataFrame(blocks, schema), "session").collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in got)


def test_cache_and_its_time_to_live(rocks, tmp_path):
    rng = random.Random(2)
    calls = [(i, rng.choice("abc"), rng.choice("xy")) for i in range(40)]
    schema = "id long, argv string, head string"
    got = run(rocks, tmp_path / "a", schema, cut(rng, calls), lambda s: stores.cache_hits(s, ["argv", "head"], ["id"]))
    want = state.cache_hits(rocks.createDataFrame(calls, schema), ["argv", "head"], ["id"]).select("id", "hit").collect()
    assert sorted(got) == sorted(tuple(r) for r in want)
    got = run(rocks, tmp_path / "b", schema, [[(1, "a", "x"), (2, "a", "x")], [(3, "a", "x")]], lambda s: stores.cache_hits(s, ["argv", "head"], ["id"], seconds=2), pause=3)
    assert dict(got) == {1: False, 2: True, 3: False}  # the entry had left the state


def test_sessions_end_by_watermark(rocks, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events = sorted((u, i, start + timedelta(minutes=rng.randrange(0, 5000))) for i in range(120) for u in [rng.randrange(4)])
    events = sorted(events, key=lambda r: r[2])
    schema = "user long, id long, ts timestamp"
    over = [(99, 1000, start + timedelta(days=30)), (99, 1001, start + timedelta(days=60))]  # moves the watermark
    got = run(rocks, tmp_path / "a", schema, [*cut(rng, events), [over[0]], [over[1]]], lambda s: stores.ttl_sessions(s, "user", 4))
    want = state.ttl_sessions(rocks.createDataFrame(events, schema), "user", 4).select("user", "session", "started", "ended", "events").collect()
    assert len(want) > 20 and sorted(r for r in got if r[0] != 99) == sorted(tuple(r) for r in want)


def test_runs_are_assembled(rocks, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    schema = "kind string, run_id string, name string, at timestamp, tokens long"
    first = [("start", f"r{i}", "pack", at(i * 0.1), None) for i in range(10)]
    ends = [("end", f"r{i}", None, at(i * 0.1 + 0.5), i * 10) for i in range(8)]
    batches = [first + first[:3], ends + ends[2:5], [("start", "far", "pack", at(100), None), ("end", "far", None, at(100.5), 7)], [("end", "r9", None, at(3), 90), ("start", "late", "pack", at(2), None)], [("start", "x", "n", at(300), None), ("end", "x", None, at(301), 1)], [("start", "y", "n", at(600), None), ("end", "y", None, at(601), 1)]]
    starts = lambda df: df.where("kind = 'start'").select("run_id", "name", F.col("at").alias("started"))
    finals = lambda df: df.where("kind = 'end'").select("run_id", F.col("at").alias("ended"), "tokens")
    got = run(rocks, tmp_path / "a", schema, batches, lambda s: stores.assembled_runs(starts(s), finals(s)), pause=0)
    timely = rocks.createDataFrame([r for b in batches for r in b if (r[1], r[3]) not in (("r9", at(3)), ("late", at(2)))], schema)
    want = [tuple(r) for r in records.assembled_runs(starts(timely), finals(timely), 24).collect()]
    known = lambda rows: sorted((r for r in rows if r[0] not in "xy"), key=str)
    assert known(got) == known(want) and {r[0]: r[4] for r in got}["r9"] is None and {r[0]: r[4] for r in got}["r3"] == 30
