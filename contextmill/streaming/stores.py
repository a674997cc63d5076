"""Stores over streams: a block ledger, a call cache, aliases and sessions, each key's entries in map state of their own.

The state is RocksDB's: a key's entries are read and written one at a time and never gathered, and those that a time to live
or a timer ends leave it. The session needs ``spark.sql.streaming.stateStore.providerClass`` set to ``PROVIDER``. Rows of a
batch are put in order; batches come in order. Each function gives the rows of its batch form in ``operators.state``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Takes the rows of a key in a batch in order; ``step`` gives output rows."""

    order: list[str] = []
    out: list[str] = []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        made = [r for row in frame.to_dict("records") for r in self.step(key, row, timerValues)]
        if made:
            yield pd.DataFrame(made, columns=self.out)

    def step(self, key, row: dict, timers) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Aliases(_Ordered):
    order, out = ["call", "pos", "name"], ["session", "name", "alias"]

    def __init__(self, least: int, most: int | None, blocked: frozenset[str]):
        self.least, self.most, self.blocked = least, most, blocked

    def init(self, handle) -> None:
        self.names = handle.getMapState("names", "name string", "alias int")
        self.count = handle.getValueState("count", "n int")

    def step(self, key, row, timers):
        name = (row["name"],)
        if len(row["name"]) < self.least or row["name"] in self.blocked or self.names.containsKey(name):
            return []
        n = (self.count.get()[0] if self.count.exists() else 0) + 1
        self.names.updateValue(name, (n,))
        self.count.update((n,))
        return [(*key, row["name"], n)] if self.most is None or n <= self.most else []


def aliases(mentions: DataFrame, least: int = 1, most: int | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(session, name, alias) of names when they are first mentioned. mentions: session, call, pos, name."""
    kind = mentions.schema["session"].dataType.simpleString()
    return mentions.groupBy("session").transformWithStateInPandas(_Aliases(least, most, frozenset(blocked)), f"session {kind}, name string, alias int", "append", "none")


class _Ledger(_Ordered):
    order, out = ["call", "pos"], ["session", "call", "pos", "reference", "first_call", "first_pos"]

    def init(self, handle) -> None:
        self.first = handle.getMapState("first", "key string", "call long, pos int")

    def step(self, key, row, timers):
        text = row["block"]
        if text is None or not 24 <= len(text) <= 4096 or -(-len(text) // 4) < 6:
            return []
        digest = (hashlib.sha1(re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").lower().encode()).hexdigest(),)
        met = self.first.containsKey(digest)
        if not met:
            self.first.updateValue(digest, (row["call"], row["pos"]))
        return [(*key, row["call"], row["pos"], met, *(self.first.getValue(digest) if met else (row["call"], row["pos"])))]


def references(blocks: DataFrame) -> DataFrame:
    """Blocks (session, call, pos, block) that a ledger takes, whether each repeats an earlier one, and that one's place."""
    kind = blocks.schema["session"].dataType.simpleString()
    return blocks.groupBy("session").transformWithStateInPandas(_Ledger(), f"session {kind}, call long, pos int, reference boolean, first_call long, first_pos int", "append", "none")


class _Cache(_Ordered):
    out = ["id", "hit"]

    def __init__(self, order: list[str], seconds: float | None):
        self.order, self.seconds = order, seconds

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long", ttlDurationMs=None if self.seconds is None else int(self.seconds * 1000))

    def step(self, key, row, timers):
        hit = self.seen.exists()
        if not hit:  # a hit does not lengthen an entry's life
            self.seen.update((1,))
        return [(row["id"], hit)]


def cache_hits(calls: DataFrame, digest: list[str], order: list[str], seconds: float | None = None) -> DataFrame:
    """(id, hit) of each call: whether an earlier one with the same digest is still in the cache. Entries live so many seconds
    of processing time from when they were made, or for ever."""
    mode = "none" if seconds is None else "processingTime"
    return calls.groupBy(*digest).transformWithStateInPandas(_Cache(order, seconds), "id long, hit boolean", "append", mode)


class _Sessions(_Ordered):
    order = ["ts", "id"]

    def __init__(self, key: str, hours: float):
        self.out, self.ttl = [key, "session", "started", "ended", "events"], timedelta(hours=hours)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session long, started timestamp, ended timestamp, events long")
        self.number = handle.getValueState("number", "n long")

    def _timer(self, ended: datetime) -> int:
        return int((ended + self.ttl).replace(tzinfo=timezone.utc).timestamp() * 1000) + 1

    def step(self, key, row, timers):
        ts, out = row["ts"].to_pydatetime(), []
        now = self.open.get() if self.open.exists() else None
        if now and ts > now[2] + self.ttl:
            out, now = [(*key, *now)], None
        if now:
            self.handle.deleteTimer(self._timer(now[2]))
            now = (now[0], min(now[1], ts), max(now[2], ts), now[3] + 1)
        else:
            n = (self.number.get()[0] if self.number.exists() else 0) + 1
            self.number.update((n,))
            now = (n, ts, ts, 1)
        self.open.update(now)
        self.handle.registerTimer(self._timer(now[2]))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and self._timer(self.open.get()[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            now = self.open.get()
            self.open.clear()
            yield pd.DataFrame([(*key, *now)], columns=self.out)


def ttl_sessions(events: DataFrame, key: str, hours: float, late: str = "1 hour") -> DataFrame:
    """(key, session, started, ended, events) of sessions that ended, as nothing came for longer than the time to live.

    events: key, id, ts; what comes later than ``late`` is dropped. A session comes out when its key's next one begins or
    the watermark passes its end, and leaves the state.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(_Sessions(key, hours), f"{key} {kind}, session long, started timestamp, ended timestamp, events long", "append", "eventTime")


def assembled_runs(starts: DataFrame, ends: DataFrame, late: str = "1 hour", longest: str = "1 day") -> DataFrame:
    """(run_id, name, started, ended, tokens) of runs from their start (run_id, name, started) and end events (run_id, ended, tokens).

    An event that is repeated counts once. An end belongs to the start up to ``longest`` before it; a run without one comes
    out with nulls when the watermark has passed what it could have. Events later than ``late`` are dropped.
    """
    from pyspark.sql import functions as F

    once = lambda df, at: df.withWatermark(at, late).dropDuplicatesWithinWatermark(["run_id"])
    a = once(starts.select("run_id", "name", "started"), "started").alias("a")
    b = once(ends.select("run_id", "ended", "tokens"), "ended").alias("b")
    paired = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("b.ended") >= F.col("a.started")) & (F.col("b.ended") <= F.col("a.started") + F.expr(f"INTERVAL {longest}"))
    return a.join(b, paired, "leftOuter").select("a.run_id", "name", "started", "ended", "tokens")
