"""Keyed state over streams: turn ledgers, aliases and snapshot deltas; and windowed telemetry with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _keyed(rows: DataFrame, key: str, out: str, state: str, step) -> DataFrame:
    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        value = held.get if held.exists else None
        found, value = step(k[0], pd.concat(list(frames)), value)
        held.update(value)
        yield found

    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def turn_ledger(turns: DataFrame) -> DataFrame:
    """session, turn, tokens, cumulative_tokens. A batch is put in order of turn; batches come in order."""

    def step(session, f: pd.DataFrame, held):
        f = f.sort_values("turn")
        total = f.tokens.cumsum() + (held[0] if held else 0)
        return pd.DataFrame({"session": session, "turn": f.turn, "tokens": f.tokens, "cumulative_tokens": total}), (int(total.iloc[-1]),)

    return _keyed(turns, "session", "session long, turn long, tokens long, cumulative_tokens long", "total long", step)


def aliases(mentions: DataFrame) -> DataFrame:
    """session, name, alias of names when they are first mentioned (session, call, pos, name)."""

    def step(session, f: pd.DataFrame, held):
        known = dict(zip(held[0], range(1, len(held[0]) + 1), strict=True)) if held else {}
        new = []
        for name in f.sort_values(["call", "pos", "name"]).name:
            if name not in known:
                known[name] = len(known) + 1
                new.append((session, name, known[name]))
        return pd.DataFrame(new, columns=["session", "name", "alias"]), (list(known),)

    kind = mentions.schema["session"].dataType.simpleString()
    return _keyed(mentions, "session", f"session {kind}, name string, alias int", "names array<string>", step)


def snapshot_choice(calls: DataFrame, key: str) -> DataFrame:
    """id, key and whether a call is sent as a delta against the one before it (id, key, ts, text)."""

    def tokens(text: str) -> int:
        return -(-len(text) // 4)

    def step(k, f: pd.DataFrame, held):
        old, out = held[0] if held else None, []
        for row in f.sort_values(["ts", "id"]).itertuples():
            took = False
            if old is not None:
                now, before = row.text.split("\n"), old.split("\n")
                a, b = set(now), set(before)
                delta = "\n".join([f"+ {x}" for x in now if x not in b] + [f"- {x}" for x in before if x not in a])
                took = len(a & b) / len(a | b) >= 0.30 and tokens(delta) < tokens(row.text)
            out.append((row.id, k, took))
            old = row.text
        return pd.DataFrame(out, columns=["id", key, "delta"]), (old,)

    return _keyed(calls, key, f"id long, {key} {calls.schema[key].dataType.simpleString()}, delta boolean", "text string", step)


def telemetry(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events (at, name, run_id, tokens) by window and name: events and tokens; what comes later than ``late`` is dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "name").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("since"), "name", "events", "tokens")


def user_sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of users (at, user) that end when nothing came for the gap."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user").agg(F.count(F.lit(1)).alias("events")).select("user", F.col("session_window.start").alias("since"), "events")
