"""Queries over the driver's tables: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from contextmill.plans import analytics, commands, imports, ranking, records, reports, state, texts


def catalogue() -> dict:
    return {**ranking.QUERIES, **analytics.QUERIES, **state.QUERIES, **commands.QUERIES, **reports.QUERIES, **imports.QUERIES, **records.QUERIES, **texts.QUERIES}
