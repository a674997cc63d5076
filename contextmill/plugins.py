"""Named functions that a configuration can swap: token estimators, scorers, compressors, summaries and delta renderers."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.functions import scalar as S
from contextmill.operators import commands, packing, ranking, state
from contextmill.sources import scan

#: What a function of each kind takes, after its options, and gives.
KINDS = {
    "estimator": "text column -> token column", "scorer": "files (path, text), keys -> files with score", "compressor": "files with score, keys -> (path, place, tier, tokens)",
    "summary": "text column -> text column", "similarity": "two columns of keys -> column", "delta": "two outputs (doc, text) -> rows",
}


class Registry:
    """Functions by kind and name, with options that are bound when they are looked up.

    A name may be registered once for each kind. A target is a dotted path ``package.module:attribute`` or
    ``package.module.attribute``.
    """

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], tuple[Callable, dict]] = {}

    def register(self, kind: str, name: str, function: Callable | str, **options) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}: one of {', '.join(KINDS)}")
        if (kind, name) in self.held:
            raise ValueError(f"{kind} {name!r} is registered already")
        self.held[kind, name] = (imported(function) if isinstance(function, str) else function, options)

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.held if k == kind)

    def get(self, kind: str, name: str, **options) -> Callable:
        """The function with its options; those given here win."""
        if (kind, name) not in self.held:
            raise ValueError(f"no {kind} {name!r}: one of {', '.join(self.names(kind)) or 'none'}")
        function, own = self.held[kind, name]
        return partial(function, **{**own, **options}) if own or options else function


def imported(target: str) -> Callable:
    """The object at a dotted path."""
    module, _, name = target.replace(":", ".").rpartition(".")
    found = getattr(importlib.import_module(module), name) if module else None
    if not callable(found):
        raise ValueError(f"{target!r} is no function")
    return found


def estimate_by_model(text: Column, model: str = "gpt-4o") -> Column:
    return S.model_tokens(text, model)


def score_by_keywords(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.withColumn("score", ranking.base_score(F.col("path"), F.col("text"), F.lit(""), S.line_count(F.col("text")), keys) * ranking.role_factor(F.col("path"), keys))


def score_with_path_bonus(files: DataFrame, keys: list[str], patterns: tuple[str, ...] = ("docs/*",), bonus: float = 4.0) -> DataFrame:
    """Keyword scores, and a bonus for paths that one of the globs matches."""
    return score_by_keywords(files, keys).withColumn("score", F.round(F.col("score") + F.when(scan.matches(F.col("path"), list(patterns)), bonus).otherwise(0.0), 3))


def first_lines(text: Column, lines: int = 8) -> Column:
    """The first lines that are not blank."""
    return F.array_join(F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, lines), "\n")


def leading_summary(files: DataFrame, keys: list[str], lines: int = 20) -> DataFrame:
    """One form of each file: its first lines."""
    return files.select("path", F.lit(0).cast("long").alias("place"), F.lit("summary").alias("tier"), S.tokens(first_lines(F.col("text"), lines)).alias("tokens"))


def diff_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return commands.diff_changes(commands.git_diff(before), commands.git_diff(after))


def line_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return commands.line_changes(commands.lines(before), commands.lines(after))


def builtins() -> Registry:
    """A registry with what the library has itself."""
    out = Registry()
    out.register("estimator", "characters", S.tokens)
    out.register("estimator", "model", estimate_by_model)
    out.register("scorer", "keywords", score_by_keywords)
    out.register("scorer", "path_bonus", score_with_path_bonus)
    out.register("compressor", "tiers", packing.tier_texts)
    out.register("compressor", "leading_summary", leading_summary)
    out.register("summary", "first_lines", first_lines)
    out.register("similarity", "sets", lambda a, b: S.set_similarity(a, b, 0.0))
    out.register("delta", "lines", line_delta)
    out.register("delta", "git_diff", diff_delta)
    out.register("delta", "pack", state.delta_package)
    return out
