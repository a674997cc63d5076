"""Relevance: keyword scores, role multipliers, pair and graph boosts, history, and PageRank."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextmill.functions import scalar as S
from contextmill.operators import folds
from contextmill.sources.scratch import shared_root

#: Default weights of the relevance score.
PATH_WEIGHT, ABBREVIATION, CONTENT_WEIGHT, CONTENT_CAP, SYMBOL_WEIGHT = 2.0, 0.6, 0.25, 4.0, 1.0
CODE_BONUS, TEST_BONUS, LARGE_LINES, LARGE_PENALTY, CRITICAL_BONUS = 0.35, 0.25, 500, 0.2, 1.0
CODE_EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".go", ".rs", ".java")
SIGNAL_FILES = {"readme.md": 0.5, "contributing.md": 0.4, "package.json": 0.3, "pyproject.toml": 0.3, "requirements.txt": 0.3, "dockerfile": 0.2}
ROLE_FACTORS = {"prod": 1.0, "test": 0.6, "docs": 0.4, "example": 0.3, "config": 0.7, "generated": 0.1}
ROLE_WORDS = {"test": ("test", "spec", "fixture", "mock"), "docs": ("doc", "documentation", "readme", "guide"), "example": ("example", "demo", "sample", "tutorial")}
ROLE_OVERRIDE = 1.2
SEED, PAIR_BOOST, IMPORTED_BOOST, IMPORTS_BOOST, ENTRY_BOOST, GRAPH_CAP = 2.0, 2.0, 0.9, 0.7, 0.45, 2.5


def content_score(text: Column, keys: list[str]) -> Column:
    """Each keyword's occurrences by a quarter, four at most."""
    low = F.lower(text)
    return reduce(add, [F.least(F.lit(CONTENT_CAP), CONTENT_WEIGHT * S.occurrences(low, k)) for k in keys], F.lit(0.0))


def base_score(path: Column, preview: Column, symbols: Column, lines: Column, keys: list[str], critical: tuple[str, ...] = ()) -> Column:
    """Score of a file from its path, preview, symbol names and size, before multipliers and boosts."""
    p, t, s = F.lower(path), F.lower(F.coalesce(preview, F.lit(""))), F.lower(F.coalesce(symbols, F.lit("")))
    parts = [F.when(p.contains(c.lower()), CRITICAL_BONUS).otherwise(0.0) for c in critical]
    for k in keys:
        in_path, in_text, in_symbols = (S.occurrences(x, k) for x in (p, t, s))
        short = S.abbreviated(path, k)
        parts.append(F.when(in_path > 0, PATH_WEIGHT * in_path).when(short, PATH_WEIGHT * ABBREVIATION).otherwise(0.0))
        parts.append(F.when(in_text > 0, F.least(F.lit(CONTENT_CAP), CONTENT_WEIGHT * in_text)).otherwise(F.least(F.lit(CONTENT_CAP), SYMBOL_WEIGHT * in_symbols)))
    name = F.element_at(F.split(p, "/"), -1)
    parts.append(F.coalesce(*[F.when(name == n, F.lit(v)) for n, v in SIGNAL_FILES.items()], F.lit(0.0)))
    parts.append(F.when(F.regexp_extract(path, r"(\.[^./]*)$", 1).isin(*CODE_EXTENSIONS), CODE_BONUS).otherwise(0.0))
    parts.append(F.when(p.contains("test"), TEST_BONUS).otherwise(0.0))
    parts.append(F.when(lines > LARGE_LINES, -LARGE_PENALTY).otherwise(0.0))
    return reduce(add, parts)


def role_factor(path: Column, keys: list[str]) -> Column:
    """Multiplier of a file's role; a task that names the role lifts it."""
    role = S.file_role(path)
    lifted = [r for r, words in ROLE_WORDS.items() if any(w in k for k in keys for w in words)]
    out = F.when(role.isin(*lifted), F.lit(ROLE_OVERRIDE)) if lifted else F.when(F.lit(False), F.lit(1.0))
    for r, factor in ROLE_FACTORS.items():
        out = out.when(role == r, F.lit(factor))
    return out.otherwise(1.0)


def pair_boost(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds 2 to files whose test or source counterpart reaches the seed score before any boost. pairs: a, b."""
    seeds = scored.where(F.col("score") >= SEED).select(F.col("path").alias("seed"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "b").distinct()
    lifted = both.join(seeds, both.b == seeds.seed, "left_semi").select(F.col("a").alias("lifted")).distinct()
    out = scored.join(lifted, scored.path == lifted.lifted, "left")
    return out.withColumn("score", F.col("score") + F.when(F.col("lifted").isNotNull(), PAIR_BOOST).otherwise(0.0)).drop("lifted")


def test_pairs(files: DataFrame) -> DataFrame:
    """(a, b): a test file and the source files of its repository with the stem that it names."""
    named = files.select("repo", "path", F.element_at(F.split("path", "/"), -1).alias("name"))
    tests = named.withColumn("stem", S.test_base(F.col("name"))).where("stem is not null").select("repo", "stem", F.col("path").alias("a"))
    sources = named.where(S.test_base(F.col("name")).isNull()).select("repo", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.col("path").alias("b"))
    return tests.join(sources, ["repo", "stem"]).select("a", "b")


def one_hop(scored: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Boosts of files next to seeds: (path, boost). edges: src imports dst, distinct, no loops.

    Seeds are the files from the seed score on, or else the single best positive one; all three boosts read the same.
    """
    strong = scored.where(F.col("score") >= SEED).select("path")
    best = scored.where("score > 0").orderBy(F.desc("score"), "path").limit(1).select("path")
    seeds = strong.union(best.join(strong.agg(F.count(F.lit(1)).alias("n")), F.col("n") == 0).select("path")).select(F.col("path").alias("seed"))
    by_in = edges.join(seeds, edges.src == seeds.seed, "left_semi").groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n_in"))
    by_out = edges.join(seeds, edges.dst == seeds.seed, "left_semi").groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("n_out"))
    entries = entrypoints.select(F.col("path").alias("entry"))
    near = edges.join(entries, edges.src == entries.entry, "left_semi").select(F.col("dst").alias("path")).union(edges.join(entries, edges.dst == entries.entry, "left_semi").select("src")).distinct().withColumn("next", F.lit(True))
    out = by_in.join(by_out, "path", "full_outer").join(near, "path", "full_outer")
    boost = F.least(F.lit(GRAPH_CAP), IMPORTED_BOOST * F.coalesce("n_in", F.lit(0))) + F.least(F.lit(GRAPH_CAP), IMPORTS_BOOST * F.coalesce("n_out", F.lit(0)))
    return out.select("path", (boost + F.when(F.col("next"), ENTRY_BOOST).otherwise(0.0)).alias("boost"))


def history_adjustment(entries: DataFrame, task: list[str], least: float = 0.2, latest: int = 50) -> DataFrame:
    """(path, adjustment) from past runs (id, generated_at, keys, selected, ignored) with a task like the given one."""
    recent = entries.orderBy(F.desc("generated_at"), F.desc("id")).limit(latest)
    similar = recent.withColumn("similarity", F.when((F.size("keys") == 0) | F.lit(not task), 0.0).otherwise(S.set_similarity(F.col("keys"), F.array(*[F.lit(k) for k in task]), 0.0))).where(F.col("similarity") >= least)
    plus = similar.select(F.explode("selected").alias("path"), F.col("similarity").alias("up"), F.lit(0.0).alias("down"))
    minus = similar.select(F.explode("ignored").alias("path"), F.lit(0.0).alias("up"), F.col("similarity").alias("down"))
    sums = plus.union(minus).groupBy("path").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return sums.select("path", F.round(S.clamp(F.col("up") * 1.25, 0, 3) - S.clamp(F.col("down") * 0.35, 0, 3), 3).alias("adjustment"))


def final_rank(scored: DataFrame) -> DataFrame:
    """Scores held to 0..10, without zeros, ranked by score and path, by ranges of this order."""
    out = scored.withColumn("score", S.clamp(F.col("score"), 0, 10)).where("score > 0")
    return folds.running(out, [F.desc("score"), F.asc("path")], F.lit(1), "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out) of distinct edges without loops."""
    e = edges.where("src <> dst").distinct()
    each = e.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select(F.col("dst"), F.lit(1), F.lit(0)))
    return each.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(path, rank) with ranks that sum to 1. nodes: path, weight (restart vector, any positive scale).

    Dangling mass goes to the restart vector. Out-degrees count repeated edges and edges to unknown nodes, whose mass
    leaks and is made up for by scaling. Every round is checkpointed in the shared folder, so neither the plan nor what a
    lost executor costs grows with the rounds, and two totals of it reach the driver. tolerance None: all rounds.
    """
    shared_root(nodes.sparkSession)  # a session without a checkpoint folder gets one
    total = nodes.agg(F.sum("weight")).first()[0]
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    base = nodes.select("path", (F.col("weight") / F.lit(float(total or 1.0))).alias("restart")).join(out, F.col("path") == F.col("src"), "left").drop("src").checkpoint()
    known = edges.join(base.select(F.col("path").alias("dst")), "dst", "left_semi").checkpoint()
    ranks = base.withColumn("rank", F.col("restart")).withColumn("moved", F.lit(1.0))
    for _ in range(rounds):
        loose, moved = ranks.agg(F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum("moved"), F.lit(0.0))).first()
        if tolerance is not None and moved < tolerance:
            break
        shares = ranks.where("n is not null").select(F.col("path").alias("src"), (F.col("rank") / F.col("n")).alias("share"))
        got = known.join(shares, "src").groupBy("dst").agg(F.sum("share").alias("got"))
        new = (1 - damping + damping * loose) * F.col("restart") + damping * F.coalesce("got", F.lit(0.0))
        ranks = ranks.join(got, ranks.path == got.dst, "left").select("path", "restart", "n", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")).checkpoint()
    mass = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("path", (F.col("rank") / F.lit(float(mass or 1.0))).alias("rank"))


def blend(scored: DataFrame, ranks: DataFrame, weight: float = 0.4) -> DataFrame:
    """(path, blended): relevance as a share of the best, mixed with page rank."""
    top = scored.agg(F.max("score").alias("top"))
    out = scored.join(ranks, "path", "left").crossJoin(F.broadcast(top))
    return out.select("path", ((1 - weight) * F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0) + weight * F.coalesce("rank", F.lit(0.0))).alias("blended"))


def resolve(wanted: DataFrame, modules: DataFrame, separator: str = ".") -> DataFrame:
    """(spec, module): for each import spec the longest of itself and its prefixes that is a module's name.

    wanted: spec; modules: name, module, where the smallest module has a name that several claim.
    """
    parts = F.split("spec", f"[{separator}]")
    tried = wanted.select("spec").distinct().select("spec", F.explode(F.sequence(F.size(parts), F.lit(1))).alias("length"), parts.alias("parts"))
    tried = tried.select("spec", "length", F.array_join(F.slice("parts", F.lit(1), F.col("length")), separator).alias("name"))
    named = modules.groupBy("name").agg(F.min("module").alias("module"))
    return tried.join(named, "name").groupBy("spec").agg(F.max_by("module", "length").alias("module"))
