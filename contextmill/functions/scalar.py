"""Scalar functions: Column to Column, all of them built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token by model prefix; the first prefix that fits decides.
MODEL_RATIOS = {
    "o4-mini": 3.45, "o3": 3.45, "gpt-4o-mini": 3.5, "gpt-4o": 3.55, "gpt-4.1-mini": 3.55, "gpt-4.1": 3.6, "claude": 3.9, "codestral": 3.8, "mistral": 3.85,
    "ministral": 3.85, "devstral": 3.8, "local-llm": 4.0, "gpt-oss": 3.75, "llama": 4.0, "qwen": 3.9, "gemma": 4.0, "phi": 4.0,
}
DEFAULT_RATIO = 3.7
#: Words that are no keywords of a task.
STOP_WORDS = (
    "add fix for the with to and api refactor change update use from into make move also when that this based its per non via any few too yet now how why was has had but not all can may our let old "
    "file time self none true data"
).split()
#: Masks that turn a line into its skeleton, in this order.
TRACE_MASKS = [(r"\b0x[0-9a-fA-F]+\b", "<hex>"), (r"\b[0-9a-f]{12,}\b", "<id>"), (r"\b\d+\.\d+\b", "<f>"), (r"\b\d{2,}\b", "<n>"), (r"'[^']*'", "'<s>'"), ('"[^"]*"', '"<s>"')]
#: Masks of event messages, in this order.
EVENT_MASKS = [(r"\b[0-9a-f]{12,64}\b", "<id>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"), (r"\b\d+m?s\b", "<dur>"), (r"\b\d+\.\d+(?:KB|MB|GB|MiB|KiB|GiB)\b", "<size>"), (r"\b\d{4,}\b", "<n>")]


def rounded(x: Column | str, digits: int) -> Column:
    """A double with so many decimals: the product with the power of ten is rounded, halves away from zero.

    A half is one of the double product, not of the shortest decimal text (which ``round`` takes): 4.475 gives 4.47, as the
    double lies below.
    """
    scale = F.lit(float(10**digits))
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * scale) / scale


def tokens(text: Column, per_token: float = 4.0) -> Column:
    """0 for an empty or null text, else the characters by ``per_token``, rounded up."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.ceil(F.length(text) / F.lit(per_token))).cast("long")


def model_tokens(text: Column, model: Column | str) -> Column:
    """Tokens by the ratio of the first prefix of MODEL_RATIOS that the model's name begins with."""
    name = F.lower(F.lit(model) if isinstance(model, str) else model)
    ratio = F.coalesce(*[F.when(name.startswith(k), F.lit(v)) for k, v in MODEL_RATIOS.items()], F.lit(DEFAULT_RATIO))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.ceil(F.length(text) / ratio)).cast("long")


def occurrences(text: Column, key: str) -> Column:
    """How often a literal stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("long")


def keywords(task: Column, most: int = 16) -> Column:
    """Distinct lower-case identifiers of a task in order, camel-case parts after their word, without stop words."""
    words = F.regexp_extract_all(task, F.lit(r"[a-zA-Z][a-zA-Z0-9_]{2,}"), F.lit(0))
    parts = lambda w: F.split(w, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    pool = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), F.when(F.size(parts(w)) > 1, F.transform(parts(w), F.lower)).otherwise(F.array().cast("array<string>")))))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.array_distinct(F.filter(pool, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, most)


def path_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(path), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 4))


def abbreviated(path: Column, key: str) -> Column:
    """Whether a word of the path begins the keyword."""
    return F.exists(path_tokens(path), lambda w: F.lit(key).startswith(w))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _segment(markers: str) -> str:
    """Pattern for a marker as a whole path part, or as a piece of it between separators."""
    return rf"(?:^|/|[_-])(?:{markers})(?:$|/|[_-])"


def file_role(path: Column) -> Column:
    """generated, test, example, docs, config or prod; the first that fits."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    stem = F.regexp_replace(p, r"(?<=[^/])\.[^./]*$", "")
    config_folder = F.exists(F.slice(F.split(p, "/"), F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), lambda s: s.isin("config", "configs", "conf", ".github", ".circleci"))
    return (
        F.when(p.rlike(r"generated|__pycache__|_pb2|\.g\."), "generated")
        .when(p.rlike(_segment("test|tests|spec|__tests__|specs")) | stem.rlike(_segment("test|tests|spec|__tests__|specs")), "test")
        .when(p.rlike(_segment("example|examples|demo|demos|sample|samples")), "example")
        .when(p.rlike(r"[^/]\.(?:md|rst|txt|adoc)$") | p.rlike("(?:^|/)(?:docs|doc|documentation)(?:/|$)"), "docs")
        .when(p.rlike(r"[^/]\.(?:toml|yaml|yml|json|cfg|ini|env)$") & ((F.size(F.split(p, "/")) <= 2) | config_folder), "config")
        .otherwise("prod")
    )


def test_base(name: Column) -> Column:
    """The source stem that a test file's name refers to; null if it is no test."""
    found = [F.regexp_extract(name, p, 1) for p in (r"^test_(.+)\.py$", r"^(.+)_test\.py$", r"^(.+)_test\.go$", r"^(.+)\.(?:test|spec)\.(?:ts|tsx|js|jsx|mjs|cjs)$")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def line_count(text: Column) -> Column:
    """Lines of a text; a last one without a line break counts."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.when(F.length(text) == 0, 0).otherwise(breaks + (~text.endswith("\n")).cast("int"))).cast("long")


def set_similarity(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def line_similarity(a: Column, b: Column) -> Column:
    return set_similarity(F.array_distinct(F.split(a, "\n")), F.array_distinct(F.split(b, "\n")), 1.0)


def shingles(lines: Column, n: int = 3) -> Column:
    """Runs of n lines, joined; a shorter text is one run."""
    runs = F.transform(F.sequence(F.lit(1), F.size(lines) - (n - 1)), lambda i: F.array_join(F.slice(lines, i, n), "\n"))
    return F.when(F.size(lines) >= n, runs).otherwise(F.array(F.array_join(lines, "\n")))


def pct_change(old: Column, new: Column) -> Column:
    """In percent with two decimals; growth from zero is 100, and zero to zero is 0."""
    grown = F.when(new > 0, 100.0).when(new < 0, -100.0).otherwise(0.0)
    return F.when(old == 0, grown).otherwise(F.round((new - old) / old * 100, 2)).cast("double")


def drift_verdict(pct: Column, threshold: float = 10.0) -> Column:
    x = F.abs(pct)
    return F.when(x < threshold, "none").when(x < 25, "low").when(x < 50, "moderate").when(x < 100, "significant").otherwise("critical")


def coverage_risk(covered: Column) -> Column:
    return F.when(covered >= 0.8, "low").when(covered >= 0.4, "medium").otherwise("high")


def pack_risk(skipped: Column, ranked: Column, packed_tokens: Column, raw_tokens: Column, degraded: Column, included: Column, budget: Column, skip_weight: float = 0.55, loss_weight: float = 0.45) -> Column:
    """low, medium or high by what a pack leaves out; over its budget it is high."""
    loss = 1 - F.least(F.lit(1.0), packed_tokens / F.greatest(raw_tokens, F.lit(1)))
    deep = F.greatest(F.lit(0.0), loss - 0.5) / 0.5
    content = F.greatest(deep, F.when((degraded > 0) & (included > 0), F.least(F.lit(1.0), degraded / F.greatest(included, F.lit(1)))).otherwise(0.0))
    score = (skip_weight * (skipped / F.greatest(ranked, F.lit(1))) + loss_weight * content) / (skip_weight + loss_weight)
    return F.when((budget > 0) & (packed_tokens > budget), "high").when(score < 0.25, "low").when(score < 0.5, "medium").otherwise("high")


def usd(n: Column, per_million: Column | float) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(n / F.lit(1_000_000.0) * per_million)


def savings_stage(cache_status: Column, strategy: Column, chunk_strategy: Column) -> Column:
    c, s, k = (F.coalesce(x, F.lit("")) for x in (cache_status, strategy, chunk_strategy))
    return (
        F.when(c == "reused", "cache_reuse").when((s == "symbol") | k.startswith("symbol-extract"), "symbol_extraction").when((s == "slice") | k.startswith("lang-"), "slicing")
        .when((s == "summary") | k.startswith("summary"), "compression").when((s == "snippet") | k.startswith("snippet"), "snippet").otherwise("full")
    )


def folders(path: Column) -> Column:
    """All folders above a file, the outermost first; none for a file at the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def masked(text: Column, rules: list[tuple[str, str]] = TRACE_MASKS) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def clipped(text: Column, most: int, mark: str = "...") -> Column:
    """At most so many characters, the last of them the mark if something is missing."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def plain_terminal(text: Column) -> Column:
    """Without escape sequences; of a line that carriage returns overwrite, the last state."""
    clean = F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)", "")
    clean = F.regexp_replace(clean, "\r\n", "\n")
    return F.array_join(F.transform(F.split(clean, "\n"), lambda s: F.element_at(F.split(s, "\r"), -1)), "\n")


def tightened(text: Column) -> Column:
    """Three and more line breaks become two; blanks after ``,`` and ``:`` one. Lines keep their indent."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?<=\S)([,:])[ ]{2,}", "$1 ")


def reduction_pct(before: Column, after: Column) -> Column:
    return F.when(before <= 0, F.lit(0.0)).otherwise(100.0 * (1 - after / before)).cast("double")


def complexity(lines: Column, symbols: Column, branches: Column, imports: Column) -> Column:
    return rounded(lines / 60.0 + symbols * 1.2 + branches * 0.75 + imports * 0.6, 2)


def normalised_prompt(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def extrapolated_tokens(preview_tokens: Column, size: Column, preview_size: Column) -> Column:
    return F.when(preview_size <= 0, preview_tokens).otherwise(F.greatest(preview_tokens, F.ceil(preview_tokens * size / F.greatest(preview_size, F.lit(1))))).cast("long")


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / float(1 << 20)), F.lit(" MB")))
    )


def level_for(raw: Column, remaining: Column, most: Column, floor: str = "ultra") -> Column:
    """The most detailed level whose estimated size fits the cap and 30 % of what remains, raised to the floor."""
    room = F.least(most.cast("double"), remaining * 0.30)
    level = F.when(raw <= room, 0).when(raw * 0.15 <= room, 1).otherwise(2)
    names = F.array(*[F.lit(x) for x in ("verbose", "compact", "ultra")])
    return F.element_at(names, F.least(level, F.lit(("verbose", "compact", "ultra").index(floor))) + 1)


def preserved(raw: Column, out: Column, patterns: list[str]) -> Column:
    """Whether every pattern that the raw text has also stands in the output."""
    kept = F.lit(True)
    for p in patterns:
        kept = kept & (~raw.rlike(f"(?m){p}") | out.rlike(f"(?m){p}"))
    return kept


def utc_time(text: Column) -> Column:
    """ISO time; null if it is none."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def number(text: Column) -> Column:
    """A whole number; 0 if it is missing or none."""
    return F.coalesce(text.try_cast("long"), F.lit(0))


def glob_pattern(glob: str) -> str:
    """Regular expression for a glob that a path's whole or its last parts match."""
    out = ""
    for c in glob:
        out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
    return f"^(?:.*/)?{out}$"
