"""File scans: a folder tree as a table of classified files, and its change against the scan before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions import scalar as S
from contextmill.operators import state

#: Folders that no scan enters.
IGNORED_FOLDERS = (".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "dist", "build", "coverage", ".pytest_cache", "__pycache__", ".venv", "venv")
#: Files that commonly hold credentials.
SECRETS = (
    ".env .env.* *.env env.*.local *.pem *.key *.pfx *.p12 *.keystore *.jks id_rsa id_rsa.* id_dsa id_ecdsa id_ed25519 id_ed25519.* *.ppk *.tfvars *.tfvars.json secrets.* *secrets.y*ml credentials credentials.* "
    "*credentials.json .npmrc .pypirc .netrc .htpasswd .pgpass .aws/credentials .aws/config .ssh/* gcp-*.json service-account*.json serviceaccount*.json"
).split()
PREVIEW = 2000
#: Files that runs of this library leave in a tree: no part of what the next run scans.
ARTIFACTS = ("run.json", "run.md", "contextmill-plan*.json", "contextmill-plan*.md", "contextmill-dataset*.json", "contextmill-dataset*.md", "*.contextmill_cache.json")


def matches(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether the whole path or its last parts match one of the globs."""
    return path.rlike("|".join(f"(?:{S.glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def gitignore(text: str) -> list[str]:
    """Globs of an ignore file: comments, negations and ``**`` are left out."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if rule and rule[0] not in "#!" and "**" not in rule:
            rule = rule.lstrip("/")
            out += [rule.rstrip("/") + "/*"] if rule.endswith("/") else [rule, rule + "/*"]
    return out


def fingerprint(settings: dict) -> str:
    """Digest of a scan's settings; another one makes an older snapshot useless."""
    import hashlib
    import json

    return hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), max_bytes: int = 1 << 20, most: int | None = 50_000) -> DataFrame:
    """file, path, size, stamp of the files below a folder, and kind of those that their name or size decides; no content is read.

    Spark's file source lists no names that begin with a point or underscore. With ``most`` the listing ends after so many
    files in order of path.
    """
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^/*(?=" + base.lstrip("/").replace(".", "\\.") + ")" + base.lstrip("/").replace(".", "\\."), "")
    pruned = F.exists(F.split("path", "/"), lambda p: p.isin(*IGNORED_FOLDERS) | p.startswith(".venv") | p.startswith("venv-"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = read.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("stamp")).withColumn("file", F.col("path")).withColumn("path", path)
    kind = F.when(pruned | matches(F.col("path"), [*SECRETS, *ARTIFACTS]), "excluded").when(matches(F.col("path"), ignore), "ignored").when(F.col("size") > max_bytes, "too_large")
    listed = listed.select("file", "path", "size", "stamp", kind.alias("kind"))
    return listed if most is None else listed.orderBy("path").limit(most)


def described(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """The record of each listed file: path, size, stamp, kind, and for included ones content_hash, line_count, preview,
    symbols and imports. texts: file, content of those whose kind is open; a file without content is unreadable."""
    zero = F.hex(F.substring("content", 1, 1024)).rlike("^(?:..)*?00")
    rows = listed.where("kind is null").join(texts, "file", "left").withColumn("kind", F.when(F.col("content").isNull(), "unreadable").when(zero, "binary").otherwise("included"))
    rows = rows.withColumn("text", F.when(F.col("kind") == "included", F.decode("content", "UTF-8"))).drop("content").unionByName(listed.where("kind is not null"), allowMissingColumns=True)
    return rows.select("path", "size", "stamp", "kind", F.sha1("text").alias("content_hash"), S.line_count(F.col("text")).alias("line_count"), F.substring("text", 1, PREVIEW).alias("preview"), symbols(F.col("text")).alias("symbols"), imports(F.col("path"), F.col("text")).alias("imports"))


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), max_bytes: int = 1 << 20, most: int | None = 50_000, label: str = "") -> DataFrame:
    """The records of all files below a folder (``listing``, ``described``).

    kind is the first that fits of excluded (ignored folders, secrets, results of earlier runs), ignored, too_large,
    unreadable, binary, included. Only paths are ordered, and only files that may be included are read.
    """
    listed = listing(spark, root, ignore, max_bytes, most)
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes).select(F.col("path").alias("file"), "content")
    out = described(listed, texts)
    return out.withColumn("path", F.concat(F.lit(f"{label}:"), F.col("path"))) if label else out


def symbols(text: Column) -> Column:
    """Names of functions and classes that lines define."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"), F.lit(1))


def imports(path: Column, text: Column) -> Column:
    """Import specs of Python, script and Go files, sorted.

    Names that a ``from`` line imports count as modules below the one named too.
    """
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    name = lambda x: F.regexp_extract(F.trim(x), r"^(\S*)", 1)
    plain = F.transform(F.flatten(F.transform(every(r"(?m)^[ \t]*import[ \t]+([^\n#(\"']+)"), lambda x: F.split(x, ","))), name)
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*from[ \t]+[.\w]+[ \t]+import[ \t]+[^\n#]+"), F.lit(0))
    module = lambda x: F.regexp_extract(x, r"^[ \t]*from[ \t]+([.\w]+)", 1)
    names = lambda x: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(x, r"import[ \t]+(.*)$", 1), r"[()]", ""), ","), name), lambda n: ~n.isin("", "*"))
    below = lambda x: F.transform(names(x), lambda n: F.concat(module(x), F.when(module(x).endswith("."), "").otherwise("."), n))
    python = F.concat(plain, F.transform(lines, module), F.flatten(F.transform(lines, below)))
    script = F.concat(every(r"""\bfrom\s+['"]([^'"]+)['"]"""), every(r"""\bimport\s*\(?\s*['"]([^'"]+)['"]"""), every(r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""))
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*import[ \t]*\(([^)]*)\)"), F.lit(1))
    go = F.concat(every(r'(?m)^[ \t]*import[ \t]+"([^"]+)"[ \t]*$'), F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'(?m)^[ \t]*"([^"]+)"[ \t]*$'), F.lit(1)))))
    kinds = F.when(path.endswith(".py"), python).when(path.rlike(r"\.(?:tsx?|jsx?|mjs|cjs)$"), script).when(path.endswith(".go"), go)
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda x: x != "")))


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two scans: added, updated, removed, or reused where size and time are the same."""
    return state.snapshot_diff(old, new)


def workspace(scans: dict[str, DataFrame]) -> DataFrame:
    """Scans of several repositories as one, each path after its label."""
    out = None
    for label, df in scans.items():
        named = df.withColumn("path", F.concat_ws(":", F.lit(label), F.col("path")))
        out = named if out is None else out.unionByName(named)
    return out


ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "strategy", "chunk_strategy", "cache_status")] + [T.StructField(n, T.LongType()) for n in ("original_tokens", "compressed_tokens")])
ARTIFACT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("command", "generated_at", "task", "repo")], T.StructField("files_included", T.ArrayType(T.StringType())), T.StructField("files_skipped", T.ArrayType(T.StringType())),
    T.StructField("compressed_context", T.ArrayType(ENTRY)), T.StructField("budget", T.StructType([T.StructField("estimated_input_tokens", T.LongType()), T.StructField("estimated_saved_tokens", T.LongType()), T.StructField("quality_risk_estimate", T.StringType())])),
    T.StructField("_broken", T.StringType()),
])


def artifacts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Run artifacts (JSON files below a folder) and the files that are none, with the reason."""
    rows = spark.read.schema(ARTIFACT).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root).withColumn("file", F.input_file_name())
    reason = F.when(F.col("_broken").isNotNull(), "invalid json").when(F.col("compressed_context").isNull(), "not a pack artifact")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason", "_broken").withColumn("at", S.utc_time(F.col("generated_at"))), rows.where("reason is not null").select("file", "reason")


def entries(runs: DataFrame) -> DataFrame:
    """Packed entries of artifacts as the analytics take them."""
    e = runs.select(F.col("file").alias("run"), F.posexplode("compressed_context").alias("position", "e"))
    return e.select("run", "position", "e.path", F.coalesce("e.original_tokens", F.lit(0)).cast("long").alias("original"), F.coalesce("e.compressed_tokens", F.lit(0)).cast("long").alias("compressed"), "e.strategy", F.coalesce("e.cache_status", F.lit("")).alias("cache_status"))
