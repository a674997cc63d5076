"""Text functions: path kinds, digests, substitutions, certificates and strippers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextmill.functions import scalar as S

#: Parts of paths of test files, and of files that hold helpers.
TESTS = ("test_", "_test.", "/test/", "/tests/", "spec_", "_spec.")
HELPERS = ("/config.", "/config/", "helpers.", "utils.", "/utils/", "validators.", "constants.", "settings.", "/types.", "exceptions.", "errors.")
#: Fixed values: (long form, short form, schemas in which it holds; empty: all), in the order in which they are tried.
SUBSTITUTIONS = [
    ("Traceback (most recent call last):", "TB:", ()), ("Installing collected packages: ", "Pkgs: ", ("pkg_install",)), ("AssertionError: assert ", "AE: ", ()), ("AttributeError: ", "AttrE: ", ()),
    ("diff --git summary:", "git diff:", ("git_diff",)), ("Successfully built ", "OK ", ("docker",)), (" > 100 characters)", ">100)", ("lint",)), (" > 100 characters", ">100", ("lint",)),
    ("DEPRECATION:", "DEP:", ("pkg_install",)), (" line too long ", " ll ", ("lint",)), (" matches in ", " m/", ("grep",)), ("kubectl get ", "kg ", ("kubectl_get",)), ("Collecting ", "C ", ("pkg_install",)),
    ("more hunks", "more h", ("git_diff",)), ("AssertionError", "AE", ()), ("grep: no matches", "g:0", ("grep",)), (" (binary)", " bin", ("git_diff",)), (", behind ", " -", ("git_status",)), (" failed, ", " F/", ()),
    ("ahead ", "+", ("git_status",)), ("grep: ", "g:", ("grep",)), ("Step ", "S", ("docker",)), ("log: ", "log:", ("git_log",)), (" -> ", "->", ()),
]


def _has_part(path: Column, parts: tuple[str, ...]) -> Column:
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def is_test_path(path: Column) -> Column:
    return _has_part(path, TESTS)


def is_helper_path(path: Column) -> Column:
    return _has_part(path, HELPERS)


def substituted(text: Column, schema: Column | str, table: list = SUBSTITUTIONS) -> Column:
    """The text with each short form that makes its tokens fewer, one after the other."""
    name = F.lit(schema) if isinstance(schema, str) else schema
    rules = F.array(*[F.struct(F.lit(a).alias("long"), F.lit(b).alias("short"), F.array(*map(F.lit, scope)).cast("array<string>").alias("scope")) for a, b, scope in table])

    def step(s: Column, r: Column) -> Column:
        new = F.replace(s, r["long"], r["short"])
        return F.when(((F.size(r["scope"]) == 0) | F.array_contains(r["scope"], name)) & (S.tokens(new) < S.tokens(s)), new).otherwise(s)

    return F.aggregate(rules, text, step)


def fragment_key(path: Column, ranges: Column, text: Column) -> Column:
    """Key of a fragment: path, its ranges (array of start and end) and the digest of its text."""
    where = F.when(F.size(ranges) > 0, F.concat(F.lit("ranges="), F.array_join(F.transform(ranges, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ","))).otherwise("ranges=unknown")
    return F.concat(F.lit("fragment:"), path, F.lit(":"), where, F.lit(":"), F.sha2(text, 256))


def reference_id(key: Column, prefix: str = "frag") -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(key, 256), 1, 16))


def command_key(argv: Column, folder: Column, state: Column) -> Column:
    """Digest of a command: its words, folder and what it depends on, each ended by a zero byte."""
    end = F.lit(b"\x00")
    words = F.array_join(F.transform(argv, lambda a: F.concat(a, F.lit("\x00"))), "")
    return F.sha2(F.concat(words.cast("binary"), folder.cast("binary"), end, F.coalesce(state, F.lit("")).cast("binary"), end), 256)


def repository_ids(path: Column) -> tuple[Column, Column]:
    """Digests of a repository's path and of the folder above it, in place of the paths."""
    digest = lambda p: F.concat(F.lit("sha256:"), F.sha2(p, 256))
    above = F.regexp_replace(path, "/[^/]*$", "")
    return digest(path), digest(F.when(above == "", "/").otherwise(above))


def certificate(text: Column, patterns: list[str]) -> Column:
    """16 hexadecimal digits for all matches of the patterns, in order of pattern and match; empty without patterns.

    A match counts as its pattern's number (4 bytes), a zero byte, its bytes and a byte of 1.
    """
    if not patterns:
        return F.lit("")

    def framed(k: int, pattern: str) -> Column:
        found = F.array_sort(F.regexp_extract_all(text, F.lit(f"(?m)({pattern})"), F.lit(1)))
        return F.transform(found, lambda m: F.concat(F.lit(k.to_bytes(4, "big")), F.lit(b"\x00"), m.cast("binary"), F.lit(b"\x01")))

    found = F.concat(*[framed(k, p) for k, p in enumerate(patterns)])
    whole = F.aggregate(found, F.lit("").cast("binary"), lambda s, x: F.concat(s, x))
    return F.substring(F.sha2(whole, 256), 1, 16)


def without_dividers(text: Column) -> Column:
    """Without comment lines of fifteen and more signs."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*#\s*[-=*#_]{15,}\s*$")), "\n")


def single_blank_lines(text: Column) -> Column:
    """Of blank lines that follow each other only the first."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, i: (F.trim(x) != "") | (i == 0) | (F.trim(F.get(lines, i - 1)) != "")), "\n")


def without_docstrings(text: Column) -> Column:
    """Without the triple-quoted text that follows the line of a function or class, with the blank lines before it."""
    head = r"(?m)^([ \t]*(?:def |async def |class |\):)[^\n]*:[ \t]*)\n(?:[ \t]*\n)*"
    out = text
    for quote in ('"""', "'''"):
        out = F.regexp_replace(out, head + rf"[ \t]*{quote}(?s:.*?){quote}[^\n]*(?:\n|\z)", "$1\n")
    return out


def shortened_blocks(text: Column, most: int = 7, keep: int = 3) -> Column:
    """Literals opened at a line's end with more than ``most`` entry lines, closed at the indent they began at: the first ``keep``, a count, and the end."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit("").alias("indent"), F.lit(False).alias("open"))
    opens = r"^(\s*)[\w.]+(?:\s*:\s*[^=]+)?\s*=\s*[\[{(]\s*$"

    def step(s: Column, line: Column) -> Column:
        closes = s["open"] & line.rlike(r"^\s*[\]})]") & (F.regexp_extract(line, r"^(\s*)", 1) == s["indent"])
        n = F.size(s["held"])
        inner = F.regexp_extract(F.get(s["held"], F.lit(0)), r"^(\s*)", 1)
        short = F.concat(F.slice(s["held"], 1, keep), F.array(F.concat(inner, F.lit("# ... ("), (n - keep).cast("string"), F.lit(" more entries)"))))
        flushed = F.concat(s["out"], F.when(closes & (n > most), short).otherwise(s["held"]), F.array(line))
        ended = F.struct(flushed.alias("out"), F.array().cast("array<string>").alias("held"), F.when(~s["open"] & line.rlike(opens), F.regexp_extract(line, r"^(\s*)", 1)).otherwise("").alias("indent"), (~s["open"] & line.rlike(opens)).alias("open"))
        return F.when(s["open"] & ~closes, F.struct(s["out"].alias("out"), F.concat(s["held"], F.array(line)).alias("held"), s["indent"].alias("indent"), F.lit(True).alias("open"))).otherwise(ended)

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(F.concat(s["out"], s["held"]), "\n"))


def boilerplate(lines: Column) -> Column:
    """How many of a file's first lines say nothing of it: an interpreter or encoding line, a block comment, three or more
    lines of ``#`` comments, a quoted text before any code, in this order, and blank lines around them. Null: null."""
    quotes = ('"""', "'''")

    def step(a: Column, line: Column) -> Column:
        text = F.btrim(line, F.lit(" \t\r\n\f\x0b"))
        at, n, marks = a["at"], a["n"], a["marks"]
        to = lambda where, skipped, marked=None: F.struct(F.lit(where).alias("at") if isinstance(where, int) else where.alias("at"), skipped.alias("n"), (F.lit(0) if marked is None else marked).alias("marks"))
        blank, closed = text == "", F.when(line.contains("*/"), 3).otherwise(2)
        whole = lambda q: text.startswith(q) & text.endswith(q) & (F.length(text) >= 6)
        # at: 0 and 1 before comments, 2 in a block comment, 3 in comments, 4 after them, 5 and 7 in a quoted text, 6 after it, 9 in the file's own lines
        out = F.when(at == 9, a).when((at == 0) & text.rlike(r"^(?:#!|# -\*-|# coding)"), to(0, n + 1)).when((at <= 1) & blank, to(1, n + 1))
        out = out.when(((at <= 1) & text.startswith("/*")) | (at == 2), to(closed, n + 1)).when((at <= 3) & text.startswith("#"), to(3, n, marks + 1))
        out = out.when((marks > 0) & (marks < 3), to(9, n)).when((at <= 4) & blank, to(4, n + marks + 1))
        for place, q in zip((5, 7), quotes, strict=True):
            out = out.when((at <= 4) & whole(q), to(6, n + marks + 1)).when((at <= 4) & text.startswith(q), to(place, n + marks + 1))
            out = out.when(at == place, to(F.when(line.contains(q), 6).otherwise(place), n + 1))
        return out.when((at == 6) & blank, to(6, n + 1)).otherwise(to(9, n + marks))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("marks"))
    return F.aggregate(lines, start, step, lambda a: a["n"] + F.when(a["marks"] >= 3, a["marks"]).otherwise(0))
