"""Leading lines of files that say nothing of them."""

import random
import re

from pyspark.sql import functions as F

from contextmill.functions import texts as X
from contextmill.operators import packing

PIECES = ["#!/bin/sh", "# -*- x", "# coding: y", "", "  ", "# a", "  # b", "/* c", "/* d */ e", "*/", "/*/", '"""f"""', '"""g', 'h"""', "'''i", "'''", "'''j'''", "import k", "x = 1", '""""', '"""""']
HEAD = re.compile(
    r"(?:[ ]*(?:#!|# -\*-|# coding)[^\n]*\n)*+(?:\s*\n)?+(?:[ ]*(?:/(?=\*)[\s\S]*?\*/[^\n]*\n|/\*[\s\S]*))?+(?:(?:[ ]*#[^\n]*\n){3,})?+"
    r"(?P<few>(?=[ ]*#))?(?(few)|(?:\s*\n)?+(?:[ ]*(?P<q>\"\"\"|''')(?:[^\n]*?(?P=q)[ ]*\n|[^\n]*\n(?:(?![^\n]*(?P=q))[^\n]*\n)*+(?:[^\n]*\n)?))?+(?:\s*\n)?+)"
)


def plain(lines):
    return HEAD.match("".join(x + "\n" for x in lines)).group().count("\n")


def test_boilerplate_equals_one_pattern(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice(PIECES) for _ in range(rng.randrange(12))]) for k in range(3000)]
    rows += [(3000, ["# x"] * 20_000 + ["y"]), (3001, ["/* x"] + ["z"] * 9000), (3002, [""] * 9000)]
    got = dict(spark.createDataFrame(rows, "k long, lines array<string>").select("k", X.boilerplate(F.col("lines"))).collect())
    wrong = [(lines[:12], got[k], plain(lines)) for k, lines in rows if got[k] != plain(lines)]
    assert not wrong, wrong[:3]


def test_summaries_begin_after_boilerplate(spark):
    text = '#!/usr/bin/env python\n# one\n# two\n# three\n\n"""About\nit."""\n\n' + "code()\n"
    files = spark.createDataFrame([("a.py", text, 0.0), ("b.py", "# one\n# two\n", 0.0), ("c.py", '"""all"""\n', 0.0)], "path string, text string, score double")
    got = {r.path: r.tokens for r in packing.tier_texts(files, ["zz"]).where("tier = 'summary'").collect()}
    assert got == {"a.py": 2, "b.py": 3, "c.py": 1}
