"""Failure blocks, recursive listings and tree listings of command output."""

import json
import random

from contextmill.operators import commands
from contextmill.operators import reports as R

PYTEST = """=== test session starts ===
__ not a block __
=== FAILURES ===
____ TestA.test_one ____

    def test_one(self):
>       assert 1 == 2
E       assert 1 == 2
E         + left

tests/t_a.py:12: AssertionError
lib/x.py:3: in f
____ test_two[a.b] ____
no marked line
=== short test summary info ===
FAILED tests/t_a.py::TestA::test_one - assert 1 == 2
FAILED tests/t_b.py::test_three - boom
=== 3 failed in 0.2s ==="""


def outputs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc long, text string")


def test_failure_blocks_meet_the_summary(spark):
    got = {(r.name, r.file, r.line, r.message) for r in R.merged_failures(outputs(spark, PYTEST, "", None)).collect()}
    assert got == {("tests/t_a.py::TestA::test_one", "tests/t_a.py", 12, "assert 1 == 2\n+ left"), ("test_two[a.b]", None, None, None), ("tests/t_b.py::test_three", "tests/t_b.py", None, "boom")}


def test_recursive_listings(spark):
    text = ".:\ntotal 8\ndrwxr-xr-x 2 u g 4096 Jan  1 00:00 src\n-rw-r--r--@ 1 u g 12 Jan  1 00:00 a b.txt\n\n./src/:\nlrwxrwxrwx 1 u g 3 Jan  1 00:00 l\n\nplain.py  dir/\n"
    got = [(r.path, r.kind, r["size"]) for r in R.ls_entries(outputs(spark, text, "", None)).orderBy("pos", "path").collect()]
    assert got == [("./src", "dir", 4096), ("./a b.txt", "file", 12), ("./src/l", "link", 3), ("dir", "dir", None), ("plain.py", "file", None)]
    top = R.top_folders(R.ls_entries(outputs(spark, text)), folders=1, names=1).collect()
    assert [(r.folder, r.entries, r.names) for r in top] == [("", 2, "dir")]


def drawn(folder, name="", lead=""):
    """A tree listing of nested dicts, and its paths in order."""
    text, paths = [], []
    for k, (child, below) in enumerate(folder.items()):
        last = k == len(folder) - 1
        text.append(lead + ("└── " if last else "├── ") + child)
        paths.append(name + child)
        more = drawn(below, f"{name}{child}/", lead + ("    " if last else "│   "))
        text += more[0]
        paths += more[1]
    return text, paths


def test_trees_are_rebuilt(spark):
    rng = random.Random(7)
    grow = lambda depth: {f"n{i} {depth}": grow(depth - 1) if rng.random() < 0.7 else {} for i in range(rng.randrange(4))} if depth else {}
    trees = [grow(6) | {"x": {}} for _ in range(8)]
    texts, wanted = zip(*(drawn(t) for t in trees), strict=True)
    got = R.tree_paths(outputs(spark, *(".\n" + "\n".join(t) + "\n\n3 directories, 4 files\nafter" for t in texts), "", None)).orderBy("doc", "pos").collect()
    assert [(r.doc, r.path) for r in got] == [(i, p) for i, paths in enumerate(wanted) for p in paths]
    assert all(r.depth == r.path.count("/") + 1 for r in got)


def test_log_rows_by_severity_and_what_is_no_record(spark):
    rng = random.Random(4)
    texts = []
    for k in range(400):
        kind = rng.random()
        level = rng.choice(["info", "debug", "ERROR", "Fatal", "warn", "odd", None])
        texts.append("plain" if kind < 0.05 else "[1]" if kind < 0.07 else " " if kind < 0.09 else json.dumps({"n": k} if kind < 0.12 else {"n": k, "severity": level} | ({"more": "x" * 300} if kind < 0.3 else {})))
    rows = [(k, t) for k, t in enumerate(texts)] + [(400, None)]
    parsed = [(k, t, json.loads(t)) for k, t in rows if t and t.startswith("{")]
    ranks = {x: n for n, x in enumerate(("fatal", "error", "warn", "warning", "info", "debug", "trace"))}
    level = lambda o: (o.get("severity") or "none").lower()
    clip = lambda t: t if len(t) <= 200 else t[:197] + "..."
    body = sorted(((ranks.get(level(o), 99), -k, level(o), clip(t)) for k, t, o in parsed if "severity" in o))[:30]
    rest = [(k, None, t) for k, t in rows if t in ("plain", "[1]")] + [(k, level(o), clip(t)) for k, t, o in parsed if "severity" not in o]
    want = [("record", n, -k, lv, t) for n, (_, k, lv, t) in enumerate(body, 1)] + [("outlier", n, *x) for n, x in enumerate(rest[:60], 1)]
    table = spark.createDataFrame(rows, "i long, line string").repartition(5)
    assert sorted(tuple(r) for r in commands.log_rows(table, outliers=60).collect()) == sorted(want)
    assert commands.log_rows(table.where("false")).count() == 0
    apart = spark.createDataFrame([(k, json.dumps({f"k{k}": 1})) for k in range(9)] + [(9, "x")], "i long, line string")
    assert [(r.kind, r.i) for r in commands.log_rows(apart).orderBy("place").collect()] == [("outlier", k) for k in range(8)]
