"""Units and invariants of the operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextmill.functions import scalar as S
from contextmill.operators import analytics, commands, packing, ranking, state
from contextmill.sources import scan, stores
from contextmill.streaming import sessions


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_one")).select(column.alias("x")).first().x


def test_tokens_and_ratios(spark):
    for text, want in (("", 0), ("abcd", 1), ("abcde", 2), ("é" * 9, 3)):
        assert one(spark, S.tokens(F.col("t")), t=text) == want
    assert one(spark, S.model_tokens(F.col("t"), "gpt-4o-mini-2"), t="x" * 35) == 10 and one(spark, S.model_tokens(F.col("t"), "other"), t="x" * 37) == 10


def test_keywords(spark):
    assert one(spark, S.keywords(F.col("t")), t="Fix the UserService JWT auth in user_service, use HTTPServer") == ["userservice", "user", "service", "jwt", "auth", "user_service", "httpserver", "http", "server"]


@pytest.mark.parametrize("path,role", [
    ("src/app.py", "prod"), ("src/test_app.py", "test"), ("src/contest.py", "prod"), ("pkg/auth_test/x.go", "test"), ("docs/a.py", "docs"), ("README.md", "docs"), ("demo/a.py", "example"), ("a/b.toml", "config"), ("a/b/c.toml", "prod"),
    (".github/x/ci.yml", "config"), ("gen/generated_api.py", "generated"), ("m_pb2.py", "generated"), ("spec/test.md", "test"),
])
def test_roles(spark, path, role):
    assert one(spark, S.file_role(F.col("p")), p=path) == role


def test_changes_bands_and_risk(spark):
    cases = [(0, 0, 0.0), (0, 5, 100.0), (100, 150, 50.0), (3, 1, -66.67)]
    assert [one(spark, S.pct_change(F.col("a"), F.col("b")), a=a, b=b) for a, b, _ in cases] == [c for *_, c in cases]
    assert [one(spark, S.drift_verdict(F.col("a")), a=x) for x in (9.9, -10.0, 25.0, 99.9, 100.0)] == ["none", "low", "moderate", "significant", "critical"]
    risk = lambda *v: one(spark, S.pack_risk(*[F.col(c) for c in "abcdefg"]), **dict(zip("abcdefg", v, strict=True)))
    assert risk(0, 10, 100, 100, 0, 10, 50) == "high" and risk(0, 10, 100, 100, 0, 10, 500) == "low" and risk(5, 10, 100, 1000, 0, 5, 500) == "high"


def test_texts(spark):
    assert one(spark, S.plain_terminal(F.col("t")), t="\x1b[31mred\x1b[0m\n10%\r20%\r30%\nend") == "red\n30%\nend"
    assert one(spark, S.masked(F.col("t")), t="at 0x1f 12 3.5 'a b' deadbeef0123") == "at <hex> <n> <f> '<s>' <id>"
    assert one(spark, S.folders(F.col("t")), t="a/b/c.py") == ["a", "a/b"] and one(spark, S.folders(F.col("t")), t="c.py") == []
    assert one(spark, S.clipped(F.col("t"), 6), t="abcdefgh") == "abc..." and one(spark, S.line_count(F.col("t")), t="a\nb") == 2 and one(spark, S.line_count(F.col("t")), t="a\n") == 1
    assert one(spark, S.tightened(F.col("t")), t="a,   b\n\n\n\nc:  d\n    e") == "a, b\n\nc: d\n    e" and one(spark, S.human_bytes(F.col("t")), t=2048) == "2.0 KB"
    assert one(spark, S.test_base(F.col("t")), t="foo.spec.ts") == "foo" and one(spark, S.test_base(F.col("t")), t="foo.ts") is None
    assert one(spark, S.number(F.col("t")), t="3.7") in (0, 3) and one(spark, S.number(F.col("t")), t="x") == 0
    assert one(spark, S.preserved(F.col("a"), F.col("b"), [r"^FAILED \S+", "absent"]), a="x\nFAILED t", b="FAILED t") and not one(spark, S.preserved(F.col("a"), F.col("b"), [r"^FAILED \S+"]), a="x\nFAILED t", b="x")


def python_fold(items, budget):
    used, out = 0, []
    for rank, tokens in sorted(items):
        if used + tokens <= budget:
            used += tokens
            out.append((rank, used))
    return out


def test_packers_against_python(spark):
    rng = random.Random(2)
    rows = [(p, k, rng.randrange(1, 60), float(rng.randrange(5))) for p in range(20) for k in range(rng.randrange(1, 15))]
    ranked = spark.createDataFrame(rows, "pack long, rank long, tokens long, relevance double")
    want = {(p, *x) for p in range(20) for x in python_fold([(k, t) for q, k, t, _ in rows if q == p], 100)}
    assert {tuple(r) for r in packing.greedy_skip(ranked, 100, ["pack"]).collect()} == want
    stop = {(r.pack, r["rank"]) for r in packing.prefix_stop(ranked, 100, ["pack"]).collect()}
    assert stop <= {x[:2] for x in want}
    tiered = ranked.withColumn("tiers", F.array("tokens", F.ceil(F.col("tokens") / 2), F.ceil(F.col("tokens") / 5)))
    best = {(r.pack, r["rank"]): r.tokens for r in packing.best_tiers(tiered, 100, ["pack"]).collect()}
    more = {(r.pack, r["rank"]): r.tokens for r in packing.progressive(tiered, 100, "pack").collect()}
    assert set(best) <= set(more)
    for p in range(20):
        assert sum(t for (q, _), t in more.items() if q == p) <= 100 and sum(t for (q, _), t in best.items() if q == p) <= 100


def test_rank_boosts(spark):
    files = spark.createDataFrame([("a/auth.py", "login auth auth", 2.5), ("a/test_auth.py", "", 0.0), ("b/x.py", "", 0.1)], "path string, text string, score double").withColumn("repo", F.lit("r"))
    pairs = ranking.test_pairs(files)
    assert [tuple(r) for r in pairs.collect()] == [("a/test_auth.py", "a/auth.py")]
    assert {r.path: r.score for r in ranking.pair_boost(files, pairs).collect()} == {"a/auth.py": 2.5, "a/test_auth.py": 2.0, "b/x.py": 0.1}
    edges = spark.createDataFrame([("a/auth.py", "b/x.py"), ("b/x.py", "a/test_auth.py")], "src string, dst string")
    boosts = {r.path: r.boost for r in ranking.one_hop(files, edges, spark.createDataFrame([("b/x.py",)], "path string")).collect()}
    assert boosts == {"b/x.py": pytest.approx(0.9), "a/auth.py": pytest.approx(0.45), "a/test_auth.py": pytest.approx(0.45)}
    assert [r.path for r in ranking.final_rank(files.withColumn("score", F.col("score") * 10)).collect()] == ["a/auth.py", "b/x.py"]


def test_pagerank_against_numpy(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    edges = [(rng.choice(names[:9]), rng.choice(names)) for _ in range(30)]
    got = {r.path: r["rank"] for r in ranking.pagerank(spark.createDataFrame([(n, 1.0) for n in names], "path string, weight double"), spark.createDataFrame(edges, "src string, dst string"), rounds=12, tolerance=None).collect()}
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((12, 12))
    for a, b in edges:
        m[at[b], at[a]] += 1
    out = m.sum(0)
    r = base = np.full(12, 1 / 12)
    for _ in range(12):
        r = 0.15 * base + 0.85 * (m @ np.where(out > 0, r / np.maximum(out, 1), 0) + r[out == 0].sum() * base)
    assert got == {n: pytest.approx(r[at[n]] / r.sum()) for n in names}


def test_resolve(spark):
    wanted = spark.createDataFrame([("a.b.c",), ("x.y",), ("a",)], "spec string")
    modules = spark.createDataFrame([("a", "a/__init__.py"), ("a.b", "a/b.py")], "name string, module string")
    assert {tuple(r) for r in ranking.resolve(wanted, modules).collect()} == {("a.b.c", "a/b.py"), ("a", "a/__init__.py")}


def test_heatmap_counts_repeats_once_a_run(spark):
    e = spark.createDataFrame([("r1", "a/x.py", 100, 40), ("r1", "a/x.py", 10, 20), ("r2", "b.py", 50, 50)], "run string, path string, original long, compressed long")
    rows = {r.path: r for r in analytics.heatmap(e).collect()}
    assert (rows["a/x.py"].inclusions, rows["a/x.py"].runs, rows["a/x.py"].saved_tokens, rows["a/x.py"].inclusion_rate) == (2, 1, 60, 0.5)
    assert [r.path for r in analytics.folder_heatmap(e).collect()] == ["a"]


def test_command_parsers(spark):
    out = lambda text: spark.createDataFrame([(1, text)], "doc long, text string")
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-old\n+new\n+more\ndiff --git a/y b/y\n@@ -1 +1 @@\n-z"
    assert {(r.file, r.added, r.removed, r.hunks) for r in commands.git_diff(out(diff)).collect()} == {("x.py", 2, 1, 1), ("y", 0, 1, 1)}
    assert {(r.state, r.files) for r in commands.git_status(out("## main\n M a\nA  b\n?? c\nUU d\n M e")).collect()} == {("unstaged", 2), ("staged", 1), ("untracked", 1), ("conflicted", 1)}
    log = "commit abcdef1\nAuthor: Ann B <a@b>\nDate: x\n\n    Subject one\n\n    Body\ncommit abcdef2\nAuthor: C\n\n    Two"
    assert {(r.commit, r.author, r.subject) for r in commands.git_log(out(log)).collect()} == {("abcdef1", "Ann B", "Subject one"), ("abcdef2", "C", "Two")}
    lint = "a.py:3:1: E501 too long\nb.py:7: error: bad thing  [arg-type]\nb.py:9:2: note: see above\nnoise"
    assert [(r.path, r.line_no, r.severity, r.code) for r in commands.lint(out(lint)).orderBy("pos").collect()] == [("a.py", 3, "error", "E501"), ("b.py", 7, "error", "arg-type"), ("b.py", 9, "note", None)]
    events = spark.createDataFrame([(0, "W", "r", "o", 2, "wait 12345", "1m"), (1, "W", "r", "o", 3, "wait 99999", "")], "pos long, type string, reason string, object string, count long, message string, seen string")
    assert tuple(commands.kube_events(events).first()) == ("W", "r", "o", 5, "wait <n>", "1m")
    nodes = spark.createDataFrame([(1, 1, 0, "A", 100, 1), (1, 2, 1, "B", 30, 2), (1, 3, 2, "C", 10, 1), (1, 4, 1, "D", 20, 1)], "plan long, pos long, depth long, op string, ms long, loops long")
    assert {(r.op, r.self_ms) for r in commands.self_times(nodes).collect()} == {("A", 20), ("B", 50), ("C", 10), ("D", 20)}


def test_state_operators(spark):
    calls = spark.createDataFrame([(1, "k", 1, "a\nb\nc\nlong line here"), (2, "k", 2, "a\nb\nc\nlong line here too"), (3, "k", 3, "zzz")], "id long, key string, ts long, text string")
    got = {r.id: r.delta for r in state.snapshot_choice(calls, "key", ["ts", "id"]).collect()}
    assert got == {1: False, 2: False, 3: False} or got[1] is False
    blocks = spark.createDataFrame([("s", 1, 0, "this is a block of some length"), ("s", 2, 0, "This  is a block of some length"), ("s", 2, 1, "short")], "session string, call long, pos long, block string")
    assert {(r.call, r.reference) for r in state.references(blocks, "session").collect()} == {(1, False), (2, True)}


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "some longer line of text"]
    rows = [(s, t, rng.randrange(50), "\n".join(rng.choice(words) for _ in range(8)), rng.choice(words)) for s in range(4) for t in range(9)]
    schema = "session long, turn long, tokens long, text string, name string"
    for k in range(3):  # one file a micro-batch
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)
    batch = spark.createDataFrame(rows, schema)

    def collected(make, name):
        source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return {tuple(r) for r in spark.table(name).collect()}

    assert collected(sessions.turn_ledger, "ledger") == {tuple(r) for r in state.turn_ledger(batch).collect()}
    named = lambda df: df.select("session", F.col("turn").alias("call"), F.lit(0).alias("pos"), "name")
    assert collected(lambda s: sessions.aliases(named(s)), "names") == {tuple(r) for r in state.aliases(named(batch), "session").collect()}
    call = lambda df: df.select((F.col("session") * 100 + F.col("turn")).alias("id"), "session", F.col("turn").alias("ts"), "text")
    assert collected(lambda s: sessions.snapshot_choice(call(s), "session"), "deltas") == {(r.id, r.session, r.delta) for r in state.snapshot_choice(call(batch), "session", ["ts", "id"]).collect()}


def test_scan_and_artifacts(spark, tmp_path):
    for name, text in {"a.py": "import os\nfrom x.y import z\n\ndef f():\n    pass\nclass C: pass\n", "prod.env": "K=1", "node_modules/m.js": "x", "big.txt": "y" * 5000, "src/t.ts": "import q from './q'\n", "bin.dat": "a\0b"}.items():
        file = tmp_path / "repo" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    rows = {r.path: r for r in scan.scan(spark, str(tmp_path / "repo"), ignore=("*.md",), max_bytes=4000, label="lib").collect()}
    assert {k: r.kind for k, r in rows.items()} == {"lib:a.py": "included", "lib:prod.env": "excluded", "lib:node_modules/m.js": "excluded", "lib:big.txt": "too_large", "lib:src/t.ts": "included", "lib:bin.dat": "binary"}
    assert rows["lib:a.py"].symbols == ["f", "C"] and rows["lib:a.py"].imports == ["os", "x.y", "x.y.z"] and rows["lib:src/t.ts"].imports == ["./q"] and rows["lib:a.py"].line_count == 6
    assert scan.gitignore("# c\n!no\n*.log\n/out/\na/**/b") == ["*.log", "*.log/*", "out/*"]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "1.json").write_text(json.dumps({"command": "pack", "generated_at": "2024-01-02T03:04:05Z", "compressed_context": [{"path": "a.py", "original_tokens": 10, "compressed_tokens": 4, "strategy": "full"}]}))
    (runs / "2.json").write_text("{broken")
    (runs / "3.json").write_text("{}")
    good, bad = scan.artifacts(spark, str(runs))
    assert scan.entries(good).select("path", "original", "compressed").collect() == [("a.py", 10, 4)] and good.first().at is not None
    assert sorted(r.reason for r in bad.collect()) == ["invalid json", "not a pack artifact"]


def test_history_store(spark, tmp_path):
    from datetime import datetime

    store = stores.History(spark, str(tmp_path / "history"))
    assert store.read().count() == 0
    row = lambda i: (i, datetime(2024, 1, i), "t", "r", ["a"], [], i * 10, {"run": f"{i}.json"})
    schema = T._parse_datatype_string("struct<id:long,generated_at:timestamp,task:string,repo:string,selected:array<string>,ignored:array<string>,tokens:long,artifacts:map<string,string>>")
    store.append(spark.createDataFrame([row(i) for i in range(1, 6)], schema))
    store.append(spark.createDataFrame([row(6)], schema), keep=4)
    assert sorted(r.id for r in store.read().collect()) == [3, 4, 5, 6]
    store.prune(F.lit("2024-01-06").cast("timestamp"), 1)
    assert sorted(r.id for r in store.read().collect()) == [5, 6]
    store.merge_artifacts(spark.createDataFrame([(datetime(2024, 1, 6), {"run": "new.json", "md": "x"})], "generated_at timestamp, more map<string,string>"))
    assert {r.id: r.artifacts for r in store.read().collect()}[6] == {"run": "new.json", "md": "x"}
    cache = spark.createDataFrame([("summary", "k", "old", 1), ("summary", "k", "new", 2), ("slice", "j", "v", 1)], "namespace string, key string, value string, at long")
    assert {(r.key, r.value, r.hit) for r in stores.cached(spark.createDataFrame([("k",), ("j",)], "key string"), cache, "summary").collect()} == {("k", "new", True), ("j", None, False)}


def test_session_similarity_is_a_number(spark):
    assert math.isclose(one(spark, S.line_similarity(F.col("a"), F.col("b")), a="x\ny", b="y\nz"), 1 / 3)
