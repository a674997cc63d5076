"""Exchanges keep the number of tasks that the tables' rows call for, however small they are."""

from contextmill.operators import commands, imports, state
from contextmill.plans import commands as plans
from contextmill.plans import imports as import_plans
from contextmill.sources import bindings as B


def test_tasks_grow_with_the_rows(spark, tmp_path):
    spark.range(1001).write.parquet(f"{tmp_path}/t.parquet")
    assert [B.tasks(spark, str(tmp_path), "t", rows=n) for n in (2000, 1001, 100)] == [1, 1, 11] and B.tasks(spark, str(tmp_path), "t", "t", rows=1001) == 2


def test_lines_stay_where_they_were_dealt(spark):
    rows = spark.createDataFrame([(d, n, f"src/p:{n}:x") for d in range(9) for n in (2, 1)], "doc int, n int, line string")
    texts = plans._outputs(rows, ["n"], 7)
    assert texts.rdd.getNumPartitions() == 7 and {r.text for r in texts.collect()} == {"src/p:1:x\nsrc/p:2:x"}
    found = commands.grep(texts)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and found.rdd.getNumPartitions() == 7  # the plan before it has run


def test_own_times_take_one_exchange_and_keep_columns(spark):
    rows = [(1, p, d, f"n{p}", t, 1, 10 * p) for p, (d, t) in enumerate([(0, 100), (2, 40), (4, 15), (2, 30), (1, 20), (3, 5), (3, 50)])] + [(2, 0, 1, "m", None, 1, None)]
    nodes = spark.createDataFrame(rows, "plan int, pos int, depth int, op string, ms int, loops int, rows long")
    own = commands.self_times(nodes, ["rows"], 5)
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and own.rdd.getNumPartitions() == 5
    assert {(r.plan, r.op): (r.self_ms, r.rows) for r in own.collect()} == {(1, "n0"): (10, 0), (1, "n1"): (25, 10), (1, "n2"): (15, 20), (1, "n3"): (30, 30), (1, "n4"): (0, 40), (1, "n5"): (5, 50), (1, "n6"): (50, 60), (2, "m"): (0, None)}


def test_snapshot_choices_keep_their_tasks(spark):
    calls = spark.createDataFrame([(i, i % 2, "a\nb\nc\nd" + str(i)) for i in range(6)], "id int, key int, text string")
    got = state.snapshot_choice(calls, "key", ["id"], 6)
    assert got.rdd.getNumPartitions() == 6 and got.count() == 6


def test_pairs_of_packages_stay_where_they_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(B, "tasks", lambda *_, **__: 7)
    pairs = import_plans.import_edges_package(spark, "/root/testdata/sf0.001")
    assert pairs.rdd.getNumPartitions() == 7 and pairs.count() == pairs.distinct().count() > 0


def test_specs_of_packages_are_resolved_once_and_pairs_once(spark):
    files = [(r, f"g{i % 2}/x{i}.go") for r in "ab" for i in range(4)]
    specs = spark.createDataFrame([(r, p, s) for r, p in files for s in ("o/g1", "g1", "o/g0", "q")] * 2 + [("c", "g0/x0.go", "o/g1"), (None, "g0/x0.go", "g1")], "repo string, src string, spec string")
    pairs = imports.package_targets(specs, spark.createDataFrame(files * 2 + [(None, "g1/x1.go")], "repo string, path string"), 7)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.split("\n") if "Generate posexplode" in line and "src" in line] == []  # specs alone are taken apart
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((r, p, q) for r, p in files for s, q in files if r == s and p[:2] != q[:2])
