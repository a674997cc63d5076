"""Outputs of test runners and build tools, prices and gates."""

import json

import pytest

from contextmill.operators import reports as R


def out(spark, text):
    return spark.createDataFrame([(1, text)], "doc long, text string")


@pytest.mark.parametrize("runner,text,want", [
    ("pytest", "== 1 passed in 1s ==\nx\n=== 2 failed, 10 passed, 3 skipped in 4s ===", (10, 2, 3)), ("cargo", "test result: ok. 1 passed; 0 failed; 0 ignored\ntest result: FAILED. 4 passed; 2 failed; 1 ignored;", (4, 2, 1)),
    ("jest", "Tests:       1 failed, 2 skipped, 7 passed, 10 total", (7, 1, 2)), ("go", "--- PASS: TestA (0.0s)\n--- FAIL: TestB (0.0s)\n    --- FAIL: TestB/sub\n--- SKIP: TestC", (1, 1, 1)), ("pytest", "nothing", (0, 0, 0)),
])
def test_counts(spark, runner, text, want):
    assert tuple(R.test_counts(out(spark, text), runner).first())[1:] == want


@pytest.mark.parametrize("runner,text,want", [
    ("pytest", "FAILED tests/a.py::test_x - assert 1 == 2\nFAILED tests/b.py::T::test_y", {("tests/a.py::test_x", "tests/a.py", "assert 1 == 2"), ("tests/b.py::T::test_y", "tests/b.py", "")}),
    ("cargo", "---- m::t stdout ----\nthread 'm::t' panicked at src/lib.rs:7:5:\nboom", {("m::t", "src/lib.rs", "thread 'm::t' panicked at src/lib.rs:7:5:")}), ("go", "--- FAIL: TestB (0.0s)\n    b_test.go:12: wrong\n", {("TestB", "b_test.go", "b_test.go:12: wrong")}),
    ("jest", "FAIL src/a.test.js\n  ● adds > numbers\n\n    expect(1).toBe(2)", {("adds > numbers", "src/a.test.js", "expect(1).toBe(2)")}),
])
def test_failures(spark, runner, text, want):
    assert {(r["name"], r.file, r.message) for r in R.test_failures(out(spark, text), runner).collect()} == want


def test_build_tools(spark):
    text = "added 12 packages in 3s\nremoved 1 package\nSuccessfully installed a-1 b-2 c-3\nCollecting x\n- y"
    assert {(r.operation, r.packages) for r in R.package_operations(out(spark, text)).collect()} == {("added", 16), ("removed", 2)}
    pods = "NAME   READY   STATUS    AGE\na   1/1   Running   1d\nb   0/1   Error   2d\nc   1/1   Running   1h"
    assert {(r.status, r.resources) for r in R.resource_states(out(spark, pods)).collect()} == {("Running", 2), ("Error", 1)}
    web, es = json.dumps({"modules": [{"name": "a.js", "size": 10}, {"name": "b.js", "size": 30}]}), json.dumps({"inputs": {"x.ts": {"bytes": 7}}})
    stats = spark.createDataFrame([(1, web), (2, es), (3, "{broken")], "doc long, text string")
    assert {tuple(r) for r in R.bundle_modules(stats, 1).collect()} == {(1, "b.js", 30), (2, "x.ts", 7)}


def test_prices_gates_and_floors(spark):
    models = spark.createDataFrame([("GPT-4o",), ("gpt-4o-mini-2024",), ("nothing",)], "model string")
    assert {(r.model, r.price_of) for r in R.priced(models).collect()} == {("GPT-4o", "gpt-4o"), ("gpt-4o-mini-2024", "gpt-4o-mini"), ("nothing", "gpt-4o")}
    was = spark.createDataFrame([("a", 80.0), ("b", 50.0), ("c", 10.0)], "key string, reduction_pct double")
    now = spark.createDataFrame([("a", 79.5), ("b", 40.0)], "key string, reduction_pct double")
    assert {r.key for r in R.regression_gate(now, was, 1.0).collect()} == {"b", "c"}
    results = spark.createDataFrame([("x", "compact", 100, 90), ("y", "ultra", 100, 20), ("z", "compact", 50, 50), ("v", "verbose", 100, 120)], "key string, level string, raw long, compressed long")
    assert {r.key for r in R.quality_floors(results).collect()} == {"x", "v"}


def test_paths_that_end_alike(spark):
    asked = spark.createDataFrame([("b/c.py",), ("/root/x/d.py",), ("c.py",), ("y.py",)], "path string")
    packed = spark.createDataFrame([("a/b/c.py",), ("x/d.py",), ("zc.py",)], "path string")
    assert {tuple(r) for r in R.matching_paths(asked, packed).collect()} == {("b/c.py", "a/b/c.py"), ("c.py", "a/b/c.py"), ("/root/x/d.py", "x/d.py")}
