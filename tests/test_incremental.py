"""Scans and import graphs that go on from the state before, against scans and graphs built anew."""

import os
import random

from pyspark.sql import functions as F

from contextmill.operators import imports as I
from contextmill.sources import scan
from contextmill.sources.snapshots import ScanIndex


def put(root, path, text, at=1_700_000_000):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)
    os.utime(root / path, (at, at))


def as_rows(df):
    return sorted((r.path, r.size, r.kind, r.content_hash, r.line_count, r.preview, tuple(r.symbols or ()), tuple(r.imports or ())) for r in df.collect())


def test_refresh_reads_changed_files_only(spark, tmp_path):
    root, index = tmp_path / "tree", ScanIndex(spark, str(tmp_path / "index"))
    for k in range(120):
        put(root, f"d{k % 9}/f{k}.py", f"import m{k}\ndef f{k}():\n    pass\n")
    put(root, "d0/[id].ts", "import a from './b'\n")
    put(root, "d0/data.bin", "a\0b")
    put(root, "id_rsa", "secret")
    assert {r.change for r in index.refresh(str(root)).collect()} == {"added"}
    assert as_rows(index.read()) == as_rows(scan.scan(spark, str(root)))
    # all texts change, but only two files' sizes or times do: no other file may be read
    for k in range(120):
        put(root, f"d{k % 9}/f{k}.py", f"import q{k}\ndef g{k}():\n    pass\n")
    put(root, "d1/f1.py", "import q1\ndef g1():\n    pass\n", at=1_700_000_050)
    put(root, "d0/[id].ts", "import a from './longer'\n")
    put(root, "new/x.py", "x = 1\n")
    (root / "d2/f2.py").unlink()
    got = {r.path: r.change for r in index.refresh(str(root)).where("change <> 'reused'").collect()}
    assert got == {"d1/f1.py": "updated", "d0/[id].ts": "updated", "new/x.py": "added", "d2/f2.py": "removed"}
    names = {r.path: r.symbols for r in index.read().collect() if r.symbols}
    assert {s[0][0] for p, s in names.items() if p != "d1/f1.py"} == {"f"} and names["d1/f1.py"] == ["g1"]
    # nothing changed: nothing is read; other settings void the index
    assert {r.change for r in index.refresh(str(root)).collect()} == {"reused"}
    again = index.refresh(str(root), ignore=("d3/*",))
    assert {r.change for r in again.collect()} == {"added"} and as_rows(index.read()) == as_rows(scan.scan(spark, str(root), ignore=("d3/*",)))
    assert len(index.generations()) == 4
    index.forget(2)
    assert [n for n, _ in index.generations()] == [2, 3] and index.read().count() == 123


def test_an_unfinished_generation_is_not_seen(spark, tmp_path):
    root, index = tmp_path / "tree", ScanIndex(spark, str(tmp_path / "index"))
    put(root, "a.py", "x = 1\n")
    index.refresh(str(root))
    number, digest = index.generations()[0]
    os.makedirs(tmp_path / "index" / f"g={number + 1}-{digest}")
    assert index.read().count() == 1 and {r.change for r in index.refresh(str(root)).collect()} == {"reused"}


def text_of(rng, path, paths):
    out = []
    for other in rng.sample(paths, 3):
        stem, up = other.rsplit(".", 1)[0], "../" * path.count("/")
        if path.endswith(".py"):
            out.append(rng.choice(("import {0}", "from {0} import x", "from {1} import {2}", "from ..{2} import y", "import {2}")).format(stem.replace("/", "."), ".".join(stem.split("/")[:-1]) or "os", stem.split("/")[-1]))
        elif path.endswith(".go"):
            out.append(f'import "host/{"/".join(stem.split("/")[:-1])}"')
        else:
            out.append(f"import x from '{up or './'}{rng.choice((stem, other))}'")
    return "\n".join(out)


def test_graph_upkeep_equals_a_rebuild(spark):
    rng = random.Random(11)
    stems = [f"{a}/{b}/{c}" for a in "pq" for b in ("x", "y", "index") for c in ("m1", "m2", "m3", "__init__", "index")] + ["top", "p/m1"]
    paths = [s + e for s in stems for e in (".py", ".ts", ".js", ".go")]
    table = lambda names: spark.createDataFrame([("r", p, t) for p, t in names.items()], "repo string, path string, text string")
    have = {p: text_of(rng, p, paths) for p in rng.sample(paths, 60)}
    scratch = I.Scratch(spark, "graph")
    graph = I.graph(table(have), scratch)
    for turn in range(3):
        removed = rng.sample(sorted(have), 6)
        changed = {p: text_of(rng, p, paths) for p in rng.sample(sorted(set(have) - set(removed)), 5) + rng.sample(sorted(set(paths) - set(have)), 7)}
        graph = I.updated(graph, table(changed), table({p: "" for p in removed}).select("repo", "path"), scratch, f"turn{turn}")
        have = {p: t for p, t in have.items() if p not in removed} | changed
        want = I.import_graph(table(have)).collect()
        assert len(want) > 20 and sorted(graph.edges.collect()) == sorted(want)
        assert sorted(r.path for r in graph.files.collect()) == sorted(have)
    kept = I.touched(graph.specs, spark.createDataFrame([("r", "p/x/m1.py")], "repo string, path string")).count()
    assert 0 < kept < graph.specs.select("src").distinct().count() / 2  # few sources are resolved again
    assert I.updated(graph, table({"only.py": ""}).limit(0), graph.files.limit(0), scratch, "none").edges.count() == graph.edges.count()
    assert I.updated(graph, table({"only.py": ""}).limit(0), graph.files, scratch, "all").edges.count() == 0
