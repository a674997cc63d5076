"""Every query of the catalogue runs, gives rows, and equals its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from contextmill.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


def rows(frame):
    return sorted(tuple("null" if x is None or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(spark, con, name):
    query, sql = catalogue()[name]
    got = query(spark, SMALL).toPandas()
    assert len(got) or name in ("json_log_schema",)
    if sql:
        want = con.execute(sql).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got[list(want.columns)]) == rows(want)


def test_entry_and_results_do_not_depend_on_partitions(spark):
    import __spark_entry__

    first = __spark_entry__.entry(spark).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert sorted(__spark_entry__.entry(spark).collect()) == sorted(first) and sum(r.tokens for r in first) <= 24_000
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    """A copy without it imports, and its queries are those of the catalogue."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "contextmill", tmp_path / "contextmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, contextmill.plans as p; assert set(e.queries()) == set(p.catalogue()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
