"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from siftgrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).collect()


def test_nothing_imports_the_corpus_package():
    import pathlib

    root = pathlib.Path(registry.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "siftgrid.llm" not in p.read_text()


def test_entry(spark):
    os.environ.setdefault("PYTHONPATH", "")
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
