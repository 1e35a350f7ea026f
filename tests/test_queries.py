"""Every registered query with SQL gives what DuckDB gives for that SQL on the same tables."""

from pathlib import Path

import pytest

from tilewright.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    db = duckdb.connect()
    for t in TABLES:
        if (DATA / f"{t}.parquet").exists():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).to_numpy().tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", ["gen_points", "gen_toy", "kmeans"])
def test_rows_only(spark, duck, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "clusters" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)
