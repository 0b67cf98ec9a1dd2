"""Every query against its SQL in DuckDB, order aside."""

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    return sorted(map(str, pdf[columns].astype(object).where(pdf[columns].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert len(catalog.QUERIES[name](spark, sf).limit(5).collect()) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
