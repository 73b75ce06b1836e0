"""Every query of the library against its SQL, run by DuckDB over the same tables; row counts where SQL has no form."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from quarry.plans import catalog, catalog_queues, catalog_texts  # noqa: E402, F401


@pytest.fixture(scope="module")
def tables(sf):
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, tables, name):
    found = catalog.QUERIES[name](spark, sf)
    got = tables.execute(catalog.SQL[name])
    assert table(map(tuple, found.collect()), found.columns) == table(got.fetchall(), [c[0] for c in got.description])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
