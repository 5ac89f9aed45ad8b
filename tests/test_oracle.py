"""Every query of the catalogue that has an equivalent in SQL, against DuckDB."""

import duckdb
import pytest

from rugosa.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def tidy(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    got = tidy(tuple(r) for r in df.select(*cols).collect())
    assert got == tidy(tuple(r[i] for i in at) for r in want.fetchall())
