"""Every registered study query against its DuckDB equivalent, at the smallest scale."""

import duckdb
import pytest

from folio.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(x, 9) if isinstance(x, float) else x) for x in r) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert plain(rows) == plain([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])
