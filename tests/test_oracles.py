"""Every named query of the library against its SQL in DuckDB, on the driver's smallest table set."""

import duckdb
import pytest

from telemill.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def comparable(row):
    return tuple((x is not None, float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(comparable(r) for r in df.select(*names).collect())
    answer = duck.execute(ORACLES[name])
    order = [[x[0] for x in answer.description].index(n) for n in names]
    want = sorted(comparable([r[i] for i in order]) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
