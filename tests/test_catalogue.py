"""Every query of the catalogue against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

from quern.operators import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if hasattr(v, "isoformat"):
        return (2, v.isoformat()[:19])
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (1, "nan") if math.isnan(v) else (1, f"{float(v):.9g}")
    return (3, str(v))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.oracle_sql()[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    assert got == want
