"""round, floor and ceil on values that Spark's own functions, which end at BIGINT, would change."""

import duckdb

from quern.operators import registry

NAME = "fn_abs_round_floor_ceil"
VALUES = [None, "nan", "inf", "-inf", 1e300, -1e300, 1e19, -1e19, 2.0**63, 2.0**53 + 2, -(2.0**53) - 2, 2.0**52 + 1, -(2.0**52) - 1, 2.0**52 - 0.5, 0.49999999999999994, -2.4999999999999996, 2.5, -2.7, 0.0, 0.5]
HALVES = [-0.5, -1.5, -2.5, -973.5, 0.5 - 2.0**52]


def both(spark, folder, values):
    con = duckdb.connect()
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_acctbal DOUBLE)")
    con.executemany("INSERT INTO customer VALUES (?, ?)", list(enumerate(values)))
    con.execute(f"COPY customer TO '{folder}/customer.parquet' (FORMAT parquet)")
    df = registry.queries()[NAME](spark, str(folder))
    cur = con.execute(registry.oracle_sql()[NAME])
    assert df.columns == [d[0] for d in cur.description]
    return sorted(map(tuple, df.collect())), sorted(cur.fetchall())


def test_large_values_nan_and_infinity_equal_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, VALUES)
    assert repr(got) == repr(want)


def test_negative_halves_go_up_where_sql_goes_down(spark, tmp_path):
    """The dialect's way (Math.round), which test_session.py and fn_round_scale hold to; all other columns equal SQL."""
    got, want = both(spark, tmp_path, HALVES)
    assert [r[4] for r in got] == [v + 0.5 for v in HALVES] == [r[4] + 1 for r in want]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2:4] for r in got] == [r[2:4] for r in want]
