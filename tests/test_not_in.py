"""NOT IN beside OR: the rows of standard SQL, and no join that broadcasts or loops over the whole subquery."""

import duckdb
import pytest

from quern.operators import registry
from quern.session import Engine

SF = "/root/testdata/sf0.001"
TABLES = {"a": "(1, 1, 5), (2, 2, NULL), (3, NULL, 5), (4, NULL, 0), (5, 9, 0), (6, 9, NULL), (7, 1, 0)", "b": "(1, 1), (2, 3)", "c": "(1, 1), (2, NULL)", "d": "(1, 9)"}
WHERE = [
    "x NOT IN (SELECT v FROM {t}) OR y > 1",
    "y > 1 OR x NOT IN (SELECT v FROM {t}) OR id = 7",
    "x NOT IN (SELECT v FROM {t}) OR x NOT IN (SELECT v FROM d)",
    "x NOT IN (SELECT v FROM {t}) OR EXISTS (SELECT 1 FROM d WHERE d.v = a.x)",
    "id > 1 AND (y > 1 AND x NOT IN (SELECT v FROM {t}) OR y IS NULL)",
    "x NOT IN (SELECT v FROM {t} WHERE {t}.v = a.x) OR y > 1",
    "x NOT IN (SELECT v FROM {t} WHERE id > 5) OR y > 1",
    "x NOT IN (SELECT v FROM {t}) OR NULL",
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    own, duck = Engine(spark, str(tmp_path_factory.mktemp("not_in"))).create_session(), duckdb.connect()
    for name, values in TABLES.items():
        columns = "(id INTEGER PRIMARY KEY, x INTEGER, y INTEGER)" if name == "a" else "(id INTEGER PRIMARY KEY, v INTEGER)"
        for run in (own.execute, duck.execute):
            run(f"CREATE TABLE {name} {columns}")
            run(f"INSERT INTO {name} VALUES {values}")
    return own, duck


@pytest.mark.parametrize("t", ["b", "c"])
@pytest.mark.parametrize("where", WHERE)
def test_rows_are_those_of_sql(both, where, t):
    own, duck = both
    text = f"SELECT id FROM a WHERE {where.format(t=t)}"
    assert sorted(r["id"] for r in own.execute(text).rows) == sorted(r[0] for r in duck.execute(text).fetchall())


def test_delete(both):
    own, duck = both
    for run in (own.execute, duck.execute):
        run("CREATE TABLE e (id INTEGER PRIMARY KEY, x INTEGER, y INTEGER)")
        run("INSERT INTO e SELECT id, x, y FROM a")
        run("DELETE FROM e WHERE x NOT IN (SELECT v FROM b) OR y > 1")
    assert sorted(r["id"] for r in own.execute("SELECT id FROM e").rows) == sorted(r[0] for r in duck.execute("SELECT id FROM e").fetchall()) == [4, 7]


def test_large_subqueries_are_shuffled(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["not_in_subquery_null_value"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan
