"""The catalogue's queries as callables over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.operators.catalogue import CHANGES, FAILS, QUERIES
from quern.session import Engine, Session, query
from quern.sources.files import ParquetTables
from quern.sources.shared import new_folder

JSON_COLUMNS = {"events": {"props"}}
_tables: dict[tuple, ParquetTables] = {}


def tables(spark: SparkSession, sf_dir: str) -> ParquetTables:
    """The tables of a folder, the same for all queries of a session: they are taken not to change meanwhile."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _tables:
        _tables[key] = ParquetTables(spark, sf_dir, JSON_COLUMNS)
    return _tables[key]


def run(spark: SparkSession, sf_dir: str, text: str, params: list | None = None) -> DataFrame:
    return query(spark, tables(spark, sf_dir), text, params)


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session on a new database in the shared folder, beside the folder's tables."""
    engine = Engine(spark, new_folder(spark).removeprefix("file://").removeprefix("file:"))
    engine.attached = tables(spark, sf_dir)
    return engine.create_session()


def change(spark: SparkSession, sf_dir: str, script: str | tuple, text: str) -> DataFrame:
    """Runs the statements on a new database and returns its state as a query."""
    own = session(spark, sf_dir)
    for statements in (script,) if isinstance(script, str) else script:
        try:
            own.execute(statements)
        except QuernError:
            if not statements.startswith(FAILS):
                raise
        else:
            if statements.startswith(FAILS):
                raise AssertionError(f"should have failed: {statements}")
    return own.execute(text).df


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts by one prepared statement with many lists of parameters, then a prepared query."""
    own = session(spark, sf_dir)
    own.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT, price REAL); BEGIN")
    own.prepare("INSERT INTO p VALUES ($1, upper($2), $3)").run_many([[i, f"n{i % 7}", i / 4] for i in range(500)])
    own.execute("COMMIT")
    return own.prepare("SELECT id, name, price FROM p WHERE price >= $1 AND name <> $2").run([20, "N3"]).df


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the plans of a query and of statements show what they read."""
    own = session(spark, sf_dir)
    own.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    texts = {"query": "SELECT n_name FROM nation WHERE n_nationkey = 3", "insert": "INSERT INTO t SELECT r_regionkey, r_name FROM region", "update": "UPDATE t SET v = 'x' WHERE k = 3", "delete": "DELETE FROM t WHERE k = 3"}
    plans = [own.execute(f"EXPLAIN {text}").df.select(F.lit(name).alias("statement"), (F.instr("plan", "Physical Plan") > 0).alias("has_plan"), (F.instr("plan", "Scan parquet") > 0).alias("has_scan")) for name, text in texts.items()]
    return plans[0].union(plans[1]).union(plans[2]).union(plans[3])


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "prepared_statements": (prepared, "SELECT i AS id, 'N' || (i % 7) AS name, i / 4 AS price FROM range(500) r(i) WHERE i / 4 >= 20 AND i % 7 <> 3"),
    "explain": (explained, "SELECT * FROM (VALUES ('query', TRUE, TRUE), ('insert', TRUE, TRUE), ('update', TRUE, TRUE), ('delete', TRUE, TRUE)) v(statement, has_plan, has_scan)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(lambda text, params, spark, sf_dir: run(spark, sf_dir, text, params), found[0], found[2] if len(found) > 2 else None) for name, found in QUERIES.items()}
    out |= {name: partial(lambda s, t, spark, sf_dir: change(spark, sf_dir, s, t), script, text) for name, (script, text, _) in CHANGES.items()}
    return out | {name: run for name, (run, _) in EXTRA.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: found[1] or found[0] for name, found in QUERIES.items()}
    return out | {name: oracle for name, (_, _, oracle) in CHANGES.items()} | {name: oracle for name, (_, oracle) in EXTRA.items()}
