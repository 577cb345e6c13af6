"""Sessions end to end: definitions, data, constraints, transactions, prepared statements."""

import pytest

from quern.errors import BindError, ConstraintError, ParseError, QuernError, TransactionError
from quern.session import Engine


@pytest.fixture
def s(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db")).create_session()


def rows(s, text, params=None):
    return [tuple(r.values()) for r in s.execute(text, params).rows]


def test_insert_select_update_delete(s):
    s.execute("CREATE TABLE fruit (id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL DEFAULT -1.5, ok BOOLEAN)")
    assert s.execute("INSERT INTO fruit VALUES (1, 'fig', 2.5, TRUE), (2, 'plum', 3.0, FALSE)").affected == 2
    s.execute("INSERT INTO fruit (id, name) VALUES (3, 'it''s')")
    assert rows(s, "SELECT id, name, price FROM fruit ORDER BY id") == [(1, "fig", 2.5), (2, "plum", 3.0), (3, "it's", -1.5)]
    assert s.execute("UPDATE fruit SET price = price * 2, name = upper(name) WHERE ok").affected == 1
    assert rows(s, "SELECT name, price FROM fruit WHERE id = 1") == [("FIG", 5.0)]
    assert s.execute("DELETE FROM fruit WHERE price < 0").affected == 1
    assert rows(s, "SELECT count(*) FROM fruit") == [(2,)]
    assert s.execute("DELETE FROM fruit").affected == 2
    assert rows(s, "SELECT count(*), sum(price) FROM fruit") == [(0, None)]


def test_keys_and_statement_atomicity(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, code TEXT UNIQUE, n INTEGER NOT NULL)")
    s.execute("INSERT INTO t VALUES (1, 'a', 1), (2, NULL, 1), (3, NULL, 1)")
    for bad in ("INSERT INTO t VALUES (9, 'z', 1), (1, 'b', 1)", "INSERT INTO t VALUES (4, 'a', 1)", "INSERT INTO t VALUES (4, 'd', NULL)", "UPDATE t SET id = 1"):
        with pytest.raises(ConstraintError):
            s.execute(bad)
    assert rows(s, "SELECT id FROM t ORDER BY id") == [(1,), (2,), (3,)]
    s.execute("UPDATE t SET id = id + 1")  # only the final state counts
    assert rows(s, "SELECT id FROM t ORDER BY id") == [(2,), (3,), (4,)]


@pytest.mark.parametrize("text", ["CREATE TABLE b (j JSON PRIMARY KEY)", "CREATE TABLE b (x BLOB UNIQUE)", "CREATE TABLE b (x TEXT PRIMARY KEY AUTOINCREMENT)", "CREATE TABLE b (x INTEGER, x TEXT)", "DROP TABLE missing", "CREATE INDEX i ON missing (x)"])
def test_definitions_that_must_fail(s, text):
    with pytest.raises(BindError):
        s.execute(text)


def test_autoincrement_follows_explicit_ids(s):
    s.execute("CREATE TABLE a (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT)")
    s.execute("INSERT INTO a (name) VALUES ('p'), ('q')")
    s.execute("INSERT INTO a VALUES (NULL, 'r'), (700, 's'), (NULL, 't'), (31, 'u'), (NULL, 'v')")
    s.execute("INSERT INTO a (name) VALUES ('w')")
    assert rows(s, "SELECT id, name FROM a ORDER BY id") == [(1, "p"), (2, "q"), (3, "r"), (31, "u"), (700, "s"), (701, "t"), (702, "v"), (703, "w")]


def test_insert_select_with_cte(s):
    s.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, v INTEGER); CREATE TABLE b (id INTEGER PRIMARY KEY, v INTEGER)")
    s.execute("INSERT INTO a VALUES (1, 10), (2, 20), (3, 30)")
    assert s.execute("INSERT INTO b WITH big AS (SELECT id, v FROM a WHERE v > 10) SELECT id, v * 2 FROM big").affected == 2
    assert rows(s, "SELECT * FROM b ORDER BY id") == [(2, 40), (3, 60)]


def test_insert_of_many_values(s):
    s.execute("CREATE TABLE m (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT, x REAL, j JSON, b BLOB)")
    values = ", ".join(f"(NULL, 'it''s {i}', {-i if i % 2 else i}, {'NULL' if i % 3 else chr(39) + '[1,  2]' + chr(39)}, x'0{i % 10}')" for i in range(3000))
    assert s.execute(f"INSERT INTO m VALUES {values}").affected == 3000
    assert rows(s, "SELECT count(*), sum(x), count(j), min(j), max(id) FROM m") == [(3000, -1500.0, 1000, "[1,2]", 3000)]
    assert rows(s, "SELECT name, x, b FROM m WHERE id = 8") == [("it's 7", -7.0, b"\x07")]
    assert s.execute("INSERT INTO m VALUES (9000, upper($1), 1 + 1, NULL, $2), (-1, $1, $3, NULL, NULL)", ["é", b"z", 2.5]).affected == 2
    assert rows(s, "SELECT id, name, x, b FROM m WHERE id < 0 OR id > 5000 ORDER BY id") == [(-1, "é", 2.5, None), (9000, "É", 2.0, b"z")]
    more = ", ".join(f"({10000 + i} + 0, 'n', {i}, NULL, NULL)" for i in range(120))
    assert s.execute(f"INSERT INTO m VALUES {more}").affected == 120
    with pytest.raises(BindError):
        s.execute("INSERT INTO m (id, name) VALUES (1, 'a'), (2)")


def test_upsert_rounds(s):
    s.execute("CREATE TABLE kv (k INTEGER PRIMARY KEY, v INTEGER)")
    s.execute("INSERT INTO kv VALUES (1, 1)")
    assert s.execute("INSERT INTO kv VALUES (1, 5), (2, 7), (2, 8) ON CONFLICT DO NOTHING").affected == 1
    assert rows(s, "SELECT * FROM kv ORDER BY k") == [(1, 1), (2, 7)]
    s.execute("INSERT INTO kv VALUES (1, 10), (1, 100), (3, 3) ON CONFLICT (k) DO UPDATE SET v = kv.v + excluded.v")
    assert rows(s, "SELECT * FROM kv ORDER BY k") == [(1, 111), (2, 7), (3, 3)]
    assert s.execute("INSERT INTO kv VALUES (1, 0), (2, 9) ON CONFLICT (k) DO UPDATE SET v = excluded.v WHERE excluded.v > kv.v").affected == 1
    assert rows(s, "SELECT v FROM kv ORDER BY k") == [(111,), (9,), (3,)]
    with pytest.raises(BindError):
        s.execute("INSERT INTO kv VALUES (1, 0) ON CONFLICT (v) DO NOTHING")


def test_null_keys_never_conflict(s):
    s.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, code TEXT UNIQUE)")
    s.execute("INSERT INTO n VALUES (1, NULL), (2, NULL) ON CONFLICT (code) DO NOTHING")
    s.execute("INSERT INTO n VALUES (3, NULL) ON CONFLICT (code) DO UPDATE SET code = 'x'")
    assert rows(s, "SELECT count(*) FROM n") == [(3,)]


def test_alter_reads_defaults_for_old_rows(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT); INSERT INTO t VALUES (1, 'x')")
    s.execute("ALTER TABLE t ADD COLUMN n INTEGER DEFAULT 7; ALTER TABLE t ADD m TEXT")
    assert rows(s, "SELECT * FROM t") == [(1, "x", 7, None)]
    s.execute("INSERT INTO t VALUES (2, 'y', 8, 'm'); ALTER TABLE t DROP COLUMN a; ALTER TABLE t ADD a TEXT DEFAULT 'new'")
    assert rows(s, "SELECT * FROM t ORDER BY id") == [(1, 7, None, "new"), (2, 8, "m", "new")]


def test_unique_and_expression_indexes(s):
    s.execute("CREATE TABLE d (id INTEGER PRIMARY KEY, j JSON, name TEXT)")
    s.execute("""INSERT INTO d VALUES (1, '{"a": 1, "b": {"c": "x"}}', 'Ann'), (2, '{"a": 2}', 'Bob')""")
    s.execute("CREATE UNIQUE INDEX low ON d (lower(name)); CREATE INDEX path ON d (j.a)")
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO d VALUES (3, NULL, 'ANN')")
    with pytest.raises(ConstraintError):
        s.execute("""INSERT INTO d VALUES (3, '{"a": {"z": 1}}', 'Cid')""")
    with pytest.raises(BindError):
        s.execute("CREATE INDEX bad ON d (j)")
    with pytest.raises(BindError):
        s.execute("ALTER TABLE d DROP COLUMN name")
    s.execute("DROP INDEX low; DROP INDEX IF EXISTS low; INSERT INTO d VALUES (3, NULL, 'ANN')")


def test_json(s):
    s.execute("CREATE TABLE j (id INTEGER PRIMARY KEY, data JSON)")
    s.execute("""INSERT INTO j VALUES (1, '{"name": "Ann",  "age": 30, "tags": ["x", "y"]}'), (2, '{"name":"Bob","age":9}'), (3, NULL)""")
    assert rows(s, "SELECT data.name, data.tags[1] FROM j WHERE data.age > 10") == [("Ann", "y")]
    assert rows(s, "SELECT id FROM j WHERE data.name = 'Bob'") == [(2,)]
    assert rows(s, "SELECT data.tags FROM j WHERE id = 1") == [('["x","y"]',)]
    assert rows(s, "SELECT typeof(data.age), typeof(data.tags), typeof(data.name) FROM j WHERE id = 1") == [("number", "json", "string")]
    with pytest.raises(Exception):
        s.execute("INSERT INTO j VALUES (4, '{broken')")
    with pytest.raises(BindError):
        s.execute("SELECT id.name FROM j")


def test_blob(s):
    s.execute("CREATE TABLE b (id INTEGER PRIMARY KEY, x BLOB); INSERT INTO b VALUES (1, x'00FF'), (2, x'')")
    assert rows(s, "SELECT length(x), CAST(x AS TEXT), typeof(x) FROM b ORDER BY id") == [(2, "00FF", "blob"), (0, "", "blob")]
    assert rows(s, "SELECT id FROM b WHERE x = x'00ff'") == [(1,)]


def test_transactions(s, spark):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    other = s.engine.create_session()
    s.execute("BEGIN; INSERT INTO t VALUES (1); CREATE TABLE u (x TEXT)")
    assert rows(s, "SELECT count(*) FROM t") == [(1,)] and rows(other, "SELECT count(*) FROM t") == [(0,)]
    s.execute("ROLLBACK")
    assert rows(s, "SELECT count(*) FROM t") == [(0,)]
    with pytest.raises(BindError):
        s.execute("SELECT * FROM u")
    s.execute("BEGIN TRANSACTION; INSERT INTO t VALUES (1); COMMIT; COMMIT; ROLLBACK")
    assert rows(other, "SELECT id FROM t") == [(1,)]
    s.execute("BEGIN")
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(TransactionError):
        s.execute("SELECT 1")
    with pytest.raises(TransactionError):
        s.execute("COMMIT")
    assert rows(s, "SELECT 1") == [(1,)]
    s.execute("BEGIN")
    with pytest.raises(TransactionError):
        s.execute("BEGIN")


def test_snapshot_isolation_and_write_conflict(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    other = s.engine.create_session()
    s.execute("BEGIN; SELECT count(*) FROM t")
    other.execute("INSERT INTO t VALUES (1)")
    assert rows(s, "SELECT count(*) FROM t") == [(0,)]
    s.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(TransactionError):
        s.execute("COMMIT")
    assert rows(s, "SELECT id FROM t") == [(1,)]
    assert s.engine.catalog.collect_garbage() >= 1 and rows(s, "SELECT id FROM t") == [(1,)]
    with s.engine.catalog.locked(), pytest.raises(TransactionError, match="locked"):
        s.execute("INSERT INTO t VALUES (3)")


def test_prepared_and_explain(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    p = s.prepare("SELECT v FROM t WHERE id = $1 OR v = $2")
    assert p.run([1, "b"]).df.count() == 2 and p.run([2, None]).rows == [{"v": "b"}]
    with pytest.raises(BindError):
        p.run([1])
    s.execute("CREATE TABLE other (x TEXT)")
    with pytest.raises(TransactionError):
        p.run([1, "b"])
    with pytest.raises(BindError):
        s.prepare("SELECT 1; SELECT 2")
    (plan,) = s.execute("EXPLAIN SELECT v FROM t WHERE id = 1").rows
    assert "plan" in plan and "Physical Plan" in plan["plan"]
    assert set(s.schema()["tables"]) == {"t", "other"}


def test_expressions(s):
    one = lambda text, params=None: rows(s, f"SELECT {text} AS x", params)[0][0]
    assert [one("7 / 2"), one("1 / 0"), one("-15 % 4"), one("5 % 0"), one("2 + 3 * 4")] == [3.5, None, -3, None, 14]
    assert [one("'r: ' || 2 + 3"), one("1.0 || 'x'"), one("NULL || 'x'"), one("TRUE || ''")] == ["r: 5", "1x", None, "true"]
    assert [one("CAST('42abc' AS INTEGER)"), one("CAST(3.7 AS INTEGER)"), one("CAST(-3.7 AS INTEGER)"), one("CAST(3.0 AS TEXT)"), one("CAST('1' AS BOOLEAN)")] == [42, 3, -3, "3", True]
    assert [one("substr('hello', 2, 3)"), one("substr('hello', -3)"), one("substr('abc', 0, 2)"), one("substr('abc', -9, 2)")] == ["ell", "llo", "ab", "ab"]
    assert [one("round(2.5)"), one("round(-2.5)"), one("round(2.345, 2)"), one("floor(-1.5)"), one("ceil(1.2)")] == [3.0, -2.0, 2.35, -2.0, 2.0]
    assert [one("trim('  a b ')"), one("replace('aXbX', 'X', '-')"), one("concat('a', NULL)"), one("nullif(1, 1)"), one("coalesce(NULL, 2)")] == ["a b", "a-b-", None, None, 2]
    assert [one("'a%c' LIKE 'a\\%c'"), one("'abc' LIKE 'a_c'"), one("NULL IN (1, NULL)"), one("3 NOT IN (1, NULL)"), one("1 BETWEEN 0 AND NULL")] == [False, True, None, None, None]
    assert [one("typeof(1)"), one("typeof('a')"), one("typeof(NULL)"), one("md5('abc')"), one("length('é')")] == ["number", "string", "null", "900150983cd24fb0d6963f7d28e17f72", 1]
    assert one("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END") == "b" and one("CASE WHEN NULL THEN 1 END") is None
    assert one("$1 + 1", [4]) == 5 and one("$1", ["it's"]) == "it's"
    for bad in ("SELECT CAST('x' AS INTEGER)", "SELECT CAST('AAB' AS BLOB)", "SELECT CAST(2 AS BOOLEAN)"):
        with pytest.raises(Exception):
            s.execute(bad).rows


@pytest.mark.parametrize("text", ["SELECT 1 = 'a'", "SELECT TRUE = 1", "SELECT 'a' + 1", "SELECT nosuch(1)", "SELECT x", "SELECT upper(x'00')", "SELECT 1 UNION SELECT 1, 2", "SELECT 1 HAVING TRUE", "SELECT count(sum(1))"])
def test_bind_errors(s, text):
    with pytest.raises(BindError):
        s.execute(text)


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 FROM", "SELECT row_number() OVER (x)", "SELECT /* open", "INSERT t", "SELECT * FROM a FULL x"])
def test_parse_errors(s, text):
    with pytest.raises(ParseError):
        s.execute(text)


def test_recursive(s):
    s.execute("CREATE TABLE tree (id INTEGER PRIMARY KEY, parent INTEGER, name TEXT)")
    s.execute("INSERT INTO tree VALUES (1, NULL, 'root'), (2, 1, 'a'), (3, 1, 'b'), (4, 2, 'c')")
    assert rows(s, "WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 200) SELECT count(*), max(x) FROM n") == [(200, 200)]
    assert rows(s, "WITH RECURSIVE n(x) AS (SELECT 0 UNION SELECT (x + 1) % 5 FROM n) SELECT x FROM n ORDER BY x") == [(i,) for i in range(5)]
    up = "WITH RECURSIVE d AS (SELECT id, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, d.depth + 1 FROM tree t JOIN d ON t.parent = d.id) SELECT id, depth FROM d ORDER BY id"
    assert rows(s, up) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    with pytest.raises(QuernError):
        s.execute("WITH RECURSIVE n AS (SELECT 1 AS x UNION ALL SELECT count(*) FROM n) SELECT * FROM n")


def test_order_null_defaults_and_names(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER); INSERT INTO t VALUES (1, NULL), (2, 5), (3, 4)")
    assert rows(s, "SELECT id FROM t ORDER BY v") == [(3,), (2,), (1,)] and rows(s, "SELECT id FROM t ORDER BY v DESC") == [(1,), (2,), (3,)]
    assert rows(s, "SELECT id FROM t ORDER BY v ASC NULLS FIRST LIMIT 1 OFFSET 1") == [(3,)]
    assert list(s.execute("SELECT count(*), sum(v), id + 1 FROM t GROUP BY id + 1").df.columns) == ["count_star", "sum_1", "column2"]
    assert rows(s, "SELECT v FROM t WHERE v IN (SELECT 5) UNION SELECT 9 ORDER BY v DESC") == [(9,), (5,)]
    assert rows(s, 'SELECT id AS "my id" FROM t WHERE id = 1 -- note') == [(1,)]
    assert rows(s, "SELECT a.id FROM t a WHERE a.v = (SELECT max(b.v) FROM t b) AND EXISTS (SELECT 1 FROM t c WHERE c.id = a.id) AND a.v NOT IN (SELECT 7)") == [(2,)]


def test_inserts_add_parts_of_falling_sizes(s):
    parts = lambda: [(p["columns"], p["rows"]) for p in s.manifest()["tables"]["t"]["parts"]]
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT UNIQUE)")
    s.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd'), (5, 'e'), (6, NULL), (7, NULL), (-1, 'o'), (-2, 'p'), (-3, 'q'), (-4, 'r')")
    s.execute("INSERT INTO t VALUES (8, 'h'), (9, 'i'), (10, 'j')")
    s.execute("INSERT INTO t VALUES (11, 'k')")
    assert parts() == [(["id", "v"], 11), (["id", "v"], 3), (["id", "v"], 1)]
    assert rows(s, "SELECT count(*), sum(id), count(v) FROM t") == [(15, 56, 13)]
    for bad in ("INSERT INTO t VALUES (2, 'z')", "INSERT INTO t VALUES (12, 'h')", "INSERT INTO t VALUES (12, 'y'), (13, 'y')"):
        with pytest.raises(ConstraintError):
            s.execute(bad)
    assert len(parts()) == 3
    s.execute("ALTER TABLE t ADD COLUMN w INTEGER DEFAULT 5")
    s.execute("INSERT INTO t VALUES (12, NULL, 1)")  # takes in the last two parts
    assert parts() == [(["id", "v"], 11), (["id", "v", "w"], 5)]
    assert rows(s, "SELECT sum(w), count(*) FROM t") == [(76, 16)]
    s.execute("ALTER TABLE t DROP COLUMN w; ALTER TABLE t ADD COLUMN w TEXT")
    assert rows(s, "SELECT count(w), count(*) FROM t") == [(0, 16)]
    assert s.execute("INSERT INTO t VALUES (1, 'n', 'x'), (20, 't', 'x') ON CONFLICT (id) DO NOTHING").affected == 1
    assert s.execute("INSERT INTO t VALUES (1, 'n', 'x'), (1, 'm', 'y'), (21, 'u', 'y') ON CONFLICT (id) DO UPDATE SET v = excluded.v, w = t.v").affected == 3
    assert rows(s, "SELECT id, v, w FROM t WHERE id IN (1, 2, 20, 21) ORDER BY id") == [(1, "m", "n"), (2, "b", None), (20, "t", "x"), (21, "u", "y")]
    assert len(parts()) == 1
    assert s.engine.catalog.collect_garbage() > 0
    assert rows(s, "SELECT count(*) FROM t") == [(18,)]


def test_added_columns_must_suit_the_rows_there_are(s):
    s.execute("CREATE TABLE t (id INTEGER PRIMARY KEY); INSERT INTO t VALUES (1), (2)")
    for bad in ("ALTER TABLE t ADD COLUMN a TEXT NOT NULL", "ALTER TABLE t ADD COLUMN a TEXT UNIQUE DEFAULT 'x'"):
        with pytest.raises(ConstraintError):
            s.execute(bad)
    s.execute("ALTER TABLE t ADD COLUMN a TEXT NOT NULL DEFAULT 'x'; ALTER TABLE t ADD COLUMN b TEXT UNIQUE")
    assert rows(s, "SELECT id, a, b FROM t ORDER BY id") == [(1, "x", None), (2, "x", None)]
