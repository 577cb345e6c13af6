"""One query for each operator and function of the dialect, over the star-schema tables, with its oracle.

QUERIES: name -> (text of the dialect, oracle), and a list of parameters where the text has some. The oracle is
None where the text itself is the same query for a standard SQL engine. Sums are cast and rounded alike on both sides.
CHANGES: name -> (statements, query, oracle). Statements are one text, or several, of which those that begin with
FAILS must fail and change nothing.
"""

from __future__ import annotations

FAILS = "-- fails\n"

QUERIES: dict[str, tuple] = {
    # scans, projection, filters
    "scan_project": ("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders", None),
    "scan_star": ("SELECT * FROM nation", None),
    "scan_qualified_star": ("SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "select_without_from": ("SELECT 1 + 1 AS two, 'a' AS letter, TRUE AS yes", None),
    "filter_compare": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'R'", None),
    "filter_and_or_not": ("SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey = 3", None),
    "filter_three_valued": ("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'F') = 'O' AND o_totalprice > 100000)", None),
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", None),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 950 AND 1500", None),
    "filter_in": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)", None),
    "filter_not_in": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE 'Brand#_2'", None),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%BRASS'", None),
    "is_null_after_left_join": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", None),
    "is_not_null": ("SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL", None),
    "timestamp_passthrough": ("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders", None),
    # expressions
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", None),
    "cast_matrix": (
        "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS whole, CAST(l_quantity AS TEXT) AS txt, CAST(l_returnflag = 'R' AS INTEGER) AS flag, CAST(CAST(l_orderkey AS TEXT) AS REAL) AS back, CAST('12.9' AS INTEGER) AS twelve FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CASE WHEN l_quantity = trunc(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS txt, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, CAST(l_orderkey AS DOUBLE) AS back, 12 AS twelve FROM lineitem",
    ),
    "cast_boolean": ("SELECT r_regionkey, CAST(r_regionkey = 1 AS TEXT) AS t, CAST('TRUE' AS BOOLEAN) AS b FROM region", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'true' ELSE 'false' END AS t, TRUE AS b FROM region"),
    "cast_blob": ("SELECT r_regionkey, CAST(CAST('0a FF' AS BLOB) AS TEXT) AS hex, length(x'0AFF') AS n FROM region", "SELECT r_regionkey, '0AFF' AS hex, 2 AS n FROM region"),
    "arith_div_mod_zero": (
        "SELECT o_orderkey, o_orderkey / o_custkey AS q, o_orderkey % o_custkey AS m, 0 - o_orderkey % 7 AS neg FROM orders",
        "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / nullif(o_custkey, 0) AS q, o_orderkey % nullif(o_custkey, 0) AS m, 0 - o_orderkey % 7 AS neg FROM orders",
    ),
    "arithmetic": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax - 2 AS v FROM lineitem", None),
    "unary_minus": ("SELECT s_suppkey, -s_acctbal AS neg, +s_suppkey AS pos FROM supplier", None),
    "string_concat": ("SELECT c_custkey, c_name || '/' || c_nationkey + 1 AS label, nullif(c_mktsegment, 'BUILDING') || '!' AS seg FROM customer", "SELECT c_custkey, c_name || '/' || CAST(c_nationkey + 1 AS VARCHAR) AS label, nullif(c_mktsegment, 'BUILDING') || '!' AS seg FROM customer"),
    "fn_upper_lower_length": ("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n FROM part", None),
    "fn_trim": ("SELECT p_partkey, trim('  ' || p_brand || ' ') AS t, ltrim('  ' || p_brand) AS l, rtrim(p_brand || '  ') AS r FROM part", None),
    "fn_substr": ("SELECT c_custkey, substr(c_name, 3, 4) AS a, substr(c_name, -3) AS b, substring(c_name, 5) AS c FROM customer", None),
    "fn_replace": ("SELECT p_partkey, replace(p_type, 'STEEL', '-') AS r FROM part", None),
    "fn_concat": ("SELECT c_custkey, concat(c_name, ':', nullif(c_mktsegment, 'BUILDING')) AS c FROM customer", "SELECT c_custkey, c_name || ':' || nullif(c_mktsegment, 'BUILDING') AS c FROM customer"),
    "fn_abs_round_floor_ceil": ("SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal) AS r FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(ceil(c_acctbal) AS DOUBLE) AS c, round(c_acctbal) AS r FROM customer"),
    "fn_coalesce_nullif": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, nullif(o_custkey, 1) AS c FROM orders", None),
    "fn_typeof": ("SELECT r_regionkey, typeof(r_name) AS a, typeof(r_regionkey) AS b, typeof(r_regionkey = 1) AS c, typeof(nullif(r_name, r_name)) AS d FROM region", "SELECT r_regionkey, 'string' AS a, 'number' AS b, 'boolean' AS c, 'null' AS d FROM region"),
    "fn_md5": ("SELECT c_custkey, md5(c_name) AS h FROM customer", None),
    "json_path": ("SELECT event_id, CAST(props.k AS INTEGER) AS k, props.missing AS missing FROM events WHERE props.k > 50", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50"),
    "json_group": ("SELECT props.k AS k, count(*) AS n FROM events GROUP BY props.k", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "fn_round_scale": (
        "SELECT c_custkey, round(c_acctbal / 7, 2) AS r, round(0.5 - c_custkey) AS half, round(0 - c_custkey - 0.25, 1) AS tie FROM customer",
        "SELECT c_custkey, round(c_acctbal / 7, 2) AS r, CAST(1 - c_custkey AS DOUBLE) AS half, 0 - c_custkey - CAST(0.2 AS DOUBLE) AS tie FROM customer",
    ),
    "fn_trim_all_space": ("SELECT n_nationkey, trim('\t\n ' || n_name || ' \r\n') AS t, length(ltrim(' \t' || n_name)) AS n FROM nation", "SELECT n_nationkey, n_name AS t, length(n_name) AS n FROM nation"),
    "like_backslash": ("SELECT n_nationkey, 'a\\' || n_name LIKE 'a\\A%' AS yes FROM nation", "SELECT n_nationkey, n_name LIKE 'A%' AS yes FROM nation"),
    "cast_json": ("SELECT n_nationkey, CAST('{\"a\":  \"' || n_name || '\", \"b\": [1, 2]}' AS JSON) AS j, typeof(CAST('[1]' AS JSON)) AS t FROM nation", "SELECT n_nationkey, '{\"a\":\"' || n_name || '\",\"b\":[1,2]}' AS j, 'json' AS t FROM nation"),
    "json_typeof": ("SELECT event_id, typeof(props.k) AS k, typeof(props.missing) AS m FROM events", "SELECT event_id, CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS k, 'null' AS m FROM events"),
    "quoted_names_and_comments": ('SELECT n."n_name" AS "the name", /* a note */ "n_regionkey" AS "Key" -- to the end\nFROM nation AS n', 'SELECT n_name AS "the name", n_regionkey AS "Key" FROM nation'),
    "default_names": ("SELECT count(*), max(n_name), n_regionkey FROM nation GROUP BY n_regionkey", "SELECT count(*) AS count_star, max(n_name) AS max_1, n_regionkey FROM nation GROUP BY n_regionkey"),
    "parameters": ("SELECT o_orderkey, $3 || o_orderstatus AS s FROM orders WHERE o_totalprice BETWEEN $1 AND $2 AND o_orderkey <> $4", "SELECT o_orderkey, 'x' || o_orderstatus AS s FROM orders WHERE o_totalprice BETWEEN 50000 AND 120000.5 AND o_orderkey <> 7", [50000, 120000.5, "x", 7]),
    # joins
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_full": ("SELECT s.s_suppkey, n.n_name FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'", None),
    "join_cross": ("SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b", None),
    "join_without_on": ("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b"),
    "join_using": ("SELECT a.o_orderkey, b.o_totalprice FROM orders a JOIN orders b USING (o_orderkey)", None),
    "join_self": ("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey", None),
    "join_three_way": ("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_on_single_side_predicate": ("SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0", None),
    "join_null_keys": ("SELECT a.o_orderkey, b.c_custkey FROM orders a LEFT JOIN customer b ON nullif(a.o_custkey, 7) = b.c_custkey", None),
    # subqueries
    "exists_semi": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", None),
    "not_exists_anti": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "not_in_subquery_with_null": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)", None),
    "in_subquery_or": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", None),
    "scalar_subquery": ("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)", None),
    "scalar_subquery_empty": ("SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey = 999) AS n FROM region", None),
    "correlated_scalar": ("SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c", None),
    "correlated_in_where": ("SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "not_in_subquery_empty": ("SELECT c_custkey FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)", None),
    "not_in_subquery_null_value": ("SELECT c_custkey FROM customer WHERE nullif(c_custkey, c_custkey) NOT IN (SELECT o_custkey FROM orders) OR c_custkey < 4", None),
    "not_in_as_value": ("SELECT n_nationkey, n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AS lone FROM nation", None),
    "exists_bound": ("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_acctbal >= p.p_retailprice * 9)", None),
    "derived_table": ("SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS d WHERE d.n > 10", None),
    "quantified_any": ("SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM supplier s WHERE p.p_retailprice < s.s_acctbal)", "SELECT p_partkey FROM part WHERE p_retailprice < (SELECT max(s_acctbal) FROM supplier)"),
    # aggregation
    "agg_global": ("SELECT count(*) AS n, CAST(sum(l_orderkey) AS INTEGER) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS a FROM lineitem", "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS a FROM lineitem"),
    "agg_empty_input": ("SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderstatus) AS m, avg(o_custkey) AS a FROM orders WHERE o_orderkey < 0", None),
    "agg_group": ("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag", None),
    "agg_group_multi": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_expression": ("SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10", None),
    "agg_group_null_key": ("SELECT nullif(o_orderstatus, 'F') AS k, count(*) AS n, count(nullif(o_orderstatus, 'F')) AS nn FROM orders GROUP BY nullif(o_orderstatus, 'F')", None),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000", None),
    "agg_count_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag", None),
    "agg_sum_avg_distinct": ("SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS INTEGER) AS s, round(avg(DISTINCT o_custkey), 6) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 6) AS a FROM orders GROUP BY o_orderstatus"),
    "agg_min_max_text": ("SELECT c_mktsegment, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment", None),
    # duplicates, order, limits, sets
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_null": ("SELECT DISTINCT nullif(o_orderstatus, 'F') AS s FROM orders", None),
    "order_nulls_default_asc": ("SELECT o_orderkey, nullif(o_custkey, o_custkey) AS z FROM orders ORDER BY nullif(o_orderstatus, 'F'), o_orderkey", "SELECT o_orderkey, nullif(o_custkey, o_custkey) AS z FROM orders ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey"),
    "order_nulls_default_desc": ("SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey DESC", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey DESC"),
    "order_explicit_nulls": ("SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'O') ASC NULLS FIRST, o_orderkey", None),
    "order_hidden_column": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey", None),
    "order_by_alias": ("SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC NULLS FIRST, k", None),
    "order_by_ordinal": ("SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2", "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC NULLS FIRST, 2"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10", None),
    "limit_offset": ("SELECT c_custkey FROM customer ORDER BY c_custkey NULLS LAST LIMIT 10 OFFSET 5", None),
    "union_all": ("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_chain": ("SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation UNION SELECT 99 ORDER BY k DESC NULLS FIRST LIMIT 4", None),
    # common table expressions
    "cte_single": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", None),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 10) SELECT c.c_name FROM customer c JOIN b ON c.c_custkey = b.k", None),
    "cte_multi_ref": ("WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT x.k, y.n FROM t x JOIN t y ON x.k = y.k WHERE x.n = (SELECT max(n) FROM t)", None),
    "recursive_union_all": ("WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 150) SELECT x FROM n", None),
    "recursive_union_dedup": ("WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * 7 + 3) % 11 FROM r) SELECT k FROM r", None),
    "recursive_hierarchy": (
        "WITH RECURSIVE h(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, h.depth + 1 FROM nation n JOIN h ON n.n_nationkey = 2 * h.k + 1 OR n.n_nationkey = 2 * h.k + 2) SELECT k, depth FROM h",
        None,
    ),
    # the shapes of the benchmark
    "bench_select_all": ("SELECT * FROM orders", None),
    "bench_point_lookup": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 1234", None),
    "bench_range": ("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1200", None),
    "bench_group_count_avg": ("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY o_orderpriority", None),
    "bench_join_group": ("SELECT p.p_brand, count(*) AS n, round(sum(l.l_extendedprice), 2) AS s FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand", None),
    "bench_join_filter": ("SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 45 AND l.l_quantity > 40", None),
    "bench_exists": ("SELECT count(*) AS n FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)", None),
    "bench_cte_join_order_limit": ("WITH t AS (SELECT l_partkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) SELECT p.p_partkey, p.p_name, round(t.q, 2) AS q FROM t JOIN part p ON p.p_partkey = t.k ORDER BY t.q DESC NULLS LAST, p.p_partkey LIMIT 10", None),
    "bench_join_count_distinct_having": ("SELECT p.p_brand, count(DISTINCT l.l_suppkey) AS n FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand HAVING count(DISTINCT l.l_suppkey) > 5", None),
    "flagship": (
        "SELECT n.n_name, count(*) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_returnflag = 'R' GROUP BY n.n_name HAVING count(*) > 1 ORDER BY revenue DESC NULLS LAST, n.n_name LIMIT 20",
        None,
    ),
}

_KV = "CREATE TABLE kv (k INTEGER PRIMARY KEY, v TEXT, n INTEGER DEFAULT 0); INSERT INTO kv (k, v) SELECT c_custkey, c_name FROM customer;"

#: Statements that change a database of their own, then the query that shows its state, and its oracle.
CHANGES: dict[str, tuple] = {
    "insert_select": (
        "CREATE TABLE o (k INTEGER PRIMARY KEY, price REAL, status TEXT, n INTEGER DEFAULT 3); INSERT INTO o (k, status, price) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders;",
        "SELECT k, price, status, n FROM o",
        "SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, 3 AS n FROM orders",
    ),
    "insert_values": ("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, ok BOOLEAN DEFAULT TRUE); INSERT INTO t (id, name) VALUES (1, 'a'), (2, NULL); INSERT INTO t VALUES (3, 'c', FALSE);", "SELECT id, name, ok FROM t", "SELECT * FROM (VALUES (1, 'a', TRUE), (2, NULL, TRUE), (3, 'c', FALSE)) v(id, name, ok)"),
    "insert_with_cte": (_KV + "INSERT INTO kv WITH sums AS (SELECT l_partkey AS p, count(*) AS c FROM lineitem GROUP BY l_partkey) SELECT 0 - p - 1, 'part', c FROM sums;", "SELECT k, v, n FROM kv", "SELECT c_custkey AS k, c_name AS v, 0 AS n FROM customer UNION ALL SELECT 0 - l_partkey - 1, 'part', count(*) FROM lineitem GROUP BY l_partkey"),
    "update_where": (_KV + "UPDATE kv SET n = k * 2, v = lower(v) WHERE k % 2 = 1;", "SELECT k, v, n FROM kv", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 1 THEN lower(c_name) ELSE c_name END AS v, CASE WHEN c_custkey % 2 = 1 THEN c_custkey * 2 ELSE 0 END AS n FROM customer"),
    "update_twice": (_KV + "UPDATE kv SET n = 1 WHERE k % 7 = 0; UPDATE kv SET n = n + 1, k = 0 - k WHERE k % 14 = 0 AND k <> 0; DELETE FROM kv WHERE n = 1;", "SELECT k, v, n FROM kv", "SELECT CASE WHEN c_custkey % 14 = 0 THEN 0 - c_custkey ELSE c_custkey END AS k, c_name AS v, CASE WHEN c_custkey % 14 = 0 THEN 2 ELSE 0 END AS n FROM customer WHERE c_custkey <> 0 AND (c_custkey % 7 <> 0 OR c_custkey % 14 = 0)"),
    "delete_where": (_KV + "DELETE FROM kv WHERE k % 5 > 2 OR v IS NULL;", "SELECT k, v FROM kv", "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 5 <= 2"),
    "upsert_do_nothing": (_KV + "INSERT INTO kv SELECT p_partkey, 'new', 1 FROM part ON CONFLICT DO NOTHING;", "SELECT k, v, n FROM kv", "SELECT c_custkey AS k, c_name AS v, 0 AS n FROM customer UNION ALL SELECT p_partkey, 'new', 1 FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)"),
    "upsert_do_update": (
        _KV + "INSERT INTO kv SELECT p_partkey, 'new', 5 FROM part ON CONFLICT (k) DO UPDATE SET v = kv.v || excluded.v, n = kv.n + excluded.n WHERE kv.k % 3 <> 0;",
        "SELECT k, v, n FROM kv",
        "SELECT coalesce(c_custkey, p_partkey) AS k, CASE WHEN c_custkey IS NULL THEN 'new' WHEN p_partkey IS NULL OR c_custkey % 3 = 0 THEN c_name ELSE c_name || 'new' END AS v, CASE WHEN c_custkey IS NOT NULL AND (p_partkey IS NULL OR c_custkey % 3 = 0) THEN 0 ELSE 5 END AS n FROM customer FULL JOIN part ON c_custkey = p_partkey",
    ),
    "upsert_null_keys": (
        "CREATE TABLE u (id INTEGER PRIMARY KEY, code TEXT UNIQUE); INSERT INTO u SELECT c_custkey, nullif(c_name, c_name) FROM customer; INSERT INTO u SELECT 0 - c_custkey - 1, nullif(c_name, c_name) FROM customer ON CONFLICT (code) DO NOTHING; INSERT INTO u VALUES (1000000000, NULL) ON CONFLICT (code) DO UPDATE SET code = 'hit';",
        "SELECT id, code FROM u",
        "SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS code FROM customer UNION ALL SELECT 0 - c_custkey - 1, NULL FROM customer UNION ALL SELECT 1000000000, NULL",
    ),
    "constraints_are_atomic": (
        (_KV, FAILS + "INSERT INTO kv SELECT p_partkey, 'x', 1 FROM part", FAILS + "UPDATE kv SET k = 1", "CREATE TABLE r (k INTEGER PRIMARY KEY, v TEXT NOT NULL)", FAILS + "INSERT INTO r SELECT n_nationkey, CASE WHEN n_nationkey <> 3 THEN n_name END FROM nation"),
        "SELECT k, v, n FROM kv UNION ALL SELECT k, v, 9 FROM r",
        "SELECT c_custkey AS k, c_name AS v, 0 AS n FROM customer",
    ),
    "index_unique_and_drop": (
        ("CREATE TABLE s (k INTEGER PRIMARY KEY, name TEXT)", "INSERT INTO s SELECT s_suppkey, s_name FROM supplier", "CREATE UNIQUE INDEX low ON s (lower(name))", FAILS + "INSERT INTO s SELECT 0 - s_suppkey - 1, upper(s_name) FROM supplier", "DROP INDEX low", "INSERT INTO s SELECT 0 - s_suppkey - 1, upper(s_name) FROM supplier"),
        "SELECT k, name FROM s",
        "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 0 - s_suppkey - 1, upper(s_name) FROM supplier",
    ),
    "drop_table": (("CREATE TABLE a (k INTEGER PRIMARY KEY)", "INSERT INTO a SELECT n_nationkey FROM nation", "DROP TABLE a", FAILS + "INSERT INTO a VALUES (1)", "DROP TABLE IF EXISTS a", "CREATE TABLE a (name TEXT)", "INSERT INTO a SELECT r_name FROM region"), "SELECT name FROM a", "SELECT r_name AS name FROM region"),
    "autoincrement": ("CREATE TABLE a (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT); INSERT INTO a (name) VALUES ('x'), ('y'); INSERT INTO a VALUES (70, 'z'), (NULL, 'w'); INSERT INTO a (name) VALUES ('v');", "SELECT id, name FROM a", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (70, 'z'), (71, 'w'), (72, 'v')) v(id, name)"),
    "alter_add_default": (_KV + "ALTER TABLE kv ADD COLUMN extra TEXT DEFAULT 'd'; ALTER TABLE kv DROP COLUMN n; INSERT INTO kv VALUES (-100, 'x', 'e');", "SELECT k, v, extra FROM kv", "SELECT c_custkey AS k, c_name AS v, 'd' AS extra FROM customer UNION ALL SELECT -100, 'x', 'e'"),
    "transaction_commit_rollback": (_KV + "BEGIN; DELETE FROM kv WHERE k % 2 = 0; COMMIT; BEGIN; DELETE FROM kv; ROLLBACK;", "SELECT k, v FROM kv", "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 <> 0"),
    "transaction_reads_own_writes": (_KV + "BEGIN; CREATE TABLE odd (k INTEGER PRIMARY KEY, n INTEGER); UPDATE kv SET n = 4 WHERE k % 2 = 1; INSERT INTO odd SELECT k, n FROM kv WHERE n = 4; COMMIT;", "SELECT k, n FROM odd", "SELECT c_custkey AS k, 4 AS n FROM customer WHERE c_custkey % 2 = 1"),
}
