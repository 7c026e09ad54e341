"""Statements of the dialect that need a connection: views, row ids, counters, definitions, JSON in SQL, settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.base import ORACLE_SQL, QUERIES, TABLES, statement


def _script(name: str, statements: str, text: str, oracle: str) -> None:
    """A query after statements on a connection of its own, over the tables that either names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.plans.connection import connect

        named = {t for t in TABLES if re.search(rf"\b{t}\b", f"{statements} {text}", re.I)}
        db = connect(spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named})
        db.executescript(statements)
        return db.query(text)

    QUERIES[name], ORACLE_SQL[name] = run, oracle


_NATIONS = "CREATE TABLE n(id INTEGER PRIMARY KEY, name TEXT, region INTEGER DEFAULT 0); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation"

_script("s2_rowid", _NATIONS, "SELECT rowid AS r, name FROM n WHERE rowid = 7 OR oid = 9", "SELECT n_nationkey AS r, n_name AS name FROM nation WHERE n_nationkey IN (7, 9)")
_script("s14_pragma_table_function", _NATIONS, "SELECT cid, name, type, pk FROM pragma_table_info('n')", "SELECT * FROM (VALUES (0, 'id', 'INTEGER', 1), (1, 'name', 'TEXT', 0), (2, 'region', 'INTEGER', 0)) v(cid, name, type, pk)")
_script("s18_stored_view", f"{_NATIONS}; CREATE VIEW far(k, v) AS SELECT id, upper(name) FROM n WHERE region > 1; DELETE FROM n WHERE id = 8", "SELECT k, v FROM far", "SELECT n_nationkey AS k, upper(n_name) AS v FROM nation WHERE n_regionkey > 1 AND n_nationkey <> 8")
_script("s19_temporary_table", "CREATE TEMP TABLE t AS SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1", "SELECT k, n FROM t", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1")
_script("d13_drop_and_create", f"{_NATIONS}; CREATE UNIQUE INDEX u ON n(name); DROP INDEX u; INSERT INTO n SELECT id + 1000, name, region FROM n; DROP VIEW IF EXISTS nothing", "SELECT name, count(*) AS k FROM n GROUP BY name", "SELECT n_name AS name, 2 AS k FROM nation")
_script("d14_alter_table", f"{_NATIONS}; ALTER TABLE n RENAME COLUMN region TO r; ALTER TABLE n ADD COLUMN extra TEXT DEFAULT 'e'; ALTER TABLE n RENAME TO m; ALTER TABLE m DROP COLUMN name", "SELECT * FROM m", "SELECT n_nationkey AS id, n_regionkey AS r, 'e' AS extra FROM nation")
_script("d15_d17_upkeep", f"{_NATIONS}; ANALYZE; REINDEX; VACUUM", "SELECT count(*) AS n FROM n NOT INDEXED", "SELECT count(*) AS n FROM nation")
_script("d18_rollback", f"{_NATIONS}; BEGIN; DELETE FROM n; ROLLBACK; BEGIN; DELETE FROM n WHERE region = 0; COMMIT", "SELECT id FROM n", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 0")
_script("d2_conflicts_by_row", "CREATE TABLE t(k INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER NOT NULL CHECK (n <> 3)); INSERT OR IGNORE INTO t SELECT n_nationkey, n_name, nullif(n_regionkey, 1) FROM nation; INSERT OR REPLACE INTO t SELECT 100, n_name, 7 FROM nation WHERE n_nationkey = 0", "SELECT k, n FROM t", "SELECT CASE WHEN n_nationkey = 0 THEN 100 ELSE n_nationkey END AS k, CASE WHEN n_nationkey = 0 THEN 7 ELSE n_regionkey END AS n FROM nation WHERE n_nationkey = 0 OR n_regionkey NOT IN (1, 3)")
_script("d10_key_update", f"PRAGMA foreign_keys = ON; CREATE TABLE r(id INTEGER PRIMARY KEY, name TEXT); INSERT INTO r SELECT r_regionkey, r_name FROM region; CREATE TABLE k(id INTEGER PRIMARY KEY, r INTEGER REFERENCES r(id) ON UPDATE CASCADE); INSERT INTO k SELECT n_nationkey, n_regionkey FROM nation; UPDATE r SET id = id + 10 WHERE id > 2", "SELECT id, r FROM k", "SELECT n_nationkey AS id, CASE WHEN n_regionkey > 2 THEN n_regionkey + 10 ELSE n_regionkey END AS r FROM nation")
_script("d11_triggers", f"{_NATIONS}; CREATE TABLE log(what TEXT, id INTEGER, a TEXT, b TEXT); CREATE TRIGGER t1 AFTER UPDATE OF name ON n WHEN new.region = 2 BEGIN INSERT INTO log VALUES ('upd', old.id, old.name, new.name); END; CREATE TRIGGER t2 BEFORE DELETE ON n BEGIN INSERT INTO log SELECT 'del', old.id, old.name, r_name FROM region WHERE r_regionkey = old.region; END; UPDATE n SET name = lower(name); DELETE FROM n WHERE region > 3", "SELECT what, id, a, b FROM log", "SELECT 'upd' AS what, n_nationkey AS id, n_name AS a, lower(n_name) AS b FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'del', n_nationkey, lower(n_name), r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 3")
_script("d7_instead_of", f"{_NATIONS}; CREATE VIEW v AS SELECT id, name FROM n; CREATE TRIGGER vi INSTEAD OF INSERT ON v BEGIN INSERT INTO n VALUES (new.id + 100, new.name, 7); END; CREATE TRIGGER vd INSTEAD OF DELETE ON v BEGIN DELETE FROM n WHERE id = old.id; END; INSERT INTO v SELECT r_regionkey, r_name FROM region; DELETE FROM v WHERE id < 20", "SELECT id, name, region FROM n", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT r_regionkey + 100, r_name, 7 FROM region")
_script("p29_raise", f"{_NATIONS}; CREATE TRIGGER g BEFORE INSERT ON n WHEN new.region > 4 BEGIN SELECT raise(ABORT, 'no such region'); END; INSERT INTO n SELECT n_nationkey + 50, n_name, n_regionkey FROM nation", "SELECT count(*) AS n, max(region) AS top FROM n", "SELECT 2 * count(*) AS n, max(n_regionkey) AS top FROM nation")
_script("f46_counters", f"{_NATIONS}; UPDATE n SET region = 9 WHERE id < 5; DELETE FROM n WHERE id >= 20", "SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS r", "SELECT count(*) FILTER (WHERE n_nationkey >= 20) AS c, count(*) + 5 + count(*) FILTER (WHERE n_nationkey >= 20) AS t, max(n_nationkey) AS r FROM nation")
_script("p21_column_collation", "CREATE TABLE t(w TEXT COLLATE NOCASE, n INTEGER); INSERT INTO t SELECT iif(p_partkey % 2, lower(p_brand), upper(p_brand)), p_size FROM part", "SELECT lower(max(w)) AS w, count(*) AS n, (SELECT count(*) FROM t WHERE w = 'brand#12') AS ones, (SELECT count(DISTINCT w) FROM t) AS kinds FROM t GROUP BY w", "SELECT lower(p_brand) AS w, count(*) AS n, (SELECT count(*) FROM part WHERE p_brand = 'Brand#12') AS ones, (SELECT count(DISTINCT p_brand) FROM part) AS kinds FROM part GROUP BY 1")
_script("g10_g13_settings", "PRAGMA user_version = 42; PRAGMA application_id = 7", "SELECT user_version AS u, encoding AS e, page_size AS p FROM pragma_user_version, pragma_encoding, pragma_page_size", "SELECT 42 AS u, 'UTF-8' AS e, 4096 AS p")

statement("f8_likelihood", "SELECT c_custkey FROM customer WHERE unlikely(c_nationkey = 3) OR likelihood(c_nationkey = 4, 0.1)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4)")
statement("f20_unistr", "SELECT c_custkey, unistr(c_name || '\\u00e9') AS v FROM customer", "SELECT c_custkey, c_name || 'é' AS v FROM customer")
statement("f22_glob", "SELECT c_custkey, glob(substr(c_name, 1, 3) || '*' || c_nationkey, c_name) AS v FROM customer", "SELECT c_custkey, CAST(ends_with(c_name, CAST(c_nationkey AS VARCHAR)) AS INT) AS v FROM customer")
statement("f23_like", "SELECT c_custkey, like('%BUILD%', c_mktsegment) AS v FROM customer", "SELECT c_custkey, CAST(c_mktsegment LIKE '%BUILD%' AS INT) AS v FROM customer")
statement("f24_printf", "SELECT c_custkey, printf('%05d|%s|%.1f', c_custkey, c_mktsegment, c_nationkey) AS v FROM customer", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '|' || c_mktsegment || '|' || c_nationkey || '.0' AS v FROM customer")
statement("f28_randomblob", "SELECT c_custkey, length(randomblob(12)) AS v, typeof(random()) AS t FROM customer", "SELECT c_custkey, 12 AS v, 'integer' AS t FROM customer")
statement("f53_timediff", "SELECT o_orderkey, timediff(datetime(o_orderdate, '+3 hours', '+5 days'), o_orderdate) AS v FROM orders", "SELECT o_orderkey, '+0000-00-05 03:00:00.000' AS v FROM orders")
statement("f54_current", "SELECT length(current_date) AS d, length(current_time) AS t, length(current_timestamp) AS s, date('now') = current_date AS same", "SELECT 10 AS d, 8 AS t, 19 AS s, 1 AS same")
statement("p2_unique_names", "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey", 'SELECT a.n_name AS "n_name", b.n_name AS "n_name:1" FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey')
statement("p30_precedence", "SELECT n_nationkey, 1 + n_regionkey * 2 << 1 AS a, NOT n_regionkey = 1 AS b, n_regionkey | 4 & 6 AS c, -n_nationkey % 3 AS d, 2 < n_regionkey = 1 AS e FROM nation", "SELECT n_nationkey, (1 + n_regionkey * 2) * 2 AS a, CAST(n_regionkey <> 1 AS INT) AS b, (n_regionkey | 4) & 6 AS c, -(n_nationkey % 3) AS d, CAST(n_regionkey > 2 AS INT) AS e FROM nation")
statement("o2_compound_order", "SELECT n_name AS k FROM nation UNION SELECT r_name FROM region ORDER BY k DESC LIMIT 6", "SELECT k FROM (SELECT n_name AS k FROM nation UNION SELECT r_name FROM region) ORDER BY k DESC LIMIT 6")
statement("w20_fixed_frames", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS r, lag(s_suppkey, 2, 0) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS l FROM supplier")
statement("w17_sql_groups", "SELECT p_partkey, count(*) OVER w AS n, sum(p_size) OVER w AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING)", "SELECT p_partkey, count(*) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
for _kind in ("CURRENT ROW", "GROUP", "TIES"):
    _frame = f"PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {_kind}"
    statement(f"w18_sql_exclude_{_kind.lower().replace(' ', '_')}", f"SELECT p_partkey, count(p_size) OVER ({_frame}) AS n, sum(p_size) OVER ({_frame}) AS s FROM part", f"SELECT p_partkey, count(p_size) OVER ({_frame}) AS n, CAST(sum(p_size) OVER ({_frame}) AS BIGINT) AS s FROM part")
statement("f5_mixed_classes", "SELECT c_custkey, min(c_name, c_nationkey, 12) AS low, max(c_name, c_nationkey) AS high, '1' = 1 AS same, c_nationkey = '3' AS three FROM customer", "SELECT c_custkey, least(c_nationkey, 12) AS low, c_name AS high, 0 AS same, CAST(c_nationkey = 3 AS INT) AS three FROM customer")

_K = "(props::JSON->>'$.k')"
for _name, _text, _oracle in (
    ("n1_sql_json", "json(' ' || props || ' ')", f"'{{\"k\":' || {_K} || '}}'"),
    ("n3_sql_json_type", "json_type(props, '$.' || 'k')", "'integer'"),
    ("n4_sql_json_extract", "json_extract(props, '$.k', '$.none')", f"'[' || {_K} || ',null]'"),
    ("n6_sql_json_object", "json_object('id', event_id, 'p', json(props), 'a', json_array(event_id, 'x', null))", f"'{{\"id\":' || event_id || ',\"p\":{{\"k\":' || {_K} || '}},\"a\":[' || event_id || ',\"x\",null]}}'"),
    ("n6_sql_json_quote", "json_quote(props ->> 'k')", f"'\"' || {_K} || '\"'"),
    ("n7_sql_json_set", "json_set(props, '$.k', event_id, '$.z', json_array(1))", "'{\"k\":' || event_id || ',\"z\":[1]}'"),
    ("n7_sql_json_insert", "json_insert(props, '$.k', 1, '$.z', event_id)", f"'{{\"k\":' || {_K} || ',\"z\":' || event_id || '}}'"),
    ("n7_sql_json_replace", "json_replace(props, '$.k', event_id, '$.z', 2)", "'{\"k\":' || event_id || '}'"),
    ("n7_sql_json_array_insert", "json_array_insert('[1,2]', '$[0]', event_id)", "'[' || event_id || ',1,2]'"),
    ("n8_sql_json_remove", "json_remove('[' || event_id || ',2,3]', '$[#-1]')", "'[' || event_id || ',2]'"),
    ("n9_sql_json_patch", "json_patch(props, json_object('k', null, 'a', event_id))", "'{\"a\":' || event_id || '}'"),
    ("n10_sql_json_pretty", "json_pretty(props, '  ')", f"'{{' || chr(10) || '  \"k\": ' || {_K} || chr(10) || '}}'"),
    ("n11_sql_json_error_position", "json_error_position(props) + json_valid(props)", "1"),
    ("n12_sql_path_from_end", "json_extract('[1,' || event_id || ']', '$[#-1]') + 0", "CAST(event_id AS DOUBLE)"),
    ("p25_sql_arrows", "(props -> 'k') || (props ->> ('$.' || 'k'))", f"{_K} || {_K}"),
):
    statement(_name, f"SELECT event_id, {_text} AS v FROM events", f"SELECT event_id, {_oracle} AS v FROM events")
