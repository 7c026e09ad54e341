"""Changes as snapshots, constraints and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.plans.base import query
from tessera.session import table
from tessera.sources.catalog import Catalog


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as customers: half of the keys exist already."""
    s = table(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))


_NEW = "(SELECT s_suppkey * 30 AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier)"
_OLD = "(SELECT c_custkey, c_name, c_acctbal FROM customer)"


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT c_custkey + 1000000, c_name, 0.5 FROM {_NEW}")
def d1_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT ... SELECT with a default for the missing column."""
    rows = _news(spark, sf_dir).select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name")
    return dml.insert(_customers(spark, sf_dir), rows, dml.Constraints(not_null=("c_name",), unique=(("c_custkey",),), defaults={"c_acctbal": "0.5"}))


@query(f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} n WHERE n.c_custkey NOT IN (SELECT c_custkey FROM customer)")
def d2_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert(_customers(spark, sf_dir), _news(spark, sf_dir), conflict="ignore", key=("c_custkey",))


@query(f"SELECT * FROM {_OLD} o WHERE o.c_custkey NOT IN (SELECT c_custkey FROM {_NEW}) UNION ALL SELECT * FROM {_NEW}")
def d2_insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert(_customers(spark, sf_dir), _news(spark, sf_dir), conflict="replace", key=("c_custkey",))


@query(f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_acctbal > 0 THEN o.c_acctbal + n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey")
def d3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.upsert(_customers(spark, sf_dir), _news(spark, sf_dir), ("c_custkey",), {"c_acctbal": "old.c_acctbal + excluded.c_acctbal"}, "excluded.c_acctbal > 0")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def d4_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update(_customers(spark, sf_dir), {"c_acctbal": "c_acctbal * 2"}, "c_custkey % 7 = 0")[0]


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT coalesce(nullif(c_acctbal, 0) < 0, false)")
def d5_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(_customers(spark, sf_dir), "nullif(c_acctbal, 0) < 0")[0]


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer")
def d6_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update(_customers(spark, sf_dir), {"c_acctbal": "c_acctbal + 1"})[1].select("c_custkey", "c_acctbal")


@query("SELECT 'check' AS kind, 'c_acctbal > 0' AS detail, count(*) AS n FROM customer WHERE c_acctbal <= 0 HAVING count(*) > 0 UNION ALL SELECT 'unique', 'c_nationkey', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def d8_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = dml.Constraints(not_null=("c_name",), unique=(("c_custkey",), ("c_nationkey",)), checks=("c_acctbal > 0",))
    return dml.violations(table(spark, sf_dir, "customer"), rules)


@query("SELECT c_name, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def d9_new_rowids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return dml.new_rowids(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "id", ["c_custkey"]).select("c_name", "id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 0")
def d10_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted customers take their orders and these their lines along."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    rules = {"orders": dml.Constraints(foreign_keys=(dml.ForeignKey(("o_custkey",), "customer", ("c_custkey",), "cascade"),)), "lineitem": dml.Constraints(foreign_keys=(dml.ForeignKey(("l_orderkey",), "orders", ("o_orderkey",), "cascade"),))}
    tables["customer"], gone = dml.delete(tables["customer"], "c_custkey % 10 = 0")
    return dml.cascade(tables, rules, "customer", gone)["lineitem"].select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, s_name || 'x' AS tag, CAST(s_suppkey * 2 AS BIGINT) AS twice, s_name || 'x' || CAST(s_suppkey * 2 AS VARCHAR) AS both FROM supplier")
def d12_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = spark.createDataFrame([], "s_suppkey long, s_name string, tag string, twice long, both string")
    rules = dml.Constraints(generated={"both": "tag || cast(twice as string)", "tag": "s_name || 'x'", "twice": "s_suppkey * 2"})
    return dml.completed(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), shape, rules).select("s_suppkey", "tag", "twice", "both")


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog(spark)
    c.create("region", {"r_regionkey": "INTEGER", "r_name": "TEXT"}, ("r_regionkey",), data=table(spark, sf_dir, "region"))
    key = dml.ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "cascade")
    c.create("nation", {"n_nationkey": "INTEGER", "n_name": "TEXT", "n_regionkey": "INT"}, ("n_nationkey",), dml.Constraints(not_null=("n_name",), foreign_keys=(key,)), table(spark, sf_dir, "nation"))
    c.create_index("nation", "by_region", ("n_regionkey", "n_name"))
    c.create_view("v", "SELECT n_name FROM nation", c.table("nation").select("n_name"))
    return c


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'n_nationkey', 'INTEGER', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(1 AS BIGINT)), (1, 'n_name', 'TEXT', 1, NULL, 0), (2, 'n_regionkey', 'INT', 0, NULL, 0)) t(cid, name, type, \"notnull\", dflt_value, pk)")
def g1_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).table_info("nation")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'by_region', CAST(0 AS BIGINT), 'c', CAST(0 AS BIGINT)), (1, 'sqlite_autoindex_nation_1', 1, 'pk', 0)) t(seq, name, \"unique\", origin, partial)")
def g2_index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).index_list("nation")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(2 AS BIGINT), 'n_regionkey'), (1, 1, 'n_name')) t(seqno, cid, name)")
def g3_index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).index_info("by_region")


@query("SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS seq, 'region' AS \"table\", 'n_regionkey' AS \"from\", 'r_regionkey' AS \"to\", 'NO ACTION' AS on_update, 'CASCADE' AS on_delete, 'NONE' AS \"match\"")
def g4_foreign_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).foreign_key_list("nation")


@query("SELECT n_nationkey, n_name, n_regionkey + 3 AS n_regionkey, 'region' AS parent, CAST(0 AS BIGINT) AS fkid FROM nation WHERE n_regionkey + 3 NOT IN (SELECT r_regionkey FROM region)")
def g5_foreign_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    c.tables["nation"].data = c.table("nation").withColumn("n_regionkey", F.col("n_regionkey") + 3)
    return c.foreign_key_check("nation")


@query("SELECT 'ok' AS integrity_check")
def g6_integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).integrity_check()


@query("SELECT * FROM (VALUES ('main', 'region', 'table', CAST(2 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)), ('main', 'nation', 'table', 3, 0, 0), ('main', 'v', 'view', 1, 0, 0)) t(schema, name, type, ncol, wr, strict)")
def g7_table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).table_list()


@query("SELECT CAST(0 AS BIGINT) AS seq, 'main' AS name, '' AS file")
def g8_database_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).database_list()


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'BINARY'), (1, 'NOCASE'), (2, 'RTRIM')) t(seq, name)")
def g9_collation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).collation_list()


@query("SELECT type, name, tbl_name FROM (VALUES ('table', 'region', 'region'), ('table', 'nation', 'nation'), ('index', 'sqlite_autoindex_region_1', 'region'), ('index', 'sqlite_autoindex_nation_1', 'nation'), ('index', 'by_region', 'nation'), ('view', 'v', 'v')) t(type, name, tbl_name)")
def s20_schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).schema().select("type", "name", "tbl_name")
