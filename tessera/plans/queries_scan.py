"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import recursive, values
from tessera.plans.base import portable, query, statement
from tessera.session import table

statement("s1_full_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
statement("s2_rowid_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 42 OR o_orderkey IN (7, 99, 1500)")
statement("s3_rowid_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
statement("s4_index_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_partkey > 50 AND l_partkey <= 900")
statement("s5_covering_scan", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
statement("s6_multi_index_or", "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 5, 8) OR o_orderpriority = '1-URGENT' AND o_orderkey < 500")
statement("s7_ordered_grouping", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey")
statement("s8_count_range", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 10 AND 5000")
statement("s9_derived_scan", "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 12")
statement("s11_select_without_from", "SELECT CAST(1 + 1 AS BIGINT) AS two, 'x' AS letter, CAST(NULL AS VARCHAR(5)) AS nothing".replace("VARCHAR(5)", "STRING"))
statement("s12_common_tables", "WITH big(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE total > 1000000) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT k FROM top)")


@query("SELECT CAST(column1 AS BIGINT) AS column1, column2 FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) v(column1, column2)")
def s10_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(1, "a"), (2, "b"), (None, "c")])


@query("""WITH RECURSIVE reach(key) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (r.key * 3 + i.i) % 97 FROM reach r, (VALUES (0), (1), (5)) i(i)) SELECT CAST(key AS BIGINT) AS key FROM reach""")
def s13_recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION drops rows seen before, so the walk over a cyclic graph ends."""
    seed = spark.range(1, 2).select(F.col("id").alias("key"))
    steps = spark.createDataFrame([(0,), (1,), (5,)], "i long")
    return recursive(seed, lambda new: new.crossJoin(F.broadcast(steps)).select(((F.col("key") * 3 + F.col("i")) % 97).alias("key")))


statement("s13_recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


@query("WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n * 2 FROM t WHERE n < 512) SELECT n FROM t")
def s13_recursive_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT inside the recursion stops it."""
    return recursive(spark.range(1, 2).select(F.col("id").alias("n")), lambda new: new.select((F.col("n") * 2).alias("n")), distinct=False, limit=10)


statement("s18_view", "WITH v(segment, balance) AS (SELECT c_mktsegment, c_acctbal FROM customer) SELECT segment, round(max(balance), 2) AS top FROM v GROUP BY segment")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def s23_create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS SELECT into the warehouse, read back."""
    name = "tessera_ctas"
    table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


portable("s25_timestamp_scan", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND event_type <> 'view'")
