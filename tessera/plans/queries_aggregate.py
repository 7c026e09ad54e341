"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators.relational import group_with_bare
from tessera.plans.base import portable, query, statement
from tessera.session import table

statement("a1_hash_aggregate", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
statement("a2_two_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
statement("a3_global_empty", "SELECT count(*) AS n, max(o_orderkey) AS m, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
portable("a4_group_by_alias", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY y")
statement("a4_group_by_ordinal", "SELECT c_nationkey % 5 AS bucket, count(*) AS n FROM customer GROUP BY 1")
statement("a5_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND min(o_totalprice) < 20000")
statement("a7_counts", "SELECT count(*) AS everything, count(nullif(o_orderstatus, 'O')) AS some, count(DISTINCT o_custkey) AS customers FROM orders")
statement("a8_sum", "SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey")
statement("a9_avg", "SELECT p_brand, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand")
statement("a11_min_max", "SELECT p_brand, min(p_name) AS first_name, max(p_retailprice) AS top FROM part GROUP BY p_brand")
statement("a15_distinct_aggregates", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
statement("a16_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS rest FROM orders GROUP BY o_orderpriority")
portable("a18_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT o_orderstatus, max(o_totalprice) AS max_o_totalprice, arg_max(o_orderkey, o_totalprice) AS o_orderkey, arg_max(o_custkey, o_totalprice) AS o_custkey FROM orders GROUP BY o_orderstatus")
def a6_bare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare columns come from the row of the lone maximum."""
    return group_with_bare(table(spark, sf_dir, "orders"), ["o_orderstatus"], ("max", "o_totalprice"), ["o_orderkey", "o_custkey"])


@query("SELECT c_mktsegment, CAST(coalesce(sum(c_acctbal) FILTER (WHERE c_acctbal > 9990), 0.0) AS DOUBLE) AS rich FROM customer GROUP BY c_mktsegment")
def a10_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") > 9990, F.col("c_acctbal")))
    return rich.groupBy("c_mktsegment").agg(A.total("v").alias("rich"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey DESC) AS keys FROM nation GROUP BY n_regionkey")
def a12_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.group_concat("n_name", ";").alias("names"), A.group_concat("n_nationkey", ",", ["n_nationkey desc"]).alias("keys"))


@query("SELECT n_regionkey, '[' || string_agg(coalesce('\"' || nullif(n_name, 'CHINA') || '\"', 'null'), ',' ORDER BY n_nationkey) || ']' AS names FROM nation GROUP BY n_regionkey")
def a13_json_group_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("v", F.expr("nullif(n_name, 'CHINA')"))
    return rows.groupBy("n_regionkey").agg(A.json_group_array("v", "text", ["n_nationkey"]).alias("names"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || '}' AS keys FROM nation GROUP BY n_regionkey")
def a14_json_group_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.json_group_object("n_name", "n_nationkey", "integer", ["n_nationkey"]).alias("keys"))
