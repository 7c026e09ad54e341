"""Order, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import compound, order_limit
from tessera.plans.base import portable, query, statement
from tessera.session import table

statement("o1_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
statement("o3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
statement("o5_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 15 OFFSET 30")
statement("o6_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
statement("o7_union", "SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey * 30 FROM supplier")
statement("o7_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey * 30 FROM supplier")
statement("o7_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey * 30 FROM supplier")


@query("SELECT k FROM ((SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) INTERSECT SELECT s_nationkey FROM supplier)")
def o7_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION before INTERSECT: operators bind from left to right."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    return compound(nation.select(F.col("n_nationkey").alias("k")), ("union", region.select(F.col("r_regionkey") + 100)), ("intersect", supplier.select("s_nationkey")))


@query("SELECT n_name FROM nation ORDER BY n_name OFFSET 3")
def o5_negative_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative limit is none."""
    return order_limit(table(spark, sf_dir, "nation").select("n_name"), [F.col("n_name")], -1, 3)


@query("SELECT CAST(k AS VARCHAR) AS k FROM (SELECT n_name AS k FROM nation WHERE n_regionkey = 1 UNION SELECT CAST(r_regionkey AS VARCHAR) FROM region)")
def o8_names_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("k"))
    return compound(nation, ("union", table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string"))))


portable("o9_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
