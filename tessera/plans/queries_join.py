"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import lateral_top, natural_join, range_join
from tessera.plans.base import query, statement
from tessera.session import table

statement("j1_inner", "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 9000")
statement("j1_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("j2_lookup", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IN (1, 2, 3, 77)")
statement("j3_hash", "SELECT s.s_nationkey, count(*) AS n, round(sum(l.l_extendedprice), 2) AS price FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_nationkey")
statement("j4_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
statement("j5_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")
statement("j6_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
statement("j7_full", "SELECT c.c_custkey AS left_key, s.s_suppkey AS right_key FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 30")
statement("j8_using_full", "SELECT k, a.x, b.y FROM (SELECT c_custkey AS k, c_name AS x FROM customer) a FULL JOIN (SELECT o_custkey * 2 AS k, max(o_orderkey) AS y FROM orders GROUP BY o_custkey) b USING (k)")
statement("j10_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
statement("j11_anti_null_aware", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 4) FROM orders)")
statement("j12_nested", "SELECT r.r_name, count(*) AS n FROM region r JOIN (nation n JOIN customer c ON c.c_nationkey = n.n_nationkey) ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
statement("j13_self", "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
statement("j13_many_tables", "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name")


@query("SELECT n_regionkey, n_nationkey, n_name, r_name FROM (SELECT * FROM nation) NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")
def j9_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return natural_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"))


@query("SELECT p.p_partkey, b.lo FROM part p JOIN (SELECT CAST(range AS DOUBLE) AS lo, CAST(range + 35 AS DOUBLE) AS hi FROM range(900, 2000, 50)) b ON p.p_retailprice BETWEEN b.lo AND b.hi")
def j4_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theta join over intervals as a hash join over bins."""
    bands = spark.range(900, 2000, 50).select(F.col("id").cast("double").alias("lo"), (F.col("id") + 35).cast("double").alias("hi"))
    return range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 50).select("p_partkey", "lo")


@query("SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def j14_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest orders of each customer, NULLs last as the oracle has them."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return lateral_top(customers, orders, "c_custkey", "o_custkey", [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")], 2).select("c_custkey", "o_orderkey")
