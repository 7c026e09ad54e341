"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.windows import UNBOUNDED_BEFORE, exclude_any, exclude_sum_count, filtered, groups_frame
from tessera.plans.base import query, statement
from tessera.session import table

_O = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
statement("w1_row_number", f"SELECT o_orderkey, row_number() OVER ({_O}) AS n FROM orders")
statement("w2_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r FROM customer")
statement("w3_dense_rank", "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS r FROM customer")
statement("w4_percent_rank", "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 9) AS r FROM supplier")
statement("w5_cume_dist", "SELECT s_suppkey, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 9) AS r FROM supplier")
statement("w6_ntile", "SELECT c_custkey, ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS t FROM customer")
statement("w7_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_O}) AS before, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_O}) AS after FROM orders")
statement("w8_first_value", f"SELECT o_orderkey, first_value(o_totalprice) OVER ({_O}) AS v FROM orders")
statement("w9_last_value", f"SELECT o_orderkey, last_value(o_orderkey) OVER ({_O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM orders")
statement("w10_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 3) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
statement("w11_aggregates_over", f"SELECT o_orderkey, count(*) OVER w1 AS n, max(o_orderkey) OVER w1 AS m, round(sum(o_totalprice) OVER w1, 2) AS s FROM orders WINDOW w1 AS ({_O})")
statement("w14_nulls_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_custkey, 7) DESC NULLS FIRST, o_orderkey) AS n FROM orders")
statement("w15_rows_frame", f"SELECT o_orderkey, count(*) OVER ({_O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, min(o_orderkey) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM orders")
statement("w16_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM part")
statement("w19_default_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part")
statement("w21_named_chain", "SELECT s_suppkey, row_number() OVER v AS n, count(*) OVER w AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey), v AS (w ORDER BY s_acctbal, s_suppkey)", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier")
statement("w24_window_over_aggregate", "SELECT c_nationkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY c_nationkey) AS BIGINT) AS running FROM customer GROUP BY c_nationkey")


@query("SELECT p_partkey, count(*) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def w17_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups_frame(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size")], -1, 2, {"n": F.count("*"), "s": F.sum("p_size")})
    return out.select("p_partkey", "n", "s")


def _exclude(kind: str):
    sql = f"SELECT p_partkey, count(p_size) OVER w AS x_count, CAST(sum(p_size) OVER w AS BIGINT) AS x_sum FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {kind.upper()})"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = exclude_sum_count(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size")], lambda w: w.rangeBetween(UNBOUNDED_BEFORE, 0), "p_size", kind, "x")
        return out.select("p_partkey", "x_count", F.col("x_sum").cast("long"))

    f.__name__ = f"w18_exclude_{kind.replace(' ', '_')}"
    query(sql)(f)


for _kind in ("current row", "group", "ties", "no others"):
    _exclude(_kind)


@query("SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM supplier")
def w18_exclude_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that can't be subtracted, over the frame's rows."""
    order = [F.col("s_acctbal"), F.col("s_suppkey")]
    out = exclude_any(table(spark, sf_dir, "supplier"), ["s_nationkey"], order, "s_suppkey", lambda w: w.rowsBetween(-2, 2), "s_acctbal", "current row", F.array_max, "m")
    return out.select("s_suppkey", "m")


@query("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def w22_filter_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F", w).alias("n"))


@query("SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS names FROM nation")
def w12_group_concat_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(-1, 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.collect_list("n_name").over(w), ",").alias("names"))


@query("SELECT n_nationkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' AS keys FROM nation")
def w13_json_group_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.collect_list("n_nationkey").over(w)).alias("keys"))
