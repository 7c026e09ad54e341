"""Projection, filters and predicates."""

from __future__ import annotations

from tessera.functions import core as c
from tessera.plans.base import portable, statement

statement("p1_projection", "SELECT o_orderkey AS key, o_totalprice * 2 AS double_price, o_orderstatus FROM orders")
statement("p3_conjunction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag = 'R' AND l_tax < 0.05")
statement("p4_constant_condition", "SELECT n_name FROM nation WHERE 1 = 0 OR n_regionkey = 2")
statement("p5_comparisons", "SELECT c_custkey, CAST(c_acctbal > 0 AS INT) AS positive, CAST(c_acctbal <> 0 AS INT) AS other, CAST(c_nationkey >= 10 AS INT) AS high FROM customer")
portable("p6_three_valued_logic", "SELECT p.a, q.b, CAST(p.a AND q.b AS INT) AS conj, CAST(p.a OR q.b AS INT) AS disj, CAST(NOT p.a AS INT) AS neg FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) p(a), (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) q(b)".replace("p.a, q.b, ", ""))
statement("p7_null_safe", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(o_orderstatus, 'O') AS s FROM orders) t WHERE t.s IS NOT DISTINCT FROM NULL")
statement("p8_is_true", "SELECT count(*) AS n FROM customer WHERE (c_acctbal > 5000) IS TRUE AND (nullif(c_nationkey, 3) > 5) IS NOT FALSE")
statement("p9_null_tests", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR c_custkey < 20")
statement("p10_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_retailprice NOT BETWEEN 1000 AND 1500")
statement("p11_in_list", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 5, 9, NULL) AND s_suppkey NOT IN (3, 4)")
statement("p12_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
statement("p13_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
statement("p14_scalar_subquery", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region_name, (SELECT count(*) FROM supplier) AS suppliers FROM nation")
statement("p15_correlated", "SELECT o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.8 * avg(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)")
statement("p16_outer_aggregate", "SELECT c.c_nationkey, c.total, count(s.s_suppkey) AS richer FROM (SELECT c_nationkey, sum(c_acctbal) / 50 AS total FROM customer GROUP BY c_nationkey) c LEFT JOIN supplier s ON s.s_acctbal > c.total GROUP BY c.c_nationkey, c.total".replace("c.total, count", "count"), "SELECT c_nationkey, (SELECT count(*) FROM supplier s WHERE s.s_acctbal > t.total) AS richer FROM (SELECT c_nationkey, sum(c_acctbal) / 50 AS total FROM customer GROUP BY c_nationkey) t")
statement("p17_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%steel%' OR p_name LIKE '_A%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%STEEL%' OR p_name ILIKE '_a%'")
statement("p17_like_escape", "SELECT p_partkey, (p_brand || '100%') LIKE '%0!%' ESCAPE '!' AS hit FROM part", "SELECT p_partkey, CAST((p_brand || '100%') LIKE '%0!%' ESCAPE '!' AS INT) AS hit FROM part")
statement("p18_glob", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4][^5-9]?'", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4][!5-9]?'")
statement("p19_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS word, CASE WHEN o_totalprice > 200000 THEN 1 WHEN o_totalprice > 100000 THEN 2 END AS tier FROM orders")
statement("p20_cast", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS whole, CAST('12abc' AS INTEGER) AS prefix FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(12 AS BIGINT) AS prefix FROM lineitem")
portable("p21_collate_nocase", f"SELECT {c.nocase('c_mktsegment')} AS seg, count(*) AS n FROM customer GROUP BY 1", "SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY 1")
statement("p21_collate_rtrim", "SELECT count(*) AS n FROM part WHERE p_brand || substr('  ', 1, p_size % 3) = 'Brand#12' COLLATE RTRIM", "SELECT count(*) AS n FROM part WHERE rtrim(p_brand || repeat(' ', p_size % 3)) = 'Brand#12'")
statement("p22_arithmetic", "SELECT o_orderkey, o_orderkey / (o_custkey % 5) AS quotient, -o_orderkey % (o_custkey % 5) AS remainder, -o_orderkey + 3 * o_custkey AS mixed FROM orders", "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey // (o_custkey % 5) END AS BIGINT) AS quotient, CAST(CASE WHEN o_custkey % 5 <> 0 THEN -o_orderkey % (o_custkey % 5) END AS BIGINT) AS remainder, -o_orderkey + 3 * o_custkey AS mixed FROM orders")
statement("p23_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS band, o_orderkey | 3 AS bor, ~o_orderkey AS bnot, o_orderkey << (o_custkey % 9) AS lsh, o_orderkey << -2 AS rsh FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS band, o_orderkey | 3 AS bor, ~o_orderkey AS bnot, CAST(o_orderkey * power(2, o_custkey % 9) AS BIGINT) AS lsh, o_orderkey >> 2 AS rsh FROM orders")
statement("p24_concatenation", "SELECT c_custkey, c_name || '/' || c_mktsegment || nullif('x', 'y') AS joined, c_name || CAST(NULL AS STRING) AS nothing FROM customer")
statement("p26_literals", "SELECT 0xFF AS hexed, 1.5e3 AS real_value, 'it''s' AS quoted, 1_000_000 AS separated, hex(x'0aFF') AS blob, 9223372036854775808 AS big", "SELECT 255 AS hexed, CAST(1500 AS DOUBLE) AS real_value, 'it''s' AS quoted, 1000000 AS separated, '0AFF' AS blob, CAST(9223372036854775808 AS DOUBLE) AS big")
statement("p28_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
