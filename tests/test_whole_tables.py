"""Queries that show a feature run over whole tables: no row is left out by id."""

import duckdb
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"


def count(sql):
    return duckdb.sql(sql.replace("{", f"'{SF}/").replace("}", ".parquet'")).fetchall()[0][0]


@pytest.mark.parametrize(("name", "table"), [("p1_projection", "orders"), ("p20_cast", "lineitem"), ("d6_returning", "customer")])
def test_every_row(spark, name, table):
    assert registry.QUERIES[name](spark, SF).count() == count(f"select count(*) from {{{table}}}")


@pytest.mark.parametrize(("name", "left", "right", "other"), [("j7_full", "left_key", "right_key", "select count(*) from {supplier}"), ("j8_using_full", "x", "y", "select count(distinct o_custkey) from {orders}")])
def test_both_sides_whole(spark, name, left, right, other):
    df = registry.QUERIES[name](spark, SF)
    assert df.filter(f"{left} is not null").count() == count("select count(*) from {customer}")
    assert df.filter(f"{right} is not null").count() == count(other)
    # matched rows and unmatched ones of either side
    assert {(r[left] is None, r[right] is None) for r in df.collect()} == {(False, False), (False, True), (True, False)}


def test_set_operations_of_whole_tables(spark):
    got = {n: {r.k for r in registry.QUERIES[f"o7_{n}"](spark, SF).collect()} for n in ("union", "intersect", "except")}
    rows = lambda sql: {r[0] for r in duckdb.sql(sql.replace("{", f"'{SF}/").replace("}", ".parquet'")).fetchall()}
    ordering, suppliers = rows("select o_custkey from {orders}"), rows("select s_suppkey * 30 from {supplier}")
    assert got["union"] == ordering | suppliers and got["intersect"] == ordering & suppliers and got["except"] == ordering - suppliers
    assert ordering - suppliers and suppliers - ordering and got["intersect"]


def test_lateral_keeps_order_through_spills(spark, tmp_path):
    # runs spilled every 50 rows come back in no order of their own, like blocks from other executors
    duckdb.sql(f"copy (select i as c_custkey from range(20) t(i)) to '{tmp_path}/customer.parquet'")
    duckdb.sql(f"copy (select i as o_orderkey, i % 20 as o_custkey, cast(hash(i) % 500 as double) as o_totalprice from range(20000) t(i)) to '{tmp_path}/orders.parquet'")
    want = duckdb.sql(registry.ORACLE_SQL["j14_lateral"].replace("customer c", f"'{tmp_path}/customer.parquet' c").replace("orders o", f"'{tmp_path}/orders.parquet' o")).fetchall()
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "50")
    try:
        got = [tuple(r) for r in registry.QUERIES["j14_lateral"](spark, str(tmp_path)).collect()]
    finally:
        conf.remove(key)
    assert len(want) == 40 and sorted(got) == sorted(want)
