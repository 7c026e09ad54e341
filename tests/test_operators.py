import pytest

from tessera.operators import dml
from tessera.operators.relational import compound, group_with_bare, recursive, unique_names
from tessera.sources.catalog import Catalog
from tessera.sources.tables import walk
from tessera.streaming import run_available, windowed_counts


def test_compound_is_left_associative(spark):
    one, two = (spark.createDataFrame([(i,) for i in v], "x long") for v in ([1, 1, 2], [2, 3]))
    got = compound(one, ("union", two), ("intersect", two), ("union all", two))
    assert sorted(r.x for r in got.collect()) == [2, 2, 3, 3]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long").toDF("a", "b", "A")
    assert unique_names(df).columns == ["a", "b", "A:1"]


def test_bare_columns_of_minimum(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "b"), ("x", 1, "a"), ("y", None, "z")], "k string, v long, w string")
    got = {r.k: (r.min_v, r.w) for r in group_with_bare(df, ["k"], ("min", "v"), ["w"]).collect()}
    assert got == {"x": (1, "a"), "y": (None, "z")}


def test_recursion_stops_on_cycle_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None)], "a long, b long")
    got = recursive(spark.createDataFrame([(1,)], "n long"), lambda new: new.join(edges, new["n"] == edges["a"]).select("b"))
    assert sorted((r.n is None, r.n or 0) for r in got.collect()) == [(False, 1), (False, 2), (False, 3), (True, 0)]


def test_constraints(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    rules = dml.Constraints(not_null=("id",), unique=(("id",), ("name",)), checks=("id > 0",))
    assert dml.violations(t, rules).count() == 0
    with pytest.raises(dml.ConstraintError, match="unique id"):
        dml.insert(t, spark.createDataFrame([(1, "z")], t.schema), rules)
    with pytest.raises(dml.ConstraintError, match="check"):
        dml.update(t, {"id": "-id"}, None, rules)
    kids = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "k long, parent long")
    fk = dml.Constraints(foreign_keys=(dml.ForeignKey(("parent",), "t", ("id",)),))
    assert [tuple(r) for r in dml.violations(kids, fk, {"t": t}).collect()] == [("foreign key", "t", 1)]


def test_upsert_and_rollback(spark):
    c = Catalog(spark)
    c.create("w", {"word": "TEXT", "hits": "INTEGER"}, ("word",), data=spark.createDataFrame([("a", 1)], "word string, hits long"))
    c.begin()
    c.tables["w"].data = dml.upsert(c.table("w"), spark.createDataFrame([("a", 1), ("b", 5)], "word string, hits long"), ("word",), {"hits": "old.hits + 1"})
    assert {tuple(r) for r in c.table("w").collect()} == {("a", 2), ("b", 5)}
    c.rollback()
    assert [tuple(r) for r in c.table("w").collect()] == [("a", 1)]
    c.add_column("w", "note", "TEXT", "'n'")
    c.rename_column("w", "hits", "n")
    assert c.table("w").columns == ["word", "n", "note"] and c.table_info("w").count() == 3


def test_json_walk():
    rows = list(walk('{"a":[1,{"b":null}],"c d":"x"}'))
    assert [r[6] for r in rows] == ["$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b", '$."c d"']
    assert [r[2] for r in rows] == ["object", "array", "integer", "object", "null", "text"]
    assert [r[0] for r in walk("[4,5]", deep=False)] == ["0", "1"] and list(walk("nope")) == [] and list(walk(None)) == []


def test_stream_matches_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    run_available(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = {tuple(r)[:3] for r in windowed_counts(events).collect()}
    got = {tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= want
