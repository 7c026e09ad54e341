"""A catalog of tables with their declared keys, and its metadata as tables (the pragma functions)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.core import SPARK_TYPE, affinity
from tessera.operators.dml import Constraints, violations

COLLATIONS = ("BINARY", "NOCASE", "RTRIM")


@dataclass
class Table:
    data: DataFrame
    types: dict[str, str]
    primary_key: tuple[str, ...] = ()
    constraints: Constraints = Constraints()
    indexes: dict[str, tuple[bool, tuple[str, ...]]] = field(default_factory=dict)
    sql: str = ""


@dataclass
class Trigger:
    """A program that runs for rows that change: time is BEFORE, AFTER or INSTEAD OF, event INSERT, UPDATE or DELETE."""

    name: str
    table: str
    time: str
    event: str
    columns: tuple[str, ...] | None  # of UPDATE OF
    when: tuple | None
    body: list[list[tuple[str, str]]]
    sql: str


class Catalog:
    """Tables and views of one session, by name without regard to case."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, tuple[str, DataFrame]] = {}
        self.triggers: dict[str, Trigger] = {}
        self.settings = {"user_version": 0, "application_id": 0, "schema_version": 0, "foreign_keys": 0, "defer_foreign_keys": 0, "ignore_check_constraints": 0, "recursive_triggers": 0}
        self._saved: list[tuple] = []

    # --- definitions

    def create(self, name: str, columns: dict[str, str], primary_key: tuple[str, ...] = (), constraints: Constraints = Constraints(), data: DataFrame | None = None) -> Table:
        schema = ", ".join(f"`{c}` {SPARK_TYPE[affinity(t)]}" for c, t in columns.items())
        sql = f"CREATE TABLE {name}({', '.join(f'{c} {t}'.strip() for c, t in columns.items())})"
        self.tables[name.lower()] = t = Table(data if data is not None else self.spark.createDataFrame([], schema), dict(columns), primary_key, constraints, sql=sql)
        if primary_key:
            t.indexes[f"sqlite_autoindex_{name}_1"] = (True, primary_key)
        self.settings["schema_version"] += 1
        return t

    def create_as(self, name: str, data: DataFrame) -> Table:
        """CREATE TABLE AS SELECT: the rows are written in the warehouse."""
        data.write.mode("overwrite").saveAsTable(name)
        return self.create(name, {c: {"bigint": "INT", "int": "INT", "double": "REAL", "string": "TEXT"}.get(t, "") for c, t in data.dtypes}, data=self.spark.table(name))

    def create_view(self, name: str, sql: str, data: DataFrame, columns: list[str] | None = None) -> None:
        self.views[name.lower()] = (sql, data.toDF(*columns) if columns else data)
        self.settings["schema_version"] += 1

    def create_index(self, table: str, name: str, columns: tuple[str, ...], unique: bool = False) -> None:
        """Indexes are declarations here; unique ones are checked."""
        t = self.tables[table.lower()]
        t.indexes[name] = (unique, columns)
        if unique:
            c = t.constraints
            t.constraints = Constraints(c.not_null, (*c.unique, columns), c.checks, c.defaults, c.generated, c.foreign_keys)

    def drop_index(self, name: str) -> bool:
        """Whether there was one; what only a unique index demanded isn't any more."""
        for t in self.tables.values():
            if name in t.indexes:
                unique, columns = t.indexes.pop(name)
                if unique:
                    left = list(t.constraints.unique)
                    left.reverse()
                    left.remove(columns)
                    t.constraints = replace(t.constraints, unique=tuple(reversed(left)))
                self.settings["schema_version"] += 1
                return True
        return False

    def drop(self, name: str) -> None:
        (self.tables if name.lower() in self.tables else self.views).pop(name.lower())
        self.triggers = {k: t for k, t in self.triggers.items() if t.table != name.lower()}
        self.settings["schema_version"] += 1

    def rename(self, name: str, new: str) -> None:
        self.tables[new.lower()] = self.tables.pop(name.lower())

    def rename_column(self, name: str, old: str, new: str) -> None:
        t = self.tables[name.lower()]
        t.data, t.types = t.data.withColumnRenamed(old, new), {new if c == old else c: k for c, k in t.types.items()}
        one = lambda c: new if c.lower() == old.lower() else c
        many = lambda cs: tuple(map(one, cs))
        text = lambda s: re.sub(rf"`{re.escape(old)}`|\b{re.escape(old)}\b", f"`{new}`", s, flags=re.I)
        k = t.constraints
        keys = tuple(replace(f, columns=many(f.columns)) for f in k.foreign_keys)
        t.constraints = Constraints(many(k.not_null), tuple(map(many, k.unique)), tuple(map(text, k.checks)), {one(c): e for c, e in k.defaults.items()}, {one(c): text(e) for c, e in k.generated.items()}, keys)
        t.primary_key = many(t.primary_key)
        t.indexes = {n: (u, many(cs)) for n, (u, cs) in t.indexes.items()}

    def add_column(self, name: str, column: str, declared: str, default: str = "null") -> None:
        t = self.tables[name.lower()]
        t.data = t.data.withColumn(column, F.expr(default).cast(SPARK_TYPE[affinity(declared)]))
        t.types[column] = declared

    def drop_column(self, name: str, column: str) -> None:
        t = self.tables[name.lower()]
        t.data = t.data.drop(column)
        t.types.pop(column)

    def table(self, name: str) -> DataFrame:
        n = name.lower()
        return self.tables[n].data if n in self.tables else self.views[n][1]

    # --- transactions: the catalog points to snapshots, so going back is putting the pointers back

    def begin(self) -> None:
        self._saved.append(({k: t.data for k, t in self.tables.items()}, dict(self.tables), dict(self.views)))

    def commit(self) -> None:
        self._saved.pop()

    def rollback(self) -> None:
        data, self.tables, self.views = self._saved.pop()
        for k, t in self.tables.items():
            t.data = data[k]

    # --- metadata

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def schema(self) -> DataFrame:
        """type, name, tbl_name, rootpage, sql of tables, indexes and views."""
        rows = [("table", n, n, 0, t.sql) for n, t in self.tables.items()]
        rows += [("index", i, n, 0, None) for n, t in self.tables.items() for i in t.indexes]
        rows += [("trigger", t.name, t.table, 0, t.sql) for t in self.triggers.values()]
        return self._frame(rows + [("view", n, n, 0, s) for n, (s, _) in self.views.items()], "type string, name string, tbl_name string, rootpage long, sql string")

    def table_info(self, name: str) -> DataFrame:
        t = self.tables[name.lower()]
        c = t.constraints
        rows = [(i, n, k, int(n in c.not_null), c.defaults.get(n), t.primary_key.index(n) + 1 if n in t.primary_key else 0) for i, (n, k) in enumerate(t.types.items()) if n not in c.generated]
        return self._frame(rows, "cid long, name string, type string, `notnull` long, dflt_value string, pk long")

    def table_xinfo(self, name: str) -> DataFrame:
        t = self.tables[name.lower()]
        c = t.constraints
        rows = [(i, n, k, int(n in c.not_null), c.defaults.get(n), t.primary_key.index(n) + 1 if n in t.primary_key else 0, 2 if n in c.generated else 0) for i, (n, k) in enumerate(t.types.items())]
        return self._frame(rows, "cid long, name string, type string, `notnull` long, dflt_value string, pk long, hidden long")

    def table_list(self) -> DataFrame:
        rows = [("main", n, "table", len(t.types), 0, 0) for n, t in self.tables.items()] + [("main", n, "view", len(d.columns), 0, 0) for n, (_, d) in self.views.items()]
        return self._frame(rows, "schema string, name string, type string, ncol long, wr long, strict long")

    def index_list(self, name: str) -> DataFrame:
        t = self.tables[name.lower()]
        rows = [(i, n, int(u), "pk" if n.startswith("sqlite_autoindex") else "c", 0) for i, (n, (u, _)) in enumerate(reversed(t.indexes.items()))]
        return self._frame(rows, "seq long, name string, unique long, origin string, partial long")

    def index_info(self, index: str) -> DataFrame:
        t, (_, columns) = next((t, t.indexes[index]) for t in self.tables.values() if index in t.indexes)
        return self._frame([(i, list(t.types).index(c), c) for i, c in enumerate(columns)], "seqno long, cid long, name string")

    def foreign_key_list(self, name: str) -> DataFrame:
        keys = self.tables[name.lower()].constraints.foreign_keys
        rows = [(i, s, k.parent, a, b, k.on_update.upper(), k.on_delete.upper(), "NONE") for i, k in enumerate(keys) for s, (a, b) in enumerate(zip(k.columns, k.parent_columns, strict=True))]
        return self._frame(rows, "id long, seq long, `table` string, `from` string, `to` string, on_update string, on_delete string, `match` string")

    def foreign_key_check(self, name: str) -> DataFrame:
        """Child rows without a parent, with the parent's name and the key's number."""
        t, out = self.tables[name.lower()], None
        for i, k in enumerate(t.constraints.foreign_keys):
            parent = self.table(k.parent).select(*(F.col(p).alias(c) for p, c in zip(k.parent_columns, k.columns, strict=True)))
            lost = t.data.dropna(subset=list(k.columns)).join(parent, list(k.columns), "left_anti").select(*t.data.columns).withColumn("parent", F.lit(k.parent)).withColumn("fkid", F.lit(i).cast("long"))
            out = lost if out is None else out.unionAll(lost)
        return out if out is not None else t.data.limit(0).withColumn("parent", F.lit("")).withColumn("fkid", F.lit(0).cast("long"))

    def integrity_check(self) -> DataFrame:
        """One row 'ok', or what is broken."""
        rows = []
        for n, t in self.tables.items():
            rows += [(f"{r['kind']} in {n}: {r['detail']} ({r['n']})",) for r in violations(t.data, t.constraints, {k: x.data for k, x in self.tables.items()}).collect()]
        return self._frame(rows or [("ok",)], "integrity_check string")

    def database_list(self) -> DataFrame:
        return self._frame([(0, "main", "")], "seq long, name string, file string")

    def collation_list(self) -> DataFrame:
        return self._frame([(i, c) for i, c in enumerate(COLLATIONS)], "seq long, name string")
