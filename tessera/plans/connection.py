"""connect(): the dialect's statements over a catalog of DataFrames, in the manner of a DB-API connection."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import python
from tessera.functions.core import affinity
from tessera.operators import dml
from tessera.plans.dialect import Parser, SqlError, _select, split_statements
from tessera.plans.translate import Scope, Translator, _has_aggregate, ident, storage_class
from tessera.session import get_session, ship_package
from tessera.sources.catalog import Catalog, Trigger
from tessera.sources.tables import EACH, walk

_numbers = itertools.count()
#: The column type of each collation. NOCASE folds letters of all scripts here.
COLLATED = {"NOCASE": "string collate UTF8_LCASE", "RTRIM": "string collate UTF8_BINARY_RTRIM"}
#: Settings of a file or a cache, which has no counterpart here: their answers.
FIXED = {
    "encoding": "UTF-8", "data_version": 1, "temp_store": 0, "synchronous": 2, "journal_mode": "memory", "locking_mode": "normal", "cache_size": -2000, "page_size": 4096, "page_count": 1,
    "freelist_count": 0, "auto_vacuum": 0, "max_page_count": 4294967294, "busy_timeout": 0, "secure_delete": 0, "wal_autocheckpoint": 1000, "analysis_limit": 0,
}


class _Lookup:
    """Tables by name for the translator, and the columns that are their rows' ids."""

    def __init__(self, connection: Connection):
        self.connection = connection

    def __call__(self, name: str):
        return self.connection._table(name)

    def rowid(self, name: str) -> str | None:
        t = self.connection.catalog.tables.get(name.lower())
        return t.primary_key[0] if t and len(t.primary_key) == 1 and affinity(t.types.get(t.primary_key[0])) == "INTEGER" else None


class _Each:
    def eval(self, text: str, root: str):
        yield from walk(text, root or "$", False)


class _Tree:
    def eval(self, text: str, root: str):
        yield from walk(text, root or "$", True)


class Cursor:
    """Rows of one statement: lazily as `dataframe`, or fetched."""

    def __init__(self, dataframe: DataFrame | None):
        self.dataframe = dataframe
        self.description = None if dataframe is None else [(n, None, None, None, None, None, None) for n in dataframe.columns]
        self._rows: Iterator | None = None

    def _iterate(self) -> Iterator:
        if self._rows is None:
            self._rows = iter(()) if self.dataframe is None else (tuple(r) for r in self.dataframe.toLocalIterator())
        return self._rows

    def fetchone(self):
        return next(self._iterate(), None)

    def fetchmany(self, n: int = 1) -> list:
        return list(itertools.islice(self._iterate(), n))

    def fetchall(self) -> list:
        return list(self._iterate())

    def __iter__(self):
        return self._iterate()


def _stored_as(x: str, given: str, to: str, is_rowid: bool) -> str:
    """A value as a column takes it: texts of whole numbers fit integers; a row's id takes nothing but numbers that are whole."""
    text = f"try_cast({x} as {to})"
    if to == "bigint" and given.startswith("string"):
        real = f"try_cast({x} as double)"
        text = f"coalesce({text}, if({real} = floor({real}), try_cast({real} as bigint), null))"
    if is_rowid and given.startswith(("string", "double", "decimal", "binary")):
        whole = f"{text} <=> {x}" if given.startswith(("double", "decimal")) else f"{text} is not null"
        return f"if({x} is null or {whole}, {text}, raise_error('datatype mismatch'))"
    return text


class Connection:
    """Statements run at once; a query's rows are computed when they are fetched."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or get_session()
        ship_package(self.spark)
        self.catalog = Catalog(self.spark)
        self._views: dict[str, tuple[str, DataFrame]] = {}
        self._extra: dict[str, DataFrame] = {}
        self._stored: dict[str, tuple[dict, list[str] | None]] = {}  # views' queries
        self._lookup = _Lookup(self)
        self._fired: tuple | None = None  # the rows that the running trigger was fired by, as a source
        self._running: list[str] = []  # triggers
        self._changed: list[DataFrame] = []  # rows that statements changed, counted when asked for
        self._total, self._last, self._inserted = 0, 0, None
        if not getattr(self.spark, "_tessera_functions", False):  # once a session
            for name, cls in (("tessera_json_each", _Each), ("tessera_json_tree", _Tree)):
                self.spark.udtf.register(name, F.udtf(cls, returnType=EACH))
            python.register(self.spark)
            self.spark._tessera_functions = True

    def register(self, name: str, data: DataFrame, types: dict[str, str] | None = None) -> None:
        """Make a DataFrame a table."""
        declared = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}
        self.catalog.create(name, types or {c: declared.get(storage_class(t), "NUMERIC") for c, t in data.dtypes}, data=data)

    # --- names

    def _spark_name(self, name: str, data: DataFrame) -> str:
        known = self._views.get(name)
        if known is None or known[1] is not data:
            known = self._views[name] = (f"_tessera_{next(_numbers)}", data)
            data.createOrReplaceTempView(known[0])
        return known[0]

    def _table(self, name: str):
        n = name.lower()
        if n.startswith("pragma_"):
            what, _, arg = n[7:].rstrip(")").partition("(")
            data = self._pragma(what, arg or None)
        elif n in ("sqlite_schema", "sqlite_master"):
            data = self.catalog.schema()
        elif n in self._extra:
            data = self._extra[n]
        elif n in self._stored and n in self.catalog.views:
            # a view's query runs over the tables as they are now
            q, cols = self._stored[n]
            data = self._query(q)
            data = data.toDF(*cols) if cols else data
        elif n in self.catalog.tables or n in self.catalog.views:
            data = self.catalog.table(n)
        else:
            return None
        return self._spark_name(n, data), [(c, storage_class(t)) for c, t in data.dtypes]

    def _counter(self, name: str) -> int:
        if name == "last_insert_rowid":
            return 0 if self._inserted is None else self._inserted.first()[0] or 0
        if self._changed:
            last = [d.count() for d in self._changed]
            self._total += sum(last[:-1])
            self._changed, self._last = [], last[-1]
            self._total += self._last
        return self._last if name == "changes" else self._total

    def _translator(self) -> Translator:
        return Translator(self._lookup, self._counter)

    # --- statements

    def execute(self, sql: str, params=()) -> Cursor:
        statements = split_statements(sql)
        if len(statements) != 1:
            raise SqlError("You can only execute one statement at a time.")
        return self._run(Parser(statements[0], params))

    def executemany(self, sql: str, many) -> Cursor:
        out = Cursor(None)
        for params in many:
            out = self.execute(sql, params)
        return out

    def executescript(self, sql: str) -> Cursor:
        out = Cursor(None)
        for statement in split_statements(sql):
            out = self._run(Parser(statement))
        return out

    def commit(self) -> None:
        if self.catalog._saved:
            self.catalog.commit()

    def rollback(self) -> None:
        if self.catalog._saved:
            self.catalog.rollback()

    def close(self) -> None:
        for name, _ in self._views.values():
            self.spark.catalog.dropTempView(name)

    def query(self, sql: str, params=()) -> DataFrame:
        """The DataFrame of a query."""
        return self.execute(sql, params).dataframe

    def sql(self, sql: str, params=()) -> str:
        """The Spark SQL that a query becomes."""
        p = Parser(split_statements(sql)[0], params)
        return self._translator().query(p.query())[0]

    def _run(self, p: Parser) -> Cursor:
        word, start = p.peek(), p.i
        if word == "WITH":
            ctes, recursive = p.with_clause()
            if p.peek() in ("INSERT", "REPLACE", "UPDATE", "DELETE"):
                return self._change_with(p, ctes, recursive)
            p.i = start
        if word in ("SELECT", "VALUES", "WITH"):
            out = self._query(p.query())
        elif p.accept("EXPLAIN"):
            steps = p.accept("QUERY", "PLAN")
            execution = self._query(p.query())._jdf.queryExecution()
            if steps:
                return Cursor(self.spark.createDataFrame(_plan_rows(execution.sparkPlan().toString()), "id long, parent long, notused long, detail string"))
            return Cursor(self.spark.createDataFrame([(execution.toString(),)], "plan string"))
        elif word in ("INSERT", "REPLACE", "UPDATE", "DELETE"):
            return self._change(p)
        elif p.accept("BEGIN"):
            self.catalog.begin()
            return Cursor(None)
        elif word in ("COMMIT", "END", "ROLLBACK"):
            (self.rollback if word == "ROLLBACK" else self.commit)()
            return Cursor(None)
        elif p.accept("PRAGMA"):
            name = p.table_name().lower()
            arg = None
            if p.accept("=") or p.accept("("):
                sign = -1 if p.accept("-") else 1
                kind, text = p.t[p.i]
                arg = sign * int(text) if kind == "number" else p.name()
            data = self._pragma(name, arg)
            return Cursor(data)
        elif word in ("ANALYZE", "VACUUM", "REINDEX"):  # nothing to keep up here
            p.i += 1
            if word == "VACUUM" and p.accept("INTO"):  # each table as Parquet in a new folder
                folder = p.name()
                for n, t in self.catalog.tables.items():
                    t.data.write.parquet(f"{folder}/{n}.parquet")
            return Cursor(None)
        elif word in ("CREATE", "DROP", "ALTER"):
            self._define(p)
            return Cursor(None)
        else:
            raise SqlError(f"near {word!r}: syntax error")
        if not p.end():
            raise SqlError(f"near {p.t[p.i][1]!r}: syntax error")
        return Cursor(out)

    def _change_with(self, p: Parser, ctes: list, recursive: bool) -> Cursor:
        """A change whose queries see named ones, which count as tables as long as it runs."""
        made = {}
        for i, (name, _, _) in enumerate(ctes):
            everything = {"kind": "select", "items": [(("star", None), "*")], "from": [("table", name, None, "comma", None)]}
            made[name.lower()] = self._query(_select(everything | {"ctes": ctes[: i + 1], "recursive": recursive}))
        before = dict(self._extra)
        self._extra.update(made)
        try:
            return self._change(p)
        finally:
            self._extra = before

    def _query(self, q: dict) -> DataFrame:
        # recursion with UNION, an order or a limit inside is iterated; Spark's own handles UNION ALL
        special = [n for n, _, sub in q.get("ctes") or [] if q["recursive"] and sub["kind"] == "compound" and _mentions(sub["right"], n) and (sub["op"] == "UNION" or sub["limit"])]
        if special:
            return self._iterated(q)
        text, _ = self._translator().query(q)
        return self.spark.sql(text)

    def _iterated(self, q: dict) -> DataFrame:
        from tessera.operators.relational import recursive

        ctes, added = list(q["ctes"]), []
        try:
            while ctes:
                name, cols, sub = ctes.pop(0)
                if sub["kind"] == "compound" and _mentions(sub["right"], name):
                    seed = self._query(_select(sub["left"]) if sub["left"]["kind"] == "select" else sub["left"] | {"ctes": []})
                    seed = seed.toDF(*cols) if cols else seed

                    def step(new: DataFrame, name=name, sub=sub, seed=seed) -> DataFrame:
                        self._extra[name.lower()] = new
                        out = self._query(_select(sub["right"])).toDF(*seed.columns)
                        return out.select(*(F.col(f"`{c}`").cast(t) for c, t in seed.dtypes))

                    limit = self._translator()._count(sub["limit"])
                    made = recursive(seed, step, distinct=sub["op"] == "UNION", limit=limit)
                else:
                    made = self._query(sub)
                    made = made.toDF(*cols) if cols else made
                self._extra[name.lower()] = made
                added.append(name.lower())
            return self._query(q | {"ctes": []})
        finally:
            for n in added:
                self._extra.pop(n, None)

    # --- changes

    def _fragment(self, x, table: str, alias: str | None = None) -> str:
        """An expression over a table's own columns."""
        data = self.catalog.tables[table.lower()].data
        scope = Scope(sources=[(alias or table, [(c, storage_class(t)) for c, t in data.dtypes])])
        return self._translator().expr(x, scope)[0].replace(f"{ident(alias or table)}.", "")

    def _truth(self, x, table: str) -> str:
        data = self.catalog.tables[table.lower()].data
        scope = Scope(sources=[(table, [(c, storage_class(t)) for c, t in data.dtypes])])
        return self._translator().truth(x, scope).replace(f"{ident(table)}.", "")

    def _rules(self, t) -> dml.Constraints:
        key = (t.primary_key,) if t.primary_key else ()
        c = t.constraints
        return dml.Constraints(c.not_null, (*c.unique, *key), () if self.catalog.settings["ignore_check_constraints"] else c.checks, c.defaults, c.generated, c.foreign_keys if self.catalog.settings["foreign_keys"] else ())

    def _parents(self) -> dict[str, DataFrame]:
        return {n: t.data for n, t in self.catalog.tables.items()}

    def _store(self, name: str, data: DataFrame) -> None:
        """A new snapshot; its lineage ends in the checkpoint folder."""
        self.catalog.tables[name.lower()].data = data.checkpoint()

    def _change(self, p: Parser) -> Cursor:
        if p.peek() in ("INSERT", "REPLACE"):
            return self._insert(p)
        if p.accept("UPDATE"):
            if p.accept("OR"):
                p.name()
            name = p.table_name()
            if name.lower() in self.catalog.views:
                return self._instead(p, name, "UPDATE")
            p.expect("SET")
            sets = {}
            while True:
                col = p.name()
                p.expect("=")
                sets[col] = p.expr()
                if not p.accept(","):
                    break
            where = p.expr() if p.accept("WHERE") else None
            t = self.catalog.tables[name.lower()]
            by_name = {c.lower(): c for c in t.data.columns}
            if self._fired:
                return self._update_fired(name, {by_name[k.lower()]: x for k, x in sets.items()}, where)
            fired = self._pairs(t.data, {by_name[k.lower()]: self._fragment(x, name) for k, x in sets.items()}, self._truth(where, name) if where else None) if self._triggers(name, "UPDATE") else None
            event, columns = "UPDATE", list(sets)
            self._fire("BEFORE", event, name, fired, columns)
            new, changed = dml.update(t.data, {by_name[k.lower()]: self._fragment(x, name) for k, x in sets.items()}, self._truth(where, name) if where else None)
            if self.catalog.settings["foreign_keys"]:
                self._follow(name, t.data, {by_name[k.lower()]: self._fragment(x, name) for k, x in sets.items()}, self._truth(where, name) if where else None, new)
            dml.checked(new, self._rules(t), self._parents())
        else:
            p.expect("DELETE", "FROM")
            name = p.table_name()
            if name.lower() in self.catalog.views:
                return self._instead(p, name, "DELETE")
            where = p.expr() if p.accept("WHERE") else None
            t = self.catalog.tables[name.lower()]
            if self._fired:
                return self._delete_fired(name, where)
            event, columns = "DELETE", None
            fired = dml.delete(t.data, self._truth(where, name) if where else None)[1].select(_struct("new", t.data, None), _struct("old", t.data, t.data.columns)) if self._triggers(name, event) else None
            self._fire("BEFORE", event, name, fired)
            new, changed = dml.delete(t.data, self._truth(where, name) if where else None)
            if self.catalog.settings["foreign_keys"]:
                changed = changed.checkpoint()
                rules = {n: x.constraints for n, x in self.catalog.tables.items()}
                after = dml.cascade(self._parents() | {name.lower(): new}, rules, name.lower(), changed)
                for n, data in after.items():
                    if data is not self.catalog.tables[n].data and n != name.lower():
                        self._store(n, data)
        if p.i == len(p.t) or p.peek() == "RETURNING":
            self._changed.append(changed)
        result = self._returning(p, name, changed)
        if fired is not None:
            fired = fired.checkpoint()
        self._store(name, new)
        self._fire("AFTER", event, name, fired, columns)
        return result

    # --- triggers: each statement of a program runs once, over all rows that fired it

    def _triggers(self, name: str, event: str) -> list[Trigger]:
        return [t for t in self.catalog.triggers.values() if t.table == name.lower() and t.event == event]

    def _pairs(self, data: DataFrame, sets: dict[str, str], where: str | None) -> DataFrame:
        """The rows that an update changes, as structs new and old."""
        hit = data.filter(F.coalesce(F.expr(where), F.lit(False))) if where else data
        new = [(F.expr(sets[c]).cast(data.schema[c].dataType) if c in sets else F.col(c)).alias(c) for c in data.columns]
        return hit.select(F.struct(*new).alias("new"), _struct("old", data, data.columns))

    def _fire(self, time: str, event: str, name: str, fired: DataFrame | None, columns: list[str] | None = None) -> None:
        """Run the triggers of an event over its rows (structs new, old). A trigger doesn't fire itself."""
        touched = None if columns is None else {c.lower() for c in columns}
        for t in self._triggers(name, event):
            if fired is None or t.time != time or t.name in self._running or t.columns is not None and touched is not None and not touched & set(t.columns):
                continue
            sources = [(s, [(f.name, storage_class(f.dataType.simpleString())) for f in fired.schema[s].dataType.fields]) for s in ("new", "old")]
            rows = fired.filter(F.expr(self._translator().truth(t.when, Scope(sources=sources)))) if t.when else fired
            rows = rows.checkpoint()
            if rows.isEmpty():
                continue
            view = f"_tessera_{next(_numbers)}"
            rows.createOrReplaceTempView(view)
            before, self._fired = self._fired, (view, sources)
            self._running.append(t.name)
            try:
                for statement in t.body:
                    self._program(Parser(statement))
            finally:
                self._fired = before
                self._running.pop()
                self.spark.catalog.dropTempView(view)

    def _program(self, p: Parser) -> None:
        if p.peek() not in ("SELECT", "VALUES", "WITH"):
            self._change(p)
            return
        q = p.query()
        item = q["items"][0][0] if q["kind"] == "select" else None
        if item and item[0] == "raise":
            if item[1] == "IGNORE":
                raise SqlError("RAISE(IGNORE) is not supported")
            if not self._query(self._over_fired(q | {"items": [(("lit", 1, "int"), "one")]})).isEmpty():
                raise dml.ConstraintError(item[2][1] if item[2] and item[2][0] == "lit" else "raised")

    def _over_fired(self, q: dict) -> dict:
        """A query of a program, for each row that fired it."""
        source = ("fired", self._fired, None, "comma", None)
        if q["kind"] == "values":
            items = [[(x, f"column{i + 1}") for i, x in enumerate(r)] for r in q["rows"]]
            parts = [_select({"kind": "select", "items": r, "from": [source]}) for r in items]
            whole = parts[0]
            for part in parts[1:]:
                whole = _select({"kind": "compound", "op": "UNION ALL", "left": whole, "right": part})
            return whole
        if q["kind"] != "select" or q["limit"] is not None or q["group"] is not None or any(_has_aggregate(x) for x, _ in q["items"]):
            raise SqlError("a trigger's query may not have aggregates, limits or compounds")
        return q | {"from": [source, *q["from"]]}

    def _joined(self, name: str, where) -> tuple[DataFrame, str, Scope]:
        """The rows that fired a program, a statement's condition over them and a table, and the scope."""
        data = self.catalog.tables[name.lower()].data
        view, sources = self._fired
        scope = Scope(sources=[(name, [(c, storage_class(k)) for c, k in data.dtypes]), *sources], hidden={"new", "old"})
        return self.spark.table(view), self._translator().truth(where, scope) if where else "true", scope

    def _delete_fired(self, name: str, where) -> Cursor:
        t = self.catalog.tables[name.lower()]
        rows, condition, _ = self._joined(name, where)
        fired = None
        if self._triggers(name, "DELETE"):
            gone = t.data.alias(name).join(rows, F.expr(condition), "left_semi").select(*t.data.columns)
            fired = gone.select(_struct("new", t.data, None), _struct("old", t.data, t.data.columns)).checkpoint()
            self._fire("BEFORE", "DELETE", name, fired)
        self._store(name, t.data.alias(name).join(rows, F.expr(condition), "left_anti").select(*t.data.columns))
        self._fire("AFTER", "DELETE", name, fired)
        return Cursor(None)

    def _update_fired(self, name: str, sets: dict, where) -> Cursor:
        """An update by the rows that fired it; where several rows meet one row of the table, their order would matter, which is refused."""
        t = self.catalog.tables[name.lower()]
        rows, condition, scope = self._joined(name, where)
        marked = t.data.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
        met = marked.alias(name).join(rows, F.expr(condition)).checkpoint()
        if not met.groupBy("_row").agg(F.count("*").alias("_times")).filter("_times > 1").isEmpty():
            raise SqlError("several rows of a trigger update one row")
        values = {c: self._translator().expr(x, scope)[0] for c, x in sets.items()}
        new = met.select("_row", *((F.expr(values[c]).cast(t.data.schema[c].dataType) if c in values else F.col(f"`{name}`.`{c}`")).alias(c) for c in t.data.columns))
        after = marked.join(new.select("_row"), "_row", "left_anti").select(*t.data.columns).unionAll(new.select(*t.data.columns))
        dml.checked(after, self._rules(t), self._parents())
        fired = None
        if self._triggers(name, "UPDATE"):
            both = new.select("_row", F.struct(*t.data.columns).alias("new")).join(marked.select("_row", F.struct(*t.data.columns).alias("old")), "_row")
            fired = both.select("new", "old").checkpoint()
            self._fire("BEFORE", "UPDATE", name, fired, list(sets))
        self._store(name, after)
        self._fire("AFTER", "UPDATE", name, fired, list(sets))
        return Cursor(None)

    def _instead(self, p: Parser, name: str, event: str, rows: DataFrame | None = None) -> Cursor:
        """A change of a view: its INSTEAD OF triggers run."""
        if not any(t.time == "INSTEAD OF" for t in self._triggers(name, event)):
            raise SqlError(f"cannot modify {name} because it is a view")
        spark_name, cols = self._table(name)
        data = self.spark.table(spark_name)
        scope = Scope(sources=[(name, cols)])
        plain = lambda e: e.replace(f"{ident(name)}.", "")
        columns = None
        if event == "INSERT":
            fired = rows.select(_struct("new", data, data.columns), _struct("old", data, None))
        else:
            sets = {}
            if event == "UPDATE":
                p.expect("SET")
                while True:
                    col = p.name()
                    p.expect("=")
                    sets[next(c for c in data.columns if c.lower() == col.lower())] = plain(self._translator().expr(p.expr(), scope)[0])
                    if not p.accept(","):
                        break
                columns = list(sets)
            where = plain(self._translator().truth(p.expr(), scope)) if p.accept("WHERE") else None
            fired = self._pairs(data, sets, where) if event == "UPDATE" else dml.delete(data, where)[1].select(_struct("new", data, None), _struct("old", data, data.columns))
        self._fire("INSTEAD OF", event, name, fired, columns)
        return Cursor(None)

    def _define_trigger(self, p: Parser, name: str, maybe: bool) -> None:
        if name.lower() in self.catalog.triggers:
            if maybe:
                return
            raise SqlError(f"trigger {name} already exists")
        time = "INSTEAD OF" if p.accept("INSTEAD", "OF") else "AFTER" if p.accept("AFTER") else "BEFORE"
        p.accept("BEFORE")
        event, columns = p.name().upper(), None
        if event == "UPDATE" and p.accept("OF"):
            columns = [p.name().lower()]
            while p.accept(","):
                columns.append(p.name().lower())
        p.expect("ON")
        table = p.table_name().lower()
        if (table in self.catalog.views) != (time == "INSTEAD OF") or table not in self.catalog.tables and table not in self.catalog.views:
            raise SqlError(f"cannot create {time} trigger on {table}")
        p.accept("FOR", "EACH", "ROW")
        when = p.expr() if p.accept("WHEN") else None
        p.expect("BEGIN")
        body: list[list] = [[]]
        for t in p.t[p.i : -1]:
            if t == ("op", ";"):
                body.append([])
            else:
                body[-1].append(t)
        if p.t[-1][1].upper() != "END":
            raise SqlError("incomplete input")
        self.catalog.triggers[name.lower()] = Trigger(name, table, time, event, tuple(columns) if columns else None, when, [s for s in body if s], " ".join(t for _, t in p.t))

    def _follow(self, name: str, old: DataFrame, sets: dict[str, str], where: str | None, new: DataFrame) -> None:
        """Child rows after an update of the keys that they refer to."""
        rules = {n: x.constraints for n, x in self.catalog.tables.items()}
        after = dml.follow_update(self._parents() | {name.lower(): new}, rules, name.lower(), old, sets, where)
        for n, data in after.items():
            if data is not self.catalog.tables[n].data and n != name.lower():
                self._store(n, data)

    def _insert(self, p: Parser) -> Cursor:
        conflict = "replace" if p.accept("REPLACE") else "abort"
        if conflict == "abort":
            p.expect("INSERT")
            if p.accept("OR"):
                conflict = p.name().lower()
        p.expect("INTO")
        name = p.table_name()
        if name.lower() in self.catalog.views:
            data = self.spark.table(self._table(name)[0])
            given = p.names() if p.peek() == "(" else data.columns
            q = p.query()
            rows = self._query(self._over_fired(q) if self._fired else q).toDF(*given)
            for f in data.schema:
                if f.name.lower() not in {c.lower() for c in given}:
                    rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
            return self._instead(p, name, "INSERT", rows)
        t = self.catalog.tables.get(name.lower())
        if t is None:
            raise SqlError(f"no such table: {name}")
        cols = p.names() if p.peek() == "(" else [c for c in t.data.columns if c not in t.constraints.generated]
        by_name = {c.lower(): c for c in t.data.columns}
        cols = [by_name[c.lower()] for c in cols]
        if p.accept("DEFAULT", "VALUES"):
            rows = self.spark.range(1).select()
            cols = []
        else:
            q = p.query()
            rows = self._query(self._over_fired(q) if self._fired else q)
            if len(rows.columns) != len(cols):
                raise SqlError(f"{len(rows.columns)} values for {len(cols)} columns")
            given = rows.schema
            rows = rows.select(*(F.expr(_stored_as(ident(f.name), f.dataType.simpleString(), t.data.schema[n].dataType.simpleString(), n == self._lookup.rowid(name))).alias(n) for f, n in zip(given, cols, strict=True)))
            if (number := self._lookup.rowid(name)) in cols and given[cols.index(number)].nullable:
                # a NULL in place of an integer key is the next number
                missing, kept = rows.filter(F.col(number).isNull()).drop(number), rows.filter(F.col(number).isNotNull())
                if not missing.isEmpty():
                    ids = t.data.select(number).unionAll(kept.select(number))
                    rows = kept.unionByName(dml.new_rowids(missing.withColumn("_o", F.monotonically_increasing_id()), ids, number, ["_o"]).drop("_o"))
        rules = self._rules(t)
        key = t.primary_key or (rules.unique[0] if rules.unique else ())
        if len(t.primary_key) == 1 and affinity(t.types[t.primary_key[0]]) == "INTEGER" and t.primary_key[0] not in cols:
            # a missing integer key is the next number
            rows = dml.new_rowids(rows.withColumn("_o", F.monotonically_increasing_id()), t.data, t.primary_key[0], ["_o"]).drop("_o")
        if p.accept("ON", "CONFLICT"):
            target = tuple(by_name[c.lower()] for c in p.names()) if p.peek() == "(" else key
            p.expect("DO")
            sets, where = None, None
            if p.accept("UPDATE"):
                p.expect("SET")
                sets, scope = {}, Scope(sources=[(name, [(c, storage_class(k)) for c, k in t.data.dtypes]), ("excluded", [(c, storage_class(k)) for c, k in t.data.dtypes])])
                made = lambda x, f: getattr(self._translator(), f)(_qualified(x, name), scope)
                while True:
                    col = by_name[p.name().lower()]
                    p.expect("=")
                    sets[col] = made(p.expr(), "expr")[0].replace(f"{ident(name)}.", "old.")
                    if not p.accept(","):
                        break
                if p.accept("WHERE"):
                    where = made(p.expr(), "truth").replace(f"{ident(name)}.", "old.")
            else:
                p.expect("NOTHING")
            new = dml.upsert(t.data, rows, target, sets, where, rules)
        elif conflict in ("ignore", "replace"):
            before, new = t.data, dml.insert(t.data, rows, rules, conflict, tuple(key), self._parents())
        else:
            new = dml.insert(t.data, rows, dml.Constraints(defaults=rules.defaults, generated=rules.generated))
            dml.checked(new, rules, self._parents())
        made = dml.completed(rows, t.data, rules)
        fired = None
        if self._triggers(name, "INSERT"):
            fired = (made if conflict != "ignore" else new.exceptAll(before)).select(_struct("new", t.data, t.data.columns), _struct("old", t.data, None)).checkpoint()
            self._fire("BEFORE", "INSERT", name, fired)
        # ids that come from a query needn't be in its order: the largest new one is the last
        added = made if conflict != "ignore" else new.exceptAll(before)
        self._changed.append(added)
        if (key_column := self._lookup.rowid(name)) is not None:
            self._inserted = added.agg(F.max(key_column))
        result = self._returning(p, name, made)
        self._store(name, new)
        self._fire("AFTER", "INSERT", name, fired)
        return result

    def _returning(self, p: Parser, name: str, rows: DataFrame) -> Cursor:
        if not p.accept("RETURNING"):
            if not p.end():
                raise SqlError(f"near {p.t[p.i][1]!r}: syntax error")
            return Cursor(None)
        items = [p._item()]
        while p.accept(","):
            items.append(p._item())
        kept = rows.checkpoint()
        self._extra[name.lower()] = kept
        try:
            return Cursor(self._query(_select({"kind": "select", "items": items, "from": [("table", name, None, "comma", None)]})))
        finally:
            self._extra.pop(name.lower())

    # --- definitions

    def _define(self, p: Parser) -> None:
        if p.accept("DROP"):
            kind = p.name().lower()
            maybe = p.accept("IF", "EXISTS")
            name = p.table_name()
            if kind == "trigger":
                if self.catalog.triggers.pop(name.lower(), None) is None and not maybe:
                    raise SqlError(f"no such trigger: {name}")
            elif kind == "index":
                if not self.catalog.drop_index(name) and not maybe:
                    raise SqlError(f"no such index: {name}")
            elif name.lower() in self.catalog.tables or name.lower() in self.catalog.views:
                self.catalog.drop(name)
            elif not maybe:
                raise SqlError(f"no such {kind}: {name}")
            return
        if p.accept("ALTER", "TABLE"):
            name = p.table_name()
            if p.accept("RENAME", "TO"):
                self.catalog.rename(name, p.name())
            elif p.accept("RENAME"):
                p.accept("COLUMN")
                old = p.name()
                p.expect("TO")
                new = p.name()
                self.catalog.rename_column(name, old, new)
                self._stored = {v: (_renamed(q, old, new) if _mentions(q, name) else q, cols) for v, (q, cols) in self._stored.items()}
            elif p.accept("ADD"):
                p.accept("COLUMN")
                col = p.name()
                declared, default = [], "null"
                while not p.end():
                    if p.accept("DEFAULT"):
                        default = self._fragment(p._unary(), name)
                    else:
                        declared.append(p.t[p.i][1])
                        p.i += 1
                self.catalog.add_column(name, col, " ".join(declared), default)
            else:
                p.expect("DROP")
                p.accept("COLUMN")
                self.catalog.drop_column(name, p.name())
            return
        p.expect("CREATE")
        unique = p.accept("UNIQUE")
        p.accept("TEMP")
        p.accept("TEMPORARY")
        kind = p.name().lower()
        maybe = p.accept("IF", "NOT", "EXISTS")
        name = p.table_name()
        if kind == "trigger":
            self._define_trigger(p, name, maybe)
        elif kind == "index":
            p.expect("ON")
            table = p.name()
            self.catalog.create_index(table, name, tuple(p.names()), unique)
        elif name.lower() in self.catalog.tables or name.lower() in self.catalog.views:
            if not maybe:
                raise SqlError(f"{kind} {name} already exists")
        elif kind == "view":
            cols = p.names() if p.peek() == "(" else None
            p.expect("AS")
            text = " ".join(t for _, t in p.t[p.i :])
            q = p.query()
            self.catalog.create_view(name, text, self._query(q), cols)
            self._stored[name.lower()] = (q, cols)
        elif kind == "table" and p.accept("AS"):
            self.register(name, self._query(p.query()).checkpoint())
        elif kind == "table":
            self._create_table(p, name)
        else:
            raise SqlError(f"CREATE {kind.upper()} is not supported")

    def _create_table(self, p: Parser, name: str) -> None:
        p.expect("(")
        types, primary, not_null, unique, defaults, generated, keys = {}, (), [], [], {}, {}, []
        late: list[tuple] = []
        collations: dict[str, str] = {}
        while True:
            if p.accept("CONSTRAINT"):
                p.name()
            if p.accept("PRIMARY", "KEY"):
                primary = tuple(p.names())
            elif p.accept("UNIQUE"):
                unique.append(tuple(p.names()))
            elif p.accept("CHECK"):
                p.expect("(")
                late.append(("check", p.expr()))
                p.expect(")")
            elif p.accept("FOREIGN", "KEY"):
                cols = tuple(p.names())
                keys.append(self._reference(p, cols))
            else:
                col = p.name()
                declared = []
                while p.peek() not in (",", ")", "PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS", "CONSTRAINT"):
                    if p.accept("("):
                        while not p.accept(")"):
                            p.i += 1
                        continue
                    declared.append(p.t[p.i][1])
                    p.i += 1
                types[col] = " ".join(declared)
                while p.peek() not in (",", ")"):
                    if p.accept("CONSTRAINT"):
                        p.name()
                    elif p.accept("PRIMARY", "KEY"):
                        primary = (col,)
                        p.accept("ASC")
                        p.accept("DESC")
                        p.accept("AUTOINCREMENT")
                    elif p.accept("NOT", "NULL"):
                        not_null.append(col)
                    elif p.accept("NULL"):
                        pass
                    elif p.accept("UNIQUE"):
                        unique.append((col,))
                    elif p.accept("CHECK"):
                        p.expect("(")
                        late.append(("check", p.expr()))
                        p.expect(")")
                    elif p.accept("DEFAULT"):
                        late.append(("default", col, p._unary()))
                    elif p.accept("COLLATE"):
                        collations[col] = p.name().upper()
                    elif p.peek() == "REFERENCES":
                        keys.append(self._reference(p, (col,)))
                    else:
                        p.accept("GENERATED", "ALWAYS")
                        p.expect("AS")
                        p.expect("(")
                        late.append(("generated", col, p.expr()))
                        p.expect(")")
                        p.accept("STORED")
                        p.accept("VIRTUAL")
            if not p.accept(","):
                break
        p.expect(")")
        self.catalog.create(name, types, primary)
        for col, collation in collations.items():
            if collation not in ("BINARY", *COLLATED):
                raise SqlError(f"no such collation sequence: {collation}")
            if collation != "BINARY" and affinity(types[col]) == "TEXT":
                t = self.catalog.tables[name.lower()]
                t.data = t.data.withColumn(col, F.expr(f"cast({ident(col)} as {COLLATED[collation]})"))
        checks = []
        for item in late:
            if item[0] == "check":
                checks.append(self._truth(item[1], name))
            else:
                (defaults if item[0] == "default" else generated)[item[1]] = self._fragment(item[2], name)
        self.catalog.tables[name.lower()].constraints = dml.Constraints(tuple(not_null), tuple(unique), tuple(checks), defaults, generated, tuple(keys))

    def _reference(self, p: Parser, cols: tuple) -> dml.ForeignKey:
        p.expect("REFERENCES")
        parent = p.name()
        to = tuple(p.names()) if p.peek() == "(" else self.catalog.tables[parent.lower()].primary_key
        actions = {"DELETE": "no action", "UPDATE": "no action"}
        while True:
            if p.accept("ON"):
                what = p.name().upper()
                actions[what] = " ".join([p.name(), *([p.name()] if p.peek() in ("NULL", "DEFAULT", "ACTION") else [])]).lower()
            elif p.accept("MATCH") or p.accept("INITIALLY"):
                p.name()
            elif not (p.accept("NOT", "DEFERRABLE") or p.accept("DEFERRABLE")):
                break
        return dml.ForeignKey(cols, parent.lower(), to, actions["DELETE"], actions["UPDATE"])

    def _pragma(self, name: str, arg) -> DataFrame | None:
        c = self.catalog
        if name in c.settings:
            if arg is not None:
                c.settings[name] = {"on": 1, "off": 0, "true": 1, "false": 0}.get(str(arg).lower(), arg)
                return None
            return self.spark.createDataFrame([(int(c.settings[name]),)], f"{name} long")
        if name in FIXED:
            value = FIXED[name]
            return None if arg is not None else self.spark.createDataFrame([(value,)], f"{name} {'string' if isinstance(value, str) else 'long'}")
        plain = {"table_list": c.table_list, "database_list": c.database_list, "collation_list": c.collation_list, "integrity_check": c.integrity_check, "quick_check": c.integrity_check}
        if name in plain:
            return plain[name]()
        of_table = {"table_info": c.table_info, "table_xinfo": c.table_xinfo, "index_list": c.index_list, "index_info": c.index_info, "foreign_key_list": c.foreign_key_list, "foreign_key_check": c.foreign_key_check}
        return of_table[name](arg) if name in of_table and arg is not None else None


def _struct(name: str, data: DataFrame, columns: list[str] | None):
    """Columns as one struct; without columns it is null."""
    made = F.struct(*(F.col(f"`{c}`") for c in data.columns))
    return (made if columns is not None else F.when(F.lit(False), made)).alias(name)


def _plan_rows(tree: str) -> list[tuple[int, int, int, str]]:
    """(id, parent, 0, detail) of the lines of a physical plan: the steps below a step come after it."""
    out, above = [], []
    for i, line in enumerate(filter(str.strip, tree.splitlines()), 1):
        depth = len(line) - len(line.lstrip(" :+-"))
        while above and above[-1][0] >= depth:
            above.pop()
        out.append((i, above[-1][1] if above else 0, 0, line.lstrip(" :+-")))
        above.append((depth, i))
    return out


def _mentions(q, name: str) -> bool:
    """Whether a query reads a table of that name."""
    if isinstance(q, dict):
        return any(_mentions(v, name) for v in q.values())
    if isinstance(q, tuple) and len(q) == 5 and q[0] == "table" and isinstance(q[1], str) and q[1].lower() == name.lower():
        return True
    return any(_mentions(v, name) for v in q) if isinstance(q, tuple | list) else False


def _renamed(q, old: str, new: str):
    """A query with another name for a column."""
    if isinstance(q, dict):
        return {k: _renamed(v, old, new) for k, v in q.items()}
    if isinstance(q, tuple) and len(q) == 3 and q[0] == "col" and q[2].lower() == old.lower():
        return ("col", q[1], new)
    return type(q)(_renamed(x, old, new) for x in q) if isinstance(q, tuple | list) else q


def _qualified(x, table: str):
    """Bare columns of an upsert mean the stored row."""
    if isinstance(x, tuple):
        if x and x[0] == "col" and x[1] is None:
            return ("col", table, x[2])
        return tuple(_qualified(y, table) for y in x)
    return [_qualified(y, table) for y in x] if isinstance(x, list) else x


def connect(spark: SparkSession | None = None, **tables: DataFrame) -> Connection:
    """A connection over the given DataFrames."""
    out = Connection(spark)
    for name, data in tables.items():
        out.register(name, data)
    return out
