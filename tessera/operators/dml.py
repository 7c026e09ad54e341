"""Inserts, updates, deletes and upserts as new snapshots of a table, with constraints checked before they replace it.

A table is a DataFrame; every change gives the new rows and the changed rows. Statements see the table as it
was before them, as set-based rewrites do.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConstraintError(Exception):
    """Rows that a constraint forbids."""


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()


def violations(df: DataFrame, constraints: Constraints, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, detail, n) of the constraints that rows break: at most a row for each constraint.

    A unique key with a NULL part never clashes, a NULL check passes, a NULL foreign key refers to nothing.
    """
    spark = df.sparkSession
    out = spark.createDataFrame([], "kind string, detail string, n long")
    plain = [("not null", c, F.col(c).isNull()) for c in constraints.not_null]
    plain += [("check", c, ~F.coalesce(F.expr(c).cast("boolean"), F.lit(True))) for c in constraints.checks]
    if plain:  # one pass for all that is told row by row
        sums = df.agg(*(F.coalesce(F.sum(F.when(broken, 1).otherwise(0)), F.lit(0)).alias(f"b{i}") for i, (_, _, broken) in enumerate(plain)))
        each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), F.col(f"b{i}").alias("n")) for i, (kind, detail, _) in enumerate(plain))))
        out = out.unionAll(sums.select(each.alias("p")).select("p.*").filter("n > 0"))
    for key in constraints.unique:
        whole = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("_times")).filter("_times > 1")
        out = out.unionAll(whole.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("unique"), F.lit(", ".join(key)), "n"))
    for fk in constraints.foreign_keys:
        parent = (parents or {})[fk.parent].select(*(F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)))
        lost = df.dropna(subset=list(fk.columns)).join(parent, list(fk.columns), "left_anti")
        out = out.unionAll(lost.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("foreign key"), F.lit(fk.parent), "n"))
    return out


def checked(df: DataFrame, constraints: Constraints, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """df, if it breaks no constraint."""
    if broken := [tuple(r) for r in violations(df, constraints, parents).collect()]:
        raise ConstraintError("; ".join(f"{k} {d}: {n}" for k, d, n in broken))
    return df


def completed(rows: DataFrame, table: DataFrame, constraints: Constraints) -> DataFrame:
    """rows with the table's columns: defaults for those that are missing, generated columns computed in their order."""
    have = set(rows.columns)
    for f in table.schema:
        if f.name not in have and f.name not in constraints.generated:
            rows = rows.withColumn(f.name, F.expr(constraints.defaults.get(f.name, "null")).cast(f.dataType))
    left = dict(constraints.generated)
    while left:
        ready = [c for c, e in left.items() if not any(o in e for o in left if o != c)] or list(left)[:1]
        for c in ready:
            rows = rows.withColumn(c, F.expr(left.pop(c)).cast(table.schema[c].dataType))
    return rows.select(*table.columns)


def insert(table: DataFrame, rows: DataFrame, constraints: Constraints = Constraints(), conflict: str = "abort", key: tuple[str, ...] = (), parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table with rows added. conflict: abort (constraints are checked), ignore or replace by every unique key.

    `ignore` leaves out rows that break NOT NULL, CHECK or a key; `replace` puts a column's default in place of
    a NULL that is forbidden and takes out the rows whose keys return. Of new rows with one key the first in
    the order of all columns stays with `ignore`, the last with `replace`. Foreign keys are checked always.
    """
    rows = completed(rows, table, constraints)
    if conflict == "abort":
        return checked(table.unionAll(rows), constraints, parents)
    order = [F.col(c) for c in rows.columns]
    ok = F.lit(True)
    for c in constraints.not_null:
        if conflict == "replace" and c in constraints.defaults:
            rows = rows.withColumn(c, F.coalesce(F.col(c), F.expr(constraints.defaults[c]).cast(table.schema[c].dataType)))
        ok = ok & F.col(c).isNotNull()
    for check in constraints.checks:
        ok = ok & F.coalesce(F.expr(check).cast("boolean"), F.lit(True))
    if conflict == "ignore":
        rows = rows.filter(ok)
    for k in dict.fromkeys((*([key] if key else []), *constraints.unique)):
        whole = F.lit(True)
        for c in k:
            whole = whole & F.col(c).isNotNull()  # keys with a NULL part never clash
        w = Window.partitionBy(*k).orderBy(*(order if conflict == "ignore" else [c.desc() for c in order]))
        rows = rows.withColumn("_n", F.when(whole, F.row_number().over(w)).otherwise(1)).filter("_n = 1").drop("_n")
        if conflict == "ignore":
            rows = rows.join(table.select(*k), list(k), "left_anti").select(*table.columns)
        else:
            table = table.join(rows.select(*k), list(k), "left_anti").select(*table.columns)
    return checked(table.unionAll(rows), constraints, parents)


def upsert(table: DataFrame, rows: DataFrame, key: tuple[str, ...], sets: dict[str, str] | None, where: str | None = None, constraints: Constraints = Constraints()) -> DataFrame:
    """INSERT ... ON CONFLICT(key) DO UPDATE SET column = SQL over `old` and `excluded` (None: DO NOTHING), by one full join."""
    new = completed(rows, table, constraints)
    old, excluded = table.alias("old"), new.alias("excluded")
    same = [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in key]
    both = old.withColumn("_o", F.lit(1)).alias("old").join(excluded.withColumn("_e", F.lit(1)).alias("excluded"), same, "full")
    hit = F.col("old._o").isNotNull() & F.col("excluded._e").isNotNull()
    if where:
        hit = hit & F.coalesce(F.expr(where), F.lit(False))
    value = lambda c: F.when(F.col("old._o").isNull(), F.col(f"excluded.{c}")).when(hit & F.lit(bool(sets and c in sets)), F.expr((sets or {}).get(c, "null")).cast(table.schema[c].dataType)).otherwise(F.col(f"old.{c}"))
    return checked(both.select(*(value(c).alias(c) for c in table.columns)), constraints)


def update(table: DataFrame, sets: dict[str, str], where: str | None = None, constraints: Constraints = Constraints()) -> tuple[DataFrame, DataFrame]:
    """The table after UPDATE, and the changed rows (for RETURNING). Assignments see the old values."""
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    marked = table.withColumn("_hit", hit)
    new = marked.select(*((F.when(F.col("_hit"), F.expr(sets[c]).cast(table.schema[c].dataType)).otherwise(F.col(c))).alias(c) if c in sets else F.col(c) for c in table.columns), "_hit")
    return checked(new.drop("_hit"), constraints), new.filter("_hit").drop("_hit")


def delete(table: DataFrame, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after DELETE, and the deleted rows."""
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    return table.filter(~hit), table.filter(hit)


def cascade(tables: dict[str, DataFrame], constraints: dict[str, Constraints], name: str, gone: DataFrame, most_rounds: int = 100) -> dict[str, DataFrame]:
    """All tables after rows of `name` went: children follow by their foreign keys' action, round by round."""
    tables = dict(tables)
    todo = [(name, gone)]
    for _ in range(most_rounds):
        if not todo:
            return tables
        parent, lost = todo.pop()
        lost = lost.checkpoint()
        if lost.isEmpty():
            continue
        for child, rules in constraints.items():
            for fk in rules.foreign_keys:
                if fk.parent != parent:
                    continue
                keys = lost.select(*(F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True))).dropna().distinct()
                hit = tables[child].join(keys, list(fk.columns), "left_semi")
                match fk.on_delete.lower():
                    case "cascade":
                        tables[child] = tables[child].join(keys, list(fk.columns), "left_anti").select(*tables[child].columns)
                        todo.append((child, hit))
                    case "set null" | "set default":
                        kept = tables[child].join(keys, list(fk.columns), "left_anti").select(*tables[child].columns)
                        given = lambda c, rules=rules, fk=fk: F.expr(rules.defaults.get(c, "null")) if fk.on_delete.lower() == "set default" else F.lit(None)
                        nulled = hit.select(*(given(c).cast(hit.schema[c].dataType).alias(c) if c in fk.columns else F.col(c) for c in tables[child].columns))
                        tables[child] = kept.unionAll(nulled)
                        checked(tables[child], Constraints(not_null=rules.not_null, foreign_keys=(fk,)), tables)
                    case _:
                        if not hit.isEmpty():
                            raise ConstraintError(f"foreign key of {child} to {parent}")
    raise RuntimeError(f"no end after {most_rounds} rounds")


def follow_update(tables: dict[str, DataFrame], constraints: dict[str, Constraints], name: str, old: DataFrame, sets: dict[str, str], where: str | None) -> dict[str, DataFrame]:
    """All tables after rows of `name` were updated: children whose key changed follow by their foreign keys' action.

    tables has the table's new rows, old its former ones; sets and where are those of the update. Children's
    own children aren't followed: a key that is both is refused by the check of their foreign key.
    """
    tables = dict(tables)
    for child, rules in constraints.items():
        for fk in rules.foreign_keys:
            if fk.parent != name or not set(fk.parent_columns) & set(sets):
                continue
            hit = old.filter(F.coalesce(F.expr(where), F.lit(False))) if where else old
            new = [F.expr(sets[p]).cast(old.schema[p].dataType) if p in sets else F.col(p) for p in fk.parent_columns]
            same = F.lit(True)
            for p, n in zip(fk.parent_columns, new, strict=True):
                same = same & F.col(p).eqNullSafe(n)
            moved = hit.filter(~same).select(*(F.col(p).alias(f"_o{i}") for i, p in enumerate(fk.parent_columns)), *(n.alias(f"_n{i}") for i, n in enumerate(new))).checkpoint()
            if moved.isEmpty():
                continue
            action = fk.on_update.lower()
            rows = tables[child]
            on = [F.col(c) == F.col(f"_o{i}") for i, c in enumerate(fk.columns)]
            if action in ("no action", "restrict"):
                if not rows.join(moved, on, "left_semi").isEmpty():
                    raise ConstraintError(f"foreign key of {child} to {name}")
                continue
            value = lambda c, i, rules=rules, action=action: F.col(f"_n{i}") if action == "cascade" else F.expr(rules.defaults.get(c, "null")) if action == "set default" else F.lit(None)
            place = {c: i for i, c in enumerate(fk.columns)}
            both = rows.join(moved, on, "left")
            tables[child] = both.select(*(F.when(F.col("_o0").isNotNull(), value(c, place[c])).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in place else F.col(c) for c in rows.columns))
            checked(tables[child], Constraints(not_null=rules.not_null, foreign_keys=(fk,)), tables)
    return tables


def new_rowids(rows: DataFrame, table: DataFrame, rowid: str, order: list[str]) -> DataFrame:
    """rows with ids after the largest of the table, in a stated order: partition counts first, so that no task holds all rows."""
    start = table.agg(F.coalesce(F.max(rowid), F.lit(0)).alias("m")).first()["m"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).checkpoint()
    counts = sorted((r["_p"], r["n"], r["lo"]) for r in ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("lo")).collect())
    base, at = F.lit(None).cast("long"), start
    for p, n, lo in counts:  # a row for each partition
        base = F.when(F.col("_p") == p, F.lit(at + 1 - lo)).otherwise(base)
        at += n
    return ranged.withColumn(rowid, base + F.col("_i")).drop("_p", "_i")
