"""Aggregates of the dialect: total, ordered concatenation, JSON arrays and objects, FILTER."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.core import real_text


def total(x: str) -> Column:
    """Sum as a double; 0.0 without values."""
    return F.coalesce(F.sum(F.col(x).cast("double")), F.lit(0.0))


def only(condition: Column, x: Column) -> Column:
    """Argument of an aggregate with FILTER (WHERE condition)."""
    return F.when(condition, x)


def group_concat(x: str, separator: str = ",", order: list[str] | None = None, distinct: bool = False) -> Column:
    """Concatenation in a stated order (by default the values' own)."""
    inner = f"{'distinct ' if distinct else ''}cast(`{x}` as string), '{separator}'"
    by = f"cast(`{x}` as string)" if distinct or not order else ", ".join(order)
    return F.expr(f"listagg({inner}) within group (order by {by})")


def json_value(x: str, kind: str) -> str:
    """SQL: JSON text of a value; kind: text, integer, real or json (already JSON text)."""
    body = {"text": f"to_json(struct({x} as v))", "integer": f"cast({x} as string)", "real": f"({real_text(x)})", "json": x}[kind]
    if kind == "text":
        body = f"substring({body}, 6, length({body}) - 6)"
    return f"if({x} is null, 'null', {body})"


def json_group_array(x: str, kind: str, order: list[str]) -> Column:
    """JSON array of all values, NULLs as null, in a stated order."""
    return F.expr(f"concat('[', coalesce(listagg({json_value(x, kind)}, ',') within group (order by {', '.join(order)}), ''), ']')")


def json_group_object(key: str, x: str, kind: str, order: list[str]) -> Column:
    """JSON object of key and value pairs; repeated keys stay."""
    return F.expr(f"concat('{{', coalesce(listagg(concat({json_value(key, 'text')}, ':', {json_value(x, kind)}), ',') within group (order by {', '.join(order)}), ''), '}}')")
