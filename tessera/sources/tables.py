"""Table-valued sources: json_each and json_tree as table functions, importing SQLite files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EACH = "key string, value string, type string, atom string, id long, parent long, fullkey string, path string"


def _kind(v) -> str:
    return "null" if v is None else "true" if v is True else "false" if v is False else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "text" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _sql(v):
    return None if v is None else str(int(v)) if isinstance(v, bool) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, dict | list) else str(v)


def _label(k) -> str:
    return f"[{k}]" if isinstance(k, int) else f".{k}" if k.isalnum() and not k[0].isdigit() else f'."{k}"'


def walk(text: str | None, root: str = "$", deep: bool = True):
    """Rows of a JSON text in pre-order; ids number the elements in that order. Text that isn't JSON has no rows."""
    from tessera.functions.json import _MISSING, _get, parse_path

    if text is None:
        return
    try:
        value = _get(json.loads(text), parse_path(root))
    except ValueError:
        return
    if value is _MISSING:
        return
    number = -1

    def row(k, v, parent, full, path):
        nested = isinstance(v, dict | list)
        return (None if k is None else str(k), _sql(v), _kind(v), None if nested else _sql(v), number, parent, full, path)

    def visit(k, v, parent, full, path):
        nonlocal number
        number += 1
        own = number
        yield row(k, v, parent, full, path)
        yield from children(v, own, full)

    def children(v, own, full):
        for k, w in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from visit(k, w, own, full + _label(k), full)

    if deep:
        yield from visit(None, value, None, root, root)
        return
    number = 0
    if not isinstance(value, dict | list):
        yield row(None, value, None, root, root)
        return
    for k, v in value.items() if isinstance(value, dict) else enumerate(value):
        number += 1
        yield row(k, v, None, root + _label(k), root)


_KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _beside(df: DataFrame, column: str, root: str, deep: bool) -> DataFrame:
    """df's columns, repeated for each element, and the elements' columns: whole Arrow batches at a time."""
    at, names = df.columns.index(column), [f.split()[0] for f in EACH.split(", ")]
    fields = [*df.schema.fields, *(T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(names, _KINDS, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                own = list(walk(text, root, deep))
                rows.extend(own)
                place.extend([i] * len(own))
            if rows:
                taken = batch.take(pa.array(place, pa.int64()))
                cells = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *cells], names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def json_each(df: DataFrame, column: str, root: str = "$") -> DataFrame:
    """df beside the children of a JSON column."""
    return _beside(df, column, root, False)


def json_tree(df: DataFrame, column: str, root: str = "$") -> DataFrame:
    """df beside all elements of a JSON column."""
    return _beside(df, column, root, True)


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a SQLite file that the driver can open, for moving small databases here."""
    import sqlite3

    from tessera.functions.core import SPARK_TYPE, affinity

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        info = db.execute(f'pragma table_info("{table}")').fetchall()
        rows = db.execute(f'select * from "{table}"').fetchall()
    schema = ", ".join(f"`{c[1]}` {SPARK_TYPE[affinity(c[2])]}" for c in info)
    convert = [{"bigint": int, "double": float, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}[SPARK_TYPE[affinity(c[2])]] for c in info]
    return spark.createDataFrame([tuple(None if v is None else f(v) for v, f in zip(r, convert, strict=True)) for r in rows], schema)
