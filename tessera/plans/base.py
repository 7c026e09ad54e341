"""How queries are registered: a function, or one SQL text for both engines, or a text for each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_NAME = re.compile(r"(\bfrom\s|\bjoin\s|,\s|\()(\s*)(" + "|".join(TABLES) + r")\b(?!\s*[.(])", re.I)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables of a data folder, which are read only where the text names them."""
    used = {m[3].lower() for m in _NAME.finditer(text)}
    escaped = text.replace("{", "{{").replace("}", "}}")
    marked = _NAME.sub(lambda m: f"{m[1]}{m[2]}{{{m[3].lower()}}}", escaped)
    return spark.sql(marked, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def query(sql: str | None = None):
    """Register a function under its own name, with the oracle's SQL where there is one."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def run_statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query of the dialect, parsed and translated, over the tables of a data folder that it names."""
    from tessera.plans.connection import connect

    named = {t for t in TABLES if re.search(rf"\b{t}\b", text, re.I)}
    return connect(spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named}).query(text)


def statement(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query of the dialect, which goes through its own parser and translator; the oracle runs its own text or the same one."""
    QUERIES[name] = lambda spark, sf_dir: run_statement(spark, sf_dir, text)
    ORACLE_SQL[name] = text if oracle is None else oracle


def portable(name: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL; the oracle runs its own text or the same one."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLE_SQL[name] = text if oracle is None else oracle
