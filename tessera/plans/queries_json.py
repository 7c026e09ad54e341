"""JSON over the event properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.plans.base import query
from tessera.session import table
from tessera.sources.tables import json_each, json_tree


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "props")


def _column(name: str, build: Callable[[], Column], oracle: str) -> None:
    """Columns are built when the query runs, as a session is active then."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _events(spark, sf_dir).select("event_id", build().alias("v"))

    f.__name__ = name
    query(f"SELECT event_id, {oracle} AS v FROM events")(f)


_K = "(props::JSON->>'$.k')"
_column("n1_json", lambda: J.json(F.col("props")), f"'{{\"k\":' || {_K} || '}}'")
_column("n2_json_valid", lambda: J.json_valid("props"), "CAST(1 AS BIGINT)")
_column("n3_json_type", lambda: J.json_type("props", "$.k"), "'integer'")
_column("n4_json_extract", lambda: J.json_extract("props", "$.k", "bigint"), f"CAST({_K} AS BIGINT)")
_column("p25_arrow", lambda: J.json_arrow("props", "$.k"), _K)
_column("n5_json_array_length", lambda: J.json_array_length("concat('[1,', props, ',2]')"), "CAST(3 AS BIGINT)")
_column("n6_json_array", lambda: J.json_array((F.col("event_id"), "integer"), (F.lit("x"), "text"), (F.col("props"), "json")), f"'[' || event_id || ',\"x\",{{\"k\":' || {_K} || '}}]'")
_column("n6_json_object", lambda: J.json_object(("id", F.col("event_id"), "integer"), ("p", F.col("props"), "json")), f"'{{\"id\":' || event_id || ',\"p\":{{\"k\":' || {_K} || '}}}}'")
_column("n7_json_set", lambda: J.json_set(F.col("props"), "$.k", 1, "$.z", "new"), "'{\"k\":1,\"z\":\"new\"}'")
_column("n7_json_insert", lambda: J.json_insert(F.col("props"), "$.k", 1, "$.z", 2), f"'{{\"k\":' || {_K} || ',\"z\":2}}'")
_column("n7_json_replace", lambda: J.json_replace(F.col("props"), "$.k", 1, "$.z", 2), "'{\"k\":1}'")
_column("n8_json_remove", lambda: J.json_remove(F.col("props"), "$.k"), "'{}'")
_column("n9_json_patch", lambda: J.json_patch(F.col("props"), F.lit('{"k":null,"a":{"b":1}}')), "'{\"a\":{\"b\":1}}'")
_column("n10_json_pretty", lambda: J.json_pretty(F.col("props")), f"'{{' || chr(10) || '    \"k\": ' || {_K} || chr(10) || '}}'")
_column("n11_json_error_position", lambda: J.json_error_position(F.concat(F.col("props"), F.lit("]"))), "CAST(length(props) + 1 AS BIGINT)")
_column("n12_path_from_end", lambda: J.json_extract("concat('[1,', props, ',7]')", "$[#-1]", "bigint"), "CAST(7 AS BIGINT)")

@query("SELECT event_id, 'k' AS key, props::JSON->>'$.k' AS value, 'integer' AS type, '$.k' AS fullkey FROM events")
def s15_json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_each(_events(spark, sf_dir), "props").select("event_id", "key", "value", "type", "fullkey")

@query("SELECT event_id, CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, '$' AS fullkey, 'object' AS type FROM events UNION ALL SELECT event_id, 1, 0, '$.k', 'integer' FROM events")
def s16_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_tree(_events(spark, sf_dir), "props").select("event_id", "id", "parent", "fullkey", "type")
