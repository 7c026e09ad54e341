"""Scalar functions over table columns; the oracle states each rule in its own functions."""

from __future__ import annotations

from tessera.plans.base import statement


def _one(name: str, select: str, oracle: str, source: str = "customer", key: str = "c_custkey") -> None:
    statement(name, f"SELECT {key}, {select} FROM {source}", f"SELECT {key}, {oracle} FROM {source}")


_one("f1_abs", "abs(c_acctbal) AS v", "abs(c_acctbal) AS v")
_one("f2_coalesce", "coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS v", "coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS v")
_one("f3_nullif", "nullif(c_nationkey, 5) AS v", "nullif(c_nationkey, 5) AS v")
_one("f4_iif", "iif(c_acctbal < 0, 'debt', c_acctbal < 1000, 'low', 'rich') AS v, iif(c_acctbal < 0, 1) AS w", "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'rich' END AS v, CASE WHEN c_acctbal < 0 THEN 1 END AS w")
_one("f5_scalar_min", "min(c_nationkey, nullif(c_custkey, 10), 12) AS v", "CASE WHEN c_custkey <> 10 THEN least(c_nationkey, c_custkey, 12) END AS v")
_one("f6_scalar_max", "max(c_nationkey, nullif(c_custkey, 10), 12) AS v", "CASE WHEN c_custkey <> 10 THEN greatest(c_nationkey, c_custkey, 12) END AS v")
_one("f7_typeof", "typeof(nullif(c_nationkey, 3)) AS a, typeof(c_acctbal) AS b, typeof(c_name) AS c", "CASE WHEN c_nationkey = 3 THEN 'null' ELSE 'integer' END AS a, 'real' AS b, 'text' AS c")
_one("f8_likely", "likely(c_nationkey) AS v", "c_nationkey AS v")
_one("f9_length", "length(c_name) AS v", "CAST(length(c_name) AS BIGINT) AS v")
_one("f10_lower_upper", "lower(c_name) AS v, upper(c_name || 'é') AS w", "lower(c_name) AS v, upper(c_name) || 'é' AS w")
_one("f11_substr", "substr(c_name, 3, 4) AS a, substr(c_name, -4) AS b, substr(c_name, 0, 3) AS c, substr(c_name, 5, -2) AS d", "substr(c_name, 3, 4) AS a, substr(c_name, -4) AS b, substr(c_name, 1, 2) AS c, substr(c_name, 3, 2) AS d")
_one("f12_replace", "replace(c_name, '0', 'zero') AS v", "replace(c_name, '0', 'zero') AS v")
_one("f13_trim", "trim(c_name, '0Cur') AS a, rtrim(c_name, '0123456789') AS b, ltrim(c_name, 'Cus') AS c", "trim(c_name, '0Cur') AS a, rtrim(c_name, '0123456789') AS b, ltrim(c_name, 'Cus') AS c")
_one("f14_instr", "instr(c_name, '0') AS a, instr(c_mktsegment, 'ILD') AS b", "CAST(instr(c_name, '0') AS BIGINT) AS a, CAST(instr(c_mktsegment, 'ILD') AS BIGINT) AS b")
_one("f15_concat", "concat(c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS v", "concat(c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS v")
_one("f16_concat_ws", "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS v", "concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) AS v")
_one("f17_char", "char(c_nationkey + 65, 8364) AS v", "chr(c_nationkey + 65) || '€' AS v")
_one("f18_unicode", "unicode(c_mktsegment) AS v", "CAST(unicode(c_mktsegment) AS BIGINT) AS v")
_one("f19_octet_length", "octet_length(c_name || 'é€') AS v", "CAST(strlen(c_name || 'é€') AS BIGINT) AS v")
_one("f21_quote", "quote(c_name || char(39)) AS v", "'''' || c_name || '''''' || '''' AS v")
_one("f25_hex", "hex(c_nationkey) AS v", "CASE WHEN c_nationkey IS NULL THEN '' ELSE hex(CAST(c_nationkey AS VARCHAR)) END AS v")
_one("f26_unhex", "cast(unhex(hex(c_name)) as text) AS v", "c_name AS v")
_one("f27_zeroblob", "hex(zeroblob(c_nationkey)) AS v", "repeat('00', c_nationkey) AS v")
_one("f29_round", "round(c_acctbal / 7, 2) AS a, round(c_nationkey, -1) AS b", "round(c_acctbal / 7, 2) AS a, CAST(c_nationkey AS DOUBLE) AS b")
_one("f30_sign", "sign(c_acctbal) AS v", "CAST(sign(c_acctbal) AS BIGINT) AS v")
_TRIG = ("acos", "asin", "atan", "asinh", "atanh", "sin", "cos", "tan", "sinh", "cosh", "tanh", "degrees", "radians", "exp")
_one(
    "f31_f36_trigonometry",
    ", ".join(f"round({f}(c_nationkey / 30.0), 8) AS {f}_v" for f in _TRIG) + ", round(atan2(c_nationkey, c_custkey), 8) AS atan2_v",
    ", ".join(f"round({f}(c_nationkey / 30.0::DOUBLE), 8) AS {f}_v" for f in _TRIG) + ", round(atan2(c_nationkey, c_custkey), 8) AS atan2_v",
)
_one("f38_f40_logarithms", "round(log(c_custkey), 8) AS a, round(log(3, c_custkey), 8) AS b, round(ln(c_acctbal), 8) AS c, round(log2(c_custkey), 8) AS d", "CASE WHEN c_custkey > 0 THEN round(log10(c_custkey), 8) END AS a, CASE WHEN c_custkey > 0 THEN round(ln(c_custkey) / ln(3), 8) END AS b, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 8) END AS c, CASE WHEN c_custkey > 0 THEN round(log2(c_custkey), 8) END AS d")
_one("f41_mod", "round(mod(c_acctbal, c_nationkey - 5), 6) AS v", "CASE WHEN c_nationkey <> 5 THEN round(c_acctbal - (c_nationkey - 5) * trunc(c_acctbal / (c_nationkey - 5)), 6) END AS v")
_one("f42_f44_power", "round(power(c_acctbal, 0.5), 6) AS a, round(sqrt(c_acctbal), 6) AS b, round(pi(), 10) AS c", "CASE WHEN c_acctbal >= 0 THEN round(power(c_acctbal, 0.5), 6) END AS a, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS b, round(pi(), 10) AS c")
_one("f45_ceil_floor_trunc", "ceil(c_acctbal) AS a, floor(c_acctbal) AS b, trunc(c_acctbal) AS c, ceil(c_custkey) AS d", "ceil(c_acctbal) AS a, floor(c_acctbal) AS b, trunc(c_acctbal) AS c, c_custkey AS d")



def _date(name: str, select: str, oracle: str) -> None:
    _one(name, select, oracle, "orders", "o_orderkey")


def _event(name: str, select: str, oracle: str) -> None:
    _one(name, select, oracle, "events", "event_id")


_date("f47_date", "date(o_orderdate) AS v, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS w", "strftime(o_orderdate, '%Y-%m-%d') AS v, strftime(last_day(o_orderdate), '%Y-%m-%d') AS w")
_event("f48_time", "time(ts) AS v", "strftime(ts, '%H:%M:%S') AS v")
_event("f49_datetime", "datetime(ts, '+90 minutes') AS v", "strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS v")
_event("f50_julianday", "round(julianday(ts), 6) AS v", "round(floor(epoch_us(ts) / 1000) / 86400000.0 + 2440587.5, 6) AS v")
_event("f51_unixepoch", "unixepoch(ts) AS v", "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS v")
_event("f52_strftime", "strftime('%d/%m/%Y %j %w %u %H-%I %p %W %%', ts) AS v", "strftime(ts, '%d/%m/%Y %j %w %u %H-%I %p %W %%') AS v")
_date("f47_month_rolls_over", "date(o_orderdate, '+1 month') AS v", "strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (CAST(day(o_orderdate) AS INTEGER) - 1) * INTERVAL 1 DAY, '%Y-%m-%d') AS v")
_date("f47_weekday", "date(o_orderdate, 'weekday 0') AS v", "strftime(o_orderdate + ((7 - dayofweek(o_orderdate)) % 7) * INTERVAL 1 DAY, '%Y-%m-%d') AS v")
_date("f47_parse_text", "datetime(date(o_orderdate) || ' 10:30+02:00', 'start of day', '+1 year') AS v", "strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR + CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d 00:00:00') AS v")
