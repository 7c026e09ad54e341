"""Function fragments against the standard library's sqlite3 over grids of values."""

import math
import sqlite3

import pytest

from tessera.functions import core as c
from tessera.functions import dates as d

db = sqlite3.connect(":memory:")


def check(spark, cases):
    """cases: (fragment, SQL for sqlite3)."""
    got = spark.sql("select " + ", ".join(f"{a} as c{i}" for i, (a, _) in enumerate(cases))).first()
    for v, (a, b) in zip(got, cases, strict=True):
        want = db.execute(f"select {b}").fetchone()[0]
        v = bytes(v) if isinstance(v, bytearray) else int(v) if isinstance(v, bool) else v
        same = v is None and want is None or v is not None and want is not None and (math.isclose(v, want, rel_tol=1e-12, abs_tol=1e-12) if isinstance(want, float) or isinstance(v, float) else v == want)
        assert same, (a, v, b, want)


def test_substr(spark):
    check(spark, [(c.substr("'hello'", str(y), str(z)), f"substr('hello', {y}, {z})") for y in range(-8, 9) for z in range(-7, 8)] + [(c.substr("'hello'", str(y)), f"substr('hello', {y})") for y in range(-8, 9)])


def test_shifts_and_division(spark):
    for a in (0, 1, -1, 5, -9, 2**62, -(2**63) + 1):
        cases = [(c.shift(f"{a}L", f"{b}L", left), f"({a}) {'<<' if left else '>>'} ({b})") for b in (-70, -64, -3, 0, 1, 5, 63, 64, 90) for left in (True, False)]
        check(spark, cases + [(c.int_div(f"{a}L", f"{b}L"), f"({a}) / ({b})") for b in (-3, 0, 2)] + [(c.int_mod(f"{a}L", f"{b}L"), f"({a}) % ({b})") for b in (-3, 0, 2)])


def test_like_and_glob(spark):
    values = ["", "abc", "ABC", "a%c", "a_c", "日本語", "É", "é", "a\\c", "ab\nc"]
    likes = ["", "%", "a%", "_b_", "A%C", "a!%c", "日%", "é", "a\\c", "%\n%"]
    globs = ["*", "a?c", "[a-c]*", "[^a]*", "*[%_]*", "日?語", "[", "A*", "a\\c", "[]]*"]
    q = lambda s: "'" + s.replace("'", "''") + "'"
    check(spark, [(c.like(c.text_literal(v), c.text_literal(p)), f"{q(v)} like {q(p)}") for v in values for p in likes])
    check(spark, [(c.like(c.text_literal(v), c.text_literal("a!%c"), "'!'"), f"{q(v)} like 'a!%c' escape '!'") for v in values])
    check(spark, [(c.glob(c.text_literal(v), p), f"{q(v)} glob {q(p)}") for v in values for p in globs])


def test_texts(spark):
    cases = [(c.lower("'ÀbÉC'"), "lower('ÀbÉC')"), (c.upper("'ÀbÉc'"), "upper('ÀbÉc')"), (c.instr("'hello'", "''"), "instr('hello', '')"), (c.unicode("'€x'"), "unicode('€x')"), (c.unicode("''"), "unicode('')"), (c.char("8364", "65"), "char(8364, 65)"), (c.hex_text("255"), "hex(255)"), (c.hex_text("null"), "hex(null)"), (c.round_to("2.5D"), "round(2.5)"), (c.round_to("123.456D", -1), "round(123.456, -1)"), (c.sign("-2.5D"), "sign(-2.5)"), (c.least("3", "null"), "min(3, null)"), (c.greatest("3", "7"), "max(3, 7)"), (c.iif("false", "1"), "iif(0, 1, null)"), (c.trim("'xxhixx'", "'x'"), "trim('xxhixx', 'x')"), (c.quote("'it''s'".replace("''", "\\'"), "text"), "quote('it''s')"), (c.sqrt("-1D"), "sqrt(-1)"), (c.log("100D"), "log(100)"), (c.log("8D", "2D"), "log(2, 8)"), (c.trunc("-2.7D", True), "trunc(-2.7)")]
    check(spark, cases)


@pytest.mark.parametrize("text", ["12abc", " 42 ", "1e3x", "0x10", "", "abc", "-7.9", "+.5", "99999999999999999999", "-", "1.5.2"])
def test_casts(spark, text):
    check(spark, [(c.cast(f"'{text}'", t, True), f"cast('{text}' as {t})") for t in ("INTEGER", "REAL", "TEXT")] + [(c.cast(f"'{text}'", "NUMERIC", True), f"cast('{text}' as real)")])


def test_dates(spark):
    times = ["2024-02-29", "2023-12-31 23:59:58.5", "1999-01-01T00:00", "2000-06-15 12:30:45Z", "2024-03-10 05:06:07+02:30", "bad", "2024-13-01", "12:30"]
    mods = [(), ("+1 month",), ("+1 year",), ("-10 days",), ("start of month", "+1 month", "-1 day"), ("weekday 0",), ("weekday 4",), ("+1.5 hours",), ("start of year",), ("+02:30",), ("nonsense",)]
    for t in times:
        cases = []
        for m in mods:
            ms, rest = d.modify(d.parse(f"'{t}'"), *m), "".join(f", '{x}'" for x in m)
            cases += [(d.datetime(ms), f"datetime('{t}'{rest})"), (d.julianday(ms), f"julianday('{t}'{rest})"), (d.unixepoch(ms), f"unixepoch('{t}'{rest})")]
        check(spark, cases)
    check(spark, [(d.strftime(f"%{k}|", d.parse(f"'{t}'")), f"strftime('%{k}|', '{t}')") for t in times[:4] for k in "dfHjmMsSwWY%"])
