"""Functions that Spark's own can't express, as Arrow-batched Python: printf, unistr, timediff, JSON with any path, GLOB with any pattern."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import jsonsql
from tessera.functions.core import glob_regex

_SPEC = re.compile(r"%([-+ 0#,!]*)(\*|[0-9]+)?(?:\.(\*|[0-9]+))?(?:ll|l|h)?(.)", re.S)
_ESCAPE = re.compile(r"\\(?:(\\)|([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4})|\+([0-9A-Fa-f]{6})|U([0-9A-Fa-f]{8})|)")
_PREFIX = re.compile(r"\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


def _as_number(v, whole: bool):
    if v is None:
        return 0 if whole else 0.0
    if isinstance(v, str):
        m = _PREFIX.match(v)
        v = float(m[1]) if m else 0.0
    return int(v) if whole else float(v)


def printf(fmt: str | None, args: list) -> str | None:
    """The dialect's printf. Missing arguments are 0 or empty; an unknown conversion ends the output."""
    if fmt is None:
        return None
    out, at, rest = [], 0, iter(args)
    for m in _SPEC.finditer(fmt):
        out.append(fmt[at : m.start()])
        at = m.end()
        flags, width, precision, kind = m[1], m[2], m[3], m[4]
        if kind == "%":
            out.append("%")
            continue
        if width == "*":
            width = _as_number(next(rest, None), True)
            flags, width = (flags + "-", -width) if width < 0 else (flags, width)
        width = int(width or 0)
        if precision == "*":
            precision = abs(_as_number(next(rest, None), True))
        precision = None if precision is None else int(precision)
        if kind in "diuxXo":
            v = _as_number(next(rest, None), True)
            if kind in "uxXo":
                v %= 2**64
            body = format(abs(v), {"d": "d", "i": "d", "u": "d"}.get(kind, kind))
            if "," in flags and kind in "di":
                body = format(abs(v), ",d")
            if precision is not None:
                body = body.rjust(precision, "0")
            lead = ("-" if v < 0 else "+" if "+" in flags else " " if " " in flags else "") if kind in "di" else ({"x": "0x", "X": "0X", "o": "0"}[kind] if "#" in flags and v and kind in "xXo" else "")
            if "0" in flags and "-" not in flags:
                body = body.rjust(width - len(lead), "0")
            text = lead + body
        elif kind in "feEgG":
            v = _as_number(next(rest, None), False)
            if v in (float("inf"), float("-inf")):
                text = ("-" if v < 0 else "+" if "+" in flags else "") + "Inf"
            else:
                sign = "+" if "+" in flags else " " if " " in flags else ""
                text = format(v, f"{sign}{'#' if '#' in flags else ''}{',' if ',' in flags else ''}.{6 if precision is None else precision}{kind}")
                if "0" in flags and "-" not in flags:
                    lead = text[0] if text[0] in "+- " else ""
                    text = lead + text[len(lead) :].rjust(width - len(lead), "0")
        elif kind in "szqQwc":
            v = next(rest, None)
            text = "" if v is None else str(v) if not isinstance(v, float) else repr(v)
            if kind == "c":
                text = text[:1] * (precision or 1)
            elif kind in "qQw":
                if v is None:
                    text = "NULL" if kind == "Q" else "(NULL)"
                else:
                    mark = '"' if kind == "w" else "'"
                    text = (text if precision is None else text[:precision]).replace(mark, mark * 2)
                    text = f"'{text}'" if kind == "Q" else text
            elif precision is not None:
                text = text[:precision]
        else:
            return "".join(out)
        out.append(text.ljust(width) if "-" in flags else text.rjust(width))
    tail = fmt[at:]
    return "".join(out) + (tail.split("%")[0] if "%" in tail else tail)


def unistr(x: str | None) -> str | None:
    """Text with backslash escapes of code points resolved; other backslashes are errors."""

    def one(m: re.Match) -> str:
        code = m[2] or m[3] or m[4] or m[5]
        if m[1]:
            return "\\"
        if code is None or int(code, 16) > 0x10FFFF:
            raise ValueError("invalid Unicode escape")
        return chr(int(code, 16))

    return None if x is None else _ESCAPE.sub(one, x)


def _months(t: datetime, n: int) -> datetime:
    """n months on; days beyond the month roll into the next."""
    y, m = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=y, month=m + 1, day=1) + timedelta(days=t.day - 1)


def timediff(a: int | None, b: int | None) -> str | None:
    """What must be added to b to get a (milliseconds since 1970), in years, months, days and time."""
    if a is None or b is None:
        return None
    epoch = datetime(1970, 1, 1)
    x, y = epoch + timedelta(milliseconds=a), epoch + timedelta(milliseconds=b)
    sign = 1 if x >= y else -1
    n = abs((x.year - y.year) * 12 + x.month - y.month)
    while n and (_months(y, sign * n) - x).total_seconds() * sign > 0:
        n -= 1
    rest = abs(x - _months(y, sign * n))
    hours, seconds = divmod(rest.seconds, 3600)
    return f"{'+' if sign > 0 else '-'}{n // 12:04d}-{n % 12:02d}-{rest.days:02d} {hours:02d}:{seconds // 60:02d}:{seconds % 60:02d}.{rest.microseconds // 1000:03d}"


def _typed(args: list[str | None]) -> list:
    """Arguments as they were: each has its class's letter in front."""
    return [None if v is None else int(v[1:]) if v[0] == "i" else float(v[1:]) if v[0] == "r" else v[1:] for v in args]


@lru_cache(maxsize=256)
def _glob(pattern: str) -> re.Pattern:
    return re.compile(glob_regex(pattern).replace("\\z", "\\Z"))


def glob(text: str | None, pattern: str | None) -> bool | None:
    return None if text is None or pattern is None else _glob(pattern).search(text) is not None


def register(spark: SparkSession) -> None:
    """The functions under their SQL names: tessera_ before printf(format, array of lettered texts), json(name, array of lettered texts), unistr, timediff, glob."""
    spark.udf.register("tessera_json", F.udf(jsonsql.call, "string", useArrow=True))
    spark.udf.register("tessera_glob", F.udf(glob, "boolean", useArrow=True))
    spark.udf.register("tessera_printf", F.udf(lambda f, a: printf(f, _typed(a)), "string", useArrow=True))
    spark.udf.register("tessera_unistr", F.udf(unistr, "string", useArrow=True))
    spark.udf.register("tessera_timediff", F.udf(timediff, "string", useArrow=True))
