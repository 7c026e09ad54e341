"""Date and time functions over milliseconds since 1970, as SQL fragments; invalid times are NULL.

A time is a bigint fragment made by `parse` (ISO text), `from_unix` or `from_julian`; modifiers map times to
times, left to right; formats map times to text. Inputs that are used more than once should be columns.
"""

from __future__ import annotations

import re

_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
_ISO = r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2}))?(?:[ T]*([0-9]{2}):([0-9]{2})(?::([0-9]{2}(?:\\.[0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
_WEEKDAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _day(y: str, m: str, d: str) -> str:
    """Days since 1970 of a year, a month that may lie outside 1 to 12, and a day that may lie beyond the month."""
    return f"(unix_date(make_date(cast({y} + floor(({m} - 1) / 12.0D) as int), cast(pmod({m} - 1, 12) as int) + 1, 1)) + {d} - 1)"


def parse(x: str) -> str:
    """Milliseconds of ISO text: a date, a date and time, or a time on 2000-01-01; offsets are taken off. Days up to 31 roll over."""
    g = lambda i: f"nullif(regexp_extract(trim({x}), '{_ISO}', {i}), '')"
    y, mo, d, h, mi, s, zone = (g(i) for i in range(1, 8))
    day = _day(f"cast(coalesce({y}, '2000') as int)", f"cast(coalesce({mo}, '01') as int)", f"cast(coalesce({d}, '01') as int)")
    clock = f"(cast(coalesce({h}, '0') as bigint) * 3600000 + cast(coalesce({mi}, '0') as bigint) * 60000 + cast(round(cast(coalesce({s}, '0') as double) * 1000) as bigint))"
    off = f"case when {zone} rlike '^[+-]' then (cast(substring({zone}, 2, 2) as bigint) * 60 + cast(substring({zone}, 5, 2) as bigint)) * if({zone} like '-%', -60000, 60000) else 0L end"
    valid = f"trim({x}) rlike '{_ISO}' and trim({x}) <> '' and coalesce(cast({mo} as int), 1) between 1 and 12 and coalesce(cast({d} as int), 1) between 1 and 31 and coalesce(cast({h} as int), 0) < 24 and coalesce(cast({mi} as int), 0) < 60 and coalesce(cast({s} as double), 0) < 60"
    return f"case when {valid} then {day} * 86400000L + {clock} - {off} end"


def from_timestamp(x: str) -> str:
    """Milliseconds of a date or a timestamp without zone; the session is in UTC."""
    return f"unix_millis(cast({x} as timestamp))"


def from_unix(x: str) -> str:
    return f"cast(round({x} * 1000) as bigint)"


def from_julian(x: str) -> str:
    return f"cast(round(({x} - 2440587.5D) * 86400000) as bigint)"


def from_either(x: str) -> str:
    """A Julian day where the number can be one, else seconds since 1970."""
    return f"case when {x} >= 0 and {x} < 5373484.5D then {from_julian(x)} when {x} between -210866760000L and 253402300799L then {from_unix(x)} end"


def _date(ms: str) -> str:
    return f"date_from_unix_date(cast(floor({ms} / 86400000.0D) as int))"


def modify(ms: str, *modifiers: str) -> str:
    """The time after constant modifiers."""
    for m in modifiers:
        ms = _let(ms, "t", _modified(m.strip().lower()))
    return ms


def _modified(m: str) -> str:
    clock = "pmod(t, 86400000L)"
    if got := re.fullmatch(r"([+-]?[0-9]+(?:\.[0-9]+)?) *(second|minute|hour|day)s?", m):
        return f"t + {round(float(got[1]) * _UNITS[got[2]])}L"
    if got := re.fullmatch(r"([+-]?[0-9]+) *(month|year)s?", m):
        n = int(got[1]) * (12 if got[2] == "year" else 1)
        return f"{_let(_date('t'), 'd', _day('year(d)', f'(month(d) + {n})', 'day(d)'))} * 86400000L + {clock}"
    if got := re.fullmatch(r"([+-])([0-9]{2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]+)?))?", m):
        ms = (int(got[2]) * 3600 + int(got[3]) * 60 + float(got[4] or 0)) * 1000
        return f"t {got[1]} {round(ms)}L"
    if got := re.fullmatch(r"start of (day|month|year)", m):
        if got[1] == "day":
            return f"t - {clock}"
        return f"unix_date(trunc({_date('t')}, '{got[1]}')) * 86400000L"
    if got := re.fullmatch(r"weekday ([0-6])", m):
        return f"unix_date(next_day({_date('t')} - 1, '{_WEEKDAYS[int(got[1])]}')) * 86400000L + {clock}"
    if m in ("subsec", "subsecond", "utc", "localtime"):  # the session is in UTC
        return "t"
    return "cast(null as bigint)"


def date(ms: str) -> str:
    return f"date_format({_date(ms)}, 'yyyy-MM-dd')"


def time(ms: str, subsec: bool = False) -> str:
    return strftime("%H:%M:%f" if subsec else "%H:%M:%S", ms)


def datetime(ms: str, subsec: bool = False) -> str:
    return f"concat({date(ms)}, ' ', {time(ms, subsec)})"


def julianday(ms: str) -> str:
    return f"({ms} / 86400000.0D + 2440587.5D)"


def unixepoch(ms: str, subsec: bool = False) -> str:
    return f"({ms} / 1000.0D)" if subsec else f"cast(floor({ms} / 1000.0D) as bigint)"


def strftime(fmt: str, ms: str) -> str:
    """Text of a time by a constant format; an unknown code makes it NULL."""
    d, sec = "date_from_unix_date(cast(floor(t / 86400000.0D) as int))", "(pmod(t, 86400000L) div 1000)"
    pad = lambda x, n, c="0": f"lpad(cast({x} as string), {n}, '{c}')"
    hour12 = f"(({sec} div 3600 + 11) % 12 + 1)"
    hour, minute, second = f"({sec} div 3600)", f"({sec} div 60 % 60)", f"({sec} % 60)"
    codes = {
        "d": pad(f"day({d})", 2), "e": pad(f"day({d})", 2, " "), "m": pad(f"month({d})", 2), "Y": pad(f"year({d})", 4), "j": pad(f"dayofyear({d})", 3),
        "H": pad(hour, 2), "k": pad(hour, 2, " "), "I": pad(hour12, 2), "l": pad(hour12, 2, " "), "M": pad(minute, 2), "S": pad(second, 2),
        "f": f"concat({pad(second, 2)}, '.', {pad('pmod(t, 1000L)', 3)})", "p": f"if({hour} < 12, 'AM', 'PM')", "P": f"if({hour} < 12, 'am', 'pm')",
        "s": "cast(cast(floor(t / 1000.0D) as bigint) as string)", "J": "cast(t / 86400000.0D + 2440587.5D as string)",
        "w": f"cast(dayofweek({d}) - 1 as string)", "u": f"cast(weekday({d}) + 1 as string)",
        "W": pad(f"cast(floor((dayofyear({d}) - 1 - weekday({d}) + 7) / 7) as int)", 2), "U": pad(f"cast(floor((dayofyear({d}) - dayofweek({d}) + 7) / 7) as int)", 2),
        "V": pad(f"weekofyear({d})", 2), "G": pad(f"extract(YEAROFWEEK FROM {d})", 4), "g": pad(f"(extract(YEAROFWEEK FROM {d}) % 100)", 2), "%": "'%'",
    }
    fmt = fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").replace("%R", "%H:%M")
    parts, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            if (code := codes.get(fmt[i + 1 : i + 2])) is None:
                return "cast(null as string)"
            parts.append(code)
            i += 2
        else:
            j = fmt.find("%", i)
            j = len(fmt) if j < 0 else j
            parts.append("'" + fmt[i:j].replace("\\", "\\\\").replace("'", "\\'") + "'")
            i = j
    return _let(ms, "t", f"concat({', '.join(parts)})" if parts else "if(t is null, null, '')")
