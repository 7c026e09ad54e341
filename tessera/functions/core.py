"""Arithmetic, comparison, text, pattern and mathematical functions.

Every function takes SQL fragments and returns one. Arguments that are used more than once should be columns
or literals. The rules are total: no input raises; what has no value is NULL.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMBER = r"^[\\t\\n\\x0B\\f\\r ]*([+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def text_literal(s: str) -> str:
    """A Spark string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# --- numbers -----------------------------------------------------------------------------------------


def number(x: str) -> str:
    """The numeric prefix of a text as a double, else 0; NULL stays."""
    return f"case when {x} is not null then coalesce(try_cast(regexp_extract({x}, '{_NUMBER}', 1) as double), 0D) end"


def truth(x: str) -> str:
    """Truth of a number: not 0."""
    return f"({x} <> 0)"


def int_div(a: str, b: str) -> str:
    """Integer quotient, cut towards 0; by 0 it is NULL."""
    return f"case when {b} <> 0 then {a} div {b} end"


def real_div(a: str, b: str) -> str:
    return f"try_divide(cast({a} as double), cast({b} as double))"


def int_mod(a: str, b: str) -> str:
    """Remainder with the sign of the dividend; by 0 it is NULL."""
    return f"try_mod(cast({a} as bigint), cast({b} as bigint))"


def int_op(a: str, op: str, b: str) -> str:
    """a + b, a - b or a * b over integers; on overflow the real result."""
    name = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}[op]
    return f"coalesce(cast({name}(cast({a} as bigint), cast({b} as bigint)) as double), cast({a} as double) {op} cast({b} as double))"


def shift(a: str, b: str, left: bool) -> str:
    """Shifts by any amount: a negative one goes the other way, 64 or more empties or fills with the sign."""
    n = f"cast(least(abs({b}), 64) as int)"
    goes_left = f"({b} >= 0)" if left else f"({b} < 0)"
    return f"case when {a} is null or {b} is null then null when {goes_left} then if({n} >= 64, 0L, shiftleft({a}, {n})) else if({n} >= 64, if({a} < 0, -1L, 0L), shiftright({a}, {n})) end"


def finite(x: str) -> str:
    """NaN is NULL."""
    return f"nullif({x}, double('NaN'))"


def least(*args: str) -> str:
    """Scalar minimum; NULL if any argument is."""
    return f"case when {' or '.join(f'({a}) is null' for a in args)} then null else least({', '.join(args)}) end"


def greatest(*args: str) -> str:
    return f"case when {' or '.join(f'({a}) is null' for a in args)} then null else greatest({', '.join(args)}) end"


def round_to(x: str, n: int = 0) -> str:
    """Half away from zero on the decimal digits, always a double; negative digits count as 0."""
    return f"cast(round(cast({x} as double), {min(max(n, 0), 30)}) as double)"


def sign(x: str) -> str:
    return f"cast(signum({x}) as bigint)"


def ceil(x: str, real: bool) -> str:
    return f"cast(ceil({x}) as double)" if real else x


def floor(x: str, real: bool) -> str:
    return f"cast(floor({x}) as double)" if real else x


def trunc(x: str, real: bool) -> str:
    return f"(cast(sign({x}) * floor(abs({x})) as double))" if real else x


def log(x: str, base: str | None = None) -> str:
    """Base 10, or of the base given first."""
    return finite(f"log10({x})") if base is None else finite(f"(ln({x}) / nullif(ln({base}), 0))")


def power(x: str, y: str) -> str:
    return finite(f"pow({x}, {y})")


def sqrt(x: str) -> str:
    return finite(f"sqrt({x})")


def unary_math(name: str, x: str) -> str:
    """acos asin atan acosh asinh atanh sin cos tan sinh cosh tanh degrees radians exp ln log2 log10; NaN is NULL."""
    return finite(f"{name}(cast({x} as double))")


def fmod(x: str, y: str) -> str:
    return f"try_mod(cast({x} as double), cast({y} as double))"


# --- text --------------------------------------------------------------------------------------------


def real_text(x: str) -> str:
    """A double as text: plain digits from 1e-4 up to 1e17, else an exponent of two digits at least."""
    s = f"cast({x} as string)"
    mantissa, power = f"substring_index({s}, 'E', 1)", f"try_cast(substring_index({s}, 'E', -1) as int)"
    whole = f"regexp_replace(cast(try_cast({s} as decimal(38, 18)) as string), '([.][0-9]+?)0*$', '$1')"
    small = f"concat(if({x} < 0, '-0.000', '0.000'), regexp_replace(translate({mantissa}, '-.', ''), '0+$', ''))"
    far = f"concat({mantissa}, if({power} < 0, 'e-', 'e+'), if(abs({power}) < 10, '0', ''), cast(abs({power}) as string))"
    return (
        f"case when abs({x}) >= 0.001D and abs({x}) < 10000000D then {s} when {x} = 0 then '0.0' when abs({x}) = double('Infinity') then if({x} > 0, 'Inf', '-Inf')"
        f" when {power} between 0 and 16 then {whole} when {power} = -4 then {small} when {power} is not null then {far} end"
    )


def lower(x: str) -> str:
    """Only A-Z change."""
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def upper(x: str) -> str:
    return f"translate({x}, '{_LOWER}', '{_UPPER}')"


def nocase(x: str) -> str:
    """Key of the collation that ignores the case of ASCII letters."""
    return lower(x)


def rtrim_key(x: str) -> str:
    """Key of the collation that ignores spaces at the end."""
    return f"rtrim({x})"


def length(x: str) -> str:
    """Characters up to the first NUL."""
    return f"cast(length(substring_index({x}, '\\u0000', 1)) as bigint)"


def substr(x: str, y: str, z: str | None = None) -> str:
    """The characters at 1-based places first <= place < stop, as far as the text has them.

    A negative y is a place counted from the end. z places follow y, or stand before it where z is negative.
    """
    first = f"if({y} < 0, length({x}) + 1 + {y}, {y})"
    stop = f"length({x}) + 1" if z is None else f"{first} + {z}"
    low, high = (first, stop) if z is None else (f"least({first}, {stop})", f"greatest({first}, {stop})")
    begin = f"greatest({low}, 1)"
    return f"if({x} is null or {y} is null{'' if z is None else f' or {z} is null'}, null, substring({x}, cast({begin} as int), cast(greatest({high} - {begin}, 0) as int)))"


def replace(x: str, p: str, r: str) -> str:
    return f"replace({x}, {p}, {r})"


def trim(x: str, chars: str = "' '", side: str = "BOTH") -> str:
    return f"trim({side} {chars} FROM {x})"


def instr(x: str, y: str) -> str:
    return f"cast(instr({x}, {y}) as bigint)"


def concat(*args: str) -> str:
    """NULLs are skipped."""
    return f"concat_ws('', {', '.join(f'cast({a} as string)' for a in args)})"


def concat_ws(sep: str, *args: str) -> str:
    return f"concat_ws({sep}, {', '.join(f'cast({a} as string)' for a in args)})"


def char(*codes: str) -> str:
    """Characters of code points; what is none becomes U+FFFD."""
    one = lambda n: f"decode(unhex(lpad(hex(if({n} between 0 and 1114111 and not {n} between 55296 and 57343, {n}, 65533)), 8, '0')), 'UTF-32')"
    return f"concat({', '.join(map(one, codes))})"


def unicode(x: str) -> str:
    """First code point; none for an empty text."""
    return f"case when {x} <> '' then cast(conv(hex(encode(substring({x}, 1, 1), 'UTF-32')), 16, 10) as bigint) end"


def hex_text(x: str) -> str:
    """Hexadecimal of the UTF-8 bytes of the text of x; NULL gives the empty text."""
    return f"coalesce(hex(cast({x} as string)), '')"


def unhex(x: str, ignore: str | None = None) -> str:
    """Bytes; NULL where digits are odd in number or invalid."""
    x = x if ignore is None else f"translate({x}, {ignore}, '')"
    return f"case when length({x}) % 2 = 0 and {x} rlike '^[0-9A-Fa-f]*$' then unhex({x}) end"


def zeroblob(n: str) -> str:
    return f"unhex(repeat('00', cast(greatest({n}, 0) as int)))"


def octet_length(x: str) -> str:
    return f"cast(octet_length({x}) as bigint)"


def quote(x: str, kind: str) -> str:
    """SQL literal of a value; kind: text, number or blob."""
    body = {"text": f"concat('''', replace({x}, '''', ''''''), '''')", "number": f"cast({x} as string)", "blob": f"concat('X''', hex({x}), '''')"}[kind]
    return f"case when {x} is null then 'NULL' else {body} end"


def typeof(x: str, spark_type: str) -> str:
    """null, integer, real, text or blob, from the static type."""
    t = spark_type.lower()
    name = "integer" if t in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if t in ("float", "double") or t.startswith("decimal") else "blob" if t == "binary" else "text"
    return f"if({x} is null, 'null', '{name}')"


def iif(*args: str) -> str:
    """iif(c, v, c2, v2, ..., else)."""
    pairs, rest = list(zip(args[::2], args[1::2], strict=False)), args[-1] if len(args) % 2 else "null"
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {rest} end"


# --- patterns ----------------------------------------------------------------------------------------


def like(x: str, pattern: str, escape: str | None = None) -> str:
    """ASCII letters match either case; without an escape character none is special."""
    esc = "'\\u0001'" if escape is None else escape
    return f"({lower(x)} like {lower(pattern)} escape {esc})"


def _set(chars: str) -> str:
    """The inside of a character class; a range that runs backwards has no characters."""
    plain = lambda c: "\\" + c if c in "\\[]^&-~|" else c
    out, i = "", 0
    while i < len(chars):
        if chars[i + 1 : i + 2] == "-" and i + 2 < len(chars):
            out += f"{plain(chars[i])}-{plain(chars[i + 2])}" if chars[i] <= chars[i + 2] else ""
            i += 3
        else:
            out += plain(chars[i])
            i += 1
    return out


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob pattern: * ? [set] [^set]; case counts."""
    out, i = ["(?s)\\A"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] == "^"
            j += negated
            end = pattern.find("]", j + 1)
            if end < 0:
                return "(?!)"  # an open set matches nothing
            body = _set(pattern[j:end])
            out.append(f"[{'^' if negated else ''}{body}]" if body else "." if negated else "(?!)")
            i = end
        else:
            out.append("\\" + c if c in "\\^$.|+(){}[]" else c)
        i += 1
    return "".join(out) + "\\z"


def glob(x: str, pattern: str) -> str:
    """x GLOB a constant pattern."""
    return f"({x} rlike {text_literal(glob_regex(pattern))})"


# --- casts -------------------------------------------------------------------------------------------


def affinity(declared: str | None) -> str:
    """INTEGER, TEXT, BLOB, REAL or NUMERIC of a declared type."""
    t = (declared or "").upper()
    if "INT" in t:
        return "INTEGER"
    if any(k in t for k in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if "BLOB" in t or not t:
        return "BLOB"
    return "REAL" if any(k in t for k in ("REAL", "FLOA", "DOUB")) else "NUMERIC"


SPARK_TYPE = {"INTEGER": "bigint", "TEXT": "string", "BLOB": "binary", "REAL": "double", "NUMERIC": "double"}


def cast(x: str, declared: str, from_text: bool, real: bool = False) -> str:
    """CAST by affinity; from text the numeric prefix counts, whole for REAL, its integer digits for INTEGER; real: x is a double."""
    to = affinity(declared)
    if to == "TEXT":
        return real_text(x) if real else f"cast({x} as string)"
    if to == "BLOB":
        return f"cast({real_text(x) if real else f'cast({x} as string)'} as binary)"
    if to == "INTEGER":
        if from_text:
            digits = f"regexp_extract({x}, '^[\\\\t\\\\n\\\\x0B\\\\f\\\\r ]*([+-]?[0-9]+)', 1)"
            big = f"if({digits} like '-%', -9223372036854775808L, 9223372036854775807L)"
            return f"case when {x} is null then null when {digits} = '' then 0L else coalesce(try_cast({digits} as bigint), {big}) end"
        whole = f"(sign({x}) * floor(abs({x})))"
        return f"case when {x} >= 9.223372036854775807E18D then 9223372036854775807L when {x} <= -9.223372036854775808E18D then -9223372036854775808L else cast({whole} as bigint) end"
    return number(x) if from_text else f"cast({x} as double)"
