"""JSON functions over text. Reading by constant paths stays in Spark's own VARIANT functions; edits, pretty
printing and error positions are Arrow-batched Python."""

from __future__ import annotations

import json as _json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(#(?:-[0-9]+)?|[0-9]+)\]""")


class PathError(ValueError):
    """A path that doesn't follow the grammar."""


def parse_path(path: str) -> list[str | int | None]:
    """Steps of $.a[0][#-1]."k": keys, places, negative places from the end, None for the place after the end."""
    if not path.startswith("$"):
        raise PathError(path)
    at, out = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise PathError(path)
        if m[3] is None:
            out.append(m[1] if m[1] is not None else m[2])
        else:
            out.append(None if m[3] == "#" else int(m[3][1:]) if m[3][0] == "#" else int(m[3]))
        at = m.end()
    return out


def arrow_path(key: str | int) -> str:
    """The path of the right operand of -> and ->>."""
    return f"$[{key}]" if isinstance(key, int) and key >= 0 else f"$[#{key}]" if isinstance(key, int) else key if key.startswith("$") else f'$."{key}"'


def _load(text: str):
    return _json.loads(text, object_pairs_hook=_Pairs)


class _Pairs(dict):
    """An object; of repeated keys the first counts for reading."""

    def __init__(self, pairs=()):
        super().__init__()
        for k, v in pairs:
            self.setdefault(k, v)


def _dump(value) -> str:
    return _json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_MISSING = object()


def _get(value, steps):
    for s in steps:
        if isinstance(s, str):
            if not isinstance(value, dict) or s not in value:
                return _MISSING
            value = value[s]
        else:
            if not isinstance(value, list) or s is None:
                return _MISSING
            i = s if s >= 0 else len(value) + s
            if not 0 <= i < len(value):
                return _MISSING
            value = value[i]
    return value


def _edit(value, steps, new, create: bool, overwrite: bool):
    """value with new at a path; missing parents are made where only the last step is missing, as objects or arrays."""
    if not steps:
        return new if overwrite else value
    s, rest = steps[0], steps[1:]
    if isinstance(s, str) and isinstance(value, dict):
        if s in value:
            return type(value)((k, _edit(v, rest, new, create, overwrite) if k == s else v) for k, v in value.items())
        if create and (made := _made(rest, new)) is not _MISSING:
            return _Pairs([*value.items(), (s, made)])
    elif not isinstance(s, str) and isinstance(value, list):
        i = len(value) if s is None else s if s >= 0 else len(value) + s
        if 0 <= i < len(value):
            return [*value[:i], _edit(value[i], rest, new, create, overwrite), *value[i + 1 :]]
        if create and i == len(value) and (made := _made(rest, new)) is not _MISSING:
            return [*value, made]
    return value


def _made(steps, new):
    if not steps:
        return new
    made = _made(steps[1:], new)
    if made is _MISSING:
        return made
    return _Pairs([(steps[0], made)]) if isinstance(steps[0], str) else [made] if steps[0] in (0, None) else _MISSING


def _remove(value, steps):
    s, rest = steps[0], steps[1:]
    if isinstance(s, str) and isinstance(value, dict) and s in value:
        return _Pairs((k, _remove(v, rest) if k == s else v) for k, v in value.items() if k != s or rest)
    if not isinstance(s, str) and isinstance(value, list) and s is not None:
        i = s if s >= 0 else len(value) + s
        if 0 <= i < len(value):
            return [*value[:i], *([_remove(value[i], rest)] if rest else []), *value[i + 1 :]]
    return value


def _patch(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = _Pairs(target.items() if isinstance(target, dict) else ())
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def _udf(f, returns: str = "string"):
    def safe(text, *args):
        if text is None:
            return None
        try:
            return f(_load(text), *args)
        except (ValueError, RecursionError):
            return None

    return F.udf(safe, returns, useArrow=True)


def _pairs_of(args: tuple) -> list[tuple[str, object]]:
    return list(zip(args[::2], args[1::2], strict=True))


def json(x: Column) -> Column:
    """Minified JSON; NULL where the text isn't JSON."""
    return _udf(_dump)(x)


def json_valid(x: str) -> Column:
    return F.expr(f"if({x} is null, null, if(try_parse_json({x}) is null and trim({x}) <> 'null', 0L, 1L))")


def json_type(x: str, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object."""
    v = f"try_variant_get(try_parse_json({x}), {_quoted(path)}, 'variant')"
    return F.expr(f"""case when schema_of_variant({v}) like 'OBJECT%' then 'object' when schema_of_variant({v}) like 'ARRAY%' then 'array'
        else case schema_of_variant({v}) when 'BIGINT' then 'integer' when 'STRING' then 'text' when 'BOOLEAN' then to_json({v}) when 'VOID' then 'null' when 'DOUBLE' then 'real'
        else if(schema_of_variant({v}) like 'DECIMAL%', 'real', null) end end""")


def _quoted(path: str) -> str:
    """A constant path in VARIANT's own grammar, as a literal; places from the end aren't known there."""
    out = "$"
    for s in parse_path(path):
        if isinstance(s, str):
            out += "['" + s.replace("'", "\\'") + "']"
        elif s is None or s < 0:
            raise PathError(path)
        else:
            out += f"[{s}]"
    return '"' + out + '"'


def from_end(path: str) -> bool:
    return any(s is None or (isinstance(s, int) and s < 0) for s in parse_path(path))


def json_extract(x: str, path: str, as_type: str = "string") -> Column:
    """The SQL value at a constant path, in the stated Spark type; objects and arrays as JSON text."""
    if not from_end(path):
        return F.expr(f"try_variant_get(try_parse_json({x}), {_quoted(path)}, '{as_type}')")
    steps = parse_path(path)

    def get(value):
        got = _get(value, steps)
        return None if got is _MISSING or got is None else _dump(got) if isinstance(got, dict | list) else str(int(got)) if isinstance(got, bool) else str(got)

    return _udf(get)(F.expr(x)).try_cast(as_type)


def json_arrow(x: str, path: str) -> Column:
    """x -> path: JSON text of what is there."""
    steps = parse_path(path)
    return F.expr(f"to_json(try_variant_get(try_parse_json({x}), {_quoted(path)}, 'variant'))") if not from_end(path) else _udf(lambda v: None if (g := _get(v, steps)) is _MISSING else _dump(g))(F.expr(x))


def json_array_length(x: str, path: str = "$") -> Column:
    """Elements of an array, 0 for other JSON, NULL without a value at the path."""
    v = f"to_json(try_variant_get(try_parse_json({x}), {_quoted(path)}, 'variant'))"
    return F.expr(f"case when {v} is null then null else coalesce(cast(json_array_length({v}) as bigint), 0L) end")


def _json_argument(kinds: list[str], args: tuple):
    return [_load(a) if k == "json" and a is not None else a for k, a in zip(kinds, args, strict=True)]


def json_array(*args: tuple[Column, str]) -> Column:
    """A JSON array of (value, kind) arguments; kind json means JSON text."""
    kinds = [k for _, k in args]
    return F.udf(lambda *a: _dump(_json_argument(kinds, a)), "string", useArrow=True)(*(c for c, _ in args))


def json_object(*pairs: tuple[str, Column, str]) -> Column:
    """A JSON object of (key, value, kind) arguments."""
    keys, kinds = [p[0] for p in pairs], [p[2] for p in pairs]
    return F.udf(lambda *a: _dump(dict(zip(keys, _json_argument(kinds, a), strict=True))), "string", useArrow=True)(*(p[1] for p in pairs))


def json_quote(x: str, kind: str) -> Column:
    from tessera.operators.aggregates import json_value

    return F.expr(json_value(x, kind))


def _editor(create: bool, overwrite: bool):
    def build(x: Column, *path_values) -> Column:
        """path, value, path, value, ...; values are constants."""
        steps = [(parse_path(p), v) for p, v in _pairs_of(path_values)]

        def f(value):
            for s, v in steps:
                value = _edit(value, s, v, create, overwrite)
            return _dump(value)

        return _udf(f)(x)

    return build


json_insert, json_replace, json_set = _editor(True, False), _editor(False, True), _editor(True, True)


def json_remove(x: Column, *paths: str) -> Column:
    steps = [parse_path(p) for p in paths]

    def f(value):
        for s in steps:
            if not s:
                return None
            value = _remove(value, s)
        return _dump(value)

    return _udf(f)(x)


def json_patch(x: Column, patch: Column) -> Column:
    """Merge patch: null members go, objects merge, all else replaces."""
    return _udf(lambda v, p: None if p is None else _dump(_patch(v, _load(p))))(x, patch)


def json_pretty(x: Column, indent: str = "    ") -> Column:
    def show(v, level=0):
        pad = "\n" + indent * (level + 1)
        if isinstance(v, dict) and v:
            return "{" + ",".join(f"{pad}{_dump(k)}: {show(w, level + 1)}" for k, w in v.items()) + "\n" + indent * level + "}"
        if isinstance(v, list) and v:
            return "[" + ",".join(pad + show(w, level + 1) for w in v) + "\n" + indent * level + "]"
        return _dump(v)

    return _udf(show)(x)


def json_error_position(x: Column) -> Column:
    """0 for JSON, else the 1-based place of the first error."""

    def f(text):
        if text is None:
            return None
        try:
            _json.loads(text)
        except _json.JSONDecodeError as e:
            return e.pos + 1
        return 0

    return F.udf(f, "long", useArrow=True)(x)
