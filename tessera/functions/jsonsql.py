"""The JSON functions of SQL text with any path and value, as one Arrow-batched function over texts.

Arguments come as texts with their class's letter in front: i integer, r real, t text, j JSON text, a a value
of JSON whose class is known only at run time. Reading by one constant path doesn't come here: Spark's VARIANT
functions do that. Numbers keep the digits they were written with.
"""

from __future__ import annotations

import json as _json
import re

from tessera.functions.json import _MISSING, PathError, _edit, _get, _Pairs, _patch, _remove, arrow_path, parse_path


class _Real(float):
    """A real number that is shown as it was written."""

    text: str

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


class Malformed(ValueError):
    """Text that isn't JSON."""


def load(text: str):
    """The value of JSON or JSON5 text."""
    try:
        return _json.loads(text, object_pairs_hook=_Pairs, parse_float=_Real, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return _Json5(text).whole()


def _refuse(word: str):
    raise Malformed(word)


class _Json5:
    """A reader of JSON5: comments, single quotes, bare keys, commas at the end, signs, points at the ends of numbers, hexadecimal."""

    SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r]*|/\*.*?\*/)*", re.S)
    NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
    KEY = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][A-Za-z0-9_$\u0080-\U0010ffff]*")
    STRING = re.compile(r"'((?:[^'\\\n]|\\.)*)'|\"((?:[^\"\\\n]|\\.)*)\"", re.S)
    ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
    LETTERS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}
    WORDS = (("null", None), ("true", True), ("false", False), ("+Infinity", _Real("9e999")), ("-Infinity", _Real("-9e999")), ("Infinity", _Real("9e999")), ("NaN", None), ("nan", None))

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def whole(self):
        try:
            v = self.value()
        except (IndexError, RecursionError) as e:
            raise Malformed("malformed JSON") from e
        self.space()
        if self.i < len(self.s):
            raise Malformed("malformed JSON")
        return v

    def space(self) -> None:
        self.i = self.SPACE.match(self.s, self.i).end()

    def match(self, pattern: re.Pattern):
        if m := pattern.match(self.s, self.i):
            self.i = m.end()
        return m

    def accept(self, c: str) -> bool:
        self.space()
        if self.s.startswith(c, self.i):
            self.i += len(c)
            return True
        return False

    def string(self) -> str | None:
        if not (m := self.match(self.STRING)):
            return None
        body = m[1] if m[1] is not None else m[2]
        return self.ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else self.LETTERS.get(e[3], e[3]), body)

    def items(self, end: str, one):
        while not self.accept(end):
            yield one()
            if not self.accept(","):
                if not self.accept(end):
                    raise Malformed("malformed JSON")
                return

    def member(self):
        self.space()
        if (k := self.string()) is None:
            if not (m := self.match(self.KEY)):
                raise Malformed("malformed JSON")
            k = m[0]
        if not self.accept(":"):
            raise Malformed("malformed JSON")
        return k, self.value()

    def value(self):
        if self.accept("{"):
            return _Pairs(list(self.items("}", self.member)))
        if self.accept("["):
            return list(self.items("]", self.value))
        if (text := self.string()) is not None:
            return text
        for word, v in self.WORDS:
            if self.accept(word):
                return v
        if m := self.match(self.NUMBER):
            n = m[0]
            if "x" in n.lower():
                return int(n, 16)
            if re.fullmatch("[+-]?[0-9]+", n):
                return int(n)
            whole, point, rest = re.fullmatch(r"([+-]?[0-9]*)(\.?)(.*)", n).groups()
            digits = re.match("[0-9]*", rest)[0]
            return _Real((whole.lstrip("+") if whole.strip("+-") else whole.lstrip("+") + "0") + (f".{digits or '0'}" if point else "") + rest[len(digits) :])
        raise Malformed("malformed JSON")


def dump(v, pad: str | None = None, level: int = 0) -> str:
    """JSON text; with `pad` one item a line."""
    if isinstance(v, dict | list) and v:
        line, end = ("\n" + pad * (level + 1), "\n" + pad * level) if pad is not None else ("", "")
        colon = ":" if pad is None else ": "
        items = [f"{dump(k)}{colon}{dump(w, pad, level + 1)}" for k, w in v.items()] if isinstance(v, dict) else [dump(w, pad, level + 1) for w in v]
        return ("{" if isinstance(v, dict) else "[") + ",".join(line + i for i in items) + end + ("}" if isinstance(v, dict) else "]")
    return v.text if isinstance(v, _Real) else _json.dumps(v, ensure_ascii=False)


def kind(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return next(name for t, name in ((type(None), "null"), (int, "integer"), (float, "real"), (str, "text"), (list, "array"), (dict, "object")) if isinstance(v, t))


def _value(arg: str | None):
    """The JSON value of a lettered SQL argument."""
    if arg is None:
        return None
    letter, text = arg[0], arg[1:]
    return int(text) if letter == "i" else _Real(text) if letter == "r" else load(text) if letter == "j" else text


def _shown(v) -> str | None:
    """The SQL value of a JSON value, as text."""
    if v is None or v is _MISSING:
        return None
    return str(int(v)) if isinstance(v, bool) else dump(v) if isinstance(v, dict | list) else v.text if isinstance(v, _Real) else str(v)


def _steps(path: str | None):
    return None if path is None else parse_path(path)


def _change(create: bool, overwrite: bool):
    def run(doc, rest):
        for path, new in zip(rest[::2], rest[1::2], strict=True):
            if path is None:
                return None
            doc = _edit(doc, parse_path(path[1:]), _value(new), create, overwrite)
        return dump(doc)

    return run


def _insert_into(doc, rest):
    """A new element before the place in an array that a path names, or at its end."""
    for path, new in zip(rest[::2], rest[1::2], strict=True):
        if path is None:
            return None
        *parent, last = parse_path(path[1:])
        if isinstance(last, str):
            raise PathError(path[1:])
        into = _get(doc, parent)
        if isinstance(into, list):
            at = len(into) if last is None else last if last >= 0 else len(into) + last
            if 0 <= at <= len(into):
                doc = _edit(doc, parent, [*into[:at], _value(new), *into[at:]], False, True)
    return dump(doc)


def _take_out(doc, rest):
    for path in rest:
        if path is None or not (steps := parse_path(path[1:])):
            return None
        doc = _remove(doc, steps)
    return dump(doc)


def _extract(doc, rest):
    if any(p is None for p in rest):
        return None
    got = [_get(doc, parse_path(p[1:])) for p in rest]
    return _shown(got[0]) if len(got) == 1 else dump([None if g is _MISSING else g for g in got])


def _at(doc, rest):
    """The value at the right operand of an arrow."""
    if rest[0] is None:
        return _MISSING
    return _get(doc, parse_path(arrow_path(int(rest[0][1:]) if rest[0][0] == "i" else rest[0][1:])))


def _length(doc, rest):
    v = _get(doc, _steps(rest[0][1:]) if rest and rest[0] else [])
    return None if v is _MISSING else str(len(v) if isinstance(v, list) else 0)


def _type(doc, rest):
    v = _get(doc, _steps(rest[0][1:]) if rest and rest[0] else [])
    return None if v is _MISSING else kind(v)


#: Functions of a document and further lettered arguments.
OF_DOCUMENT = {
    "json": lambda doc, rest: dump(doc), "json_set": _change(True, True), "json_insert": _change(True, False), "json_replace": _change(False, True),
    "json_array_insert": _insert_into, "json_remove": _take_out, "json_extract": _extract, "json_type": _type, "json_array_length": _length,
    "json_patch": lambda doc, rest: None if rest[0] is None else dump(_patch(doc, load(rest[0][1:]))),
    "json_pretty": lambda doc, rest: dump(doc, rest[0][1:] if rest and rest[0] else "    "),
    "->": lambda doc, rest: None if (v := _at(doc, rest)) is _MISSING else dump(v), "->>": lambda doc, rest: _shown(_at(doc, rest)),
}


def call(name: str, args: list[str | None]) -> str | None:
    """A JSON function of lettered arguments; a null document gives null, malformed JSON and paths are errors."""
    if name == "json_array":
        return dump([_value(a) for a in args])
    if name == "json_object":
        if any(k is None or k[0] != "t" for k in args[::2]):
            raise ValueError("json_object() labels must be TEXT")
        return dump(_Pairs((k[1:], _value(v)) for k, v in zip(args[::2], args[1::2], strict=True)))
    if name == "json_quote":
        return dump(_value(args[0]))
    if args[0] is None:
        return None
    if name == "json_error_position":
        try:
            _json.loads(args[0][1:])
        except _json.JSONDecodeError as e:
            try:
                load(args[0][1:])
            except ValueError:
                return str(e.pos + 1)
        return "0"
    return OF_DOCUMENT[name](load(args[0][1:]), args[1:])


NAMES = {*OF_DOCUMENT, "json_array", "json_object", "json_quote", "json_error_position"} - {"->", "->>"}
#: Those whose result is JSON, and those whose result is a whole number.
JSON_VALUED = NAMES - {"json_extract", "json_type", "json_array_length", "json_error_position", "json_pretty"}
WHOLE = {"json_array_length", "json_error_position"}
