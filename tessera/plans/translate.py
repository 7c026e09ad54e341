"""From parsed queries to Spark SQL text, with the dialect's rules written out.

Each expression becomes a fragment with a storage class (int, real, text, blob, bool, json or None) that is
inferred from column types, so that rules which depend on it are settled when the plan is made.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.functions import core as c
from tessera.functions import dates as d
from tessera.functions import jsonsql
from tessera.functions.json import _quoted, arrow_path, from_end
from tessera.plans.dialect import SqlError

AGGREGATES = {"count", "sum", "avg", "total", "group_concat", "string_agg", "json_group_array", "json_group_object"}
RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
MATH = {"acos", "asin", "atan", "acosh", "asinh", "atanh", "sin", "cos", "tan", "sinh", "cosh", "tanh", "degrees", "radians", "exp", "ln", "log2", "log10"}
CLASS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "boolean": "bool", "float": "real", "double": "real", "string": "text", "binary": "blob"}


class Collated(str):
    """The class of a text column with a collation of its own."""

    collation = "UTF8_BINARY"


def storage_class(spark_type: str) -> str | None:
    if spark_type.startswith("string collate "):
        kind = Collated("text")
        kind.collation = spark_type.split()[-1]
        return kind
    if spark_type.startswith("string"):
        return "text"
    return "real" if spark_type.startswith("decimal") else CLASS.get(spark_type, "time" if spark_type.startswith(("date", "timestamp")) else None)


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


ROWID = ("rowid", "oid", "_rowid_")


@dataclass
class Scope:
    """Sources in order: alias, and columns with their classes; names that USING merges come once."""

    sources: list[tuple[str, list[tuple[str, str | None]]]] = field(default_factory=list)
    merged: set[str] = field(default_factory=set)
    aliases: dict[str, tuple] = field(default_factory=dict)
    windows: dict[str, dict] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)  # of sources with a whole-number key: that column is the row's id
    hidden: set[str] = field(default_factory=set)  # sources whose columns need their name in front
    outer: Scope | None = None

    def find(self, qualifier: str | None, name: str) -> tuple[str, str | None] | None:
        hits = [(a, n, k) for a, cols in self.sources if (a not in self.hidden if qualifier is None else a.lower() == qualifier.lower()) for n, k in cols if n.lower() == name.lower()]
        if not hits and name.lower() in ROWID:
            keys = [(a, self.keys[a.lower()]) for a, _ in self.sources if a.lower() in self.keys and (qualifier is None or a.lower() == qualifier.lower())]
            return (f"{ident(keys[0][0])}.{ident(keys[0][1])}", "int") if keys else None
        if not hits:
            return None
        if qualifier is None and name.lower() in self.merged:
            return ident(hits[0][1]), hits[0][2]
        if len(hits) > 1:
            raise SqlError(f"ambiguous column name: {name}")
        return f"{ident(hits[0][0])}.{ident(hits[0][1])}", hits[0][2]


class Translator:
    """lookup(name) gives a table's Spark name and its (column, class) pairs; counter(name) what changes(), total_changes() and last_insert_rowid() are."""

    def __init__(self, lookup: Callable[[str], tuple[str, list[tuple[str, str | None]]] | None], counter: Callable[[str], int] | None = None):
        self.lookup, self.counter = lookup, counter
        self.ctes: list[dict[str, list[tuple[str, str | None]]]] = []
        self.groups: list[str] = []  # numbers of peer groups that the present select needs
        self.n = 0
        self.collated = False  # some table of the query has a text column with a collation

    # --- queries: text and (name, class) pairs

    def query(self, q: dict, outer: Scope | None = None) -> tuple[str, list[tuple[str, str | None]]]:
        head = ""
        self.ctes.append({})
        try:
            parts = []
            for name, cols, sub in q.get("ctes") or []:
                if q.get("recursive") and sub["kind"] == "compound":
                    first, own = self.query(sub["left"] | {"order": None, "limit": None, "offset": None}, outer)
                    own = [(n, k) for n, (_, k) in zip(cols or [n for n, _ in own], own, strict=True)]
                    self.ctes[-1][name.lower()] = own
                text, out = self.query(sub, outer)
                out = [(n, k) for n, (_, k) in zip(cols or [n for n, _ in out], out, strict=True)]
                self.ctes[-1][name.lower()] = out
                parts.append(f"{ident(name)}({', '.join(ident(n) for n, _ in out)}) AS ({text})")
            if parts:
                head = f"WITH {'RECURSIVE ' if q.get('recursive') else ''}{', '.join(parts)} "
            body, out, order_scope = self._body(q, outer)
            return head + body + self._tail(q, out, order_scope), out
        finally:
            self.ctes.pop()

    def _body(self, q: dict, outer: Scope | None):
        if q["kind"] == "values":
            rows = [[self.expr(x, Scope(outer=outer)) for x in r] for r in q["rows"]]
            kinds = [next((k for k in (r[i][1] for r in rows) if k), None) for i in range(len(rows[0]))]
            mixed = False
            for i, kind in enumerate(kinds):
                if len({k in ("text", "json", "any") for k in (r[i][1] for r in rows) if k and k != "blob"}) > 1:  # columns have one type
                    kinds[i], mixed = "text", True
                    for r in rows:
                        r[i] = (self._text(*r[i]), "text") if r[i][1] else r[i]
                elif kind == "int" and any(r[i][1] == "real" for r in rows):
                    kinds[i] = "real"
            out = [(f"column{i + 1}", k) for i, k in enumerate(kinds)]
            if mixed:  # what makes texts of numbers isn't allowed in an inline table
                return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {', '.join(f'{t} AS {ident(n)}' for (t, _), (n, _) in zip(r, out, strict=True))}" for r in rows) + ")", out, None
            return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(t for t, _ in r) + ')' for r in rows)}) AS v({', '.join(ident(n) for n, _ in out)})", out, None
        if q["kind"] == "compound":
            left, out, _ = self._body(q["left"], outer)
            right, other, _ = self._body(q["right"], outer)
            if len(out) != len(other):
                raise SqlError("SELECTs to the left and right do not have the same number of result columns")
            if self.collated:  # the left side's collations hold
                left, right = (self._collate(text, own, out) for text, own in ((left, out), (right, other)))
            # operators bind from left to right, so the left side is in parentheses
            return f"({left}) {q['op'].replace('EXCEPT', 'EXCEPT DISTINCT').replace('INTERSECT', 'INTERSECT DISTINCT')} ({right})", out, None
        return self._select(q, outer)

    @staticmethod
    def _collate(text: str, own: list, out: list) -> str:
        """A query whose text columns have the collations of other columns."""
        items = (f"collate({ident(n)}, '{getattr(to, 'collation', 'UTF8_BINARY')}') AS {ident(n)}" if k == "text" else ident(n) for (n, k), (_, to) in zip(own, out, strict=True))
        return f"SELECT {', '.join(items)} FROM ({text})"

    def _tail(self, q: dict, out: list, scope: Scope | None) -> str:
        text = ""
        if q.get("order"):
            names = {n.lower() for n, _ in out}
            parts = []
            for x, desc, nulls in q["order"]:
                if x[0] == "lit" and x[2] == "int":
                    if not 1 <= x[1] <= len(out):
                        raise SqlError("ORDER BY term out of range")
                    e = ident(out[x[1] - 1][0])
                elif x[0] == "col" and x[1] is None and x[2].lower() in names:
                    e = ident(x[2])
                elif x[0] == "collate" and x[1][0] == "col" and x[1][2].lower() in names:
                    e = c.nocase(ident(x[1][2])) if x[2] == "NOCASE" else c.rtrim_key(ident(x[1][2])) if x[2] == "RTRIM" else ident(x[1][2])
                elif scope is None:
                    raise SqlError("ORDER BY term does not match any column in the result set")
                else:
                    e = self.key(x, scope)
                own = out[x[1] - 1][1] if x[0] == "lit" and x[2] == "int" else next((k for n, k in out if n.lower() == x[2].lower()), None) if x[0] == "col" and x[1] is None and x[2].lower() in names else self.expr(x, scope)[1] if scope is not None and x[0] != "collate" and not _has_aggregate(x) else None
                if own == "any":
                    if nulls:
                        parts.append(f"{e} IS NULL{' DESC' if nulls == 'FIRST' else ''}")
                    parts.append(f"{_order_of(e)}{' DESC' if desc else ''}")
                    continue
                parts.append(f"{e}{' DESC' if desc else ''}{f' NULLS {nulls}' if nulls else ''}")
            text += " ORDER BY " + ", ".join(parts)
        limit, offset = (self._count(q.get(k)) for k in ("limit", "offset"))
        if limit is not None and limit >= 0:
            text += f" LIMIT {limit}"
        if offset and offset > 0:
            text += f" OFFSET {offset}"
        return text

    def _count(self, x) -> int | None:
        """The value of a constant LIMIT or OFFSET."""
        if x is None:
            return None
        if x[0] == "un" and x[1] == "-":
            return -self._count(x[2])
        if x[0] == "bin" and x[1] in "+-*":
            a, b = self._count(x[2]), self._count(x[3])
            return {"+": a + b, "-": a - b, "*": a * b}[x[1]]
        if x[0] != "lit" or not isinstance(x[1], int):
            raise SqlError("datatype mismatch")
        return x[1]

    def _select(self, q: dict, outer: Scope | None):
        scope = Scope(outer=outer, windows=q["windows"])
        source = self._from(q["from"], scope) if q["from"] else ""
        items = []
        for x, name in q["items"]:
            if x[0] == "star":
                hit = False
                for a, cols in scope.sources:
                    if x[1] is None and a not in scope.hidden or x[1] is not None and a.lower() == x[1].lower():
                        hit = True
                        for n, _ in cols:
                            if x[1] is None and n.lower() in scope.merged and any(m.lower() == n.lower() for _, m in items):
                                continue
                            items.append((("col", None if n.lower() in scope.merged else a, n), n))
                if not hit:
                    raise SqlError("no tables specified" if x[1] is None else f"no such table: {x[1]}")
            else:
                items.append((x, name))
        for x, name in items:
            scope.aliases.setdefault(name.lower(), x)
        where = f" WHERE {self._where(q['where'], scope)}" if q["where"] else ""
        group, grouped = "", None
        if q["group"] is not None:
            keys = []
            for g in q["group"]:
                if g[0] == "lit" and g[2] == "int":
                    g = items[g[1] - 1][0]
                elif g[0] == "col" and g[1] is None and not scope.find(None, g[2]) and g[2].lower() in scope.aliases:
                    g = scope.aliases[g[2].lower()]
                keys.append(g)
            grouped = {self.key(g, scope): g for g in keys}
            group = " GROUP BY " + ", ".join(grouped)
        elif any(_has_aggregate(x) for x, _ in items) or q["having"] and _has_aggregate(q["having"]):
            grouped = {}
        if q["having"] and grouped is None:
            raise SqlError("HAVING clause on a non-aggregate query")
        bare = None
        if grouped is not None:
            # columns outside aggregates come from the row of a lone minimum or maximum, else from any row
            ends = [a for x, _ in items for a in _calls(x) if a[1] in ("min", "max") and len(a[2]) == 1 and a[5] is None]
            lone = ends[0] if len(ends) == 1 else None
            # a group whose values are all NULL has no extreme, so that any row will do
            bare = (grouped, f"coalesce({lone[1]}_by(struct({{0}} AS v), {self.expr(lone[2][0], scope)[0]}), first(struct({{0}} AS v))).v" if lone else "first({0})")
        texts, out, used = [], [], {}
        outer_groups, self.groups = self.groups, []
        for x, name in items:
            e, k = self.expr(x, scope, bare)
            if k == "bool":
                e, k = f"cast({e} as bigint)", "int"
            n = used.get(name.lower(), 0)
            used[name.lower()] = n + 1
            name = f"{name}:{n}" if n else name
            texts.append(f"{e} AS {ident(name)}")
            out.append((name, k))
        having = f" HAVING {self.truth(q['having'], scope, bare)}" if q["having"] else ""
        numbers, self.groups = self.groups, outer_groups
        if numbers:
            if len(scope.sources) != 1 or grouped is not None:
                raise SqlError("GROUPS frames need one table and no grouping")
            # the peer groups are numbered below, so that frames can range over the numbers
            alias = ident(scope.sources[0][0])
            source, where = f"(SELECT {alias}.*, {', '.join(f'{e} AS `_group_{i}`' for i, e in enumerate(numbers, 1))} FROM {source}{where}) AS {alias}", ""
        return f"SELECT {'DISTINCT ' if q['distinct'] else ''}{', '.join(texts)}{' FROM ' + source if source else ''}{where}{group}{having}", out, scope

    def _from(self, sources: list, scope: Scope) -> str:
        text = ""
        for kind, what, alias, how, on in sources:
            nested_merged: set[str] = set()
            if kind == "table":
                cte = next((level[what.lower()] for level in reversed(self.ctes) if what.lower() in level), None)
                if cte is not None:
                    name, cols = ident(what), cte
                else:
                    found = self.lookup(what)
                    if found is None:
                        raise SqlError(f"no such table: {what}")
                    name, cols = found
                    if (key := getattr(self.lookup, "rowid", lambda _: None)(what)) is not None:
                        scope.keys[(alias or what).lower()] = key
                alias = alias or what
                piece, own = f"{name} AS {ident(alias)}", [(alias, cols)]
            elif kind == "fired":  # a trigger's rows: NEW and OLD are structs of one source
                piece, own = what
                scope.hidden |= {a for a, _ in own}
            elif kind == "query":
                sub, cols = self.query(what, scope.outer)
                self.n += 1
                alias = alias or f"subquery_{self.n}"
                piece, own = f"({sub}) AS {ident(alias)}", [(alias, cols)]
            elif kind == "nested":
                inner = Scope(outer=scope.outer)
                piece = f"({self._from(what, inner)})"
                own, nested_merged = inner.sources, inner.merged
            else:
                name, args = what
                piece, cols = self._table_function(name, args, scope)
                piece, own = f"{piece} AS {ident(alias)}", [(alias, cols)]
            self.collated |= any(isinstance(k, Collated) for _, columns in own for _, k in columns)
            before = Scope(sources=list(scope.sources))
            scope.sources.extend(own)
            scope.merged |= nested_merged
            if not text:
                text = piece
                continue
            joined = {"comma": "CROSS JOIN", "inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}[how]
            if on and on[0] == "natural":
                have = {n.lower() for _, cols in before.sources for n, _ in cols}
                on = ("using", [n for _, cols in own for n, _ in cols if n.lower() in have])
            if on and on[0] == "using" and on[1]:
                scope.merged |= {n.lower() for n in on[1]}
                text += f" {joined.replace('CROSS ', '')} {piece} USING ({', '.join(map(ident, on[1]))})"
            elif on and on[0] == "on":
                if how in ("left", "right", "full"):
                    later = {(a or w).lower() for k, w, a, _, _ in sources[sources.index((kind, what, alias, how, on)) + 1 :] if k == "table"} - {a.lower() for a, _ in scope.sources} if (kind, what, alias, how, on) in sources else set()
                    if any(q and q.lower() in later for q in _qualifiers(on[1])):
                        raise SqlError("ON clause references tables to its right")
                text += f" {joined.replace('CROSS ', '')} {piece} ON {self._where(on[1], scope)}"
            else:
                text += f" {'CROSS JOIN' if how in ('comma', 'inner') else joined} {piece}{'' if how in ('comma', 'inner') else ' ON true'}"
        return text

    def _table_function(self, name: str, args: list, scope: Scope):
        name = name.replace("jsonb_", "json_")
        if name in ("json_each", "json_tree"):
            texts = [self.expr(a, scope)[0] for a in args] + ([] if len(args) > 1 else ["'$'"])
            cols = [("key", "any"), ("value", "any"), ("type", "text"), ("atom", "any"), ("id", "int"), ("parent", "int"), ("fullkey", "text"), ("path", "text")]
            return f"LATERAL tessera_{name}({', '.join(texts)})", cols
        found = self.lookup(f"{name}({args[0][2] if args and args[0][0] == 'col' else args[0][1] if args else ''})") if name.startswith("pragma_") else None
        if found is None:
            raise SqlError(f"no such table-valued function: {name}")
        return found

    # --- expressions: text and class

    def truth(self, x, scope: Scope, bare=None) -> str:
        e, k = self.expr(x, scope, bare)
        return e if k == "bool" else f"({self._number(e, k)} <> 0)" if k else f"if({e} is null, null, coalesce(try_cast({e} as double), 0D) <> 0)"

    def key(self, x, scope: Scope, bare=None) -> str:
        """A grouping or ordering key; collations count."""
        if x[0] == "col" and x[1] is None and not scope.find(None, x[2]) and x[2].lower() in scope.aliases:
            x = scope.aliases[x[2].lower()]
        return self.expr(x, scope, bare)[0]

    @staticmethod
    def _number(e: str, k: str | None) -> str:
        return c.number(e) if k in ("text", "json", "any") else f"cast({e} as bigint)" if k == "bool" else e

    @staticmethod
    def _text(e: str, k: str | None) -> str:
        return f"cast(cast({e} as bigint) as string)" if k == "bool" else e if k in ("text", "json", "any") else f"({c.real_text(f'cast({e} as double)')})" if k == "real" else f"cast({e} as string)"

    def _milliseconds(self, args: list, scope: Scope, bare) -> str:
        """The time of a date function's arguments."""
        if not args or args[0] == ("lit", "now", "text"):
            ms = "unix_millis(current_timestamp())"
        else:
            e, k = self.expr(args[0], scope, bare)
            kind = args[1][1].lower() if len(args) > 1 and args[1][0] == "lit" and isinstance(args[1][1], str) else None
            kind = kind if kind in ("unixepoch", "julianday", "auto") else None
            as_number = {"unixepoch": d.from_unix, "auto": d.from_either}.get(kind, d.from_julian)
            if k in ("text", "any", "json", None):  # a text is a time or a number
                numeric = as_number(f"try_cast(regexp_extract({e}, '^ *([+-]?[0-9]+([.][0-9]*)?) *$', 1) as double)")
                ms = numeric if kind in ("unixepoch", "julianday") else f"coalesce({d.parse(e)}, {numeric})"
            else:
                ms = d.from_timestamp(e) if k == "time" else as_number(e)
            args = args[:1] + args[2:] if kind else args
        if any(a[0] != "lit" for a in args[1:]):
            raise SqlError("date modifiers must be constants")
        return d.modify(ms, *(str(a[1]) for a in args[1:]))

    def expr(self, x, scope: Scope, bare=None) -> tuple[str, str | None]:
        if x[0] == "col" and x[1] is None and scope.find(None, x[2]) is None and scope.aliases.get(x[2].lower(), x) != x:
            return self.expr(scope.aliases[x[2].lower()], scope, bare)
        if bare is not None and x[0] != "lit":
            e, k = self.expr(x, scope)[0] if not _has_aggregate(x) and x[0] not in ("scalar", "exists", "inquery") else None, None
            if e is not None:
                k = self.expr(x, scope)[1]
                if e in bare[0]:
                    return e, k
                if x[0] == "col":
                    return bare[1].format(e), k
        return getattr(self, f"_x_{x[0]}")(x, scope, bare)

    def _x_lit(self, x, scope, bare):
        _, v, k = x
        if v is None:
            return "null", None
        if k == "int":
            return f"{v}L" if v >= 0 else f"({v}L)" if v > -(2**63) else "(-9223372036854775807L - 1L)", "int"
        if k == "real":
            return ("double('Infinity')" if v == float("inf") else f"{v!r}D"), "real"
        return (f"X'{v}'", "blob") if k == "blob" else (c.text_literal(v), "text")

    def _x_col(self, x, scope, bare):
        _, q, n = x
        s: Scope | None = scope
        while s is not None:
            if found := s.find(q, n):
                return found
            if q is None and n.lower() in s.aliases and s.aliases[n.lower()] != x:
                return self.expr(s.aliases[n.lower()], s)
            s = s.outer
        raise SqlError(f"no such column: {q + '.' if q else ''}{n}")

    def _x_raise(self, x, scope, bare):
        raise SqlError("RAISE() may only be used within a trigger-program")

    def _x_or(self, x, scope, bare):
        return f"({self.truth(x[1], scope, bare)} OR {self.truth(x[2], scope, bare)})", "bool"

    def _x_and(self, x, scope, bare):
        return f"({self.truth(x[1], scope, bare)} AND {self.truth(x[2], scope, bare)})", "bool"

    def _x_not(self, x, scope, bare):
        return f"(NOT {self.truth(x[1], scope, bare)})", "bool"

    def _sides(self, a, b, scope, bare):
        """Two operands of a comparison, with collation and affinity applied: a text beside a number column counts as a number."""
        collation = next((s[2] for s in (a, b) if s[0] == "collate"), None)
        (l, lk), (r, rk) = self.expr(a, scope, bare), self.expr(b, scope, bare)
        numeric, texts = ("int", "real", "bool"), ("text", "json")
        rank = {"blob": 2} | dict.fromkeys(("any", *texts), 1) | dict.fromkeys(numeric, 0)
        if "blob" in (lk, rk) and lk != rk and lk in rank and rk in rank:  # numbers come before texts, texts before blobs
            return f"if({l} is null, null, {rank[lk]}L)", f"if({r} is null, null, {rank[rk]}L)"
        has = lambda x: x[0] in ("col", "cast") or x[0] == "collate" and has(x[1])  # noqa: E731  # literals and other expressions have no affinity
        if lk in numeric and rk in ("any", *texts):
            if has(a) or rk == "any":
                r = f"try_cast({r} as double)"
            elif has(b):
                l = self._text(l, lk)
            else:  # numbers come before texts
                return f"if({l} is null, null, 0L)", f"if({r} is null, null, 1L)"
        elif lk in ("any", *texts) and rk in numeric:
            if has(b) or lk == "any":
                l = f"try_cast({l} as double)"
            elif has(a):
                r = self._text(r, rk)
            else:
                return f"if({l} is null, null, 1L)", f"if({r} is null, null, 0L)"
        l, r = (f"cast({e} as bigint)" if k == "bool" else e for e, k in ((l, lk), (r, rk)))
        if collation in ("NOCASE", "RTRIM") and (a[0] == "collate") != (b[0] == "collate"):
            fold = c.nocase if collation == "NOCASE" else c.rtrim_key
            l, r = (l, fold(r)) if a[0] == "collate" else (fold(l), r)
        return l, r

    def _x_cmp(self, x, scope, bare):
        l, r = self._sides(x[2], x[3], scope, bare)
        plain = f"({l} {x[1]} {r})"
        # a text that counts as a number but is none comes after all numbers
        left, right = (e.startswith("try_cast(") for e in (l, r))
        if not left and not right:
            return plain, "bool"
        (a, _), (b, _) = (self.expr(s, scope, bare) for s in x[2:4])
        literal = x[2] if left else x[3]
        if literal[0] == "lit":
            if _is_number(str(literal[1])):
                return plain, "bool"
            return f"if({b if left else a} is null, null, {_AFTER[x[1]][not left]})", "bool"
        return f"coalesce({plain}, if({a} is null or {b} is null, null, {_AFTER[x[1]][not left]}))", "bool"

    def _where(self, x, scope: Scope) -> str:
        """A condition whose NULL counts as false: its equalities stay plain, so that joins find their keys."""
        if x[0] == "and":
            return f"({self._where(x[1], scope)} AND {self._where(x[2], scope)})"
        if x[0] == "cmp" and x[1] in ("=", "=="):
            l, r = self._sides(x[2], x[3], scope, None)
            return f"({l} = {r})"
        return self.truth(x, scope)

    def _x_is(self, x, scope, bare):
        l, r = self._sides(x[2], x[3], scope, bare)
        e = f"({l} IS NULL)" if r == "null" else f"({l} <=> {r})"
        if any(s.startswith("try_cast(") for s in (l, r)):  # a text that is no number isn't NULL
            (a, _), (b, _) = (self.expr(s, scope, bare) for s in x[2:4])
            e = f"({e} AND ({a} IS NULL) = ({b} IS NULL))"
        return (f"(NOT {e})" if x[1] else e), "bool"

    def _x_istrue(self, x, scope, bare):
        return f"({self.truth(x[2], scope, bare)} IS {'NOT ' if x[1] else ''}{'TRUE' if x[3] else 'FALSE'})", "bool"

    def _x_between(self, x, scope, bare):
        return self._x_and(("and", ("cmp", ">=", x[1], x[2]), ("cmp", "<=", x[1], x[3])), scope, bare)

    def _x_in(self, x, scope, bare):
        if not x[2]:
            return "false", "bool"
        sides = [self._sides(x[1], y, scope, bare) for y in x[2]]
        if any(e.startswith("try_cast(") for side in sides for e in side) and not all(y[0] == "lit" and _is_number(str(y[1])) for y in x[2]):
            return "(" + " OR ".join(self._x_cmp(("cmp", "=", x[1], y), scope, bare)[0] for y in x[2]) + ")", "bool"
        if len({l for l, _ in sides}) == 1:
            return f"({sides[0][0]} IN ({', '.join(r for _, r in sides)}))", "bool"
        return "(" + " OR ".join(f"{l} = {r}" for l, r in sides) + ")", "bool"

    def _x_inquery(self, x, scope, bare):
        sub, out = self.query(x[2], scope)
        if len(out) != 1:
            raise SqlError(f"sub-select returns {len(out)} columns - expected 1")
        e, k = self.expr(x[1], scope, bare)
        return f"({self._number(e, k) if k == 'bool' else e} IN ({sub}))", "bool"

    def _x_exists(self, x, scope, bare):
        return f"EXISTS ({self.query(x[1], scope)[0]})", "bool"

    def _x_scalar(self, x, scope, bare):
        q = x[1]
        sub, out = self.query(q, scope)
        single = q["kind"] == "select" and q["group"] is None and any(_has_aggregate(i) for i, _ in q["items"])
        return f"({sub}{'' if single or q.get('limit') else ' LIMIT 1'})", out[0][1]

    def _x_like(self, x, scope, bare):
        (v, vk), (p, pk) = self.expr(x[1], scope, bare), self.expr(x[2], scope, bare)
        return c.like(self._text(v, vk), self._text(p, pk), self.expr(x[3], scope)[0] if x[3] else None), "bool"

    def _x_glob(self, x, scope, bare):
        if x[2][0] != "lit":
            return f"tessera_glob({self._text(*self.expr(x[1], scope, bare))}, {self._text(*self.expr(x[2], scope, bare))})", "bool"
        return c.glob(self._text(*self.expr(x[1], scope, bare)), str(x[2][1])), "bool"

    def _x_case(self, x, scope, bare):
        _, base, whens, other = x
        made = [(self.truth(("cmp", "=", base, w) if base else w, scope, bare), self.expr(t, scope, bare)) for w, t in whens]
        last = self.expr(other, scope, bare) if other else ("null", None)
        kinds = {k for _, (_, k) in made} | {last[1]}
        kinds.discard(None)
        if kinds == {"bool"} or "bool" in kinds:
            made = [(w, (f"cast({e} as bigint)", "int") if k == "bool" else (e, k)) for w, (e, k) in made]
            last = (f"cast({last[0]} as bigint)", "int") if last[1] == "bool" else last
            kinds = (kinds - {"bool"}) | {"int"}
        kind = kinds.pop() if len(kinds) == 1 else "real" if kinds <= {"int", "real"} else "text"
        show = (lambda e, k: self._text(e, k)) if kind == "text" else (lambda e, k: f"cast({e} as double)" if kind == "real" else e)
        return "(CASE " + " ".join(f"WHEN {w} THEN {show(*t)}" for w, t in made) + f" ELSE {show(*last) if last[1] else 'null'} END)", kind

    def _x_cast(self, x, scope, bare):
        e, k = self.expr(x[1], scope, bare)
        to = c.affinity(x[2])
        if k == "bool":
            e, k = f"cast({e} as bigint)", "int"
        if to == "NUMERIC" and k in ("int", "bool"):
            return e, "int"
        return f"({c.cast(e, x[2], k in ('text', 'json', 'any', None), k == 'real')})" if not (to == "INTEGER" and k == "int") else e, {"INTEGER": "int", "REAL": "real", "NUMERIC": "real", "TEXT": "text", "BLOB": "blob"}[to]

    def _x_collate(self, x, scope, bare):
        e, k = self.expr(x[1], scope, bare)
        if k != "text":
            return e, k
        return (c.nocase(e) if x[2] == "NOCASE" else c.rtrim_key(e) if x[2] == "RTRIM" else f"collate({e}, 'UTF8_BINARY')"), k

    def _x_un(self, x, scope, bare):
        if x[1] == "-" and x[2][0] == "lit" and x[2][2] in ("int", "real"):
            return self._x_lit(("lit", -x[2][1], x[2][2]), scope, bare)
        e, k = self.expr(x[2], scope, bare)
        if x[1] == "+":
            return e, k
        n = self._number(e, k)
        return (f"(~cast({n} as bigint))", "int") if x[1] == "~" else (f"(-{n})", "int" if k in ("int", "bool") else "real")

    def _x_bin(self, x, scope, bare):
        _, op, a, b = x
        (l, lk), (r, rk) = self.expr(a, scope, bare), self.expr(b, scope, bare)
        if op == "||":
            return f"concat({self._text(l, lk)}, {self._text(r, rk)})", "text"
        if op in ("->", "->>"):
            path = arrow_path(b[1]) if b[0] == "lit" and b[1] is not None else None
            if path is None or from_end(path) or op == "->":  # -> keeps the digits of numbers
                return self._json(op, [(l, lk), (r, rk)]), "json" if op == "->" else "any"
            return _at_path(l, path), "any"
        l, r = self._number(l, lk), self._number(r, rk)
        whole = lk in ("int", "bool") and rk in ("int", "bool")
        if op in ("<<", ">>"):
            return f"({c.shift(f'cast({l} as bigint)', f'cast({r} as bigint)', op == '<<')})", "int"
        if op in "&|":
            return f"(cast({l} as bigint) {op} cast({r} as bigint))", "int"
        if op == "/":
            return (f"({c.int_div(l, r)})", "int") if whole else (f"({c.real_div(l, r)})", "real")
        if op == "%":
            return (f"({c.int_mod(l, r)})", "int") if whole else (f"cast({c.int_mod(l, r)} as double)", "real")
        if whole:
            return f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply'}[op] }({l}, {r})", "int"
        return f"(cast({l} as double) {op} cast({r} as double))", "real"

    # --- functions

    def _x_func(self, x, scope, bare):
        _, name, args, distinct, where, over = x
        if over is not None or name in AGGREGATES or name in RANKING or name in ("min", "max") and len(args) == 1:
            return self._aggregate(x, scope, bare)
        if name in ("date", "time", "datetime", "julianday", "unixepoch", "current_date", "current_time", "current_timestamp"):
            ms = self._milliseconds(args, scope, bare)
            sub = any(a == ("lit", "subsec", "text") for a in args)
            made = {"date": d.date, "current_date": d.date, "julianday": d.julianday}.get(name)
            text = made(ms) if made else {"time": d.time, "current_time": d.time, "datetime": d.datetime, "current_timestamp": d.datetime, "unixepoch": d.unixepoch}[name](ms, sub)
            return f"({text})", {"julianday": "real", "unixepoch": "real" if sub else "int"}.get(name, "text")
        if name == "strftime":
            return f"({d.strftime(str(args[0][1]), self._milliseconds(args[1:], scope, bare))})", "text"
        got = [self.expr(a, scope, bare) for a in args]
        e = [t for t, _ in got]
        k = [kind for _, kind in got]
        text = [self._text(*g) for g in got]
        num = [self._number(*g) for g in got]
        first = next((kind for kind in k if kind), None)
        real = bool(k) and k[0] not in ("int", "bool")
        if name in ("coalesce", "ifnull"):
            same = len({kind for kind in k if kind}) <= 1
            return f"coalesce({', '.join(e if same else text)})", first if same else "text"
        if name in ("iif", "if"):
            whens = [(args[i], args[i + 1]) for i in range(0, len(args) - 1, 2)]
            return self._x_case(("case", None, whens, args[-1] if len(args) % 2 else None), scope, bare)
        if name == "nullif":
            l, r = self._sides(args[0], args[1], scope, bare)
            return f"if({l} = {r}, null, {e[0]})", k[0]
        if name in ("min", "max") and {"text"} < {"text" if kind in ("text", "json", "any") else "number" for kind in k if kind}:
            # numbers come before texts: the least is a number, the greatest a text
            want = [t for t, kind in zip(num if name == "min" else text, k, strict=True) if (kind in ("text", "json", "any")) == (name == "max")]
            some = f"{'least' if name == 'min' else 'greatest'}({', '.join(want)})" if len(want) > 1 else want[0]
            return f"if({' or '.join(f'({t}) is null' for t in e)}, null, {some})", ("text" if name == "max" else "int" if {kind for kind in k if kind not in ("text", "json", "any")} == {"int"} else "real")
        if name in ("min", "max"):
            return f"({(c.least if name == 'min' else c.greatest)(*e)})", first
        if name in ("likely", "unlikely", "likelihood"):
            return got[0]
        if name == "typeof" and k[0] == "any" and args[0][0] in ("func", "bin"):
            inner = [self.expr(a, scope, bare) for a in (args[0][2] if args[0][0] == "func" else args[0][2:])]
            if args[0][0] == "bin" and args[0][3][0] == "lit":
                inner[1] = (c.text_literal(arrow_path(args[0][3][1])), "text")
            if len(inner) == 2:
                return f"(case {self._json('json_type', inner)} when 'integer' then 'integer' when 'true' then 'integer' when 'false' then 'integer' when 'real' then 'real' when 'text' then 'text' when 'array' then 'text' when 'object' then 'text' else 'null' end)", "text"
        if name == "typeof":
            return c.typeof(e[0], {"int": "bigint", "bool": "boolean", "real": "double", "blob": "binary"}.get(k[0], "string")) if k[0] else "'null'", "text"
        if name == "abs":
            return f"abs({num[0]})", "real" if real else "int"
        if name == "round":
            return c.round_to(num[0], self._count(args[1]) if len(args) > 1 else 0), "real"
        if name in ("ceil", "ceiling", "floor", "trunc"):
            return {"ceil": c.ceil, "ceiling": c.ceil, "floor": c.floor, "trunc": c.trunc}[name](num[0], real), "real" if real else "int"
        if name == "log":
            return (c.log(num[0]) if len(num) == 1 else c.log(num[1], num[0])), "real"
        if name in MATH:
            return c.unary_math(name, num[0]), "real"
        if name == "glob":
            return self._x_glob(("glob", args[1], args[0]), scope, bare)
        if name == "like":
            return self._x_like(("like", args[1], args[0], args[2] if len(args) > 2 else None), scope, bare)
        if name == "quote":
            return f"({c.quote(text[0] if k[0] == 'real' else e[0], 'text' if k[0] in ('text', 'json', 'any') else 'blob' if k[0] == 'blob' else 'number')})", "text"
        if name in ("printf", "format"):
            letter = {"int": "i", "bool": "i", "real": "r"}
            lettered = [f"concat('{letter.get(kind, 't')}', {t})" for t, kind in zip(text[1:], k[1:], strict=True)]
            return f"tessera_printf({text[0]}, cast(array({', '.join(lettered)}) as array<string>))", "text"
        if name == "unistr":
            return f"tessera_unistr({text[0]})", "text"
        if name == "timediff":
            return f"tessera_timediff({self._milliseconds(args[:1], scope, bare)}, {self._milliseconds(args[1:], scope, bare)})", "text"
        name = "json" + name[5:] if name.startswith("jsonb") else name  # the binary form is JSON text here
        if name == "json_extract" and len(args) == 2 and args[1][0] == "lit" and args[1][1] is not None and not from_end(args[1][1]):
            return _at_path(e[0], args[1][1]), "any"
        if name in jsonsql.NAMES:
            made = self._json(name, got)
            return (f"cast({made} as bigint)", "int") if name in jsonsql.WHOLE else (made, "json" if name in jsonsql.JSON_VALUED else "any" if name == "json_extract" and len(args) == 2 else "text")
        if name in ("changes", "total_changes", "last_insert_rowid") and self.counter is not None:
            return f"{self.counter(name)}L", "int"
        if name == "randomblob":
            n = max(1, int(args[0][1]) if args[0][0] == "lit" else 1)
            return f"unhex(substr(concat({', '.join(['replace(uuid(), ' + chr(39) + '-' + chr(39) + ', ' + chr(39) * 2 + ')'] * (n // 16 + 1))}), 1, {2 * n}))", "blob"
        table = {
            "length": lambda: (c.length(text[0]) if k[0] != "blob" else f"cast(octet_length({e[0]}) as bigint)", "int"), "lower": lambda: (c.lower(text[0]), "text"), "upper": lambda: (c.upper(text[0]), "text"),
            "substr": lambda: (f"({c.substr(text[0], *num[1:])})", "text"), "substring": lambda: (f"({c.substr(text[0], *num[1:])})", "text"), "replace": lambda: (c.replace(*text), "text"),
            "trim": lambda: (c.trim(*text), "text"), "ltrim": lambda: (c.trim(text[0], text[1] if len(text) > 1 else "' '", "LEADING"), "text"), "rtrim": lambda: (c.trim(text[0], text[1] if len(text) > 1 else "' '", "TRAILING"), "text"),
            "instr": lambda: (c.instr(*text), "int"), "concat": lambda: (c.concat(*text), "text"), "concat_ws": lambda: (c.concat_ws(*text), "text"), "char": lambda: (c.char(*num), "text"), "unicode": lambda: (f"({c.unicode(text[0])})", "int"),
            "hex": lambda: (c.hex_text(text[0]) if k[0] != "blob" else f"coalesce(hex({e[0]}), '')", "text"), "unhex": lambda: (f"({c.unhex(*text)})", "blob"), "zeroblob": lambda: (c.zeroblob(num[0]), "blob"), "octet_length": lambda: (c.octet_length(text[0]), "int"),
            "sign": lambda: (c.sign(f"try_cast({e[0]} as double)" if k[0] in ("text", "json", "any") else num[0]), "int"), "sqrt": lambda: (c.sqrt(num[0]), "real"), "pow": lambda: (c.power(*num), "real"), "power": lambda: (c.power(*num), "real"), "mod": lambda: (c.fmod(*num), "real"), "pi": lambda: ("pi()", "real"), "atan2": lambda: (f"atan2({num[0]}, {num[1]})", "real"),
            "json_valid": lambda: (f"if({e[0]} is null, null, if(try_parse_json({text[0]}) is null, 0L, 1L))", "int"), 
            "random": lambda: ("cast((rand() - 0.5D) * 1.8446744073709552E19D as bigint)", "int"),
        }
        if name not in table:
            raise SqlError(f"no such function: {name}")
        return table[name]()

    def _json(self, name: str, args: list[tuple[str, str | None]]) -> str:
        """A call of the general JSON function, with each argument's class in front of its text."""
        letter = {"int": "i", "bool": "i", "real": "r", "json": "j"}
        return f"tessera_json('{name}', cast(array({', '.join(f'concat({chr(39)}{letter.get(k, "t")}{chr(39)}, {self._text(e, k)})' for e, k in args)}) as array<string>))"

    def _aggregate(self, x, scope, bare):
        _, name, args, distinct, where, over = x
        if distinct and over is not None:
            raise SqlError("DISTINCT is not supported for window functions")
        if distinct and len(args) != 1:
            raise SqlError("DISTINCT aggregates must have exactly one argument")
        got = [("*", "int")] if args == ["*"] or not args else [self.expr(a, scope, bare if over else None) for a in args]
        if where is not None:
            t = self.truth(where, scope)
            got = [(f"if({t}, {'1' if e == '*' else e}, null)", k) for e, k in got[:1]] + got[1:]
        e, k = got[0]
        once = "DISTINCT " if distinct else ""
        ordering = ""
        match name:
            case "count":
                text, kind = f"count({once}{e})", "int"
            case "sum" | "avg":
                n = self._number(e, k)
                kind = "int" if name == "sum" and k in ("int", "bool") else "real"
                text = f"{name}({once}{n if kind == 'int' else f'cast({n} as double)'})"
            case "total":
                text, kind = f"sum({once}cast({self._number(e, k)} as double))", "real"
            case "min" | "max" if k == "any":
                text, kind = f"{name}_by({e}, if({e} is null, null, {_order_of(e)}))", k
            case "min" | "max" | "first_value" | "last_value":
                text, kind = f"{name}({e})", k
            case "group_concat" | "string_agg":
                sep = got[1][0] if len(got) > 1 else "','"
                if over is not None:
                    text, kind = f"array_join(collect_list({self._text(e, k)}){{over}}, {sep})", "text"
                else:
                    # the order of arrival isn't defined here: the values' own order is
                    text, kind = f"listagg({once}{self._text(e, k)}, {sep}) WITHIN GROUP (ORDER BY {self._text(e, k)})", "text"
            case "json_group_array":
                from tessera.operators.aggregates import json_value

                v = json_value(e, {"int": "integer", "real": "real", "json": "json"}.get(k, "text"))
                if over is not None:
                    text, kind = f"concat('[', array_join(collect_list({v}){{over}}, ','), ']')", "json"
                else:
                    # the order of arrival isn't defined here: the values' own order is
                    parts = f"transform(array_sort(collect_list(struct({e if k != 'json' else v} AS o, {v} AS v))), x -> x.v)"
                    text, kind = f"concat('[', array_join({parts}, ','), ']')", "json"
            case "json_group_object":
                from tessera.operators.aggregates import json_value

                v = f"concat({json_value(self._text(e, k), 'text')}, ':', {json_value(got[1][0], {'int': 'integer', 'real': 'real', 'json': 'json'}.get(got[1][1], 'text'))})"
                joined = f"array_join(collect_list({v}){{over}}, ',')" if over is not None else f"array_join(transform(array_sort(collect_list(struct({e} AS o, {v} AS v))), x -> x.v), ',')"
                text, kind = f"concat('{{{{', {joined}, '}}}}')", "json"
            case _:
                text = f"{name}({', '.join(t for t, _ in got) if args else ''})"
                if name in ("ntile", "lag", "lead", "nth_value"):
                    text = f"{name}({', '.join([e, *(t.rstrip('L') if a[0] == 'lit' and a[2] == 'int' and i == 0 else t for i, (a, (t, _)) in enumerate(zip(args[1:], got[1:], strict=True)))])})" if name != "ntile" else f"ntile({e.rstrip('L')})"
                kind = k if name in ("lag", "lead", "nth_value") else "real" if name in ("percent_rank", "cume_dist") else "int"
                if kind == "int" and name not in ("lag", "lead", "nth_value"):
                    text = f"cast({text}{{over}} as bigint)"
        if over is not None:
            over = self._whole(over, scope)
            frame = over["frame"]
            if frame and frame[3] != "NO OTHERS":
                return self._framed(name, got, kind, over, scope, bare)
            w = self._by_groups(over, scope, bare) if frame and frame[0] == "GROUPS" else self._window(over, scope, bare)
            text = text.replace("{over}", f" OVER {w}") if "{over}" in text else f"{text} OVER {w}"
        text = text.replace("{{", "{").replace("}}", "}") + ordering
        if name == "total":
            text = f"coalesce({text}, 0D)"
        return text, kind

    def _whole(self, w: dict, scope: Scope) -> dict:
        """A window with what it takes over from named ones."""
        base = scope.windows.get(w["base"].lower()) if w["base"] else None
        if w["base"] and base is None:
            raise SqlError(f"no such window: {w['base']}")
        while base is not None:  # a chained window takes over what it doesn't state itself
            w = {k: w[k] if w[k] is not None else base[k] for k in ("partition", "order", "frame")} | {"base": base["base"]}
            base = scope.windows.get(w["base"].lower()) if w["base"] else None
        return w

    def _by_groups(self, w: dict, scope: Scope, bare) -> str:
        """A frame of peer groups: one of RANGE over the groups' numbers, which the caller's select prepares."""
        _, lo, hi, _ = w["frame"]
        if any(b[1] is not None and b[1][0] != "lit" for b in (lo, hi)):
            raise SqlError("GROUPS offsets must be constants")
        self.groups.append(f"dense_rank() OVER {self._window(w | {'base': None, 'frame': None}, scope, bare)}")
        bound = lambda b: b[0] if b[1] is None else f"{b[1][1]} {b[0]}"
        by = f"PARTITION BY {', '.join(self.key(x, scope, bare) for x in w['partition'])} " if w["partition"] else ""
        return f"({by}ORDER BY `_group_{len(self.groups)}` RANGE BETWEEN {bound(lo)} AND {bound(hi)})"

    def _framed(self, name: str, got: list, kind: str | None, w: dict, scope: Scope, bare) -> tuple[str, str | None]:
        """A sum or a count over a frame without some of its rows: a difference of plain frames, where all that is left out lies in the frame."""
        unit, lo, hi, exclude = w["frame"]
        around = lo[0] in ("UNBOUNDED PRECEDING", "CURRENT ROW", "PRECEDING") and hi[0] in ("UNBOUNDED FOLLOWING", "CURRENT ROW", "FOLLOWING")
        whole = lo[0] == "UNBOUNDED PRECEDING" and hi[0] == "UNBOUNDED FOLLOWING"
        if name not in ("sum", "count", "total", "avg") or not around or unit == "ROWS" and exclude != "CURRENT ROW" and not whole:
            raise SqlError("this frame with EXCLUDE is in tessera.operators.windows")
        e, k = got[0]
        n = "1" if e == "*" else f"cast({self._number(e, k)} as {'bigint' if kind == 'int' else 'double'})"
        one = f"if({n} is null, 0L, 1L)"
        base = {"base": None, "partition": w["partition"], "order": w["order"]}
        full = self._by_groups(w, scope, bare) if unit == "GROUPS" else self._window(base | {"frame": (unit, lo, hi, "NO OTHERS")}, scope, bare)
        peers = self._window(base | {"frame": ("RANGE", ("CURRENT ROW", None), ("CURRENT ROW", None), "NO OTHERS")}, scope, bare)
        away = {"CURRENT ROW": "{own}", "GROUP": f"sum({{x}}) OVER {peers}", "TIES": f"sum({{x}}) OVER {peers} - {{own}}"}[exclude]
        less = lambda x: f"(coalesce(sum({x}) OVER {full}, 0) - coalesce({away.format(own=f'coalesce({x}, 0)', x=x)}, 0))"
        total, count = less(n), less(one)
        if name == "count":
            return f"cast(coalesce({count}, 0) as bigint)", "int"
        if name == "total":
            return f"if(coalesce({count}, 0) = 0, 0D, cast({total} as double))", "real"
        return (f"if(coalesce({count}, 0) = 0, null, {total})", kind) if name == "sum" else (f"if(coalesce({count}, 0) = 0, null, cast({total} as double) / {count})", "real")

    def _window(self, w: dict, scope: Scope, bare) -> str:
        w = self._whole(w, scope)
        parts = []
        if w["partition"]:
            parts.append("PARTITION BY " + ", ".join(self.key(x, scope, bare) for x in w["partition"]))
        if w["order"]:
            parts.append("ORDER BY " + ", ".join(f"{self.key(x, scope, bare)}{' DESC' if desc else ''}{f' NULLS {nulls}' if nulls else ''}" for x, desc, nulls in w["order"]))
        if w["frame"]:
            unit, lo, hi, exclude = w["frame"]
            if unit == "GROUPS" or exclude != "NO OTHERS":
                raise SqlError("GROUPS frames and EXCLUDE are in tessera.operators.windows")
            bound = lambda b: b[0] if b[1] is None else f"{self.expr(b[1], scope)[0].rstrip('L')} {b[0]}"
            parts.append(f"{unit} BETWEEN {bound(lo)} AND {bound(hi)}")
        return "(" + " ".join(parts) + ")"


def _at_path(x: str, path: str) -> str:
    """The value at a constant path as text, true and false as 1 and 0."""
    return f"transform(array(try_variant_get(try_parse_json({x}), {_quoted(path)}, 'variant')), v -> if(schema_of_variant(v) = 'BOOLEAN', cast(cast(cast(v as boolean) as int) as string), cast(v as string)))[0]"


#: What a comparison gives where its left, or its right, side alone is a text that is no number.
_AFTER = {op: ("false", "false") for op in ("=", "==")} | {op: ("true", "true") for op in ("<>", "!=")} | dict.fromkeys((">", ">="), ("true", "false")) | dict.fromkeys(("<", "<="), ("false", "true"))


def _is_number(s: str) -> bool:
    return re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", s) is not None


def _order_of(e: str) -> str:
    """The order of values of a JSON text's class: NULL, numbers, texts."""
    return f"struct({e} is not null, try_cast({e} as double) is null, try_cast({e} as double), {e})"


def _qualifiers(x):
    """The tables that an expression's columns are qualified by."""
    if isinstance(x, tuple) and len(x) == 3 and x[0] == "col":
        yield x[1]
    elif isinstance(x, tuple | list):
        for y in x:
            yield from _qualifiers(y)


def _calls(x):
    """All calls in an expression, not those in subqueries."""
    if isinstance(x, tuple):
        if x and x[0] == "func":
            yield x
        for y in x[1:]:
            if isinstance(y, tuple | list):
                yield from _calls(y if isinstance(y, tuple) else tuple([None, *y]))


def _has_aggregate(x) -> bool:
    return any((a[1] in AGGREGATES or a[1] in ("min", "max") and len(a[2]) == 1) and a[5] is None for a in _calls(x))
