"""Parsing of the embedded SQL dialect into plain tuples.

Queries are dicts (kind 'select', 'values' or 'compound'), expressions are tuples whose first item names
their kind. Precedence, from loose to tight: OR, AND, NOT, equality and membership, order, bits, sums,
products, concatenation and JSON arrows, COLLATE, unary signs.
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<blob>[xX]'(?:[0-9A-Fa-f]{2})*')
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])
    |(?P<number>0[xX][0-9A-Fa-f]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?)
    |(?P<param>\?[0-9]*|[:@$][A-Za-z_][A-Za-z_0-9]*)
    |(?P<word>[A-Za-z_\u0080-\U0010ffff][A-Za-z_0-9$\u0080-\U0010ffff]*)
    |(?P<op>->>|->|\|\||<<|>>|<=|>=|<>|!=|==|[-+*/%&|~<>=(),.;])""",
    re.X | re.S,
)
#: Words that end an expression or an alias.
RESERVED = set(
    "SELECT FROM WHERE GROUP ORDER HAVING LIMIT OFFSET UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER AS AND OR NOT IN IS LIKE GLOB BETWEEN CASE WHEN THEN ELSE END "
    "SET VALUES WINDOW RETURNING COLLATE ESCAPE ISNULL NOTNULL EXISTS DISTINCT ALL INTO DEFAULT BY ASC DESC NULLS THEN FILTER OVER INDEXED".split()
)


class SqlError(Exception):
    """Text that isn't a statement of the dialect."""


def tokenize(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unrecognized token: {sql[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return out


def split_statements(sql: str) -> list[list[tuple[str, str]]]:
    """The statements' tokens; a trigger's body belongs to its statement."""
    out: list[list] = [[]]
    depth = 0
    for t in tokenize(sql):
        words = [w.upper() for k, w in out[-1][:3] if k == "word"]
        if words[:1] == ["CREATE"] and "TRIGGER" in words and t[0] == "word":
            depth += {"BEGIN": 1, "CASE": 1, "END": -1}.get(t[1].upper(), 0)
        if t == ("op", ";") and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


class Parser:
    def __init__(self, tokens: list[tuple[str, str]], params=()):
        self.t, self.i, self.params, self.used = tokens, 0, params, 0

    # --- tokens

    def peek(self, n: int = 0) -> str:
        kind, text = self.t[self.i + n] if self.i + n < len(self.t) else ("end", "")
        return text.upper() if kind in ("word", "op") else "" if kind == "end" else f"<{kind}>"

    def accept(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            near = self.t[self.i][1] if self.i < len(self.t) else "end"
            raise SqlError(f"near {near!r}: {' '.join(words)} expected")

    def end(self) -> bool:
        return self.i >= len(self.t)

    def name(self) -> str:
        if self.end():
            raise SqlError("incomplete input")
        kind, text = self.t[self.i]
        if kind == "quoted":
            self.i += 1
            q = text[0]
            return text[1:-1] if q == "[" else text[1:-1].replace(q * 2, q)
        if kind == "string":
            self.i += 1
            return text[1:-1].replace("''", "'")
        if kind != "word":
            raise SqlError(f"near {text!r}: name expected")
        self.i += 1
        return text

    def names(self) -> list[str]:
        self.expect("(")
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        return out

    def table_name(self) -> str:
        n = self.name()
        return self.name() if self.accept(".") else n

    # --- expressions

    def expr(self):
        return self._or()

    def exprs(self) -> list:
        out = [self.expr()]
        while self.accept(","):
            out.append(self.expr())
        return out

    def _or(self):
        x = self._and()
        while self.accept("OR"):
            x = ("or", x, self._and())
        return x

    def _and(self):
        x = self._not()
        while self.accept("AND"):
            x = ("and", x, self._not())
        return x

    def _not(self):
        if self.peek() == "NOT" and self.peek(1) != "EXISTS":
            self.i += 1
            return ("not", self._not())
        return self._equal()

    def _equal(self):
        x = self._order()
        while True:
            if self.accept("=") or self.accept("=="):
                x = ("cmp", "=", x, self._order())
            elif self.accept("<>") or self.accept("!="):
                x = ("cmp", "<>", x, self._order())
            elif self.accept("IS"):
                negated = self.accept("NOT")
                if self.accept("DISTINCT", "FROM"):
                    x = ("is", not negated, x, self._order())
                elif self.peek() in ("TRUE", "FALSE"):
                    x = ("istrue", negated, x, self.peek() == "TRUE")
                    self.i += 1
                else:
                    x = ("is", negated, x, self._order())
            elif self.accept("ISNULL"):
                x = ("is", False, x, ("lit", None, None))
            elif self.accept("NOTNULL") or self.accept("NOT", "NULL"):
                x = ("is", True, x, ("lit", None, None))
            else:
                negated = self.peek() == "NOT" and self.peek(1) in ("LIKE", "GLOB", "BETWEEN", "IN")
                if negated:
                    self.i += 1
                if self.accept("BETWEEN"):
                    low = self._order()
                    self.expect("AND")
                    y = ("between", x, low, self._order())
                elif self.accept("IN"):
                    y = self._in(x)
                elif self.peek() in ("LIKE", "GLOB"):
                    op = self.peek().lower()
                    self.i += 1
                    pattern = self._order()
                    y = (op, x, pattern, self._order() if self.accept("ESCAPE") else None)
                else:
                    return x
                x = ("not", y) if negated else y

    def _in(self, x):
        if self.accept("("):
            if self.accept(")"):
                return ("in", x, [])
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                q = self.query()
                self.expect(")")
                return ("inquery", x, q)
            items = self.exprs()
            self.expect(")")
            return ("in", x, items)
        star = {"kind": "select", "items": [(("star", None), None)], "from": [("table", self.table_name(), None, "comma", None)]}
        return ("inquery", x, _select(star))

    def _order(self):
        x = self._bits()
        while self.peek() in ("<", "<=", ">", ">="):
            op = self.peek()
            self.i += 1
            x = ("cmp", op, x, self._bits())
        return x

    def _left(self, ops: tuple[str, ...], below, kind: str = "bin"):
        x = below()
        while self.peek() in ops:
            op = self.peek()
            self.i += 1
            x = (kind, op, x, below())
        return x

    def _bits(self):
        return self._left(("<<", ">>", "&", "|"), self._sum)

    def _sum(self):
        return self._left(("+", "-"), self._product)

    def _product(self):
        return self._left(("*", "/", "%"), self._concat)

    def _concat(self):
        return self._left(("||", "->", "->>"), self._collate)

    def _collate(self):
        x = self._unary()
        while self.accept("COLLATE"):
            x = ("collate", x, self.name().upper())
        return x

    def _unary(self):
        for op in ("-", "+", "~"):
            if self.accept(op):
                return ("un", op, self._unary())
        return self._primary()

    def _primary(self):
        if self.end():
            raise SqlError("incomplete input")
        kind, text = self.t[self.i]
        if kind == "number":
            self.i += 1
            n = text.replace("_", "")
            if n[:2].lower() == "0x":
                v = int(n, 16)
                return ("lit", v - 2**64 if v >= 2**63 else v, "int")
            if re.fullmatch("[0-9]+", n) and int(n) < 2**63:
                return ("lit", int(n), "int")
            return ("lit", float(n), "real")
        if kind == "string":
            self.i += 1
            return ("lit", text[1:-1].replace("''", "'"), "text")
        if kind == "blob":
            self.i += 1
            return ("lit", text[2:-1], "blob")
        if kind == "param":
            self.i += 1
            return self._param(text)
        if self.accept("("):
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                q = self.query()
                self.expect(")")
                return ("scalar", q)
            x = self.expr()
            self.expect(")")
            return x
        if self.accept("CASE"):
            base = None if self.peek() == "WHEN" else self.expr()
            whens = []
            while self.accept("WHEN"):
                c = self.expr()
                self.expect("THEN")
                whens.append((c, self.expr()))
            other = self.expr() if self.accept("ELSE") else None
            self.expect("END")
            return ("case", base, whens, other)
        if self.accept("CAST"):
            self.expect("(")
            x = self.expr()
            self.expect("AS")
            words = []
            while not self.accept(")"):
                words.append(self.t[self.i][1])
                self.i += 1
            return ("cast", x, " ".join(words))
        if self.peek() == "NOT" or self.peek() == "EXISTS":
            negated = self.accept("NOT")
            self.expect("EXISTS")
            self.expect("(")
            q = self.query()
            self.expect(")")
            return ("not", ("exists", q)) if negated else ("exists", q)
        if kind == "word" and text.upper() in ("NULL", "TRUE", "FALSE"):
            self.i += 1
            return ("lit", {"NULL": None, "TRUE": 1, "FALSE": 0}[text.upper()], None if text.upper() == "NULL" else "int")
        if kind == "word" and text.upper() in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
            self.i += 1
            return ("func", text.lower(), [], False, None, None)
        if kind == "word" and text.upper() == "RAISE" and self.peek(1) == "(":
            self.i += 2
            how = self.name().upper()
            message = self.expr() if self.accept(",") else None
            self.expect(")")
            return ("raise", how, message)
        if kind == "word" and self.peek(1) == "(":
            return self._call()
        first = self.name()
        if self.accept("."):
            second = self.name()
            return ("col", second, self.name()) if self.accept(".") else ("col", first, second)
        return ("col", None, first)

    def _param(self, text: str):
        if text == "?":
            value = self.params[self.used]
            self.used += 1
        elif text[0] == "?":
            value = self.params[int(text[1:]) - 1]
        else:
            value = self.params[text[1:]]
        if isinstance(value, bool):
            value = int(value)
        if isinstance(value, bytes):
            return ("lit", value.hex(), "blob")
        return ("lit", value, {int: "int", float: "real", str: "text", type(None): None}[type(value)])

    def _call(self):
        name = self.name().lower()
        self.expect("(")
        distinct = self.accept("DISTINCT")
        self.accept("ALL")
        args = []
        if self.accept("*"):
            args = ["*"]
        elif self.peek() != ")":
            args = self.exprs()
        self.expect(")")
        where = over = None
        if self.peek() == "FILTER" and self.peek(1) == "(":
            self.i += 2
            self.expect("WHERE")
            where = self.expr()
            self.expect(")")
        if self.accept("OVER"):
            over = self.window() if self.peek() == "(" else {"base": self.name(), "partition": None, "order": None, "frame": None}
        return ("func", name, args, distinct, where, over)

    def window(self) -> dict:
        self.expect("(")
        w = {"base": None, "partition": None, "order": None, "frame": None}
        if self.peek() not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS", ")"):
            w["base"] = self.name()
        if self.accept("PARTITION", "BY"):
            w["partition"] = self.exprs()
        if self.accept("ORDER", "BY"):
            w["order"] = self.ordering()
        if self.peek() in ("ROWS", "RANGE", "GROUPS"):
            unit = self.peek()
            self.i += 1
            if self.accept("BETWEEN"):
                lo = self._bound()
                self.expect("AND")
                hi = self._bound()
            else:
                lo, hi = self._bound(), ("CURRENT ROW", None)
            exclude = "NO OTHERS"
            if self.accept("EXCLUDE"):
                exclude = next(e for e in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES") if self.accept(*e.split()))
            w["frame"] = (unit, lo, hi, exclude)
        self.expect(")")
        return w

    def _bound(self):
        for b in ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING", "CURRENT ROW"):
            if self.accept(*b.split()):
                return (b, None)
        x = self.expr()
        side = self.peek()
        self.i += 1
        return (side, x)

    def ordering(self) -> list:
        out = []
        while True:
            x = self.expr()
            desc = self.accept("DESC")
            if not desc:
                self.accept("ASC")
            nulls = "FIRST" if self.accept("NULLS", "FIRST") else "LAST" if self.accept("NULLS", "LAST") else None
            out.append((x, desc, nulls))
            if not self.accept(","):
                return out

    # --- queries

    def with_clause(self) -> tuple[list, bool]:
        """The named queries before a statement, and whether they may name themselves."""
        ctes, recursive = [], False
        if self.accept("WITH"):
            recursive = self.accept("RECURSIVE")
            while True:
                name = self.name()
                cols = self.names() if self.peek() == "(" else None
                self.expect("AS")
                self.accept("NOT")
                self.accept("MATERIALIZED")
                self.expect("(")
                ctes.append((name, cols, self.query()))
                self.expect(")")
                if not self.accept(","):
                    break
        return ctes, recursive

    def query(self) -> dict:
        ctes, recursive = self.with_clause()
        q = self._core()
        while self.peek() in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.peek()
            self.i += 1
            if op == "UNION" and self.accept("ALL"):
                op = "UNION ALL"
            q = {"kind": "compound", "op": op, "left": q, "right": self._core()}
        q["order"] = self.ordering() if self.accept("ORDER", "BY") else None
        q["limit"] = q["offset"] = None
        if self.accept("LIMIT"):
            q["limit"] = self.expr()
            if self.accept("OFFSET"):
                q["offset"] = self.expr()
            elif self.accept(","):
                q["offset"], q["limit"] = q["limit"], self.expr()
        q["ctes"], q["recursive"] = ctes, recursive
        return q

    def _core(self) -> dict:
        if self.accept("VALUES"):
            rows = []
            while True:
                self.expect("(")
                rows.append(self.exprs())
                self.expect(")")
                if not self.accept(","):
                    return {"kind": "values", "rows": rows}
        self.expect("SELECT")
        q: dict = {"kind": "select", "distinct": self.accept("DISTINCT")}
        self.accept("ALL")
        q["items"] = [self._item()]
        while self.accept(","):
            q["items"].append(self._item())
        q["from"] = self._from() if self.accept("FROM") else []
        q["where"] = self.expr() if self.accept("WHERE") else None
        q["group"] = self.exprs() if self.accept("GROUP", "BY") else None
        q["having"] = self.expr() if self.accept("HAVING") else None
        q["windows"] = {}
        if self.accept("WINDOW"):
            while True:
                n = self.name()
                self.expect("AS")
                q["windows"][n.lower()] = self.window()
                if not self.accept(","):
                    break
        return q

    def _item(self):
        if self.accept("*"):
            return (("star", None), None)
        if self.i + 2 < len(self.t) and self.peek(1) == "." and self.peek(2) == "*":
            q = self.name()
            self.i += 2
            return (("star", q), None)
        began = self.i
        x = self.expr()
        text = " ".join(t for _, t in self.t[began : self.i])
        return (x, self._alias() or (x[2] if x[0] == "col" else text))

    def _alias(self) -> str | None:
        if self.accept("AS"):
            return self.name()
        if not self.end() and self.t[self.i][0] in ("word", "quoted", "string") and self.peek() not in RESERVED:
            return self.name()
        return None

    def _from(self) -> list:
        out = [self._source("comma")]
        while True:
            if self.accept(","):
                out.append(self._source("comma"))
                continue
            natural = self.accept("NATURAL")
            how = "inner"
            if self.accept("INNER") or self.accept("CROSS"):
                pass
            elif self.peek() in ("LEFT", "RIGHT", "FULL"):
                how = self.peek().lower()
                self.i += 1
                self.accept("OUTER")
            if not self.accept("JOIN"):
                if natural or how != "inner":
                    raise SqlError("JOIN expected")
                return out
            src = self._source(how)
            on = ("natural",) if natural else ("on", self.expr()) if self.accept("ON") else ("using", self.names()) if self.accept("USING") else None
            out.append((*src[:4], on))

    def _source(self, how: str):
        if self.accept("("):
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                q = self.query()
                self.expect(")")
                return ("query", q, self._alias(), how, None)
            inner = self._from()
            self.expect(")")
            return ("nested", inner, self._alias(), how, None)
        name = self.table_name()
        if self.accept("("):
            args = [] if self.peek() == ")" else self.exprs()
            self.expect(")")
            return ("call", (name.lower(), args), self._alias() or name, how, None)
        alias = self._alias()
        if self.accept("INDEXED", "BY"):
            self.name()
        else:
            self.accept("NOT", "INDEXED")
        return ("table", name, alias, how, None)


def _select(q: dict) -> dict:
    """A select with all parts."""
    return {"distinct": False, "where": None, "group": None, "having": None, "windows": {}, "order": None, "limit": None, "offset": None, "ctes": [], "recursive": False} | q
