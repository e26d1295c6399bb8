"""Recursive-descent parser of program text."""

from __future__ import annotations

import re
from bisect import bisect_right

from ..errors import Place, SyntaxProblem
from .ast import Agg, Alias, Atom, Bin, Call, Cast, Clause, Compare, Component, Const, Directive, Extern, Group, Init, Loop, Match, Relation, Tup, TypeRef, Var, Wild

TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#(?!\#*").*|//.*)
    |(?P<raw>r(?P<hash>\#*)"(?P<body>(?s:.*?))"(?P=hash))
    |(?P<string>"(?:\\(?s:.)|[^"\\])*")
    |(?P<float>\d+\.\d+)|(?P<int>\d+)
    |(?P<directive>\.(?:decl|input|output|printsize|include|type|extern|comp|init|override|plan|iterative)(?![A-Za-z0-9_]))
    |(?P<it>@it)
    |(?P<name>_?[A-Za-z]+[A-Za-z0-9_]*(?:\._?[A-Za-z]+[A-Za-z0-9_]*)*)
    |(?P<op>:-|<:|->|!=|<=|>=|==|[-+*/%=<>!(){}:;,.])
    |(?P<wild>_)""",
    re.VERBOSE,
)
AGGREGATES = {"count": "count", "COUNT": "count", "average": "average", "AVG": "average", "sum": "sum", "SUM": "sum", "min": "min", "MIN": "min", "max": "max", "MAX": "max"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "'": "'"}


def unquote(text: str, line: int) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x.startswith("u"):
            return chr(int(x[2:-1], 16))
        if x.startswith("x"):
            return chr(int(x[1:], 16))
        if x.startswith("\n"):
            return ""
        if x not in ESCAPES:
            raise SyntaxProblem(f"unknown escape \\{x}", line)
        return ESCAPES[x]

    return re.sub(r"\\(u\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|\n\s*|(?s:.))", one, text[1:-1])


class Source(str):
    """Program text put together out of pieces, each with the text and the file that it comes from."""

    pieces: list[tuple[int, str, int, str | None]]

    @classmethod
    def of(cls, parts: list[tuple[str, str, int, str | None]]) -> Source:
        """parts: a piece, the whole text that it was cut from, its offset there, and the file."""
        out, at = cls("".join(p for p, *_ in parts)), 0
        out.pieces = []
        for piece, *origin in parts:
            out.pieces.append((at, *origin))
            at += len(piece)
        return out

    def parts(self) -> list[tuple[str, str, int, str | None]]:
        ends = [p[0] for p in self.pieces[1:]] + [len(self)]
        return [(self[a:b], *origin) for (a, *origin), b in zip(self.pieces, ends, strict=True)]

    def place(self, at: int) -> Place:
        start, text, offset, file = self.pieces[bisect_right(self.pieces, at, key=lambda p: p[0]) - 1]
        return Place.of(text, min(offset + at - start, len(text)), file)


def tokens(text: str, file: str | None = None) -> list[tuple[str, str, Place, int]]:
    """(kind, text, place, offset)."""
    source = text if isinstance(text, Source) else Source.of([(text, text, 0, file)])
    out, at = [], 0
    while at < len(text):
        line = source.place(at)
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r}", line)
        kind = m.lastgroup if m.lastgroup not in ("hash", "body") else "raw"
        if m["raw"] is not None:
            kind = "raw"
        if kind != "skip":
            value = m["body"] if kind == "raw" else unquote(m[0], line) if kind == "string" else m[0]
            out.append(("string" if kind == "raw" else kind, value, line, at))
        at = m.end()
    out.append(("end", "", source.place(at), at))
    return out


class Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    # tokens
    def peek(self, value: str | None = None, kind: str | None = None, ahead: int = 0) -> bool:
        k, v, *_ = self.all[min(self.at + ahead, len(self.all) - 1)]
        return (value is None or v == value and k != "string") and (kind is None or k == kind)

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v, line, _ = self.all[self.at]
        if not self.peek(value, kind):
            raise SyntaxProblem(f"expected {value or kind}, found {v or 'the end'!r}", line)
        self.at += 1
        return v

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    @property
    def line(self) -> int:
        return self.all[self.at][2]

    def name(self, dotted: bool = False) -> str:
        line, v = self.line, self.take(kind="name")
        if "." in v and not dotted:
            raise SyntaxProblem(f"{v} may not have a dot here", line)
        return v

    def many(self, one, close: str = ")") -> list:
        out = []
        if not self.peek(close):
            out.append(one())
            while self.maybe(","):
                out.append(one())
        self.take(close)
        return out

    # programs
    def program(self) -> list:
        out = []
        while not self.peek(kind="end"):
            out.append(self.item())
        return out

    def item(self, inside: bool = False):
        line = self.line
        if self.peek(kind="directive"):
            word = self.take()
            if word == ".decl":
                return self.declaration(line)
            if word in (".input", ".output"):
                rel = self.name(True)
                params = dict(self.many(self.param)) if self.maybe("(") else {}
                return Directive(word[1:], rel, params, line)
            if word == ".printsize":
                return Directive("printsize", self.name(True), {}, line)
            if word == ".override" and inside:
                return Directive("override", self.name(), {}, line)
            if word == ".type":
                name = self.name()
                subtype = self.maybe("<:")
                if not subtype:
                    self.take("=")
                return Alias(name, self.type(), subtype, line)
            if word == ".comp":
                return self.component(line)
            if word == ".init":
                name = self.name()
                self.take("=")
                return Init(name, self.name(), self.type_args(), line)
            if word == ".extern" and not inside:
                self.take("fn")
                name = self.name()
                self.take("(")
                params = self.many(lambda: (self.name(), self.take(":") and self.name()))
                self.take("->")
                return Extern(name, params, self.name(), line)
            raise SyntaxProblem(f"{word} may not stand here", line)
        if not inside and self.peek("fixpoint") and self.peek("{", ahead=1):
            self.take()
            return self.block("fixpoint", line)
        if not inside and self.peek("loop") and (self.peek("while", ahead=1) or self.peek("until", ahead=1)):
            self.take()
            return self.loop(line)
        return self.clause()

    def param(self) -> tuple[str, str]:
        name = self.name()
        self.take("=")
        return name, self.take(kind="string")

    def declaration(self, line: int) -> Relation:
        name = self.name()
        self.take("(")
        attrs = self.many(lambda: (self.name(), self.take(":") and self.type()))
        return Relation(name, attrs, line, self.maybe("overridable"))

    def type(self) -> TypeRef:
        line = self.line
        if self.maybe("("):
            return TypeRef(None, self.many(lambda: (self.name(), self.take(":") and self.type())), line)
        return TypeRef(self.name(True), None, line)

    def type_args(self) -> list:
        return self.many(self.type, ">") if self.maybe("<") else []

    def component(self, line: int) -> Component:
        name = self.name()
        params = self.many(self.name, ">") if self.maybe("<") else []
        parent = (self.name(), self.type_args()) if self.maybe(":") else None
        self.take("{")
        items = []
        while not self.maybe("}"):
            items.append(self.item(True))
        return Component(name, params, parent, items, line)

    # blocks
    def block(self, kind: str, line: int) -> Loop:
        self.take("{")
        iterative = []
        while self.maybe(".iterative"):
            iterative.append(self.name(True))
        clauses = []
        while not self.maybe("}"):
            c = self.clause()
            if not c.bodies:
                raise SyntaxProblem("facts may not stand in a block", c.line)
            clauses.append(c)
        return Loop(kind, clauses, iterative, line=line)

    def loop(self, line: int) -> Loop:
        windows = until = None
        until_all, either, said = True, True, 0
        while said < 2 and (self.peek("while") or self.peek("until") or said and self.peek("or")):
            if said and self.maybe("or"):
                either = False
            if windows is None and self.maybe("while"):
                self.take("{")
                windows = self.windows()
                self.take("}")
            elif until is None and self.maybe("until"):
                self.take("{")
                until, joins = [self.name(True)], set()
                while self.peek("and") or self.peek("or"):
                    joins.add(self.take())
                    until.append(self.name(True))
                if len(joins) > 1:
                    raise SyntaxProblem("'and' and 'or' may not be mixed in a stop condition", line)
                until_all = joins != {"or"}
                self.take("}")
            else:
                raise SyntaxProblem("a loop has one 'while' and one 'until' at most", line)
            said += 1
        out = self.block("loop", line)
        out.windows, out.until, out.until_all, out.either = windows, until, until_all, either
        return out

    def windows(self) -> list[tuple[int, int]]:
        top = 65535

        def one() -> list[tuple[int, int]]:
            self.take("@it")
            op, n = self.take(kind="op"), int(self.take(kind="int"))
            if op not in ("<=", ">=", "==", "<", ">") or n > top:
                raise SyntaxProblem("a condition on @it compares it with a number up to 65535", self.line)
            low, high = {"<=": (0, n), "<": (0, n - 1), ">=": (n, top), ">": (n + 1, top), "==": (n, n)}[op]
            return [(low, high)] if low <= high else []

        out = one()
        while self.peek("and") or self.peek("or"):
            if self.take() == "and":
                out = [(max(a, c), min(b, d)) for a, b in out for c, d in one() if max(a, c) <= min(b, d)]
            else:
                out = out + one()
        return out

    # rules
    def clause(self) -> Clause:
        line = self.line
        heads = [self.head()]
        while self.maybe(","):
            heads.append(self.head())
        if self.maybe("."):
            if len(heads) > 1:
                raise SyntaxProblem("a fact has one head", line)
            return Clause(heads, [], None, line)
        self.take(":-")
        bodies = self.bodies()
        self.take(".")
        plan = None
        if self.maybe(".plan"):
            if self.peek(kind="int"):
                self.take()
                self.take(":")
            self.take("(")
            plan = tuple(self.many(lambda: int(self.take(kind="int"))))
        return Clause(heads, bodies, plan, line)

    def head(self) -> Atom:
        line, rel = self.line, self.name(True)
        self.take("(")

        def arg():
            if self.peek(kind="name") and self.all[self.at][1] in AGGREGATES and self.peek("(", ahead=1):
                op = AGGREGATES[self.take()]
                self.take("(")
                e = self.expr()
                self.take(")")
                return Agg(op, e)
            return self.expr()

        return Atom(rel, tuple(self.many(arg)), False, line)

    def bodies(self) -> list:
        out = [self.predicates()]
        while self.maybe(";"):
            out.append(self.predicates())
        return out

    def predicates(self) -> list:
        out = [self.predicate()]
        while self.maybe(","):
            out.append(self.predicate())
        return out

    def predicate(self):
        line, start = self.line, self.at
        try:  # a comparison, if an operator follows an expression
            left = self.expr()
            op = self.all[self.at][1]
            if self.all[self.at][0] == "op" and op in ("=", "!=", ">=", ">", "<=", "<"):
                self.at += 1
                return Compare(op, left, self.expr(), line)
        except SyntaxProblem:
            pass
        self.at = start
        negated = self.maybe("!")
        if self.peek(kind="name") and self.all[self.at][1] in ("match", "contains") and self.peek("(", ahead=1):
            kind = self.take()
            self.take("(")
            pattern = self.expr()
            self.take(",")
            text = self.expr()
            self.take(")")
            return Match(kind, pattern, text, negated, line)
        if negated and self.maybe("("):
            atom = self.atom(True)
            self.take(")")
            return atom
        if not negated and self.maybe("("):
            bodies = self.bodies()
            self.take(")")
            return Group(tuple(map(tuple, bodies)))
        return self.atom(negated)

    def atom(self, negated: bool) -> Atom:
        line, rel = self.line, self.name(True)
        self.take("(")

        def arg():
            if self.peek(kind="wild"):
                self.take()
                return Wild()
            e = self.factor()
            if not isinstance(e, Var | Const):
                raise SyntaxProblem("an atom's arguments are variables, constants or _", line)
            return e

        return Atom(rel, tuple(self.many(arg)), negated, line)

    # expressions: no precedence, from left to right
    def expr(self):
        left = self.factor()
        while self.all[self.at][0] == "op" and self.all[self.at][1] in "+-*/%":
            op = self.take()
            left = Bin(op, left, self.factor())
        return left

    def factor(self):
        kind, value, line, offset = self.all[self.at]
        if kind == "op" and value in "+-" and self.all[self.at + 1][0] in ("int", "float") and self.all[self.at + 1][3] == offset + 1:
            self.at += 1
            e = self.factor()
            return Const(-e.value if value == "-" else e.value, e.kind)
        self.at += 1
        if kind == "int":
            return Const(int(value), "int")
        if kind == "float":
            return Const(float(value), "float")
        if kind == "string":
            return Const(value, "string")
        if kind == "name":
            if value in ("True", "False"):
                return Const(value == "True", "bool")
            if self.peek("("):
                self.at += 1
                if value == "as":
                    e = self.factor()
                    self.take(",")
                    t = self.type()
                    self.take(")")
                    return Cast(e, t)
                return Call(value, tuple(self.many(self.expr)))
            if "." in value:
                raise SyntaxProblem(f"{value} isn't a variable", line)
            return Var(value)
        if kind == "op" and value == "(":
            items, comma = [self.element()], False
            while self.maybe(","):
                comma = True
                if self.peek(")"):
                    break
                items.append(self.element())
            self.take(")")
            if comma:
                return Tup(tuple(items))
            if isinstance(items[0], Wild):
                raise SyntaxProblem("_ isn't a value", line)
            return items[0]
        raise SyntaxProblem(f"unexpected {value or 'end'!r}", line)

    def element(self):
        if self.peek(kind="wild"):
            self.take()
            return Wild()
        return self.expr()


def parse(text: str) -> list:
    return Parser(text).program()
