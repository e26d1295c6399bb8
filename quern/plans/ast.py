"""The parts of a program."""

from __future__ import annotations

from dataclasses import dataclass, field, replace  # noqa: F401
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Const:
    value: Any
    kind: str  # int, float, string, bool; a primitive type once it is pinned


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Tup:
    items: tuple


@dataclass(frozen=True)
class Item:
    """Component of a tuple."""

    of: Any
    index: int


@dataclass(frozen=True)
class Cast:
    of: Any
    type: Any


@dataclass(frozen=True)
class Typed:
    """An expression whose primitive or tuple type is known."""

    of: Any
    type: Any


@dataclass(frozen=True)
class Agg:
    op: str
    of: Any


@dataclass(frozen=True)
class Atom:
    rel: str
    args: tuple
    negated: bool = False
    line: int = 0


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any
    line: int = 0


@dataclass(frozen=True)
class Match:
    """match(pattern, text) or contains(part, text)."""

    kind: str
    pattern: Any
    text: Any
    negated: bool
    line: int = 0


@dataclass(frozen=True)
class Group:
    bodies: tuple


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple
    plan: tuple | None = None
    line: int = 0


@dataclass
class Clause:
    """A rule as written: several heads, several bodies."""

    heads: list
    bodies: list
    plan: tuple | None
    line: int


@dataclass
class TypeRef:
    """A type as written: a name, or fields of a tuple."""

    name: str | None
    fields: list | None = None
    line: int = 0


@dataclass
class Relation:
    name: str  # as written; lower-cased it is the key
    attrs: list  # (name, TypeRef, later a resolved type)
    line: int = 0
    overridable: bool = False
    input: dict | None = None
    output: dict | None = None
    printsize: bool = False

    @property
    def key(self) -> str:
        return self.name.lower()


@dataclass
class Loop:
    """A fixpoint or loop block."""

    kind: str  # fixpoint, loop
    clauses: list
    iterative: list
    windows: list | None = None  # (low, high) of @it, ends included
    until: list | None = None  # relations
    until_all: bool = True
    either: bool = True  # stop when either condition says so; else when both do
    line: int = 0
    rules: list = field(default_factory=list)


@dataclass
class Component:
    name: str
    params: list
    parent: tuple | None  # (name, type arguments)
    items: list
    line: int = 0


@dataclass
class Init:
    name: str
    comp: str
    args: list
    line: int = 0


@dataclass
class Extern:
    name: str
    params: list  # (name, type)
    returns: str
    line: int = 0


@dataclass
class Alias:
    name: str
    ref: TypeRef
    subtype: bool
    line: int = 0


@dataclass
class Directive:
    kind: str  # input, output, printsize, override
    rel: str
    params: dict
    line: int = 0
