"""Types: twelve primitives, tuples, aliases and subtypes."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import DeclarationProblem, TypeProblem
from .ast import TypeRef

NAMES = {"number": "int32", "unsigned": "uint32", "float": "f32", "symbol": "string"}
BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
FLOATS = ("f32", "f64")
PRIMITIVES = (*BITS, *FLOATS, "string", "bool")


def limits(prim: str) -> tuple[int, int]:
    n = BITS[prim]
    return (0, 2**n - 1) if prim[0] == "u" else (-(2 ** (n - 1)), 2 ** (n - 1) - 1)


@dataclass(frozen=True)
class Type:
    """A primitive or the fields of a tuple, and the names of its subtypes from the widest on."""

    prim: str | None
    fields: tuple = ()
    names: tuple = ()

    @property
    def root(self) -> Type:
        return Type(self.prim, tuple(f.root for f in self.fields))

    @property
    def numeric(self) -> bool:
        return self.prim in BITS or self.prim in FLOATS

    def widens_to(self, other: Type) -> bool:
        """May a value of this type stand where the other is declared?"""
        return self.root == other.root and self.names[: len(other.names)] == other.names and all(a.widens_to(b) for a, b in zip(self.fields, other.fields, strict=True))

    def __str__(self) -> str:
        return self.names[-1] if self.names else self.prim or f"({', '.join(map(str, self.fields))})"


def prim(name: str) -> Type:
    return Type(name)


def meet(a: Type, b: Type, what: str, line: int) -> Type:
    """The narrower of two related types."""
    if a.widens_to(b):
        return a
    if b.widens_to(a):
        return b
    raise TypeProblem(f"{what} is both {a} and {b}", line)


class Registry:
    """Names of types; case doesn't matter."""

    def __init__(self):
        self.declared: dict[str, tuple[TypeRef, bool, str, int]] = {}
        self.done: dict[str, Type] = {}

    def add(self, name: str, ref: TypeRef, subtype: bool, line: int) -> None:
        key = name.lower()
        if key in self.declared or key in PRIMITIVES or key in NAMES:
            raise DeclarationProblem(f"type {name} is declared twice", line)
        self.declared[key] = (ref, subtype, name, line)

    def resolve(self, ref: TypeRef, open_: tuple = ()) -> Type:
        if ref.fields is not None:
            names = [n for n, _ in ref.fields]
            if len(set(names)) < len(names):
                raise DeclarationProblem("a tuple's field is declared twice", ref.line)
            return Type(None, tuple(self.resolve(t, open_) for _, t in ref.fields))
        key = ref.name.lower()
        if ref.name in PRIMITIVES or ref.name in NAMES:
            return Type(NAMES.get(ref.name, ref.name))
        if key in open_:
            raise TypeProblem(f"type {ref.name} contains itself", ref.line)
        if key not in self.declared:
            raise TypeProblem(f"type {ref.name} isn't declared", ref.line)
        if key not in self.done:
            of, subtype, name, _ = self.declared[key]
            t = self.resolve(of, (*open_, key))
            self.done[key] = Type(t.prim, t.fields, (*t.names, name.lower())) if subtype else t
        return self.done[key]
