"""Includes and components: the program without them."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from ..errors import DeclarationProblem, IncludeProblem
from .ast import Agg, Alias, Atom, Bin, Call, Cast, Clause, Compare, Component, Directive, Group, Init, Loop, Match, Relation, Tup, TypeRef
from .parser import Source, parse, tokens


def splice(text: str, folder: Path | None, folders: tuple = (), open_: tuple = (), seen: set | None = None, file: str | None = None) -> Source:
    """The text with included files in place of their directives; a file reached twice is included once."""
    seen = set() if seen is None else seen
    out, last = [], 0
    ts = tokens(text, file)
    for i, (kind, value, line, at) in enumerate(ts):
        if kind == "directive" and value == ".include":
            if ts[i + 1][0] != "string":
                raise IncludeProblem(".include needs a file name", line)
            name, end = ts[i + 1][1], ts[i + 2][3]
            places = [Path(f) / name for f in ([folder] if folder else []) + list(folders)]
            found = next((p.resolve() for p in places if p.is_file()), None)
            if found is None:
                raise IncludeProblem(f"{name} isn't found", line)
            if found in open_:
                raise IncludeProblem(f"{name} includes itself", line)
            out.append((text[last:at], text, last, file))
            if found not in seen:
                seen.add(found)
                inner = splice(found.read_text(), found.parent, folders, (*open_, found), seen, name)
                out += [("\n", text, at, file), *inner.parts(), ("\n", text, at, file)]
            last = end
    return Source.of([*out, (text[last:], text, last, file)])


class _Scope:
    """Names of one instance: what stands for relations, types, components and instances inside it."""

    def __init__(self, prefix: str, relations: set, types: set, inits: set, types_of: dict, comps_of: dict):
        self.prefix, self.relations, self.types, self.inits, self.types_of, self.comps_of = prefix, relations, types, inits, types_of, comps_of

    def relation(self, name: str) -> str:
        first = name.split(".")[0].lower()
        return self.prefix + name if name.lower() in self.relations or "." in name and first in self.inits else name

    def type(self, ref: TypeRef) -> TypeRef:
        if ref.fields is not None:
            return TypeRef(None, [(n, self.type(t)) for n, t in ref.fields], ref.line)
        if ref.name in self.types_of:
            return self.types_of[ref.name]
        first = ref.name.split(".")[0].lower()
        if ref.name.lower() in self.types or "." in ref.name and first in self.inits:
            return TypeRef(self.prefix + ref.name, None, ref.line)
        return ref

    def expr(self, e):
        if isinstance(e, Bin):
            return Bin(e.op, self.expr(e.left), self.expr(e.right))
        if isinstance(e, Call):
            return Call(e.name, tuple(map(self.expr, e.args)))
        if isinstance(e, Tup):
            return Tup(tuple(map(self.expr, e.items)))
        if isinstance(e, Cast):
            return Cast(self.expr(e.of), self.type(e.type))
        if isinstance(e, Agg):
            return Agg(e.op, self.expr(e.of))
        return e

    def predicate(self, p):
        if isinstance(p, Atom):
            return replace(p, rel=self.relation(p.rel), args=tuple(map(self.expr, p.args)))
        if isinstance(p, Compare):
            return replace(p, left=self.expr(p.left), right=self.expr(p.right))
        if isinstance(p, Match):
            return replace(p, pattern=self.expr(p.pattern), text=self.expr(p.text))
        if isinstance(p, Group):
            return Group(tuple(tuple(map(self.predicate, b)) for b in p.bodies))
        return p

    def clause(self, c: Clause) -> Clause:
        return Clause([self.predicate(h) for h in c.heads], [[self.predicate(p) for p in b] for b in c.bodies], c.plan, c.line)


def _inherited(comp: Component, args: list, comps: dict, open_: tuple = ()) -> tuple[list, dict]:
    """Items of a component and its ancestors, the oldest first, and what its type parameters stand for."""
    if comp.name in open_:
        raise DeclarationProblem(f"component {comp.name} inherits from itself", comp.line)
    if len(args) != len(comp.params):
        raise DeclarationProblem(f"component {comp.name} takes {len(comp.params)} types", comp.line)
    own = dict(zip(comp.params, args, strict=True))
    items: list = []
    if comp.parent:
        name, given = comp.parent
        name = own[name].name if name in own else name
        if name not in comps:
            raise DeclarationProblem(f"component {name} isn't declared", comp.line)
        items, theirs = _inherited(comps[name], [own.get(a.name, a) if a.fields is None else a for a in given], comps, (*open_, comp.name))
        own = theirs | own
        for d in [x for x in comp.items if isinstance(x, Directive) and x.kind == "override"]:
            decl = next((x for x in items if isinstance(x, Relation) and x.key == d.rel.lower()), None)
            if decl is None or not decl.overridable:
                raise DeclarationProblem(f"{d.rel} can't be overridden", d.line)
            items = [replace_heads(x, d.rel) if isinstance(x, Clause) else x for x in items]
            items = [x for x in items if not isinstance(x, Clause) or x.heads]
    mine = {x.key for x in items if isinstance(x, Relation)}
    for x in comp.items:
        if isinstance(x, Relation) and x.key in mine:
            raise DeclarationProblem(f"{x.name} is declared twice", x.line)
    return items + [x for x in comp.items if not (isinstance(x, Directive) and x.kind == "override")], own


def replace_heads(c: Clause, rel: str) -> Clause:
    return Clause([h for h in c.heads if h.rel.lower() != rel.lower()], c.bodies, c.plan, c.line)


def _instance(init: Init, prefix: str, comps: dict, out: list, depth: int = 0) -> None:
    if depth > 50:
        raise DeclarationProblem(f"component {init.comp} contains itself", init.line)
    if init.comp not in comps:
        raise DeclarationProblem(f"component {init.comp} isn't declared", init.line)
    items, types_of = _inherited(comps[init.comp], init.args, comps)
    inner = comps | {x.name: x for x in items if isinstance(x, Component)}
    prefix = f"{prefix}{init.name}."
    scope = _Scope(prefix, {x.key for x in items if isinstance(x, Relation)}, {x.name.lower() for x in items if isinstance(x, Alias)}, {x.name.lower() for x in items if isinstance(x, Init)}, types_of, comps)
    for x in items:
        if isinstance(x, Relation):
            out.append(Relation(prefix + x.name, [(n, scope.type(t)) for n, t in x.attrs], x.line, x.overridable))
        elif isinstance(x, Alias):
            out.append(Alias(prefix + x.name, scope.type(x.ref), x.subtype, x.line))
        elif isinstance(x, Directive):
            out.append(Directive(x.kind, scope.relation(x.rel), x.params, x.line))
        elif isinstance(x, Clause):
            out.append(scope.clause(x))
        elif isinstance(x, Init):
            comp = types_of[x.comp].name if x.comp in types_of else x.comp
            _instance(Init(x.name, comp, [scope.type(a) for a in x.args], x.line), prefix, inner, out, depth + 1)


def expand(items: list) -> list:
    comps: dict = {}
    for x in items:
        if isinstance(x, Component):
            if x.name in comps:
                raise DeclarationProblem(f"component {x.name} is declared twice", x.line)
            comps[x.name] = x
    out: list = []
    for x in items:
        if isinstance(x, Init):
            _instance(x, "", comps, out)
        elif not isinstance(x, Component):
            out.append(x)
    return out


def load(text: str, folder: str | Path | None = None, folders: tuple = ()) -> list:
    return expand(parse(splice(text, Path(folder) if folder else None, tuple(folders))))


__all__ = ["Loop", "expand", "load", "splice"]
