"""Programs: declared, safe, typed and stratified."""

from __future__ import annotations

import itertools
import warnings
from collections import defaultdict
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..errors import DeclarationProblem, RuleProblem, StratificationProblem, TypeProblem
from .ast import Agg, Alias, Atom, Bin, Call, Cast, Clause, Compare, Const, Directive, Extern, Group, Item, Loop, Match, Relation, Rule, Tup, Typed, Var, Wild
from .expand import load
from .types import BITS, FLOATS, NAMES, PRIMITIVES, Registry, Type, limits, meet, prim

#: Built-in functions: parameter types (None: any number or bool) and result.
BUILTINS = {"strlen": (("string",), "int32"), "substr": (("string", "int32", "int32"), "string"), "ord": (("string",), "int32"), "to_string": ((None,), "string"), "to_number": (("string",), "int32"), "cat": (("string", "string"), "string")}


@dataclass
class Stratum:
    """Rules evaluated together."""

    rules: list
    recursive: bool
    loop: Loop | None = None

    @property
    def heads(self) -> list[str]:
        return list(dict.fromkeys(r.head.rel for r in self.rules))


@dataclass
class Program:
    relations: dict = field(default_factory=dict)
    types: Registry = field(default_factory=Registry)
    externs: dict = field(default_factory=dict)
    facts: dict = field(default_factory=lambda: defaultdict(list))
    segments: list = field(default_factory=list)  # lists of rules, or Loops with their rules
    strata: list = field(default_factory=list)
    schema: dict = field(default_factory=dict)  # relation -> types
    warnings: list = field(default_factory=list)

    @property
    def outputs(self) -> list[str]:
        return [k for k, r in self.relations.items() if r.output is not None or r.printsize]

    @property
    def derived(self) -> set[str]:
        return {r.head.rel for s in self.segments for r in (s.rules if isinstance(s, Loop) else s)}

    def relation(self, name: str, line: int | None = None) -> str:
        key = name.lower()
        if key not in self.relations:
            raise DeclarationProblem(f"relation {name} isn't declared", line)
        return key


def variables(e) -> list[str]:
    if isinstance(e, Var):
        return [e.name]
    if isinstance(e, Bin):
        return variables(e.left) + variables(e.right)
    if isinstance(e, Call):
        return [v for a in e.args for v in variables(a)]
    if isinstance(e, Tup):
        return [v for a in e.items for v in variables(a)]
    if isinstance(e, Item | Cast | Agg | Typed):
        return variables(e.of)
    if isinstance(e, Atom):
        return [v for a in e.args for v in variables(a)]
    if isinstance(e, Compare):
        return variables(e.left) + variables(e.right)
    if isinstance(e, Match):
        return variables(e.pattern) + variables(e.text)
    return []


def put(e, by: dict):
    """e with variables replaced."""
    if isinstance(e, Var):
        return by.get(e.name, e)
    if isinstance(e, Bin):
        return Bin(e.op, put(e.left, by), put(e.right, by))
    if isinstance(e, Call):
        return Call(e.name, tuple(put(a, by) for a in e.args))
    if isinstance(e, Tup):
        return Tup(tuple(put(a, by) for a in e.items))
    if isinstance(e, Item):
        of = put(e.of, by)
        return of.items[e.index] if isinstance(of, Tup) else Item(of, e.index)
    if isinstance(e, Cast):
        return Cast(put(e.of, by), e.type)
    if isinstance(e, Agg):
        return Agg(e.op, put(e.of, by))
    if isinstance(e, Atom):
        return replace(e, args=tuple(put(a, by) for a in e.args))
    if isinstance(e, Compare):
        return replace(e, left=put(e.left, by), right=put(e.right, by))
    if isinstance(e, Match):
        return replace(e, pattern=put(e.pattern, by), text=put(e.text, by))
    return e


def _bodies(body: list) -> list[list]:
    """Disjunctive normal form."""
    options = [[[p]] if not isinstance(p, Group) else [x for b in p.bodies for x in _bodies(list(b))] for p in body]
    return [[p for part in choice for p in part] for choice in itertools.product(*options)]


def _rules(c: Clause) -> list[Rule]:
    return [Rule(h, tuple(b), c.plan, c.line) for h in c.heads for body in c.bodies for b in _bodies(list(body))]


def _assignments(rule: Rule) -> Rule:
    """Equalities that define a variable are substituted away; tuple patterns become projections."""
    bound = {v for p in rule.body if isinstance(p, Atom) and not p.negated for v in variables(p)}
    by: dict = {}
    body = list(rule.body)

    def known(e) -> bool:
        return all(v in bound or v in by for v in variables(e))

    changed = True
    while changed:
        changed = False
        for i, p in enumerate(body):
            if not isinstance(p, Compare) or p.op != "=":
                continue
            for left, right in ((p.left, p.right), (p.right, p.left)):
                if isinstance(left, Var) and left.name not in bound and left.name not in by and known(right):
                    by[left.name] = put(right, by)
                    body.pop(i)
                    changed = True
                elif isinstance(left, Tup) and known(right) and (not known(left) or any(isinstance(x, Wild) for x in left.items)):
                    parts = [Compare("=", x, put(Item(right, j), by), p.line) for j, x in enumerate(left.items) if not isinstance(x, Wild)]
                    body[i : i + 1] = [replace(q, right=_Sized(q.right, len(left.items))) if isinstance(q.right, Item) else q for q in parts]
                    changed = True
                if changed:
                    break
            if changed:
                break
    body = [put(p, by) if not (isinstance(p, Atom) and not p.negated) else p for p in body]
    return replace(rule, head=put(rule.head, by), body=tuple(body))


class _Sized(Item):
    """A projection out of a tuple of a stated size."""

    def __new__(cls, item: Item, size: int):
        out = object.__new__(cls)
        object.__setattr__(out, "of", item.of)
        object.__setattr__(out, "index", item.index)
        object.__setattr__(out, "size", size)
        return out

    def __init__(self, item: Item, size: int):
        pass


class _Checker:
    """Types of a rule's expressions; literals take the type of their context."""

    def __init__(self, program: Program, line: int):
        self.program, self.line, self.vars = program, line, {}

    def fail(self, message: str):
        raise TypeProblem(message, self.line)

    def literal(self, e) -> bool:
        if isinstance(e, Const):
            return e.kind in ("int", "float")
        return isinstance(e, Bin) and self.literal(e.left) and self.literal(e.right)

    def check(self, e, want: Type | None = None) -> Typed:
        """e with its type; want only guides literals."""
        if isinstance(e, Typed):
            return e
        if isinstance(e, Var):
            if e.name not in self.vars:
                raise RuleProblem(f"variable {e.name} isn't bound by a positive atom", self.line)
            return Typed(e, self.vars[e.name])
        if isinstance(e, Const):
            return self.const(e, want)
        if isinstance(e, Bin):
            if self.literal(e.left) and not self.literal(e.right):
                right = self.check(e.right, want)
                left = self.check(e.left, right.type)
            else:
                left = self.check(e.left, want)
                right = self.check(e.right, left.type)
            if not left.type.numeric or left.type.root != right.type.root:
                self.fail(f"{left.type} {e.op} {right.type} isn't defined")
            return Typed(Bin(e.op, left, right), left.type if left.type == right.type else left.type.root)
        if isinstance(e, Tup):
            wants = want.fields if want and want.prim is None and len(want.fields) == len(e.items) else (None,) * len(e.items)
            if any(isinstance(i, Wild) for i in e.items):
                raise RuleProblem("_ may only stand in a tuple pattern", self.line)
            items = tuple(self.check(i, w) for i, w in zip(e.items, wants, strict=True))
            return Typed(Tup(items), Type(None, tuple(i.type for i in items)))
        if isinstance(e, Item):
            of = self.check(e.of)
            if of.type.prim is not None or e.index >= len(of.type.fields) or len(of.type.fields) != getattr(e, "size", len(of.type.fields)):
                self.fail(f"{of.type} isn't a tuple of this shape")
            return Typed(Item(of, e.index), of.type.fields[e.index])
        if isinstance(e, Cast):
            target = self.program.types.resolve(e.type)
            of = self.check(e.of, target)
            if of.type.root != target.root:
                self.fail(f"{of.type} can't be taken as {target}")
            return Typed(of.of, target)
        if isinstance(e, Call):
            return self.call(e)
        self.fail("this isn't a value")

    def const(self, e: Const, want: Type | None) -> Typed:
        if e.kind == "int":
            p = want.prim if want and want.prim else "int32"
            if p in FLOATS or p not in BITS:
                self.fail(f"{e.value} stands where {want} is expected")
            low, high = limits(p)
            if not low <= e.value <= high:
                self.fail(f"{e.value} is out of the range of {p}")
        elif e.kind == "float":
            p = want.prim if want and want.prim else "f32"
            if p not in FLOATS:
                self.fail(f"{e.value} stands where {want} is expected")
        else:
            p = e.kind
        names = want.names if want and want.prim == p else ()
        return Typed(Const(e.value, p), Type(p, (), names))

    def call(self, e: Call) -> Typed:
        if e.name in BUILTINS:
            params, result = BUILTINS[e.name]
        elif e.name in self.program.externs:
            x = self.program.externs[e.name]
            params, result = tuple(t for _, t in x.params), x.returns
        else:
            self.fail(f"function {e.name} isn't declared")
        if len(params) != len(e.args):
            self.fail(f"{e.name} takes {len(params)} arguments")
        args = tuple(self.check(a, prim(p) if p else None) for a, p in zip(e.args, params, strict=True))
        for a, p in zip(args, params, strict=True):
            if p and a.type.root != prim(p) or not p and not (a.type.numeric or a.type.prim == "bool"):
                self.fail(f"{e.name} doesn't take {a.type}")
        return Typed(Call(e.name, args), prim(result))

    def pair(self, left, right) -> tuple[Typed, Typed]:
        if self.literal(left) and not self.literal(right):
            b = self.check(right)
            return self.check(left, b.type), b
        a = self.check(left, self.check(right).type if isinstance(left, Tup) and not isinstance(right, Tup) else None)
        return a, self.check(right, a.type)

    def rule(self, rule: Rule) -> Rule:
        schema = self.program.schema
        for p in rule.body:
            if isinstance(p, Atom):
                types = schema[p.rel]
                if len(types) != len(p.args):
                    self.fail(f"{p.rel} has {len(types)} columns, not {len(p.args)}")
                if not p.negated:
                    for a, t in zip(p.args, types, strict=True):
                        if isinstance(a, Var):
                            self.vars[a.name] = meet(self.vars[a.name], t, a.name, self.line) if a.name in self.vars else t
        body = []
        for p in rule.body:
            if isinstance(p, Atom):
                args = []
                for a, t in zip(p.args, schema[p.rel], strict=True):
                    if isinstance(a, Const) or p.negated and not isinstance(a, Wild):
                        x = self.check(a, t)
                        if isinstance(a, Const) and x.type.root != t.root:
                            self.fail(f"{a.value!r} stands where {t} is expected")
                        if not isinstance(a, Const):
                            meet(x.type, t, "an argument", self.line)
                        args.append(x)
                    else:
                        args.append(a)
                body.append(replace(p, args=tuple(args)))
            elif isinstance(p, Compare):
                left, right = self.pair(p.left, p.right)
                meet(left.type, right.type, "a comparison", self.line)
                if p.op not in ("=", "!=") and not (left.type.numeric or left.type.prim == "string"):
                    self.fail(f"{left.type} has no order")
                body.append(replace(p, left=left, right=right))
            else:
                pattern, text = self.check(p.pattern), self.check(p.text)
                if pattern.type.prim != "string" or text.type.prim != "string":
                    self.fail(f"{p.kind} takes strings")
                body.append(replace(p, pattern=pattern, text=text))
        types = schema[rule.head.rel]
        if len(types) != len(rule.head.args):
            self.fail(f"{rule.head.rel} has {len(types)} columns, not {len(rule.head.args)}")
        args = []
        for a, t in zip(rule.head.args, types, strict=True):
            if isinstance(a, Agg):
                x = self.check(a.of, t if a.op != "count" else None)
                if not t.numeric or a.op != "count" and x.type.root != t.root:
                    self.fail(f"{a.op} of {x.type} can't be put into {t}")
                args.append(Agg(a.op, x))
            else:
                x = self.check(a, t)
                if not x.type.widens_to(t) and not isinstance(a, Const):
                    self.fail(f"{x.type} can't be put into {t}")
                if x.type.root != t.root:
                    self.fail(f"{x.type} can't be put into {t}")
                args.append(x)
        return replace(rule, head=replace(rule.head, args=tuple(args)), body=tuple(body))


def _constant(e, line: int):
    """The value of a fact's argument."""
    if isinstance(e, Typed):
        return _constant(e.of, line)
    if isinstance(e, Const):
        return e.value
    if isinstance(e, Tup):
        return tuple(_constant(i, line) for i in e.items)
    raise RuleProblem("a fact's arguments are constants", line)


def _canonical(program: Program, rule: Rule) -> Rule:
    body = tuple(replace(p, rel=program.relation(p.rel, p.line)) if isinstance(p, Atom) else p for p in rule.body)
    return replace(rule, head=replace(rule.head, rel=program.relation(rule.head.rel, rule.line)), body=body)


def _safe(rule: Rule) -> None:
    bound = {v for p in rule.body if isinstance(p, Atom) and not p.negated for v in variables(p)}
    for p in rule.body:
        if isinstance(p, Atom) and p.negated or not isinstance(p, Atom):
            for v in variables(p):
                if v not in bound:
                    raise RuleProblem(f"variable {v} isn't bound by a positive atom", rule.line)
    aggregates = [a for a in rule.head.args if isinstance(a, Agg)]
    if len(aggregates) > 1:
        raise RuleProblem("a head has one aggregate at most", rule.line)
    for v in variables(rule.head):
        if v not in bound:
            raise RuleProblem(f"head variable {v} isn't bound by a positive atom", rule.line)
    n = sum(isinstance(p, Atom) and not p.negated for p in rule.body)
    if rule.plan is not None and sorted(rule.plan) != list(range(1, n + 1)):
        raise RuleProblem(f".plan isn't a permutation of 1 to {n}", rule.line)


def aggregate_of(rule: Rule) -> tuple[str, int] | None:
    return next(((a.op, i) for i, a in enumerate(rule.head.args) if isinstance(a, Agg)), None)


def components(n: int, edges: dict[int, set[int]]) -> list[list[int]]:
    """Strongly connected components, those depended on first (Tarjan, without recursion)."""
    index, low, on, stack, out, count = {}, {}, set(), [], [], itertools.count()
    for root in range(n):
        if root in index:
            continue
        work = [(root, iter(sorted(edges[root])))]
        index[root] = low[root] = next(count)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == v:
                            break
                    out.append(sorted(part))
            elif w not in index:
                index[w] = low[w] = next(count)
                stack.append(w)
                on.add(w)
                work.append((w, iter(sorted(edges[w]))))
            elif w in on:
                low[v] = min(low[v], index[w])
    return out


def _stratify(program: Program, rules: list[Rule]) -> list[Stratum]:
    by_head = defaultdict(list)
    for i, r in enumerate(rules):
        by_head[r.head.rel].append(i)
    edges = {i: {j for p in r.body if isinstance(p, Atom) for j in by_head[p.rel]} for i, r in enumerate(rules)}
    for group in by_head.values():  # rules that aggregate into one relation are grouped together
        own = [i for i in group if aggregate_of(rules[i])]
        for a, b in zip(own, own[1:] + own[:1], strict=True):
            edges[a].add(b)
    out = []
    for part in components(len(rules), edges):
        own = [rules[i] for i in part]
        heads = {r.head.rel for r in own}
        _check_aggregates(own)
        recursive = any(isinstance(p, Atom) and p.rel in heads for r in own for p in r.body)
        if recursive:
            for r in own:
                if any(isinstance(p, Atom) and p.negated and p.rel in heads for p in r.body):
                    program.warnings.append(f"line {r.line}: {r.head.rel} depends on its own negation")
                agg = aggregate_of(r)
                if agg and agg[0] not in ("min", "max"):
                    program.warnings.append(f"line {r.line}: {agg[0]} inside a recursion may not settle")
        out.append(Stratum(own, recursive))
    return out


def _check_aggregates(rules: list[Rule]) -> None:
    kinds = defaultdict(set)
    for r in rules:
        kinds[r.head.rel].add(aggregate_of(r))
    for rel, k in kinds.items():
        if len(k) > 1:
            raise RuleProblem(f"the rules of {rel} don't agree on its aggregate")


def _needs(loop: Loop, rel: str) -> set[str]:
    """The relations that rel depends on by the block's rules."""
    needs, todo = set(), [rel]
    while todo:
        y = todo.pop()
        new = {p.rel for r in loop.rules if r.head.rel == y for p in r.body if isinstance(p, Atom)} - needs
        needs |= new
        todo += new
    return needs


def _check_loop(program: Program, loop: Loop) -> None:
    heads = {r.head.rel for r in loop.rules}
    if not any(isinstance(p, Atom) and p.rel in heads for r in loop.rules for p in r.body):
        raise StratificationProblem("no rule of the block uses what the block derives", loop.line)
    loop.iterative = [program.relation(x, loop.line) for x in loop.iterative]
    for x in loop.iterative:
        if x not in heads:
            raise StratificationProblem(f".iterative {x} isn't derived in its block", loop.line)
        if x not in _needs(loop, x):
            raise StratificationProblem(f".iterative {x} doesn't feed back into itself", loop.line)
    if loop.until is not None:
        loop.until = [program.relation(x, loop.line) for x in loop.until]
        for x in loop.until:
            if program.schema[x]:
                raise StratificationProblem(f"stop relation {x} isn't nullary", loop.line)
            if x not in heads:
                raise StratificationProblem(f"stop relation {x} isn't derived in its loop", loop.line)
            needs = _needs(loop, x)
            if not needs & heads:
                raise StratificationProblem(f"stop relation {x} doesn't depend on its loop", loop.line)


def build(text: str, *, folder: str | Path | None = None, folders: tuple = (), extended: bool | None = None, wanted: tuple | None = None) -> Program:
    """The program of a text. extended: False rejects blocks, True allows recursion in blocks only, None allows both."""
    program = Program()
    clauses: list = []
    directives: list[Directive] = []
    for x in load(text, folder, folders):
        if isinstance(x, Relation):
            if x.key in program.relations:
                raise DeclarationProblem(f"relation {x.name} is declared twice", x.line)
            names = [n for n, _ in x.attrs]
            if len(set(names)) < len(names):
                raise DeclarationProblem(f"an attribute of {x.name} is declared twice", x.line)
            program.relations[x.key] = x
        elif isinstance(x, Alias):
            program.types.add(x.name, x.ref, x.subtype, x.line)
        elif isinstance(x, Extern):
            if x.name in program.externs:
                raise DeclarationProblem(f"function {x.name} is declared twice", x.line)
            types = [NAMES.get(t, t) for t in (*(t for _, t in x.params), x.returns)]
            if any(t not in PRIMITIVES for t in types):
                raise TypeProblem(f"{x.name} takes and gives primitive types", x.line)
            program.externs[x.name] = Extern(x.name, list(zip([n for n, _ in x.params], types[:-1], strict=True)), types[-1], x.line)
        elif isinstance(x, Directive):
            directives.append(x)
        else:
            clauses.append(x)
    for name in program.types.declared:
        program.types.resolve(program.types.declared[name][0])
    for key, r in program.relations.items():
        program.schema[key] = tuple(program.types.resolve(t) for _, t in r.attrs)
    for d in directives:
        r = program.relations[program.relation(d.rel, d.line)]
        allowed = {"input": {"IO", "filename", "delimiter", "header"}, "output": {"IO", "filename", "delimiter", "order_by", "limit"}, "printsize": set()}[d.kind]
        if unknown := set(d.params) - allowed:
            raise DeclarationProblem(f".{d.kind} has no parameter {sorted(unknown)[0]}", d.line)
        if d.kind == "input":
            if d.params.get("IO", "file") not in ("file", "command"):
                raise DeclarationProblem(f"IO is file or command, not {d.params['IO']}", d.line)
            if any(t.prim is None for t in program.schema[r.key]):
                raise DeclarationProblem(f"{r.name} has tuple columns and can't be read", d.line)
            r.input = d.params
        elif d.kind == "output":
            if r.printsize:
                raise DeclarationProblem(f"{r.name} has both .output and .printsize", d.line)
            if "limit" in d.params and "order_by" not in d.params:
                raise DeclarationProblem(f".output {r.name}: limit needs order_by", d.line)
            r.output = d.params
        else:
            if r.output is not None:
                raise DeclarationProblem(f"{r.name} has both .output and .printsize", d.line)
            r.printsize = True

    def prepared(c: Clause) -> list[Rule]:
        out = []
        for rule in _rules(c):
            rule = _assignments(_canonical(program, rule))
            _safe(rule)
            out.append(_Checker(program, rule.line).rule(rule))
        return out

    plain: list[Rule] = []
    for x in clauses:
        if isinstance(x, Loop):
            if extended is False:
                raise StratificationProblem(f"{x.kind} blocks need the extended mode", x.line)
            program.segments.append(plain)
            plain = []
            x.rules = [r for c in x.clauses for r in prepared(c)]
            _check_loop(program, x)
            program.segments.append(x)
        elif not x.bodies:
            head = _canonical(program, Rule(x.heads[0], (), None, x.line)).head
            checked = _Checker(program, x.line).rule(Rule(head, (), None, x.line))
            program.facts[head.rel].append(tuple(_constant(a, x.line) for a in checked.head.args))
        else:
            plain += prepared(x)
    program.segments.append(plain)

    # a block is a barrier: what an earlier segment reads may not be derived later only
    derived_at: dict[str, int] = {}
    for i, s in enumerate(program.segments):
        for r in s.rules if isinstance(s, Loop) else s:
            derived_at.setdefault(r.head.rel, i)
    for i, s in enumerate(program.segments):
        for r in s.rules if isinstance(s, Loop) else s:
            for p in r.body:
                if isinstance(p, Atom) and derived_at.get(p.rel, i) > i and p.rel not in program.facts and program.relations[p.rel].input is None:
                    raise StratificationProblem(f"{p.rel} is used before the block that derives it", r.line)
        if isinstance(s, Loop):
            _check_aggregates(s.rules)

    # only what the wanted relations need is kept
    live = {program.relation(w) for w in wanted} if wanted else set(program.outputs)
    if live:
        live |= {u for s in program.segments if isinstance(s, Loop) for u in s.until or ()}
        while True:
            more = {p.rel for s in program.segments for r in (s.rules if isinstance(s, Loop) else s) if r.head.rel in live for p in r.body if isinstance(p, Atom)} - live
            if not more:
                break
            live |= more
    for s in program.segments:
        if isinstance(s, Loop):
            if not live or any(r.head.rel in live for r in s.rules):
                program.strata.append(Stratum(s.rules, True, s))
        else:
            own = _stratify(program, [r for r in s if not live or r.head.rel in live])
            if extended and any(x.recursive for x in own):
                raise StratificationProblem("in the extended mode, recursion stands in blocks", next(x for x in own if x.recursive).rules[0].line)
            program.strata += own
    for w in program.warnings:
        warnings.warn(w, stacklevel=2)
    return program


__all__ = ["BITS", "Program", "Stratum", "aggregate_of", "build", "variables"]
