"""What a stratum's relations gain and lose when what it reads changes.

A stratum without aggregates is maintained by deletion and rederivation: derivations that used a lost row
(or the absence of a new one) mark their heads, through the recursion; marked heads that have another
derivation come back, and new derivations are added, semi-naively. An aggregated stratum without recursion
derives the groups anew that a changed derivation touches. Other strata (aggregates in a recursion, blocks)
are evaluated again and compared. Work grows with the changes and what they touch, but for scans.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import aggregate
from ..operators.fixpoint import Fixpoint
from ..operators.rules import UNIT, Rules, columns_of, union
from ..plans.ast import Atom, Const, Rule, Typed, Var, Wild
from ..plans.program import Stratum, aggregate_of
from ..tables import Scratch

Changes = dict[str, DataFrame]  # only relations that changed; written tables


class Maintenance:
    def __init__(self, rules: Rules, fixpoint: Fixpoint, scratch: Scratch):
        self.rules, self.fixpoint, self.scratch = rules, fixpoint, scratch

    def _some(self, df: DataFrame) -> DataFrame | None:
        """A written table, if it has rows."""
        out, n, name = self.scratch.counted(df)
        if not n:
            self.scratch.drop(name)
        return out if n else None

    def _minus(self, rel: str, a: DataFrame, b: DataFrame | None, how: str = "left_anti") -> DataFrame:
        names = columns_of(self.rules.schema[rel])
        return (a if b is None else a.join(b, names, how)).select(*names)

    def _touched(self, r: Rule, changed: Changes, absent: Changes, store: dict, heads: set[str]) -> list[DataFrame]:
        """Heads of the derivations over a store that use a changed row, or the absence of a row that wasn't or isn't there."""
        out = []
        for i, p in enumerate(r.body):
            if not isinstance(p, Atom) or p.rel in heads:
                continue
            if not p.negated and p.rel in changed:
                out.append(self.rules.tuples(r, lambda j, name, i=i: changed[name] if j == i else store[name]))
            if p.negated and p.rel in absent:  # the atom stays negated, too: another row may fit it
                flipped = replace(r, body=(*r.body, replace(p, negated=False)), plan=None)
                out.append(self.rules.tuples(flipped, lambda j, name, n=len(r.body): absent[name] if j == n else store[name]))
        return out

    @staticmethod
    def _of(r: Rule, rel: str) -> Rule:
        """The rule, its derivations limited to heads that fit rows of a frame, which comes first in the body."""
        args = tuple(a if isinstance(a, Typed) and isinstance(a.of, Var | Const) else Wild() for a in r.head.args)
        return replace(r, body=(Atom(rel, args), *r.body), plan=None)

    def stratum(self, s: Stratum, old: dict, new: dict, plus: Changes, minus: Changes) -> tuple[dict, Changes, Changes]:
        """(relations evaluated again, what each gained, what each lost). old, new: the stores before and after; `+rel` is a relation's own rows."""
        heads = set(s.heads)
        aggregates = any(aggregate_of(r) for r in s.rules)
        own = any(isinstance(p, Atom) and p.negated and p.rel in heads for r in s.rules for p in r.body)
        if s.loop is not None or own or aggregates and s.recursive:
            return self._again(s, old, new)
        return self._groups(s, old, new, plus, minus) if aggregates else self._rederive(s, old, new, plus, minus)

    def _again(self, s: Stratum, old: dict, new: dict) -> tuple[dict, Changes, Changes]:
        whole = self.fixpoint.loop(s, new) if s.loop is not None else self.fixpoint.run(s, new)
        whole = {rel: self.scratch.counted(df)[::2] for rel, df in whole.items()}
        plus = {rel: self._some(self._minus(rel, df, old[rel])) for rel, (df, _) in whole.items()}
        minus = {rel: self._some(self._minus(rel, old[rel], df)) for rel, (df, _) in whole.items()}
        return whole, plus, minus

    def _groups(self, s: Stratum, old: dict, new: dict, plus: Changes, minus: Changes) -> tuple[dict, Changes, Changes]:
        gained, lost = {}, {}
        for rel in s.heads:
            rules = [r for r in s.rules if r.head.rel == rel]
            op, at = next(a for r in rules if (a := aggregate_of(r)))
            names = columns_of(self.rules.schema[rel])
            keys = [c for c in names if c != f"c{at}"]
            parts = [x[f"+{rel}"] for x in (plus, minus) if f"+{rel}" in x]
            parts += [x for r in rules for x in self._touched(r, minus, plus, old, set()) + self._touched(r, plus, minus, new, set())]
            touched = self._some(union([p.select(*keys) if keys else p.select(F.lit(True).alias(UNIT)) for p in parts]).distinct()) if parts else None
            if touched is None:
                gained[rel], lost[rel] = None, None
                continue
            mine = touched if keys else None
            derived = [self.rules.tuples(self._of(r, "?"), lambda j, name: touched if j == 0 else new[name]) for r in rules]
            if f"+{rel}" in new:
                derived.append(new[f"+{rel}"])
            now = union(derived).distinct()
            now = aggregate(now if mine is None else now.join(mine, keys, "left_semi").select(*names), op, at, self.rules.schema[rel])
            now = self.scratch.counted(now)[0]
            had = old[rel] if mine is None else old[rel].join(mine, keys, "left_semi").select(*names)
            gained[rel], lost[rel] = self._some(self._minus(rel, now, had)), self._some(self._minus(rel, had, now))
        return dict.fromkeys(s.heads), gained, lost

    def _rederive(self, s: Stratum, old: dict, new: dict, plus: Changes, minus: Changes) -> tuple[dict, Changes, Changes]:
        heads, rules = set(s.heads), self.rules
        dead: Changes = {}
        for rel in s.heads:
            parts = [minus[f"+{rel}"]] if f"+{rel}" in minus else []
            parts += [x for r in s.rules if r.head.rel == rel for x in self._touched(r, minus, plus, old, heads)]
            if parts and (found := self._some(self._minus(rel, union([p.select(*columns_of(rules.schema[rel])) for p in parts]).distinct(), old[rel], "left_semi"))) is not None:
                dead[rel] = found
        more = dict(dead)
        while more and s.recursive:  # what was derived from marked heads is marked
            found = {}
            for rel in s.heads:
                parts = [rules.tuples(r, lambda j, name, i=i: more[name] if j == i else old[name]) for r in s.rules if r.head.rel == rel for i, p in enumerate(r.body) if isinstance(p, Atom) and p.rel in more]
                if parts and (x := self._some(self._minus(rel, union(parts).distinct(), dead.get(rel)))) is not None:
                    found[rel] = x
            for rel, x in found.items():
                dead[rel] = x if rel not in dead else self.scratch.counted(dead[rel].union(x))[0]
            more = found
        stay = {rel: self._minus(rel, old[rel], dead[rel]) if rel in dead else old[rel] for rel in s.heads}
        store = new | stay
        seeds = {}
        for rel in s.heads:
            parts = [x for r in s.rules if r.head.rel == rel for x in self._touched(r, plus, minus, store, heads)]
            parts += [plus[f"+{rel}"]] if f"+{rel}" in plus else []
            if rel in dead:
                parts += [rules.tuples(self._of(r, "?"), lambda j, name, rel=rel: dead[rel] if j == 0 else store[name]) for r in s.rules if r.head.rel == rel]
                parts += [self._minus(rel, dead[rel], new[f"+{rel}"], "left_semi")] if f"+{rel}" in new else []
            names = columns_of(rules.schema[rel])
            seeds[rel] = self.scratch.counted(self._minus(rel, union([p.select(*names) for p in parts]).distinct(), stay[rel]) if parts else rules.empty(rel))
        added = {rel: df for rel, (df, _, _) in seeds.items()}
        if s.recursive and any(n for _, n, _ in seeds.values()):
            kept: dict[str, list[DataFrame]] = {rel: [df] for rel, df in added.items()}
            parts_ = {rel: [self.scratch.counted(stay[rel])[::2] if rel in dead else (old[rel], None), (added[rel], None)] for rel in s.heads}
            written = [parts_[rel][0][1] for rel in dead]
            self.fixpoint.semi_naive(s, store, parts_, {rel: (df, n) for rel, (df, n, _) in seeds.items()}, kept)
            self.scratch.drop(*written)
            added = {rel: union(x) for rel, x in kept.items()}
        gained = {rel: self._some(self._minus(rel, added[rel], dead.get(rel))) for rel in s.heads}
        lost = {rel: self._some(self._minus(rel, dead[rel], added[rel])) if rel in dead else None for rel in s.heads}
        return dict.fromkeys(s.heads), gained, lost
