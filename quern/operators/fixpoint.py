"""Fixpoints, evaluated semi-naively by a driver loop; explicit loops by their defining equations.

Every round's new tuples are written to the shared folder: this cuts the lineage, survives lost
executors and gives Catalyst true sizes, so that small deltas are broadcast. The rows are counted
while they are written, so a round is one job for each relation, and the relations' jobs of a round run
side by side.

What a round shuffles grows with its candidates: a relation's parts that aren't small are written in
buckets of its columns (of the group, if it is aggregated), and what a loop doesn't change is dealt once
by the variables that it is joined on.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DivergenceProblem
from ..plans.ast import Atom, Loop
from ..plans.program import Stratum, aggregate_of
from ..tables import Scratch
from .aggregates import aggregate
from .rules import Rules, columns_of, union

#: Parts of a relation's table above which they are merged into one.
PARTS = 8
#: Rows from which on a merged part is written in buckets; smaller ones are broadcast.
BUCKETED = 1 << 17


class Fixpoint:
    def __init__(self, rules: Rules, scratch: Scratch, limit: int = 65535, report: Callable[..., None] | None = None):
        self.rules, self.scratch, self.limit = rules, scratch, limit
        self.report = report or (lambda **_: None)
        self.keys: dict[str, tuple[int, ...]] = {}  # of relations that are derived, and so are sets
        self.found: dict[str, tuple[int, ...]] = {}  # of those that one rule derives

    def _derive(self, rel: str, stratum: Stratum, frames: dict[str, DataFrame], base: DataFrame | None) -> DataFrame:
        """What the stratum's rules of a relation give over some frames, with a base."""
        own = [r for r in stratum.rules if r.head.rel == rel]
        parts = [self.rules.tuples(r, lambda i, name: frames[name]) for r in own]
        out = union(([base] if base is not None else []) + parts).distinct()
        agg = aggregate_of(own[0]) or next((a for r in own if (a := aggregate_of(r))), None)
        return aggregate(out, *agg, self.rules.schema[rel]) if agg else out

    def once(self, stratum: Stratum, store: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """A stratum without recursion; lazy."""
        return {rel: self._joined(rel, stratum, store) for rel in stratum.heads}

    def _joined(self, rel: str, stratum: Stratum, store: dict[str, DataFrame]) -> DataFrame:
        """A relation without recursion. Where one rule's head fixes its joins, what is joined is made distinct and not what comes out: if all of it is a set already, or if a relation meets itself, which gives many more tuples than rows."""
        own = [r for r in stratum.rules if r.head.rel == rel]
        found = self.rules.unique(own[0], self.keys) if len(own) == 1 and f"+{rel}" not in store and not aggregate_of(own[0]) else None
        if found is None:
            return self._derive(rel, stratum, store, store.get(f"+{rel}"))
        repeated, self.found[rel] = found
        atoms = Counter(p.rel for p in own[0].body if isinstance(p, Atom) and not p.negated)
        if repeated and max(atoms.values()) < 2:
            return self._derive(rel, stratum, store, None)
        return self.rules.tuples(own[0], lambda i, name: store[name], self.rules.distinct_atoms(own[0], repeated, store), self.rules.pairs(own[0]))

    def note(self, stratum: Stratum) -> None:
        """A stratum's relations are sets from now on; what their keys are."""
        for rel in stratum.heads:
            agg = next((a for r in stratum.rules if r.head.rel == rel and (a := aggregate_of(r))), None)
            every = tuple(range(len(self.rules.schema[rel])))
            self.keys[rel] = tuple(i for i in every if i != agg[1]) if agg else self.found.pop(rel, every)

    def run(self, stratum: Stratum, store: dict[str, DataFrame]) -> dict[str, DataFrame]:
        heads = set(stratum.heads)
        aggregates = {r.head.rel: aggregate_of(r) for r in stratum.rules}
        monotone = all(a is None or a[0] in ("min", "max") for a in aggregates.values()) and not any(isinstance(p, Atom) and p.negated and p.rel in heads for r in stratum.rules for p in r.body)
        return self.semi_naive(stratum, store) if monotone else self.naive(stratum, store)

    # semi-naive
    def semi_naive(self, stratum: Stratum, store: dict[str, DataFrame], parts: dict | None = None, delta: dict | None = None, kept: dict[str, list[DataFrame]] | None = None) -> dict[str, DataFrame]:
        """The least fixpoint; with parts and delta, from a state on in which the delta is new. kept: gets each round's new tuples, whose tables then stay."""
        rules, heads = self.rules, stratum.heads
        aggregates = {rel: next((a for r in stratum.rules if r.head.rel == rel and (a := aggregate_of(r))), None) for rel in heads}
        recursive = [(r, [i for i, p in enumerate(r.body) if isinstance(p, Atom) and p.rel in heads]) for r in stratum.rules]
        invariant = {p.rel: store[p.rel] for r in stratum.rules for p in r.body if isinstance(p, Atom) and p.rel not in heads}
        tasks = int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        # what doesn't change in the loop is kept; a lost part is computed again
        fixed = {n: {i: df.persist() for i, df in rules.fixed(r, invariant, set(heads), tasks).items()} for n, (r, at) in enumerate(recursive) if at}
        try:
            return self._rounds(heads, aggregates, recursive, fixed, invariant, store, parts, delta, tasks, kept)
        finally:
            for frames in fixed.values():
                for df in frames.values():
                    df.unpersist()

    def _rounds(self, heads: list[str], aggregates: dict, recursive: list, fixed: dict, invariant: dict, store: dict, parts: dict | None, delta: dict | None, tasks: int, kept: dict | None) -> dict[str, DataFrame]:
        rules, given = self.rules, parts is not None
        parts, delta = parts or {}, delta or {}
        firsts = {}
        for rel in [] if given else heads:
            start = [store[f"+{rel}"]] if f"+{rel}" in store else []
            start += [rules.tuples(r, lambda i, name: invariant[name]) for r, at in recursive if r.head.rel == rel and not at]
            first = union(start).distinct() if start else rules.empty(rel)
            firsts[rel] = aggregate(first, *aggregates[rel], rules.schema[rel]) if aggregates[rel] else first
        for rel, (df, n, name) in self._written(firsts).items():
            parts[rel], delta[rel] = [(df, name)], (df, n)
        sizes = {rel: delta[rel][1] for rel in heads}
        old: dict[str, DataFrame | None] = dict.fromkeys(heads)
        for round_ in range(1, self.limit + 2):
            if not any(n for _, n in delta.values()):
                return {rel: self._whole(rel, parts[rel], aggregates[rel]) for rel in heads}
            began = time.time()
            now = {rel: self._whole(rel, parts[rel], aggregates[rel]) for rel in heads}
            jobs: dict[str, DataFrame] = {}
            for rel in heads:
                new = []
                for n, (r, at) in enumerate(recursive):
                    if r.head.rel != rel:
                        continue
                    for k, i in enumerate(at):
                        if not delta[r.body[i].rel][1]:
                            continue

                        def frame(j: int, name: str, i=i, at=at, k=k) -> DataFrame:
                            if j == i:
                                return delta[name][0]
                            before = j in at[:k]
                            if before or aggregates[name] or old[name] is None:
                                return now[name] if before or aggregates[name] else rules.empty(name)
                            return old[name]

                        new.append(rules.tuples(r, frame, fixed[n]))
                if new:
                    jobs[rel] = self._fresh(rel, union(new), parts[rel], aggregates[rel])
            fresh = self._written(jobs)
            for rel in heads:
                if rel not in fresh or not fresh[rel][1]:
                    delta[rel], old[rel] = (rules.empty(rel), 0), now[rel]
                    continue
                df, n, name = fresh[rel]
                parts[rel].append((df, name if kept is None else None))
                sizes[rel] += n
                if kept is not None:
                    kept[rel].append(df)
                if len(parts[rel]) > PARTS:
                    self._merge(rel, parts, aggregates[rel], sizes, tasks)
                old[rel] = union([x for x, _ in parts[rel][:-1]]) if len(parts[rel]) > 1 else now[rel]
                delta[rel] = (df, n)
                self.report(relation=rel, round=round_, rows=n, seconds=round(time.time() - began, 3))
        raise DivergenceProblem(f"{', '.join(heads)} didn't settle within {self.limit} rounds")

    def _written(self, frames: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, int, str]]:
        """Tables of some frames, written side by side."""
        if len(frames) < 2:
            return {rel: self.scratch.counted(df) for rel, df in frames.items()}
        with ThreadPoolExecutor(len(frames)) as pool:
            return dict(zip(frames, pool.map(self.scratch.counted, frames.values()), strict=True))

    def _merge(self, rel: str, parts: dict, agg: tuple[str, int] | None, sizes: dict, tasks: int) -> None:
        """All parts but the last become one."""
        names = columns_of(self.rules.schema[rel])
        keys = [c for c in names if agg is None or c != f"c{agg[1]}"]
        whole = self._whole(rel, parts[rel][:-1], agg)
        if sizes[rel] < BUCKETED or not keys:
            merged, n, name = self.scratch.counted(whole)
        else:
            merged, n, name = self.scratch.bucketed(whole, keys, tasks)
        gone = [x for _, x in parts[rel][:-1]]
        parts[rel] = [(merged, name), parts[rel][-1]]
        self.scratch.drop(*[x for x in gone if x])  # all of this round's tables are written

    def _whole(self, rel: str, parts: list[tuple[DataFrame, str]], agg: tuple[str, int] | None) -> DataFrame:
        """A relation's parts together; of an aggregated one's, the best value of each group."""
        out = union([df for df, _ in parts])
        return aggregate(out, *agg, self.rules.schema[rel]) if agg and len(parts) > 1 else out

    def _fresh(self, rel: str, new: DataFrame, parts: list[tuple[DataFrame, str]], agg: tuple[str, int] | None) -> DataFrame:
        """Tuples that aren't known yet, or values that are better than the known ones. A part in buckets is met by itself, so that only candidates move."""
        names = columns_of(self.rules.schema[rel])
        dealt = [df for df, name in parts if name in self.scratch.buckets]
        rest = [df for df, name in parts if name not in self.scratch.buckets]
        known = dealt + ([union(rest)] if rest else [])
        if agg is None:
            out = new.distinct()
            for df in known:
                out = out.join(df, names, "left_anti")
            return out.select(*names)
        op, at = agg
        out = aggregate(new, op, at, self.rules.schema[rel])
        keys = [c for c in names if c != f"c{at}"]
        for df in known:
            had = df.select(*[F.col(k).alias(f"h{k}") for k in keys], F.col(f"c{at}").alias("known"))
            good = F.col("known") <= F.col(f"c{at}") if op == "min" else F.col("known") >= F.col(f"c{at}")
            out = out.join(had, reduce(Column.__and__, [F.col(k) == F.col(f"h{k}") for k in keys], good), "left_anti")
        return out.select(*names)

    # naive
    def naive(self, stratum: Stratum, store: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Recursion through negation or other aggregates: whole relations are derived anew until they don't change."""
        now: dict[str, tuple] = {rel: (self.rules.empty(rel), 0, None) for rel in stratum.heads}
        for _ in range(self.limit + 1):
            frames = store | {rel: df for rel, (df, _, _) in now.items()}
            new = self._written({rel: self._derive(rel, stratum, frames, store.get(f"+{rel}")) for rel in stratum.heads})
            same = self._same(new, now)
            self._forget(now.values())
            now = new
            if same:
                return {rel: df for rel, (df, _, _) in now.items()}
        raise DivergenceProblem(f"{', '.join(stratum.heads)} didn't settle within {self.limit} rounds")

    @staticmethod
    def _same(a: dict[str, tuple], b: dict[str, tuple]) -> bool:
        """Are the sets equal? They are compared only where their sizes are."""
        return all(a[rel][1] == b[rel][1] for rel in a) and all(a[rel][0].join(b[rel][0], a[rel][0].columns, "left_anti").isEmpty() for rel in a if a[rel][1])

    def _forget(self, tables: Iterable[tuple], but: Iterable[tuple] = ()) -> None:
        """Delete tables that no later round reads."""
        kept = {name for _, _, name in but}
        self.scratch.drop(*{name for _, _, name in tables if name and name not in kept})

    def loop(self, stratum: Stratum, store: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """fixpoint and loop blocks. A relation's next value is its base and what its rules give; an iterative one's, what they give."""
        block: Loop = stratum.loop
        heads, iterative = stratum.heads, set(block.iterative)
        if block.kind == "fixpoint" and not iterative:
            return self.run(Stratum(stratum.rules, True), store)
        base = self._written({rel: (store[f"+{rel}"] if f"+{rel}" in store else self.rules.empty(rel)).distinct() for rel in heads})
        now = {rel: base[rel] if rel in iterative else (self.rules.empty(rel), 0, None) for rel in heads}
        for k in range(self.limit + 1):
            began = time.time()
            frames = store | {rel: df for rel, (df, _, _) in now.items()}
            new = self._written({rel: self._derive(rel, stratum, frames, None if rel in iterative else base[rel][0]) for rel in heads})
            self.report(relation=",".join(heads), round=k, rows=sum(n for _, n, _ in new.values()), seconds=round(time.time() - began, 3))
            going = block.windows is None or any(a <= k <= b for a, b in block.windows)
            fired = block.until is not None and (all if block.until_all else any)(new[u][1] > 0 for u in block.until)
            if block.windows is not None and block.until is not None:
                go = going and not fired if block.either else going or not fired
            else:
                go = going and not fired
            after = new
            if iterative:  # in a mixed block, accumulated relations keep what they have
                after = {rel: x if rel in iterative else self.scratch.counted(x[0].union(now[rel][0]).distinct()) for rel, x in new.items()}
                self._forget(new.values(), after.values())
            if not go:
                return {rel: df for rel, (df, _, _) in (now if iterative else after).items()}
            same = self._same(after, now)
            self._forget(now.values(), base.values())
            now = after
            if same:
                return {rel: df for rel, (df, _, _) in now.items()}
        raise DivergenceProblem(f"{', '.join(heads)} didn't settle within {self.limit} rounds")
