"""One rule as a DataFrame: filters, joins, semi joins, anti joins, projection.

A relation's frame has columns c0, c1, ...; a nullary relation has one constant column, `unit`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import full_match
from ..functions.scalars import Columns, literal, spark_type
from ..plans.ast import Agg, Atom, Bin, Call, Compare, Const, Item, Match, Rule, Tup, Typed, Var, Wild
from ..plans.program import variables
from ..plans.types import Type

UNIT = "unit"
#: Rows of a key from which on a relation's pairs with itself are dealt in cells, which are squares of so many rows.
CELL = 4096


def schema_of(types: tuple) -> T.StructType:
    if not types:
        return T.StructType([T.StructField(UNIT, T.BooleanType())])
    return T.StructType([T.StructField(f"c{i}", spark_type(t)) for i, t in enumerate(types)])


def columns_of(types: tuple) -> list[str]:
    return [f"c{i}" for i in range(len(types))] or [UNIT]


class Rules:
    """Lowers rules over a store of frames."""

    def __init__(self, spark: SparkSession, schema: dict[str, tuple], functions: dict[str, Callable], sip: bool = False):
        self.spark, self.schema, self.functions, self.sip = spark, schema, functions, sip
        self.numbers: DataFrame | None = None  # (text, number), for ord

    def empty(self, rel: str) -> DataFrame:
        return self.spark.createDataFrame([], schema_of(self.schema[rel]))

    def _plain(self, atom: Atom, frame: DataFrame, names: dict[str, str]) -> tuple[DataFrame, list[str]]:
        """Constants and repeated variables as filters; a column for each variable; nothing of the rest."""
        keep: dict[str, str] = {}
        for i, a in enumerate(atom.args):
            a, t = (a.of, a.type) if isinstance(a, Typed) else (a, None)
            c = F.col(f"c{i}")
            if isinstance(a, Const):
                frame = frame.where(c == literal(a.value, Type(a.kind)))
            elif isinstance(a, Var):
                if a.name in keep:
                    frame = frame.where(F.col(keep[a.name]) == c)
                else:
                    keep[a.name] = f"c{i}"
            elif not isinstance(a, Wild):
                raise TypeError(f"{a} isn't an argument")
        out = frame.select(*[F.col(c).alias(names[v]) for v, c in keep.items()]) if keep else frame.select(F.lit(True).alias(UNIT))
        return out, list(keep)

    @staticmethod
    def _names(rule: Rule) -> dict[str, str]:
        return {v: f"v{i}" for i, v in enumerate(dict.fromkeys(v for p in rule.body for v in variables(p)))}

    def fixed(self, rule: Rule, store: dict[str, DataFrame], changing: set[str], parts: int) -> dict[int, DataFrame]:
        """What doesn't change in a loop, by its place in the body: filtered, pruned, and dealt by the variables that it shares with what changes, so that rounds don't shuffle it."""
        names, out = self._names(rule), {}
        moving = {v for p in rule.body if isinstance(p, Atom) and p.rel in changing for v in variables(p)}
        for i, p in enumerate(rule.body):
            if isinstance(p, Atom) and p.rel not in changing:
                df, own = self._plain(p, store[p.rel], names)
                key = own if p.negated else [v for v in own if v in moving]
                out[i] = df.repartition(parts, *[names[v] for v in key]) if key else df
        return out

    def unique(self, rule: Rule, keys: dict[str, tuple[int, ...]]) -> tuple[dict[int, list[str]], tuple[int, ...]] | None:
        """Of a rule whose head fixes all variables that its atoms are joined with, so that head tuples are distinct if the atoms' rows are: the places of the atoms whose rows may repeat, with the variables needed of them, and the head's places that are a key. keys: of relations that are sets."""
        atoms = {i: p for i, p in enumerate(rule.body) if isinstance(p, Atom) and not p.negated}
        if not atoms or ordinals(rule):
            return None
        bare = lambda a: a.of if isinstance(a, Typed) else a
        kinds = {v.name: t for p in atoms.values() for a, t in zip(p.args, self.schema[p.rel], strict=True) if isinstance(v := bare(a), Var)}
        rest = set(variables(rule.head)) | {v for i, p in enumerate(rule.body) if i not in atoms for v in variables(p)}
        needed = {i: [v for v in dict.fromkeys(variables(p)) if v in rest or any(v in variables(q) for j, q in atoms.items() if j != i)] for i, p in atoms.items()}
        wanted = {v for vs in needed.values() for v in vs}
        head = {i: v.name for i, (a, t) in enumerate(zip(rule.head.args, self.schema[rule.head.rel], strict=True)) if isinstance(v := bare(a), Var) and v.name in kinds and spark_type(kinds[v.name]) == spark_type(t)}

        def fixes(places: tuple[int, ...]) -> bool:
            found, before = {head[i] for i in places}, -1
            while len(found) > before:
                before = len(found)
                for p in atoms.values():
                    if p.rel in keys and all(isinstance(k := bare(p.args[i]), Const) or isinstance(k, Var) and k.name in found for i in keys[p.rel]):
                        found |= set(variables(p))
            return wanted <= found

        key = tuple(head)
        if not fixes(key):
            return None
        for i in reversed(key):
            if fixes(fewer := tuple(k for k in key if k != i)):
                key = fewer
        own = lambda i, p: p.rel in keys and all(isinstance(k := bare(p.args[j]), Const) or isinstance(k, Var) and k.name in needed[i] for j in keys[p.rel])
        return {i: needed[i] for i, p in atoms.items() if needed[i] and not own(i, p)}, key

    def distinct_atoms(self, rule: Rule, repeated: dict[int, list[str]], frames: dict[str, DataFrame]) -> dict[int, DataFrame]:
        """The atoms whose rows may repeat, filtered, pruned and made distinct."""
        names = self._names(rule)
        return {i: self._plain(rule.body[i], frames[rule.body[i].rel], names)[0].select(*[names[v] for v in vs]).distinct() for i, vs in repeated.items()}

    def bindings(self, rule: Rule, frame: Callable[[int, str], DataFrame], fixed: dict[int, DataFrame] | None = None, cells: bool = False) -> tuple[DataFrame, Columns]:
        """The rule's body. frame: of the i-th body predicate, an atom of a relation; fixed: frames that are filtered and pruned already; cells: deal the pairs of large keys in cells."""
        names = self._names(rule)

        def plain(i: int, p: Atom) -> tuple[DataFrame, list[str]]:
            if fixed is not None and i in fixed:
                return fixed[i], list(dict.fromkeys(v for v in variables(p)))
            return self._plain(p, frame(i, p.rel), names)

        cols = Columns(lambda v: F.col(names[v]), self.functions)
        atoms = [(i, p) for i, p in enumerate(rule.body) if isinstance(p, Atom) and not p.negated]
        atoms = [atoms[k - 1] for k in rule.plan] if rule.plan else connected(atoms)
        rest = [p for p in rule.body if not (isinstance(p, Atom) and not p.negated)]
        used = set(variables(rule.head)) | {v for p in rest for v in variables(p)}
        parts = [plain(i, p) for i, p in atoms]
        if self.sip and len(parts) >= 3:
            parts = self._sweep(parts, names)
        now: DataFrame | None = None
        have: list[str] = []
        for k, (df, own) in enumerate(parts):
            later = used | {v for _, vs in parts[k + 1 :] for v in vs}
            if now is None:
                have = [v for v in own if v in later]
                now = df.select(*[names[v] for v in have]) if have else df.select(F.lit(True).alias(UNIT)).limit(1)
                continue
            shared, new = [v for v in own if v in have], [v for v in own if v not in have and v in later]
            if not shared and not new:  # a gate: does the relation hold anything?
                now = now.join(F.broadcast(df.select(F.lit(True).alias("gate")).limit(1)), F.lit(True), "left_semi")
            elif not shared:
                now = now.crossJoin(df.select(*[names[v] for v in new]))
            elif not new:
                now = now.join(df.select(*[names[v] for v in shared]), [names[v] for v in shared], "left_semi")
            elif cells:
                now = self._celled(now, df.select(*[names[v] for v in shared + new]), [names[v] for v in shared])
            else:
                now = now.join(df.select(*[names[v] for v in shared + new]), [names[v] for v in shared])
            have = have + new
        if now is None:
            now = self.spark.range(1).select(F.lit(True).alias(UNIT))
        for n, call in enumerate(ordinals(rule) if self.numbers is not None else []):
            found = self.numbers.select(F.col("text").alias(f"text{n}"), F.col("number").alias(f"number{n}"))
            now = now.join(found, cols(call.args[0]) == F.col(f"text{n}"), "left").drop(f"text{n}")
            cols.ordinals[call] = F.col(f"number{n}")
        for p in rest:
            if isinstance(p, Compare):
                left, right = cols(p.left), cols(p.right)
                now = now.where({"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[p.op])
            elif not isinstance(p, Atom):
                s = cols(p.text)
                if p.kind == "contains":
                    hold = F.contains(s, cols(p.pattern))
                else:
                    hold = full_match(p.pattern.of.value if isinstance(p.pattern.of, Const) else cols(p.pattern), s)
                now = now.where(~hold if p.negated else hold)
        for i, p in enumerate(rule.body):
            if isinstance(p, Atom) and p.negated:
                df, own = plain(i, p)
                if own:
                    now = now.join(df, [names[v] for v in own], "left_anti")
                else:
                    now = now.join(F.broadcast(df.select(F.lit(True).alias("gate")).limit(1)), F.lit(True), "left_anti")
        return now, cols

    @staticmethod
    def pairs(rule: Rule) -> bool:
        """Does a relation meet itself on variables that the head leaves out, so that each key gives all pairs of its rows?"""
        atoms = [p for p in rule.body if isinstance(p, Atom) and not p.negated]
        if len(atoms) != 2 or atoms[0].rel != atoms[1].rel:
            return False
        shared = set(variables(atoms[0])) & set(variables(atoms[1]))
        return bool(shared) and not shared & set(variables(rule.head))

    def _celled(self, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """A join in which the pairs of a key with many rows are dealt to tasks as the cells of a square. Nothing but the sizes of such keys is broadcast."""
        large = F.broadcast(right.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL).select(*on, F.ceil(F.col("size") / CELL).alias("side")))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
            side = F.coalesce(F.col("side"), F.lit(1).cast("long"))
            place = F.pmod(F.xxhash64(*df.columns), side).alias(mine)
            return df.join(large, on, "left").select(*df.columns, place, F.explode(F.sequence(F.lit(0).cast("long"), side - 1)).alias(other)).repartition(tasks, *on, "row", "column")

        return dealt(left, "row", "column").join(dealt(right, "column", "row"), [*on, "row", "column"]).drop("row", "column")

    @staticmethod
    def _sweep(parts: list, names: dict[str, str]) -> list:
        """Sideways information passing: a forward and a backward sweep of semi joins."""
        frames = [df for df, _ in parts]
        for order in (range(1, len(parts)), range(len(parts) - 2, -1, -1)):
            step = -1 if order.step > 0 else 1
            for i in order:
                shared = [v for v in parts[i][1] if v in parts[i + step][1]]
                if shared:
                    on = [names[v] for v in shared]
                    frames[i] = frames[i].join(frames[i + step].select(*on), on, "left_semi")
        return [(df, own) for df, (_, own) in zip(frames, parts, strict=True)]

    def tuples(self, rule: Rule, frame: Callable[[int, str], DataFrame], fixed: dict[int, DataFrame] | None = None, cells: bool = False) -> DataFrame:
        """Head tuples, an aggregate's argument in its place; they may repeat."""
        now, cols = self.bindings(rule, frame, fixed, cells)
        types = self.schema[rule.head.rel]
        if not types:
            return now.select(F.lit(True).alias(UNIT)).limit(1)
        out = []
        for i, (a, t) in enumerate(zip(rule.head.args, types, strict=True)):
            counted = isinstance(a, Agg) and a.op == "count"
            e = cols(a.of if isinstance(a, Agg) else a)
            out.append((e if counted else e.cast(spark_type(t))).alias(f"c{i}"))
        return now.select(*out)


def parts_of(e) -> list:
    """An expression or predicate and all in it, inner ones first."""
    of = {Typed: lambda: [e.of], Agg: lambda: [e.of], Item: lambda: [e.of], Bin: lambda: [e.left, e.right], Compare: lambda: [e.left, e.right], Match: lambda: [e.pattern, e.text], Tup: lambda: e.items, Call: lambda: e.args, Atom: lambda: e.args}
    return [y for x in of.get(type(e), list)() for y in parts_of(x)] + [e]


def ordinals(rule: Rule) -> list[Call]:
    """The calls of ord in a rule, inner ones first."""
    return list(dict.fromkeys(e for p in (*rule.body, rule.head) for e in parts_of(p) if isinstance(e, Call) and e.name == "ord"))


def strings(rule: Rule) -> set[str]:
    """The string constants in a rule."""
    return {e.value for p in (*rule.body, rule.head) for e in parts_of(p) if isinstance(e, Const) and isinstance(e.value, str)}


def connected(atoms: list[tuple[int, Atom]]) -> list[tuple[int, Atom]]:
    """Atoms in source order, but next comes one that shares a variable with those before (or has none), as long as one does."""
    left, out, bound = list(atoms), [], set()
    while left:
        near = [x for x in left if not (own := set(variables(x[1]))) or own & bound]
        now = near[0] if near and out else left[0]
        left.remove(now)
        out.append(now)
        bound |= set(variables(now[1]))
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)
