"""Batch engine: a program over relations that are files, facts or DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineProblem
from .functions.scalars import PRIMITIVE, spark_type
from .operators.fixpoint import Fixpoint
from .operators.rules import UNIT, Rules, columns_of, ordinals, schema_of, strings, union
from .plans.ast import Atom
from .plans.program import Program, build
from .plans.types import BITS, limits
from .sources.files import lines_of, ordered, read_delimited, write_lines
from .tables import Scratch


class Engine:
    """One program.

    functions: for each `.extern fn`, a function of columns (SQL expressions, pandas UDFs), or a plain
    Python function, which is run as an Arrow-optimised UDF of the declared types.
    """

    def __init__(self, spark: SparkSession, program: str, *, folder: str | None = None, include: Iterable[str] = (), facts: str | None = None, functions: dict[str, Callable] | None = None, extended: bool | None = None, wanted: Iterable[str] | None = None, max_rounds: int = 65535, sip: bool = False):
        self.spark, self.facts_folder, self.max_rounds = spark, facts, max_rounds
        self.program: Program = build(program, folder=folder, folders=tuple(include), extended=extended, wanted=tuple(wanted) if wanted else None)
        self.wanted = [w.lower() for w in wanted] if wanted else self.program.outputs
        self.scratch = Scratch(spark, "engine")
        self.metrics: list[dict] = []
        self._bound: dict[str, DataFrame] = {}
        self._kept: list[DataFrame] = []
        self.rules = Rules(spark, self.program.schema, self._functions(functions or {}), sip)
        self.fixpoint = Fixpoint(self.rules, self.scratch, max_rounds, lambda **m: self.metrics.append(m))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **options) -> Engine:
        p = Path(path)
        return cls(spark, p.read_text(), folder=str(p.parent), **options)

    def _functions(self, given: dict[str, Callable]) -> dict[str, Callable]:
        out = {}
        for name, x in self.program.externs.items():
            if name not in given:
                continue
            f = given[name]
            if getattr(f, "on_columns", False) or hasattr(f, "returnType") or hasattr(f, "evalType"):
                out[name] = f
            else:
                out[name] = F.udf(f, PRIMITIVE[x.returns], useArrow=True)
        return out

    # input
    def _key(self, rel: str) -> str:
        key = rel.lower()
        if key not in self.program.relations:
            raise EngineProblem(f"relation {rel} isn't declared")
        return key

    def bind(self, rel: str, df: DataFrame) -> Engine:
        """Take a DataFrame as (more) rows of a relation: columns by position, cast to the declared types; rows with nulls are left out."""
        key = self._key(rel)
        types = self.program.schema[key]
        if len(df.columns) != len(types):
            raise EngineProblem(f"{rel} has {len(types)} columns, not {len(df.columns)}")
        renamed = df.toDF(*[f"x{i}" for i in range(len(types))])
        cells = [self._cast(F.col(f"x{i}"), f.dataType, t).alias(f"c{i}") for i, (t, f) in enumerate(zip(types, df.schema.fields, strict=True))]
        new = renamed.select(*cells).dropna("any") if types else df.limit(1).select(F.lit(True).alias(UNIT))
        self._bound[key] = self._bound[key].union(new) if key in self._bound else new
        return self

    @staticmethod
    def _cast(c, kind: T.DataType, t):
        if isinstance(kind, T.TimestampType) and t.prim in ("int64", "uint64"):
            return F.unix_micros(c).cast(PRIMITIVE[t.prim])
        return c if kind == spark_type(t) else c.cast(spark_type(t))

    def insert(self, rel: str, rows: Iterable[tuple]) -> Engine:
        """Take Python rows as rows of a relation."""
        key = self._key(rel)
        return self._add(key, self.frame(key, rows))

    def set(self, rel: str) -> Engine:
        """Make a nullary relation hold."""
        return self.insert(rel, [()])

    def _add(self, key: str, df: DataFrame) -> Engine:
        self._bound[key] = self._bound[key].union(df) if key in self._bound else df
        return self

    def frame(self, key: str, rows: Iterable[tuple]) -> DataFrame:
        types = self.program.schema[key]
        out = []
        for row in rows:
            row = tuple(row)
            if len(row) != len(types):
                raise EngineProblem(f"{key} has {len(types)} columns, not {len(row)}")
            out.append(tuple(self._value(v, t, key) for v, t in zip(row, types, strict=True)) or (True,))
        return self.spark.createDataFrame(out, schema_of(types))

    def _value(self, v, t, key: str):
        if t.prim is None:
            return tuple(self._value(x, f, key) for x, f in zip(v, t.fields, strict=True))
        if t.prim in BITS:
            low, high = limits(t.prim)
            if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
                raise EngineProblem(f"{v!r} isn't a {t} of {key}")
            if t.prim == "uint64":
                from decimal import Decimal

                return Decimal(v)
        if t.prim in ("f32", "f64"):
            return float(v)
        return v

    def base(self, key: str) -> DataFrame | None:
        """Rows that a relation has before any rule. They may repeat: rules give distinct heads, so only outputs need a set."""
        r, parts = self.program.relations[key], []
        if key in self._bound:
            parts.append(self._bound[key])
        elif r.input is not None and r.input.get("IO", "file") == "file":
            name = r.input.get("filename", f"{r.name}.facts")
            path = f"{self.facts_folder}/{name}" if self.facts_folder else name
            parts.append(read_delimited(self.spark, path, self.program.schema[key], r.input.get("delimiter", "\t"), r.input.get("header", "false").lower() == "true"))
        if key in self.program.facts:
            parts.append(self.frame(key, self.program.facts[key]))
        return union(parts) if parts else None

    # evaluation
    def _uses(self) -> Counter:
        uses = Counter(p.rel for s in self.program.strata for r in s.rules for p in r.body if isinstance(p, Atom))
        for s in self.program.strata:  # a naive loop reads what it needs every round
            if s.loop is not None:
                uses.update({p.rel: 8 for r in s.rules for p in r.body if isinstance(p, Atom)})
        uses.update(self.wanted)
        return uses

    def _numbers(self, frames: list[tuple[str, DataFrame]]) -> DataFrame:
        """(text, number) of the strings in the inputs and in the rules, in their order, from 0 on; a table."""
        texts = [df.select(F.col(f.name).alias("text")) for _, df in frames for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        constants = {c for s in self.program.strata for r in s.rules for c in strings(r)}
        texts.append(self.spark.createDataFrame([(c,) for c in sorted(constants)], "text string"))
        # sorted parts are counted, and each string's number is its place in its part and the sizes of the parts before
        dealt = union(texts).distinct().repartitionByRange("text").sortWithinPartitions("text")
        placed = self.scratch.counted(dealt.select("text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))[0]
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
        sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        return self.scratch.counted(placed.join(F.broadcast(sizes), "part").select("text", (F.col("before") + F.col("place")).cast("int").alias("number")))[0]

    def evaluate(self, base: Callable[[str], DataFrame | None] | None = None) -> dict[str, DataFrame]:
        """All relations' frames."""
        store: dict[str, DataFrame] = {}
        needed = {p.rel for s in self.program.strata for r in s.rules for p in r.body if isinstance(p, Atom)} | {r.head.rel for s in self.program.strata for r in s.rules} | set(self.wanted)
        uses = self._uses()
        for rel in needed:
            rows = (base or self.base)(rel)
            if rows is not None:
                store[f"+{rel}"] = rows
            store[rel] = rows if rows is not None else self.rules.empty(rel)
        if any(ordinals(r) for s in self.program.strata for r in s.rules):
            self.rules.numbers = self._numbers([(k[1:], df) for k, df in store.items() if k[0] == "+"])
        self.fixpoint.keys, self.fixpoint.found = {}, {}
        for s in self.program.strata:
            if s.loop is not None:
                new = self.fixpoint.loop(s, store)
            elif s.recursive:
                new = self.fixpoint.run(s, store)
            else:
                new = self.fixpoint.once(s, store)
                for rel, df in new.items():
                    if uses[rel] > 1:
                        new[rel] = df.persist()
                        self._kept.append(new[rel])
            for rel, df in new.items():
                store[rel] = store[f"+{rel}"] = df
            self.fixpoint.note(s)
        return store

    def named(self, key: str, df: DataFrame) -> DataFrame:
        """A frame under the relation's attribute names."""
        attrs = [n for n, _ in self.program.relations[key].attrs]
        return df.toDF(*attrs) if attrs else df

    def whole(self, key: str, store: dict[str, DataFrame]) -> DataFrame:
        """A relation's frame as a set."""
        return store[key] if key in self.program.derived else store[key].distinct()

    def output(self, key: str, store: dict[str, DataFrame]) -> DataFrame:
        r = self.program.relations[key]
        spec = r.output or {}
        return ordered(self.whole(key, store), spec.get("order_by"), spec.get("limit"), [n for n, _ in r.attrs])

    def run(self) -> dict[str, DataFrame | int | bool]:
        """Outputs by name: DataFrames; a bool for nullary relations; a count for .printsize."""
        store = self.evaluate()
        out: dict = {}
        for key in self.wanted:
            r = self.program.relations[key]
            if r.printsize:
                out[r.name] = self.whole(key, store).count()
            elif not r.attrs:
                out[r.name] = not store[key].isEmpty()
            else:
                out[r.name] = self.named(key, self.output(key, store))
        return out

    def query(self, rel: str) -> DataFrame:
        """One relation as a DataFrame (nullary: the column `unit`)."""
        key = self._key(rel)
        return self.named(key, self.output(key, self.evaluate()))

    def write(self, folder: str, parts: bool = False) -> None:
        """Write the outputs to files, `<Relation>.csv` unless the directive names them; with parts, to folders of that name, in parallel."""
        store = self.evaluate()
        for key in self.wanted:
            r = self.program.relations[key]
            spec = r.output or {}
            path = f"{folder}/{spec.get('filename', f'{r.name}.csv')}"
            if r.printsize:
                lines = self.spark.createDataFrame([(str(self.whole(key, store).count()),)], "value string")
            else:
                lines = lines_of(self.output(key, store), self.program.schema[key], spec.get("delimiter", "\t"))
            write_lines(lines, path, parts)

    def explain(self) -> str:
        """The strata and their rules' relations, and the rounds that the last evaluation took."""
        out = []
        for i, s in enumerate(self.program.strata):
            kind = s.loop.kind if s.loop else "recursive" if s.recursive else "plain"
            out.append(f"stratum {i} ({kind}): {', '.join(s.heads)}")
            out += [f"  line {r.line}: {r.head.rel} <- {', '.join(('!' if p.negated else '') + p.rel for p in r.body if isinstance(p, Atom))}" for r in s.rules]
        out += [f"round {m['round']} of {m['relation']}: {m['rows']} rows, {m['seconds']} s" for m in self.metrics]
        return "\n".join(out)

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()


def on_columns(f: Callable) -> Callable:
    """Marks a function that takes and gives columns."""
    f.on_columns = True
    return f


__all__ = ["Engine", "columns_of", "on_columns"]
