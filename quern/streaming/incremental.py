"""Transactions over a program's inputs; each commit gives the signed changes of its outputs.

An input keeps signed counts of its rows, as a log of changes that is merged from time to time, and shows
the rows whose count is positive. A commit carries what the inputs gained and lost through the strata that
depend on it (see maintain), so its work grows with the changes and what they touch. All state is in written
tables in the shared folder; a commit that fails leaves the engine, and the transaction, as they were.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import EngineProblem
from ..operators.rules import UNIT, columns_of, union
from ..plans.ast import Atom
from ..sources.files import lines_of, read_delimited, write_lines
from .maintain import Changes, Maintenance

#: Tables of a relation above which they are merged into one.
PARTS = 8


class IncrementalEngine(Engine):
    """An engine that keeps its inputs between commits."""

    def __init__(self, spark: SparkSession, program: str, **options):
        super().__init__(spark, program, **options)
        self.epoch = 0
        self._log: dict[str, list[tuple[DataFrame, str]]] = {}  # signed counts of inputs
        self._whole: dict[str, list[tuple[DataFrame, str | None]]] = {}  # relations; None: a table that a caller may still read
        self._changes: dict[str, list[DataFrame]] | None = None
        heads = [h for s in self.program.strata for h in s.heads]
        #: Is no relation derived by more than one stratum? Otherwise (blocks) all is evaluated again.
        self._simple = len(heads) == len(set(heads))
        self.maintenance = Maintenance(self.rules, self.fixpoint, self.scratch)

    # transactions
    def begin(self) -> None:
        if self._changes is not None:
            raise EngineProblem("a transaction is open already")
        self._changes = {}

    def change(self, rel: str, df: DataFrame, diff: int = 1) -> None:
        """Add a frame's rows (columns c0, c1, ...) with a sign; opens a transaction if none is."""
        if self._changes is None:
            self.begin()
        self._changes.setdefault(self._key(rel), []).append(df.withColumn("diff", F.lit(diff).cast("long")))

    def insert(self, rel: str, rows: Iterable[tuple], diff: int = 1) -> IncrementalEngine:
        rows = list(rows)
        key = self._key(rel)
        if rows:
            self.change(key, self.frame(key, rows), diff)
        return self

    def remove(self, rel: str, rows: Iterable[tuple]) -> IncrementalEngine:
        return self.insert(rel, rows, -1)

    def set(self, rel: str) -> IncrementalEngine:
        return self.insert(rel, [()])

    def unset(self, rel: str) -> IncrementalEngine:
        return self.insert(rel, [()], -1)

    def load(self, rel: str, path: str, diff: int = 1) -> IncrementalEngine:
        """Add a delimited file's rows."""
        key = self._key(rel)
        r = self.program.relations[key].input or {}
        self.change(key, read_delimited(self.spark, path, self.program.schema[key], r.get("delimiter", "\t")), diff)
        return self

    def abort(self) -> None:
        self._changes = None

    rollback = abort

    def commit(self) -> dict[str, DataFrame | int]:
        """Signed changes by output: DataFrames with a last column diff (+1, -1); for .printsize the change of the size."""
        if self._changes is None:
            raise EngineProblem("no transaction is open")
        log, whole, gone = dict(self._log), dict(self._whole), []
        plus, minus = self._input_changes(log, gone)
        if self.epoch and self._simple:
            self._carry(whole, plus, minus, gone)
        else:
            plus, minus = self._evaluated(log, whole, plus, minus)
        result = {}
        for key in self.wanted:
            r = self.program.relations[key]
            parts = [x[key].withColumn("diff", F.lit(n)) for x, n in ((plus, 1), (minus, -1)) if key in x]
            delta = union(parts) if parts else self.rules.empty(key).withColumn("diff", F.lit(1))
            if r.printsize:
                result[r.name] = int(delta.agg(F.coalesce(F.sum("diff"), F.lit(0))).first()[0])
            else:
                result[r.name] = delta.toDF(*([n for n, _ in r.attrs] or [UNIT]), "diff")
        # nothing fails from here on
        self._log, self._whole, self._changes = log, whole, None
        self.epoch += 1
        self.scratch.drop(*gone)
        return result

    def _input_changes(self, log: dict, gone: list[str]) -> tuple[Changes, Changes]:
        """What the transaction adds to and takes from the inputs' visible rows; their counts go to the log."""
        plus, minus = {}, {}
        for key, frames in self._changes.items():
            names = columns_of(self.program.schema[key])
            change, n, name = self.scratch.counted(union(frames).groupBy(*names).agg(F.sum("diff").alias("diff")).where("diff <> 0"))
            if not n:
                continue
            before = [df for df, _ in log.get(key, [])]
            had = [change.select(*names, "diff", F.lit(0).cast("long").alias("had"))]
            if before:  # only the changed rows' counts are summed
                had.append(union(before).join(change.select(*names), names, "left_semi").select(*names, F.lit(0).cast("long").alias("diff"), F.col("diff").alias("had")))
            # without counts before, the change is already grouped and written
            moved = self.scratch.counted(union(had).groupBy(*names).agg(F.sum("diff").alias("diff"), F.sum("had").alias("had")))[0] if before else had[0]
            rows = super().base(key) if self.epoch else None  # rows that are there whatever the counts say
            for x, how in ((plus, "had <= 0 and had + diff > 0"), (minus, "had > 0 and had + diff <= 0")):
                found = moved.where(how).select(*names)
                found = self.maintenance._some(found if rows is None else found.join(rows, names, "left_anti"))
                if found is not None:
                    x[key] = found
            log[key] = [*log.get(key, []), (change, name)]
            if len(log[key]) > PARTS:
                merged = self.scratch.counted(union([df for df, _ in log[key]]).groupBy(*names).agg(F.sum("diff").alias("diff")).where("diff <> 0"))
                gone += [x for _, x in log[key]]
                log[key] = [merged[::2]]
        return plus, minus

    def _frame(self, whole: dict, rel: str) -> DataFrame:
        return union([df for df, _ in whole[rel]])

    def _moved(self, whole: dict, rel: str, plus: DataFrame | None, minus: DataFrame | None, gone: list[str]) -> None:
        """A relation's tables after a change: one more, or one new."""
        names, old = columns_of(self.rules.schema[rel.lstrip("+")]), whole[rel]
        parts = old + ([(plus.select(*names), None)] if plus is not None else [])
        if minus is None and len(parts) <= PARTS:
            whole[rel] = parts
            return
        rows = union([df for df, _ in old])
        rows = rows if minus is None else rows.join(minus, names, "left_anti").select(*names)
        whole[rel] = [self.scratch.counted(rows if plus is None else rows.union(plus.select(*names)))[::2]]
        gone += [name for _, name in old if name]

    def _carry(self, whole: dict, plus: Changes, minus: Changes, gone: list[str]) -> None:
        """Carry changes through the strata; plus and minus get those of derived relations."""
        heads = {h for s in self.program.strata for h in s.heads}
        old = {rel: self._frame(whole, rel) for rel in whole}
        for rel in set(plus) | set(minus):
            key = f"+{rel}" if rel in heads else rel
            if key in whole:
                self._moved(whole, key, plus.get(rel), minus.get(rel), gone)
        for rel in heads:  # a derived relation's own rows
            for x in (plus, minus):
                if rel in x:
                    x[f"+{rel}"] = x.pop(rel)
        for s in self.program.strata:
            seen = {p.rel for r in s.rules for p in r.body if isinstance(p, Atom)} | {f"+{h}" for h in s.heads}
            if not seen & (set(plus) | set(minus)):
                continue
            new = {rel: self._frame(whole, rel) for rel in whole}
            now, gained, lost = self.maintenance.stratum(s, old, new, plus, minus)
            for rel in s.heads:
                if now[rel] is None:
                    if gained[rel] is not None or lost[rel] is not None:
                        self._moved(whole, rel, gained[rel], lost[rel], gone)
                else:
                    gone += [name for _, name in whole[rel] if name]
                    whole[rel] = [now[rel]]
                plus |= {rel: gained[rel]} if gained[rel] is not None else {}
                minus |= {rel: lost[rel]} if lost[rel] is not None else {}

    def _evaluated(self, log: dict, whole: dict, plus: Changes, minus: Changes) -> tuple[Changes, Changes]:
        """Evaluate all strata; the relations become tables, and outputs are compared with those before."""
        rows = lambda key: self._visible(key, log)
        store = super().evaluate(rows)
        heads = {h for s in self.program.strata for h in s.heads}
        for rel, df in store.items():
            if not rel.startswith("+"):
                whole[rel] = [self.scratch.counted(df if rel in heads else df.distinct())[::2]]
        for rel in heads:
            own = rows(rel)
            whole[f"+{rel}"] = [self.scratch.counted(own if own is not None else self.rules.empty(rel))[::2]]
        self.close()
        plus, minus = {}, {}  # of outputs
        for key in self.wanted:
            now, names = self._frame(whole, key), columns_of(self.program.schema[key])
            if key not in self._whole:
                plus[key] = now
                continue
            before = self._frame(self._whole, key)
            for x, a, b in ((plus, now, before), (minus, before, now)):
                found = self.maintenance._some(a.join(b, names, "left_anti").select(*names))
                if found is not None:
                    x[key] = found
        return plus, minus

    def _visible(self, key: str, log: dict) -> DataFrame | None:
        """A relation's rows that are given, or whose count is positive."""
        rows = super().base(key)
        parts = [] if rows is None else [rows]
        if log.get(key):
            names = columns_of(self.program.schema[key])
            parts.append(union([df for df, _ in log[key]]).groupBy(*names).agg(F.sum("diff").alias("diff")).where("diff > 0").select(*names))
        return union(parts).distinct() if parts else None

    def base(self, key: str) -> DataFrame | None:
        return self._visible(key, self._log)

    def preload(self) -> dict:
        """The first epoch: what files and facts hold. Their rows become counts, so that they can be removed."""
        for key, r in self.program.relations.items():
            if r.input is not None or key in self.program.facts or key in self._bound:
                rows = super().base(key)
                if rows is not None:
                    self.change(key, rows)
        if self._changes is None:
            self.begin()
        self.program.facts.clear()
        for r in self.program.relations.values():
            if r.input is not None:
                r.input = r.input | {"IO": "command"}
        self._bound.clear()
        return self.commit()

    def write_delta(self, folder: str, delta: dict) -> None:
        """Files `<name>_t<epoch><suffix>` with the sign as last column."""
        for key in self.wanted:
            r = self.program.relations[key]
            spec = r.output or {}
            stem, dot, suffix = spec.get("filename", f"{r.name}.csv").rpartition(".")
            path = f"{folder}/{stem or suffix}_t{self.epoch}{dot}{suffix if stem else ''}"
            if r.printsize:
                lines = self.spark.createDataFrame([(str(delta[r.name]),)], "value string")
            else:
                types = self.program.schema[key]
                rows = delta[r.name].toDF(*columns_of(types), "diff")
                if types:
                    lines = lines_of(rows, types, spec.get("delimiter", "\t"), (F.when(F.col("diff") > 0, "+1").otherwise("-1"),))
                else:
                    lines = rows.select(F.lit("True").alias("value"))
            write_lines(lines, path)


def feed(engine: IncrementalEngine, rel: str, stream: DataFrame, on_delta, checkpoint: str | None = None):
    """Commit each micro-batch of a stream as a transaction of insertions; on_delta gets the changes and the batch's number.

    A stream with a column `diff` gives signed rows. With a checkpoint the batches are logged beside the stream's
    own state: a batch that comes again replaces its log and isn't counted twice, and an engine that starts anew
    first takes the batches before. The engine must then have no other transactions.
    """
    key = engine._key(rel)
    names = columns_of(engine.program.schema[key])
    last: list[int] = []

    def log(number: int) -> str:
        return f"{checkpoint}/quern-batches/batch={number}"

    def commit(rows: DataFrame) -> dict:
        engine.begin()
        engine._changes.setdefault(key, []).append(rows)
        try:
            return engine.commit()
        except Exception:
            engine.abort()
            raise

    def batch(df: DataFrame, number: int) -> None:
        if last and number <= last[0]:
            return
        signed = df if "diff" in df.columns else df.withColumn("diff", F.lit(1))
        rows = signed.toDF(*names, "diff").select(*[F.col(n).cast(f.dataType) for n, f in zip(names, engine.rules.empty(key).schema, strict=True)], F.col("diff").cast("long")).dropna("any")
        if checkpoint:
            if not last and number:
                commit(engine.spark.read.schema(rows.schema).parquet(*[log(i) for i in range(number)]))
            rows.write.mode("overwrite").parquet(log(number))
            rows = engine.spark.read.schema(rows.schema).parquet(log(number))
        delta = commit(rows)
        last[:] = [number]
        on_delta(delta, number)

    writer = stream.writeStream.foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
