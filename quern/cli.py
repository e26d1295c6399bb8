"""python -m quern.cli program.dl -F facts -D out: run a program on files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import QuernError
from .report import page, write_json
from .streaming.incremental import IncrementalEngine
from .streaming.repl import run_script

MODES = {"datalog-batch": (Engine, False), "datalog-inc": (IncrementalEngine, False), "extend-batch": (Engine, True), "extend-inc": (IncrementalEngine, True)}


def functions_of(path: str | None) -> dict:
    """The functions of a Python file, for `.extern fn`."""
    if not path:
        return {}
    names: dict = {}
    exec(compile(Path(path).read_text(), path, "exec"), names)  # noqa: S102 - the user's own file
    return {k: v for k, v in names.items() if callable(v) and not k.startswith("_")}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("program")
    p.add_argument("-F", "--facts", help="folder of input files")
    p.add_argument("-D", "--output", default=".", help="folder of output files, or - to print rows")
    p.add_argument("-I", "--include", action="append", default=[], help="folder of included programs")
    p.add_argument("--mode", choices=MODES, default="datalog-batch")
    p.add_argument("--udf-file", help="Python file with the external functions")
    p.add_argument("--parts", action="store_true", help="outputs are folders of part files, written in parallel")
    p.add_argument("--sip", action="store_true", help="reduce joins by sweeps of semi joins")
    p.add_argument("--max-rounds", type=int, default=65535)
    p.add_argument("--profile", help="write strata and rounds to this JSON file, and a page beside it")
    p.add_argument("--explain", action="store_true", help="print strata and rounds")
    a = p.parse_args(argv)
    try:
        return _run(a, spark)
    except QuernError as e:
        print(*filter(None, (f"error: {e}", e.excerpt)), sep="\n", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession | None) -> int:
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    kind, extended = MODES[a.mode]
    options = {"facts": a.facts, "include": a.include, "functions": functions_of(a.udf_file), "sip": a.sip, "max_rounds": a.max_rounds, "extended": extended}
    engine = kind.from_file(spark, a.program, **options)

    def show(results: dict) -> None:
        for name, x in results.items():
            if hasattr(x, "toLocalIterator"):
                for r in x.toLocalIterator():
                    row, diff = (tuple(r)[:-1], r["diff"]) if isinstance(engine, IncrementalEngine) else (tuple(r), 1)
                    print(f"[tuple][{name}] t={getattr(engine, 'epoch', 0)} data={row} diff={diff:+d}")
            else:
                print(f"[size][{name}] t={getattr(engine, 'epoch', 0)} size={x}")

    def delta(results: dict) -> None:
        show(results) if a.output == "-" else engine.write_delta(a.output, results)

    if isinstance(engine, IncrementalEngine):
        delta(engine.preload())
        run_script(engine, sys.stdin, delta)
    elif a.output == "-":
        show(engine.run())
    else:
        engine.write(a.output, a.parts)
    if a.profile:
        write_json(engine, a.profile)
        Path(a.profile).with_suffix(".html").write_text(page(engine))
    if a.explain:
        print(engine.explain())
    return 0


if __name__ == "__main__":
    sys.exit(main())
