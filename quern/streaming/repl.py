"""Transaction commands: begin, put, file, commit, abort, help, quit."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterable

from ..errors import EngineProblem
from ..plans.types import BITS
from .incremental import IncrementalEngine

HELP = "txn | begin        open a transaction\nput R v1,v2 [n]    add a row n times (default +1)\nfile R path [n]    add a file's rows\ncommit | done      evaluate and give the changes\nabort | rollback   forget the transaction\nquit               leave"


def value(text: str, prim: str):
    if prim in BITS:
        return int(text)
    if prim in ("f32", "f64"):
        return float(text)
    if prim == "bool":
        if text.lower() not in ("true", "false"):
            raise EngineProblem(f"{text} isn't a bool")
        return text.lower() == "true"
    return re.sub(r'\\([tn\\"])', lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), text)


def row(engine: IncrementalEngine, rel: str, text: str) -> tuple:
    key = engine._key(rel)
    types = engine.program.schema[key]
    if not types:
        return () if text.lower() == "true" else None
    delimiter = (engine.program.relations[key].input or {}).get("delimiter", "\t")[:1]
    fields = text.split(delimiter)
    if len(fields) < len(types):
        raise EngineProblem(f"{rel} has {len(types)} columns, not {len(fields)}")
    return tuple(value(f.strip(), t.prim) for f, t in zip(fields, types))  # noqa: B905 - further fields are left out


def run_script(engine: IncrementalEngine, lines: Iterable[str], on_delta, say=print) -> None:
    """Run commands until quit or the end."""
    for line in lines:
        words = shlex.split(line, posix=True) if "\\" not in line else shlex.split(line.replace("\\", "\\\\"), posix=True)
        if not words:
            continue
        word = words[0].lower()
        if word in ("begin", "txn"):
            engine.begin()
        elif word == "put":
            if len(words) not in (3, 4):
                raise EngineProblem("put takes a relation, a row and a count")
            values, n = row(engine, words[1], words[2]), int(words[3]) if len(words) == 4 else 1
            if values is not None:
                engine.insert(words[1], [values], n)
        elif word == "file":
            engine.load(words[1], words[2], int(words[3]) if len(words) == 4 else 1)
        elif word in ("commit", "done"):
            on_delta(engine.commit())
        elif word in ("abort", "rollback"):
            engine.abort()
        elif word == "help":
            say(HELP)
        elif word in ("quit", "exit"):
            return
        else:
            say(f"unknown command {word}; try help")
