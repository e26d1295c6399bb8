"""Errors of programs and of their use. Each names the place in the source where it is known."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache


@lru_cache(64)
def _lines(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, and where each starts."""
    lines, starts = text.split("\n"), [0]
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    return lines, starts


class Place(int):
    """A line's number that knows its column (from 1), its file (None: the program's own text) and the line's text."""

    column: int
    file: str | None
    text: str

    @classmethod
    def of(cls, text: str, offset: int, file: str | None = None) -> Place:
        lines, starts = _lines(text)
        out = cls(bisect_right(starts, offset))
        out.column, out.file, out.text = offset - starts[out - 1] + 1, file, lines[out - 1].rstrip("\r")
        return out

    def name(self) -> str:
        return f"line {int(self)}, column {self.column}" + (f" of {self.file}" if self.file else "")

    def excerpt(self) -> str:
        """The line, and a mark below the column."""
        pad = "".join("\t" if c == "\t" else " " for c in self.text[: self.column - 1])
        return f"{self.text}\n{pad}^"


class QuernError(Exception):
    """Any error of this package. excerpt shows its place in the program, where it is known."""

    def __init__(self, message: str, line: int | None = None):
        place = isinstance(line, Place)
        super().__init__(f"{line.name() if place else f'line {line}'}: {message}" if line else message)
        self.line = line
        self.column = line.column if place else None
        self.excerpt = line.excerpt() if place else ""


class SyntaxProblem(QuernError):
    """The text isn't a program."""


class IncludeProblem(QuernError):
    """A file isn't found, or includes itself."""


class DeclarationProblem(QuernError):
    """A name is declared twice or not at all, or a directive doesn't fit it."""


class TypeProblem(QuernError):
    """Types, arities or literal ranges don't fit."""


class RuleProblem(QuernError):
    """A rule isn't safe: unbound variables, aggregates out of place, plans that aren't permutations."""


class StratificationProblem(QuernError):
    """Blocks refer forward, or a loop's conditions don't fit its rules."""


class EngineProblem(QuernError):
    """The engine was used in a wrong way: unknown relations, commits without a transaction."""


class DivergenceProblem(QuernError):
    """A fixpoint didn't settle within the iteration limit."""
