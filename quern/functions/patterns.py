"""Patterns of `match`: Unicode classes, named groups and POSIX sets, without look-around or back-references.

A constant pattern is translated to Java's dialect and checked on the driver, so that it runs inside the
JVM; a pattern that isn't valid matches nothing. A pattern out of a column can't be checked beforehand:
it is matched in Arrow batches, where an invalid one matches nothing either.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The POSIX sets, ASCII only.
POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}


def _set(pattern: str, at: int) -> tuple[str, int] | None:
    """A bracketed set from `[` on, in Java's dialect, and the place after it."""
    out, i = ["["], at + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return "".join([*out, "]"]), i + 1
        posix = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)
        if posix:
            if posix[2] not in POSIX:
                return None
            out.append(f"[^{POSIX[posix[2]]}]" if posix[1] else POSIX[posix[2]])
            i = posix.end()
        elif c == "[":
            inner = _set(pattern, i)
            if inner is None:
                return None
            out.append(inner[0])
            i = inner[1]
        elif c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif pattern[i : i + 2] in ("--", "~~"):  # difference and symmetric difference
            rest = _set("[" + pattern[i + 2 :], 0)
            if rest is None or pattern[i : i + 2] == "~~":
                return None
            body = "".join(out)
            return f"[{body}]&&[^{rest[0][1:-1]}]]", i + 1 + rest[1]
        else:
            out.append("\\" + c if c in "]^" and first or c == "#" or c == " " else c)
            i += 1
        first = False
    return None


def java_pattern(pattern: str) -> str | None:
    """A pattern in Java's dialect; None if it isn't valid, as far as can be seen without Java."""
    out, i, names = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if len(two) < 2 or two[1] in "123456789kGQERXNhHVZ":  # back-references and Java's own escapes
                return None
            if two[1] in "pP" and (named := re.compile(r"\\([pP])\{(\^?)([A-Za-z_ ]+)\}").match(pattern, i)):
                kind = named[1] if not named[2] else "pP"["Pp".index(named[1])]
                name = named[3].replace(" ", "_")
                out.append(f"\\{kind}{{{name if len(name) <= 2 else 'Is' + name}}}")
                i = named.end()
                continue
            elif re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\[uU]\{[0-9A-Fa-f]+\}").match(pattern, i):
                end = pattern.index("}", i)
                out.append(f"\\x{{{pattern[i + 3 : end]}}}")
                i = end + 1
                continue
            else:
                out.append(two)
            i += 2
        elif c == "[":
            found = _set(pattern, i)
            if found is None:
                return None
            out.append(found[0])
            i = found[1]
        elif pattern.startswith("(?", i):
            name = re.compile(r"\(\?P?<([A-Za-z_][\w.\[\]]*)>").match(pattern, i)
            if name:
                out.append(f"(?<g{names}>")
                names += 1
                i = name.end()
            elif re.compile(r"\(\?[imsx-]*[:)]").match(pattern, i):
                end = re.compile(r"[:)]").search(pattern, i).end()
                out.append(pattern[i:end])
                i = end
            else:  # look-around and other extensions
                return None
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":  # a repetition repeated: possessive in Java, plain here
            return None
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _valid(java: str) -> bool:
    spark = SparkSession.getActiveSession()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:  # Java's PatternSyntaxException is one
        return False
    return True


def _python(pattern: str):
    """A compiled pattern for Arrow batches, None if it isn't valid."""
    if java_pattern(pattern) is None:
        return None
    try:
        import regex

        return regex.compile(pattern, regex.V1)
    except ImportError:
        kind = re
    except Exception:  # noqa: BLE001 - not valid
        return None
    try:
        return kind.compile(pattern)
    except re.error:
        return None


def _match_all(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for p, s in zip(patterns, texts, strict=True):
        if p is None or s is None:
            out.append(None)
            continue
        if p not in known:
            known[p] = _python(p)
        out.append(known[p] is not None and known[p].fullmatch(s) is not None)
    return pd.Series(out, dtype="object")


def full_match(pattern: Column | str, s: Column) -> Column:
    """Does the pattern match the whole text?"""
    if isinstance(pattern, str):
        java = java_pattern(pattern)
        whole = f"(?d)(?U)^(?:{java})\\z"
        return F.lit(False) if java is None or not _valid(whole) else F.rlike(s, F.lit(whole))
    return F.coalesce(F.pandas_udf(_match_all, "boolean")(pattern, s), F.lit(False))
