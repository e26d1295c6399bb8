"""Typed expressions as Spark columns.

Integers wrap around in their width whatever the session's ANSI setting; division by zero fails for
integers and follows IEEE for floats. Unsigned integers are kept in the next wider signed type, and
uint64 in decimal(20, 0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import Bin, Call, Const, Item, Tup, Typed, Var
from ..plans.types import BITS, Type

PRIMITIVE = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType()}
WIDE = T.DecimalType(38, 0)


def spark_type(t: Type) -> T.DataType:
    if t.prim:
        return PRIMITIVE[t.prim]
    return T.StructType([T.StructField(f"_{i}", spark_type(f)) for i, f in enumerate(t.fields)])


def _number(n: int) -> Column:
    return F.lit(str(n)).cast(WIDE)


def _wide(x: Column) -> Column:
    return x.cast(WIDE)


def _modulo(x: Column, bits: int, signed: bool) -> Column:
    """A wide decimal, wrapped."""
    half = _number(2 ** (bits - 1) if signed else 0)
    return (F.pmod(x + half, _number(2**bits)) - half).cast(WIDE)


def _wide_div(a: Column, b: Column) -> Column:
    """A quotient that may not fit into a long, which `div` gives: halved first, then put right by its remainder."""
    half = F.call_function("div", a, _wide(b) * 2).cast(WIDE) * 2
    rest = a - half * b
    return (half + F.when(rest >= b, 1).otherwise(0)).cast(WIDE)


def wrap(x: Column, p: str) -> Column:
    """A long (or for 64-bit types a wide decimal) in the width of p."""
    bits, signed = BITS[p], p[0] != "u"
    if bits == 64:
        return _modulo(x, 64, signed).cast(PRIMITIVE[p])
    if signed:
        by = F.lit(64 - bits)
        x = F.call_function("shiftright", F.call_function("shiftleft", x, by), by)
    else:
        x = x.bitwiseAND(F.lit(2**bits - 1).cast("long"))
    return x.cast(PRIMITIVE[p])


def arithmetic(op: str, a: Column, b: Column, p: str) -> Column:
    if p in ("f32", "f64"):
        a, b = a.cast("double"), b.cast("double")
        if op == "/":
            inf = F.lit(float("inf"))
            sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
            by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf * sign).otherwise(-inf * sign)
            out = F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))
        elif op == "%":
            out = F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))
        else:
            out = {"+": a + b, "-": a - b, "*": a * b}[op]
        return out.cast(PRIMITIVE[p])
    if p == "uint64":
        if op in "/%":
            a, b = _wide(a), _wide(b)
            if op == "%":
                return (a % b).cast(PRIMITIVE[p])
            return _wide_div(a, b).cast(PRIMITIVE[p])
        if op == "*":  # by halves, so that 38 digits do
            half = _number(2**32)
            low = (_wide(b) % half).cast(WIDE)
            high = F.call_function("div", _wide(b), half).cast(WIDE)
            top = ((_wide(a) * high).cast(WIDE) % half).cast(WIDE)
            return _modulo(((_wide(a) * low).cast(WIDE) + (top * half).cast(WIDE)).cast(WIDE), 64, False).cast(PRIMITIVE[p])
        return _modulo(_wide(a) + _wide(b) if op == "+" else _wide(a) - _wide(b), 64, False).cast(PRIMITIVE[p])
    x, y = a.cast("long"), b.cast("long")
    if op == "/":
        if p == "int64":  # the smallest by -1 wraps to itself
            return F.when(y == -1, arithmetic("-", F.lit(0), x, p)).otherwise(F.call_function("div", x, F.when(y == -1, F.lit(1).cast("long")).otherwise(y)))
        return wrap(F.call_function("div", x, y), p)
    if op == "%":
        out = F.when(y == -1, F.lit(0).cast("long")).otherwise(x % F.when(y == -1, F.lit(1).cast("long")).otherwise(y))
        return out.cast(PRIMITIVE[p])
    if BITS[p] < 64 and not (op == "*" and p == "uint32"):
        return wrap({"+": x + y, "-": x - y, "*": x * y}[op], p)
    quick = F.call_function({"+": "try_add", "-": "try_subtract", "*": "try_multiply"}[op], x, y)
    wide = {"+": _wide(x) + _wide(y), "-": _wide(x) - _wide(y), "*": _wide(x) * _wide(y)}[op].cast(WIDE)
    if p == "uint32":
        return F.coalesce(quick.bitwiseAND(F.lit(2**32 - 1)), _modulo(wide, 32, False).cast("long"))
    return F.coalesce(quick, _modulo(wide, 64, True).cast("long"))


def float_text(x: Column) -> Column:
    """The shortest decimal that reads back as x, without exponent and without a trailing .0."""
    s = x.cast("string")
    sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
    pattern = r"^-?(\d)\.(\d+)E(-?\d+)$"
    first, rest, e = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2), F.regexp_extract(s, pattern, 3)
    rest = F.when(rest == "0", "").otherwise(rest)
    n = F.coalesce(F.nullif(e, F.lit("")).cast("int"), F.lit(0))
    size = F.length(rest)
    large = F.when(size <= n, F.concat(first, rest, F.repeat(F.lit("0"), F.greatest(n - size, F.lit(0))))).otherwise(F.concat(first, F.substring(rest, F.lit(1), F.greatest(n, F.lit(0))), F.lit("."), F.substring(rest, F.greatest(n, F.lit(0)) + 1, size)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-n - 1, F.lit(0))), first, rest)
    plain = F.regexp_replace(s, r"\.0$", "")
    special = F.when(F.isnan(x), "NaN").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf")
    return F.coalesce(special, F.when(F.contains(s, F.lit("E")), F.concat(sign, F.when(n >= 0, large).otherwise(small))).otherwise(plain))


def text(x: Column, t: Type) -> Column:
    """A value as it is written to files."""
    if t.prim in ("f32", "f64"):
        return float_text(x)
    if t.prim is None:
        parts = [text(x[f"_{i}"], f) for i, f in enumerate(t.fields)]
        return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(",)" if len(parts) == 1 else ")"))
    return x.cast("string")


def literal(value, t: Type) -> Column:
    if t.prim is None:
        return F.struct(*[literal(v, f).alias(f"_{i}") for i, (v, f) in enumerate(zip(value, t.fields, strict=True))])
    if t.prim == "uint64":
        return F.lit(str(value)).cast(PRIMITIVE[t.prim])
    return F.lit(value).cast(PRIMITIVE[t.prim])


class Columns:
    """Turns typed expressions into columns of one rule's bindings."""

    def __init__(self, of: Callable[[str], Column], functions: dict[str, Callable], ordinals: dict | None = None):
        self.of, self.functions, self.ordinals = of, functions, ordinals or {}

    def __call__(self, e: Typed) -> Column:
        x, t = e.of, e.type
        if isinstance(x, Var):
            return self.of(x.name)
        if isinstance(x, Const):
            return literal(x.value, Type(x.kind))
        if isinstance(x, Bin):
            return arithmetic(x.op, self(x.left), self(x.right), t.prim)
        if isinstance(x, Tup):
            return F.struct(*[self(i).alias(f"_{n}") for n, i in enumerate(x.items)])
        if isinstance(x, Item):
            return self(x.of)[f"_{x.index}"]
        if isinstance(x, Call):
            return self.call(x, [self(a) for a in x.args]).cast(spark_type(t))
        raise TypeError(f"{x} isn't an expression")

    def call(self, x: Call, args: list[Column]) -> Column:
        if x.name == "strlen":
            return F.char_length(args[0])
        if x.name == "cat":
            return F.concat(*args)
        if x.name == "to_string":
            return text(args[0], x.args[0].type)
        if x.name == "to_number":
            ok = F.rlike(args[0], F.lit(r"^[+-]?[0-9]+\z"))
            return F.when(ok, F.coalesce(args[0].try_cast("int"), F.lit(0))).otherwise(F.lit(0))
        if x.name == "substr":  # a negative start is past the end, a negative length is without limit
            s, start, size = args
            long = F.when(size < 0, F.char_length(s)).otherwise(size)
            return F.when(start < 0, "").otherwise(F.substring(s, F.when(start < 0, F.lit(1)).otherwise(F.least(start, F.char_length(s)) + 1), long))
        if x.name == "ord":
            # strings of the inputs and rules have dense numbers from 0 on; others, built on the way, a negative hash
            other = F.xxhash64(args[0]).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") - F.lit(2**31 - 1) - F.lit(1)
            return F.coalesce(self.ordinals[x], other) if x in self.ordinals else other
        return self.functions[x.name](*args)
