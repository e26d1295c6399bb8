"""Delimited text: no quoting, fields trimmed, rows that don't fit left out."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DeclarationProblem, EngineProblem
from ..functions.scalars import PRIMITIVE, text
from ..operators.rules import UNIT
from ..plans.types import BITS, limits


def parse_field(s: Column, p: str) -> Column:
    """A trimmed field, or null where it isn't one of the type."""
    if p == "string":
        return s
    if p == "bool":
        return F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False)
    if p == "uint64":
        low, high = limits(p)
        whole = F.when(F.rlike(s, F.lit(r"^[+-]?[0-9]+\z")), s.try_cast("decimal(38,0)"))
        return F.when((whole >= F.lit(str(low)).cast("decimal(38,0)")) & (whole <= F.lit(str(high)).cast("decimal(38,0)")), whole).cast(PRIMITIVE[p])
    if p in BITS:
        # a cast takes only signs and digits, but also blanks around them and fractions
        plain = F.ascii(s).between(43, 57) & F.ascii(F.right(s, F.lit(1))).between(48, 57) & ~F.contains(s, F.lit("."))
        whole = F.when(plain, s.try_cast(PRIMITIVE[p]))
        return whole if p[0] != "u" else F.when(whole.between(*limits(p)), whole)
    number = F.rlike(s, F.lit(r"(?i)^[+-]?([0-9]+\.?[0-9]*([e][+-]?[0-9]+)?|\.[0-9]+([e][+-]?[0-9]+)?|inf|infinity|nan)\z"))
    return F.when(number, F.regexp_replace(s, r"(?i)^([+-]?)inf$", "$1Infinity").try_cast(PRIMITIVE[p]))


def read_delimited(spark: SparkSession, path: str, types: tuple, delimiter: str = "\t", header: bool = False) -> DataFrame:
    """A relation's frame, not yet distinct. Further columns are left out; rows with missing or bad columns are skipped."""
    if header:
        lines = spark.read.csv(path, sep="\x01", quote="", escape="", header=True, enforceSchema=True, schema="value string")
    else:
        lines = spark.read.schema("value string").option("lineSep", "\n").text(path)
    # patterns only where they can match; every step is a projection of its own, so that nothing is computed twice
    value = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", r"\r$", "")).otherwise(F.col("value"))
    lines = lines.select(value.alias("value"))
    if not types:
        return lines.where(F.lower(F.trim("value")) == "true").select(F.lit(True).alias(UNIT))
    names = [f"c{i}" for i in range(len(types))]
    fields = lines.select((F.trim("value") != "").alias("filled"), F.split("value", re.escape(delimiter[:1]), -1).alias("fields"))
    cells = fields.select("filled", *[F.trim(F.get("fields", F.lit(i))).alias(n) for i, n in enumerate(names)])
    parsed = cells.select("filled", *[parse_field(F.col(n), t.prim).alias(n) for n, t in zip(names, types, strict=True)])
    # filters on what a generator gives stay above it; pushed into the scan they would parse each line again
    rows = parsed.select(F.inline(F.array(F.struct("filled", *names))))
    return rows.where("filled").select(*names).dropna("any")


def ordered(df: DataFrame, spec: str | None, limit: str | None, attrs: list[str]) -> DataFrame:
    """order_by and limit of .output; ties are broken by all columns."""
    if not spec:
        return df
    by, used = [], set()
    for part in spec.split(","):
        words = part.split()
        if not words or len(words) > 2 or len(words) == 2 and words[1].upper() not in ("ASC", "DESC"):
            raise DeclarationProblem(f"order_by {spec!r} isn't 'column [ASC|DESC], ...'")
        names = [i for i, a in enumerate(attrs) if a.lower() == words[0].lower()]
        if not names:
            raise DeclarationProblem(f"order_by names {words[0]}, which isn't a column")
        used.add(names[0])
        by.append(F.col(f"c{names[0]}").desc() if len(words) == 2 and words[1].upper() == "DESC" else F.col(f"c{names[0]}").asc())
    by += [F.col(f"c{i}").asc() for i in range(len(attrs)) if i not in used]
    df = df.orderBy(*by)
    return df.limit(int(limit)) if limit is not None else df


def lines_of(df: DataFrame, types: tuple, delimiter: str, more: tuple = ()) -> DataFrame:
    """One text column, a line per row; `more` are further text columns."""
    cells = [text(F.col(f"c{i}"), t) for i, t in enumerate(types)] or [F.lit("True")]
    return df.select(F.concat_ws(delimiter, *cells, *more).alias("value"))


def write_lines(lines: DataFrame, path: str, parts: bool = False) -> None:
    """Executors write part files in order. With parts they stay, a folder; otherwise they are joined into one file by streams.

    The file comes under its name when it is whole; nothing is held in memory.
    """
    spark = lines.sparkSession
    if parts:
        lines.write.mode("overwrite").text(path)
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    work = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    source, whole = jvm.org.apache.hadoop.fs.Path(work, "parts"), jvm.org.apache.hadoop.fs.Path(work, "whole")
    files = target.getFileSystem(conf)
    lines.write.text(source.toString())
    out = files.create(whole, True)
    for name in sorted(s.getPath().toString() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")):
        stream = files.open(jvm.org.apache.hadoop.fs.Path(name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 22, False)
        stream.close()
    out.close()
    files.delete(target, True)
    if not files.rename(whole, target):
        raise EngineProblem(f"{path} can't be written")
    files.delete(work, True)
