"""Registered queries that need more than a program: files, commands, transactions, results by name."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .streaming.incremental import IncrementalEngine
from .streaming.repl import run_script
from .tables import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns as a relation's frame."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return df.toDF(*[f"c{i}" for i in range(len(columns))])


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    return Scratch(spark, "files").path


# files
@_query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey > 1")
def s1_k1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    first = Engine(spark, '.decl N(k: int32, name: string, r: int32)\n.decl Pair(k: int32, name: string, r: int32)\n.output Pair(delimiter="|", filename="p.csv")\nPair(k, n, r) :- N(k, n, r).')
    first.bind("N", _table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")).write(folder)
    return Engine(spark, '.decl Pair(k: int32, name: string, r: int32)\n.input Pair(IO="file", filename="p.csv", delimiter="|")\n.decl Out(k: int32, name: string)\n.output Out\nOut(k, n) :- Pair(k, n, r), r > 1.', facts=folder).query("Out")


@_query("SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_linenumber > 3")
def s2_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file of all lines, read in splits; the default name and delimiter."""
    folder = _folder(spark)
    first = Engine(spark, '.decl L(o: int64, s: int64, n: int32)\n.output L(filename="Line.facts")')
    first.bind("L", _table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")).write(folder)
    return Engine(spark, ".decl Line(o: int64, s: int64, n: int32)\n.input Line\n.decl Out(o: int64, s: int64)\n.output Out\nOut(o, s) :- Line(o, s, n), n > 3.", facts=folder).query("Out")


@_query("SELECT DISTINCT c_custkey AS k, c_mktsegment AS seg FROM customer")
def s4_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    _table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").write.option("header", True).csv(f"{folder}/c.csv")
    return Engine(spark, '.decl Out(k: int64, seg: string)\n.input Out(filename="c.csv", delimiter=",", header="true")\n.output Out', facts=folder).query("Out")


@_query("SELECT DISTINCT c_custkey AS k, c_acctbal AS bal FROM customer")
def s5_default_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    Engine(spark, '.decl C(k: int64, bal: f64)\n.output C(filename="Cust.facts")').bind("C", _table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")).write(folder)
    return Engine(spark, ".decl Cust(k: int64, bal: f64)\n.input Cust\n.decl Out(k: int64, bal: f64)\n.output Out\nOut(k, b) :- Cust(k, b).", facts=folder).query("Out")


@_query("SELECT r_regionkey AS k, t AS tag FROM region JOIN (VALUES (0, 'a'), (2, 'b'), (2, 'c'), (9, 'd')) x(k, t) ON k = r_regionkey")
def s8_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, ".decl R(k: int32)\n.decl Tag(k: int32, t: string)\n.decl Out(k: int32, tag: string)\n.output Out\nOut(k, t) :- R(k), Tag(k, t).")
    return e.bind("R", _table(spark, sf_dir, "region", "r_regionkey")).insert("Tag", [(0, "a"), (2, "b"), (2, "c"), (9, "d"), (0, "a")]).query("Out")


@_query("WITH RECURSIVE p AS (SELECT s_suppkey AS a, s_suppkey // 3 AS b FROM supplier WHERE s_suppkey > 0 UNION SELECT a, b // 3 FROM p WHERE b > 0) SELECT a, b FROM p")
def s11_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '.include "closure.dl"\n.decl S(k: int64)\n.decl Out(a: int64, b: int64)\n.output Out\nStep(k, k / 3) :- S(k), k > 0.\nOut(a, b) :- Path(a, b).'
    return Engine(spark, text, folder=str(Path(__file__).parent / "programs")).bind("S", _table(spark, sf_dir, "supplier", "s_suppkey")).query("Out")


@_query("SELECT count(DISTINCT c_mktsegment) AS n FROM customer")
def k3_printsize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, ".decl C(s: string)\n.decl Seg(s: string)\n.printsize Seg\nSeg(s) :- C(s).").bind("C", _table(spark, sf_dir, "customer", "c_mktsegment"))
    return spark.createDataFrame([(e.run()["Seg"],)], "n long")


@_query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS rich, false AS poor")
def k4_nullary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, ".decl C(b: f64)\n.decl Rich()\n.output Rich\n.decl Poor()\n.output Poor\nRich() :- C(b), b > 9000.0.\nPoor() :- C(b), b < -100000.0.").bind("C", _table(spark, sf_dir, "customer", "c_acctbal"))
    found = e.run()
    return spark.createDataFrame([(found["Rich"], found["Poor"])], "rich boolean, poor boolean")


@_query("SELECT r_name AS name FROM region")
def g6_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no output needs isn't read: the file of Dead doesn't exist."""
    text = '.decl Dead(x: int32)\n.input Dead(filename="nowhere.csv")\n.decl Gone(x: int32)\nGone(x) :- Dead(x).\n.decl R(n: string)\n.decl Out(name: string)\n.output Out\nOut(n) :- R(n).'
    return Engine(spark, text).bind("R", _table(spark, sf_dir, "region", "r_name")).query("Out")


# transactions
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")


def _two(spark: SparkSession, sf_dir: str, rules: str) -> DataFrame:
    """The changes of Out when the failed orders go and their customers' keys come as orders of customer 0."""
    e = IncrementalEngine(spark, ".decl Ord(o: int64, c: int64)\n.decl Cust(c: int64, n: int32)\n" + rules)
    orders = _orders(spark, sf_dir)
    failed = orders.where("c2 = 'F'").select("c0", "c1")
    e.change("Ord", orders.select("c0", "c1"))
    e.change("Cust", _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"))
    e.commit()
    e.change("Ord", failed, -1)
    e.change("Ord", failed.select("c1", F.lit(0).cast("long").alias("c1x")).distinct().toDF("c0", "c1"))
    return e.commit()["Out"]


_BEFORE = "a AS (SELECT DISTINCT o_orderkey AS o, o_custkey AS c FROM orders)"
#: The orders after _two; a key may come that was there.
_AFTER = "n AS (SELECT o, c, sum(d) AS d FROM (SELECT o_orderkey AS o, o_custkey AS c, 1 AS d FROM orders UNION ALL SELECT o_orderkey, o_custkey, -1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT o_custkey, 0, 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2), b AS (SELECT o, c FROM n WHERE d > 0)"


def _difference(one: str) -> str:
    """SQL of the changes of a query over the orders, {} being their name."""
    old, new = one.format("a"), one.format("b")
    return f"WITH {_BEFORE}, {_AFTER}, x AS ({old}), y AS ({new}) SELECT *, 1::INTEGER AS diff FROM (SELECT * FROM y EXCEPT SELECT * FROM x) UNION ALL SELECT *, -1 FROM (SELECT * FROM x EXCEPT SELECT * FROM y)"


@_query(_difference("SELECT DISTINCT c_nationkey AS n, o FROM {} JOIN customer ON c = c_custkey"))
def i6_delete_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, ".decl Out(n: int32, o: int64)\n.output Out\nOut(n, o) :- Ord(o, c), Cust(c, n).")


@_query(_difference("SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT c FROM {})"))
def i6_neg_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, ".decl Out(c: int64)\n.output Out\nOut(c) :- Cust(c, _), !Ord(_, c).")


@_query(_difference("SELECT c, count(o) AS n, FROM {} GROUP BY 1"))
def i6_agg_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, ".decl Out(c: int64, n: int64)\n.output Out\nOut(c, count(o)) :- Ord(o, c).")


@_query(f"WITH RECURSIVE {_BEFORE}, {_AFTER}, s AS (SELECT DISTINCT o // 3 AS p, c FROM a), t AS (SELECT DISTINCT o // 3 AS p, c FROM b), x AS (SELECT 1::BIGINT AS c UNION SELECT s.c FROM x JOIN s ON x.c = s.p), y AS (SELECT 1::BIGINT AS c UNION SELECT t.c FROM y JOIN t ON y.c = t.p) SELECT c, 1::INTEGER AS diff FROM (SELECT c FROM y EXCEPT SELECT c FROM x) UNION ALL SELECT c, -1 FROM (SELECT c FROM x EXCEPT SELECT c FROM y)")
def i6_recursive_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir, ".decl Out(c: int64)\n.output Out\nOut(1).\nOut(c) :- Out(p), Ord(o, c), p = o / 3.")


@_query("SELECT r_regionkey AS k, r_name AS name, 1::INTEGER AS diff FROM region UNION SELECT 77, 'EXTRA', 1")
def i5_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and facts are the first epoch."""
    folder = _folder(spark)
    Engine(spark, '.decl R(k: int32, n: string)\n.output R(filename="R.facts")').bind("R", _table(spark, sf_dir, "region", "r_regionkey", "r_name")).write(folder)
    return IncrementalEngine(spark, '.decl R(k: int32, name: string)\n.input R\n.output R\nR(77, "EXTRA").', facts=folder).preload()["R"]


@_query("SELECT n_nationkey AS k, 1::INTEGER AS diff FROM nation WHERE n_nationkey <> 4 UNION SELECT 100, 1")
def i1_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands: a file, rows with counts, a transaction that is given up."""
    folder, got = _folder(spark), []
    _table(spark, sf_dir, "nation", "n_nationkey").select(F.col("c0").cast("string").alias("value")).write.text(f"{folder}/n.csv")
    e = IncrementalEngine(spark, '.decl N(k: int32)\n.input N(IO="command")\n.decl Flag()\n.input Flag(IO="command")\n.decl Out(k: int32)\n.output Out\nOut(k) :- N(k), Flag().')
    script = ["begin", f"file N {folder}/n.csv", "commit", "put N 100 2", "put N 100 -1", "put N 4 -1", "put Flag True", "commit", "begin", "put N 55", "abort", "quit"]
    run_script(e, script, got.append)
    return got[-1]["Out"]


@_query("SELECT r_regionkey || chr(9) || r_name || chr(9) || CASE WHEN r_regionkey = 1 THEN '-1' ELSE '+1' END AS line, CASE WHEN r_regionkey = 1 THEN 2 ELSE 1 END::INTEGER AS epoch FROM region UNION ALL SELECT r_regionkey || chr(9) || r_name || chr(9) || '+1', 1 FROM region WHERE r_regionkey = 1")
def k5_delta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of two commits: all regions come, region 1 goes."""
    folder, rows = _folder(spark), _table(spark, sf_dir, "region", "r_regionkey", "r_name")
    e = IncrementalEngine(spark, ".decl R(k: int32, n: string)\n.output R")
    for df, n in ((rows, 1), (rows.where("c0 = 1"), -1)):
        e.change("R", df, n)
        e.write_delta(folder, e.commit())
    return spark.read.text(f"{folder}/R_t1.csv").select(F.col("value").alias("line"), F.lit(1).alias("epoch")).union(spark.read.text(f"{folder}/R_t2.csv").select("value", F.lit(2)))
