"""Queries on small tables that have what only larger tables have."""

from conftest import same

from quern.engine import Engine
from quern.queries import ORACLES, QUERIES
from quern.streaming.incremental import IncrementalEngine


def write(spark, folder, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_paths_longer_than_the_sql_follows(spark, tmp_path):
    """A chain of 30 customers: distances around and past 64."""
    orders = [(10 * (c + 1) + c % 7, c, "F", 1.0, "1-URGENT") for c in range(30)]
    customers = [(c, f"C{c}", 0, 0.0, "BUILDING") for c in range(30)]
    folder = write(
        spark, tmp_path,
        orders=("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", orders),
        customer=("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", customers),
    )
    got = same(QUERIES["a9_sssp_min"](spark, folder), ORACLES["a9_sssp_min"], folder)
    assert 10 < len(got) < 30 and max(d for _, d in got) > 56


def top(df):
    return df._jdf.queryExecution().optimizedPlan().nodeName()


def test_pairs_of_a_self_join_are_not_made_distinct(spark, tmp_path):
    """Rows repeat; what is joined is made distinct, and the pairs are not held to be compared."""
    lines = [(o, o % 3, o % 7, n) for o in range(60) for n in (1, 2)] * 2
    folder = write(spark, tmp_path, lineitem=("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", lines))
    df = QUERIES["j2_self_join"](spark, folder)
    assert len(same(df, ORACLES["j2_self_join"], folder)) == 3 * 21
    assert top(df) != "Aggregate"


def test_heads_that_do_not_fix_their_joins_stay_distinct(spark):
    rows = [(1, 1, 5), (1, 2, 5), (2, 1, 6), (2, 1, 7), (2, 1, 7)]
    text = ".decl E(a: int64, b: int64, c: int64)\n.decl D(a: int64, m: int64)\n.decl P(a: int64, b: int64)\n.decl Out(x: int64, y: int64)\n.output Out\nD(a, min(c)) :- E(a, _, c).\nP(a, b) :- E(a, b, _).\n"
    for rule, want in {
        "Out(x, y) :- E(x, p, _), E(y, p, _).": {(1, 1), (1, 2), (2, 1), (2, 2)},  # p isn't in the head
        "Out(x, y) :- P(x, p), P(y, p), D(x, _).": {(1, 1), (1, 2), (2, 1), (2, 2)},
        "Out(x, m) :- D(x, m), D(y, m), E(y, _, _).": {(1, 5), (2, 6)},
        "Out(x, y) :- E(x, y, c), E(x, y, d), c < d.": {(2, 1)},  # more than one c for a head
        "Out(x, y) :- P(x, y), D(x, m), m < 6.": {(1, 1), (1, 2)},  # m is fixed by x
        "Out(x, x) :- E(x, 1, c), E(x, 1, c).": {(1, 1), (2, 2)},
        "Out(1, 2) :- E(_, _, _), P(_, _).": {(1, 2)},
    }.items():
        got = [tuple(r) for r in Engine(spark, text + rule).insert("E", rows).query("Out").collect()]
        assert len(got) == len(want) and set(got) == want, rule


def test_generations_without_rounds_over_pairs(spark, tmp_path, monkeypatch):
    """Keys with gaps (several tops), repeated, 0 and negative; groups larger than a cell."""
    monkeypatch.setattr("quern.operators.rules.CELL", 16)
    keys = [k for k in range(-3, 400) if k % 11 and k not in (4, 5, 40)] + [7, 7, 5000, 15001, 45003, 45004, 15002]
    folder = write(spark, tmp_path, supplier=("s_suppkey long, s_nationkey int, s_acctbal double", [(k, 0, 0.0) for k in keys]))
    df = QUERIES["r1_same_generation"](spark, folder)
    assert len(same(df, ORACLES["r1_same_generation"], folder)) > 10000
    assert top(df) != "Aggregate"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "column" in plan


def test_a_line_is_parsed_once(spark, tmp_path):
    """Filters on parsed cells stay above the parsing; odd fields give what they gave."""
    good = ["1\t2\t4", " +1 \t-2\t5\r", "007\t8\t9\tmore", "9223372036854775807\t-9223372036854775808\t6"]
    bad = ["", "  ", "1\t2", "1.0\t2\t4", "1\t2\t2147483648", "9223372036854775808\t1\t4", "1\x0b\t2\t4", "--1\t2\t4", "+\t2\t4", "٥\t2\t4", "1e3\t2\t4", "1\t2\t3"]
    (tmp_path / "Line.facts").write_text("\n".join(good + bad) + "\n")
    text = ".decl Line(o: int64, s: int64, n: int32)\n.input Line\n.decl Out(o: int64, s: int64)\n.output Out\nOut(o, s) :- Line(o, s, n), n > 3."
    df = Engine(spark, text, facts=str(tmp_path)).query("Out")
    assert {tuple(r) for r in df.collect()} == {(1, 2), (1, -2), (7, 8), (2**63 - 1, -(2**63))}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_first_commit_groups_its_rows_once(spark):
    e = IncrementalEngine(spark, ".decl A(a: int64)\n.decl Out(a: int64)\n.output Out\nOut(x) :- A(x).")
    e.insert("A", [(1,), (1,), (2,)]).remove("A", [(2,), (3,)])
    plus, minus = e._input_changes({}, [])
    assert [tuple(r) for r in plus["a"].collect()] == [(1,)] and not minus
    assert e.scratch.n == 3  # the counts, what comes, what goes
