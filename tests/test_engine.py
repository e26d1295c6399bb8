import json
import random

import pytest
from conftest import rows

from quern.cli import main
from quern.engine import Engine, on_columns
from quern.errors import DivergenceProblem, EngineProblem
from quern.streaming.incremental import IncrementalEngine, feed
from quern.streaming.repl import run_script


def run(spark, text, out="Out", **inputs):
    e = Engine(spark, text)
    for rel, data in inputs.items():
        e.insert(rel, data)
    return rows(e.query(out))


def test_aggregates_take_distinct_heads(spark):
    text = ".decl S(d: int32, k: int32, a: int32)\n.decl Out(d: int32, t: int32)\n.output Out\nOut(d, sum(a)) :- S(d, _, a)."
    assert run(spark, text, S=[(1, 1, 10), (1, 2, 10), (1, 3, 5)]) == [(1, 15)]


def test_integers_wrap(spark):
    text = """.decl A(a: int8, b: int16, c: int32, d: int64, e: uint8, f: uint32, g: uint64)
    .decl Out(a: int8, b: int16, c: int32, d: int64, e: uint8, f: uint32, g: uint64)\n.output Out
    Out(a + 1, b * 2, c * c, d + d, e - 1, f * f, g * g) :- A(a, b, c, d, e, f, g)."""
    got = run(spark, text, A=[(127, 32767, 2**31 - 1, 2**63 - 1, 0, 2**32 - 1, 2**64 - 1)])
    assert [int(x) for x in got[0]] == [-128, -2, 1, -2, 255, 1, 1]


def test_division(spark):
    text = ".decl A(a: int32, b: int32)\n.decl Out(q: int32, r: int32)\n.output Out\nOut(a / b, a % b) :- A(a, b)."
    assert run(spark, text, A=[(-7, 2), (7, -2), (-(2**31), -1)]) == sorted([(-3, -1), (-3, 1), (-(2**31), 0)], key=repr)
    with pytest.raises(Exception, match="(?i)divi"):
        run(spark, text, A=[(1, 0)])


def test_averages_truncate(spark):
    text = ".decl A(a: int32)\n.decl Out(m: int32)\n.output Out\nOut(average(a)) :- A(a)."
    assert run(spark, text, A=[(-1,), (-4,)]) == [(-2,)]
    assert run(spark, text) == []


def test_texts_of_floats(spark):
    text = ".decl A(x: f64)\n.decl Out(s: string)\n.output Out\nOut(to_string(x)) :- A(x)."
    values = {1.0: "1", 0.1: "0.1", 1e20: "1" + "0" * 20, 1.5e-9: "0.0000000015", -2.5: "-2.5", 123456789.125: "123456789.125", 1.25e10: "12500000000", float("inf"): "inf"}
    assert run(spark, text, A=[(v,) for v in values]) == sorted(((s,) for s in values.values()), key=repr)


def test_float_division_by_zero(spark):
    text = ".decl A(x: f64, y: f64)\n.decl Out(s: string)\n.output Out\nOut(to_string(x / y)) :- A(x, y)."
    assert run(spark, text, A=[(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0)]) == [("-inf",), ("NaN",), ("inf",)]


def test_strings(spark):
    text = '.decl A(s: string, i: int32, n: int32)\n.decl Out(s: string)\n.output Out\nOut(substr(s, i, n)) :- A(s, i, n).'
    assert run(spark, text, A=[("héllo", 1, 3)]) == [("éll",)]
    assert run(spark, text, A=[("abc", -1, 2), ("abc", 1, -1), ("abc", 9, 1)]) == [("",), ("bc",)]
    number = ".decl A(s: string)\n.decl Out(n: int32)\n.output Out\nOut(to_number(s)) :- A(s)."
    assert run(spark, number, A=[("+42",)]) == [(42,)] and run(spark, number, A=[(" 42",), ("99999999999",)]) == [(0,)]


def test_patterns(spark):
    text = '.decl A(s: string)\n.decl Out(s: string)\n.output Out\nOut(s) :- A(s), match("PATTERN", s).'
    data = [("ab",), ("z1",), (":",), ("é",), ("(",), ("aa",), ("a\nb",)]
    want = {"(?P<n>z)1": ["z1"], "[[:alpha:]]+": ["ab", "aa"], "[[:^alpha:]]": [":", "é", "("], "(": [], "(a)\\\\1": [], "a(?=b).": [], "[a-z--[b-z]]+": ["aa"], r"\\w": ["é"], "a.b": [], "(?s)a.b": ["a\nb"]}
    for pattern, found in want.items():
        assert run(spark, text.replace("PATTERN", pattern), A=data) == sorted(((x,) for x in found), key=repr), pattern
    columns = ".decl A(p: string, s: string)\n.decl Out(p: string)\n.output Out\nOut(p) :- A(p, s), match(p, s)."
    assert run(spark, columns, A=[(p.replace("\\\\", "\\"), "ab") for p in want]) == [("[[:alpha:]]+",)]


def test_ord(spark):
    text = '.decl A(s: string)\n.decl Out(s: string, n: int32)\n.output Out\nOut(s, ord(s)) :- A(s).\nOut("k", ord("k")) :- A("a").\n.decl B(n: int32)\n.output B\nB(ord(cat(s, "!"))) :- A(s).'
    assert run(spark, text, A=[("b",), ("a",), ("a",)]) == [("a", 1), ("b", 2), ("k", 3)]
    assert all(n < 0 for (n,) in run(spark, text, "B", A=[("b",), ("a",)]))


def test_tuples(spark):
    text = """.type P = (a: int32, b: string)\n.decl A(a: int32, b: string)\n.decl T(p: P)\n.decl Out(a: int32)\n.output Out
    T((a, b)) :- A(a, b).\nOut(a) :- T(p), (a, "x") = p."""
    assert run(spark, text, A=[(1, "x"), (2, "y")]) == [(1,)]


def closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("rule", ["R(x, z) :- R(x, y), E(y, z).", "R(x, z) :- E(x, y), R(y, z).", "R(x, z) :- R(x, y), R(y, z)."])
def test_closures_agree(spark, rule):
    r = random.Random(3)
    edges = {(r.randrange(9), r.randrange(9)) for _ in range(14)}
    text = ".decl E(a: int32, b: int32)\n.decl R(a: int32, b: int32)\n.output R\nR(x, y) :- E(x, y).\n" + rule
    assert run(spark, text, "R", E=edges) == sorted(closure(edges), key=repr)


@pytest.mark.parametrize("bucketed", [1, 1 << 17])
def test_long_chains(spark, bucketed, monkeypatch):
    """More rounds than a relation has parts, plain and aggregated; with merged parts in buckets and without."""
    monkeypatch.setattr("quern.operators.fixpoint.BUCKETED", bucketed)
    edges = [(i, i + 1) for i in range(12)]
    text = ".decl E(a: int32, b: int32)\n.decl Out(a: int32)\n.decl D(a: int32, d: int32)\n.output Out\n.output D\nOut(0).\nOut(b) :- Out(a), E(a, b).\nD(0, min(0)) :- E(0, _).\nD(b, min(d + 2)) :- D(a, d), E(a, b).\nD(b, min(d + 1)) :- D(a, d), E(a, c), E(c, b)."
    assert run(spark, text, E=edges) == sorted([(i,) for i in range(13)], key=repr)
    want = {0: 0}
    for i in range(1, 13):
        want[i] = min(want[i - 1] + 2, want[i - 2] + 1) if i > 1 else 2
    assert run(spark, text, "D", E=edges) == sorted(want.items(), key=repr)


def test_join_order(spark):
    """Atoms that share no variable with those before wait for one that does; only genuine cross products remain."""
    text = ".decl A(x: int32)\n.decl B(y: int32)\n.decl C(x: int32, y: int32)\n.decl Out(x: int32, y: int32)\n.output Out\nOut(x, y) :- A(x), B(y), C(x, y)."
    e = Engine(spark, text)
    for rel, data in {"A": [(1,), (2,)], "B": [(5,), (6,)], "C": [(1, 5), (2, 7), (3, 6), (2, 6)]}.items():
        e.insert(rel, data)
    out = e.query("Out")
    assert rows(out) == [(1, 5), (2, 6)]
    assert "NestedLoop" not in (plan := out._jdf.queryExecution().toString()) and "Cartesian" not in plan


def test_divergence(spark):
    e = Engine(spark, ".decl N(n: int32)\n.output N\nN(0).\nN(n + 1) :- N(n).", max_rounds=4)
    with pytest.raises(DivergenceProblem):
        e.query("N").collect()


def test_loops(spark):
    text = ".decl E(a: int32, b: int32)\n.decl Out(a: int32, b: int32)\n.decl Done()\n.output Out\n.output Done\nOut(a, b) :- E(a, b).\n"
    chain = [(i, i + 1) for i in range(1, 6)]
    upto = lambda n: sorted(((a, b) for a in range(1, 7) for b in range(a + 1, min(6, a + n) + 1)), key=repr)
    step = "Out(a, c) :- Out(a, b), E(b, c)."
    assert run(spark, text + "loop while { @it <= 1 } { " + step + " }", E=chain) == upto(3)
    assert run(spark, text + "loop while { @it <= 3 } until { Done } { " + step + " Done() :- Out(1, 4). }", E=chain) == upto(4)
    assert run(spark, text + "loop while { @it <= 0 } or until { Done } { " + step + " Done() :- Out(1, 4). }", E=chain) == upto(4)
    assert run(spark, text + "fixpoint { " + step + " }", E=chain) == upto(5)


def test_mixed_iterative_loop(spark):
    text = ".decl V(x: int32)\n.decl All(x: int32)\n.output V\n.output All\nV(1).\nloop while { @it <= 2 } { .iterative V\n V(x + 1) :- V(x). All(x) :- V(x). }"
    e = Engine(spark, text)
    assert rows(e.query("V")) == [(4,)] and rows(e.query("All")) == [(1,), (2,), (3,)]


def test_files(spark, tmp_path):
    (tmp_path / "A.facts").write_text(" 1 \tx\textra\n\nbad\ty\n2\n3\tz\r\n1\tx\n")
    (tmp_path / "H.csv").write_text("k,n\n5,true\n6,nope\n")
    (tmp_path / "p.dl").write_text('.decl A(k: int32, s: string)\n.input A\n.decl H(k: int32, b: bool)\n.input H(filename="H.csv", delimiter=",", header="true")\n.output A(order_by="k DESC")\n.output H\n.decl N()\n.output N\nN() :- A(1, _).\n.decl C(k: int32)\n.printsize C\nC(k) :- A(k, _).\n')
    assert main([str(tmp_path / "p.dl"), "-F", f"file://{tmp_path}", "-D", f"file://{tmp_path}/out"], spark) == 0
    out = {f.name: f.read_text() for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")}
    assert out == {"A.csv": "3\tz\n1\tx\n", "H.csv": "5\ttrue\n", "N.csv": "True\n", "C.csv": "2\n"}


def test_functions(spark):
    text = ".extern fn f(x: int32) -> int32\n.decl A(x: int32)\n.decl Out(x: int32)\n.output Out\nOut(max(f(f(x)))) :- A(x), f(x) > 2."
    for f in (on_columns(lambda x: x * 2), lambda x: x * 2):
        e = Engine(spark, text, functions={"f": f})
        e.insert("A", [(1,), (2,), (3,)])
        assert rows(e.query("Out")) == [(12,)]


def test_misuse(spark):
    e = IncrementalEngine(spark, ".decl A(x: int32)\n.output A")
    with pytest.raises(EngineProblem):
        e.commit()
    with pytest.raises(EngineProblem):
        e.insert("B", [(1,)])
    with pytest.raises(EngineProblem):
        e.insert("A", [(2**40,)])


TC = ".decl E(a: int32, b: int32)\n.decl R(a: int32, b: int32)\n.output R\n.decl D(a: int32)\n.output D\n.decl N()\n.output N\nR(x, y) :- E(x, y).\nR(x, z) :- R(x, y), E(y, z).\nD(x) :- E(x, _), !R(x, x).\nN() :- R(x, x).\n"


MORE = ".decl C(x: int32, n: int64)\n.output C\nC(x, count(y)) :- R(x, y).\n.decl M(y: int32)\n.output M\nM(max(y)) :- E(_, y).\n.decl S(y: int32)\n.output S\nS(y) :- E(_, y), !E(y, _).\n.printsize P\n.decl P(x: int32)\nP(x) :- S(x) ; E(x, x).\n"


def test_increments_equal_batches(spark):
    """Insertions and removals through joins, negation, recursion and aggregates."""
    r = random.Random(8)
    e, state, seen, size = IncrementalEngine(spark, TC + MORE), {}, {k: set() for k in "RDCMS"}, 0
    for signs in ([1], [1], [1, -1, -1], [-1, 1]):
        e.begin()
        for _ in range(4):
            edge, n = (r.randrange(5), r.randrange(5)), r.choice(signs)
            state[edge] = state.get(edge, 0) + n
            e.insert("E", [edge], n)
        delta = e.commit()
        for rel in seen:
            for *row, n in rows(delta[rel]):
                assert (tuple(row) in seen[rel]) == (n < 0)
                (seen[rel].add if n > 0 else seen[rel].discard)(tuple(row))
        edges = {x for x, n in state.items() if n > 0}
        reach = closure(edges)
        assert seen["R"] == reach
        assert seen["D"] == {(a,) for a, _ in edges if (a, a) not in reach}
        assert seen["C"] == {(a, sum(x == a for x, _ in reach)) for a, _ in reach}
        assert seen["M"] == ({(max(b for _, b in edges),)} if edges else set())
        assert seen["S"] == {(b,) for _, b in edges if b not in {a for a, _ in edges}}
        size += delta["P"]
        assert size == len(seen["S"] | {(a,) for a, b in edges if a == b})


def test_failing_commit(spark):
    """It leaves the engine, and the transaction, as they were."""
    e = IncrementalEngine(spark, ".decl A(x: int32)\n.decl B(y: int32)\n.output B\nB(10 / x) :- A(x).")
    e.insert("A", [(5,)])
    assert rows(e.commit()["B"]) == [(2, 1)]
    e.insert("A", [(0,), (2,)])
    with pytest.raises(Exception, match="(?i)divi"):
        e.commit()
    e.remove("A", [(0,)])
    assert rows(e.commit()["B"]) == [(5, 1)] and e.epoch == 2


def test_repl(spark, tmp_path):
    (tmp_path / "f.csv").write_text("3,30\n4,40\n")
    text = '.decl S(d: int32, a: int32)\n.input S(IO="command", delimiter=",")\n.decl T(d: int32, t: int32)\n.output T\nT(d, sum(a)) :- S(d, a).'
    e, got, said = IncrementalEngine(spark, text), [], []
    script = f"begin\nput S 1,10\nput S 1,20 +1\ncommit\nput S 1,10 -1\nfile S file://{tmp_path}/f.csv\nput S 9,9\ndone\nput S 7,7\nabort\nbegin\ncommit\nwhat\nquit\nput S 1,1".split("\n")
    run_script(e, script, lambda d: (got.append(rows(d["T"])), e.write_delta(f"file://{tmp_path}", d)), said.append)
    assert got == [[(1, 30, 1)], [(1, 20, 1), (1, 30, -1), (3, 30, 1), (4, 40, 1), (9, 9, 1)], []]
    assert (tmp_path / "T_t1.csv").read_text() == "1\t30\t+1\n" and (tmp_path / "T_t3.csv").read_text() == "" and "unknown" in said[0]


def test_preload(spark):
    e = IncrementalEngine(spark, ".decl A(x: int32)\n.output A\nA(1).\nA(2).")
    assert rows(e.preload()["A"]) == [(1, 1), (2, 1)]
    e.remove("A", [(1,)])
    assert rows(e.commit()["A"]) == [(1, -1)]


def test_stream(spark, tmp_path):
    """Batches come once each, also to an engine that starts anew."""
    text, got = ".decl E(a: int32, b: int32)\n.decl N(a: int32, n: int64)\n.output N\nN(a, count(b)) :- E(a, b).", []
    for i, data in enumerate([[(1, 2), (2, 3)], [(1, 4), (None, 1)]]):
        spark.createDataFrame(data, "a int, b int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        e = IncrementalEngine(spark, text)
        q = feed(e, "E", spark.readStream.schema("a int, b int").parquet(str(tmp_path / "in")), lambda d, n: got.append((n, rows(d["N"]))), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert got == [(0, [(1, 1, 1), (2, 1, 1)]), (1, [(1, 1, -1), (1, 2, 1)])]


def test_profile(spark, tmp_path):
    (tmp_path / "p.dl").write_text(TC + "E(1, 2).\nE(2, 1).\n")
    assert main([str(tmp_path / "p.dl"), "-D", f"file://{tmp_path}/out", "--profile", str(tmp_path / "x.json"), "--explain"], spark) == 0
    told = json.loads((tmp_path / "x.json").read_text())
    assert [s["kind"] for s in told["strata"]].count("recursive") == 1 and told["rounds"] and "Stratum 0" in (tmp_path / "x.html").read_text()
