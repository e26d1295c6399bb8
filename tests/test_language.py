import pytest

from quern.errors import DeclarationProblem, IncludeProblem, QuernError, RuleProblem, StratificationProblem, SyntaxProblem, TypeProblem
from quern.plans.expand import load
from quern.plans.parser import parse, tokens
from quern.plans.program import build

E = ".decl E(a: int32, b: int32)\n.decl S(x: string)\n.decl F(x: f64)\n.decl N()\n"


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("R(x) :- ", SyntaxProblem),
        ("R(x) :- E(x, 1 + 2).", SyntaxProblem),
        (E + "R(x) :- E(x, _).", DeclarationProblem),
        (E + ".decl E(a: int32)", DeclarationProblem),
        (E + ".decl e(a: int32)", DeclarationProblem),
        (".decl R(a: int32, a: int32)", DeclarationProblem),
        (".decl R(a: nothing)", TypeProblem),
        (E + ".decl R(a: int32)\nR(x) :- E(x).", TypeProblem),
        (E + ".decl R(a: int32)\nR(x) :- S(x).", TypeProblem),
        (E + ".decl R(a: int8)\nR(1000).", TypeProblem),
        (E + ".decl R(a: f64)\nR(1).", TypeProblem),
        (E + ".decl R(a: int32)\nR(x) :- E(x, y), F(y).", TypeProblem),
        (E + ".decl R(a: string)\nR(x) :- S(x), x + 1 = 2.", TypeProblem),
        (E + ".decl R(a: int32)\nR(z) :- E(x, y).", RuleProblem),
        (E + ".decl R(a: int32)\nR(x) :- E(x, _), !E(x, z).", RuleProblem),
        (E + ".decl R(a: int32)\nR(x) :- E(x, _), z > x.", RuleProblem),
        (E + ".decl R(a: int32, b: int32)\nR(count(x), sum(y)) :- E(x, y).", RuleProblem),
        (E + ".decl R(a: int32, b: int32)\nR(x, sum(y)) :- E(x, y).\nR(x, max(y)) :- E(x, y).\n.output R", RuleProblem),
        (E + ".decl R(a: int32)\nR(x) :- E(x, y), E(y, _). .plan (1, 1)", RuleProblem),
        (E + ".decl R(a: int32)\nR(f(x)) :- E(x, _).", TypeProblem),
        (E + ".output E(limit=\"3\")", DeclarationProblem),
        (E + ".output E\n.printsize E", DeclarationProblem),
        (E + ".decl A(x: int32)\n.decl B(x: int32)\nA(x) :- B(x).\nfixpoint { B(x) :- E(x, _). B(y) :- B(x), E(x, y). }", StratificationProblem),
        (E + ".decl A(x: int32)\nloop until { E } { A(x) :- A(x), E(x, _). }", StratificationProblem),
        (E + ".decl A(x: int32)\nfixpoint { A(x) :- E(x, _). }", StratificationProblem),
        (".include \"nowhere.dl\"", IncludeProblem),
        (".comp A : A { }\n.init a = A", DeclarationProblem),
        (".comp A { .decl R(x: int32) }\n.comp B : A { .override R }\n.init b = B", DeclarationProblem),
        (".type A = (x: A)\n.decl R(a: A)", TypeProblem),
        (".type A <: int32\n.type B <: int32\n.decl R(a: A)\n.decl S(b: B)\n.decl O(x: int32)\nO(x) :- R(x), S(x).", TypeProblem),
        (".type A <: int32\n.decl R(a: int32)\n.decl O(x: A)\nO(x) :- R(x).", TypeProblem),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        build(text)


def test_modes():
    text = E + ".decl R(a: int32, b: int32)\n.output R\nR(x, y) :- E(x, y).\nR(x, z) :- R(x, y), E(y, z).\n"
    assert [s.recursive for s in build(text).strata] == [False, True]
    with pytest.raises(StratificationProblem):
        build(text, extended=True)
    with pytest.raises(StratificationProblem):
        build(text + "fixpoint { R(x, x) :- R(x, _). }", extended=False)


def test_tokens():
    assert [t[:2] for t in tokens('r#"a"b"# "x\\t\\u{41}" a.B -1 // c\n# d\n_ _x')] == [("string", 'a"b'), ("string", "x\tA"), ("name", "a.B"), ("op", "-"), ("int", "1"), ("wild", "_"), ("name", "_x"), ("end", "")]


def test_left_to_right():
    head = parse("R(1 + 2 * 3 - x).")[0].heads[0].args[0]
    assert (head.op, head.left.op, head.left.left.op) == ("-", "*", "+")


def test_pruning_and_case():
    p = build(E + ".decl A(x: int32)\n.decl B(x: int32)\n.output a\nA(X) :- e(X, _).\nB(x) :- E(x, _).")
    assert [s.heads for s in p.strata] == [["a"]] and p.relations["a"].name == "A"


def test_includes(tmp_path):
    (tmp_path / "a.dl").write_text('.include "b.dl"\n.decl A(x: int32)\n')
    (tmp_path / "b.dl").write_text(".decl B(x: int32)\n")
    assert set(build('.include "a.dl"\n.include "b.dl"', folder=tmp_path).relations) == {"a", "b"}
    (tmp_path / "b.dl").write_text('.include "a.dl"\n')
    with pytest.raises(IncludeProblem):
        build('.include "a.dl"', folders=(tmp_path,))


@pytest.mark.parametrize("text", ["", "\x00", ".decl", "R(", "R(x) :- (A(x) ; ", '"', "loop while { @it < } {}", "((((", "R(1,,2).", "@it", ".plan (1)", "R(x) :- !(", "é(x)."])
def test_parser_never_breaks(text):
    try:
        build(text)
    except QuernError:
        pass


def test_places_of_errors(tmp_path, capsys, spark):
    from quern.cli import main

    (tmp_path / "a.dl").write_text(".decl A(x: int32)\n\n\tA(1) B.\n")
    (tmp_path / "p.dl").write_text('.include "a.dl"\n')
    with pytest.raises(SyntaxProblem) as e:
        load('.decl R(a: int32)\n.include "a.dl"', tmp_path)
    assert (e.value.line, e.value.column, e.value.excerpt) == (3, 7, "\tA(1) B.\n\t     ^") and "of a.dl" in str(e.value)
    (tmp_path / "a.dl").write_text(".decl A(x: int32)\n")
    with pytest.raises(SyntaxProblem) as e:
        load('.include "a.dl" .decl R(a: int32)\nR(1) $', tmp_path)
    assert str(e.value).startswith("line 2, column 6: ")
    (tmp_path / "a.dl").write_text("\n  A(x) :- B(x).")
    assert main([str(tmp_path / "p.dl")], spark) == 1
    assert "line 2, column 11 of a.dl" in (err := capsys.readouterr().err) and "  A(x) :- B(x).\n          ^" in err
