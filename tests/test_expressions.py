from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlane.functions import expressions as ex

TEXTS = ["x + 2 * y - 3", "x if x < y else -y", "0 < x <= 5 and not y == 2", "(x - y) ** 3 / 4", "abs(x) + min(x, y, 1)", "implies(x > 1, y > 1) or iff(x < 0, y < 0)", "x * x * y - x / 2"]


@pytest.mark.parametrize("bad", ["x ^ 2", "[1, 2]", "x / y", "x / 0", "x ** -1", "x ** 0.5", "f(x)", "x.y", "lambda: 1", "x[0]", "'a'", "__import__('os')", "x in y"])
def test_rejected(bad):
    with pytest.raises(ex.ExpressionError):
        ex.parse(bad)


@given(st.sampled_from(TEXTS), st.integers(-6, 6), st.integers(-6, 6))
@settings(max_examples=150, deadline=None)
def test_rewrites_keep_the_value(text, x, y):
    at = {"x": Fraction(x), "y": Fraction(y)}
    n = ex.parse(text)
    want = ex.value(n, at)
    assert ex.value(ex.fold(n), at) == want
    assert ex.value(ex.nnf(n), at) == want
    assert ex.value(ex.parse(ex.text(n)), at) == want
    assert ex.value(ex.parse_prefix(ex.prefix(n)), at) == want
    assert ex.value(ex.substitute(n, {"x": ex.parse("x + 0")}), at) == want
    box = {"x": (x - 1.0, x + 1.0), "y": (y - 1.0, y + 1.0)}
    got = ex.interval(n, box)
    assert got is None or (got == want if isinstance(got, bool) else got[0] <= want <= got[1])


def test_numbers_are_exact_and_derivatives():
    assert ex.parse("0.1") == ex.Num(Fraction(1, 10))
    assert ex.fold(ex.parse("0.1 + 0.2")) == ex.Num(Fraction(3, 10))
    assert ex.value(ex.derivative(ex.parse("x ** 3 - 2 * x"), "x"), {"x": Fraction(2)}) == 10
    assert ex.names(ex.parse("x + y if z else 1")) == {"x", "y", "z"}
    assert ex.operators(ex.parse("x + y + 1"))["+"] == 2
    assert ex.is_linear(ex.parse("2 * x + y")) and not ex.is_linear(ex.parse("x * y"))
    assert ex.parse("x ^ 2", infix=True) == ex.parse("x ** 2")
    assert ex.smt2(ex.parse("x + 1 < -2")) == "(< (+ x 1) (- 2))"


def test_columns_with_odd_names_and_partial_match(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a b` int, `p.q` double")
    got = df.select(ex.column(ex.Arith("*", ex.Var("a b"), ex.Var("p.q"))).alias("v"), ex.column(ex.parse("Match(k, 1, 5, .)", infix=True), {"k": df["a b"]}).alias("m")).first()
    assert tuple(got) == (2.0, 5)
    with pytest.raises(Exception, match="no case matches"):
        df.select(ex.column(ex.parse("Match(k, 7, 5, .)", infix=True), {"k": df["a b"]})).collect()


_leaf = st.one_of(st.fractions(min_value=-9, max_value=9, max_denominator=20).map(ex.Num), st.sampled_from(["x", "y", "a b", "let", "p.q"]).map(ex.Var))


def _numeric(inner):
    ops = st.tuples(st.sampled_from("+-*"), inner, inner).map(lambda t: ex.Arith(*t))
    return st.one_of(ops, inner.filter(lambda n: not isinstance(n, ex.Num)).map(ex.Neg))


_number = st.recursive(_leaf, _numeric, max_leaves=8)
_test = st.tuples(st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), _number, _number).map(lambda t: ex.Compare(*t))
_formula = st.recursive(
    _test,
    lambda inner: st.one_of(st.tuples(st.sampled_from(["and", "or"]), st.lists(inner, min_size=2, max_size=3).map(tuple)).map(lambda t: ex.Logic(*t)), inner.filter(lambda n: not (isinstance(n, ex.Compare) and n.op == "==")).map(ex.Not), st.tuples(inner, inner, inner).map(lambda t: ex.If(*t))),
    max_leaves=6,
)


@given(_formula)
@settings(max_examples=200, deadline=None)
def test_smt_terms_read_back(node):
    assert ex.parse_smt2(ex.smt2(node)) == node


def test_smt_scripts_and_errors():
    sorts, asserts = ex.parse_assertions("(set-logic QF_NRA) ; a comment (\n(declare-fun x () Real)(declare-const |a b| Int)\n(assert (let ((z (+ x 1 |a b|))) (=> (< 0 z 5) (distinct x |a b|))))(assert (xor (> x 0.5) (= x 1)))(check-sat)")
    assert sorts == {"x": "Real", "a b": "Int"}
    at = {"x": Fraction(1), "a b": Fraction(1)}
    assert [ex.value(a, at) for a in asserts] == [False, False] and ex.value(asserts[0], at | {"a b": Fraction(9)})
    for bad in ("(+ x", "x)", "(f x)", "(+ 1 2) x", "|x", "()", "(not x y)", ""):
        with pytest.raises(ex.ExpressionError):
            ex.parse_smt2(bad)
