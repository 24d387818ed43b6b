"""Answers: expressions against exact fractions, normal forms, tolerant and strict equality."""

import random
from fractions import Fraction

import pytest

from tallyweave.functions import algebra, answers


def polynomial(e):
    """The expression's coefficients by exponents of (x, y): the exact oracle of sums, products and powers."""
    kind = e[0]
    if kind == "number":
        return {(0, 0): e[1]} if e[1] else {}
    if kind == "variable":
        return {(int(e[1] == "x"), int(e[1] == "y")): Fraction(1)}
    if kind == "^":
        out, base = {(0, 0): Fraction(1)}, polynomial(e[1])
        for _ in range(int(e[2][1])):
            out = times(out, base)
        return out
    a, b = polynomial(e[1]), polynomial(e[2])
    return plus(a, b) if kind == "+" else times(a, b)


def plus(a, b):
    out = {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}
    return {k: v for k, v in out.items() if v}


def times(a, b):
    out = {}
    for (i, j), v in a.items():
        for (k, m), w in b.items():
            out = plus(out, {(i + k, j + m): v * w})
    return out


def some_expression(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([("number", Fraction(rng.randint(-5, 9), rng.choice([1, 1, 2, 3]))), ("variable", "x"), ("variable", "y")])
    kind = rng.choice("++*^")
    a = some_expression(rng, depth - 1)
    return ("^", a, ("number", Fraction(rng.randint(0, 3)))) if kind == "^" else (kind, a, some_expression(rng, depth - 1))


def written(e, latex):
    kind = e[0]
    if kind == "number":
        if e[1].denominator == 1:
            return f"({e[1]})"
        return f"(-\\frac{{{-e[1].numerator}}}{{{e[1].denominator}}})" if latex and e[1] < 0 else f"\\frac{{{e[1].numerator}}}{{{e[1].denominator}}}" if latex else f"({e[1].numerator}/{e[1].denominator})"
    if kind == "variable":
        return e[1]
    if kind == "^":
        return f"\\left({written(e[1], latex)}\\right)^{{{e[2][1]}}}" if latex else f"({written(e[1], latex)})^{e[2][1]}"
    a, b = written(e[1], latex), written(e[2], latex)
    return f"({a} + {b})" if kind == "+" else f"({a} \\cdot {b})" if latex else f"({a})({b})"


def expanded(terms):
    return " + ".join(f"({v.numerator}/{v.denominator})*x^{i}*y^{j}" for (i, j), v in terms.items()) or "0"


def test_identity_against_exact_polynomials():
    rng = random.Random(5)
    for _ in range(300):
        e = some_expression(rng, 4)
        terms = polynomial(e)
        plain, tex = written(e, False), written(e, True)
        if len(plain) > algebra.LONGEST or len(tex) > algebra.LONGEST or len(expanded(terms)) > algebra.LONGEST:
            continue
        assert algebra.equal(plain, tex) and algebra.equal(tex, expanded(terms)), (plain, tex, terms)
        other = plus(terms, {(rng.randint(0, 2), rng.randint(0, 2)): Fraction(1, rng.randint(1, 10**9))})
        assert algebra.equal(plain, expanded(other)) is False
        f = some_expression(rng, 4)
        if len(written(f, True)) <= algebra.LONGEST:
            assert algebra.equal(plain, written(f, True)) is (polynomial(f) == terms)


EQUAL = [
    ("2(x+1)", "2x+2"), ("sqrt(8)", "2 sqrt 2"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt2}{2}"), ("(x^2-1)/(x-1)", "x+1"), ("sqrt(6)", "sqrt2*sqrt3"), ("7 3/4", "31/4"), ("3\\frac12", "7/2"), ("\\sqrt[3]{8}", "2"),
    ("2\\pi", "\\pi+\\pi"), ("sin(x)^2+cos(x)^2", "1"), ("sqrt(4x+4)", "2sqrt(x+1)"), ("e^{2x}", "(e^x)^2"), ("(1+\\sqrt2)^2", "3+2\\sqrt2"), ("\\sqrt{3+2\\sqrt{2}}", "1+\\sqrt{2}"), ("2^{-3}", "1/8"), ("a_1+a_2", "a_2+a_1"),
    ("10^{100}", "10^{99}*10"), ("\\sqrt{-4}", "2i"), ("\\frac{3}{\\sqrt{3}}", "\\sqrt{3}"), ("\\sqrt{\\frac{3}{4}}", "\\frac{\\sqrt3}{2}"), ("|-3|", "3"), ("8^{1/3}", "2"), ("x\\div 2", "\\frac x2"), ("−x", "-x"),
]
DIFFERENT = [("x+1", "x+2"), ("sqrt(5)", "sqrt(3)+sqrt(2)"), ("-x^2", "x^2"), ("|x|", "x"), ("x^y", "y^x"), ("\\sqrt{2}", "1.41421356"), ("x", "y"), ("\\sqrt{7}", "-\\sqrt{7}")]
UNTOLD = [("monday", "dynamo"), ("1/0", "1"), ("", "1"), ("(1", "1"), ("x" * 1001, "x"), ("(" * 70 + "x" + ")" * 70, "x"), ("2+", "2"), ("\\unknown{x}", "x"), ("漢", "x")]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal_expressions(a, b):
    assert algebra.equal(a, b) is True and algebra.equal(b, a) is True


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_expressions(a, b):
    assert algebra.equal(a, b) is False


@pytest.mark.parametrize(("a", "b"), UNTOLD)
def test_expressions_without_an_answer(a, b):
    assert algebra.equal(a, b) is None


def test_roots_modulo_a_prime():
    p, roots = algebra.modulus((2, 3, 5, 7))
    assert all(r * r % p == q for q, r in roots.items()) and algebra._is_prime(p)
    assert algebra.square_part(2**5 * 3**4 * 7) == (36, [2, 7]) and algebra.square_part(1) == (1, [])


def test_tolerant_equality():
    same = [
        ("0.5", "\\frac{1}{2}"), ("1,234", "1234"), ("50%", "0.5"), ("1 1/2", "1.5"), ("(1, 2)", "(1.0,2)"), ("[0, 1)", "[0,1)"), ("Interval.Ropen(0,1)", "[0, 1)"), ("Point(1,2)", "(1, 2)"), ("2\\sqrt{2}", "\\sqrt{8}"),
        ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "[[1,2],[3,4.0]]"), ("\\frac{\\pi}{2}", "1.5708"), ("(x+1,2y)", "(1+x,y+y)"), ("1011_2", "1011"), ("\\left(\\frac12, 3\\right)", "(0.5,3)"), ("1,2,3", "1, 2, 3"), ("x=5", "5"), ("(\\frac{a}{b}, (1,2))", "(a/b, (1, 2))"),
    ]
    for a, b in same:
        assert answers.math_equal(a, b) and answers.math_equal(b, a), (a, b)
    for a, b in (("1", "2"), ("(1,2)", "[1,2]"), ("(1,2)", "(1,2,3)"), ("monday", "dynamo"), ("x+1", "x+2"), ("", "1"), (None, "1"), ("1", None), ("[[1,2],[3,4]]", "[[1,2,3,4]]"), ("1.001", "1")):
        assert not answers.math_equal(a, b), (a, b)


def test_strict_equality():
    for a, b in (("\\frac{1}{2}", "1/2"), ("x+1", "1+x"), ("5.0", "5"), ("3 cm", "3"), ("\\text{yes}", "Yes"), ("3\\frac{1}{2}", "7/2"), ("1,000", "1000"), ("(1, x+1)", "(1, 1+x)"), ("sqrt(8)", "2sqrt(2)"), ("$5", "5"), ("50\\%", "50"), ("90^\\circ", "90"), ("5 minutes", "5")):
        assert answers.strict_equal(a, b), (a, b)
    for a, b in (("2/4", "1/2"), ("5.5", "5"), ("x^{2}", "x*x"), ("(1,2)", "[1,2]"), ("4*1", "4"), ("", "1"), (None, "1"), ("a+b+c", "c+b+a")):
        assert not answers.strict_equal(a, b), (a, b)


def test_normal_forms():
    for a, b in (("\\tfrac{1}{2}", "\\frac12"), ("k=3", "3"), ("\\sqrt3", "\\sqrt{3}"), (".5", "\\frac{1}{2}"), ("3\\text{ cm}", "3"), ("\\frac1{72}", "\\frac{1}{72}"), ("3/4", "\\frac{3}{4}"), ("{.5}", "{0.5}"), ("\\left( 1 \\right)", "(1)"), ("10^\\circ", "10")):
        assert answers.latex_equal(a, b), (a, b)
    assert answers.latex_form("\\frac{72}1") == "\\frac{72}1" and answers.latex_form("\\frac1") == "\\frac1" and answers.latex_form("+3/4") == "+3/4" and answers.latex_form("03/4") == "03/4" and answers.latex_form("") == ""
    assert not answers.latex_equal("\\sqrt", "") and answers.latex_equal("\\sqrt", "\\sqrt") and not answers.latex_equal("1\\text{ a}\\text{ b}", "1")
