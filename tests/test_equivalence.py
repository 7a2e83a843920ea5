"""Symbolic equivalence against exact arithmetic on polynomials and fractions, and on pairs decided by hand."""

import random
from fractions import Fraction

import pytest

from palimpsest.functions import equivalence as E
from palimpsest.functions import grade as G

SAME = [
    ("\\frac{1}{2}", "0.5"), ("1\\frac12", "3/2"), ("\\sqrt{8}", "2\\sqrt2"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{x^2-1}{x-1}", "x+1"), ("\\{1,2,3\\}", "3,1,2"), ("(1,2)", "(1, 2.0)"),
    ("[0,1)", "[0, \\frac{2}{2})"), ("x=5", "5"), ("\\text{Even}", "even"), ("50\\%", "50"), ("90^\\circ", "90"), ("1,000", "1000"), ("3\\pm\\sqrt{2}", "3-\\sqrt2, 3+\\sqrt2"),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix} 1 & \\frac42 \\\\ 3 & 4\\end{pmatrix}"), ("2x+4y=6", "x+2y=3"), ("x>3", "3<x"), ("(-\\infty,2)\\cup(3,\\infty)", "(3,\\infty)\\cup(-\\infty,2)"),
    ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"), ("\\sin^2 x+\\cos^2 x", "1"), ("2^{10}", "1024"), ("\\frac{\\pi}{2}", "0.5\\pi"), ("5\\text{ cm}", "5"), ("10!", "3628800"), ("\\binom{5}{2}", "10"),
    ("\\log_2 8", "3"), ("-\\frac{1}{3}", "\\frac{-1}{3}"), ("0.333333", "\\frac13"), ("x \\in [1,2]", "[1,2]"), ("\\sqrt[3]{-8}", "-2"), ("a_1+b", "b+a_{1}"), ("f(x)=x^2", "x^2"), ("$\\frac{3}{4}$.", "0.75"),
    ("|x-1|", "|1-x|"), ("e^{i\\pi}", "-1"), ("2^{1000}", "(2^{500})^2"), ("", ""), ("\\frac{", "\\frac{"),
]
OTHER = [
    ("\\frac12", "\\frac13"), ("x+1", "x-1"), ("(1,2)", "(2,1)"), ("[0,1)", "(0,1)"), ("\\{1,2\\}", "\\{1,3\\}"), ("even", "odd"), ("2^{1000}", "2^{1000}+1"), ("\\sqrt2", "1.41"), ("x<3", "x>3"),
    ("0.33", "\\frac13"), ("", "1"), ("x", "y"), ("1/0", "2/0"), ("2x+4y=6", "x+2y=4"), ("{", "}"), ("\\frac{", "3"), ("9^{9^{9^9}}", "1"), ("(" * 5000, "1"), ("(1,2,3)", "(1,2)"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert E.equivalent(a, b) and E.equivalent(b, a)


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert not E.equivalent(a, b) and not E.equivalent(b, a)


def plus(a, b, by=1):
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + by * v
    return {k: v for k, v in out.items() if v}


def times(a, b):
    out = {}
    for k, v in a.items():
        for l, w in b.items():
            m = (k[0] + l[0], k[1] + l[1])
            out[m] = out.get(m, 0) + v * w
    return {k: v for k, v in out.items() if v}


def expression(rng, depth):
    """(LaTeX, polynomial in x and y as {powers: coefficient})."""
    if depth == 0:
        kind = rng.randrange(4)
        if kind < 2:
            return "xy"[kind], {(1, 0) if kind == 0 else (0, 1): Fraction(1)}
        n, d = rng.randrange(1, 12), rng.randrange(1, 6)
        return (str(n), {(0, 0): Fraction(n)}) if kind == 2 else (rng.choice(["\\frac{%d}{%d}", "(%d/%d)"]) % (n, d), {(0, 0): Fraction(n, d)})
    (a, p), (b, q) = expression(rng, depth - 1), expression(rng, depth - 1)
    kind = rng.randrange(4)
    if kind == 0:
        return f"\\left({a}\\right)+{b}", plus(p, q)
    if kind == 1:
        return f"{a}-({b})", plus(p, q, -1)
    if kind == 2:
        return f"({a}){rng.choice(['', ' ', '*', chr(92) + 'cdot '])}({b})", times(p, q)
    n = rng.randrange(1, 4)
    power = {(0, 0): Fraction(1)}
    for _ in range(n):
        power = times(power, p)
    return f"({a})^{rng.choice(['%d', '{%d}']) % n}", power


def written(p):
    """A polynomial as a sum of terms, in any order."""
    terms = list(p.items())
    random.Random(str(terms)).shuffle(terms)
    return "+".join(f"({c.numerator}/{c.denominator})x^{{{i}}}y^{{{j}}}" for (i, j), c in terms) or "0"


def test_polynomials_against_exact_arithmetic():
    rng = random.Random(1)
    for _ in range(300):
        a, p = expression(rng, rng.randrange(1, 4))
        b, q = expression(rng, rng.randrange(1, 4))
        assert E.equivalent(a, written(p)), a
        assert not E.equivalent(a, written(plus(p, {(rng.randrange(3), rng.randrange(3)): Fraction(1, rng.randrange(1, 9))}))), a
        assert E.equivalent(a, b) == (p == q), (a, b)
        if p and q:
            assert E.equivalent(f"\\frac{{{a}}}{{{b}}}", f"\\frac{{{written(times(p, q))}}}{{{written(times(q, q))}}}"), (a, b)


def test_columns(spark):
    rows = [("\\frac{1}{2}", "0.5"), ("(x+1)^2", "x^2+2x+1"), (None, "1"), ("1", None), (None, None), ("x", "y"), ("", ""), ("(x+1)^2", "x^2+2x+1")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.x for r in df.select(E.symbolic_equiv("a", "b").alias("x")).collect()] == [True, True, None, None, None, False, True, True]
    assert [r.x for r in df.select(G.is_equiv("a", "b", E.symbolic_equiv).alias("x")).collect()] == [True, True, False, False, True, False, True, True]
    assert df.where("false").select(E.symbolic_equiv("a", "b")).collect() == []


def test_grading(spark):
    cases = [
        ("so \\boxed{(x+1)^2}", "x^2+2x+1", "(x+1)^2", True), ("so \\boxed{4} or **2.50**", "\\frac52", "2.50", True), ("we get 7", "7", "7", True), ("\\boxed{x} then 3", "y", "x", False),
        ("none", "1", None, False), (None, "1", None, False), ("\\boxed{1}", None, None, False),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "output string, truth string")
    got = G.with_symbolic_grade(df, "output", "truth")
    assert got.columns == ["output", "truth", "graded"]
    assert [tuple(r.graded) for r in got.collect()] == [c[2:] for c in cases]
    both = spark.createDataFrame([("\\boxed{\\frac{2}{4}} and \\boxed{9}", "1/2")], "output string, truth string")
    assert tuple(G.with_symbolic_grade(both, "output", "truth", "compound").first().graded) == ("\\frac{2}{4}", True)
