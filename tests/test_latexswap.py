"""Renaming in LaTeX: what is math, by hand; that nothing else changes and all comes back, on random texts."""

import random
import re

import pytest

from palimpsest.functions import latexswap as X

CASES = [
    ("Let $x=y$ be.", "xy"), ("cost \\$5 and $z$", "z"), ("\\(a\\) or \\[b\\]", "ab"), ("$\\frac{a}{\\sqrt{b}} \\cdot \\sin c$", "abc"), ("$$x$$ then $y$", "xy"),
    ("$x \\text{ if $y$ and z} w$", "wxy"), ("\\mbox{no}", ""), ("\\begin{align*} a&=b \\end{align*} c", "ab"), ("\\begin{equation}e\\end{equation}", "e"), ("\\begin{itemize} x $y$ \\end{itemize}", "y"),
    ("$\\begin{cases} p & q \\end{cases}$", "pq"), ('[asy] draw(A); label("$B$", (0,0)); label( "C", p); [/asy] $D$', "BD"), ('\\begin{asy} label("$k$"); int n; \\end{asy}', "k"), ("an open $x", ""), ("$x$ y $z", "x"), ("a } b { c", ""),
    ("", ""), ("no math", ""), ("$\\text {word} v$", "v"), ("${\\text{a}b}c$", "bc"), ("\\label{x} $A_{ij}^n$", "Aijn"),
]


@pytest.mark.parametrize("text, names", CASES)
def test_what_is_math(text, names):
    assert "".join(sorted({t for t, is_name in X.pieces(text) if is_name})) == "".join(sorted(names))
    assert "".join(t for t, _ in X.pieces(text)) == text


def test_random_texts_come_back():
    rng = random.Random(1)
    parts = ["$", "$$", "\\(", "\\)", "\\[", "\\]", "{", "}", "\\text", "\\frac", "x", "ab", "Z", " ", "\\begin{align}", "\\end{align}", "[asy]", "[/asy]", 'label("$p$")', "\\$", "\\\\", "é", "1", "\n", "_", "label(", '"']
    for i in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        names = X.renaming(7, str(i))
        there = X.renamed(t, names)
        assert X.renamed(there, {b: a for a, b in names.items()}) == t
        assert re.sub("[A-Za-z]", "", there) == re.sub("[A-Za-z]", "", t) and len(there) == len(t)


def test_columns(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    for r in df.select("k", "t", X.swap_math_variables("t", "k").alias("s"), X.undo_math_variables(X.swap_math_variables("t", "k"), "k").alias("b"), X.math_variables("t").alias("v")).collect():
        assert r.b == r.t and (r.v is None) == (r.t is None)
        if r.t is not None:
            assert r.s == X.renamed(r.t, X.renaming(42, str(r.k))) and "".join(r.v) == "".join(sorted(CASES[r.k][1]))


def test_prose_is_scanned_in_stretches():
    """Letters outside math are not looked at one by one."""
    prose = "label me, then a letter " * 1000
    assert X.stretches(f"{prose}$ab$ {prose}") == [(prose, False), ("$", False), ("ab", True), ("$", False), (" " + prose, False)]
    assert X.pieces(prose + "$a+b$") == [(prose, False), ("$", False), ("a", True), ("+", False), ("b", True), ("$", False)]
