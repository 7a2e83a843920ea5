"""Golden vectors and round trips of the perturbations."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import normalize as N
from palimpsest.functions import perturb as P


def run(spark, rows, *exprs):
    df = spark.createDataFrame(rows, "a string, b string")
    return [tuple(r) for r in df.select(*exprs).collect()]


GOLDEN = [
    (lambda: P.interleave_lines("a", "b"), ("one\ntwo", "z"), "<Problem A> one; two\n<Problem B> z"),
    (lambda: P.interleave_words("a", "b"), ("p q r", "1 2"), "p 1 q 2 r 1"),
    (lambda: P.interleave_words("a", "b"), ("", "1 2"), " 1  2"),
    (lambda: P.interleave_symbols("a", "b"), ("abc", "12"), "a1b2c1"),
    (lambda: P.reverse_sentences("a"), ("Find x. Add 3 to it.", ""), " Add 3 to it.Find x."),
    (lambda: P.reverse_sentences("a"), ("a. b", ""), " b.a"),
    (lambda: P.reverse_sentences("a"), ("", ""), ""),
    (lambda: P.reverse_words("a"), ("a  b\tc", ""), "c  b\ta"),
    (lambda: P.reverse_words("a"), (" x y ", ""), " y x "),
    (lambda: P.reverse_words("a"), ("  ", ""), "  "),
    (lambda: P.split_reverse("a"), ("ab  cd é1", ""), "ba  dc 1é"),
    (lambda: P.rail_fence("a"), ("WEARE", ""), "GRID START\nW...E\n.E.R.\n..A..\nGRID END"),
    (lambda: P.rail_fence("a"), ("W", ""), "GRID START\nW\n.\n.\nGRID END"),
    (lambda: P.rectangle_perimeter("a"), ("abcdefghijkl", ""), "GRID START\nabcde\nl...f\nkjihg\nGRID END"),
    (lambda: P.rectangle_perimeter("a"), ("abc", ""), "GRID START\nab\n c\n  \nGRID END"),
    (lambda: P.snake_vertical("a"), ("abcdefghijkl", ""), "GRID START\najk\nbil\nch\ndg\nef\nGRID END"),
    (lambda: P.snake_horizontal("a"), ("abcdefghijkl", ""), "GRID START\nabc\nfed\nghi\nlkj\n\nGRID END"),
    (lambda: P.snake_horizontal("a"), ("abcdefg", ""), "GRID START\nab\ndc\nef\ng\n\nGRID END"),
    (lambda: P.word_split_swap("a"), ("abcde fg h", ""), "cdeab gf h"),
    (lambda: N.remove_latex_comments("a"), ("a \\% b % c\n% d", ""), "a \\% b \n"),
    (lambda: N.sanitize_inverted_escapes("a"), ("b\\c x\\y", ""), "b \\c x\\y"),
    (lambda: N.flatten_text("a"), ("a\nb", ""), "a; b"),
    (lambda: P.undo_not_not("a"), ("a not not b", ""), "a b"),
    (lambda: N.strip_thinking_tags("a"), ("<think>x</think> y", ""), "x y"),
    (lambda: N.normalize_for_recovery("a"), ("a \\tfrac12 , ( b )", ""), "a \\frac12, (b)"),
]


@pytest.mark.parametrize("expr,row,want", GOLDEN)
def test_golden(spark, expr, row, want):
    assert run(spark, [row], expr().alias("x")) == [(want,)]


def _texts(n=150):
    rng = random.Random(4)
    pool = "abcXYZ019.,;% \t\n\r\\{}é\u00a0\u2003\u2028e\u0301😀"
    out = ["", ".", " ", "a", "\n", "x" * 61]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("name", [n for n, p in P.REGISTRY.items() if p.inverse])
def test_round_trip(spark, name):
    """The inverse gives the text back, up to white space at the ends (grids pad) or repetition (pairs)."""
    p = P.REGISTRY[name]
    texts = _texts()
    if name == "sentence_reversal":  # not an involution for texts that start with a period
        texts = [t for t in texts if not t.startswith(".")]
    if name in ("rail_fence", "rectangle_perimeter", "snake_vertical", "snake_horizontal"):  # grids hold one line
        texts = ["".join(c for c in t if not c.isspace()) for t in texts]
        texts = [t for t in texts if name != "snake_horizontal" or len(t) not in (7, 11)]
    rows = list(zip(texts, texts[1:] + texts[:1]))
    if name == "interleaved_context_symbol":
        rows = [r for r in rows if all(r)]
    if name == "interleaved_context_word":  # a text without words interleaves as "", which the split drops
        rows = [r for r in rows if all(x.split() for x in r)]
    got = run(spark, rows, F.col("a"), p.inverse(P.perturb(name, F.col("a"), F.col("b"))).alias("x"))
    for text, back in got:
        want = " ".join(text.split()) if name == "interleaved_context_word" else text
        if name == "interleaved_context_line":
            want = text.replace("\n", "; ").strip()
        if name == "baseline":
            want = text.strip()
        assert back.startswith(want) if p.prefix else back.rstrip(" ") == want.rstrip(" "), (text, back)


def test_exact_snake(spark):
    rows = [("x" * n, "") for n in range(1, 60)]
    got = run(spark, rows, F.col("a"), P.read_snake_horizontal_exact(P.snake_horizontal("a")).alias("x"))
    assert all(a == b for a, b in got)


def test_unknown(spark):
    with pytest.raises(ValueError):
        P.perturb("no_such", F.col("a"))
    with pytest.raises(ValueError):
        P.split_reverse("a", separator="")
