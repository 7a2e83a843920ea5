"""Generated systems: every formula is defined everywhere, every question has an answer, choices are spread."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import systems as S


def value(formula, a, b, x, y, times):
    """A formula at two elements, read by another grammar: Python's."""
    code = re.sub(r"\|([^|]*)\|", r"abs(\1)", formula).replace("^", "**").replace("*", "@") if times else re.sub(r"\|([^|]*)\|", r"abs(\1)", formula).replace("^", "**")
    return eval(code.replace("@@", "**"), {"__builtins__": {}}, {a: x, b: y, "abs": abs, "max": max, "min": min})  # noqa: S307


def trimmed(p):
    while p and p[-1] == 0:
        p = p[:-1]
    return p


class Poly(tuple):
    __add__ = lambda s, o: Poly(trimmed(tuple(a + b for a, b in itertools.zip_longest(s, o, fillvalue=0))))
    __sub__ = lambda s, o: Poly(trimmed(tuple(a - b for a, b in itertools.zip_longest(s, o, fillvalue=0))))
    __matmul__ = lambda s, o: Poly(trimmed(tuple(sum(s[i] * o[k - i] for i in range(len(s)) if 0 <= k - i < len(o)) for k in range(max(0, len(s) + len(o) - 1)))))

    def __pow__(self, n):
        out = Poly((1,))
        for _ in range(n):
            out = out @ self
        return out


class Matrix(tuple):
    __add__ = lambda s, o: Matrix(a + b for a, b in zip(s, o))
    __sub__ = lambda s, o: Matrix(a - b for a, b in zip(s, o))
    __matmul__ = lambda s, o: Matrix((s[0] * o[0] + s[1] * o[2], s[0] * o[1] + s[1] * o[3], s[2] * o[0] + s[3] * o[2], s[2] * o[1] + s[3] * o[3]))


def answers(r, rng):
    """Both sides of each kind of question at random elements."""
    mod = int(r.modulus)
    if r.domain == S.MODULAR:
        new = lambda: rng.randrange(mod)
        wrap, times = lambda v: v % mod, False
    elif r.domain == S.POLYNOMIALS:
        new, wrap, times = lambda: Poly(rng.randrange(-3, 4) for _ in range(3)), lambda v: v, True
    else:
        new, wrap, times = lambda: Matrix(rng.randrange(-4, 5) for _ in range(4)), lambda v: v, True
    add = lambda x, y: wrap(value(r.add, r.a, r.b, x, y, times))
    mul = lambda x, y: wrap(value(r.mul, r.a, r.b, x, y, times))
    x, y, z = new(), new(), new()
    return {
        "associativity": lambda: (mul(mul(x, y), z), mul(x, mul(y, z))), "distributivity": lambda: (mul(x, add(y, z)), add(mul(x, y), mul(x, z))), "commutativity": lambda: mul(add(x, y), add(y, x)),
        "sequence": lambda: mul(add(x, y), x), "identity": lambda: [e for e in range(mod) if add(x, e) == x] if r.domain == S.MODULAR else add(x, y),
    }[r.kind]()


def test_every_question_has_an_answer(spark):
    rows = spark.range(1500).select("id", S.system(5, F.col("id")).alias("s")).select("id", "s.*").collect()
    rng = random.Random(1)
    for r in rows:
        for _ in range(3):
            assert answers(r, rng) is not None
        assert "{" not in r.text and r.add in r.text and r.mul in r.text and r.equality in r.text and "\n" not in r.text and r.text.endswith((".", "?"))
        assert r.a != r.b and r.a in S.DUMMY_VARIABLES and r.b in S.DUMMY_VARIABLES
    for field, n in (("domain", 3), ("kind", 5), ("a", 7)):
        found = Counter(getattr(r, field) for r in rows)
        assert len(found) == n and min(found.values()) > 0.7 * len(rows) / n
    assert len({r.add for r in rows}) > 100 and len({re.sub(r"\d+|\b[xynkABS]\b", "", r.equality) for r in rows}) == len(set().union(*S.EQUALITIES.values()))
    again = spark.range(1500).repartition(3).select("id", S.system(5, F.col("id")).alias("s")).select("id", "s.text").collect()
    assert {r.id: r.text for r in again} == {r.id: r.text for r in rows}


def test_bins_are_even(spark):
    keys = spark.range(400).withColumnRenamed("id", "idx")
    rows = L.static_distractors(keys, bins=6).collect()
    assert len(rows) == 400 and {r.bin for r in rows} == set(range(6))
    for v in {r.variable for r in rows}:
        per = Counter(r.bin for r in rows if r.variable == v)
        assert max(per.values()) - min(per[b] for b in range(6)) <= 1
