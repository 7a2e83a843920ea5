"""Generated algebraic systems (B11): two terms of a domain, an addition, a multiplication and an equality
defined anew, and a question about them.  Text from a typed grammar in Column expressions.

Every formula is defined for all elements of its domain: no roots or quotients, powers and absolute
values only where the domain has them.  So every question has an answer, which tests work out.
All choices are seeded by md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import choice, let

# Fixed value: the placeholder variables of generated systems.
DUMMY_VARIABLES = ["x", "y", "n", "k", "A", "B", "S"]
MODULAR, POLYNOMIALS, MATRICES = "numbers modulo", "polynomials", "matrices"
#: What formulas of a domain are made of: {a} and {b} are the terms, {p} a power.
ATOMS = {
    MODULAR: ("{a}", "{b}", "({a}^{p})", "({b}^{p})", "({a}*{b})", "({a}+{b})", "|{a}-{b}|"),
    POLYNOMIALS: ("{a}", "{b}", "({a}^{p})", "({b}^{p})", "({a}*{b})", "({a}+{b})"),
    MATRICES: ("{a}", "{b}", "({a}*{b})", "({a}+{b})"),
}
JOINS = {MODULAR: ("{l} + {r}", "{l} - {r}", "{l} * {r}", "max({l}, {r})", "min({l}, {r})"), POLYNOMIALS: ("{l} + {r}", "{l} - {r}", "{l} * {r}"), MATRICES: ("{l} + {r}", "{l} - {r}", "{l} * {r}")}
#: When two elements count as equal, by domain: {k} is a number from 2 to 15, {m} from 3 to 50.
EQUALITIES = {
    MODULAR: (
        "{a} - {b} is a multiple of {k}", "the squares of {a} and {b} leave the same remainder by {k}", "{a} and {b} have the same absolute value", "{a} and {b} lie equally far from {k}",
        "{a} and {b} are at most {k} apart", "{a} and {b} add up to {m}", "the product of {a} and {b} leaves 1 by {k}",
    ),
    POLYNOMIALS: ("every coefficient of {a} - {b} is a multiple of {k}", "{a} and {b} agree at {k}", "{a} and {b} add up to {m}"),
    MATRICES: ("every entry of {a} - {b} is a multiple of {k}", "{a} and {b} have the same determinant", "the entries of {a} and {b} differ by at most {k}"),
}
#: Kinds of questions; {c} is a third element.
QUESTIONS = {
    "associativity": "Is ({a} * {b}) * {c} = {a} * ({b} * {c})? Work out both sides by the definition of * and compare them by the definition of =.",
    "sequence": "Let Z_0 = {a} and Z_(n+1) = (Z_n + {b}) * Z_n. Work out Z_1, Z_2 and Z_3 by the definitions. Is Z_3 = Z_0?",
    "distributivity": "Does * distribute over + here? Compare {a} * ({b} + {c}) with ({a} * {b}) + ({a} * {c}) and explain any difference by the definitions.",
    "commutativity": "How far is + from commuting? With X = {a} + {b} and Y = {b} + {a} work out X * Y.",
    "identity": "Is there an element E with {a} + E = {a}? Solve for E by the definition of + and check whether it serves {b} as well.",
}
_DOMAINS = (MODULAR, POLYNOMIALS, MATRICES)


def _filled(template: Column, **parts: Column) -> Column:
    for name, part in parts.items():
        template = F.replace(template, F.lit("{" + name + "}"), part)
    return template


def system(*seed, variables: list[str] | None = None, name=None) -> Column:
    """struct<domain, modulus, a, b, c, add, mul, equality, kind, text> of one system; ``name`` is its number
    in the text (the seed's choice unless given)."""
    names = variables or DUMMY_VARIABLES
    pick = lambda options, *tag: F.element_at(F.array(*[F.lit(o) for o in options]), choice(len(options), *seed, *tag) + 1)
    number = lambda low, high, *tag: (low + choice(high - low + 1, *seed, *tag)).cast("string")
    at = choice(len(names), *seed, "term")
    term = lambda i: F.element_at(F.array(*[F.lit(v) for v in names]), (at + i) % len(names) + 1)
    domain = pick(_DOMAINS, "domain")

    def by_domain(options, *tag):
        out = F
        for d in _DOMAINS:
            out = out.when(domain == d, pick(options[d], *tag))
        return out

    def made(t):
        a, b = t["a"], t["b"]

        def formula(op):
            side = lambda s: _filled(by_domain(ATOMS, op, s), a=a, b=b, p=number(2, 4, op, s, "power"))
            return _filled(by_domain(JOINS, op), l=side("l"), r=side("r"))

        equality = _filled(by_domain(EQUALITIES, "equality"), a=a, b=b, k=number(2, 15, "k"), m=number(3, 50, "m"))
        return F.struct(domain.alias("domain"), number(42, 100, "modulus").alias("modulus"), a.alias("a"), b.alias("b"), F.concat(a, F.lit("_0")).alias("c"), formula("add").alias("add"), formula("mul").alias("mul"), equality.alias("equality"), pick(QUESTIONS, "question").alias("kind"))

    def told(s):
        question = F
        for kind, template in QUESTIONS.items():
            question = question.when(s["kind"] == kind, F.lit(template))
        where = F.when(s["domain"] == MODULAR, F.concat(s["domain"], F.lit(" "), s["modulus"])).otherwise(s["domain"])
        number_ = (choice(900, *seed, "name") + 100 if name is None else name).cast("string")
        text = F.concat(
            F.lit("System "), number_, F.lit(" is about "), where, F.lit(". For elements "), s["a"], F.lit(" and "), s["b"], F.lit(" these hold instead of the usual rules: "),
            s["a"], F.lit(" + "), s["b"], F.lit(" means "), s["add"], F.lit("; "), s["a"], F.lit(" * "), s["b"], F.lit(" means "), s["mul"], F.lit("; "), s["a"], F.lit(" = "), s["b"], F.lit(" holds if "), s["equality"], F.lit(". "),
            _filled(question, a=s["a"], b=s["b"], c=s["c"]),
        )
        return F.struct(*[s[c].alias(c) for c in ("domain", "modulus", "a", "b", "c", "add", "mul", "equality", "kind")], text.alias("text"))

    return let(F.struct(term(0).alias("a"), term(1).alias("b")), lambda t: let(made(t), told))


def distractor(*seed) -> Column:
    """The text of one generated system."""
    return system(*seed)["text"]
