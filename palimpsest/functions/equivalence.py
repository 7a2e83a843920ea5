"""Symbolic equivalence of answers.

A LaTeX answer becomes a tree; two trees are the same expression if they agree at random
points: modulo two primes, which is exact, where only the four operations and whole powers
occur, else as complex numbers.  Around expressions there are lists, sets, tuples,
intervals, unions, matrices and relations.  The JVM decides what it can first; only the
other pairs reach Arrow batches, each different pair of a batch once.
"""

from __future__ import annotations

import cmath
import itertools
import math
import re
from fractions import Fraction
from functools import lru_cache
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

PRIMES = (2**61 - 1, 2**89 - 1)
#: Numbers are equal within this share; a decimal also equals what rounds to it at six places.
CLOSE, DECIMAL = 1e-9, 5e-7

_SPELLING = [
    (r"\\(?:left|right|displaystyle|limits|[bB]igg?[lr]?)(?![A-Za-z])|\\[,!;: ]|\\q?quad|~|\$|\\%|%|\^\{?\\circ\}?|\\degree|°|\{,\}", " "),
    (r"\\[dtc]frac", r"\\frac"),
    (r"\\(?:cdot|times|ast)(?![A-Za-z])|×|⋅", "*"),
    (r"\\div(?![A-Za-z])|÷", "/"),
    (r"\\(?:leq?|leqslant)(?![A-Za-z])|≤", "≤"),
    (r"\\(?:geq?|geqslant)(?![A-Za-z])|≥", "≥"),
    (r"\\lt(?![A-Za-z])", "<"),
    (r"\\gt(?![A-Za-z])", ">"),
    (r"\\(?:lbrace|lb)(?![A-Za-z])", r"\\{"),
    (r"\\(?:rbrace|rb)(?![A-Za-z])", r"\\}"),
    (r"\\cup(?![A-Za-z])", "∪"),
    (r"\\in(?![A-Za-z])", "∈"),
    (r"\\pi(?![A-Za-z])", "π"),
    (r"\\infty(?![A-Za-z])", "∞"),
    (r"−|–", "-"),
    (r"\*\*", "^"),
]
_WORDY = re.compile(r"\\(?:text|textbf|textit|mathrm|mathbf|mbox|operatorname)\s*\{([^{}]*)\}")
_TOKEN = re.compile(r"\\[A-Za-z]+|\\[{}|]|\d+(?:\.\d+)?|\.\d+|\S")
_OPEN, _SHUT = {"(", "[", "{", "\\{"}, {")", "]", "}", "\\}"}
_FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh,
    "ln": cmath.log, "exp": cmath.exp, "abs": abs, "factorial": lambda x: cmath.exp(math.lgamma(x.real + 1)),
}
_CONSTANTS = {"π": cmath.pi, "e": cmath.e, "i": 1j, "∞": cmath.inf}


class Unreadable(ValueError):
    """Not an expression of this grammar."""


class Irrational(ValueError):
    """Not a rational function: no value modulo a prime."""


class Reader:
    """Recursive descent over tokens; trees are ("num", Fraction, is_decimal), ("name", x), (operator, a, b)
    with one of + * / ^, and (function, a)."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or (wanted and got not in wanted):
            raise Unreadable(got)
        self.at += 1
        return got

    def whole(self):
        tree = self.total()
        if self.peek():
            raise Unreadable(self.peek())
        return tree

    def total(self):
        tree, sign = None, 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        while True:
            part = self.product()
            part = part if sign == 1 else ("*", _number(-1), part)
            tree = part if tree is None else ("+", tree, part)
            if self.peek() not in ("+", "-"):
                return tree
            sign = 1
            while self.peek() in ("+", "-"):
                sign = -sign if self.take() == "-" else sign

    def product(self):
        tree = self.power()
        while True:
            x = self.peek()
            if x in ("*", "/"):
                self.take()
                sign = -1 if self.peek() == "-" and self.take() else 1
                right = self.power()
                tree = (x, tree, right if sign == 1 else ("*", _number(-1), right))
            elif x == "\\frac" and tree[0] == "num" and tree[1].denominator == 1 and re.fullmatch(r"\d+", self.tokens[self.at - 1]):
                part = self.power()  # a mixed number, unless its fraction is none of numbers
                mixed = part[0] == "/" and part[1][0] == part[2][0] == "num"
                tree = ("+" if mixed else "*", tree, part)
            elif x in ("(", "[", "{") or re.match(r"[A-Za-z\d.π∞]", x) or (x[:1] == "\\" and x not in _SHUT and x not in _OPEN):
                tree = ("*", tree, self.power())
            else:
                return tree

    def power(self):
        tree = self.atom()
        while self.peek() in ("^", "!"):
            tree = ("factorial", tree) if self.take() == "!" else ("^", tree, self.argument())
        return tree

    def argument(self):
        """A group in braces, or one token; of a number its first digit."""
        if self.peek() == "{":
            return self.group("}")
        if self.peek() == "-":
            self.take()
            return ("*", _number(-1), self.argument())
        x = self.peek()
        if re.fullmatch(r"\d{2,}(\.\d+)?", x):
            self.tokens[self.at : self.at + 1] = [x[0], x[1:]]
        return self.atom()

    def group(self, shut: str):
        self.take()
        tree = self.total()
        self.take(shut)
        return tree

    def atom(self):
        x = self.peek()
        if x in ("(", "[", "{"):
            return self.group({"(": ")", "[": "]", "{": "}"}[x])
        if x in ("|", "\\|"):
            return ("abs", self.group(x))
        self.take()
        if re.match(r"[\d.]", x):
            return ("num", Fraction(x), "." in x)
        if x == "\\frac":
            return ("/", self.argument(), self.argument())
        if x == "\\binom":
            n, k = self.argument(), self.argument()
            return ("/", ("factorial", n), ("*", ("factorial", k), ("factorial", ("+", n, ("*", _number(-1), k)))))
        if x == "\\sqrt":
            degree = self.group("]") if self.peek() == "[" else _number(2)
            return ("^", self.argument(), ("/", _number(1), degree))
        name = x.lstrip("\\")
        if name == "log":
            base = self.argument() if self.peek() == "_" and self.take() else _number(10)
            return ("/", ("ln", self.applied()), ("ln", base))
        if x[0] == "\\" and name in _FUNCTIONS:
            raised = self.argument() if self.peek() == "^" and self.take() else None
            tree = (name, self.applied())
            return tree if raised is None else ("^", tree, raised)
        if re.fullmatch(r"\\?[A-Za-z]+|π|∞", x):
            if self.peek() == "_":
                self.take()
                x += f"_{self.argument()}"
            return ("name", x)
        raise Unreadable(x)

    def applied(self):
        """What a function is applied to: a group, or the factors up to a sign."""
        return self.atom() if self.peek() in ("(", "{", "[") else self.power()


def _number(n: int):
    return ("num", Fraction(n), False)


def _names(tree) -> set[str]:
    return {tree[1]} - set(_CONSTANTS) if tree[0] == "name" else set() if tree[0] == "num" else set().union(*map(_names, tree[1:]))


def _decimal(tree) -> bool:
    return tree[2] if tree[0] == "num" else False if tree[0] == "name" else any(map(_decimal, tree[1:]))


def _rational(tree) -> Fraction:
    """The value of a small constant exponent."""
    kind = tree[0]
    if kind == "num":
        return tree[1]
    if kind not in ("+", "*", "/"):
        raise Irrational(kind)
    a, b = _rational(tree[1]), _rational(tree[2])
    return a + b if kind == "+" else a * b if kind == "*" else a / b


def modular(tree, p: int, salt: str) -> int:
    """Value in the field of p elements, at the point that salt names."""
    kind = tree[0]
    if kind == "num":
        return tree[1].numerator * pow(tree[1].denominator, -1, p) % p
    if kind == "name" and tree[1] not in _CONSTANTS:
        return (crc32(f"{salt}|{tree[1]}".encode()) * 0x9E3779B97F4A7C15 + 12345) % p
    if kind == "^":
        n = _rational(tree[2])
        if n.denominator != 1:
            raise Irrational(kind)
        return pow(modular(tree[1], p, salt), int(n), p)
    if kind not in ("+", "*", "/"):
        raise Irrational(kind)
    a, b = modular(tree[1], p, salt), modular(tree[2], p, salt)
    return (a + b if kind == "+" else a * b if kind == "*" else a * pow(b, -1, p)) % p


def numeric(tree, salt: str) -> complex:
    """Value at positive numbers that salt names."""
    kind = tree[0]
    if kind == "num":
        return complex(tree[1])
    if kind == "name":
        return complex(_CONSTANTS[tree[1]]) if tree[1] in _CONSTANTS else 0.5 + 2 * crc32(f"{salt}|{tree[1]}".encode()) / 2**32 + 0j
    if kind == "^":
        a, b = numeric(tree[1], salt), numeric(tree[2], salt)
        n = 1 / b if b else 0
        if a.imag == 0 and a.real < 0 and abs(n - round(n.real)) < 1e-12 and round(n.real) % 2:
            return complex(-((-a.real) ** b.real))  # an odd root of a negative number is real here
        return a**b
    if kind in _FUNCTIONS:
        return complex(_FUNCTIONS[kind](numeric(tree[1], salt)))
    a, b = numeric(tree[1], salt), numeric(tree[2], salt)
    return a + b if kind == "+" else a * b if kind == "*" else a / b


def _near(x: complex, y: complex, within: float) -> bool:
    return x == y or abs(x - y) <= within * max(1.0, abs(x), abs(y))


def same_expression(a, b) -> bool:
    """Whether two trees agree at the points tried."""
    try:
        if all(modular(a, p, str(p)) == modular(b, p, str(p)) for p in PRIMES):
            return True
        exact = True
    except Irrational:
        exact = False
    constant = not (_names(a) | _names(b))
    if exact and not (constant and (_decimal(a) or _decimal(b))):
        return False
    values = [(numeric(a, s), numeric(b, s)) for s in (["0"] if constant else ["0", "1", "2"])]
    if constant and (_decimal(a) or _decimal(b)) and all(abs(x - y) <= DECIMAL for x, y in values):
        return True
    return not exact and all(_near(x, y, CLOSE) for x, y in values)


def _split(tokens: list[str], at: set[str]) -> list[list[str]]:
    """Parts between separators that stand in no bracket; the separators are parts themselves."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t in _OPEN) - (t in _SHUT)
        if depth == 0 and t in at:
            parts += [[t], []]
        else:
            parts[-1].append(t)
    return parts


def _answer(tokens: list[str]):
    """("expr", tree), (kind of collection, items), (relation, left, right)."""
    if not tokens:
        raise Unreadable("")
    unions = _split(tokens, {"∪"})
    if len(unions) > 1:
        return ("set", [_answer(x) for x in unions[::2]])
    items = _split(tokens, {",", ";"})
    if len(items) > 1:
        return ("list", [_answer(x) for x in items[::2]])
    if len(tokens) > 2 and tokens[1] == "∈":
        return _answer(tokens[2:])
    sides = _split(tokens, {"=", "<", ">", "≤", "≥"})
    if len(sides) > 1:
        left, (op,), right = sides[0], sides[1], sides[2:] if len(sides) == 3 else []
        if op == "=" and all(x in (["="],) for x in sides[1::2]) and (len(left) == 1 or left[1:2] == ["("] and len(left) == 4):
            return _answer(sides[-1])  # x = 5, f(x) = 5: the value
        if not right:
            raise Unreadable(op)
        a, b = Reader(left).whole(), Reader(right[0]).whole()
        return (op, a, b) if op in "=<≤" else ({">": "<", "≥": "≤"}[op], b, a)
    if tokens[0] in _OPEN and len(tokens) > 2 and tokens[-1] in _SHUT and all(len(x) for x in [tokens[1:-1]]):
        inner = _split(tokens[1:-1], {",", ";"})
        if tokens[0] == "\\{" and tokens[-1] == "\\}":
            return ("set", [_answer(x) for x in inner[::2]])
        if len(inner) > 1:
            return (tokens[0] + tokens[-1], [_answer(x) for x in inner[::2]])
    return ("expr", Reader(list(tokens)).whole())


def plain_text(text: str) -> str:
    return re.sub(r"\s+", " ", _WORDY.sub(lambda m: f" {m[1]} ", text)).strip(" .$").casefold()


@lru_cache(maxsize=1 << 14)
def read_answer(text: str):
    """The answer that a text states; ("text", words) where it is none of the grammar."""
    try:
        t = text.strip()
        if m := re.fullmatch(r"\\begin\{([a-z]*matrix)\}(.*)\\end\{\1\}", t, re.S):
            return ("matrix", [("row", [read_answer(c) for c in row.split("&")]) for row in re.split(r"\\\\", m[2]) if row.strip()])
        for pattern, by in _SPELLING:
            t = re.sub(pattern, by, t)
        t = _WORDY.sub(lambda m: " , " if m[1].strip() in ("and", "or") else " ", t).strip().rstrip(".").strip()
        if re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.\d+)?", t):
            t = t.replace(",", "")
        if "\\pm" in t or "\\mp" in t:
            signs = [dict(zip(("\\pm", "\\mp"), s)) for s in ("+-", "-+")]
            return ("set", [_answer([s.get(x, x) for x in _TOKEN.findall(t)]) for s in signs])
        return _answer(_TOKEN.findall(t))
    except (Unreadable, RecursionError, IndexError, ZeroDivisionError):
        return ("text", plain_text(text))


def _matched(a: list, b: list) -> bool:
    """The same items in any order, however often."""
    return all(any(same_answer(x, y) for y in b) for x in a) and all(any(same_answer(x, y) for x in a) for y in b)


def same_answer(a, b) -> bool:
    kinds = {a[0], b[0]}
    if kinds <= {"set", "list"}:
        return _matched(a[1], b[1])
    if "expr" in kinds and kinds & {"set", "list"}:
        return _matched([a] if a[0] == "expr" else a[1], [b] if b[0] == "expr" else b[1])
    if a[0] != b[0] and not kinds <= {"list", "()"}:
        return False
    if a[0] == "text":
        return a[1] == b[1]
    if a[0] == "expr":
        return same_expression(a[1], b[1])
    if a[0] in ("<", "≤"):
        return same_expression(a[1], b[1]) and same_expression(a[2], b[2])
    if a[0] == "=":  # the same up to a constant factor
        zero = lambda x: ("+", x[1], ("*", _number(-1), x[2]))
        p = PRIMES[1]
        here, there = ([modular(zero(x), p, s) for s in "01"] for x in (a, b))
        return here[0] * there[1] % p == here[1] * there[0] % p and any(here) == any(there)
    return len(a[1]) == len(b[1]) and all(itertools.starmap(same_answer, zip(a[1], b[1])))


def equivalent(a: str, b: str) -> bool:
    """Whether two answers mean the same; equal texts do, whatever they say."""
    if a == b:
        return True
    try:
        x, y = read_answer(a), read_answer(b)
        return plain_text(a) == plain_text(b) if "text" in (x[0], y[0]) else same_answer(x, y)
    except (ArithmeticError, ValueError, RecursionError):
        return False


def _equal_pairs(a, b):
    """Pandas: equivalent() of each pair; null where either is."""
    import pandas as pd

    seen = {p: None if p[0] is None or p[1] is None else equivalent(*p) for p in set(zip(a, b))}
    return pd.Series([seen[p] for p in zip(a, b)], dtype=object)


def _equal_to_any(values, truth):
    """Pandas: an array of equivalent() of each value with the truth; null where either is."""
    import pandas as pd

    keys = [(None if v is None else tuple(v), t) for v, t in zip(values, truth)]
    seen = {k: None if k[0] is None or k[1] is None else [equivalent(v, k[1]) for v in k[0]] for k in set(keys)}
    return pd.Series([seen[k] for k in keys], dtype=object)


def symbolic_equiv(a, b) -> Column:
    """Whether two answers are equal as numbers or strings, else as expressions; null where either is.
    Not for use in a lambda."""
    from .grade import answer_equiv

    a, b = col(a), col(b)
    # no lambda may stand in the arguments, so that plain inequality decides who is asked
    hard = F.pandas_udf(_equal_pairs, "boolean")(F.when(a != b, a), F.when(a != b, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(hard, F.lit(False)) | F.coalesce(answer_equiv(a, b), F.lit(False)))


def symbolic_matches(values, truth, undecided) -> Column:
    """array<boolean>: which of a row's values mean the truth; null where not undecided."""
    return F.pandas_udf(_equal_to_any, "array<boolean>")(F.when(undecided, values), F.when(undecided, truth))
