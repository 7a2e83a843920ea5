"""Column helpers shared by the text functions.

Text functions take and return Columns.  Python's notion of white space (Unicode, with the
separators U+001C..U+001F) is spelled out in WS; plain ``\\s`` in Java is ASCII only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "(?U)[\\s\\x1c-\\x1f]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas
    (the optimizer does not hoist invariants out of a lambda)."""
    return F.transform(F.array(value), body)[0]


def bound(texts: int = 1):
    """Decorator: the first ``texts`` arguments are evaluated once a row, also where the function
    uses them several times or inside lambdas, so functions can be composed freely."""

    def wrap(f):
        @functools.wraps(f)
        def one(a, *rest, **kw):
            return let(col(a), lambda x: f(x, *rest, **kw))

        @functools.wraps(f)
        def two(a, b, *rest, **kw):
            return let(col(a), lambda x: let(col(b), lambda y: f(x, y, *rest, **kw)))

        return one if texts == 1 else two

    return wrap


def chars(t) -> Column:
    """Code points of a text; none for an empty one."""
    return F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))


def words(t) -> Column:
    """Runs of non-white space (Python's str.split())."""
    return F.filter(F.split(t, WS + "+"), lambda x: x != "")


def strip(t) -> Column:
    return F.regexp_replace(F.regexp_replace(t, f"^{WS}+", ""), f"{WS}+\\z", "")


def rstrip(t) -> Column:
    return F.regexp_replace(t, f"{WS}+\\z", "")


def span(n) -> Column:
    """0 .. n-1 as an array; empty for n < 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def ceil_div(a, b) -> Column:
    return F.ceil(a / b).cast("int")


def choice(n, *parts) -> Column:
    """A number in 0 .. n-1 that depends on the parts alone: md5 of them joined by "|", so any
    engine can reproduce it and row order cannot change it."""
    digest = F.md5(F.concat_ws("|", *[F.lit(p).cast("string") if not isinstance(p, Column) else p.cast("string") for p in parts]).cast("binary"))
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n.cast("bigint")).cast("int")
