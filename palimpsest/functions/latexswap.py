"""Renaming of variables in LaTeX (T19): letters change where they are math, and nowhere else.

One scan keeps a stack of scopes: math between dollars, \\(..\\), \\[..\\] and in display
environments, text elsewhere and in \\text{..}, drawing code in asy, of which only the text of
labels is LaTeX.  Names of commands and environments are never letters.  The renaming is a
seeded one-to-one map of the alphabet on itself, case by case, so its inverse restores the text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import md5
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

# Environments whose body is math, and commands whose argument is text.
MATH_ENVIRONMENTS = ("equation", "align", "gather", "eqnarray")
TEXT_COMMANDS = ("text", "mbox")
# what can change a scope; letters and other text lie between
_MARK = re.compile(r'\\(?:begin|end)\s*\{[^{}]*\}|\\[A-Za-z]+|\\.|\$\$|\[/?asy\]|label\s*\(\s*"[^"]*"|[$\{\}]', re.S)
_ENVIRONMENT = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}")
_LABEL = re.compile(r'(label\s*\(\s*")([^"]*)(")', re.S)
_LETTERS = frozenset(ascii_lowercase + ascii_uppercase)
_CLOSED_BY = {"\\(": "\\)", "\\[": "\\]", "$": "$", "$$": "$$"}


def stretches(text: str) -> list[tuple[str, bool]]:
    """A text in stretches, in order, and whether the letters of a stretch are math."""
    out: list[tuple[str, bool]] = []
    stack = [("text", "")]
    command = ""  # the command just before, whose argument a group is
    found = [(m.start(), m[0]) for m in _MARK.finditer(text)]
    left = Counter(t for _, t in found)
    end = 0
    for at, t in found:
        left[t] -= 1
        scope, close = stack[-1]
        if end < at:
            between = text[end:at]
            out.append((between, scope == "math"))
            command = command if between.isspace() else ""
        end = at + len(t)
        if m := _ENVIRONMENT.fullmatch(t):
            name = m[2].rstrip("*")
            if m[1] == "begin":
                stack.append(("asy" if name == "asy" else "math" if name in MATH_ENVIRONMENTS else scope, "\\end " + name))
            elif close == "\\end " + name:
                stack.pop()
        elif t == close:
            stack.pop()
        elif scope == "asy":
            if m := _LABEL.fullmatch(t):
                out += [(m[1], False), *stretches(m[2]), (m[3], False)]
                continue
        elif t in _CLOSED_BY and scope != "math" and left[_CLOSED_BY[t]]:
            stack.append(("math", _CLOSED_BY[t]))
        elif t == "[asy]":
            stack.append(("asy", "[/asy]"))
        elif t == "{":
            stack.append(("text" if command in TEXT_COMMANDS else scope, "}"))
        out.append((t, False))
        command = t[1:] if t[0] == "\\" else ""
    if end < len(text):
        out.append((text[end:], stack[-1][0] == "math"))
    return out


def pieces(text: str) -> list[tuple[str, bool]]:
    """A text in pieces, in order, and whether a piece is a letter that is math."""
    return [(t, is_math and t in _LETTERS) for s, is_math in stretches(text) for t in (re.findall("[A-Za-z]|[^A-Za-z]+", s) if is_math else [s])]


@lru_cache(maxsize=4096)
def renaming(seed: int, key: str) -> dict[str, str]:
    """A letter's new name: the letters of its case in order of the md5 of "seed|key|letter"."""
    shuffled = lambda letters: sorted(letters, key=lambda x: md5(f"{seed}|{key}|{x}".encode()).hexdigest())
    return {a: b for letters in (ascii_lowercase, ascii_uppercase) for a, b in zip(letters, shuffled(letters))}


def renamed(text: str, names: dict[str, str]) -> str:
    table = str.maketrans(names)
    return "".join(t.translate(table) if is_math else t for t, is_math in stretches(text))


def _rename(seed: int, back: bool):
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def one(t, k):
            names = renaming(seed, k)
            return renamed(t, {b: a for a, b in names.items()} if back else names)

        return pd.Series([None if t is None or k is None else one(t, k) for t, k in zip(texts, keys)], dtype=object)

    return F.pandas_udf(run, "string")


def swap_math_variables(t, key, seed: int = 42) -> Column:
    """The text with the letters of its math renamed; null for null."""
    return _rename(seed, False)(col(t), col(key).cast("string"))


def undo_math_variables(t, key, seed: int = 42) -> Column:
    """The text that swap_math_variables was given."""
    return _rename(seed, True)(col(t), col(key).cast("string"))


def math_variables(t) -> Column:
    """array<string>: the letters that are math, sorted; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sorted(_LETTERS.intersection("".join(s for s, is_math in stretches(t) if is_math))) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")(col(t))
