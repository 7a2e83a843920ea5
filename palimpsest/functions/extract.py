"""Extraction scalars (X01-X14) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import bound, chars, col, let, strip, words

#: Names that open an answer box.
BOXES = ("boxed", "fbox")


def _balanced_end(t: Column, start: Column) -> Column:
    """0-based place of the brace that closes the first one at or after start; null if none does."""
    state = "struct<d:int,i:int,e:int>"
    tail = chars(F.substring(t, start + 1, F.length(t)))

    def step(s, c):
        depth = s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        ends = (s["e"] < 0) & (c == "}") & (depth == 0)
        return F.struct(depth.alias("d"), (s["i"] + 1).alias("i"), F.when(ends, s["i"]).otherwise(s["e"]).alias("e")).cast(state)

    first = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(-1).alias("e")).cast(state)
    end = F.aggregate(tail, first, step, lambda s: s["e"])
    return let(end, lambda e: F.when(e >= 0, start + e))


def _last_place(t: Column, what: str) -> Column:
    """0-based place of the last occurrence, null if there is none."""
    at = F.locate(what[::-1], F.reverse(t))
    return F.when(at > 0, F.length(t) - at - len(what) + 1)


@bound()
def last_boxed(t) -> Column:
    """The last \\boxed (else the last \\fbox) with its balanced braces; null if unbalanced."""
    t = col(t)
    start = F.coalesce(_last_place(t, "\\boxed"), _last_place(t, "\\fbox"))

    def cut(s):
        return let(_balanced_end(t, s), lambda e: F.when(e.isNotNull(), F.substring(t, s + 1, e - s + 1)))

    return F.when(start.isNotNull(), let(start, cut))


@bound()
def last_boxed_from_brace(t) -> Column:
    """X01, passive variant: the scan starts at the first brace after the command."""
    t = col(t)
    start = F.coalesce(_last_place(t, "\\boxed"), _last_place(t, "\\fbox"))

    def cut(s):
        brace = F.position(F.lit("{"), t, s + 1) - 1
        return let(brace, lambda b: F.when(b >= 0, let(_balanced_end(t, b), lambda e: F.when(e.isNotNull(), F.substring(t, s + 1, e - s + 1)))))

    return F.when(start.isNotNull(), let(start, cut))


@bound()
def all_boxed(t) -> Column:
    """Every box in order, at any depth of braces.  A box runs from its command to the brace that
    closes the first one after it; one that never closes is none, and boxes inside it count; boxes
    inside another are part of that.

    One pass over commands and braces: an open brace holds the commands that wait for it, and
    closing it gives their boxes; then those that begin inside an earlier one are left out."""
    t = col(t)
    tokens = F.regexp_extract_all(t, F.lit(r"(?s)(\\boxed|\\fbox|[{}]|[^\\{}]+|\\)"), F.lit(1))
    state = "struct<at:int,wait:array<int>,open:array<array<int>>,out:array<struct<start:int,end:int>>>"
    none, nobody = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def step(s, x):
        at = s["at"]
        command, opens = x.isin(*[f"\\{b}" for b in BOXES]), x == "{"
        closes = (x == "}") & (F.size(s["open"]) > 0)
        top = F.element_at(s["open"], -1)
        made = F.transform(F.coalesce(top, none), lambda b: F.struct(b.alias("start"), (at + 1).alias("end")))
        wait = F.when(command, F.concat(s["wait"], F.array(at))).when(opens, none).otherwise(s["wait"])
        stack = F.when(opens, F.concat(s["open"], F.array(s["wait"]))).when(closes, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        out = F.when(closes, F.concat(s["out"], made)).otherwise(s["out"])
        return F.struct((at + F.length(x)).alias("at"), wait.alias("wait"), stack.alias("open"), out.alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("at"), none.alias("wait"), nobody.alias("open"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>").alias("out")).cast(state)
    boxes = F.array_sort(F.aggregate(tokens, start, step, lambda s: s["out"]))
    kind = "struct<last:int,out:array<struct<start:int,end:int>>>"
    first = F.struct(F.lit(0).alias("last"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>").alias("out")).cast(kind)
    outer = lambda s, b: F.when(b["start"] >= s["last"], F.struct(b["end"].alias("last"), F.concat(s["out"], F.array(b)).alias("out")).cast(kind)).otherwise(s)
    return F.transform(F.aggregate(boxes, first, outer, lambda s: s["out"]), lambda b: F.substring(t, b["start"] + 1, b["end"] - b["start"]))


@bound()
def remove_boxed(t) -> Column:
    """What a box holds; null for anything else."""
    t = col(t)
    pattern = r"(?s)\A\\(?:boxed|fbox)\s*\{(.*)\}\z"
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))


@bound()
def simple_answer(t) -> Column:
    """The last flat box, else the last number that a statement of the answer gives (fixed values: both patterns)."""
    t = col(t)
    boxed = F.regexp_extract_all(t, F.lit(r"\\boxed\s*\{([^}]+)\}"), F.lit(1))
    said = F.regexp_extract_all(t, F.lit(r"(?i)(?:The answer is|result is|so|equals)\s*[:=]?\s*(\d{1,4})(?:\.|,|\s|$)"), F.lit(1))
    return F.coalesce(strip(F.try_element_at(boxed, F.lit(-1))), F.try_element_at(said, F.lit(-1)))


def bold_candidate(t) -> Column:
    """The last bold piece of 1 to 40 characters with a digit and no run of four letters (fixed values: the patterns)."""
    found = F.transform(F.regexp_extract_all(col(t), F.lit(r"\*\*([^*]{1,40})\*\*"), F.lit(1)), lambda x: F.regexp_replace(strip(x), r"\.+\z", ""))
    return F.try_element_at(F.filter(found, lambda x: x.rlike("[0-9]") & ~x.rlike("[A-Za-z]{4,}")), F.lit(-1))


OPEN, CLOSE = "<RECOVERED_PROBLEM>", "</RECOVERED_PROBLEM>"


@bound()
def recovered_text(t) -> Column:
    """struct<text, tagged>: the last tagged piece, else the whole; both stripped."""
    t = F.coalesce(col(t), F.lit(""))
    pieces = F.regexp_extract_all(t, F.lit(f"(?is){OPEN}(.*?){CLOSE}"), F.lit(1))
    last = F.try_element_at(pieces, F.lit(-1))
    return F.struct(strip(F.coalesce(last, t)).alias("text"), last.isNotNull().alias("tagged"))


@bound()
def python_code(t, unclosed: bool = True) -> Column:
    """The first fenced Python block, else (unclosed) an open one to the end; null if none."""
    t = col(t)
    closed = r"(?s)```python\s*(.*?)```"
    opened = r"(?s)```python\s*(.*)\z"
    out = F.when(t.rlike(closed), strip(F.regexp_extract(t, closed, 1)))
    return out.when(t.rlike(opened), strip(F.regexp_extract(t, opened, 1))) if unclosed else out


def problem_count(prompt) -> Column:
    """Numbered problems before the last, 0 at least."""
    return F.greatest(F.regexp_count(col(prompt), F.lit(r"Problem \d+:")) - 1, F.lit(0))


def problem_markers(t) -> Column:
    """The numbers of all markers, in order."""
    return F.transform(F.regexp_extract_all(col(t), F.lit(r"Problem\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))


@bound()
def marker_segments(t) -> Column:
    """array<struct<num, start, length>> of the pieces that start at a marker, in order;
    start is a 0-based character place.  Text before the first marker is in none."""
    pieces = F.split(col(t), r"(?=Problem\s*\d)")
    state = "struct<at:int,out:array<struct<num:bigint,start:int,length:int>>>"
    first = F.from_json(F.lit('{"at":0,"out":[]}'), state)

    def step(s, x):
        num = F.regexp_extract(x, r"\AProblem\s*(\d+)", 1).try_cast("bigint")
        row = F.struct(num.alias("num"), s["at"].alias("start"), F.length(x).alias("length"))
        return F.struct((s["at"] + F.length(x)).alias("at"), F.when(num.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(row))).alias("out")).cast(state)

    return F.aggregate(pieces, first, step, lambda s: s["out"])


def system_boundary(t) -> Column:
    """0-based place of the first marker, null if none."""
    at = F.regexp_instr(col(t), F.lit(r"Problem\s*\d+"))
    return F.when(at > 0, at - 1)


def statement_boundary(prompt, number) -> Column:
    """0-based place of "Problem <number>:" in a prompt, null if none."""
    at = F.instr(col(prompt), F.concat(F.lit("Problem "), col(number).cast("string"), F.lit(":")))
    return F.when(at > 0, at - 1)


def char_to_word(t, place) -> Column:
    """Words in the first ``place`` characters, the fallback of tokens.char_to_token."""
    return F.size(words(F.substring(col(t), F.lit(1), col(place))))


def transformed_input(t) -> Column:
    """What follows TRANSFORMED INPUT:, stripped."""
    return strip(F.regexp_extract(col(t), r"(?s)TRANSFORMED INPUT:(.*)", 1))
