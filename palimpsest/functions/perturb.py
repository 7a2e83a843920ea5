"""Text perturbations and their inverses (T04-T18, R01-R17), all as Column expressions.

Grids are computed cell by cell in closed form from one array of code points.  Each
perturbation is registered with its inverse and its rule texts in REGISTRY; see
register_perturbation for the plug-in point.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import WS, bound, ceil_div, chars, col, let, rstrip, span, strip, words

TAG_A, TAG_B = "<Problem A> ", "<Problem B> "
GRID_START, GRID_END = "GRID START", "GRID END"
LINE_WIDTH = 60


def _grid(rows: Column) -> Column:
    return F.concat(F.lit(GRID_START + "\n"), F.array_join(rows, "\n"), F.lit("\n" + GRID_END))


def _cycle(a: Column, i) -> Column:
    return F.get(a, F.pmod(i, F.size(a)).cast("int"))


def _or_blank(a: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("")))


def _interleave(a: Column, b: Column, sep: str, tag_a: str = "", tag_b: str = "", inner: str | None = None) -> Column:
    inner = sep if inner is None else inner

    def both(x, y):
        n = F.greatest(F.size(x), F.size(y))
        return F.array_join(F.transform(span(n), lambda i: F.concat(F.lit(tag_a), _cycle(x, i), F.lit(inner + tag_b), _cycle(y, i))), sep)

    return let(_or_blank(a), lambda x: let(_or_blank(b), lambda y: both(x, y)))


def _line_pieces(t) -> Column:
    flat = strip(F.replace(col(t), F.lit("\n"), F.lit("; ")))
    return let(flat, lambda f: F.transform(span(ceil_div(F.length(f), F.lit(LINE_WIDTH))), lambda i: F.substring(f, i * LINE_WIDTH + 1, F.lit(LINE_WIDTH))))


@bound(2)
def interleave_lines(a, b) -> Column:
    """60-character pieces of two texts on alternate tagged lines, the shorter repeated."""
    return _interleave(_line_pieces(a), _line_pieces(b), "\n", TAG_A, TAG_B)


@bound(2)
def interleave_words(a, b) -> Column:
    """T05"""
    return _interleave(words(col(a)), words(col(b)), " ")


@bound(2)
def interleave_symbols(a, b) -> Column:
    """T06"""
    return _interleave(chars(col(a)), chars(col(b)), "")


@bound()
def deinterleave_lines(t) -> Column:
    """The lines tagged A, without their tags, joined."""
    kept = F.filter(F.split(col(t), "\n"), lambda x: x.startswith(TAG_A))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, F.lit(len(TAG_A) + 1), F.length(x))), "")


@bound()
def deinterleave_words(t) -> Column:
    """R05"""
    return F.array_join(F.filter(words(col(t)), lambda _, i: i % 2 == 0), " ")


@bound()
def deinterleave_symbols(t) -> Column:
    """R06"""
    return F.array_join(F.filter(chars(col(t)), lambda _, i: i % 2 == 0), "")


@bound()
def reverse_sentences(t) -> Column:
    """Pieces between periods in reverse order; a piece that is empty in front moves to the end."""
    back = F.reverse(F.split(col(t), "\\."))
    moved = lambda r: F.when(F.get(r, 0) == "", F.concat(F.slice(r, 2, F.size(r) - 1), F.array(F.lit("")))).otherwise(r)
    return F.array_join(let(back, moved), ".")


@bound()
def reverse_words(t) -> Column:
    """Words in reverse order, runs of white space where they were."""
    gaps = F.regexp_extract_all(col(t), F.lit(f"({WS}+)"), F.lit(1))

    def rebuilt(own, ws, lead):
        parts = F.transform(F.reverse(own), lambda w, i: F.concat(F.when(lead + i > 0, F.coalesce(F.get(ws, lead + i - 1), F.lit(""))).otherwise(F.lit("")), w))
        tail = F.when(F.size(ws) > F.size(own) - 1 + lead, F.get(ws, F.size(ws) - 1)).otherwise(F.lit(""))
        return F.concat(F.array_join(parts, ""), F.coalesce(tail, F.lit("")))

    return let(words(col(t)), lambda own: let(gaps, lambda ws: let(F.when(col(t).rlike(f"^{WS}"), 1).otherwise(0), lambda lead: rebuilt(own, ws, lead))))


@bound()
def split_reverse(t, separator: str = " ", func: str = "reverse_string") -> Column:
    """Each piece between separators through a named function."""
    if not separator:
        raise ValueError("empty separator")
    if func not in SPLIT_FUNCTIONS:
        raise ValueError(f"unknown function: {func}")
    quoted = "\\Q" + separator + "\\E"
    return F.array_join(F.transform(F.split(col(t), quoted), SPLIT_FUNCTIONS[func]), separator)


SPLIT_FUNCTIONS: dict[str, Callable] = {"reverse_string": F.reverse}


def _rail(c, rails: int) -> Column:
    p = 2 * (rails - 1)
    return F.least(c % p, F.lit(p) - c % p)


@bound()
def rail_fence(t, rails: int = 3) -> Column:
    """A zigzag over rails, dots elsewhere; one rail or fewer leaves the text."""
    t = col(t)
    if rails <= 1:
        return t
    row = lambda ch, r: F.array_join(F.transform(ch, lambda x, c: F.when(_rail(c, rails) == r, x).otherwise(F.lit("."))), "")
    rows = let(chars(t), lambda ch: F.array(*[row(ch, r) for r in range(rails)]))
    return F.when(t == "", F.lit("")).otherwise(_grid(rows))


def _marked_rows(t) -> Column:
    return F.filter(F.split(strip(col(t)), "\n"), lambda x: ~strip(x).isin(GRID_START, GRID_END, ""))


@bound()
def read_rail_fence(t) -> Column:
    """R10"""
    t = col(t)

    def read(rows):
        p = 2 * (F.size(rows) - 1)
        grid = F.transform(rows, chars)
        return let(grid, lambda g: F.array_join(F.transform(span(F.size(F.get(g, 0))), lambda c: F.get(F.get(g, F.least(c % p, p - c % p).cast("int")), c)), ""))

    return let(_marked_rows(t), lambda rows: F.when(F.size(rows) <= 1, F.replace(t, F.lit("\n"), F.lit(""))).otherwise(read(rows)))


@bound()
def rectangle_perimeter(t) -> Column:
    """Clockwise round a flat rectangle; blanks after the end, dots inside.
    The grid has about n * n / 25 cells: meant for problem-sized texts."""
    t = col(t)
    n = F.length(t)
    height = F.greatest(F.lit(3), ceil_div(n + 4, F.lit(10)))

    def grid(ch, h, w):
        at = lambda i: F.coalesce(F.get(ch, i), F.lit(" "))

        def cell(r, c):
            return F.when(r == 0, at(c)).when(c == w - 1, at(w - 1 + r)).when(r == h - 1, at(2 * w + h - 3 - c)).when(c == 0, at(2 * w + 2 * h - 4 - r)).otherwise(F.lit("."))

        return F.transform(span(h), lambda r: F.array_join(F.transform(span(w), lambda c: cell(r, c)), ""))

    width = lambda h: F.greatest(F.lit(2), ceil_div(n - 2 * h + 4, F.lit(2)))
    rows = let(chars(t), lambda ch: let(height, lambda h: let(width(h), lambda w: grid(ch, h, w))))
    return F.when(t == "", F.lit("")).otherwise(_grid(rows))


def _padded(rows: Column) -> Column:
    """Rows as arrays of code points, short ones filled with blanks to the longest."""
    return let(rows, lambda rs: let(F.coalesce(F.array_max(F.transform(rs, F.length)), F.lit(0)), lambda w: F.transform(rs, lambda x: let(chars(x), lambda ch: F.transform(span(w), lambda c: F.coalesce(F.get(ch, c), F.lit(" ")))))))


@bound()
def read_rectangle_perimeter(t) -> Column:
    """R11"""
    t = col(t)

    def read(g):
        h, w = F.size(g), F.size(F.get(g, 0))
        cell = lambda r, c: F.get(F.get(g, r), c)
        place = lambda i: (
            F.when(i < w, cell(F.lit(0), i))
            .when(i < w + h - 1, cell(i - w + 1, w - 1))
            .when(i < 2 * w + h - 2, cell(h - 1, 2 * w + h - 3 - i))
            .otherwise(cell(2 * w + 2 * h - 4 - i, F.lit(0)))
        )
        return F.array_join(F.transform(span(F.when(h == 1, w).otherwise(2 * w + 2 * h - 4)), place), "")

    lines = F.split(t, "\n")
    inner = F.when(F.size(lines) > 2, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return rstrip(let(_padded(inner), lambda g: F.when(F.size(g) == 0, F.lit("")).otherwise(read(g))))


def _snake(t, height: int, index) -> Column:
    t = col(t)

    def grid(ch, w):
        row = lambda r: F.array_join(F.transform(span(w), lambda c: F.coalesce(F.get(ch, index(r, c, w, height)), F.lit(""))), "")
        return F.transform(span(height), row)

    rows = let(chars(t), lambda ch: let(ceil_div(F.length(t), F.lit(height)), lambda w: grid(ch, w)))
    return F.when(t == "", F.lit("")).otherwise(_grid(rows))


@bound()
def snake_vertical(t, height: int = 5) -> Column:
    """Down even columns, up odd ones."""
    return _snake(t, height, lambda r, c, w, h: c * h + F.when(c % 2 == 0, r).otherwise(h - 1 - r))


@bound()
def snake_horizontal(t, height: int = 5) -> Column:
    """Right along even rows, left along odd ones."""
    return _snake(t, height, lambda r, c, w, h: r * w + F.when(r % 2 == 0, c).otherwise(w - 1 - c))


def _between_markers(t) -> Column:
    lines = F.split(t, "\n")

    def rows(ls):
        start = F.array_max(F.transform(ls, lambda x, i: F.when(x.contains(GRID_START), i)))
        end = F.array_min(F.transform(ls, lambda x, i: F.when(x.contains(GRID_END) & ~x.contains(GRID_START), i)))
        bare = F.filter(ls, lambda x: (strip(x) != "") & ~x.isin(GRID_START, GRID_END))
        return F.when(start.isNull() | end.isNull(), bare).otherwise(F.slice(ls, F.coalesce(start, F.lit(0)) + 2, F.greatest(F.coalesce(end - start - 1, F.lit(0)), F.lit(0))))

    return let(lines, rows)


def _read_snake(t, cells) -> Column:
    return let(_padded(_between_markers(col(t))), lambda g: F.when(F.size(g) == 0, F.lit("")).otherwise(cells(g)))


@bound()
def read_snake_vertical(t) -> Column:
    """R12; blanks may follow the text."""
    def cells(g):
        h, w = F.size(g), F.size(F.get(g, 0))
        cell = lambda i: F.get(F.get(g, F.when((i / h).cast("int") % 2 == 0, i % h).otherwise(h - 1 - i % h)), (i / h).cast("int"))
        return F.array_join(F.transform(span(h * w), cell), "")

    return _read_snake(t, cells)


@bound()
def read_snake_horizontal(t) -> Column:
    """R13; a partly filled odd row is read with its blanks first, as the forward grid has no fill."""
    def cells(g):
        h, w = F.size(g), F.size(F.get(g, 0))
        cell = lambda i: F.get(F.get(g, (i / w).cast("int")), F.when((i / w).cast("int") % 2 == 0, i % w).otherwise(w - 1 - i % w))
        return F.array_join(F.transform(span(h * w), cell), "")

    return _read_snake(t, cells)


@bound()
def read_snake_horizontal_exact(t) -> Column:
    """R13 without that: an odd row is read from its own right end, so every text without blanks at a row's end comes back."""
    rows = _between_markers(col(t))
    return F.array_join(F.transform(rows, lambda x, r: F.when(r % 2 == 0, x).otherwise(F.reverse(x))), "")


# Fixed value: the heading of a multi-problem prompt.
COMPOUND_HEADING = "Solve these completely unrelated math problems. For each problem put your final answer within \\boxed{}.\n"


def compound(target, others) -> Column:
    """Numbered problems, the target last; others is an array column."""
    numbered = F.transform(others, lambda p, i: F.concat(F.lit("Problem "), (i + 1).cast("string"), F.lit(":\n"), p, F.lit("\n")))
    last = F.concat(F.lit("Problem "), (F.size(others) + 1).cast("string"), F.lit(":\n"), col(target))
    return F.array_join(F.concat(F.array(F.lit(COMPOUND_HEADING)), numbered, F.array(last)), "\n")


def baseline(t) -> Column:
    """T15"""
    return strip(col(t))


def _swap_halves(t, first) -> Column:
    n = F.length
    return F.array_join(F.transform(F.split(col(t), " "), lambda x: F.when((n(x) < 2) | (strip(x) == ""), x).otherwise(F.concat(F.substring(x, first(n(x)) + 1, n(x)), F.substring(x, F.lit(1), first(n(x)))))), " ")


@bound()
def word_split_swap(t) -> Column:
    """The halves of each word swapped, the first the shorter."""
    return _swap_halves(t, lambda n: F.floor(n / 2).cast("int"))


@bound()
def undo_word_split_swap(t) -> Column:
    """R17"""
    return _swap_halves(t, lambda n: n - F.floor(n / 2).cast("int"))


def undo_not_not(t) -> Column:
    """R01"""
    return F.regexp_replace(col(t), f"not{WS}+not{WS}+".replace("(?U)", ""), "")


@bound()
def undo_context_saturation(t) -> Column:
    """The last paragraph without the two halves of the problem index."""
    last = F.element_at(F.split(col(t), "\n\n"), -1)
    return strip(F.regexp_replace(F.regexp_replace(last, r"(?d)\[\[P.*?\.\s*", ""), r"\S*\]\]\.\s*", ""))


@dataclass(frozen=True)
class Perturbation:
    """apply takes the text column (and the partner's); inverse the perturbed text."""

    name: str
    apply: Callable[..., Column]
    inverse: Callable[[Column], Column] | None = None
    paired: bool = False
    prefix: bool = False  # the inverse returns the text repeated, so it is a prefix of it


REGISTRY: dict[str, Perturbation] = {}


def register_perturbation(name: str, apply, inverse=None, paired: bool = False, prefix: bool = False) -> Perturbation:
    """Add a perturbation; everything that fans out over techniques picks it up."""
    REGISTRY[name] = Perturbation(name, apply, inverse, paired, prefix)
    return REGISTRY[name]


def perturb(name: str, text, partner=None) -> Column:
    """The perturbed text column of a registered technique; ValueError for an unknown name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown perturbation: {name}")
    p = REGISTRY[name]
    if p.paired and partner is None:
        raise ValueError(f"{name} needs a partner text")
    return p.apply(text, partner) if p.paired else p.apply(text)


register_perturbation("baseline", baseline, lambda t: col(t))
register_perturbation("interleaved_context_line", interleave_lines, deinterleave_lines, paired=True, prefix=True)
register_perturbation("interleaved_context_word", interleave_words, deinterleave_words, paired=True, prefix=True)
register_perturbation("interleaved_context_symbol", interleave_symbols, deinterleave_symbols, paired=True, prefix=True)
register_perturbation("sentence_reversal", reverse_sentences, reverse_sentences)
register_perturbation("word_reversal", reverse_words, reverse_words)
register_perturbation("split_reversal", split_reverse, split_reverse)
register_perturbation("rail_fence", rail_fence, read_rail_fence)
register_perturbation("rectangle_perimeter", rectangle_perimeter, read_rectangle_perimeter)
register_perturbation("snake_vertical", snake_vertical, read_snake_vertical)
register_perturbation("snake_horizontal", snake_horizontal, read_snake_horizontal)
register_perturbation("word_split_swap", word_split_swap, undo_word_split_swap)
