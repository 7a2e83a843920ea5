"""Grading (G01-G11) and failure predicates.

answer_equiv compares integers, decimals, percentages and simple fractions, and other answers as
canonical strings, in the JVM; with_symbolic_grade also compares them as expressions.  Another
``equiv`` can be passed to any grader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract as X
from .core import WS, bound, col, let, strip, words
from .equivalence import symbolic_matches

ERROR = "ERROR"


def canonical_answer(t) -> Column:
    """A LaTeX answer with its decoration taken off."""
    x = strip(col(t).cast("string"))
    x = F.regexp_replace(x, r"\\(?:left|right|,|;|!|quad|qquad)", "")
    x = F.regexp_replace(x, r"\\(?:text|mathrm|mbox)\{([^{}]*)\}", "$1")
    x = F.regexp_replace(x, r"\\[td]frac", r"\\frac")
    x = F.translate(x, "$", "")
    x = F.regexp_replace(x, r"(\d),(?=\d{3}(?:\D|\z))", "$1")
    x = F.regexp_replace(x, r"\^\{?\\circ\}?|\\%|%", "")
    return F.regexp_replace(F.regexp_replace(x, f"{WS}+", ""), r"\.\z", "")


def numeric_value(t) -> Column:
    """Integers, decimals, a/b and \\frac{a}{b} as a double; null for anything else."""
    return let(canonical_answer(t), _numeric)


def _numeric(x: Column) -> Column:
    frac = r"\A(-?)\\frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}\z"
    ratio = r"\A(-?\d+(?:\.\d+)?)/(-?\d+(?:\.\d+)?)\z"
    d = lambda c: c.try_cast("double")
    sign = F.when(F.regexp_extract(x, frac, 1) == "-", -1.0).otherwise(1.0)
    return (
        F.when(x.rlike(r"\A[+-]?(\d+(\.\d*)?|\.\d+)\z"), d(x))
        .when(x.rlike(frac), sign * F.try_divide(d(F.regexp_extract(x, frac, 2)), d(F.regexp_extract(x, frac, 3))))
        .when(x.rlike(ratio), F.try_divide(d(F.regexp_extract(x, ratio, 1)), d(F.regexp_extract(x, ratio, 2))))
    )


@bound(2)
def answer_equiv(a, b) -> Column:
    """Equal as numbers within 1e-9, else as canonical strings."""
    na, nb = numeric_value(a), numeric_value(b)
    return F.when(na.isNotNull() & nb.isNotNull(), F.abs(na - nb) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(na))).otherwise(canonical_answer(a) == canonical_answer(b))


def is_equiv(a, b, equiv=answer_equiv) -> Column:
    """Two nulls are equal, one is not."""
    a, b = col(a), col(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.coalesce(equiv(a, b), F.lit(False)))


def last_number(t) -> Column:
    """The last number in a text: what a parse of a whole output falls back on here."""
    return F.try_element_at(F.regexp_extract_all(col(t), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1))


def _filled(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def candidates(output, mode: str = "single") -> Column:
    """Answers of an output in order: the last box (every box in "compound" mode), a bold number, the whole output."""
    output = col(output)
    if mode == "compound":
        boxed = F.filter(F.transform(X.all_boxed(output), lambda b: X.remove_boxed(b)), lambda v: v.isNotNull() & (strip(v) != ""))
    else:
        boxed = F.array_compact(F.array(_filled(X.remove_boxed(X.last_boxed(output)))))
    return F.concat(boxed, F.array_compact(F.array(X.bold_candidate(output), last_number(output))))


def extract_and_grade(output, truth, mode: str = "single", equiv=answer_equiv) -> Column:
    """struct<extracted, correct>.  Candidates are tried in order and correct if any is.  The value is
    the first correct candidate, else the first.  A null truth grades (null, false)."""
    output, truth = col(output), col(truth).cast("string")

    def pick(cands):
        good = F.filter(cands, lambda c: c["ok"])
        return F.struct(F.coalesce(F.get(good, 0)["v"], F.get(cands, 0)["v"]).alias("extracted"), (F.size(good) > 0).alias("correct"))

    graded = let(candidates(output, mode), lambda vs: F.transform(vs, lambda v: F.struct(v.alias("v"), F.coalesce(equiv(v, truth), F.lit(False)).alias("ok"))))
    nothing = F.struct(F.lit(None).cast("string").alias("extracted"), F.lit(False).alias("correct"))
    return F.when(truth.isNull() | output.isNull(), nothing).otherwise(let(graded, pick))


def with_symbolic_grade(rows: DataFrame, output: str, truth: str, mode: str = "single") -> DataFrame:
    """G01 with G04: ``rows`` with ``graded``, the struct of extract_and_grade, where answers are also compared
    as expressions.  Only rows whose first candidate the JVM does not find equal reach Arrow batches,
    with their candidates and not their outputs."""
    t = F.col(truth).cast("string")
    easy = F.transform("_values", lambda v: F.coalesce(answer_equiv(v, t), F.lit(False)))
    rows = rows.withColumn("_values", F.when(t.isNotNull(), candidates(F.col(output), mode))).withColumn("_easy", easy)
    rows = rows.withColumn("_hard", symbolic_matches(F.col("_values"), t, ~F.coalesce(F.get("_easy", 0), F.lit(True))))
    first = F.array_position(F.zip_with("_easy", F.coalesce("_hard", "_easy"), lambda x, y: x | F.coalesce(y, F.lit(False))), True)
    value = F.coalesce(F.when(first > 0, F.get("_values", (first - 1).cast("int"))), F.get("_values", 0))
    return rows.withColumn("graded", F.struct(value.alias("extracted"), F.coalesce(first > 0, F.lit(False)).alias("correct"))).drop("_values", "_easy", "_hard")


def extract_and_grade_passive(output, truth, equiv=answer_equiv) -> Column:
    """A box decides alone where there is one, else the whole output."""
    output, truth = col(output), col(truth).cast("string")
    boxed = _filled(X.remove_boxed(X.last_boxed_from_brace(output)))
    value = F.coalesce(boxed, last_number(output))
    return F.struct(F.when(truth.isNotNull(), value).alias("extracted"), F.coalesce(equiv(value, truth), F.lit(False)).alias("correct"))


def graded_or_error(extracted, error) -> Column:
    """The text of an error in place of a value."""
    return F.when(col(error).isNotNull(), F.concat(F.lit(ERROR + ": "), col(error))).otherwise(col(extracted))


def loops(t, n: int = 10, times: int = 3) -> Column:
    """Whether some n-word phrase occurs ``times`` times or more."""
    def repeated(w):
        grams = F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(w, i + 1, n)))
        s = F.sort_array(grams)
        return let(s, lambda g: F.exists(F.when(F.size(g) >= times, F.sequence(F.lit(0), F.size(g) - times)).otherwise(F.array().cast("array<int>")), lambda i: F.get(g, i) == F.get(g, i + times - 1)))

    return let(words(col(t)), repeated)


def failure_mode(t) -> Column:
    """Loop, wrong_answer or no_conclusion."""
    return F.when(loops(t), "loop").when(col(t).contains("\\boxed"), "wrong_answer").otherwise("no_conclusion")


def keyword_relevance(prompt, output) -> Column:
    """Share of the 4+-letter tokens of the prompt's last line (or last 300 characters if that is
    short) that the output holds."""
    p = strip(col(prompt))
    line = F.element_at(F.split(p, "\n"), -1)
    source = F.lower(F.when(F.length(line) < 50, F.substring(p, F.greatest(F.length(p) - 299, F.lit(1)), F.lit(300))).otherwise(line))
    keys = F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b([a-z0-9]{4,})\b"), F.lit(1)))
    low = F.lower(col(output))
    return let(keys, lambda k: F.coalesce(F.try_divide(F.size(F.filter(k, lambda x: low.contains(x))).cast("double"), F.size(k)), F.lit(0.0)))


# The finish reasons that count as refusals, by provider.
REFUSALS = {"openai": ("content_filter",), "anthropic": ("refusal",), "google": ("SAFETY", "RECITATION", "BLOCKLIST")}


def is_refusal(provider, reason) -> Column:
    """G08"""
    out = F.lit(False)
    for name, reasons in REFUSALS.items():
        out = out | ((col(provider) == name) & col(reason).isin(*reasons))
    return F.coalesce(out, F.lit(False))


def retry_class(message) -> Column:
    """Quota, safety, cache_expired or other, by what an error says."""
    m = F.lower(col(message))
    return (
        F.when(m.rlike("429|quota|rate limit|resource_exhausted|resource exhausted"), "quota")
        .when(m.rlike("safety|blocked|content_filter|recitation"), "safety")
        .when(m.contains("cache") & m.rlike("expired|not found"), "cache_expired")
        .otherwise("other")
    )


def truncation_suspect(output, correct) -> Column:
    """A failure whose last box is open, or that stops without a closing sign."""
    t = strip(col(output))
    end = F.right(t, F.lit(1))
    return ~F.coalesce(col(correct), F.lit(False)) & (t != "") & (t.rlike(r"(?s)\\boxed\{[^}]*\z") | ~end.isin(".", "!", "?", "}", ">", "]"))


def cut_off(tokens, max_tokens, max_model_length=None) -> Column:
    """Tokens reach 98 % of the limit; false where either is no number."""
    limit = col(max_tokens).try_cast("double")
    if max_model_length is not None:
        limit = F.coalesce(limit, col(max_model_length).try_cast("double"))
    return F.coalesce(col(tokens).try_cast("double") >= 0.98 * limit, F.lit(False))


def failed_prefix(extracted) -> Column:
    """F1"""
    return F.coalesce(col(extracted).startswith(ERROR), F.lit(False))


def failed_contains(extracted) -> Column:
    """F2"""
    return F.coalesce(col(extracted).contains(ERROR), F.lit(False))


def failed_missing(extracted, correct) -> Column:
    """F3"""
    return col(extracted).isNull() & ~F.coalesce(col(correct), F.lit(False))
