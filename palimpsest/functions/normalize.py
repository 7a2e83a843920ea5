"""Sanitising and normalising scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import WS, col, strip


def remove_latex_comments(t) -> Column:
    """Per line drop an unescaped % and what follows; keep double backslashes and \\%."""
    return F.regexp_replace(col(t), r"(?d)(\\\\|\\%)|%.*", "$1")


def sanitize_inverted_escapes(t) -> Column:
    """A space between b, n, t, a, f or r and a following backslash."""
    return F.regexp_replace(col(t), r"([bntafr])\\", r"$1 \\")


def flatten_text(t) -> Column:
    """Null is empty, a newline becomes "; "."""
    return F.replace(F.coalesce(col(t), F.lit("")), F.lit("\n"), F.lit("; "))


def sanitize_problem(t) -> Column:
    """N03 after N02 after N01."""
    return flatten_text(sanitize_inverted_escapes(remove_latex_comments(t)))


def drop_blank_lines(t) -> Column:
    """Lines of white space alone go."""
    return F.array_join(F.filter(F.split(col(t), "\n"), lambda x: strip(x) != ""), "\n")


def normalize_text(t) -> Column:
    """Runs of white space become one space, ends stripped."""
    return F.regexp_replace(strip(col(t)), f"{WS}+", " ")


def normalize_for_recovery(t) -> Column:
    """Newlines, fraction commands and the spacing round punctuation made uniform."""
    x = F.replace(col(t), F.lit("\r\n"), F.lit("\n"))
    x = F.replace(F.replace(x, F.lit("\\tfrac"), F.lit("\\frac")), F.lit("\\dfrac"), F.lit("\\frac"))
    x = F.regexp_replace(x, f"{WS}+", " ")
    x = F.regexp_replace(x, f"{WS}+([,.;:!?])", "$1")
    x = F.regexp_replace(x, "([({\\[])" + f"{WS}+", "$1")
    x = F.regexp_replace(x, f"{WS}+" + "([)}\\]])", "$1")
    return strip(x)


def normalize_legacy(t) -> Column:
    """Unwrap \\boxed{x}, drop $ and backslashes, collapse white space."""
    x = F.regexp_replace(col(t), r"\\boxed\{([^}]*)\}", "$1")
    return normalize_text(F.translate(x, "$\\", ""))


def strip_thinking_tags(t) -> Column:
    """Remove the tags of reasoning blocks and keep what they hold."""
    return strip(F.regexp_replace(col(t), r"(?i)</?(think|thinking|reasoning|reflection|scratchpad)[^>]*>", ""))


def safe_name(t) -> Column:
    """/ and space become _."""
    return F.translate(col(t), "/ ", "__")


def size_label(n) -> Column:
    """16000 -> 16K."""
    n = col(n)
    return F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def length_label(n) -> Column:
    """1500 -> 1.5k."""
    n = col(n)
    return F.when(n >= 1000, F.concat(F.round(n / 1000, 1).cast("decimal(18,1)").cast("string"), F.lit("k"))).otherwise(F.round(n).cast("bigint").cast("string"))


def with_label(df: DataFrame, key: str, labels: DataFrame, out: str) -> DataFrame:
    """Left look-up in ``labels(name, label)``, the key itself where it is missing."""
    own = labels.select(F.col("name").alias("_name"), F.col("label").alias("_label"))
    return df.join(own, F.col(key) == F.col("_name"), "left").withColumn(out, F.coalesce("_label", F.col(key))).drop("_name", "_label")
