"""Person and other proper names without a recogniser (T20): a table of names learned from capitals,
and the mentions of those names.

A word is a name if it has a capital inside sentences and is hardly ever written without one.
Learning is one aggregate over words; mentions are found by an equi-join of the capitalised
words of a text with the table, so both may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import OPENERS

#: Capitals inside sentences that make a name, and the share of all spellings that they must be.
LEAST, SHARE = 2, 0.9
_MATH = r"\$[^$]+\$"
_INSIDE = r"[a-z0-9,;:)] ([A-Z][a-z]+)"
# the ends of a word as SQL's \b has them, by ASCII alone: Java's takes other letters for parts of a word
_START, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_PLAIN = f"{_START}([a-z]+){_END}"
_RUN = f"{_START}([A-Z][a-z]+(?: [A-Z][a-z]+){{0,2}}){_END}"


def _clean(text: str):
    return F.regexp_replace(F.col(text), _MATH, " ")


def learn_names(texts: DataFrame, text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(name, inside, plain): words written with a capital inside a sentence at least ``least`` times, and
    that in at least ``share`` of these and their plain spellings.  Math is left out; null texts teach nothing."""
    found = lambda pattern: F.regexp_extract_all(_clean(text), F.lit(pattern), F.lit(1))
    kinds = F.array(F.struct(F.lit(1).alias("cap"), found(_INSIDE).alias("words")), F.struct(F.lit(0).alias("cap"), F.transform(found(_PLAIN), F.initcap).alias("words")))
    words = texts.select(F.inline(kinds)).select("cap", F.explode("words").alias("name"))
    counts = words.groupBy("name").agg(F.sum("cap").alias("inside"), F.sum(1 - F.col("cap")).alias("plain"))
    return counts.where((F.col("inside") >= least) & (F.col("inside") >= share * (F.col("inside") + F.col("plain"))))


def name_mentions(texts: DataFrame, names: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, names): the distinct names in each text with any, sorted: runs of up to three capitalised words
    outside math, a sentence opener in front taken off, of which every word is in ``names(name)``."""
    opener = "^(?:" + "|".join(OPENERS) + ")(?: |$)"
    runs = F.array_distinct(F.transform(F.regexp_extract_all(_clean(text), F.lit(_RUN), F.lit(1)), lambda r: F.regexp_replace(r, opener, "")))
    rows = texts.select(F.col(key), F.explode(runs).alias("run")).where("run <> ''")
    words = rows.select(key, "run", F.explode(F.array_distinct(F.split("run", " "))).alias("name"))
    different = F.size(F.array_distinct(F.split("run", " ")))
    known = words.join(names.select("name").distinct(), "name").groupBy(key, "run").agg(F.count("*").alias("hits")).where(F.col("hits") == different)
    return known.groupBy(key).agg(F.array_sort(F.collect_list("run")).alias("names"))
