"""Problem tables (S01-S05) and text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import strip, words


def load_problems(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A problem table; ``split`` is a partition column ("all": every split, train before test)."""
    df = spark.read.format(fmt).load(path)
    if split and split != "all" and "split" in df.columns:
        df = df.where(F.col("split") == split)
    return df


def normalise_problems(df: DataFrame, problem: str, answer: str | None = None, id_: str | None = None) -> DataFrame:
    """The engine's problem table (idx, id, problem, answer) from one that has idx; id falls back to idx."""
    fallback = F.col("idx").cast("string")
    return df.select("idx", F.coalesce(F.col(id_).cast("string"), fallback).alias("id") if id_ else fallback.alias("id"), F.col(problem).alias("problem"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer"))


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by idx, dense or not: every partition keeps its own first n."""
    return df.orderBy("idx").limit(n)


def range_filter(spec: str) -> Column:
    """S03: "N" (the first N), "a:b" (end exclusive), "0", "all" or "none" (everything)."""
    spec = spec.strip().lower()
    if spec in ("0", "all", "none", ""):
        return F.lit(True)
    lo, _, hi = spec.partition(":") if ":" in spec else ("0", ":", spec)
    low = F.col("idx") >= int(lo or 0)
    return low & (F.col("idx") < int(hi)) if hi else low


def pick_rows(df: DataFrame, spec: str, n: int | None = None) -> DataFrame:
    """S04: "5", "0-10" (end exclusive, clipped) and lists of them, with ``pick``, the place in the list;
    duplicates are kept.  A range is two bounds however long it is."""
    n = df.count() if n is None else n
    parts, at = [], 0
    for part in spec.split(","):
        lo, dash, hi = part.strip().partition("-")
        if not lo:
            continue
        low, high = (max(0, int(lo)), min(int(hi), n)) if dash else (int(lo), int(lo) + (int(lo) < n))
        if high > low:
            parts.append(F.struct(F.lit(low).cast("bigint").alias("lo"), F.lit(high).cast("bigint").alias("hi"), F.lit(at).cast("bigint").alias("at")))
            at += high - low
    if not parts:
        return df.where(F.lit(False)).withColumn("pick", F.lit(0).cast("bigint"))
    holds = F.filter(F.array(*parts), lambda p: (F.col("idx") >= p["lo"]) & (F.col("idx") < p["hi"]))
    return df.withColumn("pick", F.explode(F.transform(holds, lambda p: p["at"] + F.col("idx") - p["lo"])))


def inspect_row(df: DataFrame, idx: int) -> DataFrame:
    """(field, value) of one row."""
    row = df.where(F.col("idx") == idx)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return row.select(F.inline(fields))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, stripped."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text"))


def book_slice(text, start: str, end: str) -> Column:
    """What stands between two markers (from the start, to the end, where one is missing)."""
    after = F.when(F.instr(text, F.lit(start)) > 0, F.substring(text, F.instr(text, F.lit(start)) + len(start), F.length(text))).otherwise(text)
    return strip(F.when(F.instr(after, F.lit(end)) > 0, F.substring(after, F.lit(1), F.instr(after, F.lit(end)) - 1)).otherwise(after))


def word_chunks(df: DataFrame, text: str, size: int = 1500, min_chars: int = 100) -> DataFrame:
    """One row a chunk of ``size`` words, chunks of min_chars characters or fewer dropped."""
    w = words(F.col(text))
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rest = [c for c in df.columns if c != text]
    own = df.withColumn("_w", w).withColumn("_s", starts)
    out = own.select(*rest, "_w", F.posexplode("_s").alias("chunk", "_at"))
    out = out.select(*rest, "chunk", F.array_join(F.slice("_w", F.col("_at") + 1, F.lit(size)), " ").alias("text"))
    return out.where(F.length("text") > min_chars)
