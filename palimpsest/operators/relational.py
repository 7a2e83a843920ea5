"""Joins, ordering and set operations that the analytics use (J, W, K, U, L rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import marker_segments

MISSING = "ERROR: Missing from batch results"


def join_outputs(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each job with its output by custom_id, else by position (where ``outputs`` has one and
    ``jobs`` too), else an error text; ``refusal`` says whether the output was refused."""
    own = outputs.select("custom_id", F.col("output").alias("_o"), F.col("is_refusal").alias("_r")).where("custom_id is not null")
    out = jobs.join(own, "custom_id", "left")
    if "position" in outputs.columns and "position" in jobs.columns:
        at = outputs.select("position", F.col("output").alias("_p"), F.col("is_refusal").alias("_q"))
        out = out.join(at, "position", "left")
    else:
        out = out.withColumns({"_p": F.lit(None).cast("string"), "_q": F.lit(None).cast("boolean")})
    # a refusal found by position belongs to no id
    return out.withColumn("output", F.coalesce("_o", "_p", F.lit(MISSING))).withColumn("refusal", F.coalesce("_r", F.lit(False))).drop("_o", "_p", "_r", "_q")


def pick_boundary(samples: DataFrame, options: DataFrame) -> DataFrame:
    """For each (id, sample_idx) the option number sample_idx mod count of its id, else the mean of all."""
    w = Window.partitionBy("id").orderBy("pos")
    numbered = options.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    counts = numbered.select("id", "_n").distinct()
    mean = options.agg(F.avg("boundary").alias("_mean"))
    out = samples.join(counts, "id", "left").withColumn("_k", F.pmod("sample_idx", "_n"))
    out = out.join(numbered.select("id", "_k", "boundary"), ["id", "_k"], "left").crossJoin(F.broadcast(mean))  # one row
    return out.withColumn("is_fallback", F.col("boundary").isNull()).withColumn("boundary", F.coalesce(F.col("boundary").cast("double"), "_mean")).drop("_k", "_n", "_mean")


def latest_per_key(df: DataFrame, keys: list[str], order: str, tie: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` (null is least), the first by ``tie`` of
    equals.  Two aggregates, so hot keys are reduced before any shuffle; no key is lost."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    picked = F.min_by(row, F.struct(*tie)) if tie else F.first(row)
    equal = df.groupBy(*keys, F.col(order).alias("_o")).agg(picked.alias("_r"))
    return equal.groupBy(*keys).agg(F.max_by("_r", F.struct(F.col("_o").isNotNull(), "_o")).alias("_r")).select(*keys, "_r.*")


def number_samples(df: DataFrame, key: str, order: str) -> DataFrame:
    """sample_idx, the occurrence number of a row within its key."""
    return df.withColumn("sample_idx", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def contiguous_groups(outputs: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """(keys, num, start, length): runs of adjacent sections with the same number, merged."""
    seg = outputs.select(*keys, F.inline(marker_segments(text)))
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.lag("num").over(w).eqNullSafe(F.col("num")), 0).otherwise(1)
    isl = seg.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return isl.groupBy(*keys, "_island", "num").agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length")).drop("_island")


def longest_target_group(groups: DataFrame, keys: list[str], target: Column) -> DataFrame:
    """The longest run of the target's number, the first of equals."""
    own = groups.where(F.col("num") == target)
    return own.groupBy(*keys).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("_g")).select(*keys, "_g.start", "_g.length")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows; ``order`` must end with a key, so ties are stable."""
    return df.orderBy(*order).limit(k)


def ordered_summaries(df: DataFrame) -> DataFrame:
    """Run summaries by model, dataset and condition, comparisons by their label first."""
    first = ["comparison"] if "comparison" in df.columns else []
    return df.orderBy(*first, "model", "dataset", "condition")


def pool(*parts: DataFrame) -> DataFrame:
    """Union by name, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def not_done(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs whose key is not among the done."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def allow_lists(runs: DataFrame, models=(), datasets=(), techniques=()) -> DataFrame:
    """Rows in every list that is not empty; a technique list matches the condition or the technique."""
    out = runs
    if models:
        out = out.where(F.col("model").isin(*models))
    if datasets:
        out = out.where(F.col("dataset").isin(*datasets))
    if techniques:
        out = out.where(F.col("condition").isin(*techniques) | F.col("technique").isin(*techniques))
    return out
