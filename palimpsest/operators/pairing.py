"""Pairing, sampling and fan-out of problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import choice


def with_next(problems: DataFrame, idx: str = "idx", text: str = "problem", n: int | None = None) -> DataFrame:
    """``partner``, the text of row (idx + 1) mod n; idx must be 0 .. n-1.

    A self-join on idx rather than a window over all rows, so no task sees the whole table.
    """
    n = problems.count() if n is None else n
    after = problems.select(F.pmod(F.col(idx) - 1 + n, F.lit(n)).alias("_at"), F.col(text).alias("partner"))
    return problems.join(after, F.col(idx) == F.col("_at")).drop("_at")


def sample_others(problems: DataFrame, k: int, seed: int, idx: str = "idx", n: int | None = None, tries: int = 4) -> DataFrame:
    """(idx, pos, other): k distinct other rows for each row of idx 0 .. n-1.

    Draws seeded offsets from a row's own idx and keeps the first k distinct ones, then the next
    free offsets where draws repeat: nothing of size n * n is made.
    """
    n = problems.count() if n is None else n
    k = max(0, min(k, n - 1))
    if k == 0:
        return problems.select(F.col(idx), F.lit(0).alias("pos"), F.col(idx).cast("bigint").alias("other")).where(F.lit(False))
    draws = F.array(*[choice(n - 1, seed, F.col(idx), t) + 1 for t in range(k * tries)])
    spare = F.sequence(F.lit(1), F.lit(min(n - 1, k)))
    offsets = F.slice(F.array_distinct(F.concat(draws, spare)), 1, k)
    return problems.select(F.col(idx), F.posexplode(offsets).alias("pos", "off")).select(idx, "pos", F.pmod(F.col(idx) + F.col("off"), F.lit(n)).cast("bigint").alias("other"))


def replicate(prompts: DataFrame, n_samples: int) -> DataFrame:
    """Each prompt n_samples times, with sample_idx."""
    return prompts.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))


def fan_out(problems: DataFrame, techniques: list[str], text: str, partner: str) -> DataFrame:
    """One row a problem and technique with its perturbed text; a projection, no join."""
    from ..functions.perturb import perturb

    rows = [F.struct(F.lit(t).alias("technique"), perturb(t, F.col(text), F.col(partner)).alias("perturbed")) for t in techniques]
    return problems.select("*", F.inline(F.array(*rows)))


def preview(jobs: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """M rows by least seeded hash."""
    return jobs.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(m)


#: Rows of which other_pairs makes all pairs.
MOST_PAIRED = 20_000


def other_pairs(problems: DataFrame, idx: str = "idx") -> DataFrame:
    """All pairs of different rows of one problem set; of more than MOST_PAIRED rows it is an error, as all
    their pairs are what is asked for.  sample_others pairs tables of any size."""
    if (n := problems.count()) > MOST_PAIRED:
        raise ValueError(f"{n} rows would make {n * (n - 1)} pairs; see sample_others")
    return problems.select(F.col(idx).alias("a")).crossJoin(problems.select(F.col(idx).alias("b"))).where("a <> b")


def indexed(df: DataFrame, order: str) -> DataFrame:
    """``idx`` 0 .. n-1 in order of a column: counts of range partitions, then positions inside
    each, so a task sorts its own range only."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(parts), order).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("_part").orderBy(order)
    return ranged.withColumn("_n", F.row_number().over(within) - 1).join(base, "_part").withColumn("idx", (F.col("_n") + F.col("_base")).cast("bigint")).drop("_part", "_n", "_base")
