"""Statistical operators (Q01-Q04)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col


def wilson_interval(successes, n, z: float = 1.96) -> tuple[Column, Column]:
    """Q01: (low, high) of a proportion, within [0, 1]; nulls for n < 1."""
    s, n = col(successes).cast("double"), col(n).cast("double")
    p, d = s / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = n >= 1
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


#: A pick is made from one md5 a draw by two squarings modulo this prime.
PRIME, STEP = 2147483647, 1640531527


#: Draws dealt out together, scores of a key in one row at most, picks made at a time.
DRAWS, SEGMENT, PICKS = 500, 1 << 18, 1 << 19


def draw_starts(seed: int, draws: int) -> np.ndarray:
    """The numbers that the picks of each draw start from: 32 bits of the md5 of "seed|d"."""
    return np.array([int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:8], 16) % PRIME for d in range(draws)], dtype=np.int64)


def draw_picks(start: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Picks i (columns) of draws (rows), places in 0 .. n-1; integer arithmetic that any engine can repeat."""
    u = (start[:, None] + i[None, :] * STEP) % PRIME
    v = (u * u + 1) % PRIME
    return (v * v + u) % PRIME % n


def _draw_sums(seed: int, draws: int):
    """(keys..., n, base, block, scores) -> (keys..., block, sums): for each draw of the block the sum of
    its picks among the scores at places base, base + 1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = draw_starts(seed, draws)
        for batch in batches:
            sums = []
            ns, bases, blocks = (batch.column(batch.num_columns - k).to_pylist() for k in (4, 3, 2))
            for row, (n, base, block) in enumerate(zip(ns, bases, blocks)):
                scores = batch.column(batch.num_columns - 1)[row].values.to_numpy(zero_copy_only=False)
                own = starts[block * DRAWS : (block + 1) * DRAWS]
                total, width = np.zeros(len(own)), max(1, PICKS // len(own))
                for at in range(0, n, width):
                    place = draw_picks(own, np.arange(at, min(n, at + width), dtype=np.int64), n) - base
                    if len(scores) < n:
                        inside = (place >= 0) & (place < len(scores))
                        total += np.where(inside, scores[np.where(inside, place, 0)], 0.0).sum(axis=1)
                    else:
                        total += scores[place].sum(axis=1)
                sums.append(total)
            keep = [batch.column(i) for i in range(batch.num_columns - 4)]
            names = batch.schema.names[: batch.num_columns - 4]
            yield pa.record_batch([*keep, batch.column(batch.num_columns - 2), pa.array(sums, pa.list_(pa.float64()))], names=[*names, "_block", "_sums"])

    return run


def bootstrap_mean(scores: DataFrame, keys: list[str], draws: int = 10000, seed: int = 42, score: str = "score", order: str = "id") -> DataFrame:
    """Q02: (keys, n, mean, low, high): percentile bootstrap of the mean over a key's rows.

    Pick i of draw d is row draw_picks(start of d, i, n) in order of ``order``, equal ones by score; the
    interval takes the sorted means at int(0.025 (draws - 1)) and int(0.975 (draws - 1)).  One row: itself.
    Null scores count as none: such rows are left out.

    A key's scores lie in segments of SEGMENT, and each (segment, block of DRAWS draws) is a row of its
    own that any task may take; sums of segments are added draw by draw.
    """
    scores = scores.where(F.col(score).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(score).cast("double").alias("_s"))
    own, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_o", "_s")
    placed = scores.select(*keys, "_s", (F.row_number().over(ordered) - 1).alias("_p"), F.count("*").over(own).cast("int").alias("n"), F.avg("_s").over(own).alias("mean"))
    key = [*keys, "n", "mean"]
    parts = placed.groupBy(*key, (F.floor(F.col("_p") / SEGMENT) * SEGMENT).alias("_base")).agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_a"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS)))
    dealt = parts.select(*key, F.col("n").alias("_n"), "_base", blocks.alias("_block"), F.transform("_a", lambda x: x["_s"]).alias("_scores")).repartition(*keys, "_base", "_block")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[: len(key)])
    sums = lambda which: dealt.where(which).mapInArrow(_draw_sums(seed, draws), f"{kinds}, _block int, _sums array<double>")
    # a key of one segment has its sums ready; others are added up draw by draw
    one = sums(F.col("n") <= SEGMENT).groupBy(*key).agg(F.flatten(F.collect_list("_sums")).alias("_x"))
    more = sums(F.col("n") > SEGMENT).select(*key, "_block", F.posexplode("_sums").alias("_d", "_x")).groupBy(*key, "_block", "_d").agg(F.sum("_x").alias("_x"))
    both = one.unionByName(more.groupBy(*key).agg(F.collect_list("_x").alias("_x")))
    means = both.select(*key, F.transform(F.array_sort("_x"), lambda x: x / F.col("n")).alias("_m"))
    at = lambda share: F.get("_m", int(share * (draws - 1)))
    return means.select(*key, at(0.025).alias("low"), at(0.975).alias("high"))


def paired_comparison(a: DataFrame, b: DataFrame, keys: list[str], draws: int = 10000, seed: int = 42) -> DataFrame:
    """On common ids of ``(keys, id, score)``: mean difference a - b, its bootstrap interval
    (low, high) over the ids, and how many ids are better, the same or worse; a_mean and b_mean
    are the means over all ids of either side.  Sides without a common id have null differences."""
    both = a.select(*keys, "id", F.col("score").alias("_a")).join(b.select(*keys, "id", F.col("score").alias("_b")), [*keys, "id"])
    d = F.col("_a") - F.col("_b")
    out = both.groupBy(*keys).agg(F.count("*").alias("n_common"), F.avg(d).alias("mean_diff"), F.count_if(d > 0).alias("better"), F.count_if(d == 0).alias("same"), F.count_if(d < 0).alias("worse"))
    out = out.join(bootstrap_mean(both.withColumn("score", d), keys, draws, seed).select(*keys, "low", "high"), keys)
    means = a.groupBy(*keys).agg(F.avg("score").alias("a_mean")).join(b.groupBy(*keys).agg(F.avg("score").alias("b_mean")), keys)
    return means.join(out, keys, "left").fillna(0, ["n_common", "better", "same", "worse"])


#: Q04: (label, what is compared, its reference condition).
COMPARISONS = (
    ("perturbation_vs_baseline", "perturbation", "baseline:perturb"),
    ("compound_vs_baseline", "compound", "baseline:compound"),
    ("passive_vs_baseline", "passive_context", "baseline:compound"),
    ("passive_vs_compound", "passive_context", "compound"),
)


def plan_comparisons(runs: DataFrame) -> DataFrame:
    """(model, dataset, condition, label, reference, found): which runs are compared with which;
    a missing reference stays visible as found = false."""
    c = F.col("condition")
    passive = c.startswith("passive_context")
    plain = ~c.startswith("baseline") & ~passive & (c != "compound")
    rule = lambda kind: {"perturbation": plain, "passive_context": passive}.get(kind, c == kind)
    options = F.array_compact(F.array(*[F.when(rule(kind), F.struct(F.lit(label).alias("label"), F.lit(ref).alias("reference"))) for label, kind, ref in COMPARISONS]))
    plan = runs.select("model", "dataset", "condition").distinct().select("*", F.inline(options))
    have = runs.select("model", "dataset", F.col("condition").alias("reference")).distinct().withColumn("found", F.lit(True))
    return plan.join(have, ["model", "dataset", "reference"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
