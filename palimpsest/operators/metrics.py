"""Aggregations over graded results.

Input rows follow one shape, whatever their source: run keys (technique, model, ...), id,
correct, refusal, extracted, tokens, output.  Every operator is a groupBy with partial
aggregation; two-level means group by problem first.  Rates are in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import grade as G
from ..functions.core import col
from .stats import bootstrap_mean, wilson_interval


def count_if(c) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def run_summary(rows: DataFrame, keys: list[str], limit=None) -> DataFrame:
    """Total, correct, failures (error prefix), cut-offs and accuracy of each run."""
    cut = G.cut_off("tokens", limit if limit is not None else F.lit(None).cast("string"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), count_if(F.col("correct")).alias("n_correct"), count_if(G.failed_prefix("extracted")).alias("failures"), count_if(cut).alias("cutoffs"))
    return out.withColumn("accuracy", ratio("n_correct", "total"))


def batch_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A01 with refusals, attempts and accuracy over attempts; failures hold an error anywhere."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), count_if(F.col("correct")).alias("n_correct"), count_if(F.col("refusal")).alias("refusals"), count_if(G.failed_contains("extracted")).alias("failures"))
    out = out.withColumn("attempted", F.col("total") - F.col("refusals"))
    return out.withColumn("accuracy", ratio("n_correct", "total")).withColumn("accuracy_attempted", ratio("n_correct", "attempted"))


def file_analysis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, missing extractions, longest output, truncation suspects, and the mean over
    problems of the pass rate.  Rows that carry a summary must be filtered before (read_results does)."""
    per = rows.groupBy(*keys, "id").agg(
        F.avg(F.col("correct").cast("int")).alias("rate"), F.count("*").alias("n"), count_if(F.col("correct")).alias("c"),
        count_if(G.failed_missing("extracted", "correct")).alias("f"), F.max(F.length("output")).alias("longest"), count_if(G.truncation_suspect("output", "correct")).alias("t"),
    )
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("c").alias("n_correct"), F.sum("f").alias("extraction_failures"), F.max("longest").alias("max_output_length"),
        F.sum("t").alias("truncation_suspects"), F.avg("rate").alias("mean_pass_rate"),
    )
    return out.withColumn("accuracy", ratio("n_correct", "total"))


def output_lengths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, mean tokens of non-empty outputs, failure rate, samples a problem."""
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), count_if(F.col("correct")).alias("c"), F.avg(F.when(F.col("output") != "", F.col("tokens"))).alias("length"),
        count_if(G.failed_missing("extracted", "correct")).alias("f"), F.count_distinct("id").alias("ids"),
    )
    return out.select(*keys, ratio("c", "total").alias("accuracy"), F.coalesce("length", F.lit(0.0)).alias("length"), ratio("f", "total").alias("failure_rate"), ratio("total", "ids").alias("n_samples"))


def decode_summary(rows: DataFrame, keys: list[str], limit=None) -> DataFrame:
    """Recovery and exact rates, missing tags, estimated error rates, cut-offs (tokens against
    ``limit``) and the histogram of residual states (a map)."""
    cut = count_if(G.cut_off("tokens", limit if limit is not None else F.lit(None).cast("string")))
    guessed = count_if(F.col("char_error_rate_estimated"))
    counts = rows.groupBy(*keys, "residual_status").agg(F.count("*").alias("n"), count_if(F.col("recovered")).alias("r"), count_if(F.col("exact_normalized_match")).alias("e"), count_if(~F.col("has_recovered_tags")).alias("m"), guessed.alias("g"), cut.alias("k"))
    out = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("r").alias("r"), F.sum("e").alias("e"), F.sum("m").alias("missing_tags"), F.sum("g").alias("estimated_cer_count"), F.sum("k").alias("max_token_cutoffs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("residual_status", "n")))).alias("residual_status_counts"),
    )
    return out.select(*keys, "total", ratio("r", "total").alias("recovery_rate"), ratio("e", "total").alias("exact_rate"), "missing_tags", "estimated_cer_count", "max_token_cutoffs", "residual_status_counts")


def passive_summary(rows: DataFrame, keys: list[str], averages: list[str]) -> DataFrame:
    """Accuracy and the means of token-accounting columns."""
    return rows.groupBy(*keys).agg(ratio(count_if(F.col("correct")), F.count("*")).alias("accuracy"), *[F.avg(c).alias(f"avg_{c}") for c in averages])


def infer_condition(technique, sub, task=None, num_distractors=None, file_name=None) -> Column:
    """A baseline is named by its sub-directory ("unknown" without one), a decode run by the
    technique in its file name, a passive run by its number of distractors."""
    none = F.lit(None).cast("string")
    t, task = col(technique), col(task) if task is not None else none
    d = col(num_distractors).cast("string") if num_distractors is not None else none
    decode = F.regexp_extract(col(file_name), "_([a-z_]+?)_decode_recovery_", 1) if file_name is not None else F.lit("")
    is_decode = (t == "decode_recovery") | F.coalesce(task == "decode_only_recovery", F.lit(False))
    is_passive = (t == "passive_context") | F.coalesce(task == "equal_length_passive_context", F.lit(False))
    return (
        F.when(t == "baseline", F.concat(F.lit("baseline:"), F.coalesce(F.when(col(sub) != "", col(sub)), F.lit("unknown"))))
        .when(is_decode, F.concat(F.lit("decode_recovery:"), F.coalesce(F.when(decode != "", decode), F.lit("unknown"))))
        .when(is_passive, F.concat(F.lit("passive_context"), F.coalesce(F.concat(F.lit(":d"), d), F.lit(""))))
        .otherwise(t)
    )


def with_success(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``score_key`` and ``success``: recovered where any row of the run has it, else correct."""
    has = F.max(F.col("recovered").isNotNull().cast("int")).over(Window.partitionBy(*keys)) == 1
    out = rows.withColumn("score_key", F.when(has, "recovered").otherwise("correct"))
    return out.withColumn("success", F.coalesce(F.when(has, F.col("recovered")).otherwise(F.col("correct")), F.lit(False)))


def summarize_runs(rows: DataFrame, keys: list[str], draws: int = 10000, seed: int = 42, limit=None, reported=None) -> DataFrame:
    """Successes, rate, Wilson interval, mean over problems with its bootstrap interval (low, high),
    samples a problem, failures, and cut-offs: outputs of at least 98 % of ``limit`` tokens, or where
    there is none the number that ``reported`` (a column, one value a run) holds."""
    cut = G.cut_off("tokens", limit) if limit is not None else F.lit(False)
    told = (reported if reported is not None else F.lit(0)).cast("bigint")
    per = rows.groupBy(*keys, "id").agg(count_if(cut).alias("k"), F.max(told).alias("t"), F.count("*").alias("n"), count_if(F.col("success")).alias("s"), count_if(G.failed_missing("extracted", "correct")).alias("f"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("s").alias("successes"), F.count("*").alias("n_problems"), F.avg(F.col("s") / F.col("n")).alias("problem_mean"),
        F.min("n").alias("min_samples"), F.max("n").alias("max_samples"), F.avg("n").alias("mean_samples"), F.sum("f").alias("failures"),
        F.sum("k").alias("cutoffs"), F.max("t").alias("_told"),
    )
    out = out.withColumn("cutoffs", F.when(F.col("cutoffs") > 0, F.col("cutoffs")).otherwise(F.coalesce("_told", "cutoffs"))).drop("_told")
    low, high = wilson_interval("successes", "total")
    out = out.withColumn("rate", ratio("successes", "total")).withColumn("wilson_low", low).withColumn("wilson_high", high)
    boot = bootstrap_mean(problem_scores(rows, keys), keys, draws, seed).select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return out.join(boot, same).drop(*[f"_{k}" for k in keys])


def problem_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, score): the mean success of each problem of a run."""
    return rows.groupBy(*keys, "id").agg(F.avg(F.col("success").cast("int")).alias("score"))


def metrics_cube(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The metrics of the latest run of each key."""
    from .relational import latest_per_key

    return latest_per_key(runs, keys, order, [])


def pooled_metrics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A10: all runs of a key pooled by raw counts, length weighted by totals."""
    out = runs.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n_correct").alias("n_correct"), F.sum("attempted").alias("attempted"), F.sum("failures").alias("failures"), F.sum(F.col("length") * F.col("total")).alias("_l"))
    return out.select(*keys, "total", "attempted", ratio("n_correct", "total").alias("accuracy"), ratio("n_correct", "attempted").alias("accuracy_attempted"), ratio("failures", "total").alias("failure_rate"), ratio("_l", "total").alias("length"))


def accuracy_drop(cube: DataFrame, baseline: str) -> DataFrame:
    """By model, the mean over other techniques of baseline accuracy less theirs, and the
    attempt rate."""
    base = cube.where(F.col("technique") == baseline).select("model", F.col("accuracy").alias("base"))
    other = cube.where(F.col("technique") != baseline).join(base, "model")
    return other.groupBy("model").agg(F.avg(F.col("base") - F.col("accuracy")).alias("mean_drop"), ratio(F.sum("attempted"), F.sum("total")).alias("attempt_rate"))


def category_means(cube: DataFrame, categories: DataFrame) -> DataFrame:
    """Mean accuracy by model and category of ``categories(technique, category)``; 0 for a category without runs."""
    grid = cube.select("model").distinct().crossJoin(categories.select("category").distinct())
    means = cube.join(categories, "technique").groupBy("model", "category").agg(F.avg("accuracy").alias("m"))
    return grid.join(means, ["model", "category"], "left").select("model", "category", F.coalesce("m", F.lit(0.0)).alias("accuracy"))


def conditional_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Recovery rate, and accuracy among recovered problems (in percent)."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), count_if(F.col("recovered")).alias("n_recovered"), count_if(F.col("recovered") & F.col("correct")).alias("n_solved"))
    return out.withColumn("recovery_rate", ratio("n_recovered", "total")).withColumn("conditional_accuracy", 100 * ratio("n_solved", "n_recovered"))


def global_conditional_accuracy(recoveries: DataFrame, excluded=("baseline", "context_saturation")) -> DataFrame:
    """By model over all techniques but the excluded ones."""
    kept = recoveries.where(~F.col("technique").isin(*excluded))
    return kept.groupBy("model").agg((100 * ratio(F.sum("n_solved"), F.sum("n_recovered"))).alias("conditional_accuracy"))


def accuracy_by_position(baseline: DataFrame, compound: DataFrame) -> DataFrame:
    """Accuracy and cut-off share by model and position: 1 for the baseline, distractors + 1 else."""
    both = baseline.withColumn("position", F.lit(1)).unionByName(compound.withColumn("position", (F.col("num_distractors") + 1).cast("int")), allowMissingColumns=True)
    out = both.groupBy("model", "position").agg(F.count("*").alias("total"), count_if(F.col("correct")).alias("c"), count_if(F.col("cut")).alias("k"))
    return out.select("model", "position", "total", ratio("c", "total").alias("accuracy"), ratio("k", "total").alias("cutoff_rate"))


def section_shares(outputs: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """The share of each problem's section: from the first marker of its number to the next
    first marker (or the end), over the output's length."""
    seg = outputs.withColumn("_total", F.length(text)).select(*keys, "_total", F.inline(X.marker_segments(text)))
    first = seg.groupBy(*keys, "_total", "num").agg(F.min("start").alias("start"))
    end = F.lead("start", 1).over(Window.partitionBy(*keys).orderBy("start"))
    return first.withColumn("end", F.coalesce(end, F.col("_total"))).select(*keys, "num", "start", "end", ratio(F.col("end") - F.col("start"), "_total").alias("share"))


def effort_ratio(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Mean section share by problem number, normalised to sum to 1 within keys."""
    mean = shares.groupBy(*keys, "num").agg(F.avg("share").alias("mean_share"))
    return mean.withColumn("effort", ratio("mean_share", F.sum("mean_share").over(Window.partitionBy(*keys))))


def problem_difficulty(rows: DataFrame) -> DataFrame:
    """Failures, total and mean tokens of each problem over all runs."""
    out = rows.groupBy("id").agg(F.count("*").alias("total"), count_if(~F.coalesce(F.col("correct"), F.lit(False))).alias("failures"), F.avg("tokens").alias("mean_length"))
    return out.withColumn("failure_rate", ratio("failures", "total"))


def difficulty_trend(difficulty: DataFrame) -> DataFrame:
    """Correlation and least-squares line of mean length on failure rate."""
    x, y = F.col("failure_rate"), F.col("mean_length")
    return difficulty.agg(F.corr(x, y).alias("correlation"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def attention_means(mass: DataFrame, merge: dict[str, str], excluded: str = "system") -> DataFrame:
    """Mean mass by layer and merged region over samples, then the mean of layer means as layer
    null, with shares renormalised without one region."""
    region = F.coalesce(*[F.when(F.col("region") == k, F.lit(v)) for k, v in merge.items()], F.col("region"))
    per = mass.groupBy("sample", "layer", region.alias("region")).agg(F.sum("pct").alias("pct"))
    layer = per.groupBy("layer", "region").agg(F.avg("pct").alias("pct"))
    whole = layer.groupBy("region").agg(F.avg("pct").alias("pct")).withColumn("layer", F.lit(None).cast(layer.schema["layer"].dataType))
    out = layer.unionByName(whole)
    rest = F.sum(F.when(F.col("region") != excluded, F.col("pct"))).over(Window.partitionBy("layer"))
    return out.withColumn("share", F.when(F.col("region") != excluded, ratio("pct", rest)))


def token_usage(rows: DataFrame, usage: str = "usage") -> DataFrame:
    """Of a map of token counts: sum, mean and number of its distractor keys, solution and pre-solve."""
    own = F.map_values(F.map_filter(usage, lambda k, _: k.startswith("distractor")))
    total = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("*", total.alias("distractor_sum"), ratio(total, F.size(own)).alias("distractor_mean"), F.size(own).alias("distractor_count"), F.coalesce(F.try_element_at(usage, F.lit("solution")), F.lit(0)).alias("solution_tokens"))


def recovery_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, correct, recovered (the correct ones count as recovered) and both accuracies."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total_samples"), count_if(F.col("correct")).alias("original_correct"), count_if(F.col("correct") | F.col("recovered")).alias("semantic_correct"))
    return out.withColumn("original_accuracy", ratio("original_correct", "total_samples")).withColumn("semantic_accuracy", ratio("semantic_correct", "total_samples"))
