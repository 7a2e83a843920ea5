"""Prompt construction (B01-B14) as Column and DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import choice, col, let, strip, words
from .extract import CLOSE, OPEN
from .prompt_texts import DECODE_RULES, JUDGE_SYSTEM, JUDGE_TEMPLATE, PROTOCOL_AGENT, PROTOCOL_MODEL, SOLVE_RULES, SYSTEM_PROMPT

NO_RULE = "No Transformation. Solve the problem as is."


def _lookup(name, texts: dict[str, str], default: str) -> Column:
    """A text by technique; only the rows' own branch is evaluated."""
    out = F
    for k, v in texts.items():
        out = out.when(col(name) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def solve_prompt(name, problem, perturbed, agentic: bool = False) -> Column:
    """The user prompt for a technique column, the sanitised problem and its perturbed text.
    baseline is the problem, compound the perturbed text, not_not has no protocol."""
    wrapped = F.concat(F.lit("\nTRANSFORMATION RULE:\n"), _lookup(name, SOLVE_RULES, NO_RULE), F.lit("\n\nTRANSFORMED INPUT:\n"), col(perturbed), F.lit("\n"))
    prefix = PROTOCOL_AGENT if agentic else PROTOCOL_MODEL
    n = col(name)
    return strip(F.when(n == "baseline", col(problem)).when(n == "compound", col(perturbed)).when(n == "not_not", wrapped).otherwise(F.concat(F.lit(prefix + "\n\n"), wrapped)))


def decode_prompt(name, perturbed) -> Column:
    """B02; null for an unknown technique."""
    task = (
        "YOUR TASK:\n1. Read the TRANSFORMATION RULE and the TRANSFORMED INPUT.\n"
        "2. Reverse the transformation and recover the original target problem statement.\n"
        "3. Do not solve the math problem.\n"
        f"4. Output only the recovered problem statement between {OPEN} and {CLOSE}.\n\nTRANSFORMATION RULE:\n"
    )
    rule = F
    for k, v in DECODE_RULES.items():
        rule = rule.when(col(name) == k, F.lit(v))
    return strip(F.concat(F.lit(task), rule, F.lit("\n\nTRANSFORMED INPUT:\n"), col(perturbed), F.lit("\n")))


def passive_prompt(target, body) -> Column:
    """B03"""
    return strip(F.concat(F.lit("Take a look at this historical passage:\n\n"), col(body), F.lit("\n\nSolve the following problem:\n\n"), col(target), F.lit("\n")))


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def messages(user, system: str = SYSTEM_PROMPT) -> Column:
    """array<struct<role, content>> of a system and a user message."""
    return F.array(message("system", system), message("user", col(user)))


def render_messages(msgs) -> Column:
    """B04 without a tokenizer: the contents on lines of their own."""
    return F.array_join(F.transform(col(msgs), lambda m: m["content"]), "\n")


def with_system(msgs, system: str = SYSTEM_PROMPT) -> Column:
    """The conversation without its own system messages, under the standard one."""
    return F.concat(F.array(message("system", system)), F.filter(col(msgs), lambda m: m["role"] != "system"))


def passive_body(source, target_words, *seed) -> Column:
    """The source's words from a seeded offset on, repeated and cut to a number of words."""
    def rotate(w):
        n = F.size(w)
        at = choice(F.greatest(n, F.lit(1)), *seed)
        count = F.when(n > 0, col(target_words)).otherwise(F.lit(0))
        return F.array_join(F.transform(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(w, F.pmod(i + at, n).cast("int"))), " ")

    return let(words(col(source)), rotate)


def matched_body_words(wanted_tokens, skeleton, target) -> Column:
    """B06 by words: how many of a body bring a prompt to wanted_tokens words; one step.  tokens.matched_prompt
    corrects by the tokens of a vocabulary."""
    return F.greatest(col(wanted_tokens) - F.size(words(F.concat_ws(" ", col(skeleton), col(target)))), F.lit(0))


def token_count(t, method: str = "words") -> Column:
    """B14 without a tokenizer: words, words_1_3 (1.3 a word) or chars_4 (a quarter of the characters).
    tokens.exact_token_count counts by a vocabulary."""
    n = F.size(words(col(t)))
    if method == "words":
        return n
    if method == "words_1_3":
        return F.floor(n * 1.3).cast("int")
    if method == "chars_4":
        return F.floor(F.length(col(t)) / 4).cast("int")
    raise ValueError(f"unknown token counter: {method}")


def trim_to_budget(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The longest prefix of each conversation's messages within budget words, and of the next
    message as many words as still fit.  Adds n_tokens, before (words used ahead) and kept."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = turns.withColumn("n_tokens", token_count(text)).withColumn("before", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    out = out.where(F.col("before") < budget)
    fits = F.col("before") + F.col("n_tokens") <= budget
    part = F.array_join(F.slice(words(F.col(text)), F.lit(1), (F.lit(budget) - F.col("before")).cast("int")), " ")
    return out.withColumn("kept", F.when(fits, F.col(text)).otherwise(part))


def within_tolerance(actual, target, tolerance: float) -> Column:
    """B08 (1 %) and B09 (2 %): whether a token count is near enough to its target."""
    return F.abs(col(actual) - col(target)) <= tolerance * col(target)


def judge_prompt(original, output) -> Column:
    """The judge's question about a problem and a model's output."""
    before, middle, after = (F.lit(x) for x in JUDGE_TEMPLATE.replace("{output}", "{target}").split("{target}"))
    return F.concat(before, col(original), middle, col(output), after)


def judge_messages(original, output) -> Column:
    """The judge's system prompt and question as messages."""
    return messages(judge_prompt(original, output), JUDGE_SYSTEM)


def judge_verdict(reply) -> Column:
    """YES anywhere in the reply."""
    return F.coalesce(F.upper(strip(col(reply))).contains("YES"), F.lit(False))


def fill_context(texts: DataFrame, target: int, order: str, text: str = "text") -> DataFrame:
    """Rows in order until a running total of chars_4 tokens reaches target; the row that reaches it is
    the last.  ``order`` is one column, a struct for several.

    Rows are ranged by order; totals of the ranges (one row a partition) are carried on, and only
    inside a range a window adds up, of the ranges that begin below the target."""
    from ..sources.scratch import keep

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(texts.withColumn("n_tokens", token_count(text, "chars_4")).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "fill")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.sum("n_tokens").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_base") < target)
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(base.select("_part", "_base"), "_part").withColumn("total", F.sum("n_tokens").over(within) + F.col("_base"))
    return out.where(F.col("total") - F.col("n_tokens") < target).drop("_part", "_base")
