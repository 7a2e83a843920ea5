"""Stateful operators (Z01-Z04) over recorded turns and arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.core import col, words


def backoff_seconds(attempt, kind) -> Column:
    """The wait after a failed attempt k = 1, 2, ...: quota 30 * 2^(k-1) up to 300, none for
    safety, 2 * k up to five attempts for the rest, null where no retry follows."""
    k = col(attempt)
    quota = F.least(F.lit(30.0) * F.pow(F.lit(2.0), F.least(k, F.lit(10)) - 1), F.lit(300.0)).cast("int")
    return F.when(col(kind) == "quota", quota).when((col(kind) == "other") & (k < 5), (2 * k).cast("int"))


def saturate(turns: DataFrame, budget: int) -> DataFrame:
    """Z02 on recorded turns: phase FEEDING while a conversation is within its word budget, SOLVING for the
    turn that reaches it (cut to the words that fit), DONE after."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.size(words(F.coalesce("text", F.lit(""))))
    out = turns.withColumn("n_tokens", n).withColumn("before", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    total = F.col("before") + F.col("n_tokens")
    phase = F.when(total < budget, "FEEDING").when(F.col("before") < budget, "SOLVING").otherwise("DONE")
    left = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    kept = F.when(total <= budget, F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), F.when(left > 0, left).otherwise(F.lit(0)).cast("int")), " "))
    return out.withColumn("phase", phase).withColumn("kept", kept)


def agent_loop(agents: DataFrame, generate: Callable[[DataFrame], DataFrame], max_steps: int = 20, execute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, history, answer, steps).  Each step, ``generate`` adds a column ``reply`` to the agents still
    active; a boxed answer ends an agent.  Model-written code is never run here: ``execute`` adds a column
    ``observation`` to (id, code) in a place of the caller's choice, and without it code gets a refusal text.
    A step is one checkpointed job, so lineage stays short and lost executors cost one step."""
    state = agents.select("id", F.col("history"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("steps"))
    for _ in range(max_steps):
        active = state.where("answer IS NULL")
        if active.isEmpty():
            break
        said = generate(active.select("id", "history")).select("id", "reply")
        code = said.select("id", X.python_code("reply").alias("code")).where("code IS NOT NULL")
        seen = execute(code) if execute else code.withColumn("observation", F.lit("execution is disabled"))
        step = state.join(said, "id", "left").join(seen.select("id", "observation"), "id", "left")
        alive = F.col("answer").isNull() & F.col("reply").isNotNull()
        more = F.concat(F.array("reply"), F.when(F.col("observation").isNotNull(), F.array(F.concat(F.lit("Observation: "), "observation"))).otherwise(F.array().cast("array<string>")))
        state = step.select(
            "id", F.when(alive, F.concat("history", more)).otherwise(F.col("history")).alias("history"),
            F.coalesce("answer", F.when(alive, X.remove_boxed(X.last_boxed("reply")))).alias("answer"),
            (F.col("steps") + alive.cast("int")).alias("steps"),
        ).checkpoint()
    return state


def poll_results(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A stream of result files; each micro-batch goes to handle(batch, batch_id).  Files are read once:
    the checkpoint remembers them.  ``once`` drains what is there and stops; else the stream stays on."""
    stream = spark.readStream.schema(schema).json(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def poll_batches(tracking: DataFrame, graded: DataFrame) -> DataFrame:
    """Finished batches that are not graded."""
    from ..sources.results import batch_done

    return tracking.where(batch_done("status")).join(graded.select("batch_id").distinct(), "batch_id", "left_anti")


class TableGenerator:
    """Replies looked up in a table of recorded outputs (id, reply)."""

    def __init__(self, outputs: DataFrame):
        self.outputs = outputs

    def __call__(self, agents: DataFrame) -> DataFrame:
        return agents.join(self.outputs.select("id", "reply"), "id", "left")


class MockGenerator:
    """A fixed reply, for dry runs."""

    def __init__(self, reply: str = "\\boxed{0}"):
        self.reply = reply

    def __call__(self, agents: DataFrame) -> DataFrame:
        return agents.withColumn("reply", F.lit(self.reply))


def cache_expired(age, ttl, share: float = 0.9) -> Column:
    """Whether a context cache of ``age`` seconds must be made anew: past ``share`` of its time to live."""
    return age > share * ttl
