"""Streams with state by key (Z02) and a sink that no replay can fill twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import exists

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "conv_id long, turn long, text string, n_tokens int, before int, phase string, kept string"


class Saturation(StatefulProcessor):
    """FEEDING while a conversation is within its word budget, SOLVING for the turn that reaches it, cut
    to the words that fit, DONE after.  The state of a conversation is the number of its words."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "words long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # the shuffle has mixed the turns of this batch; those of one conversation are few
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        used = self.used.get()[0] if self.used.exists() else 0
        out = []
        for turn, text in zip(turns["turn"], turns["text"]):
            words = (text or "").split()
            before, used = used, used + len(words)
            phase = "FEEDING" if used < self.budget else "SOLVING" if before < self.budget else "DONE"
            kept = text if text is None or used <= self.budget else " ".join(words[: max(0, self.budget - before)])
            out.append((key[0], turn, text, len(words), before, phase, kept))
        self.used.update((used,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def saturation_stream(turns: DataFrame, budget: int) -> DataFrame:
    """Z02 over a stream of ``turns(conv_id, turn, text)``: each turn with n_tokens, before, phase and kept, as
    recorded.saturate gives it for a table.  The turns of a conversation come in order of turn, those of
    one micro-batch in any order; conv_id is not null.  State is kept by RocksDB, so it need not fit in memory."""
    turns.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    turns = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(text as string) text").where("conv_id is not null")
    return turns.groupBy("conv_id").transformWithStateInPandas(Saturation(budget), outputStructType=COLUMNS, outputMode="Append", timeMode="None")


def exactly_once(path: str) -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch.  A batch goes to a folder of its own, which a second try overwrites, and
    counts once its commit is there; a batch that is committed is not written again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commit = f"{path}/commits/{batch_id}"
        if exists(spark, commit):
            return
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        p = spark._jvm.org.apache.hadoop.fs.Path(commit)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()

    return handle


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, and of no other."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    ids = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    if not ids:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/batch={i}" for i in ids])


def run_to_end(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that a stream holds now, through a handler; a run that broke off goes on where its checkpoint ends."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
