"""Keyed state over micro-batches against the table form, and a sink under replays and broken runs."""

import random

import pytest

from palimpsest.streaming import keyed, recorded

TURNS = "conv_id long, turn long, text string"


def stream_of(spark, path, per_trigger=1):
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def test_saturation_over_batches(spark, tmp_path):
    """Conversations that go on over several micro-batches, null and empty texts, turns shuffled inside a batch."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice([None, "", "one", "a few words more", " spaced  out words "])) for c in range(25) for t in range(9)]
    for k in range(3):
        part = [r for r in rows if r[1] // 3 == k]
        rng.shuffle(part)
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = f"file://{tmp_path}/out"
    keyed.run_to_end(keyed.saturation_stream(stream_of(spark, f"{tmp_path}/in"), 9), keyed.exactly_once(at), f"{tmp_path}/checkpoint")
    got = {(r.conv_id, r.turn): (r.phase, r.kept, r.n_tokens, r.before) for r in keyed.committed(spark, at, keyed.COLUMNS).collect()}
    want = {(r.conv_id, r.turn): (r.phase, r.kept, r.n_tokens, r.before) for r in recorded.saturate(spark.createDataFrame(rows, TURNS), 9).collect()}
    assert got == want and len(got) == len(rows) and {p for p, *_ in got.values()} == {"FEEDING", "SOLVING", "DONE"}


def test_replays_and_broken_runs(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, i, str(i)) for i in range(5)], TURNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = f"file://{tmp_path}/out"
    sink, calls = keyed.exactly_once(at), []

    def breaks(batch, i):
        calls.append(i)
        if i == 1 and calls.count(1) == 1:
            batch.write.mode("overwrite").parquet(f"{at}/data/batch=1")  # written, but the task that commits is lost
            raise RuntimeError("lost")
        sink(batch, i)
        sink(batch, i)

    with pytest.raises(Exception, match="lost"):
        keyed.run_to_end(stream_of(spark, f"{tmp_path}/in"), breaks, f"{tmp_path}/checkpoint")
    half = keyed.committed(spark, at, TURNS)
    assert half.count() == 5  # what is written but not committed doesn't count
    keyed.run_to_end(stream_of(spark, f"{tmp_path}/in"), breaks, f"{tmp_path}/checkpoint")
    rows = sorted((r.conv_id, r.turn) for r in keyed.committed(spark, at, TURNS).collect())
    assert rows == [(k, i) for k in range(3) for i in range(5)] and calls.count(1) == 2
    assert keyed.committed(spark, f"file://{tmp_path}/none", TURNS).count() == 0
