"""The bootstrap dealt in blocks against the rule drawn out pick by pick."""

import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import stats


def plain(values, draws, seed):
    """(n, mean, low, high) of scores in order."""
    n, means = len(values), []
    for d in range(draws):
        start = int(md5(f"{seed}|{d}".encode()).hexdigest()[:8], 16) % stats.PRIME
        total = 0.0
        for i in range(n):
            u = (start + i * stats.STEP) % stats.PRIME
            v = (u * u + 1) % stats.PRIME
            total += values[(v * v + u) % stats.PRIME % n]
        means.append(total / n)
    means.sort()
    return n, sum(values) / n, means[int(0.025 * (draws - 1))], means[int(0.975 * (draws - 1))]


@pytest.mark.parametrize("segment", [1 << 18, 7])
def test_against_the_rule(spark, monkeypatch, segment):
    """Keys of one to many scores, of null, with ties; whole and in segments; a last block that is not full."""
    monkeypatch.setattr(stats, "SEGMENT", segment)
    monkeypatch.setattr(stats, "PICKS", 900)
    rng = random.Random(1)
    groups = {("a", 1): 60, ("a", 2): 1, ("b", None): 23, (None, 1): 8, ("c", 3): 7}
    rows = [(m, d, rng.randrange(n), rng.choice([0.0, 0.25, 1.0]), "x") for (m, d), n in groups.items() for _ in range(n)] + [("a", 1, 5, None, "x"), ("z", 9, 1, None, "x")]
    table = spark.createDataFrame(rows, "model string, n_ int, id long, score double, other string")
    got = {(r.model, r.n_): tuple(r)[2:] for r in stats.bootstrap_mean(table, ["model", "n_"], draws=1203, seed=7).collect()}
    assert set(got) == set(groups)
    for key in groups:
        own = sorted((i, s) for m, d, i, s, _ in rows if (m, d) == key and s is not None)
        assert got[key] == pytest.approx(plain([s for _, s in own], 1203, 7), abs=1e-9)
    assert stats.bootstrap_mean(table.where("false"), ["model"]).count() == 0


def test_no_key_is_one_row(spark, monkeypatch):
    """A key's scores reach several rows, and its draws several tasks."""
    monkeypatch.setattr(stats, "SEGMENT", 50)
    table = spark.range(400).select(F.lit("k").alias("model"), "id", (F.col("id") % 3).alias("score"))
    seen = []
    real = stats._draw_sums

    def watched(seed, draws):
        run = real(seed, draws)

        def counted(batches):
            for b in batches:
                assert all(len(x) <= 50 for x in b.column(b.num_columns - 1).to_pylist())
                yield from run(iter([b]))

        seen.append(draws)
        return counted

    monkeypatch.setattr(stats, "_draw_sums", watched)
    (r,) = stats.bootstrap_mean(table, ["model"], draws=1000).collect()
    assert set(seen) == {1000} and r.n == 400 and r.low < r.mean < r.high
