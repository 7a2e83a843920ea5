"""The inverted file against all pairs: every list opened in time, whatever the centroids."""

import numpy as np

from palimpsest.operators import neighbours as N


def plain(targets, vectors):
    def unit(x):
        if x is None or not len(x) or any(v is None or not np.isfinite(v) for v in x) or not np.linalg.norm(x):
            return None
        return np.array(x) / np.linalg.norm(x)

    vs = [(i, u) for i, x in vectors if (u := unit(x)) is not None]
    out = {}
    for i, x in targets:
        u = unit(x)
        cos = [(float(u @ v), -j) for j, v in vs if j != i] if u is not None else []
        out[i] = (max(cos)[0], {-j for c, j in cos if c > max(cos)[0] - 1e-9}) if cos else (None, {None})
    return out


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 40)
    monkeypatch.setattr(N, "BATCH", 9)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, (centres[i % 12] + rng.normal(size=16) * (0.05 if i % 2 else 1.0)).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[5][1]) for i in range(120)]  # one common vector
    vectors += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [])]
    targets = [v for v in vectors if v[0] % 7 == 0] + [(-1, rng.normal(size=16).tolist()), (900, None), (901, [0.0] * 16)]
    v = spark.createDataFrame(vectors, "id long, embedding array<double>").repartition(3)
    t = spark.createDataFrame(targets, "id long, embedding array<double>")
    want = plain(targets, vectors)
    for lists in (1, 5, 30, None):
        got = {r.id: r for r in N.nearest_vectors(t, v, lists).collect()}
        assert set(got) == set(want)
        for i, (best, ids) in want.items():
            assert (got[i].best is None) == (best is None) and got[i].nearest in ids, (lists, i)
            assert best is None or abs(got[i].best - best) < 1e-9


def test_most_lists_stay_shut(spark):
    """With vectors in tight groups few lists are opened after the first ones."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import pyarrow as pa

    wide = np.full(40, -1.0)
    own = (x @ centres.T).argmax(axis=1)
    for k in range(40):
        if (own == k).any():
            wide[k] = np.arccos(np.clip((x[own == k] @ centres[k]).min(), -1, 1))
    batch = pa.record_batch([pa.array(range(300)), pa.array(x.tolist()), pa.array([0.99] * 300)], names=["id", "x", "best"])
    opened = sum(b.num_rows for b in N._open_lists(centres, wide, False)(iter([batch])))
    assert opened < 300 * 40 * 0.05


def test_without_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    assert [tuple(r) for r in N.nearest_vectors(one, none).collect()] == [(1, None, None)]
    assert [tuple(r) for r in N.nearest_vectors(one, one).collect()] == [(1, None, None)]
    assert N.nearest_vectors(none, one).count() == 0


def test_best_in_group_over_chunks_and_odd_vectors(spark, monkeypatch):
    """All pairs of a group, in several batches and chunks, against the cosine of columns."""
    import math

    from pyspark.sql import functions as F

    from palimpsest.functions import distance
    from palimpsest.operators import neighbours

    monkeypatch.setattr(neighbours, "CHUNK", 7)
    monkeypatch.setattr(neighbours, "BATCH", 3)
    data = [(i, [math.sin(i * j + 1.0) for j in range(1, 5)], i % 3) for i in range(60)]
    data += [(60, [0.0] * 4, 0), (61, [1.0, None, 0.0, 0.0], 0), (62, None, 0), (63, [1.0, 2.0], 0), (64, [2.0, 1.0], 0), (65, [1.0] * 4, None), (66, [float("nan")] + [1.0] * 3, 7), (67, [1.0] * 4, 7), (68, [1.0] * 4, 8), (69, [], 0)]
    df = spark.createDataFrame(data, "id long, embedding array<double>, group int").repartition(3)
    pairs = df.alias("a").join(df.alias("b"), (F.col("a.group") == F.col("b.group")) & (F.col("a.id") != F.col("b.id")))
    plain = pairs.groupBy("a.id").agg(F.max(distance.cosine("a.embedding", "b.embedding")).alias("best")).where("best is not null")
    show = lambda rows: {r.id: "NaN" if math.isnan(r.best) else round(r.best, 9) for r in rows.collect()}
    got = show(neighbours.best_in_group(df, df))
    assert got == show(plain) and got[66] == got[67] == "NaN" and {63, 64} <= set(got) and not {60, 61, 62, 65, 68, 69} & set(got)
