"""Nearest vectors by cosine through an inverted file, exact (M06 over a whole table).

Centroids are learned on a bounded sample; every vector is listed under its nearest one, lists
are cut into chunks of bounded size.  A target is first compared with the lists it is nearest
to.  What it has found there is then held against each other list: no vector of a list can be
nearer to the target than the angle to the list's centroid less the widest angle in the list.
Only lists that could still hold something nearer are opened, so the answer is that of all
pairs.  Comparisons are matrix products of a chunk of vectors with a batch of targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep

#: Vectors that centroids are learned from, rounds of learning, lists probed first, vectors of a chunk, targets of a batch.
SAMPLE, ROUNDS, PROBES, CHUNK, BATCH = 20_000, 5, 3, 2048, 512
#: More than rounding can move a cosine by.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, x): vectors of length 1, as doubles; those without a direction (null, empty, zero, or with a null or
    non-finite component) are left out."""
    d = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("id", d.alias("x")).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.withColumn("_n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))).where("_n > 0 and _n < double('infinity')")
    return rows.select("id", F.transform("x", lambda c: c / F.col("_n")).alias("x"))


def learn_centroids(units: DataFrame, lists: int, seed: int = 5) -> np.ndarray:
    """Directions of at most ``lists`` clusters of about SAMPLE vectors, those whose hash is least."""
    total = units.count()
    part = min(1.0, 2 * SAMPLE / max(1, total))
    cut = 2**63 - 1 if part == 1 else int(-(2**63) + part * (2**64 - 1))
    h = F.xxhash64("id", "x", F.lit(seed))
    x = np.array([r.x for r in units.where(h <= cut).orderBy(h, "id").limit(SAMPLE).select("x").collect()])
    if not len(x):
        return np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        some = np.linalg.norm(sums, axis=1) > 0
        c[some] = _unit(sums[some])
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _listed(c: np.ndarray):
    """(id, x) -> (id, x, list, near): the nearest centroid and the cosine to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = _matrix(b.column(1)) @ c.T
                own = cos.argmax(axis=1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(cos[np.arange(len(own)), own])], names=["id", "x", "list", "near"])

    return run


def _open_lists(c: np.ndarray, wide: np.ndarray, first: bool):
    """(id, x, best) -> (id, x, list): the PROBES nearest lists, or the others that could hold something
    nearer than best.  ``wide``: the widest angle of each list, below 0 for one that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            cos = np.clip(x @ c.T, -1, 1)
            order = np.argsort(-np.where(wide >= 0, cos, -2), axis=1, kind="stable")
            probed = np.zeros(cos.shape, dtype=bool)
            np.put_along_axis(probed, order[:, :PROBES], True, axis=1)
            if first:
                chosen = probed & (wide >= 0)
            else:
                best = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                most = np.cos(np.maximum(0, np.arccos(cos) - wide))
                chosen = ~probed & (wide >= 0) & ~(most < np.nan_to_num(best, nan=-2)[:, None] - SLACK)
            row, at = np.nonzero(chosen)
            take = pa.array(row)
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32())], names=["id", "x", "list"])

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, xs of targets, ids, xs of a chunk) -> (id, best, nearest) of each target."""
    for b in batches:
        for r in range(b.num_rows):
            t_id, t_x, v_id, v_x = (b.column(i)[r].values for i in range(4))
            t_id, v_id = t_id.to_numpy(), v_id.to_numpy()
            t, v = (x.flatten().to_numpy().reshape(n, -1) for x, n in ((t_x, len(t_id)), (v_x, len(v_id))))
            cos = np.where(t_id[:, None] == v_id[None, :], -np.inf, t @ v.T)  # a vector is no neighbour of its own
            top = cos.max(axis=1)
            least = np.where(cos == top[:, None], v_id[None, :], np.iinfo(np.int64).max).min(axis=1)
            some = top > -np.inf
            yield pa.record_batch([pa.array(t_id[some]), pa.array(top[some]), pa.array(least[some])], names=["id", "best", "nearest"])


def _compared(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, best, nearest) of ``asked(id, x, list)`` over the chunks of those lists."""
    sizes = asked.groupBy("list").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("_m"))
    batch = F.pmod(F.xxhash64("id"), F.col("_m")).alias("_b")
    packed = asked.join(keep(sizes, "asked").hint("merge"), "list").select("list", batch, "id", "x").repartition("list", "_b")
    packed = packed.groupBy("list", "_b").agg(F.collect_list(F.struct("id", "x")).alias("_t"))
    packed = packed.select("list", F.transform("_t", lambda t: t["id"]).alias("t_id"), F.transform("_t", lambda t: t["x"]).alias("t_x"))
    both = packed.join(chunks.hint("merge"), "list").select("t_id", "t_x", "v_id", "v_x")
    found = both.mapInArrow(_best, "id long, best double, nearest long")
    return found.groupBy("id").agg(F.max(F.struct("best", (-F.col("nearest")).alias("_n"))).alias("_m")).select("id", "_m.best", (-F.col("_m._n")).alias("nearest"))


def nearest_vectors(targets: DataFrame, vectors: DataFrame, lists: int | None = None) -> DataFrame:
    """(id, best, nearest): for each row of ``targets(id, embedding)`` the greatest cosine to a vector of
    ``vectors(id, embedding)`` with another id, and the least such id at that cosine (up to rounding).

    Vectors without a direction are nobody's neighbour; such targets, and targets without any
    other vector, have nulls.  Ids are not null and all vectors have one length.  ``lists``: about
    the square root of the number of vectors unless given, 4096 at most; the answer doesn't
    depend on it.
    """
    units = keep(unit_vectors(vectors), "units")
    c = learn_centroids(units, lists or int(min(4096, max(1, units.count() ** 0.5))))
    if not len(c):
        return targets.select("id", F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("nearest"))
    listed = keep(units.mapInArrow(_listed(c), "id long, x array<double>, list int, near double"), "listed")
    wide = np.full(len(c), -1.0)
    about = listed.groupBy("list").agg(F.min("near").alias("near"), F.ceil(F.count("*") / CHUNK).cast("int").alias("_m"))
    for r in about.select("list", "near").collect():
        wide[r["list"]] = np.arccos(np.clip(r.near, -1, 1)) + 1e-7
    part = F.pmod(F.xxhash64("id"), F.col("_m")).alias("_c")
    chunks = listed.join(keep(about, "lists").hint("merge"), "list").select("list", part, "id", "x").repartition("list", "_c")
    chunks = chunks.groupBy("list", "_c").agg(F.collect_list(F.struct("id", "x")).alias("_v"))
    chunks = keep(chunks.select("list", F.transform("_v", lambda v: v["id"]).alias("v_id"), F.transform("_v", lambda v: v["x"]).alias("v_x")), "chunks")
    asked = keep(unit_vectors(targets), "targets")
    kind = "id long, x array<double>, list int"
    near = keep(_compared(keep(asked.withColumn("best", F.lit(None).cast("double")).mapInArrow(_open_lists(c, wide, True), kind), "probes"), chunks), "near")
    open_ = keep(asked.join(near.select("id", "best"), "id", "left").select("id", "x", "best").mapInArrow(_open_lists(c, wide, False), kind), "open")
    found = near.union(_compared(open_, chunks))
    found = found.groupBy("id").agg(F.max(F.struct("best", (-F.col("nearest")).alias("_n"))).alias("_m"))
    return targets.select("id").join(found.select("id", "_m.best", (-F.col("_m._n")).alias("nearest")), "id", "left")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, vectors of targets, ids, vectors of a chunk) -> (id, best) of each target: NaN where any cosine is."""
    for b in batches:
        for r in range(b.num_rows):
            t_id, t_x, v_id, v_x = (b.column(i)[r].values for i in range(4))
            t_id, v_id = t_id.to_numpy(), v_id.to_numpy()
            t, v = (x.flatten().to_numpy().reshape(n, -1) for x, n in ((t_x, len(t_id)), (v_x, len(v_id))))
            with np.errstate(all="ignore"):
                norms = np.sqrt((t * t).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
                cos = np.where((norms == 0) | (t_id[:, None] == v_id[None, :]), -np.inf, t @ v.T / norms)
            top = cos.max(axis=1)  # of NaN and numbers NaN, as in SQL
            some = ~(top == -np.inf)
            yield pa.record_batch([pa.array(t_id[some]), pa.array(top[some])], names=["id", "best"])


def best_in_group(targets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, best): for each row of ``targets(id, embedding, group)`` the greatest cosine to a vector of
    ``vectors(id, embedding, group)`` of its group and length with another id; targets without one are left out.

    All pairs of a group, as matrix products of a batch of targets with a chunk of vectors, so a task holds
    one of each and a large group is dealt over many.  Vectors without a direction, with a null component
    or in no group are nobody's neighbours.
    """
    d = F.transform("embedding", lambda c: c.cast("double"))
    key = ["group", "size"]
    rows = lambda df: df.select("id", d.alias("x"), "group", F.size("embedding").alias("size")).where("size > 0 and group is not null and id is not null and forall(x, c -> c is not null)")
    listed, asked = keep(rows(vectors), "grouped"), keep(rows(targets), "grouped-targets")
    parts = lambda df, most: keep(df.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("m")), "groups")
    chunks_of, batches_of = parts(listed, CHUNK), parts(asked, BATCH)

    def packed(df: DataFrame, sizes: DataFrame, part: str, name: str) -> DataFrame:
        dealt = df.join(sizes.hint("merge"), key).withColumn(part, F.pmod(F.xxhash64("id"), F.col("m"))).repartition(*key, part)
        own = dealt.groupBy(*key, part).agg(F.collect_list(F.struct("id", "x")).alias("_r"))
        return own.select(*key, part, F.transform("_r", lambda r: r["id"]).alias(name + "_id"), F.transform("_r", lambda r: r["x"]).alias(name + "_x"))

    chunks = packed(listed, chunks_of, "_c", "v")
    batches = packed(asked, batches_of, "_b", "t").join(chunks_of.hint("merge"), key).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint") - 1)))
    both = batches.join(chunks.hint("merge"), [*key, "_c"]).select("t_id", "t_x", "v_id", "v_x")
    return both.mapInArrow(_cosines, "id long, best double").groupBy("id").agg(F.max("best").alias("best"))
