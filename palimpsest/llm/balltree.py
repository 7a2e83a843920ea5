"""Centroid clustering of integer vectors, filtered through ball trees.

Each task packs its vectors into metric trees once; a node knows its centre, radius, count
and integer sum.  In a round the candidates for nearest centroid are carried down from the
root: by the triangle inequality a ball whose centre is nearer to one centroid than to all
others by more than its diameter belongs to that centroid whole, with its count and sum; in
other balls the centroids that can be nearest to no member are dropped, and what reaches a
leaf is decided by exact integer distances.  Tasks return sums of clusters only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep

#: Components of a vector, steps to a unit, clusters and rounds of the query.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Vectors of a tree and of a leaf.
TREE, LEAF = 4096, 32
#: Greatest size of a component: 64 squared differences fit a long.
LIMIT = 1 << 27
#: More than rounding can move a distance by: a share of it, and an amount.
SLACK, EDGE = 1e-9, 1e-5

_FOREST = "ids array<long>, points binary, starts array<int>, ends array<int>, skips array<int>, radii array<double>, centres binary, sums binary"


def quantised(x: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """array<int>: floor(scale * component); null for vectors of another length, or with a null or
    non-finite component.  Components beyond LIMIT count as LIMIT, so that distances stay longs."""
    value = lambda c: c.cast("double")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")))
    step = lambda c: F.when(F.abs(value(c) * scale) <= LIMIT, F.floor(value(c) * scale)).when(value(c) > 0, LIMIT).otherwise(-LIMIT).cast("int")
    return F.when((F.size(x) == dimensions) & sound, F.transform(x, step))


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict]:
    """(order of points, nodes in preorder).  Node: members start..end of the order, the node after
    its subtree (skip; the next node for a leaf), centre, radius, sum."""
    order, nodes = np.arange(len(points)), {k: [] for k in ("starts", "ends", "skips", "radii", "centres", "sums")}

    def plant(lo: int, hi: int) -> None:
        at, own = len(nodes["starts"]), points[order[lo:hi]].astype(np.float64)
        total = points[order[lo:hi]].astype(np.int64).sum(axis=0)
        centre = total / (hi - lo)
        away = np.square(own - centre).sum(axis=1)
        for k, v in (("starts", lo), ("ends", hi), ("skips", 0), ("radii", np.sqrt(away.max())), ("centres", centre), ("sums", total)):
            nodes[k].append(v)
        if hi - lo > leaf and away.max() > 0:
            one = own[away.argmax()]
            far = np.square(own - one).sum(axis=1)
            along = own @ (own[far.argmax()] - one)
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(along, half)]
            plant(lo, lo + half)
            plant(lo + half, hi)
        nodes["skips"][at] = len(nodes["starts"])

    plant(0, len(points))
    return order, nodes


def _forest(dimensions: int):
    """(vec_id, x) -> trees of at most TREE vectors."""

    def tree(ids: list, points: np.ndarray) -> pa.RecordBatch:
        order, n = grow(points)
        row = {"ids": [ids[i] for i in order], "points": points[order].astype("<i4").tobytes(), "starts": n["starts"], "ends": n["ends"], "skips": n["skips"], "radii": n["radii"]}
        row |= {"centres": np.array(n["centres"], dtype="<f8").tobytes(), "sums": np.array(n["sums"], dtype="<i8").tobytes()}
        kinds = [pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([v], kind) for v, kind in zip(row.values(), kinds)], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = [], np.zeros((0, dimensions), dtype=np.int32)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            points = np.concatenate((points, batch.column(1).flatten().to_numpy().reshape(-1, dimensions)))
            while len(ids) >= TREE:
                yield tree(ids[:TREE], points[:TREE])
                ids, points = ids[TREE:], points[TREE:]
        if ids:
            yield tree(ids, points)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            out = {k: row[k].values.to_numpy() for k in ("starts", "ends", "skips", "radii")}
            out |= {k: np.frombuffer(row[k].as_py(), dtype=d).reshape(-1, dimensions) for k, d in (("points", "<i4"), ("centres", "<f8"), ("sums", "<i8"))}
            yield out | {"ids": row["ids"].values}


def filtered(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray | int, np.ndarray | None]]:
    """(node, cluster, None) of each ball assigned whole, (node, clusters, squared distances) of each
    leaf decided by exact distances; ties go to the smaller number."""
    far = np.sqrt(np.square(tree["centres"][:, None, :] - centroids[None, :, :].astype(np.float64)).sum(axis=2))
    live = np.empty(far.shape, dtype=bool)  # which centroids are left for a node, from its parent
    live[0] = True
    at, n = 0, len(far)
    while at < n:
        open_ = np.flatnonzero(live[at])
        d = far[at, open_]
        reach = (d.min() + 2 * tree["radii"][at]) * (1 + SLACK) + EDGE
        open_ = open_[d <= reach]
        lo, hi, skip = int(tree["starts"][at]), int(tree["ends"][at]), int(tree["skips"][at])
        if len(open_) == 1:
            yield at, int(open_[0]), None
            at = skip
        elif skip == at + 1:
            x = tree["points"][lo:hi].astype(np.int64)
            exact = np.square(x[:, None, :] - centroids[None, open_, :]).sum(axis=2)
            best = exact.argmin(axis=1)
            yield at, open_[best], exact[np.arange(hi - lo), best]
            at = skip
        else:
            for child in (at + 1, int(tree["skips"][at + 1])):
                live[child] = False
                live[child, open_] = True
            at += 1


def _sums(centroids: np.ndarray):
    """Trees -> (cluster, n, total), one row a cluster and task.  A ball assigned whole is not opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for tree in _trees(batches, centroids.shape[1]):
            for node, cluster, exact in filtered(tree, centroids):
                lo, hi = tree["starts"][node], tree["ends"][node]
                if exact is None:
                    n[cluster] += hi - lo
                    total[cluster] += tree["sums"][node]
                else:
                    np.add.at(n, cluster, 1)
                    np.add.at(total, cluster, tree["points"][lo:hi].astype(np.int64))
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    """Trees -> (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches, centroids.shape[1]):
            cluster, distance = np.zeros(len(tree["points"]), dtype=np.int32), np.zeros(len(tree["points"]), dtype=np.int64)
            for node, c, exact in filtered(tree, centroids):
                lo, hi = tree["starts"][node], tree["ends"][node]
                cluster[lo:hi] = c
                distance[lo:hi] = np.square(tree["points"][lo:hi].astype(np.int64) - centroids[c]).sum(axis=1) if exact is None else exact
            yield pa.record_batch([tree["ids"], pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The ``clusters`` vectors with least sha256 of "seed:vec_id", in that order; a null id is empty
    there, and vectors that share an id come in order of their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()]


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector kept of
    ``vectors(vec_id, embedding, ...)``.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; components
    become floor(scale * x), those beyond 2**27 in size 2**27.  Each round assigns every vector
    to the nearest centroid (ties: the smaller number) and moves centroids to floor(sum / count)
    of theirs; one that has no vectors stays.  A last assignment follows.  cluster_inertia and
    inertia sum the squared distances of a cluster and of all; null if beyond a long.

    With fewer vectors than clusters there are fewer centroids; without any the result is empty.
    Null ids stay null, repeated ids and rows each count; extra columns are ignored.  The driver
    holds centroids and the sums of clusters.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), dimensions, scale).alias("x")).where("x is not null")
    forest = keep(x.mapInArrow(_forest(dimensions), _FOREST), "ball-trees")
    centroids = np.array(first_centroids(x, clusters, seed), dtype=np.int64).reshape(-1, dimensions)
    if len(centroids):
        for _ in range(rounds):
            parts = forest.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
            whole = lambda c: F.sum(c.cast("decimal(28,0)"))
            for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[whole(F.col("total")[i]) for i in range(dimensions)]).alias("total")).collect():
                centroids[r.cluster] = [int(t) // r.n for t in r.total]
        out = keep(forest.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "ball-assigned")
    else:
        out = spark.createDataFrame([], "vec_id long, cluster int, distance long")
    drop(forest)
    inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    rows = [(c, long(d), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    # one row a cluster, made from a list of that length
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
