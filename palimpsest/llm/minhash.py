"""Near-duplicate detection by circulant MinHash with exact confirmation.

One permutation scatters the shingle hashes of a document over a circle of 2**32
places; a second, shifted by 0, 1, 2, ... places round that circle, yields all
coordinates of the signature (Li & Li, C-MinHash, 2022).  Coordinates are banded, and
the documents of a bucket are compared on their full shingle sets.

No group of copies is expanded into pairs.  Equal sets collapse to one class first.
In each bucket every class is compared with one hub only, the class that collides most
(a star): the text that others were copied from.  Two classes that share any bucket
share that bucket's hub, so what is left to check are the classes apart from their hub,
against the hub's group.  Small groups are compared directly; large ones (classes that
share boilerplate, not content) are first divided by a second, more selective set of
bands.  Comparisons run block by block inside tasks, which emit links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, drop, keep, without
from .textscan import U64, chunks, doc_shingles, mix, text_buffers, word_hashes

U32 = np.uint32
ROWS, BANDS = 4, 32
#: The bands within a large group, at most: a pair at 0.8 shares none with probability 1e-9.
INNER_ROWS, INNER_BANDS = 8, 112
#: Shingles on each side of a block, blocks of a group that is compared undivided, and members that meet one copy of a hub.
BLOCK_SHINGLES, UNDIVIDED, STAR_MEMBERS = 1 << 18, 4, 256


def signature(shingles: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """n circulant MinHash coordinates of distinct 64-bit shingle hashes; another salt gives another pair of permutations."""
    place = (mix(shingles ^ U64(0x5851F42D4C957F2D + salt)) >> U64(32)).astype(U32)
    shift = np.arange(n, dtype=U32)[:, None]
    out = np.full(n, 0xFFFFFFFF, dtype=U32)
    for at in range(0, len(place), 512):
        x = place[None, at : at + 512] - shift
        x ^= x >> U32(16)
        x *= U32(0x85EBCA6B)
        x ^= x >> U32(13)
        x *= U32(0xC2B2AE35)
        x ^= x >> U32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def inner_bands(percent: int) -> int:
    """Bands within a large group: as many as miss a pair at the threshold no likelier than INNER_BANDS miss one at 0.8."""
    shared = lambda s: np.log1p(-min(s**INNER_ROWS, 1 - 1e-16))
    return min(INNER_BANDS, max(1, int(np.ceil(INNER_BANDS * shared(0.8) / shared(percent / 100)))))


def bucket_ids(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket id a band; the band is part of the id."""
    parts = sig.reshape(-1, rows).astype(U64)
    h = np.arange(len(parts), dtype=U64) * U64(0x9E3779B97F4A7C15)
    for i in range(rows):
        h = mix((h ^ parts[:, i]) * U64(0xD6E8FEB86659FD93) + U64(i + 1))
    return h


def _describe(k: int, rows: int, bands: int):
    """(doc_id, row, text) batches -> doc_id, row, set size, 128-bit set key, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, first = word_hashes(*text_buffers(part.column(2)), lower=True)
                n, key1, key2, buckets = [], [], [], []
                for i in range(part.num_rows):
                    s = doc_shingles(h[first[i] : first[i + 1]], k)
                    n.append(len(s))
                    key1.append(int(mix(s).sum(dtype=U64).astype(np.int64)))
                    key2.append(int(mix(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64).astype(np.int64)))
                    buckets.append(bucket_ids(signature(s, rows * bands), rows).view(np.int64) if len(s) else None)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_shingles", "key1", "key2", "buckets"],
                )

    return run


def _inner_buckets(k: int, bands: int):
    """(hub, d, r, text) -> the same without the text, and the second set of buckets."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                h, first = word_hashes(*text_buffers(part.column(3)), lower=True)
                sets = (doc_shingles(h[first[i] : first[i + 1]], k) for i in range(part.num_rows))
                found = [bucket_ids(signature(s, INNER_ROWS * bands, salt=1), INNER_ROWS).view(np.int64) for s in sets]
                yield pa.record_batch([part.column(i) for i in range(3)] + [pa.array(found, pa.list_(pa.int64()))], names=["hub", "d", "r", "buckets"])

    return run


def _rows_with_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(values of the other columns..., shingle set) of rows whose last column is the text."""
    for batch in batches:
        text = batch.schema.names[-1]
        for part in chunks(batch, text):
            h, first = word_hashes(*text_buffers(part.column(part.num_columns - 1)), lower=True)
            others = [part.column(i).to_pylist() for i in range(part.num_columns - 1)]
            for i, row in enumerate(zip(*others)):
                yield (*row, doc_shingles(h[first[i] : first[i + 1]], k))


def similar(common, a: int, b, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * common >= percent * (a + b - common)


_LINKS = "ud long, ur long, vd long, vr long"


def _links(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
    flat = [(*u, *v) for u, v in pairs]
    return pa.record_batch([pa.array([x[i] for x in flat], pa.int64()) for i in range(4)], names=["ud", "ur", "vd", "vr"])


def _stars(k: int, percent: int):
    """Rows sorted by (hub, salt, role): the hub's own row comes first, members stream past it."""

    def run(batches):
        at, hub, found = None, None, []
        for hd, hr, salt, role, d, r, s in _rows_with_sets(batches, k):
            if role == 0:
                at, hub = (hd, hr, salt), s
            elif at == (hd, hr, salt) and similar(len(np.intersect1d(hub, s, assume_unique=True)), len(hub), len(s), percent):
                found.append(((hd, hr), (d, r)))
            if len(found) >= 10_000:
                yield _links(found)
                found = []
        yield _links(found)

    return run


def block_links(left: list, right: list, percent: int) -> list[tuple[int, int]]:
    """Links (a forest over components) between rows (doc, component, set) of left and right.
    Exact intersections are counted over posting lists of the right side."""
    if not left or not right:
        return []
    sizes = np.array([len(r[2]) for r in right])
    vocabulary, owner = np.concatenate([r[2] for r in right]), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(vocabulary, kind="stable")
    vocabulary, owner = vocabulary[order], owner[order]
    roots: dict = {}

    def root(c):
        while roots.get(c, c) != c:
            c = roots[c]
        return c

    comps, found = [r[1] for r in right], []
    for doc, comp, s in left:
        lo, hi = np.searchsorted(vocabulary, s, side="left"), np.searchsorted(vocabulary, s, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero((common > 0) & similar(common, len(s), sizes, percent)):
            a, b = root(comp), root(comps[j])
            if a != b:
                roots[a] = b
                found.append((doc, right[j][0]))
    return found


def _blocks(k: int, percent: int):
    """Rows sorted by (key, i, j, side): side 0 the members left over, side 1 the group."""

    def run(batches):
        at, sides = None, ([], [])
        for key, i, j, side, d, r, cd, cr, s in _rows_with_sets(batches, k):
            if at != (key, i, j):
                yield _links(block_links(*sides, percent))
                at, sides = (key, i, j), ([], [])
            sides[side].append(((d, r), (cd, cr), s))
        yield _links(block_links(*sides, percent))

    return run


def _node(links: DataFrame) -> DataFrame:
    node = lambda x: F.struct(F.col(x + "d").alias("d"), F.col(x + "r").alias("r")).alias(x)
    return links.select(node("u"), node("v"))


def _compare(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the members of ``groups(key, node, comp, apart, n_shingles)`` that stand
    apart and all of their group, block by block."""
    size = groups.groupBy("key").agg(F.sum("n_shingles").alias("total"), F.sum(F.when(F.col("apart"), F.col("n_shingles"))).alias("left"), F.count("*").alias("n"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    size = size.where("n > 1 and left > 0").select("key", blocks("left").alias("ni"), blocks("total").alias("nj"))
    group = groups.join(size.hint("merge"), "key")
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side0 = group.where("apart").select("key", salt("ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("side"), "node", "comp")
    side1 = group.select("key", every("ni").alias("i"), salt("nj").alias("j"), F.lit(1).alias("side"), "node", "comp")
    rows = side0.union(side1).join(texts, "node").select("key", "i", "j", "side", "node.d", "node.r", F.col("comp.d").alias("cd"), F.col("comp.r").alias("cr"), "text")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return _node(rows.mapInArrow(_blocks(k, percent), _LINKS))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text, ...)``.

    Documents are linked if the Jaccard similarity of their distinct k-word shingles
    (A-Z lower-cased) is at least percent / 100, confirmed on full sets.  component_id is
    the smallest doc_id reachable over links, itself included; kept marks that document.
    A pair at similarity s is missed with probability (1 - s**rows)**bands: 5e-8 at 0.8,
    6e-11 at 0.85 for the defaults, less where others of its group connect it.

    Null or blank texts have no shingle: linked with nothing, kept.  Rows that share a
    doc_id count as one document: each of their texts is compared, and their components
    join.  Rows with a null doc_id are linked by nothing and kept, with a null component_id.
    Extra columns are ignored.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text"))
    described = keep(docs.mapInArrow(_describe(k, rows, bands), "doc_id long, row long, n_shingles long, key1 long, key2 long, buckets array<long>"), "minhash")
    same = ["key1", "key2", "n_shingles"]
    some = described.where("n_shingles > 0 and doc_id is not null")
    # a class is known by one of its rows: the least doc_id, and the hash of its text
    node = F.struct(F.col("doc_id").alias("d"), F.col("row").alias("r"))
    classes = keep(some.groupBy(*same).agg(F.min(node).alias("node"), F.first("buckets").alias("buckets")), "minhash-classes")
    slots = keep(classes.select("node", "n_shingles", F.explode("buckets").alias("bucket")), "minhash-slots")
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    live = keep(slots.join(sizes.hint("merge"), "bucket"), "minhash-live")
    drop(slots)
    popular = live.groupBy("node").agg(F.sum("size").alias("popular"))
    ranked = live.drop("size").join(popular.hint("merge"), "node")
    hubs = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("popular")).alias("o"), "node"))["node"].alias("hub"))
    edges = keep(ranked.join(hubs.hint("merge"), "bucket").where("node <> hub").select("hub", "node", "n_shingles").distinct(), "minhash-edges")
    drop(live)
    # one text of each class that shares a bucket with another
    wanted = edges.select("node").union(edges.select("hub")).distinct().select("node", "node.d", "node.r")
    own = docs.join(wanted.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")))
    texts = keep(own.groupBy("node").agg(F.first("text").alias("text")), "minhash-texts")

    # 1. stars: each member against its hub, which is copied once per STAR_MEMBERS members
    fans = keep(edges.groupBy("hub").agg(F.ceil(F.count("*") / STAR_MEMBERS).alias("fans"), F.sum("n_shingles").alias("total")), "minhash-fans")
    members = edges.join(fans.hint("merge"), "hub").select("hub", F.pmod(F.xxhash64("node"), "fans").alias("salt"), "node")
    each = lambda role: ["hub.d", "hub.r", "salt", F.lit(role).alias("role"), F.col("node.d").alias("md"), F.col("node.r").alias("mr"), "text"]
    centres = members.select("hub", "salt").distinct().withColumn("node", F.col("hub"))
    star = members.join(texts, "node").select(*each(1)).union(centres.join(texts, "node").select(*each(0)))
    star = star.repartition("d", "r", "salt").sortWithinPartitions("d", "r", "salt", "role")
    links = keep(_node(star.mapInArrow(_stars(k, percent), _LINKS)), "minhash-links")
    label = components(links)

    # 2. what stands apart from its hub against the hub's group
    labelled = edges.join(label.select("node", F.col("root").alias("comp")).hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = labelled.join(label.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")).hint("merge"), "hub", "left")
    labelled = labelled.withColumn("apart", F.col("comp") != F.coalesce("hub_root", "hub")).drop("hub_root")
    open_hubs = labelled.groupBy("hub").agg(F.max("apart").alias("any")).where("any").join(fans.hint("merge"), "hub")
    labelled = keep(labelled.join(open_hubs.select("hub", (F.col("total") > UNDIVIDED * BLOCK_SHINGLES).alias("large")).hint("merge"), "hub"), "minhash-open")
    small = labelled.where("not large").withColumn("key", F.xxhash64("hub"))
    large = labelled.where("large")
    inner = large.join(texts, "node").select(F.xxhash64("hub").alias("hub"), "node.d", "node.r", "text")
    inner = keep(inner.mapInArrow(_inner_buckets(k, inner_bands(percent)), "hub long, d long, r long, buckets array<long>"), "minhash-inner")
    inner = inner.select(F.struct("d", "r").alias("node"), F.col("hub").alias("h"), F.explode("buckets").alias("bucket"))
    divided = large.withColumn("h", F.xxhash64("hub")).join(inner, ["h", "node"]).withColumn("key", F.xxhash64("h", "bucket"))
    fields = ["key", "node", "comp", "apart", "n_shingles"]
    more = keep(_compare(small.select(*fields).union(divided.select(*fields)), texts, k, percent), "minhash-more")

    # 3. the classes of one doc_id belong together; then back to all rows
    held = some.join(classes.select(*same, "node").hint("merge"), same).select("doc_id", "node")
    shared = held.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("doc_id", "u")
    joined = held.join(shared.hint("merge"), "doc_id").select("u", F.col("node").alias("v"))
    final = components(links.union(more).union(joined))
    drop(label, labelled, fans, texts, links, more, edges)
    roots = classes.select(*same, "node").join(final.hint("merge"), "node", "left").select(*same, F.coalesce("root", "node")["d"].alias("root"))
    out = described.drop("buckets").join(roots.hint("merge"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs whose document represents its component, with all columns.  Null ids stay,
    as do texts without a word unless another row of their doc_id goes."""
    return without(docs, near_duplicates(docs, **params).where("not kept").select("doc_id"))
