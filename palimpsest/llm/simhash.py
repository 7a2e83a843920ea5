"""Near-duplicate detection by SimHash with a tiled exact comparison.

A fingerprint's 64 bits are cut into equal blocks; fingerprints with the same population
count in every block lie in one tile.  The counts of two fingerprints differ, summed over
the blocks, by no more than the fingerprints do, so only tiles whose counts differ by at
most the radius are compared, each with numpy's exclusive-or and bit counts.  Tiles are
dealt out in chunks of bounded size; only links leave a task.  Nothing is approximate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, drop, keep
from .textscan import LOWER, SPACE, U64, chunks, text_buffers, word_spans

SEED, BITS, RADIUS = 42, 64, 2
#: Fingerprints in a chunk of a tile; shingles hashed at a time; bytes from which one shingle is hashed by itself.
TILE, SHINGLES, LONG = 1024, 1 << 18, 2048

# the primes of XXH64 (fixed values)
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_M = (1 << 64) - 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * U64(P2), 31) * U64(P1)


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte ranges (start, size) of data, all at once."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 5, "<u4", padded, strides=(1,))
    h = np.full(len(start), (seed + P5) & _M, dtype=U64)
    at = start.copy()
    wide = np.flatnonzero((size >= 32) & (size < LONG))
    if len(wide):
        stripes, p = size[wide] // 32, start[wide]
        acc = [np.full(len(wide), x & _M, dtype=U64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for j in range(int(stripes.max())):
            on = np.flatnonzero(stripes > j)
            for i in range(4):
                acc[i][on] = _round(acc[i][on], eight[p[on] + (32 * j + 8 * i)])
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            x = (x ^ _round(U64(0), a)) * U64(P1) + U64(P4)
        h[wide] = x
        at[wide] += 32 * stripes
    h += size.astype(U64)
    left = np.where(size < LONG, size & 31, 0)
    for j in range(3):
        on = np.flatnonzero(left >= 8 * (j + 1))
        h[on] = _rotl(h[on] ^ _round(U64(0), eight[at[on] + 8 * j]), 27) * U64(P1) + U64(P4)
    at += left & ~7
    on = np.flatnonzero(left & 4)
    h[on] = _rotl(h[on] ^ (four[at[on]].astype(U64) * U64(P1)), 23) * U64(P2) + U64(P3)
    at[on] += 4
    for j in range(3):
        on = np.flatnonzero((left & 3) > j)
        h[on] = _rotl(h[on] ^ (data[at[on] + j].astype(U64) * U64(P5)), 11) * U64(P1)
    h ^= h >> U64(33)
    h *= U64(P2)
    h ^= h >> U64(29)
    h *= U64(P3)
    h ^= h >> U64(32)
    for i in np.flatnonzero(size >= LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), seed)
    return h


def _bit_counts(h: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
    """Add to counts[owner, bit] how many h have the bit; owner ascends.  Eight bits are counted
    at a time, in the bytes of a word, over runs that no byte overflows in."""
    edge = np.flatnonzero(np.diff(owner, prepend=-1))
    bounds = np.union1d(edge, np.arange(0, len(h), 255))
    for b in range(8):
        lanes = np.add.reduceat((h >> U64(b)) & U64(0x0101010101010101), bounds)
        np.add.at(counts, (owner[bounds], slice(b, None, 8)), lanes.view(np.uint8).reshape(-1, 8).astype(np.int64))


def simhash(buf: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of texts given as (bytes, offsets): a bit is set if over half of the hashes of
    a text's k-word shingles, repeats included, have it; zero without words."""
    s, e, first = word_spans(buf, offs)
    solid = LOWER[buf[~SPACE[buf]]]
    size = e - s
    begin = np.concatenate(([0], np.cumsum(size)))  # of each word in ``solid``
    n = np.diff(first)
    many = np.where(n >= k, n - (k - 1), np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), many)
    word = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many - first[:-1], many)
    last = np.where(n[owner] >= k, word + k - 1, first[owner] + n[owner] - 1)
    counts = np.zeros((len(n), BITS), dtype=np.int64)
    for x in range(0, len(owner), SHINGLES):
        y = min(x + SHINGLES, len(owner))
        lo, hi = word[x], last[y - 1] + 1
        place = begin[lo:hi] - begin[lo] + np.arange(hi - lo)  # words with one space after each
        data = np.full(place[-1] + size[hi - 1] + 1, 32, dtype=np.uint8)
        data[np.arange(begin[hi] - begin[lo]) + np.repeat(np.arange(hi - lo), size[lo:hi])] = solid[begin[lo] : begin[hi]]
        a, z = word[x:y] - lo, last[x:y] - lo
        _bit_counts(xxh64(data, place[a], place[z] + size[lo:hi][z] - place[a]), owner[x:y], counts)
    bits = 2 * counts > many[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = simhash(*text_buffers(part.column(1)), k)
                yield pa.record_batch([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs (a, b) of fingerprints at most radius bits apart; of one tile with itself each pair once."""
    strip = max(1, (1 << 20) // max(1, len(b)))
    x, y = a.view(U64), b.view(U64)  # bits of signed numbers would be those of their size
    for at in range(0, len(a), strip):
        i, j = np.nonzero(np.bitwise_count(x[at : at + strip, None] ^ y[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        yield from zip(a[i].tolist(), b[j].tolist())


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what those before them have not joined."""
    up, found = {}, []

    def root(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for pair in pairs:
        p, q = map(root, pair)
        if p != q:
            up[p] = q
            found.append(pair)
    return found


def _compare(radius: int):
    """(a, b, same) rows of two tiles -> a forest of their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (sa, sb), (va, vb) = zip(*((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(0), batch.column(1))))
            for row, same in enumerate(batch.column(2).to_pylist()):
                found = forest(close_pairs(va[sa[row] : sa[row + 1]], vb[sb[row] : sb[row + 1]], radius, same))
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return run


def blocks_for(n: int) -> int:
    """Blocks of a fingerprint for n distinct ones: the fewest for which n fingerprints of random
    bits would meet TILE others in their tile, or the most there are.  Results don't depend on it."""
    k = 1
    while k < 16:
        width = BITS // k
        if n * (comb(2 * width, width) / 4**width) ** k <= TILE:
            break
        k *= 2
    return k


def _tile(fp: Column, blocks: int) -> Column:
    """Population counts of the blocks as digits of one long."""
    width = BITS // blocks
    mask = F.lit(-1 if width == 64 else (1 << width) - 1).cast("long")
    return sum((F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(mask)).cast("long") * (width + 1) ** i for i in range(blocks)), F.lit(0).cast("long"))


def _steps(blocks: int, radius: int) -> list[dict]:
    """Half of the differences of counts up to the radius: one of (x, -x) each, and none at all.
    A step adds to at most ``radius`` digits."""
    base = BITS // blocks + 1
    found = {(): 0}
    for _ in range(radius):
        for step in list(found):
            for i in range(blocks):
                for by in (1, -1):
                    digits = dict(step)
                    digits[i] = digits.get(i, 0) + by
                    found[tuple(sorted((j, d) for j, d in digits.items() if d))] = 0
    half = [x for x in found if not x or x[0][1] > 0]
    return [{"add": sum(d * base**i for i, d in x), "digits": [{"unit": base**i, "by": d} for i, d in x]} for x in half]


def tile_pairs(tiles: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(tile, i, other, j): chunks to compare, of ``tiles(tile, m)`` with m chunks each."""
    base = BITS // blocks + 1
    steps = F.from_json(F.lit(json.dumps(_steps(blocks, radius))), "array<struct<add:long,digits:array<struct<unit:long,by:int>>>>")
    near = tiles.select("tile", "m", F.explode(steps).alias("step"))
    digit = lambda d: F.pmod(F.call_function("div", F.col("tile"), d["unit"]), F.lit(base))
    near = near.where(F.forall("step.digits", lambda d: (digit(d) + d["by"]).between(0, base - 1)))
    near = near.select("tile", "m", (F.col("tile") + F.col("step.add")).alias("other"))
    both = near.join(tiles.select(F.col("tile").alias("other"), F.col("m").alias("om")).hint("merge"), "other")
    both = both.select("tile", "other", "om", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    start = F.when(F.col("tile") == F.col("other"), F.col("i")).otherwise(0)
    return both.select("tile", "i", "other", F.explode(F.sequence(start, F.col("om") - 1)).alias("j"))


def close_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(u, v): fingerprints of ``prints(fp)``, all distinct, at most radius bits apart; of links that
    close a circle within a pair of chunks some are left out, so components are those of all links."""
    blocks = blocks or blocks_for(prints.count())
    placed = prints.select("fp", _tile(F.col("fp"), blocks).alias("tile"))
    tiles = keep(placed.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("m")), "simhash-tiles")
    chunk = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    # dealt by chunk, or a large tile would be grouped where the join has put it
    dealt = placed.join(tiles.hint("merge"), "tile").select("tile", chunk.alias("i"), "fp").repartition("tile", "i")
    packed = keep(dealt.groupBy("tile", "i").agg(F.collect_list("fp").alias("a")), "simhash-chunks")
    pairs = tile_pairs(tiles, blocks, radius).join(packed.hint("merge"), ["tile", "i"])
    others = packed.select(F.col("tile").alias("other"), F.col("i").alias("j"), F.col("a").alias("b"))
    pairs = pairs.join(others.hint("merge"), ["other", "j"])
    same = (F.col("tile") == F.col("other")) & (F.col("i") == F.col("j"))
    links = keep(pairs.select("a", "b", same.alias("same")).mapInArrow(_compare(radius), "u long, v long"), "simhash-links")
    drop(tiles, packed)
    return links


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs(doc_id, text, ...)``.

    A fingerprint is 16 lowercase hex digits: bit by bit the majority of the XXH64 hashes (seed
    42) of the text's k-word shingles, repeats included, words lower-cased in A-Z and joined by
    one space; a text of fewer words is one shingle.  Documents are linked if their fingerprints
    differ in at most radius bits; component_id is the smallest doc_id reachable.

    Null, empty and blank texts have the fingerprint zero, which is linked like any other.  Rows
    that share a doc_id count as one document: all their fingerprints belong together.  Rows with
    a null doc_id are linked with nothing and have a null component_id.  Extra columns are
    ignored; repeated rows get equal results; an empty table gives an empty result.  A single
    text takes some twelve times its size of a worker's memory.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = keep(docs.mapInArrow(_fingerprints(k), "doc_id long, fp long"), "simhash")
    own = prints.where("doc_id is not null")
    classes = keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    links = close_links(classes.select("fp"), radius)
    # the fingerprints of one doc_id belong together
    several = own.groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).where("u <> v").select("doc_id", "u")
    several = own.join(keep(several, "simhash-several").hint("merge"), "doc_id").select("u", F.col("fp").alias("v"))
    label = keep(components(links.union(several)), "simhash-labels")
    member = classes.join(label.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = keep(member.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    member = keep(member.join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-members")
    drop(classes, links, label, least)
    out = prints.join(member.hint("merge"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
