"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming
blocks, and exact weighted-shingle similarity.

A benchmark item is its words, lower-cased A-Z, and its fingerprint the 64-bit SimHash of
its shingles.  Over each document slide windows of the items' own sizes.  A window that
can reach the similarity at all holds that share of its shingles in the benchmark; the
others are passed over without loss, so fingerprints are made for few.  The index cuts a
fingerprint into blocks: two within the radius agree to within radius // blocks bits in at
least one block, so probing a block's table with its neighbours finds every item within it.
Candidates are then compared by the exact weighted Jaccard similarity of their shingles
(weights are multiplicities).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, without
from .textscan import U64, chunks, ngrams, text_buffers, word_hashes

#: SimHash radius: similarity 0.8 means some 10 of 64 bits on average; 20 leaves 3.5 deviations.
RADIUS, BLOCKS = 20, 4
#: Words of the items in one pass over the documents: some 20,000 items.
WORDS_A_PASS = 1 << 20
_OUT = "doc_id long, item_id long, start int, n_words int, distance int, similarity double"


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, repeats counted."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)).tobytes(), "little")


def shingles_of(h: np.ndarray, k: int) -> np.ndarray:
    """All k-word shingles in order; fewer words than k make one."""
    return ngrams(h, min(k, len(h))) if len(h) else np.zeros(0, dtype=U64)


class Index:
    """Fingerprints of items by block value.  Two fingerprints within the radius agree to within
    radius // blocks bits in one block at least, so looking in a block's table for all values
    that near finds all of them.  A table with fewer values than there are neighbours is gone
    through; a larger one is probed with each neighbour, so a look-up never costs more than
    those, however many items there are."""

    def __init__(self, prints: list[int], radius: int, blocks: int):
        self.prints, self.radius, self.near = np.array(prints, dtype=U64), radius, radius // blocks
        self.width = 64 // blocks
        bits = (sum(1 << i for i in c) for n in range(self.near + 1) for c in combinations(range(self.width), n))
        self.masks = np.fromiter(bits, dtype=np.int64)
        self.tables = []
        for b in range(blocks):
            own = self._block(self.prints, b)
            start = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=1 << self.width))))
            self.tables.append((start, np.argsort(own, kind="stable"), np.unique(own)))

    def _block(self, p: np.ndarray, b: int) -> np.ndarray:
        return ((p >> U64(b * self.width)) & U64((1 << self.width) - 1)).astype(np.int64)

    def _neighbours(self, mine: np.ndarray, start: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of the table's values near each query's."""
        if len(values) <= len(self.masks):
            q, at = np.nonzero(np.bitwise_count(mine[:, None] ^ values) <= self.near)
            return q, values[at]
        near = (mine[:, None] ^ self.masks).ravel()
        hit = np.flatnonzero(start[near + 1] > start[near])
        return hit // len(self.masks), near[hit]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) places of all pairs that differ in at most radius bits, sorted."""
        found, n = [np.zeros(0, dtype=np.int64)], len(self.prints)
        some = max(64, (1 << 18) // max(1, min(n, len(self.masks))))
        for at in range(0, len(prints) if n else 0, some):
            for b, (start, items, values) in enumerate(self.tables):
                q, value = self._neighbours(self._block(prints[at : at + some], b), start, values)
                lo, size = start[value], start[value + 1] - start[value]
                place = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                q, i = np.repeat(at + q, size), items[place]
                near = np.bitwise_count(prints[q] ^ self.prints[i]) <= self.radius
                found.append(q[near] * n + i[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, n), pairs % max(1, n)


def window_prints(grams: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of windows of ``counts`` shingles from ``starts``, by prefix sums of their bits."""
    lo, hi = int(starts.min()), int((starts + counts).max())
    bits = np.unpackbits(grams[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((hi - lo + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    most = 2 * (sums[starts - lo + counts] - sums[starts - lo]) > counts[:, None]
    return np.packbits(most, axis=1).view(U64).ravel()


def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their multiplicities."""
    s = np.sort(shingles)
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[edge], np.diff(np.append(edge, len(s)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of lesser over sum of greater multiplicities of two counted() sets."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    low = int(np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum())
    return low / max(1, int(a[1].sum() + b[1].sum()) - low)


def _scan(items: list[tuple[int, str]], k: int, similarity: float, radius: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sizes, ids = [], [], []
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            h, _ = word_hashes(raw, np.array([0, len(raw)]), lower=True)
            if len(h):
                sets.append(shingles_of(h, k)), sizes.append(len(h)), ids.append(item_id)
        known_sets = [counted(x) for x in sets]
        index = Index([simhash(s) for s in sets], radius, blocks)
        lengths = sorted(set(sizes))
        short = {n: np.array([s[0] for s, m in zip(sets, sizes) if m == n], dtype=U64) for n in lengths if n < k}
        known = np.unique(np.concatenate([s for s, n in zip(sets, sizes) if n >= k] or [np.zeros(0, dtype=U64)]))
        sieve = np.zeros(1 << 20, dtype=bool)  # most shingles are in no item: one look-up tells
        sieve[(known >> U64(44)).astype(np.int64)] = True
        for batch in batches:
            for part in chunks(batch):
                h, first = word_hashes(*text_buffers(part.column(1)), lower=True)
                out = []
                grams = ngrams(h, k)
                hit = np.zeros(len(h) + 1, dtype=np.int64)
                maybe = np.flatnonzero(sieve[(grams >> U64(44)).astype(np.int64)])
                sure = maybe[np.isin(grams[maybe], known)] if len(maybe) else maybe
                hit[sure + 1] = 1
                # an item shorter than a shingle is one: its windows are those with that hash
                brief = {n: np.flatnonzero(np.isin(ngrams(h, n), own)) for n, own in short.items()}
                docs = np.unique(np.searchsorted(first, np.concatenate([sure, *brief.values()]), side="right") - 1)
                total = np.cumsum(hit)
                for i in docs:
                    lo, hi = int(first[i]), int(first[i + 1])
                    best: dict[int, tuple] = {}
                    found = []
                    for n in lengths:
                        if n > hi - lo:
                            break
                        starts = np.arange(lo, hi - n + 1) if n >= k else brief[n][(brief[n] >= lo) & (brief[n] <= hi - n)]
                        if n >= k:
                            held = total[starts + n - k + 1] - total[starts]
                            starts = starts[held >= similarity * (n - k + 1)]
                        if len(starts):
                            found.append((n, starts))
                    for n, starts in found:
                        g = min(n, k)
                        own = grams if g == k else ngrams(h, g)
                        for at in range(0, len(starts), 4096):
                            some = starts[at : at + 4096]
                            prints = window_prints(own, some, np.full(len(some), n - g + 1))
                            for q, j in zip(*(x.tolist() for x in index.within(prints))):
                                # set sizes alone bound the similarity
                                if min(sizes[j], k) != g or min(n - g, sizes[j] - g) + 1 < similarity * (max(n, sizes[j]) - g + 1):
                                    continue
                                s = int(some[q])
                                sim = weighted_jaccard(counted(own[s : s + n - g + 1]), known_sets[j])
                                if sim >= similarity and (j not in best or sim > best[j][3]):
                                    best[j] = (s - lo, n, int(np.bitwise_count(index.prints[j] ^ prints[q])), sim)
                    out += [(i, ids[j], *v) for j, v in best.items()]
                at = pa.array([r[0] for r in out], pa.int64())
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.record_batch(
                    [part.column(0).take(at)] + [pa.array([r[c + 1] for r in out], t) for c, t in enumerate(kinds)],
                    names=["doc_id", "item_id", "start", "n_words", "distance", "similarity"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): for each document and item
    with a window of at least ``similarity``, the best such window (the first of equals in
    order of size and place); distance is that of the fingerprints.

    Windows take the sizes of the items.  A shingle is k words, the whole item where it is
    shorter.  The benchmark is the stated query set: it is read in passes of some
    WORDS_A_PASS words of items, each over all documents, so what the driver holds and the
    tasks are sent is bounded whatever its size; with several passes each writes its finds
    to the shared folder.  Null or blank items match nothing; nor do null or blank texts.  Repeated
    items or rows are each reported.  Null ids stay null.  Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).orderBy("item_id", "text")
    scan = lambda some: docs.mapInArrow(_scan(some, k, similarity, radius, blocks), _OUT)
    done, items, words = [], [], 0
    for row in rows.toLocalIterator():
        if words > WORDS_A_PASS:
            done.append(keep(scan(items), "contaminated"))
            items, words = [], 0
        items.append((row["item_id"], row["text"]))
        words += row["text"].count(" ") + 1
    out = scan(items)
    for found in done:
        out = out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs without a contaminated window, all columns kept.  Null ids stay."""
    return without(docs, contaminated(docs, benchmark, **params))
