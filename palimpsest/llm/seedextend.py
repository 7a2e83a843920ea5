"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every window of ``min_words`` consecutive words the
k-word gram with the least hash (the leftmost of equals) is kept, so two equal windows
always keep the same gram at the same offset.  Documents are joined on anchors.

An anchor is extended both ways over every word that a window around it can hold.
Occurrences with equal surroundings form a class, and the member with the smallest
doc_id stands for it: in the others every window of that anchor repeats.  Only where
an anchor has several classes (at the ends of a repeat) are the representatives'
windows compared one by one.  Neither step pairs occurrences with each other: both
take the smallest doc_id of a key (pre-aggregated) and join it back, so a passage
shared by a third of all documents is one key with one small row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep
from .textscan import U64, chunks, mix, text_buffers, word_hashes

_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)
_tables: dict = {}


class Ranges:
    """Hashes of ranges of a sequence of 64-bit hashes, by prefix sums."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h) + 1
        if base not in _tables or len(_tables[base][0]) < n:
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(max(n, 1 << 18), b, dtype=U64)
                t[0] = 1
                made.append(np.multiply.accumulate(t))
            _tables[base] = made
        p, self.inverse = _tables[base]
        self.sums = np.zeros(n, dtype=U64)
        np.cumsum(h * p[: n - 1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(U64))


def windows(h: np.ndarray, first: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window of ``size`` words within one document, as positions in h."""
    n = len(h)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = Ranges(h, _BASES[0]).of(np.arange(n - k + 1), np.arange(k, n + 1))
    starts = np.arange(n - size + 1)
    end = np.repeat(first[1:], np.diff(first))[: len(starts)]
    starts = starts[starts + size <= end]
    view = np.lib.stride_tricks.sliding_window_view(grams, size - k + 1)
    anchor = np.empty(len(starts), dtype=np.int64)
    for at in range(0, len(starts), 1 << 16):
        s = starts[at : at + (1 << 16)]
        anchor[at : at + len(s)] = s + view[s].argmin(axis=1)
    return starts, anchor


def _anchors(size: int, k: int):
    """(doc_id, row, text) -> one row an anchor: gram hash, hash of its surroundings, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, first = word_hashes(*text_buffers(part.column(2)), lower=False)
                anchor = np.unique(windows(h, first, size, k)[1])
                doc = np.searchsorted(first, anchor, side="right") - 1
                lo = np.maximum(first[doc], anchor - (size - k))
                hi = np.minimum(first[doc + 1], anchor + size)
                r = Ranges(h, _BASES[0])
                around = mix(Ranges(h, _BASES[1]).of(lo, hi) + ((anchor - lo) * 4096 + (hi - anchor)).astype(U64))
                at = pa.array(doc)
                yield pa.record_batch(
                    [
                        pa.array(r.of(anchor, anchor + k).view(np.int64)),
                        pa.array(around.view(np.int64)),
                        part.column(0).take(at),
                        part.column(1).take(at),
                        pa.array((anchor - first[doc]).astype(np.int32)),
                    ],
                    names=["anchor", "around", "doc_id", "row", "place"],
                )

    return run


def _edge_windows(size: int, k: int):
    """(doc_id, row, text, places) -> one row a window of the given anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, first = word_hashes(*text_buffers(part.column(2)), lower=False)
                starts, anchor = windows(h, first, size, k)
                doc = np.searchsorted(first, starts, side="right") - 1
                wanted = [np.asarray(p, dtype=np.int64) + first[i] for i, p in enumerate(part.column(3).to_pylist())]
                use = np.isin(anchor, np.concatenate(wanted)) if wanted else np.zeros(0, dtype=bool)
                starts, doc = starts[use], doc[use]
                at = pa.array(doc)
                yield pa.record_batch(
                    [
                        pa.array(Ranges(h, b).of(starts, starts + size).view(np.int64)) for b in _BASES
                    ]
                    + [part.column(0).take(at), part.column(1).take(at), pa.array((starts - first[doc]).astype(np.int32))],
                    names=["w1", "w2", "doc_id", "row", "start"],
                )

    return run


_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


def _cut(size: int, k: int):
    """(doc_id, row, text, whole, starts) -> what is removed and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for doc, text, whole, starts in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4))):
                    raw = (text or "").encode()
                    words, spans, n = raw.split(), [], 0
                    if whole or starts:
                        dup = np.asarray(starts or [], dtype=np.int64)
                        if whole:
                            h, first = word_hashes(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), lower=False)
                            s, a = windows(h, first, size, k)
                            dup = np.concatenate((dup, s[np.isin(a, whole)]))
                        step = np.bincount(dup, minlength=len(words) + 1) - np.bincount(dup + size, minlength=len(words) + 1)
                        cover = np.cumsum(step)[: len(words)] > 0
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False]))))
                        spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                        n = int(cover.sum())
                        kept = [w for w, c in zip(words, cover) if not c]
                    else:
                        kept = words
                    rows.append((doc, len(words), n, spans, b" ".join(kept).decode()))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for each row of ``docs(doc_id, text, ...)``.

    A word goes if a window of min_words consecutive words covers it whose word sequence
    also starts in a document with a smaller doc_id; ``spans`` are the maximal removed
    repeats as [start, end) word positions, ``kept`` the other words joined by one space.
    Words are compared unchanged, by 128 bits of hash per window.

    Null, empty and short texts lose nothing.  Rows with a null doc_id are no smaller
    document and have none: they lose nothing.  Rows that share a doc_id lose nothing to
    each other and are judged each by its own text; identical rows give identical results.
    Extra columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size, k = min_words, max(1, min_words // 2)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    known = docs.where("doc_id is not null and text is not null")
    found = keep(known.mapInArrow(_anchors(size, k), "anchor long, around long, doc_id long, row long, place int"), "anchors")
    # anchors of several documents
    # (the small sides are kept, so that the joins have plain exchanges on both sides, which are split where an anchor is hot)
    shared = keep(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "seed-shared")
    seeds = keep(found.join(shared.hint("merge"), "anchor", "left_semi"), "seeds")
    drop(found, shared)
    classes = keep(seeds.groupBy("anchor", "around").agg(F.min("doc_id").alias("rep")), "seed-classes")
    split = keep(classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("split")), "seed-split")
    placed = seeds.join(classes.hint("merge"), ["anchor", "around"]).join(split.hint("merge"), "anchor", "left")
    placed = placed.withColumn("whole", F.col("doc_id") > F.col("rep")).where("whole or split")
    # of a class, rows other than the representative repeat as a whole
    marks = keep(
        placed.groupBy("doc_id", "row").agg(
            F.collect_list(F.when(F.col("whole"), F.col("place"))).alias("whole"),
            F.collect_list(F.when(~F.col("whole"), F.col("place"))).alias("edge"),
        ),
        "seed-marks",
    )
    drop(seeds, classes, split)
    edges = docs.join(marks.where("size(edge) > 0").select("doc_id", "row", "edge"), ["doc_id", "row"]).select("doc_id", "row", "text", "edge")
    tried = keep(edges.mapInArrow(_edge_windows(size, k), "w1 long, w2 long, doc_id long, row long, start int"), "edge-windows")
    least = keep(tried.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "seed-least")
    repeats = tried.join(least.hint("merge"), ["w1", "w2"]).where("doc_id > lo").groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"))
    cuts = keep(marks.where("size(whole) > 0").select("doc_id", "row", "whole").join(repeats, ["doc_id", "row"], "full"), "seed-cuts")
    drop(tried, marks, least)
    out = docs.join(cuts, ["doc_id", "row"], "left").select("doc_id", "row", "text", "whole", "starts")
    return out.mapInArrow(_cut(size, k), _OUT)
