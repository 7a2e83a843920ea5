"""Language identification by rank-order n-gram profiles (Cavnar & Trenkle, 1994).

A profile lists the most frequent letter n-grams of a language in order of frequency.
A document's own list is compared with each profile by the out-of-place distance: the
sum, over the document's n-grams, of how far each stands from its place in the profile,
or the profile's length where it is missing.  The least distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep
from .textscan import U64, chunks

UNKNOWN = "und"
#: n-grams in a profile; training documents taken for each language, least hash first.
PROFILE, TRAIN_DOCS = 400, 4000
_FIELDS = "doc_id long, lang_pred string, score double, distance double"
_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for all else (basic plane and beyond)."""
    global _lower
    if _lower is None:
        t = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _lower = t
    return _lower


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams (n = 1..3, words padded with one blank) and their counts.
    An n-gram is packed as 21 bits a code point; a run of letters is a word."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not c.any():
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    c = np.concatenate(([0], c, [0])).astype(U64)
    one = c[c > 0]
    a, b = c[:-1], c[1:]
    two = ((a << U64(21)) | b)[(a > 0) | (b > 0)]
    mid = c[1:-1] > 0  # a trigram has a letter in the middle: no gap inside
    three = ((c[:-2] << U64(42)) | (c[1:-1] << U64(21)) | c[2:] | U64(1 << 63))[mid]
    return np.unique(np.concatenate((one, two | U64(1 << 62), three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by code."""
    if len(grams) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        use = counts >= floor
        grams, counts = grams[use], counts[use]
    return grams[np.lexsort((grams, -counts))][:most]


def distances(own: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
    """Out-of-place distance of a document's ranked n-grams to each (sorted grams, ranks) profile."""
    place = np.arange(len(own))
    out = np.empty(len(profiles), dtype=np.int64)
    for i, (grams, rank) in enumerate(profiles):
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        out[i] = np.where(grams[at] == own, np.abs(rank[at] - place), most).sum()
    return out


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> n-gram counts of the partition by language."""
    totals: dict[str, dict] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mine = totals.setdefault(lang, {})
            for g, n in zip(*(x.tolist() for x in ngram_counts(text or ""))):
                mine[g] = mine.get(g, 0) + n
    for lang, mine in totals.items():
        g = np.fromiter(mine.keys(), dtype=U64, count=len(mine))
        yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(list(mine.values()), pa.int64())], names=["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, most: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """{lang: its most frequent n-grams, in order} from ``labelled(doc_id, text, lang)``.

    A classifier fit on a bounded sample: of each language the train_docs documents (about)
    whose doc_id and text hash least, at least the least of all; equal rows are in it together
    or not at all.  The result holds ``most`` numbers a language.  Rows with a null lang or text
    teach nothing.
    """
    # hashes are uniform, so a cut at a fraction of their range takes that fraction of a
    # language's rows, and no language is gathered in one task
    labelled = labelled.where("lang is not null and text is not null")
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.lit(7))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(h).alias("least")).collect()
    taught = F.lit(False)
    for row in counts:
        part = min(1.0, train_docs / row["count"])
        cut = 2**63 - 1 if part == 1 else max(row["least"], int(-(2**63) + part * (2**64 - 1)))
        taught = taught | ((F.col("lang") == row["lang"]) & (h <= F.lit(cut)))
    grams = labelled.where(taught).select("lang", "text").mapInArrow(_count_partition, "lang string, gram long, n long")
    grams = keep(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    out = {}
    for lang in sorted(r["lang"] for r in counts):
        # unsigned order of the packed n-gram, as in ranked()
        top = grams.where(F.col("lang") == lang).orderBy(F.col("n").desc(), F.col("gram") < 0, "gram").limit(most)
        out[lang] = [r["gram"] for r in top.select("gram").collect()]
    drop(grams)
    return {k: v for k, v in out.items() if v}


def _predict(profiles: dict[str, list[int]], most: int):
    names = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for name in names:
            g = np.array(profiles[name], dtype=np.int64).view(U64)
            order = np.argsort(g)
            tables.append((g[order], order))
        for batch in batches:
            for part in chunks(batch):
                langs, scores, dists = [], [], []
                for text in part.column(1).to_pylist():
                    own = ranked(*ngram_counts(text or ""), most)
                    if not len(own) or not tables:
                        langs.append(UNKNOWN), scores.append(0.0), dists.append(1.0)
                        continue
                    d = distances(own, tables, most) / (len(own) * most)
                    best = int(d.argmin())
                    others = np.delete(d, best)
                    next_ = float(others.min()) if len(others) else 1.0
                    langs.append(names[best])
                    scores.append(1 - float(d[best]) / next_ if next_ > 0 else 0.0)
                    dists.append(float(d[best]))
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(dists, pa.float64())], names=["doc_id", "lang_pred", "score", "distance"])

    return run


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], most: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score, distance) for each row of ``docs(doc_id, text, ...)``.

    distance is the least out-of-place distance as a share of the greatest possible; score
    is the lead over the next language, 1 - least / second (0: a tie; ties go to the lower
    code).  Texts that are null or hold no letter are ``und`` with score 0 and distance 1,
    as all are where no profile was learned.  Only the text is read; whole texts count.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_predict(profiles, most), _FIELDS)


def accepted(docs: DataFrame, profiles: dict[str, list[int]], most: int = PROFILE, max_distance: float = 0.97) -> DataFrame:
    """The rows of docs in one of the learned languages, all columns kept.  Texts without a
    letter go, and those whose n-grams are out of place in every profile (distance over
    max_distance of the greatest possible)."""

    run = _predict(profiles, most)
    schema = docs.schema

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.names.index(c) for c in ("doc_id", "text")]
            two = pa.record_batch([batch.column(i) for i in at], names=["doc_id", "text"])
            out = pa.Table.from_batches(list(run([two])) or [], None) if two.num_rows else None
            if out is None:
                continue
            good = [lang != UNKNOWN and d <= max_distance for lang, d in zip(out.column(1).to_pylist(), out.column(3).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(filtered, schema)
