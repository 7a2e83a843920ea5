"""Quality classifier: naive Bayes support vectors (Wang & Manning, 2012).

A text is the set of its n-grams: words and word pairs, and up to three consecutive word
shapes (letter case, trailing signs, whether the word repeats the one before), hashed to
a fixed number of features.  Indicators are scaled by the log ratio of the features'
smoothed counts in the two classes, then a linear model is fit with hinge loss by dual
coordinate descent (Hsieh et al., 2008) and its margin turned into a probability by
Platt's sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep
from .textscan import U64, chunks, mix, ngrams, text_buffers, word_hashes, word_spans

FEATURES = 1 << 18
#: Labelled rows in the fit, those whose doc_id hashes least; the class counts take all.
FIT_ROWS = 8000
_BLOCK = 1 << 12

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 upper, 1 lower or beyond ASCII, 2 digit, 3 sign
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 1


def _shapes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each word's shape, without regard to its letters."""
    kind = _KIND[buf]
    total = np.zeros((4, len(buf) + 1), dtype=np.int32)
    for c in range(4):
        np.cumsum(kind == c, out=total[c, 1:])
    n = total[:, e] - total[:, s]
    code = np.zeros(len(s), dtype=U64)
    for c in range(4):
        code = code * U64(3) + np.minimum(n[c], 2).astype(U64)
    code = code * U64(4) + kind[s]
    for back in (1, 2, 3):  # up to three signs at the end
        at = np.maximum(e - back, s)
        sign = (kind[at] == 3) & (e - back >= s)
        code = code * U64(257) + np.where(sign, buf[at].astype(U64) + U64(1), U64(0))
    return code


def features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct feature numbers of each text, sorted."""
    buf, offs = text_buffers(texts)
    h, first = word_hashes(buf, offs, lower=True)
    s, e, _ = word_spans(buf, offs)
    shape = _shapes(buf, s, e)
    again = np.zeros(len(h), dtype=bool)  # the word before, of the same text
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    shape = mix(shape * U64(2) + again.astype(U64) + U64(0xABCDEF))
    kinds = [mix(h), ngrams(h, 2)] + [mix(ngrams(shape, k) + U64(k)) for k in (1, 2, 3)]
    spans = (1, 2, 1, 2, 3)
    out = []
    for i in range(len(texts)):
        lo, hi = first[i], first[i + 1]
        own = np.concatenate([g[lo : max(lo, hi - k + 1)] for g, k in zip(kinds, spans)])
        out.append(np.unique((own >> U64(40)).astype(np.int64) % FEATURES))
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, fit, text) -> features of the rows to fit, and the partition's class counts in blocks."""
    counts = np.zeros((2, FEATURES), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    names = ["block", "label", "data"]
    for batch in batches:
        for part in chunks(batch):
            labels, fit = part.column(0).to_pylist(), part.column(1).to_pylist()
            own = features(part.column(2))
            for y, x in zip(labels, own):
                counts[y, x] += 1
                rows[y] += 1
            use = [i for i, f in enumerate(fit) if f]
            data = [own[i].astype(np.int32).tobytes() for i in use]
            yield pa.record_batch([pa.array([-1] * len(use), pa.int32()), pa.array([labels[i] for i in use], pa.int32()), pa.array(data, pa.binary())], names=names)
    if rows.any():
        blocks = list(range(FEATURES // _BLOCK))
        for y in (0, 1):
            data = [counts[y, b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in blocks]
            yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array([y] * len(blocks), pa.int32()), pa.array(data, pa.binary())], names=names)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each (block, label); a partition holds whole keys, a few hundred in all."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, label, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            sums.setdefault((block, label), np.zeros(_BLOCK, dtype=np.int64))[:] += np.frombuffer(data, dtype=np.int64)
    keys = list(sums)
    yield pa.record_batch(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())],
        names=["block", "label", "data"],
    )


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, c: float, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last is the bias) of min 1/2 |w|^2 + c * sum of hinge losses, y in -1, 1."""
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + w[n]) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                w[n] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.column_stack((margin, np.ones(len(margin))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = x.T @ (p - t)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, c: float = 1.0, epochs: int = 20, seed: int = 11) -> dict:
    """A model from ``labelled(doc_id, text, label)`` with label 0 or 1.

    The class counts behind the ratios are of all rows; the linear model is fit on a bounded
    sample, the fit_rows rows (about) whose doc_id and text hash least; rows with the same words
    and label count once there.  Rows with a null label are left out; a null text is empty.
    Without rows of both classes in the sample every score is the share of label 1 among all
    rows (0.5 without rows).
    """
    labelled = labelled.where("label in (0, 1)")
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.lit(seed))
    # without the texts, which would else be moved once more
    sizes = {int(r["label"]): r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(sizes.values())
    part = min(1.0, fit_rows / max(1, total))
    cut = 2**63 - 1 if part == 1 else int(-(2**63) + part * (2**64 - 1))
    rows = labelled.select(F.col("label").cast("int").alias("label"), (h <= F.lit(cut)).alias("fit"), "text")
    gathered = keep(rows.mapInArrow(_gather, "block int, label int, data binary"), "nbsvm")
    schema = "block int, label int, data binary"
    sums = gathered.where("block >= 0").repartition("block", "label").mapInArrow(_sum_blocks, schema).collect()
    counts = np.zeros((2, FEATURES))
    for r in sums:
        counts[r["label"], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(bytes(r["data"]), dtype=np.int64)
    taken = gathered.where("block < 0").select("label", "data").distinct().collect()
    drop(gathered)
    taken = sorted(((r["label"], bytes(r["data"])) for r in taken))
    y = np.array([2 * label - 1 for label, _ in taken], dtype=float)
    if not len(y) or abs(y.sum()) == len(y):
        share = sizes.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return {"w": np.zeros(FEATURES + 1, dtype=np.float32), "a": 0.0, "b": float(np.log(share / (1 - share)))}
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    xs = [np.frombuffer(d, dtype=np.int32) for _, d in taken]
    vs = [ratio[x] / max(1.0, np.sqrt(len(x))) for x in xs]
    # margins for the sigmoid come from rows that the weights have not seen
    fold = np.arange(len(xs)) % 3
    margin = np.zeros(len(xs))
    for f in range(3):
        use, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        w = dual_coordinate_descent([xs[i] for i in use], [vs[i] for i in use], y[use], FEATURES, c, epochs, seed)
        margin[test] = [w[xs[i]] @ vs[i] + w[FEATURES] for i in test]
    a, b = platt(margin, y)
    w = dual_coordinate_descent(xs, vs, y, FEATURES, c, epochs, seed)
    w[:FEATURES] *= ratio
    return {"w": w.astype(np.float32), "a": a, "b": b}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model["w"]
        for batch in batches:
            for part in chunks(batch):
                m = np.array([w[x].sum() / max(1.0, np.sqrt(len(x))) + w[FEATURES] for x in features(part.column(1))], dtype=float)
                yield pa.record_batch([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -35, 35))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text, ...)``: the probability of label 1.

    Whole texts are read and nothing else.  Null and empty texts get the score of a text
    without n-grams.  Repeated rows and null ids are scored like any other.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")
