"""Language-model scoring: a gated recurrent network in numpy.

Tokens are lower-cased words and one end a text.  The output softmax is factored into
classes: the HEAD most frequent words in classes of equal size, ordered by frequency, with
a softmax of their own inside each, and classes of all other words by their last two
bytes.  Inside those a word seen in training takes its share of the corpus counts, less
the class's share of words seen once (Good-Turing); that share is left to unseen words,
among which a byte model that spells backwards from the suffix divides it.  So the
probabilities of all words, known or not, sum to one at most.

Gates and candidate state use the softsign x / (1 + |x|), a sigmoid without exponentials.
The network is trained by truncated backpropagation on every training text: in each round
replicas pass once over their parts of the corpus from one start, and are averaged into
the start of the next.  Scoring carries the state across windows, from the first word of
a text to its end.

Texts are read twice: once to count words, once to encode them; training and scoring
read the encoded table, two bytes a token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep
from .textscan import LOWER, U64, chunks, text_buffers, word_hashes, word_spans

HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 16, 32, 16
HEAD = HEAD_CLASSES * CLASS_WORDS  # the end token is word 0
CLASSES = HEAD_CLASSES + TAIL_CLASSES
HIDDEN, WINDOW, LANES = 16, 16, 512
#: Tokens whose output probabilities are worked out together: what fits a core's cache.
SLICE = 4096
#: Rounds of averaging, tokens of a replica in all rounds, and the least number of its updates
#: a round (a short stream is passed more than once).
ROUNDS, REPLICA_TOKENS, LEAST_UPDATES = 3, 4_000_000, 150
#: Replicas averaged in one task; more are averaged in a tree.
FAN_IN = 64
#: At most so many of the most frequent words travel to every task with their counts (16 bytes
#: each); rarer words are joined.
CARRIED = 1 << 18
_END = 1  # the hash that stands for the end token
SUFFIXES = (1 << 16) + 256
_BEGIN = 256  # stands to the left of a word's first byte


def _suffix(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Last two bytes of each word as one number, 65536 + the byte for words of one; A-Z lower-cased."""
    last = LOWER[buf[e - 1]].astype(np.int64)
    return np.where(e - s > 1, LOWER[buf[np.maximum(e - 2, 0)]].astype(np.int64) << 8, 1 << 16) | last


def _pairs(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Counts of (byte, byte to its left or _BEGIN) in the given words, flat by 257 * byte + left."""
    low = LOWER[buf].astype(np.int32)
    inside = np.cumsum(np.bincount(s, minlength=len(buf) + 1) - np.bincount(e, minlength=len(buf) + 1))[: len(buf)].astype(bool)
    inside[s] = False  # bytes with a left neighbour in their word
    at = np.flatnonzero(inside)
    codes = np.concatenate((low[at] * 257 + low[at - 1], low[s] * 257 + _BEGIN))
    return np.bincount(codes, minlength=256 * 257)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (kind, h, suffix, n): words of a partition (kind 0), merged whenever a million pile
    up, and byte pairs of the distinct words of each piece of text (kind 1)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = texts = 0
    pairs = np.zeros(256 * 257, dtype=np.int64)

    def merged():
        h, s, n = (np.concatenate(x) for x in zip(*held))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, s[first], np.bincount(inverse, weights=n).astype(np.int64)

    def rows(kind, h, s, n):
        return pa.record_batch([pa.array(np.full(len(h), kind, dtype=np.int8)), pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], names=["kind", "h", "suffix", "n"])

    for batch in batches:
        for part in chunks(batch):
            buf, offs = text_buffers(part.column(0))
            h, _ = word_hashes(buf, offs, lower=True)
            s, e, _ = word_spans(buf, offs)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, _suffix(buf, s[first], e[first]), n))
            pairs += _pairs(buf, s[first], e[first])
            size, texts = size + len(u), texts + part.num_rows
            if size > 1 << 20:
                one = merged()
                if len(one[0]) > 1 << 19:
                    yield rows(0, *one)
                    held, size = [], 0
                else:
                    held, size = [one], len(one[0])
    if held:
        yield rows(0, *merged())
    if texts:
        yield rows(0, np.array([_END], dtype=U64), np.array([0]), np.array([texts], dtype=np.int64))
        at = np.flatnonzero(pairs)
        yield rows(1, at, np.zeros(len(at)), pairs[at])


def count_words(texts: DataFrame) -> DataFrame:
    """(kind, h, suffix, n) of all ``texts(text, ...)``, a kept table: words and ends (kind 0), byte pairs (kind 1)."""
    body = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = body.mapInArrow(_counted, "kind byte, h long, suffix int, n long")
    return keep(counts.groupBy("kind", "h").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n")), "lm-counts")


@dataclass
class Vocabulary:
    head: np.ndarray  # sorted hashes of head words
    head_id: np.ndarray  # their word numbers, by frequency
    head_n: np.ndarray  # counts by word number
    carried: np.ndarray  # sorted hashes of the CARRIED most frequent words
    carried_n: np.ndarray
    tail_class: np.ndarray  # suffix -> tail class
    seen: np.ndarray  # by tail class: log10 of (1 - unseen share) / mass
    unseen: np.ndarray  # by tail class: log10 of the unseen share
    tail_n: np.ndarray  # tokens by tail class
    suffix_log: np.ndarray  # log10 of a suffix's share of its class, by distinct words
    left_log: np.ndarray  # log10 P(byte to the left or _BEGIN | byte), flat
    total: int  # N
    types: int  # V

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.types + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of count_words().  What comes to the driver is bounded: CARRIED words
    (and what of the head is not among them), 65792 suffixes and as many byte pairs."""
    # a histogram of some hundred bins tells the least count that CARRIED words reach, so no
    # partition sends its own top words
    bin_ = F.floor(F.log2(F.col("n")) * 16)
    every = counts.where("kind = 0")
    words = every.where(F.col("h") != _END)
    room, floor = CARRIED, 0
    for r in sorted(words.groupBy(bin_.alias("b")).count().collect(), key=lambda r: -r["b"]):
        room -= r["count"]
        if room < 0:
            floor = r["b"] + 1
            break
    top = words.where(bin_ >= floor).select("h", "n").toPandas()
    if floor and len(top) < HEAD - 1:  # the next bin alone holds more than CARRIED words: its most frequent ones
        top = pd.concat([top, words.where(bin_ == floor - 1).select("h", "n").orderBy(F.desc("n"), "h").limit(HEAD - 1 - len(top)).toPandas()])
    end = every.where(F.col("h") == _END).select("h", "n").toPandas()  # word 0, however rare
    top = pd.concat([end, top.sort_values(["n", "h"], ascending=[False, True])])
    total, types = every.agg(F.sum("n"), F.count("*")).first()
    h = top["h"].to_numpy(dtype=np.int64).view(U64)
    n = top["n"].to_numpy(dtype=np.int64)
    head_h, head_n = h[:HEAD], n[:HEAD]
    s, c = np.argsort(head_h), np.argsort(h)
    tail = every.where(~F.col("h").isin([int(x) for x in head_h.view(np.int64)]))
    by = tail.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).toPandas()
    by = by.sort_values(["n", "suffix"], ascending=[False, True])
    suffix = by["suffix"].to_numpy(dtype=np.int64)
    tail_class = np.full(SUFFIXES, TAIL_CLASSES - 1, dtype=np.int16)
    tail_class[suffix] = np.arange(len(by)) % (TAIL_CLASSES - 1)
    k = tail_class[suffix]
    sums = [np.bincount(k, weights=by[c].to_numpy(dtype=float), minlength=TAIL_CLASSES) for c in ("n", "v", "once")]
    share = np.clip((sums[2] + 0.5) / (sums[0] + 1), 1e-4, 0.9)
    share[sums[1] == 0] = 1.0
    mass = np.where(sums[1] > 0, sums[0] + 0.5 * sums[1], 1.0)
    with np.errstate(divide="ignore"):
        seen = np.where(sums[1] > 0, np.log10(1 - share) - np.log10(mass), 0.0)
    of_suffix = np.full(SUFFIXES, 0.1)
    of_suffix[suffix] += by["v"].to_numpy(dtype=float)
    suffix_log = np.log10(of_suffix / np.bincount(tail_class, weights=of_suffix, minlength=TAIL_CLASSES)[tail_class])
    left = np.full(256 * 257, 0.05)
    for r in counts.where("kind = 1").select("h", "n").toPandas().itertuples():
        left[r.h] += r.n
    left = left.reshape(256, 257)
    left_log = np.log10(left / left.sum(axis=1, keepdims=True)).ravel()
    return Vocabulary(head_h[s], s, head_n, h[c], n[c], tail_class, seen, np.log10(share), sums[0], suffix_log, left_log, int(total or 0), int(types or 0))


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, -1 where missing."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def spelling(buf: np.ndarray, s: np.ndarray, e: np.ndarray, suffix: np.ndarray, v: Vocabulary) -> np.ndarray:
    """log10 of the share that each word takes among all spellings of its tail class: its suffix,
    then byte after byte to the left, then the begin."""
    low = LOWER[buf].astype(np.int32)
    sums = np.zeros(len(buf) + 1)
    if len(buf) > 1:
        np.cumsum(v.left_log[low[1:] * 257 + low[:-1]], out=sums[1:-1])  # sums[i]: pairs with a left byte before i
    more = sums[np.maximum(e - 2, s)] - sums[s] + v.left_log[low[s] * 257 + _BEGIN]
    return v.suffix_log[suffix] + np.where(e - s > 1, more, 0.0)


_ENCODED = (
    "key long, doc_id long, train boolean, n_tokens long, known long, base double, inner double, ids binary, "
    "rare array<struct<h:bigint,tf:int,seen:double,unseen:double>>"
)


def _encode(v: Vocabulary):
    """(doc_id, train, text) -> the encoded table.  Head words keep their number, others are HEAD +
    class; the end is 0.  base and inner hold what the carried counts tell; words without one are
    listed in ``rare``, once a text, with their share of the class if seen or if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part = TaskContext.get()
        next_key = (at_part.partitionId() if at_part else 0) << 40
        norm = np.log10(v.norm)
        carried_log = np.log10(v.carried_n + 0.5)
        head_of = np.full(len(v.carried) + 1, -1, dtype=np.int64)  # place among the carried -> head number
        head_of[_find(v.carried, v.head)] = v.head_id
        head_of[-1] = -1
        end_n = int(v.head_n[0]) if len(v.head_n) and v.total else 0
        for batch in batches:
            for part in chunks(batch):
                rows = part.num_rows
                buf, offs = text_buffers(part.column(2))
                h, first = word_hashes(buf, offs, lower=True)
                s, e, _ = word_spans(buf, offs)
                at = _find(v.carried, h)
                suffix = _suffix(buf, s, e) if len(s) else np.zeros(0, dtype=np.int64)
                tail = v.tail_class[suffix]
                ids = head_of[at]
                in_tail = ids < 0
                ids = np.where(in_tail, HEAD + tail, ids).astype(np.int16)
                found = at >= 0
                log_n = np.where(found, carried_log[at] if len(v.carried) else 0.0, 0.0)
                inner = np.where(found & in_tail, log_n + v.seen[tail], 0.0)
                who = np.repeat(np.arange(rows), np.diff(first))
                known, base, inside = (np.bincount(who, weights=x, minlength=rows) for x in (found, np.where(found, log_n - norm, 0.0), inner))
                rare = np.flatnonzero(~found)
                rare = rare[np.lexsort((h[rare], who[rare]))]  # one entry a word and text
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (who[rare[1:]] != who[rare[:-1]]) | (h[rare[1:]] != h[rare[:-1]])
                start = np.flatnonzero(new)
                tf = np.diff(np.append(start, len(rare)))
                word = rare[start]
                spelled = v.unseen[tail[word]] + spelling(buf, s[word], e[word], suffix[word], v) if len(word) else np.zeros(0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(who[word], np.arange(rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(h[word].view(np.int64)), pa.array(tf.astype(np.int32)), pa.array(v.seen[tail[word]]), pa.array(spelled)], names=["h", "tf", "seen", "unseen"]),
                )
                ends = np.zeros(1, dtype=np.int16).tobytes()
                data = [ids[first[i] : first[i + 1]].tobytes() + ends for i in range(rows)]
                n = np.diff(first) + 1
                yield pa.record_batch(
                    [
                        pa.array(np.arange(next_key, next_key + rows)), part.column(0), part.column(1), pa.array(n.astype(np.int64)),
                        pa.array(known.astype(np.int64) + (end_n > 0)), pa.array(base + np.log10(end_n + 0.5) - norm), pa.array(inside), pa.array(data, pa.binary()), lists,
                    ],
                    names=["key", "doc_id", "train", "n_tokens", "known", "base", "inner", "ids", "rare"],
                )
                next_key += rows

    return run


def encode(docs: DataFrame, v: Vocabulary, train: Column) -> DataFrame:
    """The encoded table (kept) of ``docs(doc_id, text, ...)``; ``train`` marks rows to learn from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    return keep(rows.mapInArrow(_encode(v), _ENCODED), "lm-encoded")


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by groups: ``order`` brings a group's rows together, ``first`` is where each begins."""
    return np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)


class Network:
    """GRU with class-factored output; all parameters in one flat vector.  The last rows of C and
    of each W are biases: states are given a one at their end."""

    SHAPES = {
        "Eg": (HEAD + TAIL_CLASSES, 2 * HIDDEN), "En": (HEAD + TAIL_CLASSES, HIDDEN), "Ug": (HIDDEN, 2 * HIDDEN), "Un": (HIDDEN, HIDDEN),
        "C": (HIDDEN + 1, CLASSES), "W": (HEAD_CLASSES, HIDDEN + 1, CLASS_WORDS),
    }

    def __init__(self, flat: np.ndarray | None = None):
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        self.flat = np.zeros(size, dtype=np.float32) if flat is None else flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, v: Vocabulary, seed: int) -> Network:
        """Small random weights; biases that give every word its corpus share."""
        net, rng = cls(), np.random.default_rng(seed)
        for x in (net.Eg, net.En):
            x[:] = rng.normal(0, 0.5, x.shape)
        for x in (net.Ug, net.Un):
            x[:] = rng.normal(0, 1 / np.sqrt(HIDDEN), x.shape)
        words = np.full(HEAD, 0.01)
        words[: len(v.head_n)] += v.head_n
        words = words.reshape(HEAD_CLASSES, CLASS_WORDS)
        net.W[:, -1] = np.log(words / words.sum(axis=1, keepdims=True))
        classes = np.concatenate((words.sum(axis=1), v.tail_n + 0.5))
        net.C[-1] = np.log(classes / classes.sum())
        return net

    def forward(self, ids: np.ndarray, live: np.ndarray, states: np.ndarray, h: np.ndarray, past: tuple | None = None) -> np.ndarray:
        """Run over the steps of ids (steps, lanes); live is 0 where a text begins.  Fills states[t],
        the state before step t (a one at its end), and what ``past`` holds for the gradient;
        returns the state after the last step."""
        gates, new = np.take(self.Eg, ids, axis=0), np.take(self.En, ids, axis=0)
        live = live[:, :, None]
        for t in range(len(ids)):
            now = h * live[t]
            states[t, :, :HIDDEN] = now
            s = now @ self.Un
            a = gates[t]
            a += now @ self.Ug
            q = np.abs(a)
            q += 1
            a /= q
            a *= 0.5
            a += 0.5
            n = new[t]
            n += a[:, :HIDDEN] * s
            m = np.abs(n)
            m += 1
            n /= m
            if past is not None:
                past.append((now, s, a, q, n, m))
            h = now - n
            h *= a[:, HIDDEN:]
            h += n
        return h

    def output(self, states: np.ndarray, ids: np.ndarray, grads: Network | None = None):
        """Natural log probability of each token (a tail token: of its class), and the gradient
        of their negative sum by the states if grads collects the parameters'."""
        parts = [self._output(states[i : i + SLICE], ids[i : i + SLICE], grads) for i in range(0, len(ids), SLICE)]
        return np.concatenate([x for x, _ in parts]), None if grads is None else np.concatenate([d for _, d in parts])

    def _output(self, states: np.ndarray, ids: np.ndarray, grads: Network | None):
        cls = np.where(ids < HEAD, ids // CLASS_WORDS, ids - (HEAD - HEAD_CLASSES)).astype(np.int16)
        rows = np.arange(len(ids))
        p = states @ self.C
        if np.abs(self.C).sum(axis=0).max() > 60:  # states are within one: only then could exp overflow
            p -= p.max(axis=1, keepdims=True)
        mine = rows * CLASSES + cls
        out = np.take(p, mine)
        np.exp(p, out=p)
        norm = p @ np.ones(CLASSES, dtype=p.dtype)
        out -= np.log(norm)
        dstates = None
        if grads is not None:
            p *= (1 / norm)[:, None]
            p.ravel()[mine] -= 1
            grads.C += states.T @ p
            dstates = p @ self.C[:HIDDEN].T
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
        order = order[: edge[-1]]
        classes = [(k, slice(edge[k], edge[k + 1])) for k in np.flatnonzero(np.diff(edge))]
        x, mine = np.take(states, order, axis=0), rows[: len(order)] * CLASS_WORDS + ids[order] % CLASS_WORDS
        y = np.empty((len(order), CLASS_WORDS), dtype=np.result_type(states, self.W))
        for k, i in classes:
            np.matmul(x[i], self.W[k], out=y[i])
        if np.abs(self.W).sum(axis=1).max() > 60:
            y -= y.max(axis=1, keepdims=True)
        picked = np.take(y, mine)
        np.exp(y, out=y)
        total = y @ np.ones(CLASS_WORDS, dtype=y.dtype)
        out[order] += picked - np.log(total)
        if grads is not None and classes:
            y *= (1 / total)[:, None]
            y.ravel()[mine] -= 1
            dx = np.empty((len(order), HIDDEN), dtype=y.dtype)
            for k, i in classes:
                grads.W[k] += x[i].T @ y[i]
                np.matmul(y[i], self.W[k, :HIDDEN].T, out=dx[i])
            dstates[order] += dx
        return out, dstates

    def window(self, ids: np.ndarray, h: np.ndarray, fresh: np.ndarray, grads: Network) -> tuple[float, np.ndarray]:
        """One window of truncated backpropagation: ids (steps, lanes), the state before it,
        and where a text begins.  Adds gradients of the summed loss; returns loss and state."""
        steps, lanes = ids.shape
        kind = self.flat.dtype
        states = np.ones((steps, lanes, HIDDEN + 1), dtype=kind)
        live, flat_ids, past = (~fresh).astype(kind), ids.ravel(), []
        h = self.forward(ids, live, states, h, past)
        logp, d = self.output(states.reshape(-1, HIDDEN + 1), flat_ids, grads)
        d = d.reshape(steps, lanes, HIDDEN)
        by_gates, by_new, by_s = (np.empty((steps, lanes, w * HIDDEN), dtype=kind) for w in (2, 1, 1))
        dh = np.zeros((lanes, HIDDEN), dtype=kind)
        gates_t, new_t = np.ascontiguousarray(self.Ug.T), np.ascontiguousarray(self.Un.T)
        for t in range(steps - 1, -1, -1):
            now, s, a, q, n, m = past[t]
            dn, da = by_new[t], by_gates[t]
            z = a[:, HIDDEN:]
            np.subtract(1, z, out=dn)
            dn *= dh
            m *= m
            dn /= m
            np.multiply(dn, a[:, :HIDDEN], out=by_s[t])
            s *= dn
            now -= n
            now *= dh
            da[:, :HIDDEN], da[:, HIDDEN:] = s, now
            da *= 0.5
            q *= q
            da /= q
            dh *= z
            dh += da @ gates_t
            dh += by_s[t] @ new_t
            dh += d[t]
            dh *= live[t][:, None]
        before = states.reshape(-1, HIDDEN + 1)[:, :HIDDEN].T
        gates, new = by_gates.reshape(-1, 2 * HIDDEN), by_new.reshape(-1, HIDDEN)
        grads.Ug += before @ gates
        grads.Un += before @ by_s.reshape(-1, HIDDEN)
        order = np.argsort(flat_ids, kind="stable")
        words = flat_ids[order]
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        grads.Eg[words[first]] += _sums(gates, order, first)
        grads.En[words[first]] += _sums(new, order, first)
        return -float(logp.sum()), h


def train(net: Network, stream: np.ndarray, least: int = LEAST_UPDATES, rate: float = 0.01, progress: tuple[float, float] = (0.0, 1.0)) -> int:
    """Adam over lanes of one token stream (texts end with word 0): one pass over all of it, or as
    many as make ``least`` updates.  The rate falls with ``progress``, the part of the whole
    training that this pass begins and ends at.  Returns the number of updates."""
    if len(stream) < 2:
        return 0
    lanes = int(min(LANES, max(1, len(stream) // WINDOW)))
    length = -(-len(stream) // lanes)
    ids = np.resize(stream, lanes * length).reshape(lanes, length).T  # the last lane ends with the stream's begin
    ids = np.ascontiguousarray(ids, dtype=np.int16)
    fresh = np.zeros(ids.shape, dtype=bool)
    fresh[1:] = ids[:-1] == 0
    fresh[0] = True
    a_pass = -(-length // WINDOW)
    updates = a_pass * -(-least // a_pass)  # whole passes
    m, v, by = np.zeros_like(net.flat), np.zeros_like(net.flat), np.empty_like(net.flat)
    grads = Network(np.zeros_like(net.flat))
    g = grads.flat
    done = 0
    while done < updates:
        h = np.zeros((lanes, HIDDEN), dtype=net.flat.dtype)
        for at in range(0, length, WINDOW):
            g.fill(0)
            part = ids[at : at + WINDOW]
            _, h = net.window(part, h, fresh[at : at + WINDOW], grads)
            norm = float(np.sqrt(g @ g))
            if norm > part.size:  # sums, not means, keep the squares out of the subnormal numbers
                g *= part.size / norm
            done += 1
            m *= 0.9
            m += np.multiply(g, 0.1, out=by)
            v *= 0.99
            np.multiply(g, g, out=by)
            by *= 0.01
            v += by
            pace = rate * max(0.02, 1 - progress[0] - (progress[1] - progress[0]) * done / updates)
            np.sqrt(v, out=by)
            by *= 1 / np.sqrt(1 - 0.99**done).item()
            by += 1e-4
            np.divide(m, by, out=by)
            by *= pace / (1 - 0.9**done)
            net.flat -= by
    return done


_PARAMS = "n long, data binary"


def _replica(start: np.ndarray, progress: tuple[float, float]):
    """(ids) -> the replica's parameters with its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held = Network(start.copy()), []
        for batch in batches:
            held += [np.frombuffer(x.as_buffer(), dtype=np.int16) for x in batch.column(0)]
        if held:
            stream = np.concatenate(held)
            held.clear()
            train(net, stream, progress=progress)
            yield pa.record_batch([pa.array([len(stream)], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], names=["n", "data"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, sums = 0, 0.0
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            total, sums = total + n, sums + np.frombuffer(data.as_buffer(), dtype=np.float32).astype(np.float64) * n
    if total:
        yield pa.record_batch([pa.array([total], pa.int64()), pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())], names=["n", "data"])


def train_round(encoded: DataFrame, start: Network, i: int, rounds: int, replicas: int) -> DataFrame:
    """(n, data): tokens and parameters of the average of all replicas of round i, at most one row.

    Every text that is marked to learn from is in one round and one replica of it, by a hash of
    its id and place in the table; the average is weighted by tokens and made in a tree."""
    rows = encoded.where("train").select(F.xxhash64("doc_id", "key").alias("o"), "ids")
    part = rows.where(F.pmod("o", F.lit(rounds)) == i).repartition(replicas, "o").sortWithinPartitions("o").select("ids")
    made = part.mapInArrow(_replica(start.flat, (i / rounds, (i + 1) / rounds)), _PARAMS)
    while replicas > 1:
        replicas = -(-replicas // FAN_IN)
        made = made.repartition(replicas).mapInArrow(_average, _PARAMS)
    return made


def fit(encoded: DataFrame, v: Vocabulary, seed: int = 5, rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS) -> Network:
    """A network trained on all rows of the encoded table that are marked to learn from.  Without
    such rows it gives every word its share."""
    net = Network.start(v, seed)
    for i in range(rounds):
        got = train_round(encoded, net, i, rounds, max(1, round(v.total / replica_tokens))).collect()
        if got:
            net = Network(np.frombuffer(bytes(got[0]["data"]), dtype=np.float32).copy())
    return net


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of the class-and-head probability of each id sequence (ends included).  Texts
    are dealt to lanes of about equal length and run one after the other, from a zero state each."""
    out = np.zeros(len(texts))
    lanes = [(0, i, []) for i in range(min(LANES, len(texts)))]
    for i in np.argsort([-len(t) for t in texts], kind="stable"):
        load, j, own = lanes[0]
        own.append(int(i))
        heapq.heapreplace(lanes, (load + len(texts[i]), j, own))
    lanes.sort(key=lambda x: (-x[0], x[1]))
    lengths = np.array([x[0] for x in lanes], dtype=np.int64)
    streams = [np.concatenate([texts[i] for i in own]) for _, _, own in lanes]
    owners = [np.repeat(np.array(own, dtype=np.int32), [len(texts[i]) for i in own]) for _, _, own in lanes]
    kind = net.flat.dtype
    h = np.zeros((len(lanes), HIDDEN), dtype=kind)
    last = np.zeros(len(lanes), dtype=np.int16)  # the state before a lane's first text is zero
    at = 0
    while at < (lengths[0] if len(lanes) else 0):
        live = int(np.searchsorted(-lengths, -at, side="left"))  # lanes longer than at
        # a lane may end within the block: it runs over ends, which no text owns
        width = int(min(lengths[0] - at, (1 << 17) // live))
        ids = np.zeros((live, width), dtype=np.int16)
        who = np.full((live, width), len(texts), dtype=np.int32)
        for j in range(live):
            part = streams[j][at : at + width]
            ids[j, : len(part)] = part
            who[j, : len(part)] = owners[j][at : at + width]
        ids, logp = np.ascontiguousarray(ids.T), np.empty((width, live), dtype=kind)
        going = (np.vstack((last[None, :live], ids[:-1])) != 0).astype(kind)
        h = h[:live]
        steps = max(1, SLICE // live)
        for i in range(0, width, steps):
            some = ids[i : i + steps]
            states = np.ones((*some.shape, HIDDEN + 1), dtype=kind)
            h = net.forward(some, going[i : i + steps], states, h)
            logp[i : i + steps] = net.output(states.reshape(-1, HIDDEN + 1), some.ravel())[0].reshape(some.shape)
        out += np.bincount(who.T.ravel(), weights=logp.ravel(), minlength=len(texts) + 1)[:-1]
        last = ids[-1]
        at += width
    return out


_SCORED = "key long, doc_id long, n_tokens long, known long, base double, model double"


def _score(net: np.ndarray, tokens_a_group: int = 1 << 23, docs_a_group: int = 1 << 14):
    """(key, doc_id, n_tokens, known, base, inner, ids) -> the network's part of each text's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(net)
        held, size, rows = [], 0, 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = [np.frombuffer(x.as_buffer(), dtype=np.int16) for x in whole.column("ids")]
            model_log = score_texts(model, texts) / np.log(10) + whole.column("inner").to_numpy()
            cols = [whole.column(c).combine_chunks() for c in ("key", "doc_id", "n_tokens", "known", "base")]
            return pa.record_batch([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols] + [pa.array(model_log)], names=["key", "doc_id", "n_tokens", "known", "base", "model"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size, rows = size + batch.column(batch.schema.get_field_index("ids")).nbytes // 2, rows + batch.num_rows
            if size >= tokens_a_group or rows >= docs_a_group:
                yield flush()
                held, size, rows = [], 0, 0
        if held:
            yield flush()

    return run


def score(encoded: DataFrame, net: Network, v: Vocabulary, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of the encoded table.

    base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's words and its
    end, score the network's log10 probability of them.
    """
    main = encoded.select("key", "doc_id", "n_tokens", "known", "base", "inner", "ids").mapInArrow(_score(net.flat), _SCORED)
    rare = encoded.select("key", F.inline("rare"))
    words = counts.where("kind = 0").select("h", "n").hint("merge")  # the vocabulary grows with the corpus
    n = F.col("n")
    base = F.col("tf") * (F.log10(F.coalesce(n, F.lit(0)) + 0.5) - F.lit(float(np.log10(v.norm))))
    inner = F.col("tf") * F.when(n.isNull(), F.col("unseen")).otherwise(F.log10(n + 0.5) + F.col("seen"))
    per_text = rare.join(words, "h", "left").groupBy("key").agg(
        F.sum(F.when(n.isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(base).alias("rare_base"), F.sum(inner).alias("rare_inner")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return main.join(per_text.hint("merge"), "key", "left").select(
        "doc_id", "n_tokens", plus("known", "rare_known").cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), plus("model", "rare_inner").alias("score"),
    )


def learn_and_score(docs: DataFrame, train: Column, seed: int = 5) -> DataFrame:
    """score() of every row of ``docs(doc_id, text, ...)`` by a model that learns from all rows where
    ``train`` holds (null: does not).

    A null or blank text is its end alone.  Null ids and repeated rows are counted, learned
    from and scored like any other.  Whole texts are read; extra columns are ignored, whatever
    their names.  Without training rows N and V are 0 and every word is unseen.  An empty
    table gives an empty result.
    """
    two = docs.select("doc_id", "text", train.alias("train"))
    counts = count_words(two.where("train"))
    v = vocabulary(counts)
    encoded = encode(two, v, F.col("train"))
    return score(encoded, fit(encoded, v, seed), v, counts)
