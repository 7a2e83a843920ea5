"""Vectorised word and shingle scanning of Arrow string columns.

Everything here works on the raw UTF-8 buffers of an Arrow column, so no Python
string is built per word.  A word is a maximal run of bytes other than
``\\x20 \\x09-\\x0D`` (the class ``[^\\x20\\x09-\\x0D]+`` of the contracts);
lower-casing touches A-Z only.  Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 20
_LONG = 64  # bytes; powers modulo 2**64 tell longer words apart less and less
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, b, dtype=U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 16 * _PIECE:
            return tuple(tables)  # for one giant word: not worth keeping
        _powers = tuple(tables)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows have zero length."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding about ``limit`` bytes of text each, so that the
    working arrays stay small whatever the Arrow batch size; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    offs = text_buffers(batch.column(batch.schema.get_field_index(text)))[1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _pieces(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about a piece, cut at white space or between documents."""
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + _PIECE)
        if to < n:
            doc_cut = int(offs[np.searchsorted(offs, to, side="right") - 1])
            gaps = np.flatnonzero(SPACE[buf[at:to]])
            cut = max(doc_cut, at + int(gaps[-1]) + 1 if len(gaps) else 0)
            while cut <= at:  # one word is longer than a piece: look further for its end
                more = min(n, to + _PIECE)
                gaps = np.flatnonzero(SPACE[buf[to:more]])
                later = offs[(offs > at) & (offs <= more)]
                ends = [to + int(gaps[0]) + 1] if len(gaps) else []
                ends += [int(later[0])] if len(later) else []
                ends += [n] if more == n else []
                cut, to = (min(ends) if ends else at), more
            to = cut
        yield at, to
        at = to


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of words in byte positions; ``first`` are word offsets per document."""
    solid = ~SPACE[buf]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(buf))]
    starts[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and word offsets per document."""
    s, e, first = word_spans(buf, offs)
    out = np.empty(len(s), dtype=U64)
    table = (LOWER if lower else SAME).astype(U64) + U64(1)
    for at, to in _pieces(buf, offs):
        lo, hi = np.searchsorted(s, (at, to))
        if lo == hi:
            continue
        p, q = _power_tables(to - at + 1)
        x = table[buf[at:to]]
        x *= p[: to - at]
        c = np.zeros(to - at + 1, dtype=U64)
        np.cumsum(x, out=c[1:])
        a, b = s[lo:hi] - at, e[lo:hi] - at
        out[lo:hi] = mix((c[b] - c[a]) * q[a] + (b - a).astype(U64))
    fold = LOWER if lower else SAME
    for i in np.flatnonzero(e - s > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(fold[buf[s[i] : e[i]]].tobytes())
    return out, first


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words at every position (the last k-1 are cut off)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(29)
        out += h[i : i + n]
    return mix(out)


def doc_shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of one document's word hashes; fewer
    words than k make one shingle, no words none."""
    if len(h) == 0:
        return np.zeros(0, dtype=U64)
    if len(h) < k:
        return ngrams(h, len(h)) ^ U64(len(h))
    g = ngrams(h, k)
    g.sort()
    keep = np.empty(len(g), dtype=bool)
    keep[0] = True
    np.not_equal(g[1:], g[:-1], out=keep[1:])
    return g[keep]
