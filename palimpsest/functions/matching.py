"""Pairs of long texts, for Arrow batches: edits in time of length plus edits squared, difflib's blocks in about linear time."""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _packed(codes: np.ndarray, bits: int, end: int) -> np.ndarray:
    """At each place the characters from there on, as many as 64 bits hold; ``end`` stands behind the last."""
    n = 64 // bits
    filled = np.append(codes, [end] * n).astype(np.uint64)
    out = np.zeros(len(codes) + 1, np.uint64)
    for i in range(n):
        out |= filled[i : i + len(out)] << np.uint64(bits * i)
    return out


def _without_common_start(x: np.ndarray, y: np.ndarray):
    """Both backwards, without the start that they share."""
    n = min(len(x), len(y))
    unlike = x[:n] != y[:n]
    start = int(np.argmax(unlike)) if unlike.any() else n
    return x[start:][::-1], y[start:][::-1]


def edits(a: str, b: str) -> int:
    """Edits between two texts, a column of the table of distances as the bits of two numbers (Myers, Hyyrö)."""
    if not a or not b:
        return len(a) + len(b)
    places, top, whole = {}, len(a) - 1, (1 << len(a)) - 1
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, found = whole, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(across | up)), up & across
        found += (more >> top & 1) - (less >> top & 1)
        more, less, same = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(same | more)) & whole, more & same & whole
    return found


def edits_within(a: str, b: str, most: int) -> int:
    """Edits between two texts, -1 if over ``most``: on each diagonal the furthest place that so many edits reach, for
    1, 2, ... edits (Ukkonen's way; only diagonals from which the end is still in reach)."""
    if abs(len(a) - len(b)) > most:
        return -1
    x, y = _without_common_start(*_without_common_start(_codes(a), _codes(b)))
    n, m = len(x), len(y)
    if n == 0 or m == 0:
        return n + m
    kinds, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    bits = int(len(kinds) + 1).bit_length()
    x, y, step = _packed(codes[:n] + 2, bits, 0), _packed(codes[n:] + 2, bits, 1), 64 // bits

    def along(i, j):
        length = 64
        while True:
            unlike = codes[i : min(i + length, n)][: m - j] != codes[n + j : n + j + length][: n - i]
            if unlike.any():
                return i + int(np.argmax(unlike))
            if len(unlike) < length:
                return i + len(unlike)
            i, j, length = i + length, j + length, 2 * length

    def slid(at, diagonals):
        going = np.arange(len(at))
        while len(going):
            if len(going) < 3:  # few diagonals go on for long
                at[going] = [along(int(at[g]), int(at[g] + diagonals[g])) for g in going]
                break
            unlike = x[at[going]] ^ y[at[going] + diagonals[going]]
            same = unlike == 0
            stops, lowest = going[~same], unlike[~same]
            at[stops] += (np.frexp((lowest & (~lowest + np.uint64(1))).astype(np.float64))[1] - 1) // bits
            going = going[same]
            at[going] += step
        return at

    first, at = 0, slid(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for edits in range(most + 1):
        if first <= m - n < first + len(at) and at[m - n - first] == n:
            return edits
        if edits == most:
            break
        low, high = max(-edits - 1, m - n - (most - edits - 1)), min(edits + 1, m - n + (most - edits - 1))
        if low > high:
            break
        diagonals = np.arange(low, high + 1)
        last = np.full(len(diagonals) + 2, -2)  # of the diagonals from low - 1 to high + 1
        own = slice(max(first, low - 1) - first, max(min(first + len(at), high + 2) - first, 0))
        begin = max(first, low - 1) - (low - 1)
        last[begin : begin + len(at[own])] = at[own]
        reached = np.maximum(np.maximum(last[1:-1] + 1, last[2:] + 1), last[:-2])
        first, at = low, slid(np.minimum(reached, np.minimum(n, m - diagonals)), diagonals)
    return -1


class Matcher(difflib.SequenceMatcher):
    """difflib's matcher without junk, with the same blocks.  A block grows from the longest run of characters that
    difflib indexes (long texts' frequent ones it doesn't), the first of them in either text.  Ranges over SMALL are
    decided together for each length of runs: what lies before a block holds shorter ones only, what lies
    behind it is searched on, so a place is looked at once a length.  In smaller ranges only indexed places are."""

    SMALL = 1 << 17

    def __init__(self, a: str, b: str):
        super().__init__(None, a, b)
        self.places = [i for i, c in enumerate(a) if c in self.b2j]
        self.known = {}

    def get_matching_blocks(self):
        if self.matching_blocks is None and len(self.a) * len(self.b) > self.SMALL:
            self._decide()
        return super().get_matching_blocks()

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        a, b2j, places = self.a, self.b2j, self.places
        ahi, bhi = len(a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if (alo, ahi, blo, bhi) in self.known:
            return self.known[alo, ahi, blo, bhi]
        i, j, size, before, lengths = alo, blo, 0, -2, {}
        for at in places[bisect_left(places, alo) : bisect_left(places, ahi)]:
            last, lengths = lengths if at == before + 1 else {}, {}
            before, own = at, b2j[a[at]]
            for to in own[bisect_left(own, blo) : bisect_left(own, bhi)]:
                k = lengths[to] = last.get(to - 1, 0) + 1
                if k > size:
                    i, j, size = at - k + 1, to - k + 1, k
        return self._grown(i, j, size, alo, ahi, blo, bhi)

    def _grown(self, i, j, size, alo, ahi, blo, bhi):
        a, b = self.a, self.b
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        return difflib.Match(i, j, size)

    def _ranks(self):
        """For both texts, at each place, a number for the 1, 2, 4, ... indexed characters from there on, -1 where
        not all are indexed or the other text doesn't have them; as far as texts have such runs in common."""
        indexed = np.array(sorted(map(ord, self.b2j)), np.int64)
        out = [[np.where(np.isin(c, indexed), c, -1) for c in map(_codes, (self.a, self.b))]]
        while (n := 2 << len(out) - 1) <= min(len(self.a), len(self.b)):
            runs = [self._runs(out, t, n, 0, len(s), len(out) - 1) for t, s in enumerate((self.a, self.b))]
            common = np.intersect1d(runs[0][1], runs[1][1])
            if not len(common):
                break
            new = [np.full(len(s), -1, np.int64) for s in (self.a, self.b)]
            for ranks, (at, keys) in zip(new, runs):
                number = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                ranks[at] = np.where(common[number] == keys, number, -1)
            out.append(new)
        return out

    @staticmethod
    def _runs(ranks, text, n, lo, hi, level):
        """The places in lo..hi of a text where ``n`` indexed characters begin and end, and a number that says which."""
        r, back = ranks[level][text], n - (1 << level)
        first, last = r[lo : hi - n + 1], r[lo + back : hi - n + 1 + back]
        at = np.flatnonzero((first >= 0) & (last >= 0))
        return at + lo, first[at] << 32 | last[at]

    def _decide(self):
        ranks = self._ranks()
        todo = [(0, len(self.a), 0, len(self.b), (1 << len(ranks)) - 1)]
        while todo:
            alo, ahi, blo, bhi, most = todo.pop()
            if min(ahi - alo, bhi - blo) <= 0 or (ahi - alo) * (bhi - blo) <= self.SMALL:
                continue
            runs = lambda n: (self._runs(ranks, 0, n, alo, ahi, n.bit_length() - 1), self._runs(ranks, 1, n, blo, bhi, n.bit_length() - 1))  # noqa: B023, E731
            n, over = 0, min(most, ahi - alo, bhi - blo) + 1
            while over - n > 1:
                middle = (n + over) // 2
                (_, here), (_, there) = runs(middle)
                n, over = (middle, over) if np.isin(here, there).any() else (n, middle)
            if n == 0:
                self.known[alo, ahi, blo, bhi] = block = self._grown(alo, blo, 0, alo, ahi, blo, bhi)
                if block.size:
                    todo.append((alo + block.size, ahi, blo + block.size, bhi, 0))
                continue
            (at, here), (to, there) = runs(n)
            order = np.argsort(there, kind="stable")
            to, there = to[order].tolist(), there[order]
            lows, highs = np.searchsorted(there, here, "left"), np.searchsorted(there, here, "right")
            both = lows < highs
            for i, low, high in zip(at[both].tolist(), lows[both].tolist(), highs[both].tolist()):
                if i >= alo and (low := bisect_left(to, blo, low, high)) < high:
                    self.known[alo, ahi, blo, bhi] = block = self._grown(i, to[low], n, alo, ahi, blo, bhi)
                    todo.append((alo, block.a, blo, block.b, n - 1))
                    alo, blo = block.a + block.size, block.b + block.size
            todo.append((alo, ahi, blo, bhi, n - 1))
