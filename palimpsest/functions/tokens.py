"""Byte-pair tokens of a public vocabulary (B14, B06, X13): counts, offsets, and bodies cut by tokens.

A text is split by a pattern and each piece merged greedily by rank.  Most pieces of a corpus
are few words again and again, so a worker keeps the merged pieces it has met; nothing is
shuffled.  The ranks (some 50,000 short byte strings) are read by Spark and broadcast; MOST
bounds their number.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .core import col
from .prompt import messages, passive_prompt, render_messages

#: A public rank file: a line a token, its bytes in base64 and its rank.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges of such a file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a vocabulary at most; pieces a worker remembers.
MOST, MEMORY = 1 << 20, 1 << 17
#: Rounds of correction at most, and tokens by which a prompt may miss its length.
ROUNDS, TOLERANCE = 4, 2
_HOLE = "\x00"


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: of all neighbours the pair of least rank merges first, the leftmost of
    equals.  O(n log n): a heap of pairs, those that a merge has undone are passed over."""
    if piece in ranks:
        return [piece]
    n = len(piece)
    end, back = [*range(1, n + 1), 0], list(range(-1, n))  # of the part that starts at i: its end, the part before
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not i < mid < stop or end[mid] != stop:
            continue
        end[i], end[mid], back[stop] = stop, 0, i
        for a, b in ((back[i], stop), (i, end[stop] if stop < n else 0)):
            if a >= 0 and b and piece[a:b] in ranks:
                heapq.heappush(heap, (ranks[piece[a:b]], a, b))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class Encoder:
    """Text to tokens and back; made once a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), {}
        self.spelled = {v: k for k, v in ranks.items()}

    def pieces(self, text: str) -> Iterator[tuple[list[bytes], int]]:
        """The tokens of each piece of a text, and their bytes."""
        known = self.known
        for piece in self.pattern.findall(text):
            found = known.get(piece)
            if found is None:
                own = merged(piece.encode("utf-8", "replace"), self.ranks)
                found = own, sum(map(len, own))
                if len(piece) < 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = found
            yield found

    def tokens(self, text: str) -> Iterator[bytes]:
        for own, _ in self.pieces(text):
            yield from own

    def ids(self, text: str) -> list[int]:
        return [self.ranks[t] for t in self.tokens(text)]

    def count(self, text: str) -> int:
        return sum(len(own) for own, _ in self.pieces(text))

    def decode(self, ids) -> str:
        return b"".join(self.spelled[int(i)] for i in ids).decode("utf-8", "replace")

    def places(self, text: str, chars: list[int]) -> list[int]:
        """For each character place the first token that ends behind it, or the number of tokens."""
        wanted = sorted((len(text[: max(0, c)].encode("utf-8", "replace")), k) for k, c in enumerate(chars))
        out, end, n, at = [0] * len(chars), 0, 0, 0
        next_ = wanted[0][0] if wanted else float("inf")
        for own, size in self.pieces(text):
            if next_ >= end + size:  # no place within this piece
                end += size
                n += len(own)
                continue
            for t in own:
                end += len(t)
                while at < len(wanted) and wanted[at][0] < end:
                    out[wanted[at][1]] = n
                    at += 1
                n += 1
            next_ = wanted[at][0] if at < len(wanted) else float("inf")
        for _, k in wanted[at:]:
            out[k] = n
        return out

    def body(self, source: str, n: int, seed: str) -> str:
        """The source's words from a seeded place on, repeated, cut to n tokens."""
        words = source.split()
        if n <= 0 or not words:
            return ""
        at = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) % len(words)
        turned = " ".join(words[at:] + words[:at])
        times = n // len(words) + 4
        ids = []
        for t in self.tokens(((turned + "\n\n") * times).strip()):
            ids.append(self.ranks[t])
            if len(ids) == n:
                break
        while len(ids) < n:  # words that share tokens: begin again
            ids += ids[: n - len(ids)]
        return self.decode(ids).strip()

    def fitted(self, template: str, source: str, wanted: int, seed: str) -> tuple[str, int, int, int]:
        """(prompt, tokens of the body, of the prompt, rounds): the body is made anew, longer or
        shorter by what the prompt lacks, until it is within TOLERANCE of the wanted length."""
        before, after = template.split(_HOLE, 1)
        aim = max(1, wanted - self.count(before + after))
        for k in range(1, ROUNDS + 1):
            body = self.body(source, aim, seed)
            prompt = before + body + after
            got = self.count(prompt)
            if abs(wanted - got) <= TOLERANCE or k == ROUNDS:
                return prompt, self.count(body), got, k
            aim = max(1, aim + wanted - got)


_encoders: dict[str, Encoder] = {}


class Vocabulary:
    """Ranks that every executor has a copy of."""

    def __init__(self, spark: SparkSession, path: str = RANKS, pattern: str = PATTERN):
        rows = spark.read.text(path).where("value <> ''").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"{path} holds over {MOST} tokens: not to be broadcast")
        ranks = {base64.b64decode(token): int(rank) for token, rank in (r.value.split() for r in rows)}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{path} lacks the bytes {missing}")
        self.name, self.pattern, self.shared = uuid.uuid4().hex, pattern, spark.sparkContext.broadcast(ranks)

    def encoder(self) -> Encoder:
        if self.name not in _encoders:
            _encoders.clear()
            _encoders[self.name] = Encoder(self.shared.value, self.pattern)
        return _encoders[self.name]


def _udf(vocabulary: Vocabulary, kind: str, one):
    """A pandas UDF of one(encoder, values of a row...), null where a value is."""
    names = [f.split()[0] for f in kind[7:-1].split(", ")] if kind.startswith("struct") else []

    def values(columns) -> list:
        encoder = vocabulary.encoder()
        return [None if any(pd.api.types.is_scalar(x) and pd.isna(x) for x in row) else one(encoder, *row) for row in zip(*columns)]

    def series(*columns: pd.Series) -> pd.Series:
        return pd.Series(values(columns), dtype=object)

    def frame(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([v or (None,) * len(names) for v in values(columns)], columns=names, dtype=object)

    return F.pandas_udf(frame if names else series, kind)


def token_ids(text, vocabulary: Vocabulary) -> Column:
    """array<int> of token ids; null for null."""
    return _udf(vocabulary, "array<int>", lambda e, t: e.ids(t))(col(text))


def token_text(ids, vocabulary: Vocabulary) -> Column:
    """The text that token ids spell."""
    return _udf(vocabulary, "string", lambda e, x: e.decode(x))(col(ids))


def exact_token_count(text, vocabulary: Vocabulary) -> Column:
    """Number of tokens; null for null."""
    return _udf(vocabulary, "int", lambda e, t: e.count(t))(col(text))


def char_to_token(text, places, vocabulary: Vocabulary) -> Column:
    """array<int>: for each 0-based character place the first token that ends behind it, or the
    number of tokens where none does."""
    return _udf(vocabulary, "array<int>", lambda e, t, x: e.places(t, list(x)))(col(text), col(places))


def tokens_body(source, n, seed, vocabulary: Vocabulary) -> Column:
    """B05 by tokens: words of a source from a seeded place on, repeated and cut to n tokens."""
    return _udf(vocabulary, "string", lambda e, s, n, seed: e.body(s, int(n), seed))(col(source), col(n), col(seed))


def matched_prompt(target, source, wanted, seed, vocabulary: Vocabulary) -> Column:
    """struct<prompt, body_tokens, context_tokens, rounds>: a passive prompt of about ``wanted``
    tokens with its system prompt, in at most four rounds; the last round counts if none fits."""
    template = F.when(col(target).isNotNull(), render_messages(messages(passive_prompt(col(target), F.lit(_HOLE)))))
    kind = "struct<prompt string, body_tokens int, context_tokens int, rounds int>"
    return _udf(vocabulary, kind, lambda e, t, s, n, seed: e.fitted(t, s, int(n), seed))(template, col(source), col(wanted), col(seed))
