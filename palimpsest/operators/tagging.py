"""A part-of-speech tagger behind T01-T03: a hidden Markov model learned from untagged text.

Expectation and maximisation alternate: tasks sum expected counts by forward and backward
passes over their sentences, one row a word and task is shuffled, and the driver holds the
model, whose size VOCABULARY and ENDINGS bound.  What a tag means comes from a prior: closed
classes, endings and spelling.  Tags are decoded by Viterbi's algorithm.  Both passes run over
many sentences at a time, position by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..functions.lexicon import FUNCTION_WORDS, NUMBERS, tokens
from ..sources.scratch import keep

#: Hidden tags of words; signs and math blocks are seen, and are tags of their own.
TAGS = ("ADJ", "ADV", "NUM", "VERB", "NOUN", "PROPN", "OTHER", "PUNCT", "MATH")
_ID = {t: i for i, t in enumerate(TAGS)}
#: Words that the model knows by themselves, endings that stand for the others, texts learned from.
VOCABULARY, ENDINGS, TEXTS = 20_000, 5_000, 200_000
#: Weight of the prior in counts, rounds, sentences at a time, tokens of a sentence at most (what runs on without a stop is cut there).
PRIOR, ROUNDS, BLOCK, LONGEST = 5.0, 4, 512, 200
#: Tokens that a task turns into Python objects at a time (whole texts, one at least).
TOKENS = 1 << 18
_STOPS = {".", "!", "?", ";"}
_ENDS = (("ADV", ("ly",)), ("ADJ", ("ous", "ful", "able", "ible", "ive", "less", "ical", "al", "ic")), ("VERB", ("ize", "ify", "ate", "ing", "ed")), ("NOUN", ("tion", "ment", "ness", "ity", "ance", "ence", "er", "or")))


def symbol(token: str, first: bool) -> str:
    """What the model sees of a token: signs and math as kinds, words in lower case, with a mark for a
    capital inside a sentence."""
    if token[0] in "$\\" and len(token) > 1 or token.startswith("[asy]"):
        return "<math>"
    if not token[0].isalnum() and token[0] != "_":
        return token
    return ("^" if token[0].isupper() and not first else "") + token.lower()


def ending(word: str) -> str:
    """The class of a rare word: its spelling and last three letters."""
    bare = word.lstrip("^")
    kind = "9" if bare[:1].isdigit() else "^" if word[0] == "^" else "a"
    return f"{kind}~{bare[-3:]}"


def rest(word: str) -> str:
    """The class of a word with a rare ending."""
    return ending(word)[:2]


def prior(word: str) -> np.ndarray:
    """Shares of the tags that a word, or a class of words, is taken to have at first.  What has none
    here never gets it: closed classes and signs have one tag, other words none of theirs."""
    out = np.zeros(len(TAGS))
    bare = word.lstrip("^").split("~")[-1]
    if word == "<math>":
        out[_ID["MATH"]] = 1
    elif not word[:1].isalnum() and word[:1] not in "^_":
        out[_ID["PUNCT"]] = 1
    elif word[:1] == "9" or bare[:1].isdigit() or bare in NUMBERS:
        out[_ID["NUM"]] = 1
    elif bare in FUNCTION_WORDS:
        out[_ID["OTHER"]] = 1
    else:
        for tag, share in (("ADJ", 0.15), ("ADV", 0.05), ("VERB", 0.2), ("NOUN", 0.5), ("PROPN", 3.0 * (word[0] == "^"))):
            out[_ID[tag]] = share
        for tag, ends in _ENDS:
            out[_ID[tag]] += 2.0 * any(bare.endswith(e) and (len(bare) > len(e) + 1 or "~" in word) for e in ends)
    return out / out.sum()


class Model:
    """Shares of words (rows) by tag, of tags by the tag before, and of first tags."""

    def __init__(self, words: list[str], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.words, self.emit, self.move, self.start = words, emit, move, start

    def known(self, word: str) -> int:
        at = self.index
        if not word[0].isalnum() and word[0] not in "^_":
            return at.get(word, at["<sign>"])
        i = at.get(word, at.get(ending(word)))
        return at[rest(word)] if i is None else i


def model_of(words: list[str], emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> Model:
    """The model of (expected) counts; a tag that no word has keeps no share."""
    return Model(words, emit / np.maximum(emit.sum(axis=0), 1e-300), move / move.sum(axis=1, keepdims=True), start / start.sum())


def new_model(words: list[str]) -> Model:
    """The prior alone."""
    n = len(TAGS)
    return model_of(words, np.array([prior(w) for w in words]), np.ones((n, n)), np.ones(n))


def sentences(tags_of: list[str]) -> list[list[int]]:
    """Places of the tokens of each sentence; white space is in none."""
    out, own = [], []
    for i, t in enumerate(tags_of):
        if t.isspace():
            continue
        own.append(i)
        if t in _STOPS or len(own) == LONGEST:
            out.append(own)
            own = []
    return out + [own] * bool(own)


def _padded(seqs: list[list[int]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Blocks of sequences of like length: their numbers, lengths and words, filled up with -1."""
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    for at in range(0, len(order), BLOCK):
        own = order[at : at + BLOCK]
        size = np.array([len(seqs[i]) for i in own])
        x = np.full((len(own), size.max()), -1)
        for r, i in enumerate(own):
            x[r, : size[r]] = seqs[i]
        yield own, size, x


def expected_counts(model: Model, seqs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected (word by tag, tag by tag, first tag) counts of sequences of word numbers, and the log
    likelihood: forward and backward passes, scaled position by position."""
    emit, move, start, total = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.start), 0.0
    for _, size, x in _padded([s for s in seqs if s]):
        b = model.emit[x]  # of filled-up places nothing counts
        n, length = x.shape
        forward, scale = np.zeros((length, n, len(TAGS))), np.ones((length, n))
        for t in range(length):
            f = (model.start if t == 0 else forward[t - 1] @ model.move) * b[:, t]
            on = t < size
            s = np.where(on, f.sum(axis=1), 1.0)
            forward[t], scale[t] = np.where(on[:, None], f / s[:, None], forward[t - 1] if t else 0), s
        back = np.ones((n, len(TAGS)))
        for t in range(length - 1, -1, -1):
            on = (t < size)[:, None]
            g = forward[t] * back * on
            np.add.at(emit, x[:, t], np.where(on, g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300), 0))
            if t == 0:
                start += (g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
                break
            ahead = b[:, t] * back / scale[t][:, None] * on
            move += model.move * (forward[t - 1].T @ ahead)
            back = np.where(on, ahead @ model.move.T, 1.0)
        total += float(np.log(scale).sum())
    return emit, move, start, total


def viterbi(model: Model, seqs: list[list[int]]) -> list[list[int]]:
    """The likeliest tags of each sequence; of equals the first tag."""
    out: list[list[int]] = [[] for _ in seqs]
    with np.errstate(divide="ignore"):
        emit, move, start = np.log(model.emit), np.log(model.move), np.log(model.start)
    some = [i for i, s in enumerate(seqs) if s]
    for own, size, x in _padded([seqs[i] for i in some]):
        b = emit[x]
        score, came = start + b[:, 0], []
        for t in range(1, x.shape[1]):
            ways = score[:, :, None] + move
            came.append(ways.argmax(axis=1))
            score = np.where((t < size)[:, None], ways.max(axis=1) + b[:, t], score)
        for r, i in enumerate(own):
            path = [int(score[r].argmax())]
            for t in range(size[r] - 1, 0, -1):
                path.append(int(came[t - 1][r, path[-1]]))
            out[some[i]] = path[::-1]
    return out


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column of (nested) lists in slices of about TOKENS innermost values, one row at least."""
    ends, inner = column.offsets.to_numpy(), column.values
    while pa.types.is_list(inner.type):
        ends, inner = inner.offsets.to_numpy()[ends], inner.values
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
        yield column.slice(at, to - at)
        at = to


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token arrays -> the symbols of each sentence of a text."""
    for part in (part for batch in batches for part in slices(batch.column(0))):
        found = [[[symbol(text[i], k == 0) for k, i in enumerate(own)] for own in sentences(text or [])] for text in part.to_pylist()]
        yield pa.record_batch([pa.array(found, pa.list_(pa.list_(pa.string())))], names=["sentences"])


def _expect(model: Model):
    """Sentences -> (kind, at, counts): expected counts of a task; kind 0 words, 1 tag pairs, 2 first tags, 3 likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros((1, len(TAGS))), np.zeros((1, len(TAGS)))]
        for part in (part for batch in batches for part in slices(batch.column(0))):
            got = expected_counts(model, [[model.known(w) for w in s] for text in part.to_pylist() for s in text])
            for mine, new in zip(sums, got):
                mine += new
        rows = [(k, i, mine[i].tolist()) for k, mine in enumerate(sums) for i in np.flatnonzero(mine.any(axis=1)).tolist()]
        yield pa.record_batch([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["kind", "at", "counts"])

    return run


def learn(texts: DataFrame, text: str = "text", rounds: int = ROUNDS, vocabulary: int = VOCABULARY, most: int = TEXTS) -> Model:
    """A tagger from the untagged texts of a table.

    Learned from a bounded sample: about ``most`` texts, those whose hash is least (equal texts
    together).  Words by themselves are the ``vocabulary`` most frequent ones, others go by
    spelling and last letters.  Null and empty texts teach nothing; without any the prior is
    the model.
    """
    h = F.xxhash64(text)
    total, least = texts.where(F.col(text).isNotNull()).agg(F.count("*"), F.min(h)).first()
    part = min(1.0, most / max(1, total))
    cut = 2**63 - 1 if part == 1 else max(least, int(-(2**63) + part * (2**64 - 1)))
    chosen = texts.where(h <= F.lit(cut)).select(tokens(F.col(text)).alias("tokens")).repartition(texts.sparkSession.sparkContext.defaultParallelism)
    sample = keep(chosen.mapInArrow(_sentences, "sentences array<array<string>>"), "tagger")
    counts = sample.select(F.explode(F.flatten("sentences")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = [r.word for r in counts.where("n > 1").orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()]
    last = F.concat(F.when(F.col("word").rlike(r"^\^?\d"), "9").when(F.col("word").startswith("^"), "^").otherwise("a"), F.lit("~"), F.expr("right(ltrim('^', word), 3)"))
    ends = counts.where(r"word rlike '^\\^?\\w'").groupBy(last.alias("word")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(ENDINGS)
    model = new_model([*sorted({*words, *(r.word for r in ends.collect())} - {"<math>"}), "9~", "^~", "a~", "<math>", "<sign>"])
    base = np.array([prior(w) for w in model.words])
    for _ in range(rounds):
        summed = sample.mapInArrow(_expect(model), "kind int, at int, counts array<double>").groupBy("kind", "at").agg(F.array(*[F.sum(F.get("counts", i)) for i in range(len(TAGS))]).alias("counts")).collect()
        emit, move, start = PRIOR * base, np.full(model.move.shape, PRIOR), np.full(model.start.shape, PRIOR)
        for r in summed:
            if r.kind == 0:
                emit[r["at"]] += r.counts
            elif r.kind == 1:
                move[r["at"]] += r.counts
            elif r.kind == 2:
                start += r.counts
        model = model_of(model.words, emit, move, start)
    return model


def tag_tokens(tokens_: Column | str, model: Model) -> Column:
    """array<string>: the tag of each token of ``lexicon.tokens``; SPACE for white space; null for null."""

    def tags_of(texts: list) -> pa.Array:
        places, seqs, out = [], [], []
        for text in texts:
            out.append(None if text is None else ["SPACE"] * len(text))
            for own in sentences(text or []):
                places.append((len(out) - 1, own))
                seqs.append([model.known(symbol(text[i], k == 0)) for k, i in enumerate(own)])
        for (row, own), path in zip(places, viterbi(model, seqs)):
            for i, t in zip(own, path):
                out[row][i] = TAGS[t]
        return pa.array(out, pa.list_(pa.string()))

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.string()))] + [tags_of(part.to_pylist()) for part in slices(column)])

    # not deterministic in name only: so the optimizer leaves it out of lambdas, where it can't run
    return F.arrow_udf(run, "array<string>").asNondeterministic()(col(tokens_))


def with_tags(df: DataFrame, text: str, model: Model, name: str = "tags") -> DataFrame:
    """df with the tags of its texts' tokens, for not_not, opposites and wrappers."""
    return df.withColumn(name, tag_tokens(tokens(F.col(text)), model))


def tag_shares(tagged: DataFrame, name: str = "tags") -> DataFrame:
    """(tag, n, share) over all tokens but white space."""
    n = tagged.select(F.explode(name).alias("tag")).where("tag <> 'SPACE'").groupBy("tag").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(whole)).select("tag", "n", (F.col("n") / F.col("_all")).alias("share"))
