"""Byte-pair tokens against a merge by definition, against a public library, and around texts of every kind."""

import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import prompt as B
from palimpsest.functions import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.RANKS).exists(), reason="no vocabulary")
TEXTS = ["", " ", "Find  the 3 values\n\n of $x^2$; it's \\boxed{12345}.", "naïve café — 数学 русский 🙂🙂", "a" * 3000, "ab" * 999 + " " * 50 + "end", "\t\r\n x y", "1234567890" * 30, "don't we'll THEY'RE"]


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(T.RANKS) if line.strip())}


@pytest.fixture(scope="module")
def vocabulary(spark):
    return T.Vocabulary(spark)


def plain_merge(piece, ranks):
    """Merge the leftmost pair of least rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def plain_tokens(text, ranks):
    import regex

    return [t for m in regex.finditer(T.PATTERN, text) for t in plain_merge(m[0].encode(), ranks)]


def test_merges_against_the_definition(ranks):
    rng = random.Random(0)
    small = {bytes([b]): b for b in range(256)} | {x.encode(): 256 + i for i, x in enumerate(["aa", "ab", "aab", "aaaa", "bb", "bab", "abab"])}
    for _ in range(400):
        piece = "".join(rng.choice("aab") for _ in range(rng.randrange(1, 40))).encode()
        assert T.merged(piece, small) in (plain_merge(piece, small), [piece])
        if piece not in small:
            assert T.merged(piece, small) == plain_merge(piece, small)
    for t in TEXTS:
        e = T.Encoder(ranks, T.PATTERN)
        assert list(e.tokens(t)) == plain_tokens(t, ranks) and e.decode(e.ids(t)) == t


def test_ids_against_a_library(spark, ranks, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    peer = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [*TEXTS, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), 10, 32])) for _ in range(rng.randrange(200))) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r for r in df.select("i", T.token_ids("t", vocabulary).alias("ids"), T.exact_token_count("t", vocabulary).alias("n"), T.token_text(T.token_ids("t", vocabulary), vocabulary).alias("back")).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == peer.encode_ordinary(t) and got[i].n == len(got[i].ids) and got[i].back == t
    assert got[len(texts)].ids is None and got[len(texts)].n is None


def test_places_against_spans(spark, ranks, vocabulary):
    rng = random.Random(2)
    rows = []
    for t in TEXTS:
        spans, end = [], 0
        for x in plain_tokens(t, ranks):
            spans.append((end, end + len(x)))
            end += len(x)
        for _ in range(12):
            c = rng.randrange(len(t) + 3)
            at = len(t[:c].encode())
            rows.append((t, [c, 0], [next((i for i, (_, z) in enumerate(spans) if z > at), len(spans)), 0]))
    df = spark.createDataFrame(rows, "t string, c array<int>, want array<int>")
    for r in df.select("t", "c", "want", T.char_to_token("t", "c", vocabulary).alias("x")).collect():
        assert r.x == r.want, (r.t[:40], r.c)


def test_bodies_and_prompts(spark, ranks, vocabulary):
    source = "The long march of the 3 armies went on through naïve lands, day after day. " * 5
    rows = [(i, f"What is {i} + {i}?", source if i % 3 else "word", 60 + 37 * i, str(i)) for i in range(12)] + [(99, "x", " \n", 200, "s"), (98, None, source, 200, "s")]
    df = spark.createDataFrame(rows, "i int, target string, source string, wanted int, seed string")
    got = df.select("*", T.matched_prompt("target", "source", "wanted", "seed", vocabulary).alias("m"), T.tokens_body("source", "wanted", "seed", vocabulary).alias("body")).collect()
    for r in got:
        if r.target is None:
            assert r.m.prompt is None
            continue
        assert r.m.context_tokens == len(plain_tokens(r.m.prompt, ranks)) and r.target in r.m.prompt and B.SYSTEM_PROMPT in r.m.prompt and 1 <= r.m.rounds <= 4
        if r.i < 90:
            skeleton = len(plain_tokens(r.m.prompt, ranks)) - r.m.body_tokens
            assert abs(r.m.context_tokens - r.wanted) <= 2 or r.m.rounds == 4 or skeleton > r.wanted
            assert set(r.body.split()) <= set(source.split()) | {"word"} | {r.body.split()[-1]} and abs(len(plain_tokens(r.body, ranks)) - r.wanted) <= 2
        else:
            assert r.body == ""


def test_a_vocabulary_must_be_whole(spark, tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        T.Vocabulary(spark, str(tmp_path / "few"))


def test_places_look_into_few_pieces():
    """Only pieces that hold a place are walked token by token; the places are those of all tokens one by one."""
    from palimpsest.functions import tokens as T

    class Walked(list):
        walks = 0

        def __iter__(self):
            Walked.walks += 1
            return super().__iter__()

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": 257}
    encoder = T.Encoder(ranks, T.PATTERN)
    text = "abab é \U0001f600 abc 12,  ab\n" * 50
    ends, end = [], 0
    for t in encoder.tokens(text):
        end += len(t)
        ends.append(end)
    chars = [-1, 0, 1, 5, 6, 7, 8, 9, 20, 700, 3, 3, len(text) - 1, len(text), len(text) + 5]
    plain = [next((i for i, e in enumerate(ends) if e > len(text[: max(0, c)].encode())), len(ends)) for c in chars]
    encoder.known = {k: (Walked(own), size) for k, (own, size) in encoder.known.items()}
    assert encoder.places(text, chars) == plain and encoder.count(text) == len(ends) and Walked.walks <= len(chars)
    assert encoder.places(text, []) == [] and encoder.places("", [0, 3]) == [0, 0]
