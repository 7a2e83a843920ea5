"""The hidden Markov tagger against enumeration of all taggings, on a corpus of known tags, and behind the perturbations."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import perturb as P
from palimpsest.operators import tagging as T


def small_model(seed=0, words=6):
    rng = np.random.default_rng(seed)
    n = len(T.TAGS)
    emit = rng.random((words, n)) * (rng.random((words, n)) < 0.5) + 0.01
    move = rng.random((n, n))
    start = rng.random(n)
    return T.Model([f"w{i}" for i in range(words)], emit / emit.sum(axis=0), move / move.sum(axis=1, keepdims=True), start / start.sum())


def all_paths(m, s):
    for path in itertools.product(range(len(T.TAGS)), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for i in range(1, len(s)):
            p *= m.move[path[i - 1], path[i]] * m.emit[s[i], path[i]]
        yield path, p


def test_viterbi_and_expectations_against_enumeration(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)  # blocks of unequal lengths
    m, rng = small_model(), random.Random(1)
    seqs = [[rng.randrange(6) for _ in range(n)] for n in (1, 2, 3, 4, 4, 1, 3)] + [[]]
    emit, move, start, total = np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start), 0.0
    best = []
    for s in seqs:
        paths = list(all_paths(m, s)) if s else []
        best.append(list(max(paths, key=lambda x: x[1])[0]) if s else [])
        whole = sum(p for _, p in paths)
        total += np.log(whole) if s else 0
        for path, p in paths:
            start[path[0]] += p / whole
            for i, t in enumerate(path):
                emit[s[i], t] += p / whole
                if i:
                    move[path[i - 1], t] += p / whole
    got = T.expected_counts(m, seqs)
    for a, b in zip(got, (emit, move, start, total)):
        assert np.allclose(a, b)
    assert T.viterbi(m, seqs) == best


def test_rounds_raise_the_likelihood():
    m, rng = small_model(3), random.Random(2)
    seqs = [[rng.choice([0, 1, 1, 2, i % 6]) for i in range(rng.randrange(1, 12))] for _ in range(80)]
    last = -np.inf
    for _ in range(6):
        emit, move, start, total = T.expected_counts(m, seqs)
        assert total >= last - 1e-9
        last = total
        m = T.Model(m.words, emit / emit.sum(axis=0), move / move.sum(axis=1, keepdims=True), start / start.sum())


GRAMMAR = {
    "NOUN": "box boxes number garden train value teacher apple river metal window".split(), "ADJ": "big red heavy famous possible useful quick simple".split(),
    "VERB": "holds sells multiplied counted moving takes gives adding".split(), "ADV": "slowly quickly nearly exactly".split(), "PROPN": "Alice Bob Carla Dave".split(),
}


def sentence(rng):
    """A sentence of a small grammar and its tags; nouns, verbs and adjectives mostly have no telling ending."""
    noun = lambda: [(rng.choice(["the", "a", "every"]), "OTHER")] + [(rng.choice(GRAMMAR["ADJ"]), "ADJ")] * (rng.random() < 0.5) + [(rng.choice(GRAMMAR["NOUN"]), "NOUN")]
    who = [(rng.choice(GRAMMAR["PROPN"]), "PROPN")] if rng.random() < 0.3 else noun()
    out = [("then", "OTHER")] * (rng.random() < 0.5) + who + [(rng.choice(GRAMMAR["VERB"]), "VERB")] + [(str(rng.randrange(99)), "NUM")] * (rng.random() < 0.3) + noun()
    out += [(rng.choice(GRAMMAR["ADV"]), "ADV")] * (rng.random() < 0.4) + [(".", "PUNCT")]
    return out


def test_learned_tags_against_known_ones(spark):
    rng = random.Random(5)
    texts, tags = [], []
    for _ in range(600):
        s = [x for _ in range(3) for x in sentence(rng)]
        texts.append(" ".join(w for w, _ in s))
        tags.append([t for _, t in s])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, text string").repartition(3)
    model = T.learn(df, rounds=8)
    got = {r.i: r for r in T.with_tags(df, "text", model).select("i", L.tokens(F.col("text")).alias("t"), "tags").collect()}
    pairs = [(a, b) for i, want in enumerate(tags) for a, b in zip([g for g in got[i].tags if g != "SPACE"], want)]
    assert all(len(got[i].t) == len(got[i].tags) for i in range(len(texts)))
    right = sum(a == b for a, b in pairs) / len(pairs)
    assert right > 0.8, right
    assert got[len(texts)].tags is None and got[len(texts) + 1].tags == []
    shares = {r.tag: r for r in T.tag_shares(T.with_tags(df, "text", model)).collect()}
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9 and sum(r.n for r in shares.values()) == len(pairs)


def test_bounds_of_the_model(spark):
    df = spark.createDataFrame([(f"word{i} other thing number{i % 7} .",) for i in range(300)], "text string")
    model = T.learn(df, vocabulary=5, most=50, rounds=1)
    assert len([w for w in model.words if "~" not in w]) <= 7 and np.allclose(model.move.sum(axis=1), 1) and np.allclose(model.emit.sum(axis=0)[model.emit.any(axis=0)], 1)
    nothing = T.learn(df.where("false"))
    assert T.with_tags(df.limit(1), "text", nothing).first().tags[-1] == "PUNCT"


def test_perturbations_by_tags(spark):
    texts = ["Find the 3 big red boxes such that $x$ is large. Alice sells a heavy apple slowly!", "", "a b", "One $y$."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tagged = T.with_tags(df, "t", T.learn(df, "t"))
    out = tagged.select("t", "tags", L.not_not("t", tags="tags").alias("n"), L.opposites("t", tags="tags").alias("o"), L.wrappers("t", tags="tags").alias("w"))
    out = out.select("*", P.undo_not_not("n").alias("a"), L.undo_opposites("o").alias("b"), L.undo_wrappers("w").alias("c")).collect()
    for r in out:
        assert r.a == r.t and r.b == r.t and r.c.split() == r.t.split()
        n = sum(g in ("ADJ", "NUM") for g in r.tags)
        assert ("not not " in r.n) == ("ADJ" in r.tags or n > 1) and "not not such" not in r.n and "not not $" not in r.n
        assert ("defyn{" in r.o) == any(g in ("ADJ", "VERB") for g in r.tags)
    # given tags decide: the same text with other tags
    own = spark.createDataFrame([("big box", ["ADJ", "SPACE", "NOUN"]), ("big box", ["NOUN", "SPACE", "ADJ"])], "t string, tags array<string>")
    assert [r.x for r in own.select(L.not_not("t", tags="tags").alias("x")).collect()] == ["not not big box", "big not not box"]


def test_a_task_holds_few_tokens_at_a_time(spark, monkeypatch):
    """Texts of one batch are tagged and learned from in slices; nulls, empty and long texts stay whole."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from palimpsest.functions.lexicon import tokens
    from palimpsest.operators import tagging

    column = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"], ["d"] * 2])
    nested = pa.array([[["a"] * 2, ["b"]], [], [["c"] * 9], [["d"], ["e"]]])
    monkeypatch.setattr(tagging, "TOKENS", 4)
    assert [len(p) for p in tagging.slices(column)] == [3, 1, 2] and [len(p) for p in tagging.slices(column.slice(1))] == [2, 1, 2]
    assert [len(p) for p in tagging.slices(nested)] == [2, 1, 1] and list(tagging.slices(column.slice(6))) == []
    assert pa.concat_arrays(list(tagging.slices(column))) == column and pa.concat_arrays(list(tagging.slices(nested))) == nested
    monkeypatch.setattr(tagging, "TOKENS", 1 << 18)
    texts = [(i, t) for i, t in enumerate(["The red box is here. Bob runs quickly!", None, "", "Carla sees 3 boxes; they are large."] * 5)]
    df = spark.createDataFrame(texts, "k int, text string").coalesce(1)
    model = tagging.learn(df)
    rows = lambda: [(r.k, r.tags) for r in tagging.with_tags(df, "text", model).select("k", "tags").orderBy("k").collect()]
    whole = rows()
    sizes = {r.k: r.n for r in df.select("k", F.size(tokens(F.col("text"))).alias("n"), F.col("text").isNull().alias("none")).where("not none").collect()}
    assert all((tags is None) == (t is None) and (tags is None or len(tags) == sizes[k]) for (k, tags), (_, t) in zip(whole, texts))
    monkeypatch.setattr(tagging, "TOKENS", 3)
    assert rows() == whole
