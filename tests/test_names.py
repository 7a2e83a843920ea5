"""Learned names and their mentions against a naive matcher."""

import re
from collections import Counter

from palimpsest.functions.lexicon import OPENERS
from palimpsest.operators import names as N

TEXTS = [
    "Suppose Alice meets Bob in Paris. Then Alice Smith gives Bob 3 apples, and Carla leaves.", "The red box is here. Box $Alice$ and a box for Bob.", "Let Carla be there; so Carla wins. Then Dave waits.",
    "When Mary Ann Smith came, Mary Ann left. We saw Mary, Ann and Smith.", "Hope is a word, and hope too; but Hope came with Hope.", "", None, "so Alice, with Alice and Bob (by Bob) went", "Find Paris. we like Paris and Paris",
]


def naive(texts, least=2, share=0.9):
    inside, plain = Counter(), Counter()
    for t in texts:
        t = re.sub(r"\$[^$]+\$", " ", t or "")
        inside.update(re.findall(r"[a-z0-9,;:)] ([A-Z][a-z]+)", t))
        plain.update(w[0].upper() + w[1:] for w in re.findall(r"\b([a-z]+)\b", t))
    table = {w: (n, plain[w]) for w, n in inside.items() if n >= least and n >= share * (n + plain[w])}
    found = {}
    for k, t in enumerate(texts):
        for run in re.findall(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})\b", re.sub(r"\$[^$]+\$", " ", t or "")):
            words = run.split(" ")
            words = words[1:] if words[0] in OPENERS else words
            if words and all(w in table for w in words):
                found.setdefault(k, set()).add(" ".join(words))
    return table, {k: sorted(v) for k, v in found.items()}


def test_against_a_naive_matcher(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "k int, text string, name string").repartition(3)
    table, found = naive(TEXTS)
    names = N.learn_names(df)
    assert {r.name: (r.inside, r.plain) for r in names.collect()} == table and {"Alice", "Bob", "Carla", "Paris"} <= set(table) and "Hope" not in table
    assert {r.k: r.names for r in N.name_mentions(df, names, "k").collect()} == found
    assert N.name_mentions(df, names.where("false"), "k").count() == 0 and N.learn_names(df.where("false")).count() == 0
