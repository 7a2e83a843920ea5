"""Distances and recovery against the definitions, with characters of one to four bytes and texts of any length."""

import difflib
import random

from pyspark.sql import functions as F

from palimpsest.functions import distance as D


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def rate(a, b):
    if max(len(a), len(b)) <= D.MAX_EXACT:
        return edits(a, b) / max(1, len(a))
    return 1 - difflib.SequenceMatcher(None, a, b).ratio()


def status(a, b, x, tagged):
    near = lambda o: o == x or edits(o, x) / max(1, len(o)) <= 0.02
    if not tagged:
        return "missing_recovered_tags"
    if near(a):
        return "recovered"
    if not x:
        return "empty_recovered_text"
    if near(b):
        return "copied_transformed_input"
    if rate(b, x) < rate(a, x):
        return "closer_to_transformed_than_original"
    return "contains_transformation_markers" if any(m in x for m in D.MARKERS) else "partial_or_other"


def damaged(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            t.insert(at, rng.choice("aé数🙂"))
        elif t and kind == 1:
            del t[at % len(t)]
        elif t:
            t[at % len(t)] = rng.choice("aé数🙂")
    return "".join(t)


def test_against_the_definitions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé数🙂 ") for _ in range(rng.randrange(1, 9)))
    rows = []
    for i in range(150):
        a = " ".join(word() for _ in range(rng.choice([0, 1, 5, 20, 40])))
        b = " ".join(reversed(a.split(" ")))
        x = rng.choice([a, "", b, damaged(rng, a, rng.randrange(6)), damaged(rng, b, 2), damaged(rng, a, 60), "GRID START", a[10:]])
        rows.append((i, a, b, x, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "i int, a string, b string, x string, tagged boolean")
    got = df.select("*", D.levenshtein("a", "x").alias("d"), D.levenshtein("a", "x", 5).alias("five"), D.char_error_rate("a", "x").alias("e"), D.recovered("a", "x").alias("r"), D.residual_status("a", "b", "x", "tagged", D.recovered("a", "x")).alias("s")).collect()
    for r in got:
        d = edits(r.a, r.x)
        assert r.d == d and r.five == (d if d <= 5 else -1)
        assert abs(r.e - d / max(1, len(r.a))) < 1e-12 and r.r == (d / max(1, len(r.a)) <= 0.02)
        assert r.s == status(r.a, r.b, r.x, r.tagged)
    assert len({r.s for r in got}) == 7


def test_at_the_threshold(spark):
    """Every length to 400 with as many edits as are just allowed, and one more."""
    rows = [("a" * n, "a" * (n - k)) for n in range(1, 400) for k in (int(n / 50), int(n / 50) + 1) if k <= n]
    df = spark.createDataFrame(rows, "a string, x string")
    for r in df.select("*", D.recovered("a", "x").alias("r")).collect():
        assert r.r == ((len(r.a) - len(r.x)) / len(r.a) <= 0.02), (len(r.a), len(r.x))


def test_long_texts(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgé ") for _ in range(30_000))
    near, far, part = damaged(rng, a, 500), damaged(rng, a, 900), a[:20_000]
    df = spark.createDataFrame([(0, a, a), (1, a, near), (2, a, far), (3, a, part), (4, a, None), (5, None, a)], "i int, a string, x string")
    out = {r.i: r for r in df.select("i", D.recovered("a", "x").alias("r"), D.is_estimated("a", "x").alias("long"), D.char_error_rate("a", "x", F.col("i") == 3).alias("e")).collect()}
    assert [out[i].r for i in range(4)] == [True, True, False, False] and out[4].r is None and out[5].r is None
    assert all(out[i].long for i in range(6)) and abs(out[3].e - 0.2) < 1e-9 and out[1].e is None


def test_common_ends(spark):
    """Long texts that share all, one or none of their ends, and texts within each other."""
    rng = random.Random(4)
    base = "".join(rng.choice("abé数 ") for _ in range(1500))
    pairs = [(base, base), (base, base[:1200] + "zz" + base[1210:]), ("y" + base, base), (base + "y", base), (base, base[:1000]), ("ab" * 700, "ab" * 650), ("a" * 1500, "b" * 1400), (damaged(rng, base, 30), base)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("*", D.levenshtein("a", "b").alias("d"), D.levenshtein("a", "b", 200).alias("k")).collect():
        d = edits(r.a, r.b)
        assert r.d == d and r.k == (d if d <= 200 else -1)


def test_recovery_runs_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "b")], "a string, x string").select(D.recovered("a", "x"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_matcher_has_the_blocks_of_difflib():
    import difflib
    import random

    rng = random.Random(3)
    for n in range(300):
        letters = "abcdefghijklmnopqrstuvwxyz   eeeaat"[: rng.choice([2, 9, 35])]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 20, 150, 600])))
        b = rng.choice([a[11:], a.replace("th", "t").replace("e", "") + "z", a + " once more" * 9, "", "".join(rng.choice(letters) for _ in range(300))])
        ours, theirs = D.Matcher(a, b), difflib.SequenceMatcher(None, a, b)
        assert ours.get_matching_blocks() == theirs.get_matching_blocks() and ours.ratio() == theirs.ratio()
        assert ours.find_longest_match() == theirs.find_longest_match()


def test_edits_in_batches():
    """Both distances of Arrow batches against the definition."""
    rng = random.Random(6)
    for _ in range(200):
        letters = rng.choice(["ab", "abcdefgh é数🙂", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 40, 90])))
        b = rng.choice([a, "", damaged(rng, a, 3), damaged(rng, a, 30), a[10:], a + "zz", "".join(rng.choice(letters) for _ in range(30))])
        d = edits(a, b)
        assert D.edits(a, b) == d
        for most in {0, 1, max(d - 1, 0), d, d + 1, 500}:
            assert D.edits_within(a, b, most) == (d if d <= most else -1), (a, b, most)


def test_large_ranges_have_the_blocks_of_difflib(monkeypatch):
    rng = random.Random(7)
    for n in range(120):
        monkeypatch.setattr(D.Matcher, "SMALL", rng.choice([0, 50, 1 << 12]))
        letters = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz   eeeaat" + " " * 20, "".join(map(chr, range(0x4E00, 0x4E00 + 400)))])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([20, 400, 900])))
        b = rng.choice([a[11:], a.replace("th", "t").replace("e", "") + "z", a + " once more" * 9, "", damaged(rng, a, 60), a[200:] + a[:200], a[:100] * 3])
        ours, theirs = D.Matcher(a, b), difflib.SequenceMatcher(None, a, b)
        assert ours.get_matching_blocks() == theirs.get_matching_blocks() and ours.ratio() == theirs.ratio()


def test_time_of_long_texts_is_not_quadratic():
    import time

    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz"[: rng.choice([8, 14, 26])]) for _ in range(rng.randrange(2, 9))) for _ in range(900)] + ["the", "with", "other"] * 60
    a = " ".join(rng.choice(words) for _ in range(16_000))
    began = time.process_time()
    assert 0 < D.Matcher(a, a.replace("th", "t")).ratio() < 1 and len(a) > 60_000
    assert D.edits_within(a, a[10:], 1000) == 10 and D.edits_within(a, damaged(rng, a, 300), 1000) <= 300
    assert time.process_time() - began < 4


def test_status_of_long_texts(spark):
    """Texts on both sides of BATCHED and of MAX_EXACT, with nulls."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("etaoin shrdlucmfwypvbgkjqxzé数") for _ in range(n))
    rows = []
    for i, n in enumerate([200, 249, 250, 260, 400, 700] * 6 + [5990, 6100] * 4):
        a = text(n)
        b = rng.choice([a + " once more" * 30, a[::-1], damaged(rng, a, n // 20)])
        if n > 5000:
            b = a + " once more" * 30
            x = [a, b, a[n // 20 :], a[3:], b[:-40] if n > 6000 else b[:-200], a[: n - 200] + b[n:], b[200:], "GRID START"][i % 8]
        else:
            x = [a, b, damaged(rng, a, n // 15), damaged(rng, b, n // 15), damaged(rng, a, 2), damaged(rng, b, 2), text(n), ""][i % 8]
        rows.append((i, a, b, x, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "i int, a string, b string, x string, tagged boolean")
    got = df.select("*", D.long_levenshtein("a", "x", 40).alias("d"), D.recovered("a", "x", bounded=D.long_levenshtein).alias("r")).select("*", D.residual_status("a", "b", "x", "tagged").alias("s"), D.residual_status("a", "b", "x", "tagged", "r").alias("given"))
    for r in got.collect():
        d = D.edits(r.a, r.x)
        near = lambda o: o == r.x or D.edits(o, r.x) / max(1, len(o)) <= 0.02  # noqa: B023, E731
        assert r.d == (d if d <= 40 else -1) and r.r == near(r.a), r.i
        rates = [1 - difflib.SequenceMatcher(None, o, r.x).ratio() if max(len(o), len(r.x)) > D.MAX_EXACT else D.edits(o, r.x) / len(o) for o in (r.b, r.a)]
        own = "missing_recovered_tags" if not r.tagged else "recovered" if near(r.a) else "empty_recovered_text" if not r.x else "copied_transformed_input" if near(r.b) else None
        assert r.s == (own or ("closer_to_transformed_than_original" if rates[0] < rates[1] else "contains_transformation_markers" if "GRID START" in r.x else "partial_or_other")), r.i
        assert r.given == r.s, r.i
    long = text(900)
    nulls = [(long, long + "zz" * 20, None), (None, long, long), (None, long, long[100:]), (long, None, long[100:])]
    out = spark.createDataFrame(nulls, "a string, b string, x string").select(D.residual_status("a", "b", "x", F.lit(True)).alias("s")).collect()
    assert [r.s for r in out] == ["partial_or_other", "copied_transformed_input", "partial_or_other", "partial_or_other"]
