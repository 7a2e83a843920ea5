"""SimHash tiles, ball trees and conversation repair against plain models and on odd tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from palimpsest.llm import balltree, nbsvm, ordermin, repair, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp long, tile long, least long, root long, node long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_fingerprint(text, k=3):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_xxh64():
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(9000))
    spans = [(rng.randrange(3000), n) for n in [*range(0, 140), 1000, 2047, 2048, 5000]]
    got = simhash.xxh64(np.frombuffer(data, dtype=np.uint8), np.array([a for a, _ in spans]), np.array([n for _, n in spans]))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in spans]


def simhash_rows():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    texts += [t.upper().replace(" ", "\t\n ") for t in texts[:10]]
    for t in texts[:30]:  # a word changed at the end: a few bits differ
        texts += [t + " w1", "w2 " + t]
    return [(i, t) for i, t in enumerate([*texts, "", None, " \n", "é ñ Ü", "one", "x" * 5000, "ab " * 70_000, "one"])]


def test_simhash_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 1000)  # blocks end within texts
    rows = simhash_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = roots(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(set(want.values())) < len(want) - 20
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_tiles_lose_no_link(spark, monkeypatch):
    """Every number of blocks, chunks of few fingerprints, many links: the same components as all pairs."""
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    for x in list(prints):
        for _ in range(8):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(x)
        prints.add(x ^ 0b111)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = roots(sorted(map(signed, prints)), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for blocks in (1, 2, 4, 8, 16):
        links = {frozenset((r.u, r.v)) for r in simhash.close_links(table, blocks=blocks).collect()}
        assert roots(sorted(want), lambda a, b: frozenset((a, b)) in links) == want


def test_simhash_blocks():
    assert simhash.blocks_for(0) == 1 and simhash.blocks_for(10**6) == 4 and simhash.blocks_for(10**12) == 16
    assert len(simhash._steps(4, 2)) == 21 and len(simhash._steps(1, 2)) == 3


def test_simhash_odd_tables(spark):
    t = "alpha beta gamma delta epsilon"
    rows = [(None, t), (None, None), (5, t), (5, t), (5, "quite another text"), (7, "quite another text"), (9, ""), (8, " ")]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, None)] * 2 + [(5, 5)] * 3 + [(7, 5), (9, 8), (8, 8)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    z = [list(x) for _, x in sorted(kept, key=key)[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        at = [min((far(x, c), k) for k, c in enumerate(z)) for _, x in kept]
        if r < rounds:
            for k in range(len(z)):
                own = [x for (_, x), (_, c) in zip(kept, at) if c == k]
                z[k] = [sum(c) // len(own) for c in zip(*own)] if own else z[k]
    total = sum(d for d, _ in at)
    return sorted(((i, k, d, sum(e for e, c in at if c == k), total, hashlib.sha256(",".join(map(str, z[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, at)), key=str)


def vectors(n=400, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(size=64) * (0.02 if i % 3 else 0.5)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(120)]  # one common vector
    rows += [(None, same), (None, rows[4][1]), (7, rows[8][1]), (7, rows[7][1])]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)]


KIND = "vec_id long, embedding array<float>, cluster int, x int, n long"


def clusters_of(spark, rows):
    out = balltree.cluster_vectors(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KIND))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_clusters_against_all_distances(spark, monkeypatch):
    rows = vectors()
    want = plain_clusters(rows)
    assert clusters_of(spark, rows) == want
    monkeypatch.setattr(balltree, "TREE", 50)
    assert clusters_of(spark, rows) == want
    assert clusters_of(spark, rows[:5]) == plain_clusters(rows[:5])  # fewer than clusters
    assert clusters_of(spark, rows[-3:]) == [] and clusters_of(spark, []) == []


def test_clusters_at_ties_and_limits(spark):
    axis = lambda i, x: [x if j == i else 0.0 for j in range(64)]
    rows = [(i, axis(i % 4, float((-1) ** i))) for i in range(60)] + [(100, [0.0] * 64)]
    assert clusters_of(spark, rows) == plain_clusters(rows)
    huge = clusters_of(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])
    assert [r[:3] for r in huge] == [(1, r[1], 0) for r in huge[:1]] + [(2, huge[1][1], 0), (3, huge[2][1], 0)]


def test_balls_are_assigned_whole_and_exactly():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-500, 500, (16, 64))
    points = (centroids[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 64))).astype(np.int32)
    order, nodes = balltree.grow(points)
    tree = {k: np.array(v) for k, v in nodes.items()} | {"points": points[order]}
    exact = np.square(points[order][:, None, :].astype(np.int64) - centroids[None]).sum(axis=2).argmin(axis=1)
    got, whole = np.full(3000, -1), 0
    for node, c, d in balltree.filtered(tree, centroids):
        lo, hi = tree["starts"][node], tree["ends"][node]
        assert (got[lo:hi] == -1).all() and (tree["sums"][node] == points[order][lo:hi].sum(axis=0)).all()
        got[lo:hi] = c
        whole += hi - lo if d is None else 0
    assert (got == exact).all() and whole > 1000


def all_edits(rows):
    """Least (cost, audit) by trying every edit of every row and every number of inserts."""
    found = []

    def go(i, out, cost, audit, inserted):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
        if inserted < 3:
            for r in "ua":
                go(i, out + r, cost + 3, audit + "I", inserted + 1)
        if i < len(rows) and re.fullmatch("s?(ua)*u?", out):
            initial, fault = rows[i]
            go(i + 1, out, cost + 4, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                go(i + 1, out + initial, cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, out + r, cost + more + 3, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_edits_against_all(spark):
    rng = random.Random(7)
    cases = [[(rng.choice("suuaaat"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)] for n in (0, 1, 2, 3, 3, 4, 4) for _ in range(25)]
    for rows in cases:
        assert repair.best_edits(rows) == all_edits(rows), rows


TALK = "conv_id long, turn long, role string, text string, kind string, gone boolean, again int, key string"


def test_repair_reports(spark):
    said = [
        (1, 0, "user", "Hello.", False), (1, 1, "user", "Are you there?", False), (1, 3, "assistant", "yes", False), (1, 3, "assistant", "yes", False),
        (2, 0, "user", " ", False), (3, 0, "user", "gone.", True), (4, None, "system", "Be brief.", False), (4, 2, None, None, False),
        (None, 1, "user", "Hi.", False), (None, 2, "assistant", "Hi!", False),
    ]
    table = spark.createDataFrame([(c, t, r, x, "k", g, 1, "y") for c, t, r, x, g in said], TALK)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(table).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # equal costs (keep, insert, keep, keep the truncated one, drop its copy): I comes before K
    assert got[1] == (1, 0, 1, 1, 2, 10, "KIKKD", sha("user:Hello.\nassistant:\nuser:Are you there?\nassistant:yes"))
    assert got[2] == (0, 1, 0, 0, 0, 4, "D", sha("")) and got[3] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got[4] == (0, 1, 0, 0, 1, 8, "DD", sha(""))
    assert got[None] == (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.\nassistant:Hi!"))
    assert repair.repair(spark.createDataFrame([], TALK)).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!", "k", None, 1, "y") for c in [*range(40), None] for t in (0, 1, None)]
    got = repair.damage(spark.createDataFrame(rows, TALK)).groupBy("conv_id", "turn", "role", "text", "gone").count().collect()
    want = {}
    for c, t, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t] = ("user" if kind == 4 else "assistant", {1: "", 2: "One Two"}.get(kind, "One. Two!"), kind == 0, 2 if kind == 3 else 1)
    assert {(r.conv_id, r.turn): tuple(r)[2:] for r in got} == want
    table = spark.createDataFrame([(1, next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 > 4), None, None, "k", None, 1, "y")], TALK)
    assert [tuple(r)[2:4] for r in repair.damage(table).collect()] == [(" ", " ")]


def test_a_long_conversation(spark):
    """Thousands of turns, all of one role, one of them very long: every second place is filled in."""
    n = 3000
    table = spark.createDataFrame([(1, i, "user", f"turn {i} " + ("x" * 2_000_000 if i == 5 else "") + ".", "k", False, 1, "y") for i in range(n)], TALK)
    (r,) = repair.repair(table).collect()
    assert r.cost == 3 * n / 2 and r.audit == "KR" * (n // 2)


def spark_hash(parts, seed=42):
    """Spark's xxhash64 of strings, longs (8 bytes) and ints (4 bytes), one after the other."""
    for x in parts:
        seed = xxhash.xxh64_intdigest(x, seed)
    return seed


def plain_order_minhash(text, coordinates=32, k=2, pick=2):
    """Order MinHash by definition: sorted numbered k-mers, looked at from equally spaced points of the circle."""
    w = [x.encode() for x in WORD.findall(text or "")]
    if not w:
        return "0" * 8 * coordinates
    value = lambda h: h >> 32
    places: dict = {}
    for i in range(max(1, len(w) - k + 1)):
        places.setdefault(value(spark_hash(w[i : i + k])), []).append(i)
    found = []
    for v, at in places.items():
        found += [(v if r == 0 else value(spark_hash([v.to_bytes(8, "little"), r.to_bytes(4, "little")])), i) for r, i in enumerate(at)]
    found.sort()
    out = []
    for c in range(coordinates):
        ahead = ([x for x in found if x[0] >> 27 >= c] + found + found)[:pick]
        ordered = [v for _, v in sorted((i, v) for v, i in ahead)]
        out.append(f"{spark_hash([v.to_bytes(8, 'little') for v in ordered]) & 0xFFFFFFFF:08X}")
    return "".join(out)


def test_order_minhash_against_the_definition(spark):
    """Fingerprints and likenesses of texts with repeated, few, many and no words."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c é", "dd\n"] if i % 3 else [str(j) for j in range(500)]) for _ in range(rng.randrange(1, 300))) for i in range(30)]
    texts += ["", None, " \t", "one", "one two", "one one one one", "x" * 3000, "a b " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(ordermin.fingerprints(df).collect(), key=lambda r: r.doc_id)
    share = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 256, 8)) / 32
    for i, r in enumerate(got):
        t, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert r.fingerprint == plain_order_minhash(t) and r.edited_fingerprint == plain_order_minhash(edited)
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint) and r.near_next == share(r.fingerprint, plain_order_minhash(after))


def test_quality_weights_against_a_plain_solver(spark):
    """Ratios by definition; the weights reach the least hinge loss, as a projected gradient finds it."""
    rng = random.Random(4)
    good, bad, both = ["clear", "fine", "sound"], ["spam", "junk", "win"], ["the", "of", "a", "to", "it"]
    texts = [" ".join(rng.choice((good if i % 2 else bad) + both * 3) for _ in range(12)) for i in range(60)]
    y = np.array([2 * (i % 2) - 1 for i in range(60)], dtype=float)
    y[:6] *= -1  # not separable
    rows = [(i, t, int(y[i] > 0)) for i, t in enumerate(texts)]
    model = nbsvm.fit(spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3), fit_rows=10_000, epochs=200)
    feats = nbsvm.features(pa.array(texts))
    counts = np.ones((2, nbsvm.FEATURES))
    for f, label in zip(feats, y):
        counts[int(label > 0), f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = np.unique(np.concatenate(feats))
    x = np.zeros((60, len(seen) + 1))
    for i, f in enumerate(feats):
        x[i, np.searchsorted(seen, f)] = ratio[f] / max(1.0, np.sqrt(len(f)))
    x[:, -1] = 1
    w = np.append(model["w"][seen].astype(float) / np.where(ratio[seen] == 0, 1, ratio[seen]), model["w"][nbsvm.FEATURES])
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    q, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, 1)
    best = loss((alpha * y) @ x)
    assert loss(w) <= best * 1.03 and np.all(np.delete(model["w"][: nbsvm.FEATURES], seen) == 0)
    score = {r.doc_id: r.score for r in nbsvm.score(spark.createDataFrame(rows, "doc_id long, text string, label int"), model).collect()}
    for i in range(60):
        assert abs(score[i] - 1 / (1 + np.exp(-(model["a"] * (x[i] @ w) + model["b"])))) < 1e-5
