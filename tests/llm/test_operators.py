"""Every operator against a plain model on a small table, and on nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontam, gru, langid, linechunks, mixing, minhash, nbsvm, ordermin, preference, seedextend
from palimpsest.llm.shared import components
from palimpsest.llm.textscan import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hub string, bucket int, n_words int, copies int, lost int, line_id long, line_row string, line_gone int, mix_size int, mix_nth int, key long"
CLASH = (1, 77, "r", 9, 4, 5, 6)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))) for _ in range(n // 3)]
    texts = list(base)
    for t in base:
        w = t.split()
        near = list(w)
        near[rng.randrange(len(w))] = "changed"
        texts += [t.replace(" w", "\nW", 3), " ".join(near)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(80))
    texts += [f"start {i} {shared} end {i}" for i in range(6)]
    texts += ["", None, " \n ", "one", "one two", "é ñ ü", "x" * 5000, "a " * 3000]
    return [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0"][i % 4], len(t or ""), "h", 1, 2, 3, *CLASH) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and ids, clashing columns."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8
    data = [(None, t), (None, None), (5, t), (5, t), (5, "other text here"), (7, ""), (7, t.upper())]
    return spark.createDataFrame([(i, x, "en", None, 0, "h", 1, 2, 3, *CLASH) for i, x in data], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes():
    texts = ["Ab ab\x0bAB", "", "x" * 3_000_000 + " y", "é é z", " lead", "trail "]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(r) for r in raw])
    for fold in (True, False):
        h, first = word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), offs, fold)
        seen = {}
        for i, r in enumerate(raw):
            own = (r.lower() if fold else r).split()
            assert len(own) == first[i + 1] - first[i]
            for w, x in zip(own, h[first[i] : first[i + 1]].tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_long_words_of_two_letters_differ():
    """The Thue-Morse words, which powers modulo 2**64 do not tell apart."""
    for n in (6, 7, 10, 12):
        one = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
        two = one.translate(str.maketrans("ab", "ba"))
        raw = f"{one} {two} {one.upper()}".encode()
        h, _ = word_hashes(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), True)
        assert h[0] != h[1] and h[0] == h[2]


@pytest.mark.parametrize("ids", [[None] * 100, [4] * 100, range(100)])
def test_samples_of_null_and_equal_ids(spark, ids):
    """A bound below the rows leaves a sample, whatever the ids; and so do equal rows."""
    for text in ("alpha beta gamma delta {}", "alpha beta gamma delta"):
        rows = spark.createDataFrame([(d, text.format(i), "en", i % 2) for i, d in enumerate(ids)], "doc_id long, text string, lang string, label int")
        assert langid.learn_profiles(rows, train_docs=10)["en"]
        assert len(nbsvm.fit(rows, fit_rows=10)["w"]) > 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def links(rows, k, percent):
    sets = {}
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_minhash(docs, rows, odd, none):
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(docs, k=3, percent=85).collect()}
    assert got == links(rows, 3, 85)
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == 7 and all(r.kept for r in out if r.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_block_links():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.sort(np.unique(np.concatenate((base[i : i + 150], base[:10])))) for i in range(0, 50, 5)]
    group = [(i, i, s) for i, s in enumerate(sets)]
    found = minhash.block_links(group, group, 85)
    ok = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert found and all(ok(sets[a], sets[b]) for a, b in found)


def test_mixing(docs, rows, odd, none):
    out = mixing.mix_sources(docs).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {r.doc_id: r["size"] for r in out} == size and all(0 <= r.copies <= 2 for r in out)
    total, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in out:
        total[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    # sources by code point, null last, weigh 5, 2, 1; water level by bisection
    weight = {s: w for s, w in zip(sorted(total, key=lambda s: (s is None, s or "")), (5, 2, 1))}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 2 * total[s]) for s in total) < 1.5 * sum(total.values()) else (lo, mid)
    for s in total:
        assert target[s] == pytest.approx(min(weight[s] * lo, 2 * total[s]), rel=1e-6)
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = {r.doc_id: r.copies for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in out}
    assert mixing.mix_sources(odd).count() == 7 and mixing.mix_sources(none).count() == 0
    assert mixing.apply_mix(odd).where("copies < 1").count() == 0


def test_decontamination(spark, odd, none):
    rng = random.Random(9)
    words = ["v%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for i in range(12)]
    data = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            body[20:20] = items[i % 12][1].upper().split()
        data.append((i, " ".join(body)))
    want = {}
    sh = lambda w, k: collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    for d, t in data:
        w = t.lower().split()
        for j, x in items:
            y = x.split()
            k = min(5, len(y))
            for n in {len(z.split()) for _, z in items}:
                if min(n, 5) != k or n > len(w):
                    continue
                for s in range(len(w) - n + 1):
                    a, b = sh(w[s : s + n], k), sh(y, k)
                    sim = sum((a & b).values()) / sum((a | b).values())
                    if sim >= 0.8:
                        want[d, j] = max(sim, want.get((d, j), 0))
    bench = spark.createDataFrame(items + [(99, None), (98, "  ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()}
    assert got == pytest.approx(want)
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench.limit(0)).count() == 0


@pytest.mark.parametrize("blocks, n", [(4, 200), (8, 3000)])
def test_simhash_index(blocks, n):
    """All pairs within the radius, where tables are gone through and where they are probed."""
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, n).astype(np.uint64)
    near = prints[:50] ^ np.uint64(0b1011)
    index = decontam.Index([int(p) for p in prints], 20, blocks)
    assert (len(index.tables[0][2]) > len(index.masks)) == (blocks == 8)
    q, i = index.within(near)
    want = {(a, b) for a in range(50) for b in range(n) if (int(near[a]) ^ int(prints[b])).bit_count() <= 20}
    assert set(zip(q.tolist(), i.tolist())) == want and len(index.within(prints[:0])[0]) == 0
    assert len(decontam.Index([], 20, blocks).within(near)[0]) == 0


def test_quality(spark, odd, none):
    rng = random.Random(5)
    good = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice("abcdefgh") * 3 + "%%%" for _ in range(40)) for _ in range(150)]
    data = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    df = spark.createDataFrame(data, "doc_id long, text string, label int")
    model = nbsvm.fit(df.where("doc_id % 5 <> 0"))
    out = nbsvm.score(df, model).join(df, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in nbsvm.score(odd, model).collect())
    assert nbsvm.score(none, nbsvm.fit(df.limit(0))).count() == 0


def test_preference(spark):
    said = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad é"), (1, 2, "user", None), (4, 0, None, "x"), (None, 0, "user", "lost")]
    c = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = {r.pair_id: r for r in preference.preference_rows(c, preference.adjacent_pairs(c)).collect()}
    assert set(out) == {0, 2} and out[0].n_common == 1 and out[0].prompt == "<|user|>\nq<|end|>\n"
    for name in ("chosen", "rejected"):
        assert [out[0][name][s.start : s.end] for s in out[0][f"{name}_spans"]] == (["good"] if name == "chosen" else ["bad é"])
    assert out[2].rejected == "" and out[2].rejected_id is None
    assert preference.adjacent_pairs(c.limit(0)).count() == 0


def test_language(docs, odd, none, spark):
    rng = random.Random(8)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 7))) for _ in range(40))
    data = [(i, make("etaoin" if i % 2 else "zqxjkv"), "aa" if i % 2 else "bb") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df.where("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in langid.predict_language(df, profiles).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in data)
    # out-of-place distance by definition
    own = langid.ranked(*langid.ngram_counts(data[0][1]), langid.PROFILE).astype(np.int64).tolist()
    place = {g: j for j, g in enumerate(np.array(profiles["bb"], dtype=np.int64).tolist())}
    d = sum(abs(place[g] - j) if g in place else langid.PROFILE for j, g in enumerate(own))
    assert out[0].distance == pytest.approx(d / (len(own) * langid.PROFILE))
    blank = spark.createDataFrame([(1, None), (2, "12 %"), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict_language(blank, profiles).collect()} == {"und"}
    assert langid.accepted(odd, profiles).columns == odd.columns and langid.accepted(none, profiles).count() == 0
    assert langid.predict_language(blank, {}).count() == 3


def test_order_minhash(spark, docs, rows, odd, none):
    out = {r.doc_id: r for r in ordermin.fingerprints(docs).collect()}
    for at, r in enumerate(rows):
        t, after = r[1] or "", rows[(at + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert out[r[0]].n_chars == len(t) and out[r[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[r[0]].near_edited <= 1
        if edited == t and t.split():
            assert out[r[0]].near_edited == 1
    a, b = "p q r s t u v w x y z " * 4, "z y x w v u t s r q p " * 4
    two = spark.createDataFrame([(a, b)], "a string, b string").select(ordermin.fingerprint(F.col("a")).alias("a"), ordermin.fingerprint(F.col("b")).alias("b")).first()
    assert two.a != two.b and len(two.a) == 256
    assert len({r.fingerprint for r in ordermin.fingerprints(odd).where("doc_id = 5").collect()}) == 2
    assert ordermin.fingerprints(none).count() == 0


def test_line_chunks(spark, docs, odd, none):
    lines = [f"line {i}" for i in range(40)]
    data = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines)), (3, "\n".join(lines[5:30] + ["own"])), (4, "alone"), (5, None), (6, "")]
    out = {r.doc_id: r for r in linechunks.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[1].text == data[0][1] and out[4].n_removed == 0 and out[5].text is None and out[5].n_lines == 0 and out[6].n_lines == 1
    assert out[2].n_removed >= 30 and "new" in out[2].text.split("\n") and out[3].n_removed >= 15 and "own" in out[3].text.split("\n")
    assert linechunks.line_dedup(odd).columns == odd.columns + ["n_lines", "n_removed"]
    assert linechunks.line_dedup(none).count() == 0


def test_substrings(docs, rows, odd, none):
    seen, want = set(), {}
    for r in rows:
        w, own = WORD.findall(r[1] or ""), []
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            t = tuple(w[s : s + 50])
            own.append(t)
            if t in seen:
                gone[s : s + 50] = [True] * 50
        seen.update(own)
        want[r[0]] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in seedextend.substring_dedup(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500
    out = seedextend.substring_dedup(odd).collect()
    assert len(out) == 7 and all(r.n_removed == 0 for r in out if r.doc_id is None)
    assert seedextend.substring_dedup(none).count() == 0


def learned(docs, train):
    two = docs.select("doc_id", "text", train.alias("train"))
    counts = gru.count_words(two.where("train"))
    v = gru.vocabulary(counts)
    encoded = gru.encode(two, v, F.col("train"))
    return v, gru.fit(encoded, v), counts, encoded


def plain_scores(words, v, net, count, head):
    """log10 probability of each text by the definition, word by word, in float64."""
    net = gru.Network(net.flat.astype(np.float64))
    soft = lambda x: x / (1 + np.abs(x))
    logs = lambda x: x - np.log(np.exp(x).sum())
    place = {w: i for i, w in enumerate(head)}
    out = {}
    for i, text in words.items():
        h, total = np.zeros(gru.HIDDEN), 0.0
        for w in text:
            state = np.append(h, 1.0)
            raw = w.encode()
            code = 0 if w in place else (raw[-2] << 8 | raw[-1] if len(raw) > 1 else 65536 + raw[0])
            tail = int(v.tail_class[code])
            ids = place.get(w, gru.HEAD + tail)
            classes = logs(state @ net.C)
            if w in place:
                k = ids // gru.CLASS_WORDS
                total += (classes[k] + logs(state @ net.W[k])[ids % gru.CLASS_WORDS]) / np.log(10)
            else:
                total += classes[gru.HEAD_CLASSES + tail] / np.log(10)
                if count[w]:
                    total += math.log10(count[w] + 0.5) + v.seen[tail]
                else:
                    total += v.unseen[tail] + v.suffix_log[code]
                    left = [*reversed(raw[:-2]), 256] if len(raw) > 1 else []
                    for right, b in zip(reversed(raw[: len(raw) - 1]), left):
                        total += v.left_log[right * 257 + b]
            s = h @ net.Un
            a = 0.5 + 0.5 * soft(net.Eg[ids] + h @ net.Ug)
            r, z = a[: gru.HIDDEN], a[gru.HIDDEN :]
            n = soft(net.En[ids] + r * s)
            h = n + z * (h - n)
        out[i] = total
    return out


@pytest.mark.parametrize("carried", [1 << 18, 40])
def test_language_model(spark, monkeypatch, carried):
    monkeypatch.setattr(gru, "CARRIED", carried)
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abc')}{int(rng.paretovariate(0.4)) % 3000}{rng.choice('xyz')}" for _ in range(rng.randrange(5, 200))) for _ in range(60)] + ["", None, " \n", "A", "é ñ"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v, net, counts, encoded = learned(docs, F.col("doc_id") % 5 != 1)
    out = {r.doc_id: r for r in gru.score(encoded, net, v, counts).collect()}
    count = collections.Counter()
    words = {r[0]: WORD.findall(lower(r[1])) + ["\n"] for r in rows}
    for i, w in words.items():
        if i % 5 != 1:
            count.update(w)
    n, types = sum(count.values()), len(count)
    for i, w in words.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (types + 1))) for x in w)
        assert out[i].n_tokens == len(w) and out[i].n_known == sum(count[x] > 0 for x in w) and out[i].train_tokens == n
        assert out[i].base_score == pytest.approx(base)
    hashes = {int(x): i for x, i in zip(v.head.astype(np.int64), v.head_id)}
    known = list(count)
    raw = [w.encode() for w in known if w != "\n"]
    h, _ = word_hashes(np.frombuffer(b" ".join(raw), dtype=np.uint8), np.array([0, sum(map(len, raw)) + len(raw) - 1]), True)
    head = {hashes[int(x)]: w for x, w in zip(h.astype(np.int64), [w for w in known if w != "\n"]) if int(x) in hashes} | {0: "\n"}
    want = plain_scores(words, v, net, count, [head[i] for i in range(len(head))])
    for i in words:
        assert out[i].score == pytest.approx(want[i], rel=1e-3, abs=1e-3)


def test_probabilities_sum_to_one_at_most(spark):
    """Within a tail class: the seen words' shares, and all spellings of a class, by two-letter words and suffixes."""
    texts = spark.createDataFrame([(i, " ".join(f"{x}{y}ab{i % 7}" for x in "pqrs" for y in "uvw") + " common" * 9) for i in range(30)], "doc_id long, text string")
    v = gru.vocabulary(gru.count_words(texts))
    for k in np.unique(v.tail_class):
        assert (10 ** v.suffix_log[v.tail_class == k]).sum() == pytest.approx(1)
    assert (10 ** v.left_log.reshape(256, 257)).sum(axis=1) == pytest.approx(np.ones(256))
    buf = np.frombuffer(b"quab3 b zz", dtype=np.uint8)
    s, e = np.array([0, 6, 8]), np.array([5, 7, 10])
    got = gru.spelling(buf, s, e, gru._suffix(buf, s, e), v)
    step = lambda r, left: v.left_log[ord(r) * 257 + (ord(left) if left else 256)]
    want = [v.suffix_log[ord("b") << 8 | ord("3")] + step("b", "a") + step("a", "u") + step("u", "q") + step("q", ""), v.suffix_log[65536 + ord("b")], v.suffix_log[ord("z") << 8 | ord("z")] + step("z", "")]
    assert got == pytest.approx(want)


def test_language_model_prefers_what_it_knows(docs, rows, odd, none, spark):
    invented = [(1000 + i, " ".join(f"qj{i}x{j}zv" for j in range(60)), None, None, 0, "h", 1, 2, 3, *CLASH) for i in range(5)]
    out = gru.learn_and_score(docs.union(spark.createDataFrame(invented, SCHEMA)), F.col("doc_id") < 900).collect()
    rate = lambda some: sum(r.score for r in some) / sum(r.n_tokens for r in some)
    assert rate([r for r in out if r.doc_id >= 1000]) < rate([r for r in out if r.doc_id < 60]) - 2
    assert gru.learn_and_score(odd, F.lit(True)).count() == 7 and gru.learn_and_score(odd, F.lit(False)).where("score >= 0").count() == 0
    assert gru.learn_and_score(none, F.lit(True)).count() == 0
    same = {(r.base_score, r.score) for r in gru.learn_and_score(odd, F.lit(True)).where("doc_id = 5 and n_tokens > 9").collect()}
    assert len(same) == 1


def test_network_gradient():
    rng = np.random.default_rng(1)
    net = gru.Network(rng.normal(0, 0.4, gru.Network().flat.shape))
    ids = rng.integers(0, gru.HEAD + gru.TAIL_CLASSES, (6, 3)).astype(np.int16)
    fresh = np.zeros((6, 3), dtype=bool)
    fresh[0] = fresh[3, 1] = True
    h = np.zeros((3, gru.HIDDEN))
    grads = gru.Network(np.zeros_like(net.flat))
    loss = lambda: net.window(ids, h, fresh, gru.Network(np.zeros_like(net.flat)))[0]
    net.window(ids, h, fresh, grads)
    for name in net.SHAPES:
        own, flat = getattr(grads, name).ravel(), getattr(net, name).ravel()
        for at in rng.choice(np.flatnonzero(own), 8):
            save = flat[at]
            flat[at] = save + 1e-5
            up = loss()
            flat[at] = save - 1e-5
            down = loss()
            flat[at] = save
            assert (up - down) / 2e-5 == pytest.approx(own[at], rel=1e-4, abs=1e-6)


def test_state_is_carried():
    rng = np.random.default_rng(4)
    net = gru.Network(rng.normal(0, 0.3, gru.Network().flat.shape).astype(np.float32))
    texts = [np.append(rng.integers(1, gru.HEAD, n), 0).astype(np.int16) for n in (0, 5, 100, 1000, *[3] * 700)]
    got = gru.score_texts(net, texts)
    for t, g in list(zip(texts, got))[:20]:
        states = np.ones((len(t), 1, gru.HIDDEN + 1), dtype=np.float32)
        net.forward(t[:, None], np.ones((len(t), 1), dtype=np.float32), states, np.zeros((1, gru.HIDDEN), dtype=np.float32))
        assert g == pytest.approx(float(net.output(states[:, 0], t)[0].sum()), rel=1e-4)
    assert len(gru.score_texts(net, [])) == 0


def test_network_sees_every_text(spark, monkeypatch):
    """All tokens reach one round and one replica, also through a tree of averages."""
    texts = spark.createDataFrame([(i, f"a b w{i}") for i in range(1000)] + [(None, "a b x")] * 3, "doc_id long, text string")
    v = gru.vocabulary(gru.count_words(texts))
    encoded, start = gru.encode(texts, v, F.lit(True)), gru.Network.start(v, 5)
    monkeypatch.setattr(gru, "FAN_IN", 2)
    rounds = [gru.train_round(encoded, start, i, 2, 3).collect() for i in range(2)]
    assert [len(r) for r in rounds] == [1, 1] and sum(r[0].n for r in rounds) == v.total == 1003 * 4


def test_training_passes_over_all_tokens(monkeypatch):
    seen = []
    monkeypatch.setattr(gru.Network, "window", lambda net, ids, h, *a: seen.append(ids.ravel()) or (0.0, h))
    for size in (1499, gru.LANES * gru.WINDOW * 20 + 7):
        stream = np.resize(np.arange(gru.HEAD, dtype=np.int16), size)
        for least in (1, 50):
            seen.clear()
            assert gru.train(gru.Network(), stream, least=least) == len(seen) >= least
            counts = np.bincount(np.concatenate(seen), minlength=gru.HEAD)
            assert (counts >= np.bincount(stream, minlength=gru.HEAD)).all()


def test_head_and_end_beside_many_words(spark, monkeypatch):
    """More than CARRIED words at least as frequent as there are texts, and a topmost bin beyond CARRIED."""
    monkeypatch.setattr(gru, "CARRIED", 8)
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40)) + " often" * 9 * i) for i in range(2)], "doc_id long, text string")
    for rows, top in ((texts, 9), (texts.where("doc_id = 0"), 1)):
        v, net, counts, encoded = learned(rows, F.lit(True))
        assert v.head_n.tolist() == [rows.count()] + [top] * (top > 1) + [rows.count()] * (len(v.head_n) - 1 - (top > 1)) and len(v.head_n) == 41 + (top > 1)
        n, types = v.total, v.types
        for r in gru.score(encoded, net, v, counts).collect():
            count = [rows.count()] * 41 + [9] * 9 * r.doc_id
            assert r.n_known == r.n_tokens == len(count)
            assert r.base_score == pytest.approx(sum(math.log10((c + 0.5) / (n + 0.5 * (types + 1))) for c in count))


def test_minhash_texts_that_share_an_id(spark):
    """Each text of an id is compared; ids join what their texts are linked with."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    data = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, "other words " * 3), (11, ""), (12, "other words " * 3)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (12, 11)}


def test_minhash_large_groups_without_a_centre(spark, monkeypatch):
    """Texts that share half their shingles fall into common buckets; only true copies link."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    rng, common = random.Random(6), [f"c{i}" for i in range(120)]
    data = [(i, " ".join(common + [f"o{i // 2}_{j}" for j in range(50)] + ([f"x{i}"] if i % 2 else []))) for i in range(40)]
    rng.shuffle(data)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == links(data, 3, 85) and len({v[1] for v in got.values()}) == 20


def test_minhash_groups_of_a_few_blocks_stay_whole(spark, monkeypatch):
    """A member of such a group is one row a hub, not one a band; bands are as many as the threshold needs."""
    compared, compare = [], minhash._compare
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(minhash, "_compare", lambda groups, *rest: compared.append(groups.count()) or compare(groups, *rest))
    data = [(i, " ".join([f"c{j}" for j in range(120)] + [f"o{i // 2}_{j}" for j in range(40)] + ["x"] * (i % 2))) for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k=3, percent=85).collect()}
    assert got == links(data, 3, 85) and 0 < compared[0] <= len(data) * minhash.BANDS
    assert [minhash.inner_bands(p) for p in (50, 80, 85, 90)] == [112, 112, 65, 37]


def test_line_chunks_runs_and_names(spark, docs, rows):
    """Runs of equal lines go, blocks survive a shift, every other column keeps its value."""
    same = "\n".join(["again"] * 20)
    block = "\n".join(f"shared line {i}" for i in range(30))
    data = [(1, same), (2, same), (3, "a\n" + same), (4, block), (5, "own\nlines\n" + block + "\nend"), (5, None)]
    out = {(r.doc_id, r.text is None): r for r in linechunks.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[1, False].n_removed == 18 and out[2, False].n_removed == 20 and out[3, False].n_removed >= 18
    assert out[5, False].n_removed >= 20 and out[5, False].text.startswith("own\nlines") and out[5, False].text.endswith("end")
    kept = {r.doc_id: r for r in linechunks.line_dedup(docs).collect()}
    assert all((kept[r[0]].line_id, kept[r[0]].line_row, kept[r[0]].lost) == (77, "r", 1) for r in rows)


def test_decontamination_of_edited_passages(spark, monkeypatch):
    """Edited windows at similarity 0.8 and more are all found, in one pass over the items or in several."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40, 60)))) for i in range(12)]
    data, want = [], set()
    for i in range(120):
        own = items[i % 12][1].split()
        for _ in range(i % 3):
            own[rng.choice([0, 1, -1, -2])] = "edited"
        body = [rng.choice(words) for _ in range(30)]
        data.append((i, " ".join(body + own + body)))
        a, b = (collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (own, items[i % 12][1].split()))
        if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
            want.add((i, i % 12))
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 100
    for words_a_pass in (1 << 20, 200):
        monkeypatch.setattr(decontam, "WORDS_A_PASS", words_a_pass)
        assert want <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    clash = docs.withColumn("lost", F.lit(1))
    assert decontam.decontaminate(clash, bench).columns == clash.columns


def test_very_long_texts(spark):
    """One text of 300,000 words beside short ones, through every operator of texts."""
    long = " ".join(f"w{(i * i) % 7919}" + ("\n" if i % 9 == 0 else "") for i in range(300_000))
    df = spark.createDataFrame([(1, long, "en", "s"), (2, long + " more", "en", "s"), (3, "short text", "en", None)], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(7, " ".join(long.split()[1000:1060]))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(df, bench).collect()} == {1, 2}
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {1, 3}
    assert linechunks.line_dedup(df).where("doc_id = 2").first().n_removed > 30_000
    assert seedextend.substring_dedup(df).where("doc_id = 2").first().n_removed >= 299_900
    assert langid.predict_language(df, langid.learn_profiles(df)).count() == 3
    model = nbsvm.fit(df.select("doc_id", "text", (F.col("doc_id") % 2).alias("label")))
    assert nbsvm.score(df, model).count() == 3
    assert ordermin.fingerprints(df).where("doc_id = 1").first().near_next > 0.9
    assert gru.learn_and_score(df, F.lit(True)).agg(F.sum("n_tokens")).first()[0] == 600_001 + 2 + 3
