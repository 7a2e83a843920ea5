"""A few registered queries against DuckDB on the smallest tables, and the sources and loops that no query shows."""

import json
from hashlib import md5
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import perturb as P
from palimpsest.operators import metrics, stats
from palimpsest.plans import catalogue
from palimpsest.sources import problems, results
from palimpsest.streaming import recorded

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()
SOME = "n04_sanitize_problem t11_rectangle_perimeter x10_segments a07_summarize_runs q03_paired j01_join_outputs w01_latest b07_trim_to_budget".split()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    key = lambda rows: sorted(str(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)
    assert sorted(got.columns) == sorted(names)
    assert key(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == key(want)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_read_results(spark, tmp_path):
    rows = [{"id": "1", "output": "a", "correct": True}, {"id": 2, "output": "b", "correct": False}]
    shapes = {"list": [*rows, {"summary": {"accuracy": 0.5, "max_tokens": 9}}], "wrapped": {"results": rows, "metadata": {}}, "map": {"x": rows[0], "y": rows[1]}}
    for name, data in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    got, summary = results.read_results(spark, str(tmp_path))
    assert sorted((r.path.split("/")[-1], r.id, r.correct) for r in got.collect()) == sorted((f"{n}.json", i, i == "1") for n in shapes for i in ("1", "2"))
    assert [(r.accuracy, r.max_tokens) for r in summary.collect()] == [(0.5, 9)]


def test_decoders(spark):
    lines = {
        "openai": ['{"custom_id":"a_0","response":{"body":{"choices":[{"finish_reason":"stop","message":{"content":"hi"}}]}}}', '{"custom_id":"b_0","response":{"body":{"choices":[{"finish_reason":"content_filter"}]}}}', '{"custom_id":"c_0","error":"bad"}', " "],
        "google": ['{"id":"a_0","response":{"candidates":[{"finishReason":"STOP","content":{"parts":[{"text":"hi"}]}}]}}', '{"request":{"id":"b_0"},"response":{"candidates":[{"finishReason":"SAFETY"}]}}', '{"id":"c_0","error":"bad"}'],
    }
    for provider, values in lines.items():
        df = spark.createDataFrame([(v,) for v in values], "value string")
        out = {r.custom_id: (r.output, r.is_refusal) for r in results.decode_results(df, provider).collect()}
        assert out["a_0"] == ("hi", False) and out["b_0"][1] and out["c_0"] == ("ERROR: bad", False) and len(out) == 3


def test_lexicon_round_trips(spark):
    texts = ["Find the 3 positive numbers such that $x$ is large. Alice has a good red ball.", "", "a b", "no rule applies"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", L.not_not("t").alias("n"), P.undo_not_not(L.not_not("t")).alias("a"), L.undo_opposites(L.opposites("t")).alias("b"), L.undo_wrappers(L.wrappers("t")).alias("c"), P.undo_context_saturation(L.context_saturation("t", F.lit(1))).alias("d")).collect():
        assert r.a == r.t and r.b == r.t and r.d == r.t and r.c.split() == r.t.split()
        assert "not not such" not in r.n and "$x$" in r.n or "$" not in r.t


def test_agent_loop(spark):
    agents = spark.createDataFrame([(1, ["q"]), (2, ["q"])], "id long, history array<string>")
    replies = spark.createDataFrame([(1, "\\boxed{7}"), (2, "```python\nprint(1)\n```")], "id long, reply string")
    out = {r.id: r for r in recorded.agent_loop(agents, recorded.TableGenerator(replies), max_steps=2).collect()}
    assert out[1].answer == "7" and out[1].steps == 1
    assert out[2].answer is None and out[2].steps == 2 and out[2].history[-1] == "Observation: execution is disabled"


def test_poll_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":"1","output":"x"}\n')
    seen = []
    for _ in range(2):  # the second pass finds nothing new
        recorded.poll_results(spark, str(tmp_path / "in"), "id string, output string", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert seen == ["1"]


def drawn_interval(scores, draws, seed=42):
    def pick(d, i):
        start = int(md5(f"{seed}|{d}".encode()).hexdigest()[:8], 16) % stats.PRIME
        u = (start + i * stats.STEP) % stats.PRIME
        v = (u * u + 1) % stats.PRIME
        return (v * v + u) % stats.PRIME % len(scores)

    means = sorted(sum(scores[pick(d, i)] for i in range(len(scores))) / len(scores) for d in range(draws))
    return means[int(0.025 * (draws - 1))], means[int(0.975 * (draws - 1))]


def test_draws_are_even():
    """The picks of many draws take every place about equally often, alone and in pairs."""
    import collections

    n, draws = 7, 4000
    starts = [int(md5(f"42|{d}".encode()).hexdigest()[:8], 16) % stats.PRIME for d in range(draws)]
    rows = []
    for s in starts:
        us = [(s + i * stats.STEP) % stats.PRIME for i in range(n)]
        rows.append([((u * u + 1) % stats.PRIME * ((u * u + 1) % stats.PRIME) + u) % stats.PRIME % n for u in us])
    pairs = collections.Counter((r[0], r[3]) for r in rows)
    assert all(abs(c - draws / n / n) < 5 * (draws / n / n) ** 0.5 for c in pairs.values()) and len(pairs) == n * n
    means = [sum(r) / n for r in rows]
    spread = sum((m - 3) ** 2 for m in means) / draws
    assert spread == pytest.approx(4 / n, rel=0.1)  # the variance of a mean of n independent picks


def test_paired_and_run_intervals(spark):
    a, b = [1.0, 0.5, 0.0, 1.0, 0.25], [0.0, 0.5, 1.0, 0.5, 0.0]
    side = lambda x: spark.createDataFrame([("m", i, v) for i, v in enumerate(x)], "model string, id long, score double")
    r = stats.paired_comparison(side(a), side(b), ["model"], draws=300).first()
    assert (r.n_common, r.better, r.same, r.worse) == (5, 3, 1, 1) and r.low < r.mean_diff < r.high
    assert (r.low, r.high) == pytest.approx(drawn_interval([x - y for x, y in zip(a, b)], 300))
    rows = spark.createDataFrame([(None, i, v, None, v) for i in range(4) for v in (True, i > 1)], "model string, id long, success boolean, extracted string, correct boolean")
    r = metrics.summarize_runs(rows, ["model"], draws=300).first()
    assert r.n_problems == 4 and (r.low, r.high) == pytest.approx(drawn_interval([0.5, 0.5, 1.0, 1.0], 300))
    limited = metrics.summarize_runs(rows.withColumn("tokens", F.lit(99)), ["model"], draws=9, limit=F.lit("100")).first()
    told = metrics.summarize_runs(rows, ["model"], draws=9, reported=F.lit(5)).first()
    assert (r.cutoffs, limited.cutoffs, told.cutoffs) == (0, 8, 5)
    far = stats.paired_comparison(side(a), side(b).withColumn("id", F.col("id") + 50), ["model"], draws=9).first()
    assert (far.n_common, far.mean_diff, far.a_mean) == (0, None, pytest.approx(0.55))


def test_queries_read_whole_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(0, ". Led by a full stop. Then more."), (1, "One. Two.")], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", "abcd") for i in range(100)], "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    queries = catalogue.queries()
    assert {r.doc_id for r in queries["r07_sentence_reversal"](spark, at).collect()} == {0, 1}
    assert sorted((r.conv_id, r.total) for r in queries["b13_fill_context"](spark, at).collect()) == [(i, i + 1) for i in range(100)]


def test_problem_sources(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "idx long, problem string")
    assert df.where(problems.range_filter("2:4")).count() == 2 and df.where(problems.range_filter("all")).count() == 12
    assert sorted(r.idx for r in problems.pick_rows(df, "1,3,3,10-99").collect()) == [1, 3, 3, 10, 11]


def scanned_boxes(t):
    """Boxes by scanning: a command, its first brace, the brace that closes it; on without one."""
    out, at = [], 0
    while True:
        found = [i for i in (t.find("\\boxed", at), t.find("\\fbox", at)) if i >= 0]
        if not found:
            return out
        start, depth, end = min(found), 0, None
        for i in range(start, len(t)):
            depth += {"{": 1, "}": -1 if depth else 0}.get(t[i], 0)
            if t[i] == "}" and depth == 0 and "{" in t[start:i]:
                end = i + 1
                break
        if end:
            out.append(t[start:end])
        at = end or start + 5


def test_boxes_at_any_depth(spark):
    from palimpsest.functions.extract import all_boxed

    deep = "\\boxed" + "{" * 9 + "x" + "}" * 9
    texts = [deep, f"a \\boxed{{1}} b {deep} \\fbox {{2}}", "\\boxed{ open \\fbox{3} and \\boxed{4", "\\boxed{a \\fbox b} \\boxed {c}", "} \\boxed x {y} }", "none", "", "\\boxed", "\\fbox{\\boxed{1}} \\boxed{\n}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string").select("i", all_boxed("t").alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: scanned_boxes(t) for i, t in enumerate(texts)} | {99: None}


def test_long_error_rates_are_estimated(spark):
    import difflib
    import random

    from palimpsest.functions import distance as D

    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh é") for _ in range(7000))
    data = [(0, "abc", "abd"), (1, long, long[:3000] + "X" + long[3000:]), (2, long, long), (3, "", ""), (4, "short", long)]
    df = spark.createDataFrame(data, "i int, a string, b string")
    out = {r.i: r for r in df.select("i", D.char_error_rate("a", "b").alias("e"), D.is_estimated("a", "b").alias("g"), D.recovered("a", "b").alias("r")).collect()}
    assert out[0].e == pytest.approx(1 / 3) and out[3].e == 0 and out[2].r and [out[i].g for i in range(5)] == [False, True, True, False, True]
    for i in (1, 4):
        assert out[i].e == pytest.approx(1 - difflib.SequenceMatcher(None, data[i][1], data[i][2]).ratio())


def test_rows_by_place(spark):
    from palimpsest.operators.relational import latest_per_key

    sparse = spark.createDataFrame([(i * 10, f"p{i}") for i in range(9)], "idx long, problem string")
    assert sorted(r.idx for r in problems.limit_rows(sparse, 3).collect()) == [0, 10, 20]
    dense = spark.range(20).withColumnRenamed("id", "idx")
    picked = sorted((r.pick, r.idx) for r in problems.pick_rows(dense, "3, 0-1000000000,3,25", 20).collect())
    assert picked == list(enumerate([3, *range(20), 3])) and problems.pick_rows(dense, "25-30").count() == 0
    runs = spark.createDataFrame([(1, None, 5), (2, 3, 9), (2, 3, 8), (2, None, 1)], "k int, at int, id int")
    assert sorted(tuple(r) for r in latest_per_key(runs, ["k"], "at", ["id"]).collect()) == [(1, None, 5), (2, 3, 8)]
    assert sorted(r.k for r in latest_per_key(runs, ["k"], "at", []).collect()) == [1, 2]
