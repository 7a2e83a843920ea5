"""Records of JSON files cut at any byte: the same as those of a whole parse."""

import json
import random

import pytest

from palimpsest.sources import jsonsplit, results


def rows(rng, n):
    word = lambda: "".join(rng.choice('ab {}[]",:\\\n\té数') for _ in range(rng.randrange(12)))
    return [{"id": str(i), "output": word(), "correct": rng.random() < 0.5, "nested": {"a": [{"b": word()}, {}], word() + "k": {}}} for i in range(n)]


@pytest.mark.parametrize("size", ["53b", "1m"])
def test_split_anywhere(spark, tmp_path, size):
    rng, want = random.Random(3), {}
    for k, indent in enumerate([None, 2]):
        data = rows(rng, 12)
        shapes = {"list": [*data, {"summary": {"accuracy": 0.5}}], "wrapped": {"results": data, "metadata": {"x": {"y": 1}}, "more": {}}, "map": {f'k"{i}{{[': r for i, r in enumerate(data)}}
        for name, value in shapes.items():
            (tmp_path / f"{name}{k}.json").write_text(json.dumps(value, indent=indent, ensure_ascii=k % 2 == 0))
            want[f"{name}{k}.json"] = value if name == "list" else data
    for name, text in {"none.json": "[]", "blank.json": " \n", "empty.json": "", "object.json": "{}", "hollow.json": '{"results": [], "metadata": {"a": {}}}', "one.json": '[{"id": "1"}]'}.items():
        (tmp_path / name).write_text(text)
    want["one.json"] = [{"id": "1"}]
    for key, value in {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}.items():
        spark.conf.set(key, value)
    try:
        got = {}
        for r in jsonsplit.json_records(spark, str(tmp_path)).collect():
            got.setdefault(r.path.split("/")[-1], []).append((r.pos, r.text))
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert {name: [json.loads(t) for _, t in sorted(found)] for name, found in got.items()} == want


def test_many_tasks_read_one_file(spark, tmp_path):
    data = [{"id": str(i), "output": "x" * 50 + "{", "correct": i % 2 == 0} for i in range(500)]
    (tmp_path / "big.json").write_text(json.dumps([*data, {"summary": {"accuracy": 0.5, "max_tokens": 9}}]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got, summary = results.read_results(spark, str(tmp_path))
        assert jsonsplit.json_records(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r.id, r.correct) for r in got.collect()) == sorted((d["id"], d["correct"]) for d in data)
        assert [r.id for r in got.orderBy("pos").collect()] == [d["id"] for d in data]
        assert [(r.accuracy, r.max_tokens) for r in summary.collect()] == [(0.5, 9)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
