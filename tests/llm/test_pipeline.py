"""The pipeline's stages keep clean documents and take effect, each on its own input."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    clean = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta eta theta iota{i} kappa{i}\nsecond line {i} of words", "en", "s0", 0) for i in range(12)]
    item = "who wrote the long book about the small green island in the cold northern sea"
    copy = " ".join(f"same{j}" for j in range(40))
    extra = [(100, copy, "en", "s0", 0), (101, copy + " tail", "en", "s1", 0), (102, f"before it {item} after it", "en", "s1", 0), (103, "123 456", "en", "s1", 0), (104, None, None, None, None)]
    spark.createDataFrame(clean + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert name == "mix" or docs.columns == columns
    every = {r[0] for r in clean}
    assert kept["language_id"] == every | {100, 101, 102}
    assert kept["line_dedup"] == kept["language_id"]
    assert kept["near_dedup"] == every | {100, 102}
    assert kept["decontaminate"] == every | {100}
    assert kept["mix"] <= kept["decontaminate"] and docs.where("copies < 1").count() == 0


def test_run_is_the_stages_in_turn(spark, tmp_path):
    """run() on a table with copies, shared blocks, a benchmark passage, nulls and an extra column."""
    import random

    rng = random.Random(3)
    words = ["able", "brown", "cloud", "during", "early", "found", "great", "house", "island", "journey", "kitchen", "little", "morning", "number", "other", "people"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(n))
    block = "\n".join(text(6) for _ in range(12))
    item, base = text(30), text(80)
    rows = [(i, text(40), "en", f"s{i % 3}", 0, i) for i in range(30)]
    rows += [(50, base, "en", "s0", 0, 1), (51, base, "en", "s1", 0, 1), (52, base + " tail", "en", "s1", 0, 1)]
    rows += [(60, text(9) + "\n" + block, "en", "s0", 0, 1), (61, text(30) + "\n" + block + "\n" + text(9), "en", "s0", 0, 1)]
    rows += [(70, text(9) + " " + item + " " + text(9), "en", "s2", 0, 1), (71, None, None, None, None, 1), (72, "", "en", "s0", 0, 1), (None, text(40), "en", "s0", 0, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lost long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=str)
    docs, lost = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema + (", copies int" if name == "mix" else ""))
        lost[name] = {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()}
        if name == "line_dedup":
            cut = {r.doc_id: r for r in after.collect()}
            assert cut[60].text.endswith(block) and len(cut[61].text) < len(rows[34][1]) - len(block) // 2 and cut[61].n_chars == len(cut[61].text)
            assert cut[3].text == rows[3][1] and cut[3].lost == 3
        docs = after
    assert (lost["language_id"], lost["line_dedup"], lost["near_dedup"], lost["decontaminate"]) == ({71, 72}, set(), {51, 52}, {70})
    assert got == sorted(docs.collect(), key=str) and None in {r.doc_id for r in got} | lost["mix"]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
