"""Small tables on which a query once differed from its SQL."""

from datetime import datetime

import duckdb

from palimpsest.plans import catalogue


def both(spark, sf, name):
    """Rows of a query and of its SQL over the tables in sf, sorted."""
    db = duckdb.connect()
    for file in sf.glob("*.parquet"):
        db.execute(f"create view {file.stem} as from read_parquet('{file}{'/*.parquet' if file.is_dir() else ''}')")
    cursor = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    rows = catalogue.queries()[name](spark, str(sf)).select(*columns).collect()
    return sorted(tuple(r) for r in rows), sorted(cursor.fetchall())


def test_cache_age_is_rounded(spark, tmp_path):
    # 32.41 * 100 is a little less than 3241
    rows = [(i, datetime(2026, 1, 1), v) for i, v in enumerate([32.41, 32.4, 32.39, 0.0, 560.21, 32.405, None])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got, expected = both(spark, tmp_path, "z05_cache_expired")
    assert got == expected and dict(got)[0] is True and dict(got)[1] is False


NAMES = ["so Our and Our and Our", "an Löour here, and Eton, by Eton", "an élour, Etonä, and Zürich with Etoné", "Über Eton and Über, Eton ÄEton"]


def test_names_end_at_ascii(spark, tmp_path):
    # where a letter is not ASCII a word ends, as \b has it in SQL: "our" of "Löour" is a word
    spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, expected = both(spark, tmp_path, "t20_learned_names")
    assert got == expected and [r[0] for r in got] == ["Eton"]


def test_mentions_end_at_ascii(spark, tmp_path):
    spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, expected = both(spark, tmp_path, "t20_name_mentions")
    assert got == expected == [(1, "Eton"), (2, "Eton"), (3, "Eton")]
