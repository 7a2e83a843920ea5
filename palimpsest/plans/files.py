"""Queries of the result-file sources and sinks: each writes to the shared folder, reads back and
returns what it read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import results as S
from ..sources.scratch import folder
from ..streaming import recorded as Z
from .analytics import G_SQL, WG, cube, graded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _at(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows in the shape of a result file; a run is a technique."""
    return graded(spark, sf).select("technique", F.col("doc_id").cast("string").alias("id"), F.col("model").alias("original"), "extracted", "correct", F.col("tokens").alias("output_tokens"))


_ROWS_SQL = WG + "select technique, doc_id::varchar id, model original, extracted, correct, tokens output_tokens from g"


@query("s06_read_results", WG + "select technique, doc_id::varchar id, model original, extracted, correct, tokens output_tokens, count(*) over (partition by technique) total from g")
def read_results(spark: SparkSession, sf: str) -> DataFrame:
    """Runs as files of the three shapes, in turn, written line by line; the summary of a list is joined back
    by its file."""
    row = F.to_json(F.struct("id", "original", "extracted", "correct", "output_tokens"))
    w = Window.partitionBy("technique").orderBy("id")
    last = F.lead("id").over(w).isNull()
    lines = _rows(spark, sf).select("technique", "id", row.alias("row"), F.row_number().over(w).alias("n"), last.alias("last"))
    shape = F.crc32(F.col("technique").cast("binary")) % 3
    head = F.when(F.col("n") > 1, "").when(shape == 0, "[").when(shape == 1, '{"results":[').otherwise("{")
    own = F.when(shape == 2, F.concat(F.lit('"'), "id", F.lit('":'), "row")).otherwise(F.col("row"))
    summary = F.concat(F.lit(',{"summary":{"total":'), F.col("n").cast("string"), F.lit("}}]"))
    tail = F.when(~F.col("last"), ",").when(shape == 0, summary).when(shape == 1, F.concat(summary, F.lit(',"metadata":{}}'))).otherwise("}")
    at = _at(spark, "s06")
    lines.select("technique", F.concat(head, own, tail).alias("value")).write.partitionBy("technique").text(at)
    rows, totals = S.read_results(spark, f"{at}/*")
    run = F.regexp_extract("path", "technique=([^/]+)/", 1).alias("technique")
    counted = rows.select(run, "id", "original", "extracted", "correct", "output_tokens")
    told = totals.select(run, F.col("total").alias("_told"))
    out = counted.withColumn("_n", F.count("*").over(Window.partitionBy("technique"))).join(told, "technique", "left")
    return out.withColumn("total", F.coalesce("_told", "_n")).drop("_told", "_n")


@query("s07_discover", WG + "select distinct coalesce(technique, 'none') technique, coalesce(model, 'none') model, 'd' dataset, '' sub from g where coalesce(model, 'none') > (select min(coalesce(model, 'none')) from g)")
def discover(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of the graded table as files in folders by technique and model; one model's are ignored."""
    at, raw = _at(spark, "s07"), _at(spark, "s07-raw")
    rows = _rows(spark, sf).select(F.coalesce("technique", F.lit("none")).alias("technique"), F.coalesce("original", F.lit("none")).alias("model"), "id", "correct")
    rows.repartition("technique", "model").write.partitionBy("technique", "model").json(raw)
    runs = [tuple(r) for r in spark.read.json(raw).select("technique", "model").distinct().collect()]
    for technique, model in runs:
        S.move(spark, f"{raw}/technique={technique}/model={model}", f"{at}/{technique}/results/{model}/d")
    found = S.discover(spark, at, ignored_models=(min(m for _, m in runs),) if runs else ())
    return found.select(S.parse_path("path", at.removeprefix("file://")).alias("p")).select("p.technique", "p.model", "p.dataset", "p.sub").distinct()


@query("s10_write_results", _ROWS_SQL + " union all select 'summary', null, null, null, null, count(*) from g")
def write_results(spark: SparkSession, sf: str) -> DataFrame:
    at, rows = _at(spark, "s10"), _rows(spark, sf)
    S.write_results(rows, rows.agg(F.count("*").alias("output_tokens")), at)
    back = spark.read.schema(rows.schema).json(f"{at}/rows")
    return back.unionByName(spark.read.schema("output_tokens bigint").json(f"{at}/summary").withColumn("technique", F.lit("summary")), allowMissingColumns=True)


@query("s11_raw_then_graded", WG + "select technique, doc_id::varchar id, correct, false raw_left from g")
def raw_then_graded(spark: SparkSession, sf: str) -> DataFrame:
    """Raw outputs are written first, graded from there, and deleted once the graded rows are written."""
    at = _at(spark, "s11")
    out = S.grade_from_checkpoint(_rows(spark, sf).drop("correct"), lambda raw: raw.join(_rows(spark, sf).select("technique", "id", "correct"), ["technique", "id"]), f"{at}/raw", f"{at}/graded")
    return out.select("technique", "id", "correct", F.lit(S.exists(spark, f"{at}/raw")).alias("raw_left"))


@query("s12_append_rows", _ROWS_SQL + " union all " + _ROWS_SQL.removeprefix("with " + G_SQL))
def append_rows(spark: SparkSession, sf: str) -> DataFrame:
    at, rows = _at(spark, "s12"), _rows(spark, sf)
    S.append_rows(rows, at)
    S.append_rows(rows, at)
    return spark.read.schema(rows.schema).json(at)


@query("s13_write_csv", WG + "select technique, doc_id::varchar id, tokens::varchar output_tokens from g")
def write_csv(spark: SparkSession, sf: str) -> DataFrame:
    at = _at(spark, "s13")
    S.write_csv(_rows(spark, sf), at, ["technique", "id", "output_tokens"])
    return spark.read.option("header", True).csv(at)


@query("s14_write_json", _ROWS_SQL)
def write_json(spark: SparkSession, sf: str) -> DataFrame:
    at, rows = _at(spark, "s14"), _rows(spark, sf)
    S.write_json(rows.withColumn("problem_scores", F.map_from_arrays(F.array("id"), F.array(F.lit(1.0)))), at)
    back = spark.read.json(at)
    return back.select(*rows.columns, *[c for c in back.columns if c not in rows.columns])


@query("s22_resume_point", "select 'log' || doc_id file, (n_chars % 6 + 1)::int last from documents")
def resume_point(spark: SparkSession, sf: str) -> DataFrame:
    """A log a document: as many closed sample blocks as its length says, and one that is still open."""
    k, n = F.col("n_chars") % 6 + 1, F.col("n")
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * k)).alias("n"))
    value = F.when(n % 2 == 0, F.format_string("=== SAMPLE %d DILUTION SUMMARY", F.floor(n / 2) + 1)).otherwise("-" * 20)
    return S.resume_point(lines.select(F.format_string("log%d", "doc_id").alias("file"), "n", value.alias("value")))


@query("s23_report", WG + "select 'model  total  correct' line, 0::bigint n union all select rpad(model, 5, ' ') || '  ' || lpad(count(*)::varchar, 5, ' ') || '  ' || lpad(count(*) filter (correct)::varchar, 7, ' '), row_number() over (order by model) from g where model is not null group by model")
def report(spark: SparkSession, sf: str) -> DataFrame:
    counts = graded(spark, sf).where("model is not null").groupBy("model").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return S.text_report(counts, {"model": -5, "total": 5, "correct": 7}, "model")


@query("k03_summary_order", WG + ", m as (select distinct model, technique from g) select model, technique, row_number() over (order by model nulls first, technique nulls first) rank from m")
def summary_order(spark: SparkSession, sf: str) -> DataFrame:
    runs = cube(spark, sf).select("model", F.lit("d").alias("dataset"), F.col("technique").alias("condition"))
    ordered = R.ordered_summaries(runs)
    # a registry of runs: one row each
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy("model", "dataset", "condition")).cast("bigint")).select("model", F.col("condition").alias("technique"), "rank")


@query("z01_agent_loop", "select conv_id id, case when conv_id % 2 = 0 then conv_id::varchar end answer, case when conv_id % 2 = 0 then 1 else 2 end steps from (select distinct conv_id from conversations)")
def agent_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Even conversations box an answer at once, odd ones send code until the steps are used up."""
    ids = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("id")).distinct()
    replies = ids.select("id", F.when(F.col("id") % 2 == 0, F.format_string("so \\boxed{%d}", "id")).otherwise("```python\nprint(1)\n```").alias("reply"))
    out = Z.agent_loop(ids.withColumn("history", F.array(F.lit("q"))), Z.TableGenerator(replies), max_steps=2)
    return out.select("id", "answer", F.col("steps").cast("int").alias("steps"))


@query("z05_cache_expired", "select event_id, (value * 100)::bigint > 0.9 * 3600 x from events")
def cache_expired(spark: SparkSession, sf: str) -> DataFrame:
    age = F.rint(F.col("value") * 100).cast("bigint")  # SQL's cast rounds, Spark's cuts off
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", Z.cache_expired(age, F.lit(3600)).alias("x"))


@query("z06_resume", WG + "select technique, doc_id::varchar id from g where doc_id % 3 <> 0")
def resume(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after a run that had appended a third of its rows."""
    at, rows = _at(spark, "z06"), _rows(spark, sf)
    S.append_rows(rows.where("id % 3 = 0"), at)
    return R.not_done(rows, spark.read.schema(rows.schema).json(at), "id").select("technique", "id")
