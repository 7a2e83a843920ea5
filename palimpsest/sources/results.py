"""Result files: discovery, reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import col
from .jsonsplit import json_records
from .scratch import delete, exists, move

SUMMARY = (
    "STRUCT<accuracy:DOUBLE,accuracy_attempted:DOUBLE,correct:BIGINT,total:BIGINT,attempted:BIGINT,refusals:BIGINT,failures:BIGINT,max_token_cutoffs:BIGINT,"
    "max_model_length:BIGINT,max_tokens:BIGINT,num_distractors:INT,num_gpus:INT,n_samples:INT,temperature:DOUBLE,top_p:DOUBLE,reasoning_effort:STRING,avg_output_tokens:DOUBLE,task:STRING>"
)
RESULT_SCHEMA = (
    "id STRING, sample_idx INT, system_prompt STRING, original STRING, unmodified_original STRING, ground_truth STRING, output STRING, extracted STRING, "
    "correct BOOLEAN, output_tokens BIGINT, refusal BOOLEAN, recovered BOOLEAN, recovered_text STRING, residual_status STRING, summary " + SUMMARY
)

# What marks a file as no result.
IGNORED_PARTS = ("_raw", "jobs_", "tracking_", "batch_", "_summary_", "prompt_recovery")
IGNORED_FOLDERS = ("/not_paper/",)


def discover(spark: SparkSession, root: str, ignored_models: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, modified) of result files below root.  A listing: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    out = files.select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    for part in IGNORED_PARTS:
        out = out.where(~F.col("name").contains(part))
    for part in (*IGNORED_FOLDERS, *(f"/{m}/" for m in ignored_models)):
        out = out.where(~F.col("path").contains(part))
    return out


def parse_path(path, root: str) -> Column:
    """struct<technique, model, dataset, sub, file> of <technique>/results/<model>/<dataset>[/<sub>]/<file>
    below root; null for any other path.  Only baselines have a sub."""
    rel = F.split(F.element_at(F.split(col(path), root.rstrip("/").replace(".", "\\.") + "/"), -1), "/")
    n = F.size(rel)
    sub = F.when((F.get(rel, 0) == "baseline") & (n >= 6), F.get(rel, 4)).otherwise(F.lit(""))
    made = F.struct(F.get(rel, 0).alias("technique"), F.get(rel, 2).alias("model"), F.get(rel, 3).alias("dataset"), sub.alias("sub"), F.element_at(rel, -1).alias("file"))
    return F.when((n >= 5) & (F.get(rel, 1) == "results"), made)


def decode_technique(name, techniques: list[str]) -> Column:
    """The technique that a decode run's file name holds, else "unknown"."""
    hits = F.filter(F.array(*[F.lit(t) for t in techniques]), lambda t: F.instr(col(name), F.concat(F.lit("_"), t, F.lit("_decode_recovery_"))) > 0)
    return F.coalesce(F.get(hits, 0), F.lit("unknown"))


def model_id(folder) -> Column:
    """The first _ of a model's folder is /, but for hosted models."""
    m = col(folder)
    return F.when(F.lower(m).rlike("gpt|claude|gemini"), m).otherwise(F.regexp_replace(m, "^([^_]*)_", "$1/"))


def read_results(spark: SparkSession, path, schema: str = RESULT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, summaries) of JSON result files of any of three shapes: a list, {"results": [...]} or a
    map of rows; pos orders the rows of a file.  The summary object at a list's end is no row.  Files are
    split between tasks (see jsonsplit)."""
    record = F.from_json("text", f"STRUCT<{_as_struct(schema)}>").alias("r")
    rows = json_records(spark, path).select("path", "pos", record).select("path", "pos", "r.*")
    return rows.where("summary IS NULL").drop("summary"), rows.where("summary IS NOT NULL").select("path", "summary.*")


def _as_struct(ddl: str) -> str:
    """Column DDL as struct fields."""
    out, depth = [], 0
    for part in ddl.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def write_results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows and the one-row summary as two folders below path."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    rows.write.mode("append").json(path)


def grade_from_checkpoint(raw: DataFrame, grade, raw_path: str, graded_path: str) -> DataFrame:
    """Raw rows are written before they are graded (``grade`` is a function of a DataFrame), so a
    failure while grading loses no output; once the graded rows are written the raw ones go."""
    spark = raw.sparkSession
    if not exists(spark, f"{raw_path}/_SUCCESS"):
        raw.write.mode("overwrite").parquet(raw_path)
    grade(spark.read.schema(raw.schema).parquet(raw_path)).write.mode("overwrite").parquet(graded_path)
    delete(spark, raw_path)
    return spark.read.parquet(graded_path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """S13"""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, dropped: tuple[str, ...] = ("problem_scores",)) -> None:
    """S14"""
    rows.drop(*dropped).write.mode("overwrite").json(path)


def custom_id(id_, sample) -> Column:
    return F.concat_ws("_", col(id_).cast("string"), F.coalesce(col(sample), F.lit(0)).cast("string"))


def encode_requests(jobs: DataFrame, provider: str, model: str, max_tokens: int | None = None, temperature: float = 0.6, top_p: float = 0.95, cached: str | None = None) -> DataFrame:
    """(custom_id, request), one JSON line a job of ``jobs(id, sample_idx, messages)``; provider is openai,
    anthropic, google or google_vertex.  ``cached`` names a context cache of google's, which holds the
    system prompt, so requests leave that out."""
    key = custom_id("id", "sample_idx").alias("custom_id")
    msgs = F.col("messages")
    lit = lambda x, n: F.lit(x).alias(n)
    if provider == "openai":
        fields = [lit(model, "model"), msgs.alias("messages")]
        if "o1" in model.lower() or "gpt-5" in model.lower():
            fields += [lit(max_tokens, "max_completion_tokens")] if max_tokens else []
            fields += [lit("xhigh", "reasoning_effort")] if "gpt-5" in model.lower() else []
        else:
            fields += [lit(max_tokens, "max_tokens")] if max_tokens else []
            fields += [lit(temperature, "temperature"), lit(top_p, "top_p")]
        body = F.struct(key, lit("POST", "method"), lit("/v1/chat/completions", "url"), F.struct(*fields).alias("body"))
    elif provider == "anthropic":
        system = F.coalesce(F.try_element_at(F.filter(msgs, lambda m: m["role"] == "system"), F.lit(-1))["content"], F.lit(""))
        rest = F.filter(msgs, lambda m: m["role"] != "system")
        params = F.struct(lit(model, "model"), lit(max_tokens, "max_tokens"), system.alias("system"), rest.alias("messages"), F.struct(lit("adaptive", "type")).alias("thinking"), F.struct(lit("max", "effort")).alias("output_config"))
        body = F.struct(key, params.alias("params"))
    elif provider in ("google", "google_vertex"):
        role = lambda m: F.when(m["role"] == "assistant", "model").otherwise(m["role"])
        contents = F.transform(F.filter(msgs, lambda m: m["role"] != "system"), lambda m: F.struct(role(m).alias("role"), F.array(F.struct(m["content"].alias("text"))).alias("parts")))
        system = F.try_element_at(F.filter(msgs, lambda m: m["role"] == "system"), F.lit(-1))["content"]
        parts = F.when(system.isNotNull(), F.struct(F.array(F.struct(system.alias("text"))).alias("parts")))
        config = [lit(temperature, "temperature"), lit(max_tokens, "max_output_tokens")]
        if provider == "google_vertex":
            config = [config[0], lit(top_p, "top_p"), config[1], F.struct(lit("HIGH", "thinking_level")).alias("thinking_config")]
        first = lit(cached, "cached_content") if cached and provider == "google" else parts.alias("system_instruction")
        request = F.struct(contents.alias("contents"), F.struct(*config).alias("generation_config"), first)
        body = F.struct(request.alias("request"), key.alias("id"))
    else:
        raise ValueError(f"unknown provider: {provider}")
    return jobs.select(key, F.to_json(body).alias("request"))


_OPENAI = "custom_id STRING, response STRUCT<body:STRUCT<choices:ARRAY<STRUCT<finish_reason:STRING,message:STRUCT<content:STRING>>>>>, error STRING"
_ANTHROPIC = "custom_id STRING, result STRUCT<type:STRING,message:STRUCT<stop_reason:STRING,content:ARRAY<STRUCT<type:STRING,text:STRING,thinking:STRING>>>,error:STRING>"
_GOOGLE = "id STRING, request STRUCT<id:STRING>, response STRUCT<candidates:ARRAY<STRUCT<finishReason:STRING,content:STRUCT<parts:ARRAY<STRUCT<text:STRING>>>>>>, error STRING"


def decode_results(lines: DataFrame, provider: str) -> DataFrame:
    """(custom_id, position, output, is_refusal) from ``lines(value[, position])`` of a provider's batch
    results; blank lines go.  Errors and refusals become texts that start with ERROR."""
    position = F.col("position") if "position" in lines.columns else F.lit(None).cast("bigint")
    lines = lines.where(F.trim("value") != "")
    error = lambda e: F.concat(F.lit("ERROR: "), F.coalesce(e, F.lit("Unknown error")))
    if provider == "openai":
        r = lines.select(F.from_json("value", _OPENAI).alias("r"), position.alias("position"))
        first = F.get(F.col("r.response.body.choices"), 0)
        refused = F.coalesce(first["finish_reason"] == "content_filter", F.lit(False))
        text = F.when(refused, "ERROR: Refused by content filter").when(F.col("r.response.body.choices").isNotNull(), first["message"]["content"]).otherwise(error(F.col("r.error")))
        return r.select(F.col("r.custom_id").alias("custom_id"), "position", text.alias("output"), refused.alias("is_refusal"))
    if provider == "anthropic":
        r = lines.select(F.from_json("value", _ANTHROPIC).alias("r"), position.alias("position"))
        ok = F.coalesce(F.col("r.result.type") == "succeeded", F.lit(False))
        refused = ok & F.coalesce(F.col("r.result.message.stop_reason") == "refusal", F.lit(False))
        blocks = F.filter(F.coalesce(F.col("r.result.message.content"), F.expr("array()").cast("ARRAY<STRUCT<type:STRING,text:STRING,thinking:STRING>>")), lambda b: b["type"].isin("text", "thinking"))
        texts = F.transform(blocks, lambda b: F.coalesce(F.when(b["type"] == "text", b["text"]).otherwise(b["thinking"]), F.lit("")))
        empty = F.coalesce(F.size("r.result.message.content"), F.lit(0)) <= 0
        text = (
            F.when(~ok, error(F.col("r.result.error")))
            .when(refused, "ERROR: Refused by model safety filter")
            .when(empty, "ERROR: Empty content block in Anthropic response")
            .when(F.size(texts) == 0, "ERROR: No text or thinking blocks found in Anthropic response")
            .otherwise(F.array_join(texts, "\n\n"))
        )
        return r.select(F.col("r.custom_id").alias("custom_id"), "position", text.alias("output"), refused.alias("is_refusal"))
    if provider == "google":
        r = lines.select(F.from_json("value", _GOOGLE).alias("r"), position.alias("position"))
        first = F.get(F.col("r.response.candidates"), 0)
        reason = first["finishReason"]
        refused = F.coalesce(reason.isin("SAFETY", "RECITATION", "BLOCKLIST"), F.lit(False))
        content = F.get(first["content"]["parts"], 0)["text"]
        text = (
            F.when(refused, F.concat(F.lit("ERROR: Refused by safety filter ("), reason, F.lit(")")))
            .when(F.col("r.response.candidates").isNotNull(), F.coalesce(content, F.lit("ERROR: Could not parse nested candidate response")))
            .when(F.col("r.error").isNotNull(), error(F.col("r.error")))
            .otherwise("ERROR: No response found")
        )
        key = F.coalesce(F.when(F.col("r.request.id") != "", F.col("r.request.id")), F.col("r.id"))
        return r.select(key.alias("custom_id"), "position", text.alias("output"), refused.alias("is_refusal"))
    raise ValueError(f"unknown provider: {provider}")


GRADED = "COMPLETED_AND_GRADED"


def active_batches(tracking: DataFrame) -> DataFrame:
    """The latest record of each batch that is not graded yet."""
    w = Window.partitionBy("batch_id").orderBy(F.col("timestamp").desc())
    return tracking.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").where(F.coalesce("status", F.lit("")) != GRADED)


def batch_done(status) -> Column:
    """S18"""
    return F.coalesce(F.lower(col(status)).rlike("completed|ended|succeeded"), F.lit(False))


def infer_provider(model) -> Column:
    """Null for a model of no known provider."""
    m = F.lower(col(model))
    return F.when(m.contains("gemini"), "google").when(m.contains("claude"), "anthropic").when(m.contains("gpt") | m.contains("o1"), "openai")


# How a layer's line of the log reads.
_LAYER = r"Layer\s+(\d+) Averages - System:\s*([\d.]+)%, DistractorPre:\s*([\d.]+)%, TargetStmt:\s*([\d.]+)%, DistractorPost:\s*([\d.]+)%, Target:\s*([\d.]+)%"
REGIONS = ("system", "distractor_pre", "target_stmt", "distractor_post", "target")


def parse_attention_log(lines: DataFrame) -> DataFrame:
    """(file, sample, layer, region, pct) from ``lines(file, n, value)``: layer lines inside sample blocks;
    n orders the lines of a file."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.regexp_extract("value", r"=== SAMPLE (\d+)", 1)
    own = lines.withColumn("sample", F.last(F.when(mark != "", mark.try_cast("int")), ignorenulls=True).over(w))
    hit = own.where(F.col("sample").isNotNull() & F.col("value").rlike(_LAYER))
    regions = F.array(*[F.struct(F.lit(r).alias("region"), F.regexp_extract("value", _LAYER, i + 2).cast("double").alias("pct")) for i, r in enumerate(REGIONS)])
    return hit.select("file", "sample", F.regexp_extract("value", _LAYER, 1).cast("int").alias("layer"), F.inline(regions))


def resume_point(lines: DataFrame) -> DataFrame:
    """(file, last) the last sample block that a separator line closes."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.regexp_extract("value", r"=== SAMPLE (\d+)", 1)
    own = lines.withColumn("sample", F.last(F.when(mark != "", mark.try_cast("int")), ignorenulls=True).over(w))
    return own.where(F.col("value").rlike("^(=+|-{5,})$")).groupBy("file").agg(F.max("sample").alias("last"))


def percent(x) -> Column:
    """A rate as a percentage with two decimals, empty for null."""
    return F.coalesce(F.format_string("%.2f", 100 * col(x)), F.lit(""))


def text_report(rows: DataFrame, widths: dict[str, int], order: str) -> DataFrame:
    """(n, line) of a table in plain text: a head (n = 0) and one line a row in order; columns are
    padded to their widths, to the left where negative.  For reports: one row a run or model."""
    pad = lambda c, w: F.rpad(c, -w, " ") if w < 0 else F.lpad(c, w, " ")
    cells = [pad(F.coalesce(F.col(c).cast("string"), F.lit("")), w) for c, w in widths.items()]
    body = rows.select((F.row_number().over(Window.orderBy(order))).cast("bigint").alias("n"), F.concat_ws("  ", *cells).alias("line"))
    head = "  ".join(c.ljust(-w) if w < 0 else c.rjust(w) for c, w in widths.items())
    return rows.sparkSession.createDataFrame([(0, head)], "n bigint, line string").unionByName(body)


def run_timestamp(name) -> Column:
    """The %Y%m%d_%H%M%S stamp at the end of a run's name."""
    return F.try_to_timestamp(F.regexp_extract(F.regexp_replace(col(name), r"\.json$", ""), r"(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))
