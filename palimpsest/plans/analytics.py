"""Queries of the analytics operators over graded results built from ``documents`` and ``labels``:
correct = quality 1, refusal = toxic 1, technique = source, model = lang, problem = doc_id mod 97."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import figures
from ..operators import metrics as A
from ..operators import relational as R
from ..operators import stats as Q
from ..sources import results as S
from ..sources.scratch import folder
from ..streaming import keyed as K
from ..streaming import recorded as Z
from .texts import OUT_SQL, WORDS, outputs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


G_SQL = """g as (
  select d.doc_id, d.source technique, d.lang model, d.doc_id % 97 id, l.quality = 1 correct, l.toxic = 1 refusal, d.n_chars tokens,
    case when d.n_chars % 7 = 0 then null when d.n_chars % 11 = 0 then 'ERROR: x' else 'v' end extracted, d.text output
  from documents d join labels l using (doc_id))"""


def graded(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    extracted = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 11 == 0, "ERROR: x").otherwise("v")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.col("source").alias("technique"), F.col("lang").alias("model"), (F.col("doc_id") % 97).alias("id"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("refusal"), n.alias("tokens"), extracted.alias("extracted"), F.col("text").alias("output"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


KEYS = ["technique", "model"]
WG = "with " + G_SQL + " "
_R = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0), 6)"



def _boot_sql(rows: str, keys: str, draws: int = 10000, seed: int = 42) -> str:
    """CTE ``boot(keys, n, mean, low, high)`` from ``rows(keys, id, score)``, by the rule of Q.draw_pick."""
    p, lo, hi = Q.PRIME, int(0.025 * (draws - 1)) + 1, int(0.975 * (draws - 1)) + 1
    return f"""ba as (select {keys}, list(score order by id) s from {rows} group by all),
bd as (select d, ('0x' || substring(md5('{seed}|' || d), 1, 8))::bigint % {p} b from (select unnest(range(0, {draws})) d)),
bu as (select {keys}, s, d, list_transform(range(0, len(s)), lambda i: (b + i * {Q.STEP}) % {p}) us from ba, bd),
bm as (select {keys}, s, d, list_sum(list_transform(us, lambda u: s[((((u * u + 1) % {p}) * ((u * u + 1) % {p}) + u) % {p}) % len(s) + 1])) / len(s) v from bu),
bt as (select {keys}, any_value(s) s, list_sort(list(v)) v from bm group by all),
boot as (select {keys}, len(s)::int n, list_sum(s) / len(s) mean, case when len(s) > 1 then v[{lo}] else s[1] end low, case when len(s) > 1 then v[{hi}] else s[1] end high from bt)"""


query("a01_run_summary", WG + f"select technique, model, count(*) total, count(*) filter (correct) n_correct, count(*) filter (extracted like 'ERROR%') failures, count(*) filter (tokens >= 0.98 * 3000) cutoffs, {_R('count(*) filter (correct)', 'count(*)')} accuracy from g group by all")(
    lambda spark, sf: rounded(A.run_summary(graded(spark, sf), KEYS, F.lit("3000")), "accuracy")
)
query("a02_batch_summary", WG + f"select technique, model, count(*) total, count(*) filter (correct) n_correct, count(*) filter (refusal) refusals, count(*) filter (contains(extracted, 'ERROR')) failures, count(*) - count(*) filter (refusal) attempted, {_R('count(*) filter (correct)', 'count(*)')} accuracy, {_R('count(*) filter (correct)', '(count(*) - count(*) filter (refusal))')} accuracy_attempted from g group by all")(
    lambda spark, sf: rounded(A.batch_summary(graded(spark, sf), KEYS), "accuracy", "accuracy_attempted")
)
_SUS = r"(not correct and trim(output, ' ' || chr(10)) <> '' and right(trim(output, ' ' || chr(10)), 1) not in ('.', '!', '?', '}', '>', ']'))"
query("a03_file_analysis", WG + f", p as (select model, id, count(*) n, count(*) filter (correct) c, count(*) filter (extracted is null and not correct) f, max(length(output)) l, count(*) filter ({_SUS}) t from g group by all) select model, sum(n)::bigint total, sum(c)::bigint n_correct, sum(f)::bigint extraction_failures, max(l)::int max_output_length, sum(t)::bigint truncation_suspects, round(avg(c / n), 6) mean_pass_rate, {_R('sum(c)', 'sum(n)')} accuracy from p group by model")(
    lambda spark, sf: rounded(A.file_analysis(graded(spark, sf), ["model"]), "mean_pass_rate", "accuracy")
)
query("a04_output_lengths", WG + f"select technique, model, {_R('count(*) filter (correct)', 'count(*)')} accuracy, round(coalesce(avg(tokens) filter (output <> ''), 0), 4) length, {_R('count(*) filter (extracted is null and not correct)', 'count(*)')} failure_rate, {_R('count(*)', 'count(distinct id)')} n_samples from g group by all")(
    lambda spark, sf: rounded(rounded(A.output_lengths(graded(spark, sf), KEYS), "accuracy", "failure_rate", "n_samples"), "length", digits=4)
)
_STATUS = ["recovered", "partial_or_other", "missing_recovered_tags"]


def _decoded(spark, sf):
    s = F.element_at(F.array(*[F.lit(x) for x in _STATUS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return graded(spark, sf).withColumn("residual_status", s).withColumns({"recovered": F.col("residual_status") == "recovered", "exact_normalized_match": F.col("doc_id") % 6 == 0, "has_recovered_tags": F.col("residual_status") != "missing_recovered_tags", "char_error_rate_estimated": F.col("tokens") > 6000})


query("a05_decode_summary", WG + f", s as (select *, ['{_STATUS[0]}', '{_STATUS[1]}', '{_STATUS[2]}'][doc_id % 3 + 1] s from g), c as (select model, s, count(*) n from s group by all) select model, sum(n)::bigint total, {_R('sum(n) filter (s = ' + chr(39) + 'recovered' + chr(39) + ')', 'sum(n)')} recovery_rate, (select {_R('count(*) filter (doc_id % 6 = 0)', 'count(*)')} from s where s.model = c.model) exact_rate, (coalesce(sum(n) filter (s = 'missing_recovered_tags'), 0))::bigint missing_tags, (select count(*) filter (tokens > 6000) from s where s.model = c.model) estimated_cer_count, (select count(*) filter (tokens >= 2940) from s where s.model = c.model) max_token_cutoffs, string_agg(s || '=' || n, ',' order by s) counts from c group by model")(
    lambda spark, sf: rounded(A.decode_summary(_decoded(spark, sf), ["model"], F.lit("3000")), "recovery_rate", "exact_rate").withColumn("counts", F.array_join(F.transform(F.map_entries("residual_status_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")).drop("residual_status_counts")
)
query("a06_passive_summary", WG + f"select model, {_R('count(*) filter (correct)', 'count(*)')} accuracy, round(avg(tokens), 4) avg_tokens from g group by model")(
    lambda spark, sf: rounded(rounded(A.passive_summary(graded(spark, sf), ["model"], ["tokens"]), "accuracy"), "avg_tokens", digits=4)
)
_summary = lambda spark, sf: rounded(A.summarize_runs(graded(spark, sf).withColumn("success", F.col("correct")), KEYS, limit=F.lit("3000")), "problem_mean", "mean_samples", "rate", "wilson_low", "wilson_high", "low", "high")
_WIL = lambda s, n, sign: f"round(case when {n} >= 1 then {'greatest(0' if sign == '-' else 'least(1'}, (({s} / {n} + 1.9208 / {n}) {sign} 1.96 * sqrt(({s} / {n}) * (1 - {s} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})) end, 6)"
_A07 = WG + f", p as (select technique, model, id, count(*) n, count(*) filter (correct) s, count(*) filter (extracted is null and not correct) f from g group by all), r as (select technique, model, sum(n)::bigint total, sum(s)::bigint successes, count(*) n_problems, round(avg(s / n), 6) problem_mean, min(n) min_samples, max(n) max_samples, round(avg(n), 6) mean_samples, sum(f)::bigint failures from p group by all) select *, round(successes / total, 6) rate, {_WIL('successes', 'total', '-')} wilson_low, {_WIL('successes', 'total', '+')} wilson_high from r"
query("a07_summarize_runs", f"with {_boot_sql('z', 'technique, model').replace('ba as', G_SQL + ', z as (select technique, model, id, avg(correct::int) score from g group by all), ba as', 1)}, k as (select technique, model, count(*) filter (tokens >= 0.98 * 3000) cutoffs from g group by all) select x.*, k.cutoffs, round(boot.low, 6) low, round(boot.high, 6) high from ({_A07}) x join k using (technique, model) join boot using (technique, model)")(
    lambda spark, sf: _summary(spark, sf)
)
query("a08_conditions", "select page_id, case page_id % 4 when 0 then 'baseline:compound' when 1 then 'baseline:unknown' when 2 then 'decode_recovery:rail_fence' else 'passive_context:d3' end condition from pages")(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id",
        A.infer_condition(
            F.element_at(F.array(*[F.lit(x) for x in ("baseline", "baseline", "decode_recovery", "passive_context")]), (F.col("page_id") % 4 + 1).cast("int")),
            F.when(F.col("page_id") % 4 == 0, "compound").otherwise(""), F.lit(None).cast("string"), F.lit(3), F.lit("m_rail_fence_decode_recovery_s42.json"),
        ).alias("condition"),
    )
)
_CUBE_SQL = WG + f", c as (select technique, model, count(*) total, count(*) filter (correct) n_correct, count(*) - count(*) filter (refusal) attempted, count(*) filter (extracted is null and not correct) failures, avg(tokens) length, max(doc_id) stamp from g group by all), m as (select *, n_correct / total accuracy from c) "


def cube(spark, sf):
    out = graded(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("total"), A.count_if(F.col("correct")).alias("n_correct"), (F.count("*") - A.count_if(F.col("refusal"))).alias("attempted"), F.count_if(F.col("extracted").isNull() & ~F.col("correct")).alias("failures"), F.avg("tokens").alias("length"), F.max("doc_id").alias("stamp"))
    return out.withColumn("accuracy", A.ratio("n_correct", "total"))


query("a09_latest_metrics", _CUBE_SQL + "select model, technique, total, round(accuracy, 6) accuracy from (select *, row_number() over (partition by model order by stamp desc) rn from m) where rn = 1")(
    lambda spark, sf: rounded(A.metrics_cube(cube(spark, sf), ["model"], "stamp").select("model", "technique", "total", "accuracy"), "accuracy")
)
query("a10_pooled_metrics", _CUBE_SQL + f"select model, sum(total)::bigint total, sum(attempted)::bigint attempted, {_R('sum(n_correct)', 'sum(total)')} accuracy, {_R('sum(n_correct)', 'sum(attempted)')} accuracy_attempted, {_R('sum(failures)', 'sum(total)')} failure_rate, round(sum(length * total) / sum(total), 3) length from m group by model")(
    lambda spark, sf: rounded(rounded(A.pooled_metrics(cube(spark, sf), ["model"]), "accuracy", "accuracy_attempted", "failure_rate"), "length", digits=3)
)
query("a11_accuracy_drop", _CUBE_SQL + f"select o.model, round(avg(b.accuracy - o.accuracy), 6) mean_drop, {_R('sum(o.attempted)', 'sum(o.total)')} attempt_rate from m o join m b on o.model = b.model and b.technique = 'src0' where o.technique <> 'src0' group by o.model")(
    lambda spark, sf: rounded(A.accuracy_drop(cube(spark, sf), "src0"), "mean_drop", "attempt_rate")
)


def _categories(spark):
    return spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("technique"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("category"))


query("a12_category_means", _CUBE_SQL + ", k as (select 'src' || i technique, 'c' || i % 4 category from (select unnest(range(20)) i)) select a.model, b.category, round(coalesce(avg(m.accuracy), 0), 6) accuracy from (select distinct model from m) a cross join (select distinct category from k) b left join k on k.category = b.category left join m on m.model = a.model and m.technique = k.technique group by all")(
    lambda spark, sf: rounded(A.category_means(cube(spark, sf), _categories(spark)), "accuracy")
)
_REC = WG + ", r as (select *, doc_id % 3 = 0 recovered from g), c as (select technique, model, count(*) total, count(*) filter (recovered) n_recovered, count(*) filter (recovered and correct) n_solved from r group by all) "
_recovered = lambda spark, sf: graded(spark, sf).withColumn("recovered", F.col("doc_id") % 3 == 0)
query("a13_conditional_accuracy", _REC + f"select *, {_R('n_recovered', 'total')} recovery_rate, round(100 * coalesce(n_solved / nullif(n_recovered, 0), 0), 4) conditional_accuracy from c")(
    lambda spark, sf: rounded(rounded(A.conditional_accuracy(_recovered(spark, sf), KEYS), "recovery_rate"), "conditional_accuracy", digits=4)
)
query("a14_global_conditional", _REC + "select model, round(100 * coalesce(sum(n_solved) / nullif(sum(n_recovered), 0), 0), 4) conditional_accuracy from c where technique not in ('src0', 'src1') group by model")(
    lambda spark, sf: rounded(A.global_conditional_accuracy(A.conditional_accuracy(_recovered(spark, sf), KEYS), ("src0", "src1")), "conditional_accuracy", digits=4)
)
query("a15_by_position", WG + f", b as (select model, 1 as position, correct, tokens >= 2940 cut from g where technique = 'src0' union all select model, id % 4 + 1, correct, tokens >= 2940 from g where technique <> 'src0') select model, position::int as position, count(*) total, {_R('count(*) filter (correct)', 'count(*)')} accuracy, {_R('count(*) filter (cut)', 'count(*)')} cutoff_rate from b group by all")(
    lambda spark, sf: rounded(A.accuracy_by_position(graded(spark, sf).withColumn("cut", F.col("tokens") >= 2940).where("technique = 'src0'"), graded(spark, sf).withColumn("cut", F.col("tokens") >= 2940).withColumn("num_distractors", F.col("id") % 4).where("technique <> 'src0'")), "accuracy", "cutoff_rate")
)
_SEG = "with " + OUT_SQL + r""", n as (select doc_id, length(output) l, string_split(regexp_replace(output, '(Problem\s*\d)', chr(1) || '\1', 'g'), chr(1)) ps from o),
u as (select doc_id, l, unnest(ps) p, generate_subscripts(ps, 1) k from n), v as (select doc_id, l, p, sum(length(p)) over (partition by doc_id order by k) - length(p) st from u),
s as (select doc_id, l, regexp_extract(p, '^Problem\s*(\d+)', 1)::bigint num, st from v where regexp_matches(p, '^Problem\s*\d')),
f as (select doc_id, l, num, min(st) st from s group by all), e as (select *, coalesce(lead(st) over (partition by doc_id order by st), l) en from f) """
query("x10_segments", _SEG + "select doc_id, num, st::int as start, en::int as \"end\", round((en - st) / l, 6) as share from e")(lambda spark, sf: rounded(A.section_shares(outputs(spark, sf), ["doc_id"]), "share"))
query("a16_effort_ratio", _SEG + ", m as (select doc_id % 5 k, num, avg((en - st) / l) m from e group by all) select k, num, round(m, 6) mean_share, round(m / sum(m) over (partition by k), 6) effort from m")(
    lambda spark, sf: rounded(A.effort_ratio(A.section_shares(outputs(spark, sf), ["doc_id"]).withColumn("k", F.col("doc_id") % 5), ["k"]), "mean_share", "effort")
)
query("x11_longest_group", _SEG.replace(" e as (select", " ee as (select") + r""", g1 as (select doc_id, num, st, lead(st, 1, l) over (partition by doc_id order by st) en, lag(num) over (partition by doc_id order by st) prev from s),
g2 as (select *, sum(case when prev is not distinct from num then 0 else 1 end) over (partition by doc_id order by st) isl from g1), g3 as (select doc_id, num, isl, min(st) st, sum(en - st) len from g2 group by all)
select doc_id, st::int as start, len::int as length from (select *, row_number() over (partition by doc_id order by len desc, st) rn from g3 where num = 1) where rn = 1""")(
    lambda spark, sf: R.longest_target_group(R.contiguous_groups(outputs(spark, sf), ["doc_id"]), ["doc_id"], F.lit(1))
)
query("a17_difficulty", WG + f"select id, count(*) total, count(*) filter (not correct) failures, round(avg(tokens), 4) mean_length, {_R('count(*) filter (not correct)', 'count(*)')} failure_rate from g group by id")(
    lambda spark, sf: rounded(rounded(A.problem_difficulty(graded(spark, sf)), "failure_rate"), "mean_length", digits=4)
)
query("a18_trend", WG + ", d as (select id, avg(tokens) y, count(*) filter (not correct) / count(*) x from g group by id) select round(corr(x, y), 5) correlation, round(regr_slope(y, x), 3) slope, round(regr_intercept(y, x), 3) intercept from d")(
    lambda spark, sf: rounded(rounded(A.difficulty_trend(A.problem_difficulty(graded(spark, sf))), "correlation", digits=5), "slope", "intercept", digits=3)
)
query("a19_attention_means", "with m as (select event_id // 20 sample, (event_id % 4)::int layer, case event_type when 'click' then 'system' when 'view' then 'target' else 'other' end region, sum(value) pct from events group by all), l as (select layer, region, avg(pct) pct from m group by all), w as (select layer, region, pct from l union all select null, region, avg(pct) from l group by region) select coalesce(layer::varchar, 'avg') layer, region, round(pct, 4) pct, case when region <> 'system' then round(pct / sum(case when region <> 'system' then pct end) over (partition by layer), 5) end as share from w")(
    lambda spark, sf: rounded(rounded(A.attention_means(table(spark, sf, "events").select((F.floor(F.col("event_id") / 20)).alias("sample"), (F.col("event_id") % 4).cast("int").alias("layer"), F.col("event_type").alias("region"), F.col("value").alias("pct")).where("region is not null").withColumn("region", F.when(F.col("region").isin("click", "view"), F.col("region")).otherwise("rest")), {"click": "system", "view": "target", "rest": "other"}), "pct", digits=4), "share", digits=5).withColumn("layer", F.coalesce(F.col("layer").cast("string"), F.lit("avg")))
)
query("a20_token_usage", "select conv_id, sum(length(text)) filter (role = 'user')::bigint distractor_sum from conversations group by conv_id having count(*) filter (role = 'user') > 0")(
    lambda spark, sf: A.token_usage(table(spark, sf, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.when(F.col("role") == "user", "distractor_").otherwise("other_"), F.col("turn").cast("string")), F.length("text").cast("bigint")))).alias("usage"))).where("distractor_count > 0").select("conv_id", "distractor_sum")
)
query("a21_recovery_report", WG + f", r as (select *, doc_id % 3 = 0 recovered from g) select model, count(*) total_samples, count(*) filter (correct) original_correct, count(*) filter (correct or recovered) semantic_correct, {_R('count(*) filter (correct)', 'count(*)')} original_accuracy, {_R('count(*) filter (correct or recovered)', 'count(*)')} semantic_accuracy from r group by model")(
    lambda spark, sf: rounded(A.recovery_report(_recovered(spark, sf), ["model"]), "original_accuracy", "semantic_accuracy")
)

# --- statistics --------------------------------------------------------------------------------

query("q01_wilson", f"select doc_id, {_WIL('(doc_id % 11)', '(doc_id % 11 + n_chars % 5)', '-')} low, {_WIL('(doc_id % 11)', '(doc_id % 11 + n_chars % 5)', '+')} high from documents".replace("case when (doc_id % 11 + n_chars % 5) >= 1 then", "case when (doc_id % 11 + n_chars % 5) >= 1 then"))(
    lambda spark, sf: rounded(table(spark, sf, "documents").select("doc_id", *[x.alias(n) for x, n in zip(Q.wilson_interval(F.col("doc_id") % 11, F.col("doc_id") % 11 + F.col("n_chars") % 5), ("low", "high"))]), "low", "high")
)
_SCORES = WG + ", s as (select model, id, avg(correct::int) score from g group by all) "
_BOOT = _SCORES + ", " + _boot_sql("s", "model") + " select model, n, round(mean, 6) mean, round(low, 6) low, round(high, 6) high from boot"
query("q02_bootstrap", _BOOT)(lambda spark, sf: rounded(Q.bootstrap_mean(A.problem_scores(graded(spark, sf).withColumn("success", F.col("correct")), ["model"]), ["model"]), "mean", "low", "high"))
_TS = WG + ", s as (select technique, model, id, avg(correct::int) score from g group by all) "
_paired = lambda spark, sf: rounded(Q.paired_comparison(_score(spark, sf).where("technique = 'src1'"), _score(spark, sf).where("technique = 'src0'"), ["model"]), "mean_diff", "low", "high")
_score = lambda spark, sf: A.problem_scores(graded(spark, sf).withColumn("success", F.col("correct")), KEYS)
query("q03_paired", _TS + f""", c as (select a.model, a.id, a.score - b.score score from s a join s b on a.model = b.model and a.id = b.id where a.technique = 'src1' and b.technique = 'src0'), {_boot_sql('c', 'model')},
m as (select model, avg(score) filter (technique = 'src1') x, avg(score) filter (technique = 'src0') y from s group by model having x is not null and y is not null),
d as (select model, count(*) n, avg(score) v, count(*) filter (score > 0) u, count(*) filter (score = 0) e, count(*) filter (score < 0) w from c group by model)
select m.model, round(x, 6) a_mean, round(y, 6) b_mean, coalesce(d.n, 0) n_common, round(v, 6) mean_diff, coalesce(u, 0) better, coalesce(e, 0) same, coalesce(w, 0) worse, round(low, 6) low, round(high, 6) high
from m left join d using (model) left join boot using (model)""")(
    lambda spark, sf: rounded(_paired(spark, sf), "a_mean", "b_mean")
)
_COND = ["baseline:perturb", "baseline:compound", "compound", "passive_context:d3", "rail_fence"]
query("q04_plan", f"with r as (select distinct lang model, 'd' dataset, {_COND}[doc_id % 5 + 1] condition from documents where not (lang = 'es' and doc_id % 5 = 0)), p as (select *, unnest(case condition when 'rail_fence' then [{{'l': 'perturbation_vs_baseline', 'r': 'baseline:perturb'}}] when 'compound' then [{{'l': 'compound_vs_baseline', 'r': 'baseline:compound'}}] when 'passive_context:d3' then [{{'l': 'passive_vs_baseline', 'r': 'baseline:compound'}}, {{'l': 'passive_vs_compound', 'r': 'compound'}}] else [] end) u from r) select model, dataset, condition, u.l as label, u.r as reference, exists (select 1 from r where r.model = p.model and r.condition = p.u.r) as found from p")(
    lambda spark, sf: Q.plan_comparisons(table(spark, sf, "documents").where("not (lang = 'es' and doc_id % 5 = 0)").select(F.col("lang").alias("model"), F.lit("d").alias("dataset"), F.element_at(F.array(*[F.lit(c) for c in _COND]), (F.col("doc_id") % 5 + 1).cast("int")).alias("condition")))
)

# --- joins, windows, sets ----------------------------------------------------------------------


def _jobs(spark, sf):
    return table(spark, sf, "documents").select(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("0")).alias("custom_id"), F.col("doc_id").alias("position"))


def _outs(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(F.when(d % 5 != 0, F.concat_ws("_", d.cast("string"), F.lit("0"))).alias("custom_id"), d.alias("position"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("output"), (F.col("toxic") == 1).alias("is_refusal"))


query("j01_join_outputs", "select doc_id::varchar || '_0' custom_id, doc_id as position, coalesce('q' || quality, 'ERROR: Missing from batch results') as output, coalesce(toxic = 1 and doc_id % 5 <> 0, false) refusal from documents left join labels using (doc_id)")(lambda spark, sf: R.join_outputs(_jobs(spark, sf), _outs(spark, sf)))
query("j04_common_ids", "select doc_id from documents join labels using (doc_id)")(lambda spark, sf: table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id"))
query("j06_pick_boundary", "with o as (select user_id id, event_id pos, value boundary, row_number() over (partition by user_id order by event_id) - 1 k, count(*) over (partition by user_id) n from events where user_id % 3 <> 0), s as (select distinct user_id id, unnest(range(0, 3)) sample_idx from events), a as (select avg(boundary) m from o) select s.id, s.sample_idx::int sample_idx, round(coalesce(o.boundary, a.m), 4) boundary, o.boundary is null is_fallback from s cross join a left join (select distinct id, n from o) c on c.id = s.id left join o on o.id = s.id and o.k = s.sample_idx % c.n")(
    lambda spark, sf: rounded(R.pick_boundary(table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(2)))), table(spark, sf, "events").where("user_id % 3 <> 0").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("value").alias("boundary"))), "boundary", digits=4)
)
query("j07_label_lookup", "select doc_id, case lang when 'en' then 'English' when 'de' then 'German' else lang end label from documents")(
    lambda spark, sf: N.with_label(table(spark, sf, "documents").select("doc_id", "lang"), "lang", spark.sql("select * from values ('en', 'English'), ('de', 'German') as t(name, label)"), "label").select("doc_id", "label")
)
query("w01_latest", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) rn from events) where rn = 1")(
    lambda spark, sf: R.latest_per_key(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id")
)
query("w02_sample_number", "select event_id, (row_number() over (partition by user_id order by event_id) - 1)::int sample_idx from events")(lambda spark, sf: R.number_samples(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "sample_idx"))
query("k01_top", WG + "select id, count(*) filter (not correct) failures from g group by id order by failures desc, id limit 60")(lambda spark, sf: R.top_k(A.problem_difficulty(graded(spark, sf)).select("id", "failures"), 60, F.desc("failures"), "id"))
query("k02_model_order", _CUBE_SQL + "select model, round(avg(accuracy), 6) accuracy, row_number() over (order by avg(accuracy) desc, model) rank from m group by model")(
    lambda spark, sf: rounded(cube(spark, sf).groupBy("model").agg(F.avg("accuracy").alias("accuracy")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), "model")).cast("bigint")), "accuracy")
)
query("u01_pool", "select doc_id id, lang, null as role from documents union all select conv_id, null, role from conversations")(lambda spark, sf: R.pool(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role")))
query("u02_distinct", "select distinct lang, source from documents")(lambda spark, sf: table(spark, sf, "documents").select("lang", "source").distinct())
query("u03_intersect", "select doc_id from documents intersect select conv_id from conversations")(lambda spark, sf: table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))))
query("u04_not_done", "select doc_id from documents where doc_id not in (select doc_id from labels)")(lambda spark, sf: R.not_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id"))
query("l01_allow_lists", "select doc_id from documents where lang in ('en', 'fr') and (source = 'src3' or lang in ('src3'))")(
    lambda spark, sf: R.allow_lists(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("technique"), F.col("lang").alias("condition"), F.lit("d").alias("dataset")), models=("en", "fr"), techniques=("src3",)).select("doc_id")
)

# --- sources and streaming ---------------------------------------------------------------------

query("s08_parse_path", "select page_id, 'rail_fence' technique, 'm' || page_id model, 'd' dataset, '' sub, 'f.json' file from pages where page_id % 2 = 0 union all select page_id, 'baseline', 'm', 'd', 'perturb', 'f.json' from pages where page_id % 2 = 1")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", S.parse_path(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/runs/rail_fence/results/m"), F.col("page_id").cast("string"), F.lit("/d/f.json"))).otherwise("/runs/baseline/results/m/d/perturb/f.json"), "/runs").alias("p")).select("page_id", "p.*")
)
query("s09_names", "select page_id, case page_id % 3 when 0 then 'Qwen/Q_3' when 1 then 'gpt_5' else 'unknown' end model, case when page_id % 2 = 0 then 'rail_fence' else 'unknown' end technique from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", S.model_id(F.when(F.col("page_id") % 3 == 0, "Qwen_Q_3").when(F.col("page_id") % 3 == 1, "gpt_5").otherwise("unknown")).alias("model"), S.decode_technique(F.when(F.col("page_id") % 2 == 0, "m_rail_fence_decode_recovery_1.json").otherwise("m.json"), ["wrappers", "rail_fence"]).alias("technique"))
)
query("s15_encode_requests", """select conv_id::varchar || '_0' custom_id, '{"custom_id":"' || conv_id || '_0","method":"POST","url":"/v1/chat/completions","body":{"model":"m","messages":[{"role":"user","content":"c' || conv_id || '"}],"max_tokens":9,"temperature":0.6,"top_p":0.95}}' request from (select distinct conv_id from conversations)""")(
    lambda spark, sf: S.encode_requests(table(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.lit(0).alias("sample_idx"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("content"))).alias("messages")), "openai", "m", 9)
)


def _requests(provider, cached=None):
    """Requests of four messages a conversation, one of the system."""

    def run(spark, sf):
        said = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("content"))
        c = F.col("conv_id")
        msgs = F.array(said("system", "be brief ", c % 3), said("user", "c", c), said("assistant", "ok"), said("user", "and ", c + 1))
        jobs = table(spark, sf, "conversations").select("conv_id").distinct().select(c.alias("id"), (c % 2).cast("int").alias("sample_idx"), msgs.alias("messages"))
        return S.encode_requests(jobs, provider, "m", 9, cached=cached)

    return run


def _request_sql(body: str) -> str:
    return f"select conv_id || '_' || conv_id % 2 custom_id, {body} request from (select distinct conv_id from conversations)"


_CONTENTS = """'{"request":{"contents":[{"role":"user","parts":[{"text":"c' || conv_id || '"}]},{"role":"model","parts":[{"text":"ok"}]},{"role":"user","parts":[{"text":"and ' || conv_id + 1 || '"}]}],"generation_config":{"temperature":0.6,"""
_END = """ || '"id":"' || conv_id || '_' || conv_id % 2 || '"}'"""
_SYSTEM = """'"system_instruction":{"parts":[{"text":"be brief ' || conv_id % 3 || '"}]}},'"""
query("s15_encode_anthropic", _request_sql("""'{"custom_id":"' || conv_id || '_' || conv_id % 2 || '","params":{"model":"m","max_tokens":9,"system":"be brief ' || conv_id % 3 || '","messages":[{"role":"user","content":"c' || conv_id || '"},{"role":"assistant","content":"ok"},{"role":"user","content":"and ' || conv_id + 1 || '"}],"thinking":{"type":"adaptive"},"output_config":{"effort":"max"}}}'"""))(_requests("anthropic"))
query("s15_encode_google", _request_sql(_CONTENTS + """"max_output_tokens":9},' || """ + _SYSTEM + _END))(_requests("google"))
query("s15_encode_google_cached", _request_sql(_CONTENTS + """"max_output_tokens":9},"cached_content":"cache/7"},'""" + _END))(_requests("google", "cache/7"))
query("s15_encode_google_vertex", _request_sql(_CONTENTS + """"top_p":0.95,"max_output_tokens":9,"thinking_config":{"thinking_level":"HIGH"}},' || """ + _SYSTEM + _END))(_requests("google_vertex"))
query("s16_decode_results", "select doc_id::varchar custom_id, case doc_id % 3 when 0 then 'ERROR: Refused by model safety filter' when 1 then 'a' || chr(10) || chr(10) || lang else 'ERROR: ' || source end as output, doc_id % 3 = 0 is_refusal from documents")(
    lambda spark, sf: S.decode_results(
        table(spark, sf, "documents").select(
            F.when(F.col("doc_id") % 3 == 0, F.format_string('{"custom_id":"%d","result":{"type":"succeeded","message":{"stop_reason":"refusal","content":[]}}}', "doc_id"))
            .when(F.col("doc_id") % 3 == 1, F.format_string('{"custom_id":"%d","result":{"type":"succeeded","message":{"stop_reason":"end","content":[{"type":"thinking","thinking":"a"},{"type":"text","text":"%s"}]}}}', "doc_id", "lang"))
            .otherwise(F.format_string('{"custom_id":"%d","result":{"type":"errored","error":"%s"}}', "doc_id", "source")).alias("value")
        ), "anthropic",
    ).drop("position")
)
query("s17_active_batches", "select user_id batch_id, event_type status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1 and event_type <> 'click'")(
    lambda spark, sf: S.active_batches(table(spark, sf, "events").select(F.col("user_id").alias("batch_id"), F.struct("ts", "event_id").alias("timestamp"), F.when(F.col("event_type") == "click", S.GRADED).otherwise(F.col("event_type")).alias("status"))).select("batch_id", "status")
)
query("s18_batch_done", "select event_id, regexp_matches(lower(event_type), 'completed|ended|succeeded') or event_id % 2 = 0 done from events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", S.batch_done(F.when(F.col("event_id") % 2 == 0, "JOB_STATE_SUCCEEDED").otherwise(F.col("event_type"))).alias("done"))
)
_MODULI = (97, 89, 83, 79, 73)
query("s21_attention_log", f"select 'log' || doc_id file, doc_id % 4 + 1 sample, l layer, ['system', 'distractor_pre', 'target_stmt', 'distractor_post', 'target'][p] region, (n_chars + l) % {list(_MODULI)}[p] + 0.5::double pct from documents, (select unnest(range(0, 3))::int l), (select unnest(range(1, 6)) p)".replace("doc_id % 4 + 1 sample", "(doc_id % 4 + 1)::int sample"))(
    lambda spark, sf: S.parse_attention_log(_attention_lines(table(spark, sf, "documents")))
)


def _attention_lines(docs):
    """A log a document: a layer before any sample, a sample's head and three layers."""
    n, k = F.col("n"), F.col("n") - 2
    told = F.format_string("Layer %d Averages - System: %d.5%%, DistractorPre: %d.5%%, TargetStmt: %d.5%%, DistractorPost: %d.5%%, Target: %d.5%%", k, *[(F.col("n_chars") + k) % m for m in _MODULI])
    value = F.when(n == 1, F.format_string("=== SAMPLE %d DILUTION SUMMARY", F.col("doc_id") % 4 + 1)).otherwise(told)
    return docs.select(F.format_string("log%d", "doc_id").alias("file"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("n"), "doc_id", "n_chars").select("file", "n", F.when(n == 0, F.regexp_replace(told, "Layer -2", "Layer 9")).otherwise(value).alias("value"))


query("s25_providers", "select page_id, ['google', 'anthropic', 'openai', null][page_id % 4 + 1] provider from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", S.infer_provider(F.element_at(F.array(*[F.lit(m) for m in ("Gemini-3", "claude-x", "o1-mini", "llama")]), (F.col("page_id") % 4 + 1).cast("int"))).alias("provider"))
)
# --- S27: frames of figures --------------------------------------------------------------------

query("s27_bar_panels", _CUBE_SQL + """, f as (select model, technique, n_correct / total acc, failures / total fail from m), p as (select model, row_number() over (order by avg(acc) desc, model nulls first)::int - 1 panel_at from f group by model),
b as (select technique, row_number() over (order by technique nulls first)::int - 1 bar_at from (select distinct technique from f))
select f.model, f.technique, panel_at, bar_at, part, round(case when part = 'accuracy' then 0 else acc end, 6) bottom, round(case when part = 'accuracy' then acc else acc + fail end, 6) top
from f join p on f.model is not distinct from p.model join b on f.technique is not distinct from b.technique, (select unnest(['accuracy', 'failure_rate']) part)""")(
    lambda spark, sf: rounded(figures.bar_panels(A.pooled_metrics(cube(spark, sf), KEYS), "model", "technique", "accuracy", "failure_rate"), "bottom", "top")
)
query("s27_radar", _CUBE_SQL + """, f as (select model, technique, n_correct / total acc from m), n as (select *, row_number() over (partition by model order by technique nulls first) - 1 at_, count(*) over (partition by model) n from f),
closed as (select model, technique, at_, n, acc from n union all select model, technique, n, n, acc from n where at_ = 0) select model, technique, at_::int as "at", round(2 * pi() * at_ / n, 6) angle, round(acc, 6) as value from closed""")(
    lambda spark, sf: rounded(figures.radar(A.pooled_metrics(cube(spark, sf), KEYS), "model", "technique", "accuracy"), "angle", "value")
)
query("s27_stacked", _CUBE_SQL + "select model, technique, total, round(sum(total::double) over w - total, 3) bottom, round(sum(total::double) over w, 3) top from m window w as (partition by model order by technique nulls first rows unbounded preceding)")(
    lambda spark, sf: rounded(figures.stacked(A.pooled_metrics(cube(spark, sf), KEYS).select("model", "technique", "total"), "model", "technique", "total"), "bottom", "top", digits=3)
)
_TYPES = ["click", "view", "purchase"]
query("s27_heat_map", "select user_id % 12 row_, " + ", ".join(f"round(avg(value) filter (event_type = '{t}'), 4) as {t}" for t in _TYPES) + " from events group by 1")(
    lambda spark, sf: rounded(figures.heat_map(table(spark, sf, "events").withColumn("row_", F.col("user_id") % 12), "row_", "event_type", "value", _TYPES), *_TYPES, digits=4)
)
query("s27_trend", "with p as (select doc_id, length(text) n, n_chars % 1000 y from documents), l as (select regr_slope(y, n) a, regr_intercept(y, n) b from p) select doc_id, n, y, round(a * n + b, 3) fitted from p, l")(
    lambda spark, sf: rounded(figures.trend_line(table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), (F.col("n_chars") % 1000).alias("y")), "n", "y"), "fitted", digits=3)
)
query("s23_percent", "select doc_id, printf('%.2f', 100 * (doc_id % 8) / 8.0) x from documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", S.percent((F.col("doc_id") % 8) / 8.0).alias("x")))
_Z02_SQL = f"with c as (select conv_id, turn, text, len({WORDS('text')}) n, {WORDS('text')} w from conversations), r as (select *, sum(n) over (partition by conv_id order by turn) - n b from c) select conv_id, turn, case when b + n < 80 then 'FEEDING' when b < 80 then 'SOLVING' else 'DONE' end phase, case when b + n <= 80 then text else array_to_string(w[1:greatest(80 - b, 0)::bigint], ' ') end kept from r"
query("z02_saturation", _Z02_SQL)(
    lambda spark, sf: Z.saturate(table(spark, sf, "conversations"), 80).select("conv_id", "turn", "phase", "kept")
)


def _streamed(spark, sf, name):
    """A table as a stream of its files; the pattern stands for a file or a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/{name}.parque[t]")


def _saturated(spark, sf):
    at = f"{folder(spark)}/saturated-{uuid.uuid4().hex}"
    K.run_to_end(K.saturation_stream(_streamed(spark, sf, "conversations"), 80), K.exactly_once(at), f"{at}/checkpoint")
    return K.committed(spark, at, K.COLUMNS).select("conv_id", "turn", "phase", "kept")


def _replayed(spark, sf):
    """Every batch of labels is handed to the sink twice, and once more under a checkpoint that has forgotten it."""
    at = f"{folder(spark)}/labels-{uuid.uuid4().hex}"
    once = K.exactly_once(at)
    twice = lambda batch, i: [once(batch, i) for _ in range(2)]
    for checkpoint in ("first", "forgotten"):
        K.run_to_end(_streamed(spark, sf, "labels"), twice, f"{at}/{checkpoint}")
    return K.committed(spark, at, "doc_id long, quality int, toxic int")


query("z02_saturation_stream", _Z02_SQL)(_saturated)
query("z03_exactly_once", "select doc_id, quality, toxic from labels")(_replayed)
query("z03_poll_batches", "select distinct doc_id batch_id from documents where doc_id % 2 = 0 and doc_id not in (select doc_id from labels)")(
    lambda spark, sf: Z.poll_batches(table(spark, sf, "documents").select(F.col("doc_id").alias("batch_id"), F.when(F.col("doc_id") % 2 == 0, "completed").otherwise("running").alias("status")), table(spark, sf, "labels").select(F.col("doc_id").alias("batch_id"))).select("batch_id")
)
query("z04_backoff", "select event_id, case when event_type = 'click' then least(30 * power(2, user_id % 8), 300)::int when event_type <> 'view' and user_id % 8 + 1 < 5 then (2 * (user_id % 8 + 1))::int end wait from events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", Z.backoff_seconds(F.col("user_id") % 8 + 1, F.when(F.col("event_type") == "click", "quota").when(F.col("event_type") == "view", "safety").otherwise("other")).alias("wait"))
)
