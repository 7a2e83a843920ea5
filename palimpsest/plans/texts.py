"""Queries of the text functions: normalising, perturbing, prompting, extracting, grading, distance.

Problems are the rows of ``benchmark`` (idx = item_id, which is dense), sanitised; model outputs
are built from ``documents`` by one rule that the SQL side repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import equivalence as E
from ..functions import extract as X
from ..functions import grade as G
from ..functions import latexswap
from ..functions import lexicon as L
from ..functions import normalize as N
from ..functions import perturb as P
from ..functions import prompt as B
from ..functions import systems
from ..functions import tokens as T
from ..functions.core import words
from ..operators import names as names_
from ..operators import neighbours, pairing
from ..operators import tagging as tagger
from ..sources import problems as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- inputs, and the same in SQL ---------------------------------------------------------------

_SAN = r"replace(regexp_replace(regexp_replace(text, '(\\\\|\\%)|%.*', '\1', 'g'), '([bntafr])\\', '\1 \\', 'g'), chr(10), '; ')"
P_SQL = f"p as (select item_id idx, {_SAN} problem from benchmark)"
PAIR_SQL = P_SQL + ", q as (select a.idx, a.problem a, b.problem b from p a join p b on b.idx = (a.idx + 1) % (select count(*) from p))"
CH = lambda t: f"list_transform(range(1, length({t}) + 1), lambda i: substring({t}, i, 1))"
WORDS = lambda t: rf"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OUT_SQL = r"""o as (
  select doc_id, n_chars, text, lang,
    'Problem 1: ' || text || ' Problem 2: \boxed{' || n_chars || '} so **' || doc_id || '.** ' ||
      case when doc_id % 3 = 0 then 'Problem 1 again \boxed{a{b}' || doc_id % 7 || '}' else 'The answer is ' || doc_id % 50 || '.' end output,
    case doc_id % 4 when 0 then n_chars::varchar when 1 then doc_id::varchar when 2 then (doc_id % 50)::varchar else '-1' end truth
  from documents)"""


def problems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), N.sanitize_problem("text").alias("problem"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.with_next(problems(spark, sf)).select("idx", F.col("problem").alias("a"), F.col("partner").alias("b"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    tail = F.when(d % 3 == 0, F.concat(F.lit("Problem 1 again \\boxed{a{b}"), (d % 7).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("The answer is "), (d % 50).cast("string"), F.lit(".")))
    out = F.concat(F.lit("Problem 1: "), F.col("text"), F.lit(" Problem 2: \\boxed{"), F.col("n_chars").cast("string"), F.lit("} so **"), d.cast("string"), F.lit(".** "), tail)
    truth = F.when(d % 4 == 0, F.col("n_chars")).when(d % 4 == 1, d).when(d % 4 == 2, d % 50).otherwise(-1).cast("string")
    return table(spark, sf, "documents").select("doc_id", "n_chars", "text", "lang", out.alias("output"), truth.alias("truth"))


# expressions come as thunks: a Column needs a session, and this module must import without one


def _docs(expr: Callable[[], Column], name: str = "x"):
    return lambda spark, sf: table(spark, sf, "documents").select("doc_id", expr().alias(name))


def _outs(*exprs: Callable[[], Column]):
    return lambda spark, sf: outputs(spark, sf).select("doc_id", *[e() for e in exprs])


def _probs(expr: Callable[[], Column]):
    return lambda spark, sf: problems(spark, sf).select("idx", expr().alias("x"))


def _pairs(expr: Callable[[], Column]):
    return lambda spark, sf: pairs(spark, sf).select("idx", expr().alias("x"))


def _doc_sql(e: str) -> str:
    return f"select doc_id, {e} x from documents"


def _prob_sql(e: str) -> str:
    return f"with {P_SQL} select idx, {e} x from p"


def _pair_sql(e: str) -> str:
    return f"with {PAIR_SQL} select idx, {e} x from q"


# --- S01-S05, S19 ------------------------------------------------------------------------------

query("s01_load_problems", "select item_id::varchar id, text problem from benchmark")(
    lambda spark, sf: S.normalise_problems(S.load_problems(spark, f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "idx"), "text").select("id", "problem")
)
query("s02_limit", "select item_id idx, text from benchmark where item_id < 7")(lambda spark, sf: S.limit_rows(table(spark, sf, "benchmark").withColumnRenamed("item_id", "idx"), 7))
query("s03_row_range", "select item_id idx, text from benchmark where item_id between 3 and 8")(
    lambda spark, sf: table(spark, sf, "benchmark").withColumnRenamed("item_id", "idx").where(S.range_filter("3:9"))
)
query("s04_row_list", "select i idx, text from (select unnest([1, 3, 3, 10, 11]) i) join benchmark on item_id = i")(
    lambda spark, sf: S.pick_rows(table(spark, sf, "benchmark").withColumnRenamed("item_id", "idx"), "1,3,3,10-12", 40).select("idx", "text")
)
query("s05_inspect_row", "select 'item_id' field, item_id::varchar value from benchmark where item_id = 5 union all select 'text', text from benchmark where item_id = 5")(
    lambda spark, sf: S.inspect_row(table(spark, sf, "benchmark").withColumn("idx", F.col("item_id")), 5).where("field <> 'idx'")
)
query("s19_word_chunks", f"with w as (select doc_id, {WORDS('text')} w from documents), c as (select doc_id, unnest(range(0, greatest(len(w), 1), 1500)) a, w from w where len(w) > 0) select doc_id, (a // 1500)::int chunk, array_to_string(w[a + 1:a + 1500], ' ') as text from c where length(array_to_string(w[a + 1:a + 1500], ' ')) > 100")(
    lambda spark, sf: S.word_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text")
)

# --- N01-N11 -----------------------------------------------------------------------------------

query("n01_remove_latex_comments", _doc_sql(r"regexp_replace(text, '(\\\\|\\%)|%.*', '\1', 'g')"))(_docs(lambda: N.remove_latex_comments("text")))
query("n02_sanitize_inverted_escapes", r"with " + OUT_SQL + r" select doc_id, regexp_replace(output || 'n\x b\\y', '([bntafr])\\', '\1 \\', 'g') x from o")(
    _outs(lambda: N.sanitize_inverted_escapes(F.concat(F.col("output"), F.lit("n\\x b\\\\y"))).alias("x"))
)
query("n03_flatten_text", _doc_sql("replace(coalesce(text, ''), chr(10), '; ')"))(_docs(lambda: N.flatten_text("text")))
query("n04_sanitize_problem", f"select doc_id, {_SAN} x from documents")(_docs(lambda: N.sanitize_problem("text")))
query("n05_drop_blank_lines", _doc_sql("array_to_string(list_filter(string_split(replace(text, '. ', chr(10) || ' ' || chr(10)), chr(10)), lambda l: trim(l) <> ''), chr(10))"))(
    _docs(lambda: N.drop_blank_lines(F.replace(F.col("text"), F.lit(". "), F.lit("\n \n"))))
)
query("n06_normalize_text", _doc_sql(r"trim(regexp_replace(text, '\s+', ' ', 'g'))"))(_docs(lambda: N.normalize_text("text")))
query(
    "n07_normalize_for_recovery",
    _doc_sql(r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), '\tfrac', '\frac'), '\dfrac', '\frac'), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '([({\[])\s+', '\1', 'g'), '\s+([)}\]])', '\1', 'g'))"),
)(_docs(lambda: N.normalize_for_recovery("text")))
query("n08_normalize_legacy", r"with " + OUT_SQL + r" select doc_id, trim(regexp_replace(replace(replace(regexp_replace(output, '\\boxed\{([^}]*)\}', '\1', 'g'), '$', ''), '\', ''), '\s+', ' ', 'g')) x from o")(
    _outs(lambda: N.normalize_legacy("output").alias("x"))
)
query("n09_strip_thinking_tags", r"select page_id, trim(regexp_replace('<think>' || url || '</Think> <reasoning a=1>' || page_id || '</reasoning>', '(?i)</?(think|thinking|reasoning|reflection|scratchpad)[^>]*>', '', 'g')) x from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", N.strip_thinking_tags(F.concat(F.lit("<think>"), "url", F.lit("</Think> <reasoning a=1>"), F.col("page_id").cast("string"), F.lit("</reasoning>"))).alias("x"))
)
query("n10_safe_name", "select page_id, translate(url, '/ ', '__') x from pages")(lambda spark, sf: table(spark, sf, "pages").select("page_id", N.safe_name("url").alias("x")))
query("n11_labels", "select doc_id, case when n_chars >= 1000 then (n_chars // 1000)::varchar || 'K' else n_chars::varchar end size_label, case when n_chars >= 1000 then round(n_chars / 1000.0, 1)::decimal(18,1)::varchar || 'k' else n_chars::varchar end length_label  from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", N.size_label("n_chars").alias("size_label"), N.length_label("n_chars").alias("length_label"))
)

# --- T04-T18, R04-R20 --------------------------------------------------------------------------

_LINES = lambda t: f"list_transform(range(0, ((length({t}) + 59) // 60)), lambda i: substring({t}, i * 60 + 1, 60))"
_CYCLE = lambda x, y, f: f"list_transform(range(0, greatest(len({x}), len({y}))), lambda i: {f})"
query("t04_interleave_lines", f"with {PAIR_SQL}, l as (select idx, {_LINES('trim(a)')} x, {_LINES('trim(b)')} y from q) select idx, array_to_string({_CYCLE('x', 'y', chr(39) + '<Problem A> ' + chr(39) + ' || x[i % len(x) + 1] || chr(10) || ' + chr(39) + '<Problem B> ' + chr(39) + ' || y[i % len(y) + 1]')}, chr(10)) x from l")(_pairs(lambda: P.interleave_lines("a", "b")))
query("t05_interleave_words", f"with {PAIR_SQL}, l as (select idx, {WORDS('a')} x, {WORDS('b')} y from q) select idx, array_to_string({_CYCLE('x', 'y', 'x[i % len(x) + 1] || chr(32) || y[i % len(y) + 1]')}, ' ') x from l")(_pairs(lambda: P.interleave_words("a", "b")))
query("t06_interleave_symbols", f"with {PAIR_SQL}, l as (select idx, {CH('a')} x, {CH('b')} y from q) select idx, array_to_string({_CYCLE('x', 'y', 'x[i % len(x) + 1] || y[i % len(y) + 1]')}, '') x from l")(_pairs(lambda: P.interleave_symbols("a", "b")))
query("t07_sentence_reversal", "with r as (select doc_id, list_reverse(string_split(text, '.')) r from documents) select doc_id, array_to_string(case when r[1] = '' then r[2:] || [''] else r end, '.') x from r")(_docs(lambda: P.reverse_sentences("text")))
query("t08_word_reversal", r"""with l as (select doc_id, text, regexp_extract_all(text, '\S+') w, regexp_extract_all(text, '\s+') s from documents),
m as (select *, case when regexp_matches(text, '^\s') then 1 else 0 end lead_ from l)
select doc_id, case when len(w) = 0 then text else array_to_string(list_transform(range(1, len(w) + 1), lambda i: coalesce(case when lead_ + i > 1 then s[lead_ + i - 1] end, '') || w[len(w) + 1 - i]), '') || coalesce(case when len(s) > len(w) - 1 + lead_ then s[len(s)] end, '') end x from m""")(_docs(lambda: P.reverse_words("text")))
_CPREV = lambda x: f"array_to_string(list_reverse({CH(x)}), '')"
query("t09_split_reversal", f"select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: {_CPREV('w').replace('lambda i:', 'lambda j:').replace('substring(w, i,', 'substring(w, j,')}), ' ') x from documents")(_docs(lambda: P.split_reverse("text")))
query("t10_rail_fence", f"with {P_SQL}, c as (select idx, {CH('problem')} ch from p) select idx, 'GRID START' || chr(10) || array_to_string(list_transform([0, 1, 2], lambda r: array_to_string(list_transform(range(0, len(ch)), lambda k: case when least(k % 4, 4 - k % 4) = r then ch[k + 1] else '.' end), '')), chr(10)) || chr(10) || 'GRID END' x from c")(_probs(lambda: P.rail_fence("problem")))
query("t11_rectangle_perimeter", f"""with {P_SQL}, c as (select idx, {CH('problem')} ch, length(problem) n, greatest(3, (length(problem) + 13) // 10)::bigint h from p),
d as (select *, greatest(2, (n - 2 * h + 5) // 2)::bigint w from c)
select idx, 'GRID START' || chr(10) || array_to_string(list_transform(range(0, h), lambda r: array_to_string(list_transform(range(0, w), lambda k:
  case when r = 0 then coalesce(ch[k + 1], ' ') when k = w - 1 then coalesce(ch[w + r], ' ') when r = h - 1 then coalesce(ch[2 * w + h - 2 - k], ' ') when k = 0 then coalesce(ch[2 * w + 2 * h - 3 - r], ' ') else '.' end), '')), chr(10)) || chr(10) || 'GRID END' x from d""")(_probs(lambda: P.rectangle_perimeter("problem")))
_SNAKE = lambda e: f"with {P_SQL}, c as (select idx, {CH('problem')} ch, ((length(problem) + 4) // 5)::bigint w from p) select idx, 'GRID START' || chr(10) || array_to_string(list_transform(range(0, 5), lambda r: array_to_string(list_transform(range(0, w), lambda k: coalesce(ch[{e} + 1], '')), '')), chr(10)) || chr(10) || 'GRID END' x from c"
query("t12_snake_vertical", _SNAKE("k * 5 + (case when k % 2 = 0 then r else 4 - r end)"))(_probs(lambda: P.snake_vertical("problem")))
query("t13_snake_horizontal", _SNAKE("r * w + (case when r % 2 = 0 then k else w - 1 - k end)"))(_probs(lambda: P.snake_horizontal("problem")))
_COMPOUND = "'Solve these completely unrelated math problems. For each problem put your final answer within \\boxed{}.' || chr(10) || chr(10) || 'Problem 1:' || chr(10) || b || chr(10) || chr(10) || 'Problem 2:' || chr(10) || a"
query("t14_compound", _pair_sql(_COMPOUND))(_pairs(lambda: P.compound("a", F.array("b"))))
query("t15_baseline", _prob_sql("trim(problem)"))(_probs(lambda: P.baseline("problem")))
query("t17_word_split_swap", _doc_sql("array_to_string(list_transform(string_split(text, ' '), lambda w: case when length(w) < 2 or trim(w, ' ' || chr(10) || chr(9)) = '' then w else substring(w, length(w) // 2 + 1) || substring(w, 1, length(w) // 2) end), ' ')"))(_docs(lambda: P.word_split_swap("text")))
query("t18_terms_prompt", _prob_sql("'" + L.TERMS_TEMPLATE.replace("'", "''").replace("{problem_text}", "' || problem || '") + "'"))(_probs(lambda: L.terms_prompt("problem")))

# perturbations behind a tagger: rows only, with their round trips


def _tagged(expr: Callable[[], Column]):
    """Problems tagged by a model that the problems themselves teach."""

    def run(spark, sf):
        p = problems(spark, sf)
        return tagger.with_tags(p, "problem", tagger.learn(p, "problem")).select("idx", expr().alias("x"))

    return run


query("t01_not_not")(_tagged(lambda: L.not_not("problem", tags="tags")))
query("t02_opposites")(_tagged(lambda: L.opposites("problem", key="idx", tags="tags")))
query("t03_wrappers")(_tagged(lambda: L.wrappers("problem", key="idx", tags="tags")))
query("t03_tag_shares")(lambda spark, sf: tagger.tag_shares(tagger.with_tags(table(spark, sf, "documents"), "text", tagger.learn(table(spark, sf, "documents")))).withColumn("share", F.round("share", 6)))
query("t16_context_saturation")(_probs(lambda: L.context_saturation("problem", "idx")))
# documents with math of every scope round their text; the renaming has no SQL, what is done and undone has
_LATEX = lambda: F.concat(F.lit("Let $x_{"), F.col("doc_id") % 9, F.lit("} + \\frac{a}{b} \\text{ so }$. "), F.replace("text", F.lit("$"), F.lit("")), F.lit(" \\[ y=\\sqrt{x}, \\] \\(z\\) \\begin{align*} u&=v \\end{align*} [asy] draw(p); label(\"$q$\", (0,0)); [/asy]"))
query("t19_math_variables", "select doc_id, 'a,b,q,u,v,x,y,z' x from documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.array_join(latexswap.math_variables(_LATEX()), ",").alias("x")))
query("t19_swap_math")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", latexswap.swap_math_variables(_LATEX(), F.col("doc_id")).alias("x")))
query("t19_undo_math", "select doc_id, replace(text, '$', '') x from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", latexswap.undo_math_variables(latexswap.swap_math_variables(_LATEX(), F.col("doc_id")), F.col("doc_id")).alias("t")).select("doc_id", F.regexp_extract("t", r"(?s)so \}\$\. (.*) \\\[ y=", 1).alias("x"))
)
query("t19_swap_variables")(_probs(lambda: L.swap_variables(F.concat("problem", F.lit(" $x + ab + \\frac{y}{Z}$")), key="idx")))
_NAMES_SQL = rf"""with c as (select doc_id, regexp_replace(text, '\$[^$]+\$', ' ', 'g') t from documents),
i as (select w, 1 cap from (select unnest(regexp_extract_all(t, '[a-z0-9,;:)] ([A-Z][a-z]+)', 1)) w from c) union all
  select upper(w[1]) || w[2:], 0 from (select unnest(regexp_extract_all(t, '\b([a-z]+)\b', 1)) w from c)),
names as (select w, sum(cap)::bigint inside, (count(*) - sum(cap))::bigint plain from i group by w having sum(cap) >= 2 and sum(cap) >= 0.9 * count(*)), """
query("t20_learned_names", _NAMES_SQL.rstrip(", ") + " select w as name, inside, plain from names")(lambda spark, sf: names_.learn_names(table(spark, sf, "documents")))
query("t20_name_mentions", _NAMES_SQL + rf"""r as (select distinct doc_id, regexp_replace(unnest(regexp_extract_all(t, '\b([A-Z][a-z]+(?: [A-Z][a-z]+){{0,2}})\b', 1)), '^(?:{"|".join(L.OPENERS)})(?: |$)', '') run from c),
k as (select doc_id, run from r, (select list(w) ns from names) where run <> '' and list_has_all(ns, string_split(run, ' '))) select doc_id, string_agg(run, ',' order by run) as names from k group by doc_id""")(
    lambda spark, sf: names_.name_mentions(table(spark, sf, "documents"), names_.learn_names(table(spark, sf, "documents")), "doc_id").withColumn("names", F.array_join("names", ","))
)
query("t20_person_names")(lambda spark, sf: problems(spark, sf).select(F.explode(L.person_names("problem")).alias("name")).distinct().orderBy("name"))

query("r01_undo_not_not", _prob_sql("problem"))(_probs(lambda: P.undo_not_not(L.not_not("problem"))))
query("r02_undo_opposites", _prob_sql(r"trim(regexp_replace(problem, '\s+', ' ', 'g'))"))(_probs(lambda: L.undo_opposites(L.opposites("problem", key="idx"))))
query("r03_undo_wrappers", _prob_sql(r"trim(regexp_replace(problem, '\s+', ' ', 'g'))"))(_probs(lambda: N.normalize_text(L.undo_wrappers(L.wrappers("problem", key="idx")))))
query("r04_deinterleave_lines", f"with {PAIR_SQL}, l as (select idx, {_LINES('trim(a)')} x, {_LINES('trim(b)')} y from q) select idx, array_to_string({_CYCLE('x', 'y', 'x[i % len(x) + 1]')}, '') x from l")(_pairs(lambda: P.deinterleave_lines(P.interleave_lines("a", "b"))))
query("r05_deinterleave_words", f"with {PAIR_SQL}, l as (select idx, {WORDS('a')} x, {WORDS('b')} y from q) select idx, array_to_string({_CYCLE('x', 'y', 'x[i % len(x) + 1]')}, ' ') x from l")(_pairs(lambda: P.deinterleave_words(P.interleave_words("a", "b"))))
query("r06_deinterleave_symbols", f"with {PAIR_SQL}, l as (select idx, {CH('a')} x, {CH('b')} y from q) select idx, array_to_string({_CYCLE('x', 'y', 'x[i % len(x) + 1]')}, '') x from l")(_pairs(lambda: P.deinterleave_symbols(P.interleave_symbols("a", "b"))))
query("r07_sentence_reversal", "with r as (select doc_id, list_reverse(string_split(text, '.')) r from documents), o as (select doc_id, list_reverse(case when r[1] = '' then r[2:] || [''] else r end) r from r) select doc_id, array_to_string(case when r[1] = '' then r[2:] || [''] else r end, '.') x from o")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", P.reverse_sentences(P.reverse_sentences("text")).alias("x")))
query("r08_word_reversal", _doc_sql("text"))(_docs(lambda: P.reverse_words(P.reverse_words("text"))))
query("r09_split_reversal", _doc_sql("text"))(_docs(lambda: P.split_reverse(P.split_reverse("text"))))
query("r10_read_rail_fence", _prob_sql("problem"))(_probs(lambda: P.read_rail_fence(P.rail_fence("problem"))))
query("r11_read_rectangle", _prob_sql("rtrim(problem)"))(_probs(lambda: P.read_rectangle_perimeter(P.rectangle_perimeter("problem"))))
query("r12_read_snake_vertical", _prob_sql("rtrim(problem)"))(_probs(lambda: F.rtrim(P.read_snake_vertical(P.snake_vertical("problem")))))
query("r13_read_snake_horizontal", _prob_sql("problem"))(_probs(lambda: P.read_snake_horizontal_exact(P.snake_horizontal("problem"))))
query("r16_undo_context_saturation", _prob_sql(r"trim(regexp_replace(problem, '([.!?])\s+', '\1 ', 'g'))"))(_probs(lambda: P.undo_context_saturation(L.context_saturation("problem", "idx"))))
query("r17_undo_word_split_swap", _doc_sql("text"))(_docs(lambda: P.undo_word_split_swap(P.word_split_swap("text"))))


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """R20, the flagship: sanitise, pair, fan out over every reversible technique, invert, compare."""
    df = pairs(spark, sf)
    checks = []
    for name, p in P.REGISTRY.items():
        if p.inverse is None:
            continue
        back, want = N.normalize_text(p.inverse(P.perturb(name, F.col("a"), F.col("b")))), N.normalize_text(F.col("a"))
        checks.append(F.struct(F.lit(name).alias("technique"), (back.startswith(want) if p.prefix else back == want).alias("ok")))
    return df.select(F.inline(F.array(*checks))).groupBy("technique").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


query("r20_round_trip", "select unnest(['" + "','".join(n for n, p in P.REGISTRY.items() if p.inverse) + "']) technique, (select count(*) from benchmark) passed, (select count(*) from benchmark) total")(round_trip)

# --- P01-P06, J08 ------------------------------------------------------------------------------

query("p01_next_row", f"with {PAIR_SQL} select idx, a, b from q")(pairs)
_CHOICE = lambda n, *parts: f"(('0x' || substring(md5({' || chr(124) || '.join(parts)}), 1, 8))::bigint % ({n}))"
query("p02_sample_others", f"""with n as (select count(*) n from benchmark),
d as (select item_id idx, list_transform(range(0, 12), lambda t: {_CHOICE('n - 1', "'7'", 'item_id::varchar', 't::varchar')} + 1) || [1, 2, 3] d, n from benchmark, n),
u as (select idx, list_filter(list_transform(range(1, len(d) + 1), lambda i: case when list_position(d, d[i]) = i then d[i] end), lambda x: x is not null)[1:3] o, n from d)
select idx, unnest(range(0, len(o)))::int pos, ((idx + unnest(o)) % n)::bigint other from u""")(lambda spark, sf: pairing.sample_others(problems(spark, sf), 3, 7))
query("p03_replicate", f"with {P_SQL} select idx, problem, unnest(range(0, 4))::int sample_idx from p")(lambda spark, sf: pairing.replicate(problems(spark, sf), 4))
query("p04_fan_out", f"with {PAIR_SQL} select idx, t technique, md5(case t when 'baseline' then trim(a) when 'split_reversal' then array_to_string(list_transform(string_split(a, ' '), lambda w: {_CPREV('w').replace('lambda i:', 'lambda j:').replace('substring(w, i,', 'substring(w, j,')}), ' ') end) digest from q, (select unnest(['baseline', 'split_reversal']) t)")(
    lambda spark, sf: pairing.fan_out(pairs(spark, sf), ["baseline", "split_reversal"], "a", "b").select("idx", "technique", F.md5(F.col("perturbed").cast("binary")).alias("digest"))
)
query("p05_preview", f"with {P_SQL} select idx, problem from p order by md5('3|' || idx), idx limit 2")(lambda spark, sf: pairing.preview(problems(spark, sf), "idx", 2, 3))
query("p06_random_sample", f"with {P_SQL} select idx, problem from p order by md5('11|' || idx), idx limit 9")(lambda spark, sf: pairing.preview(problems(spark, sf), "idx", 9, 11))
query("j08_other_pairs", "select a.item_id a, b.item_id b from benchmark a join benchmark b on a.item_id <> b.item_id")(lambda spark, sf: pairing.other_pairs(problems(spark, sf)))

# --- B01-B14 -----------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WRAP = lambda rule, body: f"chr(10) || 'TRANSFORMATION RULE:' || chr(10) || {_quoted(rule)} || chr(10) || chr(10) || 'TRANSFORMED INPUT:' || chr(10) || {body} || chr(10)"
query("b01_solve_prompt", f"with {PAIR_SQL} select idx, 'split_reversal' technique, trim({_quoted(B.PROTOCOL_MODEL)} || chr(10) || chr(10) || {_WRAP(B.SOLVE_RULES['split_reversal'], 'array_to_string(list_transform(string_split(a, chr(32)), lambda w: ' + _CPREV('w').replace('lambda i:', 'lambda j:').replace('substring(w, i,', 'substring(w, j,') + '), chr(32))')}, chr(10)) prompt from q union all select idx, 'baseline', trim(a) from q union all select idx, 'compound', {_COMPOUND} from q")(
    lambda spark, sf: pairs(spark, sf).select("idx", "a", F.inline(F.array(*[F.struct(F.lit(t).alias("technique"), x.alias("x")) for t, x in (("split_reversal", P.split_reverse("a")), ("baseline", F.col("a")), ("compound", P.compound("a", F.array("b"))))]))).select("idx", "technique", B.solve_prompt("technique", "a", "x").alias("prompt"))
)
query("b02_decode_prompt", f"with {P_SQL} select idx, rtrim('YOUR TASK:' || chr(10) || '1. Read the TRANSFORMATION RULE and the TRANSFORMED INPUT.' || chr(10) || '2. Reverse the transformation and recover the original target problem statement.' || chr(10) || '3. Do not solve the math problem.' || chr(10) || '4. Output only the recovered problem statement between <RECOVERED_PROBLEM> and </RECOVERED_PROBLEM>.' || chr(10) || {_WRAP(B.DECODE_RULES['word_reversal'], 'problem')}, chr(10)) x from p")(
    _probs(lambda: B.decode_prompt(F.lit("word_reversal"), "problem"))
)
query("b03_passive_prompt", _pair_sql("'Take a look at this historical passage:' || chr(10) || chr(10) || b || chr(10) || chr(10) || 'Solve the following problem:' || chr(10) || chr(10) || a"))(_pairs(lambda: B.passive_prompt("a", "b")))
query("b04_messages", _prob_sql(f"{_quoted(B.SYSTEM_PROMPT)} || chr(10) || problem"))(_probs(lambda: B.render_messages(B.messages("problem"))))
query("b05_passive_body", f"with w as (select doc_id, {WORDS('text')} w from documents), o as (select *, {_CHOICE('greatest(len(w), 1)', chr(39) + '9' + chr(39), 'doc_id::varchar')} o from w) select doc_id, case when len(w) = 0 then '' else array_to_string(list_transform(range(0, 50), lambda i: w[(i + o) % len(w) + 1]), ' ') end x from o")(_docs(lambda: B.passive_body("text", F.lit(50), 9, F.col("doc_id"))))
query("b06_matched_body", f"with {PAIR_SQL} select idx, greatest(100 - len({WORDS('a')}) - len({WORDS('b')}), 0)::int x from q")(_pairs(lambda: B.matched_body_words(F.lit(100), "a", "b")))
_CONV = f"c as (select conv_id, turn, text, len({WORDS('text')}) n from conversations), r as (select *, sum(n) over (partition by conv_id order by turn) - n b from c)"
query("b07_trim_to_budget", f"with {_CONV} select conv_id, turn, case when b + n <= 60 then text else array_to_string({WORDS('text')}[1:(60 - b)::bigint], ' ') end kept from r where b < 60")(lambda spark, sf: B.trim_to_budget(table(spark, sf, "conversations"), 60).select("conv_id", "turn", "kept"))
query("b08_tolerance", f"with {_CONV}, t as (select conv_id, sum(n) n from c group by conv_id) select conv_id, abs(n - 200) <= 0.01 * 200 near, abs(n - 200) <= 0.02 * 200 passes from t")(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(B.token_count("text")).alias("n")).select("conv_id", B.within_tolerance("n", F.lit(200), 0.01).alias("near"), B.within_tolerance("n", F.lit(200), 0.02).alias("passes"))
)
query("b10_judge", "select doc_id, contains(upper(text), 'YES') yes from documents")(_docs(lambda: B.judge_verdict("text"), "yes"))
query("b10_judge_prompt", _pair_sql("'" + B.JUDGE_SYSTEM.replace("'", "''") + "' || chr(10) || '" + B.JUDGE_TEMPLATE.replace("'", "''").replace("{target}", "' || a || '").replace("{output}", "' || b || '") + "'"))(
    _pairs(lambda: B.render_messages(B.judge_messages("a", "b")))
)
query("b11_distractors")(lambda spark, sf: problems(spark, sf).select("idx", systems.distractor(5, F.col("idx")).alias("x")))
query("b11_systems")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", systems.system(5, F.col("doc_id")).alias("s")).select("doc_id", "s.*"))
query("b12_static_bins")(lambda spark, sf: L.static_distractors(problems(spark, sf)))
query("b13_fill_context", "with c as (select conv_id, turn, length(text) // 4 n from conversations), r as (select *, sum(n) over (order by conv_id, turn) s from c) select conv_id, turn, s::bigint total from r where s - n < 2000")(
    lambda spark, sf: B.fill_context(table(spark, sf, "conversations").withColumn("o", F.struct("conv_id", "turn")), 2000, "o").select("conv_id", "turn", "total")
)
query("b14_token_counts", f"select doc_id, len({WORDS('text')})::int w, floor(len({WORDS('text')}) * 1.3)::int w13, (length(text) // 4)::int c4 from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", B.token_count("text").alias("w"), B.token_count("text", "words_1_3").alias("w13"), B.token_count("text", "chars_4").alias("c4"))
)
# byte-pair tokens have no SQL: tests compare them with a plain merge
query("b14_exact_tokens")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.exact_token_count("text", T.Vocabulary(spark)).alias("n")))
query("b05_tokens_body")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.tokens_body("text", F.lit(120), F.col("doc_id").cast("string"), T.Vocabulary(spark)).alias("body")))
query("b06_matched_prompt")(
    lambda spark, sf: pairs(spark, sf).select("idx", T.matched_prompt("a", "b", F.lit(400), F.concat_ws("|", F.lit("42"), "idx"), T.Vocabulary(spark)).alias("m")).select("idx", "m.*")
)
query("x13_char_to_token")(lambda spark, sf: _token_boundaries(spark, sf))


def _token_boundaries(spark, sf):
    """The tokens at which the first problem, the target's statement and the target's longest section begin."""
    v, o = T.Vocabulary(spark), outputs(spark, sf)
    places = F.array(X.system_boundary("output"), X.statement_boundary("output", F.lit(2)), F.length("output"))
    return o.select("doc_id", T.char_to_token("output", places, v).alias("t")).select("doc_id", F.get("t", 0).alias("first_marker"), F.get("t", 1).alias("statement"), F.get("t", 2).alias("n_tokens"))


query("s20_context_messages", f"with m as (select conv_id, list({{'role': role, 'text': text}} order by turn) m from conversations group by conv_id) select conv_id, {_quoted(B.SYSTEM_PROMPT)} || coalesce(chr(10) || array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: x.text), chr(10)), '') x from m".replace("coalesce(chr(10) || array", "array").replace("|| array_to_string(list_transform(list_filter", "|| chr(10) || array_to_string(list_transform(list_filter").replace("chr(10)), '') x from m", "chr(10)) x from m"))(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("m")).select("conv_id", B.render_messages(B.with_system("m")).alias("x"))
)

# --- X01-X14 -----------------------------------------------------------------------------------

_WO = "with " + OUT_SQL + " "
query("x01_last_boxed", _WO + r"select doc_id, regexp_extract(output, '.*(\\boxed\{(?:[^{}]|\{[^{}]*\})*\})', 1, 's') x from o")(_outs(lambda: X.last_boxed("output").alias("x")))
query("x01_last_boxed_passive", _WO + r"select doc_id, regexp_extract(output, '.*(\\boxed\{(?:[^{}]|\{[^{}]*\})*\})', 1, 's') x from o")(_outs(lambda: X.last_boxed_from_brace("output").alias("x")))
query("x02_all_boxed", _WO + r"select doc_id, array_to_string(regexp_extract_all(output, '\\boxed\{(?:[^{}]|\{[^{}]*\})*\}'), '#') x from o")(_outs(lambda: F.array_join(X.all_boxed("output"), "#").alias("x")))
query("x03_remove_boxed", _WO + r"select doc_id, case when doc_id % 3 = 0 then 'a{b}' || doc_id % 7 else n_chars::varchar end x from o")(_outs(lambda: X.remove_boxed(X.last_boxed("output")).alias("x")))
query("x04_simple_answer", _WO + r"select doc_id, trim(regexp_extract(case when doc_id % 3 = 0 then regexp_extract_all(output, '\\boxed\s*\{([^}]+)\}', 1)[-1] else n_chars::varchar end, '(?s).*')) x from o")(_outs(lambda: X.simple_answer("output").alias("x")))
query("x05_bold", _WO + r"select doc_id, list_filter(list_transform(regexp_extract_all(output, '\*\*([^*]{1,40})\*\*', 1), lambda x: rtrim(trim(x), '.')), lambda x: regexp_matches(x, '[0-9]') and not regexp_matches(x, '[A-Za-z]{4,}'))[-1] x from o")(_outs(lambda: X.bold_candidate("output").alias("x")))
query("x06_recovered_text", "select doc_id, trim(text, ' ' || chr(10)) recovered, doc_id % 2 = 0 tagged from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", X.recovered_text(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x <recovered_problem>"), F.col("text"), F.lit("</RECOVERED_PROBLEM> y"))).otherwise(F.col("text"))).alias("r")).select("doc_id", F.col("r.text").alias("recovered"), F.col("r.tagged").alias("tagged"))
)
query("x07_python_code", "select doc_id, case doc_id % 3 when 0 then 'print(' || doc_id || ')' when 1 then 'open' || doc_id end code, case when doc_id % 3 = 0 then 'print(' || doc_id || ')' end closed from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("t ```python\nprint("), "doc_id", F.lit(")\n``` z"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```python\nopen"), "doc_id")).otherwise("none").alias("t")).select("doc_id", X.python_code("t").alias("code"), X.python_code("t", unclosed=False).alias("closed"))
)
query("x08_problem_count", _WO + r"select doc_id, greatest(len(regexp_extract_all(output, 'Problem \d+:')) - 1, 0)::int x from o")(_outs(lambda: X.problem_count("output").alias("x")))
query("x09_markers", _WO + r", m as (select doc_id, unnest(regexp_extract_all(output, 'Problem\s*(\d+)', 1))::bigint num from o) select doc_id, num, count(*) n from m group by all")(
    lambda spark, sf: outputs(spark, sf).select("doc_id", F.explode(X.problem_markers("output")).alias("num")).groupBy("doc_id", "num").agg(F.count("*").alias("n"))
)
query("x12_boundaries", _WO + "select doc_id, strpos(output, 'Problem 1') - 1 first_marker, strpos(output, 'Problem 2:') - 1 statement from o")(_outs(lambda: X.system_boundary("output").cast("bigint").alias("first_marker"), lambda: X.statement_boundary("output", F.lit(2)).cast("bigint").alias("statement")))
query("x13_char_to_word", f"select doc_id, len({WORDS('substring(text, 1, 100)')})::int x from documents")(_docs(lambda: X.char_to_word("text", F.lit(100))))
query("x14_transformed_input", _prob_sql("trim(problem)"))(_probs(lambda: X.transformed_input(F.concat(F.lit("RULE\nTRANSFORMED INPUT:\n"), "problem", F.lit("\n")))))

# --- G01-G11, F1-F3 ----------------------------------------------------------------------------

_CANDS = _WO + r""", c as (select doc_id, truth, case when doc_id % 3 = 0 then ['a{b}' || doc_id % 7] else [n_chars::varchar] end || list_filter(list_transform(regexp_extract_all(output, '\*\*([^*]{1,40})\*\*', 1), lambda x: rtrim(trim(x), '.')), lambda x: regexp_matches(x, '[0-9]') and not regexp_matches(x, '[A-Za-z]{4,}'))[-1:] ||
  [regexp_extract_all(output, '(-?\d+(?:\.\d+)?)')[-1]] v from o)"""
query("g01_extract_and_grade", _CANDS + " select doc_id, list_contains(v, truth) correct, coalesce(list_filter(v, lambda x: x = truth)[1], v[1]) extracted from c")(
    lambda spark, sf: outputs(spark, sf).select("doc_id", G.extract_and_grade("output", "truth").alias("g")).select("doc_id", F.col("g.correct").alias("correct"), F.col("g.extracted").alias("extracted"))
)
query("g01_grade_compound", _CANDS.replace("case when doc_id % 3 = 0 then ['a{b}' || doc_id % 7]", "case when doc_id % 3 = 0 then [n_chars::varchar, 'a{b}' || doc_id % 7]") + " select doc_id, list_contains(v, truth) correct, coalesce(list_filter(v, lambda x: x = truth)[1], v[1]) extracted from c")(
    lambda spark, sf: outputs(spark, sf).select("doc_id", G.extract_and_grade("output", "truth", "compound").alias("g")).select("doc_id", F.col("g.correct").alias("correct"), F.col("g.extracted").alias("extracted"))
)
query("g02_grade_passive", _CANDS + " select doc_id, v[1] = truth correct, v[1] extracted from c")(
    lambda spark, sf: outputs(spark, sf).select("doc_id", G.extract_and_grade_passive("output", "truth").alias("g")).select("doc_id", F.col("g.correct").alias("correct"), F.col("g.extracted").alias("extracted"))
)
_GA = lambda c: F.when(c % 5 == 0, F.lit(None).cast("string")).when(c % 5 == 1, F.concat(F.lit("\\frac{"), c.cast("string"), F.lit("}{2}"))).when(c % 5 == 2, F.concat(F.lit("$"), c.cast("string"), F.lit(".0$"))).otherwise(F.concat(F.lit("\\text{x"), c.cast("string"), F.lit("}")))
query("g03_is_equiv", "select doc_id, case doc_id % 5 when 0 then false when 1 then true when 2 then true else doc_id % 5 = 3 end x from documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", G.is_equiv(_GA(F.col("doc_id")), F.when(F.col("doc_id") % 5 == 1, (F.col("doc_id") / 2).cast("string")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))).alias("x"))
)
# two ways to write an answer, by the document's id; whether they are equal hangs on its length.  SQL compares the numbers
_ANSWERS_SQL = r"""with n as (select doc_id, text, doc_id % 8 k, n_chars % 9 + 2 a, doc_id % 5 + 1 b, (n_chars // 9) % 2 d from documents),
w as (select *, case k when 0 then format('(x+{})(x-{})', a, b) when 1 then '\frac{' || a || '}{' || b || '}' when 2 then '\sqrt{' || a * a * b || '}' when 3 then '\{' || a || ', ' || b || ', ' || d || '\}'
    when 4 then format('({}, {}]', a, b) when 5 then a || '^{' || b || '}' when 6 then 'x=' || a else a || ' \pm ' || b end answer,
  case k when 0 then a - b + d = a - b when 1 then a * (3 * b + d) = 3 * a * b when 2 then a * a * b = a * a * (b + d) when 3 then d = a or d = b
    when 4 then d = 0 when 5 then a ** b = a ** b + d when 6 then a = a + d else a - b = a - b - d end same,
  case k when 1 then 3 * a = doc_id * (3 * b + d) when 2 then a * a * (b + d) = doc_id * doc_id when 3 then a = doc_id and b = doc_id when 5 then a ** b + d = doc_id when 6 then a + d = doc_id else false end by_id from n) """


def _answers(spark, sf):
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, a, b, d = F.col("doc_id") % 8, F.col("n_chars") % 9 + 2, F.col("doc_id") % 5 + 1, F.floor(F.col("n_chars") / 9) % 2
    left = [s("(x+", a, ")(x-", b, ")"), s("\\frac{", a, "}{", b, "}"), s("\\sqrt{", a * a * b, "}"), s("\\{", a, ", ", b, ", ", d, "\\}"), s("(", a, ", ", b, "]"), s(a, "^{", b, "}"), s("x=", a), s(a, " \\pm ", b)]
    right = [s("x^2 + (", a - b + d, ")x - ", a * b), s("\\dfrac{", 3 * a, "}{", 3 * b + d, "}"), s(a, "\\sqrt{", b + d, "}"), s(b, ",", a), F.concat(s("\\left(", a, ",\\frac{", 2 * b, "}{2}"), F.when(d == 0, "\\right]").otherwise("\\right)"))]
    right += [(F.pow(a, b) + d).cast("long").cast("string"), s(a + d, ".0"), s(a + b, ", ", a - b - d)]
    pick = lambda options: F.element_at(F.array(*options), (k + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", "text", pick(left).alias("answer"), pick(right).alias("truth"))
    return rows.withColumn("output", s(F.col("text"), " \\boxed{", F.col("answer"), "} so **", F.col("doc_id"), ".**"))


query("g04_symbolic_equiv", _ANSWERS_SQL + "select doc_id, answer, same x from w")(lambda spark, sf: _answers(spark, sf).select("doc_id", "answer", E.symbolic_equiv("answer", "truth").alias("x")))
query("g04_symbolic_grade", _ANSWERS_SQL + "select doc_id, case when by_id and not same then doc_id::varchar else answer end extracted, same or by_id correct from w")(
    lambda spark, sf: G.with_symbolic_grade(_answers(spark, sf), "output", "truth").select("doc_id", "graded.extracted", "graded.correct")
)
query("g05_error_value", "select doc_id, case when doc_id % 7 = 0 then 'ERROR: bad' else lang end x from documents")(_docs(lambda: G.graded_or_error("lang", F.when(F.col("doc_id") % 7 == 0, "bad"))))
query("g06_failure_mode", f"""with w as (select doc_id, text, {WORDS('text')} w from documents), g as (select doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) g from w),
l as (select distinct doc_id from (select doc_id, g from g group by all having count(*) >= 3)) select doc_id, case when doc_id in (select doc_id from l) then 'loop' when contains(text, '\\boxed') then 'wrong_answer' else 'no_conclusion' end x from documents""")(_docs(lambda: G.failure_mode("text")))
query("g08_refusal", "select event_id, event_type in ('content_filter', 'click') x from events where false union all select event_id, event_id % 3 = 0 from events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", G.is_refusal(F.lit("google"), F.when(F.col("event_id") % 3 == 0, "SAFETY").otherwise("STOP")).alias("x"))
)
query("g09_retry_class", "select event_id, ['quota', 'safety', 'cache_expired', 'other'][event_id % 4 + 1] x from events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", G.retry_class(F.element_at(F.array(*[F.lit(m) for m in ("HTTP 429 Quota", "blocked for Safety", "Cache expired", "timeout")]), (F.col("event_id") % 4 + 1).cast("int"))).alias("x"))
)
query("g10_truncation", r"select doc_id, trim(text, ' ' || chr(10)) <> '' and (regexp_matches(text, '\\boxed\{[^}]*$') or right(trim(text, ' ' || chr(10)), 1) not in ('.', '!', '?', '}', '>', ']')) x from documents")(_docs(lambda: G.truncation_suspect("text", F.lit(False))))
query("g11_cut_off", "select doc_id, n_chars >= 0.98 * 3000 x from documents")(_docs(lambda: G.cut_off("n_chars", F.lit("n/a"), F.lit("3000"))))
query("f_failures", "select doc_id, e like 'ERROR%' f1, contains(e, 'ERROR') f2, e is null f3 from (select doc_id, case doc_id % 4 when 0 then 'ERROR: x' when 1 then 'my ERROR' when 2 then '' end e from documents)".replace("e like 'ERROR%' f1", "coalesce(e like 'ERROR%', false) f1").replace("contains(e, 'ERROR') f2", "coalesce(contains(e, 'ERROR'), false) f2"))(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ERROR: x").when(F.col("doc_id") % 4 == 1, "my ERROR").when(F.col("doc_id") % 4 == 2, "").alias("e")).select("doc_id", G.failed_prefix("e").alias("f1"), G.failed_contains("e").alias("f2"), G.failed_missing("e", F.lit(False)).alias("f3"))
)

# --- M01-M06 (edit distance on ASCII words: the oracle's counts bytes) --------------------------

# whole problems and the ones that follow them
_M = lambda spark, sf: pairs(spark, sf).select("idx", *[F.regexp_replace(c, "[^ -~]", "").alias(c) for c in ("a", "b")])
_M_SQL = "with " + PAIR_SQL + ", m as (select idx, regexp_replace(a, '[^ -~]', '', 'g') a, regexp_replace(b, '[^ -~]', '', 'g') b from q), "
_X_SQL = _M_SQL + "n as (select *, case idx % 6 when 0 then a when 1 then '' when 2 then b when 3 then 'GRID START' when 4 then replace(a, 'th', 't') else substring(b, 10) end x from m) "


def _x(spark, sf):
    k = F.col("idx") % 6
    x = F.when(k == 0, F.col("a")).when(k == 1, "").when(k == 2, F.col("b")).when(k == 3, "GRID START").when(k == 4, F.replace("a", F.lit("th"), F.lit("t"))).otherwise(F.substring(F.col("b"), F.lit(10), F.length("b")))
    return _M(spark, sf).withColumn("x", x)


query("m01_levenshtein", _M_SQL[:-2] + " select idx, levenshtein(a, b)::int x from m")(lambda spark, sf: _M(spark, sf).select("idx", D.levenshtein("a", "b").alias("x")))
query("m02_char_error_rate", _X_SQL + "select idx, round(levenshtein(a, x) / greatest(length(a), 1), 6) x, false estimated from n")(lambda spark, sf: _x(spark, sf).select("idx", F.round(D.char_error_rate("a", "x"), 6).alias("x"), D.is_estimated("a", "x").alias("estimated")))
query("m03_recovered", _X_SQL + "select idx, levenshtein(a, x) <= 0.02 * greatest(length(a), 1) x from n")(lambda spark, sf: _x(spark, sf).select("idx", D.recovered("a", "x").alias("x")))
query("m04_residual_status", _X_SQL + "select idx, case when idx % 7 = 0 then 'missing_recovered_tags' when levenshtein(a, x) <= 0.02 * greatest(length(a), 1) then 'recovered' when x = '' then 'empty_recovered_text' when levenshtein(b, x) <= 0.02 * greatest(length(b), 1) then 'copied_transformed_input' when levenshtein(b, x) / greatest(length(b), 1) < levenshtein(a, x) / greatest(length(a), 1) then 'closer_to_transformed_than_original' when contains(x, 'GRID START') then 'contains_transformation_markers' else 'partial_or_other' end status from n")(
    lambda spark, sf: _x(spark, sf).select("idx", D.residual_status("a", "b", "x", F.col("idx") % 7 != 0, D.recovered("a", "x")).alias("status"))
)
# whole documents against texts made of them by dropping or adding characters: one of each pair is a
# subsequence of the other, so the distance is the difference of their lengths
_DOC_SQL = """with n as (select doc_id, coalesce(text, '') a, coalesce(text, '') || repeat(' once more', 30) b from documents),
d as (select *, case doc_id % 6 when 0 then a when 1 then '' when 2 then b when 3 then left(b, length(a) + 12) when 4 then replace(a, 'th', 't') else substring(a, 11) end x from n),
e as (select *, abs(length(a) - length(x)) da, abs(length(b) - length(x)) db, length(a) > 6000 or length(x) > 6000 long from d) """


def _edited(spark, sf):
    k, a = F.col("doc_id") % 6, F.col("a")
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a")).withColumn("b", F.concat("a", F.repeat(F.lit(" once more"), 30)))
    x = F.when(k == 0, a).when(k == 1, "").when(k == 2, F.col("b")).when(k == 3, F.substring("b", F.lit(1), F.length("a") + 12)).when(k == 4, F.replace("a", F.lit("th"), F.lit("t"))).otherwise(F.substring(a, F.lit(11), F.length(a)))
    return rows.withColumn("x", x)


query("m01_bounded_levenshtein", _DOC_SQL + "select doc_id, case when da <= 40 then da else -1 end::int x from e")(lambda spark, sf: _edited(spark, sf).select("doc_id", D.long_levenshtein("a", "x", 40).alias("x")))
query("m02_document_error_rates", _DOC_SQL + "select doc_id, long estimated, case when not long then round(da / greatest(length(a), 1), 6) when a = x then 0 end x from e")(
    lambda spark, sf: _edited(spark, sf).select("doc_id", D.is_estimated("a", "x").alias("estimated"), F.round(D.char_error_rate("a", "x"), 6).alias("x")).withColumn("x", F.when(~F.col("estimated") | (F.col("x") == 0), F.col("x")))
)
query("m03_documents_recovered", _DOC_SQL + "select doc_id, da / greatest(length(a), 1) <= 0.02::double x from e")(lambda spark, sf: _edited(spark, sf).select("doc_id", D.recovered("a", "x", bounded=D.long_levenshtein).alias("x")))
# estimates of long texts have no SQL
query("m04_document_status")(lambda spark, sf: _edited(spark, sf).select("doc_id", D.residual_status("a", "b", "x", F.col("doc_id") % 7 != 0).alias("status")))
query("m05_windows", f"with w as (select doc_id, {WORDS('text')} w from documents), s as (select doc_id, w, unnest([16, 20, 24]) n from w), i as (select doc_id, w, n, unnest(list_distinct(case when len(w) > n then range(0, len(w) - n + 1, 10) || [len(w) - n] else [0] end)) i from s), x as (select distinct doc_id, array_to_string(w[i + 1:i + n], ' ') x from i) select doc_id, count(*) n from x where x <> '' group by doc_id")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.size(D.sliding_windows("text", F.lit(20))).cast("bigint").alias("n")).where("n > 0")
)
query("m06_cosine", "select a.label, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))), 5) x, a.vec_id from embeddings a, embeddings b where b.vec_id = 0")(
    lambda spark, sf: table(spark, sf, "embeddings").crossJoin(F.broadcast(table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("e")))).select("label", F.round(D.cosine("embedding", "e"), 5).alias("x"), "vec_id")
)

# every vector whose id is divisible by 50 is a target, the others of its label are its windows
_COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))))"
query("m06_semantic_recovery", f"with c as (select a.vec_id id, max({_COS}) best from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by a.vec_id) select vec_id id, round(best, 5) best, vec_id % 4 = 0 or coalesce(best >= 0.9, false) recovered from embeddings left join c on id = vec_id where vec_id % 50 = 0")(
    lambda spark, sf: _semantic(table(spark, sf, "embeddings"))
)


def _semantic(e):
    e = e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("group"))
    targets = e.where("id % 50 = 0")
    out = D.semantic_status(targets.select("id", (F.col("id") % 4 == 0).alias("correct")), neighbours.best_in_group(targets, e))
    return out.withColumn("best", F.round("best", 5))


# every vector whose id is divisible by 50 against all others
query("m06_nearest_vectors", f"select a.vec_id, round(max({_COS}), 5) best from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by a.vec_id")(
    lambda spark, sf: _nearest(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
)


def _nearest(e):
    return neighbours.nearest_vectors(e.where("id % 50 = 0"), e).select(F.col("id").alias("vec_id"), F.round("best", 5).alias("best"))


query("m07_judge_recovery", "select doc_id id, doc_id % 5 = 0 or contains(upper(text), 'YES') recovered from documents")(
    lambda spark, sf: D.judge_recovery(
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 == 0).alias("correct"), B.judge_prompt("text", "text").alias("prompt")),
        lambda asked: asked.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("reply")), "id"),
    ).select("id", "recovered")
)
query("g07_keyword_relevance", "with w as (select doc_id, text, list_distinct(regexp_extract_all(lower('alpha beta Gamma42 ' || lang || ' is the and words of ' || source || ' in one long last line'), '\\b([a-z0-9]{4,})\\b', 1)) ks from documents) select doc_id, round(len(list_filter(ks, lambda k: contains(lower(text), k))) / len(ks), 6) x from w")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.round(G.keyword_relevance(F.concat(F.lit("first line\nalpha beta Gamma42 "), "lang", F.lit(" is the and words of "), "source", F.lit(" in one long last line")), "text"), 6).alias("x"))
)
