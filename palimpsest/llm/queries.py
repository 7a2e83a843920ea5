"""The queries of the llm operators: thin digests over each operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, decontam, gru, langid, linechunks, minhash, mixing, nbsvm, ordermin, preference, repair, seedextend, simhash
from .shared import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32(doc_id) mod 5 is not 1, scored for all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 1
    out = gru.learn_and_score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 over all documents; 150 % of all words, at most twice a source."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality learned where crc32(doc_id) mod 5 is not 0, scored for all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where((fold_of(F.col("doc_id"), 5) != 0) & F.col("label").isNotNull())
    # labels grow with the corpus: a merge join at every size
    model = nbsvm.fit(docs.select("doc_id", "text").where(~held_out).join(labels.hint("merge"), "doc_id"))
    out = nbsvm.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the whole table."""
    conversations = table(spark, sf_dir, "conversations")
    out = preference.preference_rows(conversations, preference.adjacent_pairs(conversations))
    spans = [preference.spans_text(F.col(c)).alias(c) for c in ("chosen_spans", "rejected_spans")]
    return out.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", *spans)


def op7_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32(doc_id) mod 4 is not 2, predicted for all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    profiles = langid.learn_profiles(docs.select("doc_id", "text", "lang").where(~held_out))
    return langid.predict_language(docs, profiles).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks of all documents."""
    out = linechunks.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 words or more over all documents."""
    out = seedextend.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most two differing bits, over all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters after three rounds, over all embeddings."""
    return balltree.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations, damaged first."""
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    first = (op1_gru_lm, op2_minhash_near_dedup, op3_pivotal_mix, op4_simhash_decontam, op5_nb_svm_quality, op6_preference_format, op7_rank_order_langid, op8_order_minhash, op9_line_chunks, op10_seed_extend)
    return {f.__name__: f for f in (*first, op11_simhash_tiles, op12_ball_tree_clusters, op13_conversation_repair)}


_BLANK = r"[\x20\x09-\x0D]+"

OP2_SQL = rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '') w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end s
  from words),
sh as (select doc_id, len(s) n, unnest(s) g from sets),
links as (
  select a.doc_id x, b.doc_id y from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
  select doc_id, doc_id root from documents
  union
  select r.doc_id, l.y from reach r join links l on r.root = l.x)
select s.doc_id, len(s.s)::bigint n_shingles, r.component_id, s.doc_id = r.component_id as kept
from sets s join (select doc_id, min(root) component_id from reach group by doc_id) r using (doc_id)
"""

OP6_SQL = r"""
with t as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn, role, text) t
  from conversations where conv_id is not null group by conv_id),
p as (
  select conv_id // 2 pair_id, max(case when conv_id % 2 = 0 then conv_id end) chosen_id, max(case when conv_id % 2 = 1 then conv_id end) rejected_id
  from t group by 1),
b as (
  select p.*, coalesce(c.t, []) c, coalesce(r.t, []) r
  from p left join t c on c.conv_id = chosen_id left join t r on r.conv_id = rejected_id),
n as (
  select *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role <> r[i].role or c[i].text <> r[i].text)[1] - 1, least(len(c), len(r))) n_common
  from b),
s as (
  select *, c[1:n_common] pt, c[n_common + 1:len(c)] ct, r[n_common + 1:len(r)] rt from n),
sides as (
  select pair_id, 'c' side, ct turns from s union all select pair_id, 'r', rt from s union all select pair_id, 'p', pt from s),
flat as (
  select pair_id, side, i, turns[i].role role, turns[i].text txt from (select *, unnest(range(1, len(turns) + 1)) i from sides)),
placed as (
  select *, sum(length(role) + length(txt) + 13) over (partition by pair_id, side order by i) - length(txt) - 8 head from flat),
done as (
  select pair_id, side, string_agg('<|' || role || '|>' || chr(10) || txt || '<|end|>' || chr(10), '' order by i) body,
    string_agg(case when role = 'assistant' then head::bigint::varchar || '-' || (head + length(txt))::bigint::varchar end, ';' order by i) spans
  from placed group by pair_id, side)
select s.pair_id, s.chosen_id, s.rejected_id, s.n_common::int n_common, coalesce(p.body, '') prompt, coalesce(c.body, '') chosen, coalesce(r.body, '') rejected,
  coalesce(c.spans, '') chosen_spans, coalesce(r.spans, '') rejected_spans
from s left join done p on p.pair_id = s.pair_id and p.side = 'p' left join done c on c.pair_id = s.pair_id and c.side = 'c'
left join done r on r.pair_id = s.pair_id and r.side = 'r'
"""

OP9_SQL = rf"""
with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
h as (select *, list_transform(ls, lambda x: ('0x' || md5(x)[1:8])::bigint % {linechunks.PRIME}) hs from l),
g as (
  select *, list_transform(range(1, len(ls) + 1),
    lambda i: (case when i > 2 then hs[i - 2] else 0 end * {linechunks.FACTORS[0]} + case when i > 1 then hs[i - 1] else 0 end * {linechunks.FACTORS[1]} + hs[i]) % {linechunks.PRIME}) gs from h),
line as (select doc_id, i, hs[i] x, hs[i - 1] y, gs[i - 1] b, gs[i] m, gs[i + 1] a, len(ls) n from (select *, unnest(range(1, len(ls) + 1)) i from g)),
run as (select *, sum(case when i = 1 or x <> y then 1 else 0 end) over (partition by doc_id order by i) r from line),
at_ as (select *, row_number() over (partition by doc_id, r order by i) j, count(*) over (partition by doc_id, r) len_ from run),
e as (
  select doc_id, list(i order by i) es from at_
  where i = n or (m < b and m < a) or (len_ >= {linechunks.RUN} and j % 2 = 0) group by doc_id),
c as (
  select doc_id, start_, end_, array_to_string(ls[start_:end_], chr(10)) body
  from (select doc_id, ls, es[j] end_, coalesce(es[j - 1] + 1, 1) start_ from (select *, unnest(range(1, len(es) + 1)) j from e join l using (doc_id)))
  where end_ > start_),
gone as (
  select doc_id, list(distinct i) js
  from (select doc_id, unnest(range(start_, end_ + 1)) i from (select *, row_number() over (partition by body order by doc_id, start_) rn from c) where rn > 1)
  group by doc_id)
select doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(js), 0)::bigint n_removed,
  sha256(case when js is null then text else array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(js, i)), lambda i: ls[i]), chr(10)) end) kept_sha256
from l left join gone using (doc_id)
"""

OP10_SQL = rf"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') w from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + 49], ' ') t from (select doc_id, w, unnest(range(1, len(w) - 48)) i from words)),
dup as (select doc_id, i from win join (select t, min(doc_id) lo from win group by t) f using (t) where doc_id > lo),
gone as (select doc_id, list(distinct j) js from (select doc_id, unnest(range(i, i + 50)) j from dup) group by doc_id),
kept as (
  select doc_id, len(w) n, coalesce(len(js), 0) r,
    case when js is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda j: not list_contains(js, j)), lambda j: w[j]) end k
  from words left join gone using (doc_id))
select doc_id, n::bigint n_words, r::bigint n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from kept
"""



def _nearest(name: str, centroids: str) -> str:
    return f"""{name} as materialized (
  select rid, any_value(vec_id) vec_id, any_value(c) c, min({{'d': d, 'k': k}}) m from (
    select rid, vec_id, v.c, k, list_sum(list_transform(range(1, 65), lambda i: (v.c[i] - z.c[i]) * (v.c[i] - z.c[i])))::bigint d from v, {centroids} z)
  group by rid),"""


def _moved(name: str, assigned: str, centroids: str) -> str:
    return f"""{name} as materialized (
  select z.k, coalesce(n.c, z.c) c from {centroids} z left join (
    select k, list(q order by i) c from (
      select k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint q
      from (select m.k k, c[i] x, i from (select *, unnest(range(1, 65)) i from {assigned})) group by k, i)
    group by k) n using (k)),"""


OP12_SQL = "\n".join(
    [
        r"""
with v as materialized (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) c from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
z0 as materialized (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), c) - 1 k, c from v qualify k < 16),""",
        *[part for r in range(3) for part in (_nearest(f"a{r}", f"z{r}"), _moved(f"z{r + 1}", f"a{r}", f"z{r}"))],
        _nearest("a3", "z3"),
        r"""done as (select vec_id, m.k k, m.d d from a3)
select vec_id, k::int as cluster, d distance, sum(d) over (partition by k)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha256(array_to_string(z3.c, ',')) centroid_sha256
from done join z3 using (k)""",
    ]
)


def _least(*options: str) -> str:
    return "list_min([" + ", ".join(options) + "])"


def _edit(letter: str, cost: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a}}"


def _row_edits(state: str, after: str, keeps: dict[str, str]) -> str:
    """Cheapest edit of a row in a state, by the costs after it; ``keeps``: what rows may be kept as."""
    kept = [f"case when ini = '{i}' and stays then {_edit('K', 'cut', to)} end" for i, to in keeps.items()]
    return _least(_edit("D", "4", after), *kept, f"case when stays then {_edit('R', '3 + cut', list(keeps.values())[-1])} end")


# an automaton over rows and inserts, from the last row back: another formulation than the operator's
OP13_SQL = rf"""
with recursive crc as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) bs
  from conversations),
kinds as (
  select conv_id, turn, role, txt, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, bs), lambda h, x:
    list_reduce(list_prepend(xor(h, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda b, o: xor(b >> 1, (b & 1) * 3988292384::bigint)))) % 20 kind
  from crc),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end role, case kind when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end txt,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) again
  from kinds),
placed as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, txt, again) i from hurt),
faults as materialized (
  select *, role[1] ini, row_number() over (partition by conv_id, role, txt order by i) > 1 twice, not regexp_matches(txt, '[^\x20\x09-\x0D]') bare,
    regexp_matches(txt, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') cut_off
  from placed),
graded as materialized (
  select conv_id, i, turn, role, txt, ini, bare, not bare and twice again, not bare and not twice and cut_off cut_off, not bare and not twice stays,
    case when not bare and not twice and cut_off then 3 else 0 end cut, lag(ini) over (partition by conv_id order by i) before
  from faults),
go as (
  select conv_id, max(i) i, {{'c': 0, 'a': ''}} g0, {{'c': 6, 'a': 'II'}} gs, {{'c': 3, 'a': 'I'}} gu, {{'c': 0, 'a': ''}} ga from graded group by conv_id
  union all
  select conv_id, i - 1, {_least('b0', _edit('I', '3', 'bu'), _edit('II', '6', 'ba'))}, {_least('bs', _edit('I', '3', 'bu'), _edit('II', '6', 'ba'))},
    {_least('bu', _edit('I', '3', 'ba'))}, {_least('ba', _edit('I', '3', 'bu'))}
  from (
    select go.conv_id, go.i, {_row_edits('g0', 'g0', {'s': 'gs', 'u': 'gu'})} b0, {_row_edits('gs', 'gs', {'u': 'gu'})} bs,
      {_row_edits('gu', 'gu', {'a': 'ga'})} bu, {_row_edits('ga', 'ga', {'u': 'gu'})} ba
    from go join graded on go.conv_id is not distinct from graded.conv_id and go.i = graded.i)),
best as materialized (select conv_id, g0.c as cost, g0.a as audit from go where i = 0),
letters as (select conv_id, audit, unnest(range(1, len(audit) + 1)) k from best),
steps as (
  select conv_id, k, audit[k] l, sum(case when audit[k] <> 'I' then 1 else 0 end) over w i, sum(case when audit[k] <> 'D' then 1 else 0 end) over w p from letters
  window w as (partition by conv_id order by k)),
said as (
  select s.conv_id, k, l, p, case when l = 'K' then role end kept_role, case when l = 'I' then '' else txt end txt,
    coalesce(max(case when p = 1 and l = 'K' and ini = 's' then 1 end) over (partition by s.conv_id), 0) first_s
  from steps s left join graded g on s.conv_id is not distinct from g.conv_id and s.i = g.i where l <> 'D'),
texts as (
  select conv_id, string_agg(coalesce(kept_role, case when (p - first_s) % 2 = 1 then 'user' else 'assistant' end) || ':' || txt, chr(10) order by k) body from said group by conv_id),
counts as (
  select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) gaps, sum(bare::int) blank, sum(again::int) duplicate, sum(cut_off::int) truncated,
    sum(case when i > 1 and before || ini not in ('su', 'ua', 'au') then 1 else 0 end) illegal
  from graded group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') audit, sha256(coalesce(body, '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id
left join best b on o.conv_id is not distinct from b.conv_id left join texts t on o.conv_id is not distinct from t.conv_id
"""


def oracle_sql() -> dict[str, str]:
    out = {"op2_minhash_near_dedup": OP2_SQL, "op6_preference_format": OP6_SQL, "op9_line_chunks": OP9_SQL, "op10_seed_extend": OP10_SQL}
    return out | {"op12_ball_tree_clusters": OP12_SQL, "op13_conversation_repair": OP13_SQL}
