"""Preference formatting of conversation pairs, in DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered
once as the prompt; what follows in each is its completion, with the spans of assistant
text marked, on which alone a loss should count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, trained: str) -> Column:
    """array<struct<start, end>>: code point ranges of the trained role's texts in the rendered turns."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    start = F.from_json(F.lit('{"at":0,"spans":[]}'), kind)

    def step(acc, t):
        head = acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        end = head + F.length(t["text"])
        span = F.when(t["role"] == trained, F.array(F.struct(head.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(acc["spans"], span).alias("spans")).cast(kind)

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations 2k and 2k + 1, the even one chosen; each
    conversation is in one pair, the other side null where its partner is missing."""
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c")).distinct()
    pair, odd = F.floor(F.col("c") / 2).cast("long"), F.pmod("c", F.lit(2)) == 1
    return ids.groupBy(pair.alias("pair_id")).agg(F.max(F.when(~odd, F.col("c"))).alias("chosen_id"), F.max(F.when(odd, F.col("c"))).alias("rejected_id"))


def preference_rows(conversations: DataFrame, pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_spans,
    rejected_spans) for each row of ``pairs(pair_id, chosen_id, rejected_id)``.

    Turns are taken in order of turn, then role and text; equal turns have the same role
    and text.  A null role or text is an empty one.  A missing conversation (or a null id)
    has no turns: the common prefix is empty and that completion too.  Rows of
    ``conversations(conv_id, turn, role, text, ...)`` with a null conv_id belong to none.
    Repeated pairs are each formatted; extra columns are ignored.
    """
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    side = lambda name: whole.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    c, r = F.coalesce("chosen_turns", none), F.coalesce("rejected_turns", none)
    differ = lambda i: (F.get(c, i)["role"] != F.get(r, i)["role"]) | (F.get(c, i)["text"] != F.get(r, i)["text"])
    least = F.least(F.size(c), F.size(r))
    first = F.get(F.filter(F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>")), differ), 0)
    both = both.withColumn("n_common", F.coalesce(first, least))
    rest = lambda t: F.slice(t, F.col("n_common") + 1, F.size(t))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_common",
        _render(F.slice(c, 1, F.col("n_common"))).alias("prompt"),
        _render(rest(c)).alias("chosen"), _render(rest(r)).alias("rejected"),
        _spans(rest(c), trained).alias("chosen_spans"), _spans(rest(r), trained).alias("rejected_spans"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as "start-end" joined by ";"."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
