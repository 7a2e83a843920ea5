"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document starts with the copy number that its source needs on average: a whole
part and a fraction.  Two fractional documents of a source are paired and mass (copies
times size) moves from one to the other, in a random direction whose odds keep both
expectations, until one of them is whole.  Buckets of some 64 documents are reduced in
one fold each, largest documents first; the one fraction that a bucket leaves goes up a
tree of fan-in 64, so a source of n documents takes log64(n) small rounds and no task
ever holds more than a bucket.  What remains at the root of a source is rounded to the
nearer whole, and the words that this adds or loses are settled with documents of one
leaf bucket, largest first, as far as their sizes fit; so a source misses its target by
less than half of one document, and commonly by a few words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, keep, n_words

FAN_IN = 64


def _uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from ``sizes(source, n, source_size)``, one row a source.

    Sources by code point, null last, take the weights in turn and share ``share`` times
    all sizes; a target stops at cap times its source's size and the excess goes to the
    others by weight, until none is above.  That fixed point is target = min(weight * level,
    cap * size) with one level for all, found by running sums over sources in the order in
    which they reach their caps.  Works on one row a source (a registry, not a corpus).
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / open_weight)
    s = s.withColumn("level", F.max(F.when(F.col("w") * F.col("level") <= F.col("most"), F.col("level"))).over(everything))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(F.col("w") * F.col("level"), F.col("most")), F.col("most")))
    return s.select("source", "n", "source_size", target.alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Reduce an array of (key, doc_id, size, nth, p) to the last fractional unit and the whole ones."""
    kind = "struct<left:struct<key:bigint,doc_id:bigint,size:bigint,nth:bigint,p:double>,done:array<struct<doc_id:bigint,size:bigint,nth:bigint,x:int>>>"
    start = F.from_json(F.lit('{"done":[]}'), kind)
    whole = lambda u, x: F.array(F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["nth"].alias("nth"), x.cast("int").alias("x")))

    def put(u, p):
        return F.struct(u["key"].alias("key"), u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["nth"].alias("nth"), p.alias("p"))

    def pair(acc, b):
        a = acc["left"]
        ratio = b["size"] / a["size"]  # copies that a gains for one copy of b
        up = F.least(1 - a["p"], b["p"] * ratio)
        down = F.least(a["p"], (1 - b["p"]) * ratio)
        rise = _uniform(F.lit(seed), F.lit(level), a["key"], b["key"]) * (up + down) < down
        pa = F.when(rise, a["p"] + up).otherwise(a["p"] - down)
        pb = F.when(rise, b["p"] - up / ratio).otherwise(b["p"] + down / ratio)
        # the side that stopped the move is whole, whatever the last bit of its sum says
        a_whole = F.when(rise, 1 - a["p"] <= b["p"] * ratio).otherwise(a["p"] <= (1 - b["p"]) * ratio)
        a_end, b_end = F.when(rise, 1).otherwise(0), F.when(rise, 0).otherwise(1)
        next_ = F.when(a_whole, put(b, F.least(F.greatest(pb, F.lit(0.0)), F.lit(1.0)))).otherwise(put(a, F.least(F.greatest(pa, F.lit(0.0)), F.lit(1.0))))
        done = F.when(a_whole, whole(a, a_end)).otherwise(whole(b, b_end))
        moved = F.struct(next_.alias("left"), F.concat(acc["done"], done).alias("done"))
        return F.when(a.isNull(), F.struct(put(b, b["p"]).alias("left"), acc["done"].alias("done")).cast(kind)).otherwise(moved.cast(kind))

    largest_first = F.transform(
        F.array_sort(F.transform(units, lambda u: F.struct((-u["size"]).alias("o"), u["key"].alias("k"), u.alias("u")))), lambda s: s["u"]
    )
    return F.aggregate(largest_first, start, pair)


def _settle(done: Column, owed: Column) -> Column:
    """Flip whole units of a bucket, largest first, while that brings ``owed`` words nearer to none."""
    kind = "struct<owed:double,done:array<struct<doc_id:bigint,size:bigint,nth:bigint,x:int>>>"
    order = F.transform(F.array_sort(F.transform(done, lambda u: F.struct((-u["size"]).alias("o"), u["nth"].alias("n"), u["doc_id"].alias("d"), u.alias("u")))), lambda s: s["u"])

    def step(acc, u):
        gain = F.when(u["x"] == 0, u["size"]).otherwise(-u["size"])
        flip = F.abs(acc["owed"] - gain) < F.abs(acc["owed"])
        new = F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["nth"].alias("nth"), F.when(flip, 1 - u["x"]).otherwise(u["x"]).alias("x"))
        return F.struct(F.when(flip, acc["owed"] - gain).otherwise(acc["owed"]).alias("owed"), F.concat(acc["done"], F.array(new)).alias("done")).cast(kind)

    start = F.struct(F.coalesce(owed, F.lit(0.0)).alias("owed"), F.from_json(F.lit("[]"), "array<struct<doc_id:bigint,size:bigint,nth:bigint,x:int>>").alias("done")).cast(kind)
    return F.aggregate(order, start, step, lambda acc: acc["done"])


def _decisions(folded: DataFrame) -> DataFrame:
    return folded.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.nth", "d.x")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, nth, source_size, target, copies) for each row of ``docs(doc_id, text, source, ...)``.

    size counts the words of the text (null: 0).  copies is between 0 and cap, and the
    sum of copies * size over a source comes within half a document of its target, commonly nearer (see
    source_targets).  Each document's expected copies are target / source_size.  The
    result depends on the rows alone, not on their order or partitioning.

    Null or blank texts have size 0 and no copy.  A null source is a source of its own,
    a null doc_id an id like any other.  Rows equal in doc_id, source and size are told
    apart by nth = 1, 2, ...  Other columns are ignored.  An empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    rows = keep(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-sizes")
    positive = F.when(F.col("size") > 0, F.col("m")).otherwise(F.lit(0))
    sources = keep(source_targets(rows.groupBy("source").agg(F.sum(positive).alias("n"), F.sum(F.col("m") * F.col("size")).alias("source_size")), weights, share, cap), "mix-sources")
    most = sources.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("base", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio))
    units = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")
    s = sources.withColumnRenamed("source", "_source")
    units = units.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "nth")
    now = units.where(fractional).select(
        "source",
        F.pmod(key, F.ceil(F.col("n") / FAN_IN)).alias("bucket"),
        F.struct(key.alias("key"), "doc_id", "size", "nth", "p").alias("u"),
    )
    decided = [units.where(~fractional).select("source", "doc_id", "size", "nth", F.lit(0).alias("x"))]
    levels = max(1, math.ceil(math.log(max(most, 2)) / math.log(FAN_IN)) + 1)
    for level in range(levels):
        folded = now.groupBy("source", "bucket").agg(F.collect_list("u").alias("units"))
        folded = keep(folded.select("source", "bucket", _fold(F.col("units"), level, seed).alias("f")), "mix-level")
        done = folded
        if level == 0:
            leaf, done = folded.where("bucket = 0"), folded.where("bucket <> 0")
        decided.append(_decisions(done.select("source", F.col("f.done").alias("done"))))
        now = folded.select("source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), F.col("f.left").alias("u"))
    root = now.select("source", "u.doc_id", "u.size", "u.nth", F.round("u.p").cast("int").alias("x"), ((F.col("u.p") - F.round("u.p")) * F.col("u.size")).alias("owed"))
    owed = root.select(F.col("source").alias("_source"), "owed")
    leaf = leaf.join(owed, F.col("source").eqNullSafe(F.col("_source")), "left")
    decided.append(_decisions(leaf.select("source", _settle(F.col("f.done"), F.col("owed")).alias("done"))))
    decided.append(root.drop("owed"))
    x = decided[0]
    for d in decided[1:]:
        x = x.union(d)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("x")).otherwise(0)
    x = x.join(s, F.col("source").eqNullSafe(F.col("_source")))
    return x.select("doc_id", "source", "size", "nth", "source_size", "target", copies.cast("int").alias("copies"))


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """docs with a ``copies`` column (int, at least 1); rows that the mix leaves out are gone.
    Null doc_ids and repeated rows get copies as mix_sources tells them apart: rows equal in
    doc_id, source and size are numbered by a hash of their texts.  All other columns stay,
    whatever their names."""
    names = []
    for stem in ("mix_doc", "mix_source", "mix_size", "mix_nth", "mix_copies"):
        names.append(free_name(docs.columns + names, stem))
    doc, source, size, nth, copies = names
    plan = mix_sources(docs, **params).where("copies > 0").select(
        F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), F.col("nth").alias(nth), F.col("copies").alias(copies)
    )
    own = [F.col("doc_id").cast("long"), F.col("source"), n_words(F.col("text"))]
    number = F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64("text")))
    mine = [free_name(docs.columns + names, x) for x in ("own_size", "own_nth")]
    sized = docs.withColumns({mine[0]: own[2], mine[1]: number})
    on = own[0].eqNullSafe(F.col(doc)) & own[1].eqNullSafe(F.col(source)) & (F.col(mine[0]) == F.col(size)) & (F.col(mine[1]) == F.col(nth))
    return sized.join(plan, on).select(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"], F.col(copies).alias("copies"))
