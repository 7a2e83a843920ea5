"""Document fingerprints by Order MinHash (Marçais et al., 2019), in DataFrame functions only.

A text's k-mers (k consecutive words) are numbered by occurrence, so equal k-mers differ.
A permutation places them on a circle; the coordinates of the fingerprint look at it from
equally spaced points, each a permutation of its own (the same circle, shifted).  Each
coordinate takes the ``pick`` k-mers that come least from its point, puts them in the order
in which they stand in the text and hashes the tuple.  Two fingerprints agree in a share of
coordinates that falls with edit distance: both the k-mers and their order must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linechunks import let
from .shared import BLANK, keep

#: Coordinates (a power of two), k-mers in a coordinate's tuple, words in a k-mer.
COORDINATES, PICK, K = 32, 2, 2
_LAST = 2**63 - 1
_PLACE = 31  # bits for a k-mer's place in the text, as many as an array has places; the 32 bits above are its hash


def _pack(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, _PLACE + 1), _PLACE) + place


def _value(x: Column) -> Column:
    return F.shiftright(x, _PLACE)


def _numbered(s: Column) -> Column:
    """Occurrence-numbered k-mers from sorted packed ones: the first of a run keeps its hash,
    the others are hashed with their number."""
    new = lambda j: (j == 0) | (_value(F.get(s, j)) != _value(F.get(s, j - 1)))
    first = F.filter(s, lambda x, j: (j == 0) | (_value(x) != _value(F.get(s, j - 1))))

    def repeats(starts: Column) -> Column:
        run = F.transform(starts, lambda at, r: F.struct(at.alias("at"), F.coalesce(F.get(starts, r + 1), F.size(s)).alias("to")))
        long = F.filter(run, lambda r: r["to"] - r["at"] > 1)
        again = lambda j, at: _pack(F.xxhash64(_value(F.get(s, j)), j - at), F.get(s, j).bitwiseAND(F.lit((1 << _PLACE) - 1)))
        return F.flatten(F.transform(long, lambda r: F.transform(F.sequence(r["at"] + 1, r["to"] - 1), lambda j: again(j, r["at"]))))

    more = let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), new), repeats)
    return let(first, lambda f: F.when(F.size(f) == F.size(s), s).otherwise(F.sort_array(F.concat(f, more))))


def fingerprint(text: Column, coordinates: int = COORDINATES, k: int = K) -> Column:
    """Hex string of 8 digits a coordinate; zeros for a text without words (or null)."""
    bits = 63 - (coordinates.bit_length() - 1)
    bin_ = lambda x: F.shiftright(x, bits)

    def kmers(w: Column) -> Column:
        parts = lambda x, i: [x] + [F.get(w, i + j) for j in range(1, k)]
        return F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda x, i: _pack(F.xxhash64(*parts(x, i)), i)))

    def tuples(least: Column) -> Column:
        def one(i: Column) -> Column:
            ahead = F.slice(F.concat(F.filter(least, lambda x: bin_(x) >= i), least, least), 1, PICK)
            place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1))
            ordered = F.transform(F.array_sort(F.transform(ahead, lambda x: F.struct(place(x).alias("p"), _value(x).alias("v")))), lambda s: s["v"])
            return F.lpad(F.hex(F.xxhash64(ordered).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(coordinates - 1)), one), "")

    def of_numbered(e: Column) -> Column:
        least = F.filter(e, lambda x, j: (j < PICK) | (bin_(x) != bin_(F.get(e, j - PICK))))
        return let(least, tuples)

    bare = F.regexp_replace(text, f"^{BLANK}|{BLANK}\\z", "")
    words = F.when(F.length(bare) > 0, F.split(bare, BLANK))
    none = F.lit("0" * 8 * coordinates)
    return F.coalesce(let(words, lambda w: F.when(w.isNotNull(), let(kmers(w), lambda s: let(_numbered(s), of_numbered)))), none)


def likeness(a: Column, b: Column, coordinates: int = COORDINATES) -> Column:
    """Share of equal coordinates of two fingerprints, 0 to 1."""
    same = lambda i: F.when(F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8)), 1).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(coordinates - 1)), F.lit(0), lambda acc, i: acc + same(i))
    return total / F.lit(float(coordinates))


def followers(keys: DataFrame) -> DataFrame:
    """(_id, _row, n, next_id, next_row): the next key in ascending order, after the last the first.

    ``keys(_id, _row, n)`` is range-partitioned, so a task sorts one range; the first keys of
    the ranges (one row a partition) are then shifted by one."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(keys.repartitionByRange(parts, "_id", "_row").withColumn("_part", F.spark_partition_id()), "order")
    within = Window.partitionBy("_part").orderBy("_id", "_row")
    pair = F.struct("_id", "_row")
    heads = ranged.groupBy("_part").agg(F.min(pair).alias("head"))
    whole = Window.orderBy("_part")
    heads = heads.select("_part", F.coalesce(F.lead("head").over(whole), F.first("head").over(whole)).alias("after"))
    out = ranged.withColumn("next", F.lead(pair).over(within)).join(heads, "_part")
    next_ = F.coalesce("next", "after")
    return out.select("_id", "_row", "n", next_["_id"].alias("next_id"), next_["_row"].alias("next_row"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document in ascending doc_id, the last followed by the
    first.  near_edited and near_next are the likeness of the fingerprint to that of the
    edited text and of the next document.

    Null texts are empty.  Texts without words have the same fingerprint.  Rows equal in
    doc_id and text count as one document in the order and get equal results; rows that
    share a doc_id only follow each other by a hash of their texts; null ids come last
    (2**63 - 1 counts as null).  A single document follows itself.  Extra columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    t = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64(text).alias("_row"), text.alias("text"))
    order = keep(followers(t.select("_id", "_row", F.length("text").alias("n")).distinct()), "followers")
    # the text is dealt out by key once, for the heads and for the edits alike: both read the
    # same columns, so the exchange is reused
    dealt = t.repartition("_id", "_row")
    quarter = F.floor(F.col("n") / 4).cast("int")
    wanted = order.select(F.col("next_id").alias("_id"), F.col("next_row").alias("_row"), F.col("_id").alias("to_id"), F.col("_row").alias("to_row"), quarter.alias("q"))
    heads = dealt.join(wanted.hint("merge"), ["_id", "_row"]).select("to_id", "to_row", F.substring("text", F.lit(1), F.col("q")).alias("head"))
    heads = heads.dropDuplicates(["to_id", "to_row"]).withColumnsRenamed({"to_id": "_id", "to_row": "_row"})
    cut = F.substring("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 4).cast("int"))
    both = dealt.join(heads.hint("merge"), ["_id", "_row"]).withColumn("edited", F.concat(cut, "head"))
    # bytes, not hex digits, are what is written and moved
    made = both.select(
        "_id", "_row", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
        F.unhex(fingerprint(F.col("text"))).alias("fingerprint"), F.unhex(fingerprint(F.col("edited"))).alias("edited_fingerprint"),
    )
    made = keep(made, "fingerprints")
    own = made.join(order.select("_id", "_row", "next_id", "next_row"), ["_id", "_row"])
    after = made.groupBy(F.col("_id").alias("next_id"), F.col("_row").alias("next_row")).agg(F.first("fingerprint").alias("next_fingerprint"))
    out = own.join(after, ["next_id", "next_row"]).withColumns({c: F.hex(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    return out.select(
        F.when(F.col("_id") != _LAST, F.col("_id")).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
