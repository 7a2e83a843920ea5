"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

A rolling hash is taken over the hashes of every three consecutive lines; a chunk ends
where it is less than on both neighbouring lines, and after every second line within a
run of four or more equal lines.  So boundaries depend on nearby lines alone, survive
shifts, and leave chunks of two lines or more (three on average).  Chunks that occur more
than once anywhere are removed but for their first occurrence.  Places of repeated chunk
hashes are found first; only those chunks' bytes travel, and equality is decided on the
bytes: a hash that stands for several is joined by its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, free_name, keep

#: The rolling hash is h[i - 2] * FACTORS[0] + h[i - 1] * FACTORS[1] + h[i] modulo PRIME.
FACTORS, PRIME = (736338717, 435268391), 2147483647
#: Lines of an equal run that is cut every second line.
RUN = 4
_LAST = 2**63 - 1
_RANGES = "array<struct<start:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def line_chunks(text: Column) -> Column:
    """array<struct<start, end>>: the chunks of a text as 0-based inclusive line ranges; null for null."""

    def rolled(h: Column) -> Column:
        back = lambda i, k: F.coalesce(F.get(h, i - k), F.lit(0))
        return F.transform(h, lambda x, i: (back(i, 2) * FACTORS[0] + back(i, 1) * FACTORS[1] + x) % PRIME)

    def ends(h: Column, g: Column) -> Column:
        n = F.size(h)
        places = F.sequence(F.lit(0), n - 1)
        least = F.filter(places, lambda i: (F.get(g, i) < F.get(g, i - 1)) & (F.get(g, i) < F.get(g, i + 1)))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))

        def every_second(s: Column) -> Column:
            after = lambda j: F.coalesce(F.get(s, j + 1), n)
            cut = lambda at, j: F.when(after(j) - at >= RUN, F.sequence(at + 1, after(j) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
            return F.flatten(F.transform(s, cut))

        return F.array_sort(F.array_distinct(F.concat(least, let(starts, every_second), F.array(n - 1))))

    def ranges(e: Column) -> Column:
        return F.transform(e, lambda to, j: F.struct(F.coalesce(F.get(e, j - 1) + 1, F.lit(0)).alias("start"), to.alias("end")))

    # md5, as another engine can compute it too; 31 bits are enough to place boundaries
    hashes = F.transform(F.split(text, "\n"), lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("bigint") % PRIME)
    return let(hashes, lambda h: let(rolled(h), lambda g: let(ends(h, g), ranges)))


def _rest(lines: Column, gone: Column) -> Column:
    """The lines outside the sorted, disjoint ranges ``gone``."""
    after = lambda j: F.coalesce(F.get(gone, j - 1)["end"] + 1, F.lit(0))
    between = F.transform(gone, lambda g, j: F.slice(lines, after(j) + 1, g["start"] - after(j)))
    return F.flatten(F.concat(between, F.array(F.slice(lines, after(F.size(gone)) + 1, F.size(lines)))))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with ``text`` rid of repeated chunks, and n_lines and n_removed (long) added.

    A chunk of two or more lines is removed wherever the same bytes stand as a chunk in a
    document with a smaller doc_id (null ids come last), or earlier in the same document.
    Lines are split at "\\n" and joined by it again; a document that loses all lines keeps
    an empty text.

    A null text stays null, with 0 lines; an empty text is one line and stays.  Rows equal
    in doc_id and text count as one document: they lose the same lines.  Rows that share a
    doc_id only are ordered by a hash of their texts.  All columns of docs stay, whatever
    their names, but for n_lines and n_removed, which are replaced.  An empty table gives an
    empty result.
    """
    id_, row_, gone_ = (free_name(docs.columns, x) for x in ("line_id", "line_row", "line_gone"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")]
    bare = docs.where("text is not null").select(key[0].alias("id"), key[1].alias("row"), "text")
    body = lambda lines, c: F.array_join(F.slice(lines, c["start"] + 1, c["end"] - c["start"] + 1), "\n")
    many = F.filter(line_chunks(F.col("text")), lambda c: c["end"] > c["start"])
    hashed = let(F.split("text", "\n"), lambda lines: F.transform(many, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.xxhash64(body(lines, c)).alias("hash"))))
    places = keep(bare.select("id", "row", F.inline(hashed)), "line-chunks")
    # kept, so that the joins below have plain exchanges on both sides, which are split where a chunk is hot
    distinct_places = keep(places.distinct(), "line-places")
    repeated = keep(distinct_places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "line-repeated")
    wanted = distinct_places.join(repeated.hint("merge"), "hash", "left_semi").groupBy("id", "row").agg(F.collect_list(F.struct("hash", "start", "end")).alias("chunks"))
    # one plan at every size: the list of documents grows with the corpus
    texts = bare.join(wanted.hint("merge"), ["id", "row"])
    pieces = let(F.split("text", "\n"), lambda lines: F.transform("chunks", lambda c: F.struct(c["hash"].alias("hash"), c["start"].alias("start"), c["end"].alias("end"), body(lines, c).alias("bytes"))))
    pieces = keep(texts.select("id", "row", F.inline(pieces)), "line-bytes")
    place = F.struct("id", "row", "start")
    variants = keep(pieces.groupBy("hash", "bytes").agg(F.min(place).alias("first")), "line-variants")
    single = keep(variants.groupBy("hash").agg(F.count("*").alias("n"), F.min("first").alias("first")), "line-single")
    spot = ["id", "row", "start", "end"]
    gone = pieces.join(single.where("n = 1").drop("n").hint("merge"), "hash").where(place != F.col("first")).select(*spot)
    clash = variants.join(single.where("n > 1").select("hash"), "hash", "left_semi")  # two contents of one hash
    gone = gone.union(pieces.join(clash, ["hash", "bytes"]).where(place != F.col("first")).select(*spot))
    gone = keep(gone.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).cast(_RANGES).alias(gone_)), "line-gone")
    drop(places, distinct_places, repeated, pieces, variants, single)
    lines = F.split("text", "\n")
    lost = F.aggregate(gone_, F.lit(0).cast("long"), lambda a, g: a + g["end"] - g["start"] + 1)
    out = docs.drop("n_lines", "n_removed").withColumns({id_: key[0], row_: key[1]})
    out = out.join(gone.withColumnsRenamed({"id": id_, "row": row_}).hint("merge"), [id_, row_], "left")
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(lost, F.lit(0).cast("long")))
    kept = F.array_join(let(lines, lambda x: _rest(x, F.col(gone_))), "\n")
    out = out.withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(kept))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
