"""Records of large JSON files (S06): one array, or object of objects, is read by many tasks.

A file is read as the pieces between its closing braces, which Spark splits by bytes wherever
it likes.  What a brace or quote means depends on all that stands before it, so a first pass
sums up each split for both cases, that it begins inside a string or outside; the sums are
folded over the splits of a file in order (one row a split); and a second pass, which knows
its beginning, cuts the records.  A record that lies across splits is put together from
its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARK = re.compile(r'\\.|["{]', re.S)
_WRAPPED = re.compile(r'\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[')
#: Brace depth around records, and whether a record's key says what it is.
LIST, WRAPPED, MAP = "list", "wrapped", "map"


def kind_of(start: str) -> str:
    """The shape of a file by its first piece: a list of records, an object that holds such a list, an object of records."""
    return LIST if start.lstrip("﻿ \t\r\n").startswith("[") else WRAPPED if _WRAPPED.match(start) else MAP


def advance(piece: str, quoted: bool, depth: int, opened=None) -> tuple[bool, int]:
    """The state behind a piece and the brace that ended it; opened(depth, place) is told of opening braces."""
    for m in _MARK.finditer(piece):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif c == "{" and not quoted:
            if opened:
                opened(depth, m.start())
            depth += 1
    return quoted, depth - (not quoted)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, str]]]]:
    """((file, start), pieces of a batch) in the order they are read."""
    for b in batches:
        files, starts, places, values = (c.to_pylist() for c in b.columns)
        at = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], starts[i]) != (files[at], starts[at]):
                yield (files[at], starts[at]), list(zip(places[at:i], values[at:i]))
                at = i


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> (file, start, kind, out, in): a row a split; ``out`` and ``in`` are the state behind it and the
    gain in depth if it begins outside or inside a string."""
    now, state, kind = None, [], None

    def row():
        return pa.record_batch([pa.array([v], t) for v, t in zip((*now, kind, *state[0], *state[1]), (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()))], names=["file", "start", "kind", "out_quoted", "out_depth", "in_quoted", "in_depth"])

    for split, pieces in _splits(batches):
        if split != now:
            if now:
                yield row()
            now, state, kind = split, [(False, 0), (True, 0)], kind_of(pieces[0][1]) if split[1] == 0 else None
        for _, piece in pieces:
            state = [advance(piece, *s) for s in state]
    if now:
        yield row()


def _cut(begins: dict):
    """Pieces -> (file, start, pos, role, key, text): whole records, and the parts of those across splits ("tail" up to
    the end of one begun before, "through" where it doesn't end either, "head" of one that goes on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        quoted = depth = base = pos = 0
        own: list[str] = []  # the record so far
        role, key, prefix = None, "", ""

        def emit(role, pos, key, text):
            out.append((*now, pos, role, key, text))

        def table():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "start", "pos", "role", "key", "text"])

        def ended():
            if role is not None:
                emit("through" if role == "tail" else "head", pos, key, "".join(own))

        for split, pieces in _splits(batches):
            if split != now:
                ended()
                now = split
                quoted, depth, base = begins[split]
                own, prefix, key = [], "", ""
                role = "tail" if depth > base else None
                pos = pieces[0][0]
            for place, piece in pieces:
                first: list[int] = []
                before = depth
                quoted, depth = advance(piece, quoted, depth, lambda d, i: first.append(i) if d == base else None)
                if role is None:
                    if not first:
                        prefix += piece + ("" if before == depth else "}")
                        continue
                    role, key, own, pos = "record", prefix + piece[: first[0]], [], place
                    piece = piece[first[0] :]
                own.append(piece + "}")
                if depth == base and not quoted:
                    emit(role, pos, key, "".join(own))
                    role, own, prefix = None, [], ""
            if len(out) >= 2048:
                yield table()
                out.clear()
        ended()
        yield table()

    return run


def json_records(spark: SparkSession, path) -> DataFrame:
    """(path, pos, text): the records of JSON files, in order of pos within a file.  A file is a list of objects,
    an object whose first value is such a list (what follows the list is no record), or an object of
    objects.  Files without a record give none; a file that is no JSON gives what its braces say."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"), "value")
    sums = pieces.mapInArrow(_summed, "file string, start long, kind string, out_quoted boolean, out_depth long, in_quoted boolean, in_depth long")
    splits = sorted(sums.collect(), key=lambda r: (r.file, r.start))  # one row a split
    begins, state = {}, {}
    for r in splits:
        quoted, depth, base = state.get(r.file, (False, 0, 0))
        base = base if r.kind is None else 0 if r.kind == LIST else 1
        begins[r.file, r.start] = (quoted, depth, base)
        state[r.file] = (r.in_quoted, depth + r.in_depth, base) if quoted else (r.out_quoted, depth + r.out_depth, base)
    wrapped = {r.file for r in splits if r.kind == WRAPPED}
    cut = pieces.mapInArrow(_cut(begins), "file string, start long, pos long, role string, key string, text string")
    whole = cut.where("role = 'record'").select("file", "pos", "key", "text")
    parts = cut.where("role <> 'record'")
    w = Window.partitionBy("file").orderBy("start", "pos")  # two rows a split at most
    parts = parts.withColumn("_r", F.sum((F.col("role") == "head").cast("int")).over(w)).where("_r > 0")
    joined = parts.groupBy("file", "_r").agg(F.array_sort(F.collect_list(F.struct("start", "pos", "key", "text"))).alias("_p"))
    joined = joined.select("file", F.get("_p", 0)["pos"].alias("pos"), F.get("_p", 0)["key"].alias("key"), F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))
    out = whole.unionByName(joined)
    # what follows the list has a key of its own in front, or the list's end
    other = F.col("file").isin(*wrapped) & F.col("key").rlike(r":\s*\z|\]") if wrapped else F.lit(False)
    return out.where(~other).select(F.col("file").alias("path"), "pos", "text")
