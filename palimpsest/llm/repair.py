"""Repair of the turn structure of conversations by a retained-subsequence DP.

Rows are kept, given another role or deleted, and empty turns inserted, so that the roles
read ``(s?(ua)+)?`` at the least cost.  The DP runs over the rows that are retained: what
lies between two of them is deleted, priced by differences of prefix sums, and the pair of
their roles says how many turns must be inserted.  From the last row back, one running
minimum a role holds the cheapest row to go on with, so a row takes constant time.

The DP sees no texts, only initials, faults and hashes; the texts travel once more and are
hashed as they stream past the decisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Costs of the edits.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
_SOLID = "[^\\x20\\x09-\\x0D]"
#: Turns to insert between a role and the next; from "" (nothing yet) and to "" (the end).
_BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
_LAST = {"": 0, "s": 2, "u": 1, "a": 0}
_AFTER = {last: [(to, n) for (of, to), n in _BETWEEN.items() if of == last] for last in _LAST}
_MOST = 2**63 - 1


def best_edits(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of (initial, fault) rows; fault is "", "blank", "duplicate"
    or "truncated".  Audit: K, R, D a row and I a turn inserted, in order; of equal costs the
    least in ASCII.

    Deletions of a gap come before its insertions, as D < I.  Of equal continuations the one with
    the farthest next row has the longest run of D, then more I come before K, and K before R.
    """
    n = len(rows)
    # a row retained in role t: least cost from there on less what is deleted up to the row
    least: dict[str, tuple[int, int]] = {}  # role -> (cost, row), the farthest row of equal cost
    step: list[dict[str, tuple[int, str, int]]] = [{} for _ in rows]  # row, role -> next row, its role, inserted

    def onward(last: str, i: int) -> tuple[int, tuple[int, str, int]]:
        """Cost of all that follows rows[i] if that is in role ``last``."""
        found = [(DELETE * n + INSERT * _LAST[last], -n, -_LAST[last], 0, "")]
        for to, more in _AFTER[last]:
            if to in least:
                cost, j = least[to]
                found.append((cost + INSERT * more, -j, -more, rows[j][0] != to, to))
        cost, j, more, _, to = min(found)
        return cost - DELETE * (i + 1), (-j, to, -more)

    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        if fault in ("blank", "duplicate"):
            continue
        now = {}
        for t in "sua":
            if t != initial and t == "s":
                continue
            rest, step[i][t] = onward(t, i)
            now[t] = (REROLE if t != initial else 0) + (CUT if fault else 0) + rest + DELETE * i
        for t, cost in now.items():
            if t not in least or cost < least[t][0]:
                least[t] = (cost, i)
    cost, go = onward("", -1)
    audit, i = [], -1
    while True:
        j, to, more = go
        audit.append("D" * (j - i - 1) + "I" * more)
        if j == n:
            return cost, "".join(audit)
        audit.append("K" if rows[j][0] == to else "R")
        i, go = j, step[j][to]


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Groups of rows, sorted by their first column, across batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[0])


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_RESULT = _REPORT + ", repaired_sha256 string"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, initial, fault, key, gone) -> one report a conversation."""
    out, size = [], 0
    for conv, group in _clusters(batches):
        rows, seen, turns = [], set(), []
        for _, turn, initial, fault, key, gone in group:
            if gone:
                continue
            if not fault or fault == "truncated":
                fault = "duplicate" if key in seen else fault
            seen.add(key)
            rows.append((initial, fault))
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
        count = lambda f: sum(x == f for _, x in rows)
        gaps = min(turns[-1] - turns[0] + 1 - len(turns), _MOST) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = best_edits(rows)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit))
        size += len(audit)
        if len(out) >= 4096 or size >= 1 << 24:
            yield _table(out, _REPORT)
            out, size = [], 0
    yield _table(out, _REPORT)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], {"long": pa.int64(), "string": pa.string()}[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, report, role, text), the row with the report first -> the report with the hash."""
    out = []
    for _, group in _clusters(batches):
        report = next(group)[1]
        audit, at, n, shift, h = report["audit"], 0, 0, 0, hashlib.sha256()

        def put(text: str, role: str | None = None) -> None:
            nonlocal n
            role = ("user", "assistant")[(n - shift) % 2] if role is None else role
            h.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            n += 1

        for _, _, role, text in group:
            while audit[at] == "I":
                put("")
                at += 1
            if audit[at] == "K":
                shift += n == 0 and role[:1] == "s"
                put(text, role)
            elif audit[at] == "R":
                put(text)
            at += 1
        for _ in audit[at:]:
            put("")
        out.append((*report.values(), h.hexdigest()))
        if len(out) >= 4096:
            yield _table(out, _RESULT)
            out = []
    yield _table(out, _RESULT)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of ``conversations(conv_id, turn, role, text, ...)`` damaged by
    crc32("conv_id:turn") % 20: 0 marks the row as gone, 1 empties its text, 2 removes its [.!?], 3
    repeats it, 4 makes its role user.  A null role or text is one space, as is a null in the key."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times).alias("again"))
    return out.drop("again")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each
    conversation of ``rows(conv_id, turn, role, text, gone)``; rows that are gone only name theirs.

    Rows are taken by turn, nulls first, equal turns by role and a hash of the text.  A row's first fault counts:
    blank (no character but white space), duplicate (role and text seen earlier), truncated (its
    last such character is not one of . ! ?).  Keeping a row costs 0, another role 3, deletion 4
    (blank rows and duplicates must go), an empty turn inserted 3, a truncated row that stays 3.

    Null roles and texts are empty; a null conv_id is a conversation of its own.  Roles count by
    their first character; one that is none of s, u, a can't stay as it is.  Without rows: zeros, an
    empty audit, the hash of nothing.  Extra columns are ignored; an empty table gives none.

    A conversation is decided in one task, as its audit and hash are single values: the DP holds
    no texts but some hundred bytes a row; the hash streams and holds the audit only.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    rows = rows.select("conv_id", "turn", empty(F.col("role")).alias("role"), empty(F.col("text")).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    cut = F.col("text").rlike("[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*\\z")
    fault = F.when(~F.col("text").rlike(_SOLID), "blank").when(cut, "truncated").otherwise("")
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # the text's digest stands for it: equal turns and roles are sorted alike in both passes
    order = ["conv_id", "turn", "role", "key"]
    rows = rows.withColumn("key", key)
    compact = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "key", "gone", "role")
    compact = compact.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault", "key", "gone")
    report = keep(compact.mapInArrow(_decide, _REPORT), "repair-decisions")
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    whole = F.struct(*report.columns).alias("report")
    heads = report.select("conv_id", F.lit(0).alias("side"), whole, none("turn"), none("role"), none("key"), none("text"))
    texts = rows.where("not gone").select("conv_id", F.lit(1), F.lit(None).cast(heads.schema["report"].dataType), "turn", "role", "key", "text")
    stream = heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "key")
    return stream.select("conv_id", "report", "role", "text").mapInArrow(_hashed, _RESULT)
