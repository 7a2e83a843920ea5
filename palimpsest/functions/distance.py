"""Text distance and recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, let, words
from .matching import Matcher, edits, edits_within

# A recovery counts up to this error rate; marks of text left transformed.
RECOVERY_THRESHOLD = 0.02
MARKERS = ("defyn{", "GRID START", "<Problem A>", "<Problem B>")


#: Texts from this length on lose their common ends first; the ends are found by halving steps.
LONG, _STEPS = 1000, [1 << i for i in range(22, -1, -1)]


def _without_common_ends(a, b, body) -> Column:
    """body(a, b) of what two texts have between their common ends, spelled backwards."""

    def ahead(p):
        longer = lambda at, n: (at + n <= F.least(F.length(p["a"]), F.length(p["b"]))) & (F.substring(p["a"], at + 1, n) == F.substring(p["b"], at + 1, n))
        n = F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda at, step: F.when(longer(at, step), at + step).otherwise(at))
        turned = lambda t, n: F.reverse(F.substring(t, n + 1, F.length(t))).alias
        return let(n, lambda n: F.struct(turned(p["a"], n)("a"), turned(p["b"], n)("b")))

    return let(F.struct(col(a).alias("a"), col(b).alias("b")), lambda p: let(ahead(p), lambda q: let(ahead(q), lambda r: body(r["a"], r["b"]))))


def levenshtein(a, b, most=None) -> Column:
    """Edits between two texts; -1 where they are over ``most`` (a number or column).  In the JVM, whose
    bounded form costs about the length times ``most``, and far less where texts share long ends or
    differ in length by more than ``most``."""
    a, b = col(a), col(b)
    if most is None:
        plain = lambda x, y: F.levenshtein(x, y)
    else:
        most = F.lit(most) if isinstance(most, int) else most.cast("int")
        plain = lambda x, y: F.when(F.abs(F.length(x) - F.length(y)) > most, -1).otherwise(F.call_function("levenshtein", x, y, most))
    return F.when(F.least(F.length(a), F.length(b)) < LONG, plain(a, b)).otherwise(_without_common_ends(a, b, plain))


#: From this length on texts are compared in Arrow batches, where that is allowed.
BATCHED = 250


def _edits(a, b, most):
    """Pandas: edits of two texts, -1 where they are over the bound; null where either is."""
    import pandas as pd

    return pd.Series([None if x is None or y is None else edits_within(x, y, int(m)) for x, y, m in zip(a, b, most)], dtype=object)


def long_levenshtein(a, b, most) -> Column:
    """levenshtein up to ``most`` for whole documents, the same number: the JVM's bounded form still walks one text
    for every character of the other, so pairs from BATCHED on that their lengths don't decide go to Arrow
    batches, in time of the length plus the square of the edits."""
    a, b = col(a), col(b)
    most = F.lit(most) if isinstance(most, int) else most.cast("int")
    apart = F.abs(F.length(a) - F.length(b)) > most
    long = (F.least(F.length(a), F.length(b)) >= BATCHED) & ~apart & (a != b)
    found = F.pandas_udf(_edits, "int")(F.when(long, a), F.when(long, b), F.when(long, most))
    return F.when(apart, -1).when(a == b, 0).when(long, found).otherwise(F.call_function("levenshtein", a, b, most))


#: Error rates of longer texts are estimated.
MAX_EXACT = 6000


def _unlike(a, b):
    """Pandas: 1 - the ratio of difflib's sequence matcher, which the estimate is defined by; null where either is."""
    import pandas as pd

    return pd.Series([None if x is None or y is None else 1.0 - Matcher(x, y).ratio() for x, y in zip(a, b)], dtype=object)


def is_estimated(original, other) -> Column:
    """Whether the error rate of two texts is an estimate."""
    o, x = F.coalesce(col(original), F.lit("")), F.coalesce(col(other), F.lit(""))
    return (F.length(o) > MAX_EXACT) | (F.length(x) > MAX_EXACT)


def char_error_rate(original, other, where=None) -> Column:
    """M02, for reports: edits over the original's length (1 at least), exact in the JVM up to MAX_EXACT
    characters on both sides; beyond, what a sequence matcher finds unlike (see is_estimated; only those
    texts reach Arrow batches).  Null where ``where`` does not hold.  within_rate decides without it."""
    o, x = col(original), col(other)
    asked = (o != x) & (F.lit(True) if where is None else where)
    long, short = is_estimated(o, x) & asked, ~is_estimated(o, x) & asked
    guess = F.pandas_udf(_unlike, "double")(F.when(long, o), F.when(long, x))
    exact = levenshtein(F.when(short, o), F.when(short, x)) / F.greatest(F.length(o), F.lit(1))
    rate = F.when(o == x, 0.0).when(is_estimated(o, x), guess).otherwise(exact)
    return rate if where is None else F.when(where, rate)


def within_rate(original, other, rate: float, bounded=levenshtein) -> Column:
    """Whether the edits between two texts are at most ``rate`` times the original's length (1 at least):
    exact at any length, by a bounded distance: in the JVM, or long_levenshtein for whole documents."""
    o, x = col(original), col(other)
    n = F.greatest(F.length(o), F.lit(1))
    edits = bounded(o, x, F.floor(n * rate) + 1)  # one more than the bound, so that rounding can't cut it
    return F.when(o == x, True).when(F.abs(F.length(o) - F.length(x)) > n * rate + 1, False).otherwise((edits >= 0) & (edits / n <= rate))


def recovered(original, other, threshold: float = RECOVERY_THRESHOLD, bounded=levenshtein) -> Column:
    """Equal, or an error rate up to the threshold."""
    return within_rate(original, other, threshold, bounded)


def _rate(a: str, b: str) -> float:
    """char_error_rate of two texts."""
    if max(len(a), len(b)) > MAX_EXACT:
        return 0.0 if a == b else 1.0 - Matcher(a, b).ratio()
    return edits(a, b) / max(len(a), 1)


def _near(a: str, b: str, rate: float) -> bool:
    """within_rate of two texts."""
    n = max(len(a), 1)
    found = 0 if a == b else edits_within(a, b, int(n * rate) + 1)
    return found >= 0 and found / n <= rate


#: Edits up to which edits_within is tried before a whole distance.
FEW = 200


def _least_rate(a: str, b: str) -> float:
    """What an error rate can't be under, by the lengths alone."""
    if max(len(a), len(b)) > MAX_EXACT:
        return 1.0 - 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return abs(len(a) - len(b)) / max(len(a), 1)


def _closer(t: str, o: str, x: str) -> bool:
    """Whether the error rate of x to t is under that to o.  Where the lengths alone put the former as high as the
    latter is, it need not be taken."""
    least, n = _least_rate(t, x), max(len(o), 1)
    if max(len(o), len(x)) <= MAX_EXACT:
        found = edits_within(o, x, min(int(least * n), FEW))
        if found >= 0 and found / n <= least:
            return False
    rate = _rate(o, x)
    return least < rate and _rate(t, x) < rate


def _sides(threshold: float, recovery: bool):
    """Pandas: what a text is beside an original and the transformed one: recovered (where that is asked), copied,
    closer to the transformed one, or neither; null where they are missing."""

    def sides(original, transformed, other):
        import pandas as pd

        def side(o, t, x):
            if x is None:
                return None
            if recovery and o is not None and _near(o, x, threshold):
                return "recovered"
            if t is None:
                return None
            if _near(t, x, threshold):
                return "copied"
            return "closer" if o is not None and _closer(t, o, x) else "neither"

        return pd.Series([side(*texts) for texts in zip(original, transformed, other)], dtype=object)

    return F.pandas_udf(sides, "string")


def residual_status(original, transformed, other, tagged, is_recovered=None, threshold: float = RECOVERY_THRESHOLD) -> Column:
    """Seven labels, the first that holds.  ``is_recovered``, where it is not given, is recovered() with this
    threshold; for long texts that is far cheaper, as those found recovered are compared no further.  Where all three
    texts are shorter than BATCHED the JVM decides, else one Arrow batch step, whose inputs must hold no lambda."""
    o, t, x = col(original), col(transformed), col(other)
    left = F.lit(False)
    for m in MARKERS:
        left = left | x.contains(m)
    long = F.coalesce((F.greatest(F.length(o), F.length(t), F.length(x)) >= BATCHED) & (x != ""), F.lit(False))
    asked = long & F.coalesce(col(tagged), F.lit(True))
    side = _sides(threshold, is_recovered is None)(*[F.when(asked, c) for c in (o, t, x)])
    short = lambda c: F.when(~long, c)
    near = lambda c: within_rate(short(c), x, threshold)
    rate = lambda c: levenshtein(short(c), short(x)) / F.greatest(F.length(c), F.lit(1))
    done = F.when(long, side == "recovered").otherwise(near(o)) if is_recovered is None else col(is_recovered)
    return (
        F.when(~col(tagged), "missing_recovered_tags")
        .when(done, "recovered")
        .when(x == "", "empty_recovered_text")
        .when(F.when(long, side == "copied").otherwise(near(t)), "copied_transformed_input")
        .when(col(tagged) & done.isNotNull() & F.when(long, side == "closer").otherwise(rate(t) < rate(o)), "closer_to_transformed_than_original")
        .when(left, "contains_transformation_markers")
        .otherwise("partial_or_other")
    )


def sliding_windows(t, target_words, step: int = 10) -> Column:
    """Distinct word windows of 0.8, 1 and 1.2 times the target length, every ``step`` words, and the last one of each."""
    def of(w):
        def sized(share):
            n = F.greatest(F.floor(col(target_words) * share).cast("int"), F.lit(1))
            starts = F.when(F.size(w) > n, F.sequence(F.lit(0), F.size(w) - n, F.lit(step))).otherwise(F.array(F.lit(0)))
            tail = F.array(F.greatest(F.size(w) - n, F.lit(0)))
            return F.transform(F.concat(starts, tail), lambda i: F.array_join(F.slice(w, i + 1, n), " "))

        return F.array_distinct(F.filter(F.concat(*[sized(s) for s in (0.8, 1.0, 1.2)]), lambda x: x != ""))

    return let(words(col(t)), of)


def cosine(a, b) -> Column:
    """Cosine of two arrays; null where either is zero or missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Fixed value: the least cosine that counts as a recovery in meaning.
SEMANTIC_THRESHOLD = 0.90


def semantic_recovery(targets, windows, threshold: float = SEMANTIC_THRESHOLD):
    """(id, best, recovered) for each row of ``targets(id, embedding, correct)``: the greatest cosine to
    its ``windows(id, embedding)``, recovered from the threshold on or where the answer was correct.
    One aggregate over an equi-join; a target without windows has a null best."""
    both = targets.select("id", F.col("embedding").alias("_t")).join(windows.select("id", F.col("embedding").alias("_w")), "id")
    return semantic_status(targets, both.groupBy("id").agg(F.max(cosine("_t", "_w")).alias("best")), threshold)


def semantic_status(targets, best, threshold: float = SEMANTIC_THRESHOLD):
    """M06 from what is nearest: ``targets(id, correct)`` and their ``best(id, best)``, as in semantic_recovery."""
    out = targets.select("id", "correct").join(best, "id", "left")
    return out.select("id", "best", (F.coalesce("correct", F.lit(False)) | F.coalesce(F.col("best") >= threshold, F.lit(False))).alias("recovered"))


def judge_recovery(rows, generate):
    """``rows(id, correct, ...)`` with ``recovered``: correct rows count as recovered and are not judged; the
    others' prompts go through ``generate`` (a function of a DataFrame with id and prompt that adds
    reply), and a reply that says yes counts."""
    from .prompt import judge_verdict

    judged = generate(rows.where(~F.coalesce("correct", F.lit(False))).select("id", "prompt")).select("id", judge_verdict("reply").alias("_v"))
    out = rows.join(judged, "id", "left")
    return out.withColumn("recovered", F.coalesce("correct", F.lit(False)) | F.coalesce("_v", F.lit(False))).drop("_v")
