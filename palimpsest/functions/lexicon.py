"""Perturbations that need word classes (T01-T03, T16, T18-T20, B11, B12) and their inverses.

Word classes come as a column of one tag a token, as the learned tagger of operators.tagging
makes it, or else from a rule: closed classes and endings.  An antonym source is a map column.
What must hold for any tagger (round trip, well-formed definitions, untouched math, no doubled
negation before "such") holds here and is tested.  All choices are seeded by md5, not by row
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import WS, bound, choice, col, let, strip
from .prompt_texts import TERMS_TEMPLATE
from .systems import distractor, system

TAGS = ("ADJ", "NUM", "VERB", "NOUN", "PROPN", "MATH", "SPACE", "PUNCT", "OTHER")

_MATH = r"\$\$.*?\$\$|\$.*?\$|\\\[.*?\\\]|\\\(.*?\\\)|\[asy\].*?\[/asy\]"
_TOKEN = rf"(?s)({_MATH}|\w+|\s+|[^\w\s])"

# Closed classes.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty hundred thousand".split()
FUNCTION_WORDS = "the a an and or of to in on at by for from with is are was were be been it its this that these those as if then than not no such what which who how when where let we you they he she there their his her each every all any".split()
ANTONYMS = {
    "positive": "negative", "negative": "positive", "even": "odd", "odd": "even", "large": "small", "small": "large", "long": "short",
    "short": "long", "high": "low", "low": "high", "good": "bad", "bad": "good", "new": "old", "old": "new", "first": "last", "last": "first",
    "right": "left", "left": "right", "open": "closed", "same": "different", "different": "same", "maximum": "minimum", "minimum": "maximum",
    "find": "lose", "add": "remove", "remove": "add", "give": "take", "take": "give", "rise": "fall", "fall": "rise", "increase": "decrease",
    "decrease": "increase", "win": "lose", "lose": "win", "buy": "sell", "sell": "buy", "start": "stop", "stop": "start", "begin": "end", "end": "begin",
}


def tokens(t) -> Column:
    """Math blocks, words, white space and signs, in order; their concatenation is the text."""
    return F.regexp_extract_all(col(t), F.lit(_TOKEN), F.lit(1))


def rule_tag(x: Column) -> Column:
    """The tag of one token by itself: closed classes, then endings and spelling."""
    low = F.lower(x)
    return (
        F.when(x.rlike(rf"(?s)\A({_MATH})\z"), "MATH")
        .when(x.rlike(r"\A\s+\z"), "SPACE")
        .when(x.rlike(r"\A\W\z"), "PUNCT")
        .when(x.rlike(r"\A\d+\z") | low.isin(NUMBERS), "NUM")
        .when(low.isin(FUNCTION_WORDS), "OTHER")
        .when(low.rlike("(ous|ful|able|ible|ive|less|ical|al|est|en)$"), "ADJ")
        .when(low.rlike("(ize|ify|ate|ing|ed)$"), "VERB")
        .when(x.rlike("^[A-Z][a-z]+$"), "PROPN")
        .otherwise("NOUN")
    )


def _tags(tok: Column, tag, tags) -> Column:
    """One tag a token: the column given, or the rule's."""
    return F.transform(tok, lambda x: tag(x)) if tags is None else col(tags)


def not_not(t, k: int = 2, tag=rule_tag, tags=None) -> Column:
    """T01: "not not " before the first adjective and every k-th adjective or number; math blocks
    are one token, never tagged."""
    def insert(tok):
        kinds = F.zip_with(tok, _tags(tok, tag, tags), lambda x, g: F.when(F.lower(x) == "such", F.lit("OTHER")).otherwise(g))
        at = lambda ks, which: F.filter(F.sequence(F.lit(0), F.size(ks) - 1), lambda i: F.get(ks, i).isin(*which))

        def places(ks):
            every = let(at(ks, ("ADJ", "NUM")), lambda e: F.filter(e, lambda _, j: (j + 1) % k == 0))
            return F.array_union(every, F.slice(at(ks, ("ADJ",)), 1, 1))

        return let(let(kinds, places), lambda ps: F.array_join(F.transform(tok, lambda x, i: F.when(F.array_contains(ps, i), F.concat(F.lit("not not "), x)).otherwise(x)), ""))

    return let(tokens(t), lambda tok: F.when(F.size(tok) > 0, insert(tok)).otherwise(F.lit("")))


def _insert_middle(text: Column, block: Column) -> Column:
    """The block on lines of its own at the space nearest the middle, the middle without one."""
    def cut(x):
        mid = F.floor(F.length(x) / 2).cast("int")
        back = F.position(F.lit(" "), F.reverse(F.substring(x, F.lit(1), mid)))
        left = F.when(back > 0, mid - back)
        right = F.position(F.lit(" "), x, mid + 1)
        right = F.when(right > 0, right - 1)
        at = F.coalesce(F.when(left.isNull(), right).when(right.isNull(), left).when(mid - left < right - mid, left).otherwise(right), mid)
        return let(at, lambda p: F.concat(F.substring(x, F.lit(1), p), F.lit("\n\n"), block, F.lit("\n\n"), F.substring(x, p + 1, F.length(x))))

    return let(text, cut)


def _definitions(defs: Column) -> Column:
    return F.concat(F.lit("defyn{"), F.array_join(F.transform(defs, lambda d: F.concat(F.lit('let "'), d["new"], F.lit('" mean "'), d["old"], F.lit('"'))), ", "), F.lit("}."))


_PAIRS = "array<struct<new:string,old:string>>"


def _antonyms() -> Column:
    return F.create_map(*[F.lit(x) for kv in ANTONYMS.items() for x in kv])


def opposites(t, seed: int = 42, key=None, tag=rule_tag, antonyms=None, tags=None) -> Column:
    """Verbs and adjectives replaced by their antonym, else "anti" (or "anti_") and the word, all
    spellings of a word alike, with definitions at the middle.  Words claim in a seeded order and
    no replacement is a word already in use."""
    antonyms = _antonyms() if antonyms is None else antonyms
    key = col(t) if key is None else col(key)
    state = "struct<used:array<string>,done:array<struct<new:string,old:string>>>"

    def claim(tok):
        low = F.transform(tok, F.lower)
        words = F.zip_with(tok, _tags(tok, tag, tags), lambda x, g: F.when(g.isin("VERB", "ADJ") & x.rlike(r"\A[A-Za-z]+\z"), F.lower(x)))
        eligible = F.array_distinct(F.array_compact(words))
        order = F.transform(F.array_sort(F.transform(eligible, lambda w: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, w).cast("binary")).alias("h"), w.alias("w")))), lambda s: s["w"])

        def step(s, w):
            anti = F.try_element_at(antonyms, w)
            plain = F.concat(F.lit("anti"), w)
            new = F.when(anti.isNotNull() & ~F.array_contains(s["used"], anti), anti).when(~F.array_contains(s["used"], plain), plain).otherwise(F.concat(F.lit("anti_"), w))
            return let(new, lambda n: F.struct(F.concat(s["used"], F.array(n)).alias("used"), F.concat(s["done"], F.array(F.struct(n.alias("new"), w.alias("old")))).alias("done")).cast(state))

        start = F.struct(low.alias("used"), F.array().cast(_PAIRS).alias("done")).cast(state)
        return F.aggregate(order, start, step, lambda s: F.map_from_entries(F.transform(s["done"], lambda d: F.struct(d["old"], d["new"]))))

    def swap(tok, m):
        def new(x):
            n = F.try_element_at(m, F.lower(x))
            upper = F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n)))
            return F.when(n.isNull(), x).when(x.rlike("^[A-Z]"), upper).otherwise(n)

        changed = F.array_distinct(F.transform(F.filter(tok, lambda x: F.try_element_at(m, F.lower(x)).isNotNull()), lambda x: F.struct(new(x).alias("new"), x.alias("old"))))
        text = F.array_join(F.transform(tok, new), "")
        return let(changed, lambda d: F.when(F.size(d) > 0, _insert_middle(text, _definitions(d))).otherwise(text))

    return let(tokens(t), lambda tok: let(claim(tok), lambda m: swap(tok, m)))


def wrappers(t, seed: int = 42, key=None, tag=rule_tag, tags=None) -> Column:
    """Nouns, names and numbers as N(word), single letters but "a" too; N is 2 to 10, unused ones
    first; one definition an occurrence, at the middle."""
    key = col(t) if key is None else col(key)
    state = "struct<free:array<int>,defs:array<struct<new:string,old:string>>,out:array<string>>"
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(2), F.lit(10)), lambda n: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, n.cast("string")).cast("binary")).alias("h"), n.alias("n")))), lambda s: s["n"])

    def step(s, pair):
        x = pair["x"]
        wrapped = (pair["tag"].isin("NOUN", "NUM", "PROPN") & x.rlike(r"\A[A-Za-z0-9]+\z")) | (x.rlike(r"\A[B-Zb-z]\z"))
        n = F.coalesce(F.get(s["free"], 0), choice(9, seed, key, F.size(s["out"])) + 2)
        new = F.concat(n.cast("string"), F.lit("("), x, F.lit(")"))
        yes = F.struct(F.slice(s["free"], 2, 9).alias("free"), F.concat(s["defs"], F.array(F.struct(new.alias("new"), x.alias("old")))).alias("defs"), F.concat(s["out"], F.array(new)).alias("out")).cast(state)
        no = F.struct(s["free"].alias("free"), s["defs"].alias("defs"), F.concat(s["out"], F.array(x)).alias("out")).cast(state)
        return F.when(wrapped, yes).otherwise(no)

    start = F.struct(order.alias("free"), F.array().cast(_PAIRS).alias("defs"), F.array().cast("array<string>").alias("out")).cast(state)
    tagged = let(tokens(t), lambda tok: F.zip_with(tok, _tags(tok, tag, tags), lambda x, g: F.struct(x.alias("x"), g.alias("tag"))))
    done = F.aggregate(tagged, start, step)
    return let(done, lambda d: F.when(F.size(d["defs"]) > 0, _insert_middle(F.array_join(d["out"], ""), _definitions(d["defs"]))).otherwise(F.array_join(d["out"], "")))


_BLOCK = r"(?s)defyn\{(.*?)\}\."


def definitions(t) -> Column:
    """The map of a text's defyn block: replacement -> original; null without a block."""
    body = F.regexp_extract(col(t), _BLOCK, 1)
    new = F.regexp_extract_all(body, F.lit('let "(.*?)" mean "(.*?)"'), F.lit(1))
    old = F.regexp_extract_all(body, F.lit('let "(.*?)" mean "(.*?)"'), F.lit(2))
    return F.when(col(t).rlike(_BLOCK), let(F.arrays_zip(new.alias("k"), old.alias("v")), lambda z: F.map_from_entries(F.array_distinct(z))))


@bound()
def undo_opposites(t) -> Column:
    """The block removed, white space collapsed, every defined word put back at once (words and
    words before n't alike are tokens here)."""
    clean = F.regexp_replace(strip(F.regexp_replace(col(t), rf"\s*{_BLOCK[4:]}\s*".replace(r"defyn", r"(?s)defyn", 1), " ")), f"{WS}+", " ")
    back = lambda m: F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(r"(?s)(\w+?(?=n't)|\w+|\W)"), F.lit(1)), lambda x: F.coalesce(F.try_element_at(m, x), x)), "")
    return F.when(definitions(t).isNull(), col(t)).otherwise(let(definitions(t), back))


@bound()
def undo_wrappers(t) -> Column:
    """The block removed, defined N(word) forms unwrapped, runs of three newlines shortened, stripped."""
    clean = F.regexp_replace(col(t), _BLOCK, "")
    piece = F.regexp_extract_all(clean, F.lit(r"(?s)(\d+\(\w+\)|.)"), F.lit(1))
    back = lambda m: F.array_join(F.transform(piece, lambda x: F.coalesce(F.try_element_at(m, x), x)), "")
    out = let(definitions(t), back)
    return F.when(definitions(t).isNull(), col(t)).otherwise(strip(F.regexp_replace(out, r"\n{3,}", "\n\n")))


def sentences(t) -> Column:
    """Pieces that end with . ! or ? before white space."""
    return F.filter(F.split(col(t), r"(?<=[.!?])\s+"), lambda x: x != "")


def embed_index(t, index, *seed) -> Column:
    """The two parts of [[ProblemN]] as sentences of a text, between a tenth and nine tenths of it."""
    index = col(index)

    def place(s):
        n = F.size(s)
        lo = F.greatest(F.lit(1), F.floor(n * 0.1).cast("int"))
        hi = F.greatest(lo, F.least(n - 1, F.floor(n * 0.9).cast("int")))
        mid = F.floor((lo + hi) / 2).cast("int")
        a = lo + choice(mid - lo + 1, *seed, "a")
        b = F.when(hi > mid, mid + 1 + choice(F.greatest(hi - mid, F.lit(1)), *seed, "b")).otherwise(a)
        cut = 3 + choice(6, *seed, "cut")
        one, two = F.concat(F.substring(index, F.lit(1), cut), F.lit(".")), F.concat(F.substring(index, cut + 1, F.length(index)), F.lit("."))
        flip = choice(2, *seed, "flip") == 1
        first, second = F.when(flip, two).otherwise(one), F.when(flip, one).otherwise(two)
        return F.array_join(F.concat(F.slice(s, F.lit(1), a), F.array(first), F.slice(s, a + 1, b - a), F.array(second), F.slice(s, b + 1, n)), " ")

    return let(sentences(t), place)


def context_saturation(t, key, num_distractors: int = 4, seed: int = 42) -> Column:
    """Generated systems round an instruction that names the target, then the target, each with its
    hidden index."""
    key = col(key)
    base = choice(700, seed, key, "ids") + 100
    index = lambda i: F.concat(F.lit("[[Problem"), (base + i).cast("string"), F.lit("]]"))
    made = [embed_index(distractor(seed, key, i), index(i), seed, key, i) for i in range(num_distractors)]
    half = num_distractors // 2
    block = lambda part: F.concat_ws(" ", *part) if part else F.lit("")
    ask = F.concat(F.lit("\n\n\nYou are to solve Problem"), (base + num_distractors).cast("string"), F.lit(" using standard mathematical operations."))
    return F.concat(block(made[:half]), ask, block(made[half:]), F.lit("\n\n"), embed_index(t, index(num_distractors), seed, key, "target"))


def static_distractors(keys: DataFrame, bins: int = 20, key: str = "idx") -> DataFrame:
    """(bin, pos, domain, variable, text): a generated line for each key, of one of three domains, dealt
    to bins so that a variable stands at most once more in one bin than in another.

    Keys are counted off within their variable (seven of them) by range partitions, so no task
    sorts all of a variable's keys."""
    from ..operators.pairing import indexed

    rows = keys.select(key, system(7, F.col(key)).alias("_s")).select(F.col(key).alias("pos"), F.col("_s.domain").alias("domain"), F.col("_s.a").alias("variable"), F.col("_s.text").alias("text"))
    placed = indexed(rows.withColumn("_o", F.struct("variable", "pos")), "_o")
    first = placed.groupBy("variable").agg(F.min("idx").alias("_first"))
    nth = F.col("idx") - F.col("_first")
    return placed.join(first, "variable").select(F.pmod(nth, F.lit(bins)).cast("int").alias("bin"), "pos", "domain", "variable", "text")


@bound()
def swap_variables(t, seed: int = 42, key=None) -> Column:
    """T19, the native subset: single letters inside $...$ are renamed by a seeded one-to-one map, case kept;
    text outside math is left alone."""
    key = col(t) if key is None else col(key)
    low = [chr(c) for c in range(ord("a"), ord("z") + 1)]

    def pool(letters):
        return F.transform(F.array_sort(F.transform(F.array(*[F.lit(x) for x in letters]), lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, x).cast("binary")).alias("h"), x.alias("x")))), lambda s: s["x"])

    names = F.map_from_arrays(F.array(*[F.lit(x) for x in low + [x.upper() for x in low]]), F.concat(pool(low), pool([x.upper() for x in low])))
    pieces = F.regexp_extract_all(col(t), F.lit(r"(?s)(\$[^$]*\$|[^$]+|\$)"), F.lit(1))
    inner = lambda m, p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"(?s)(\\[A-Za-z]+|[A-Za-z]{2,}|.)"), F.lit(1)), lambda x: F.coalesce(F.try_element_at(m, x), x)), "")
    return let(names, lambda m: F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?s)\A\$.+\$\z"), inner(m, p)).otherwise(p)), ""))


# Small list of the built-in recogniser: sentence openers that are no names.
OPENERS = "Suppose Let Find Given Assume Consider Determine Compute If When The A An In On At How What Each Every Then And But For".split()


def person_names(t) -> Column:
    """Distinct capitalised words (one or two in a row) outside math and not sentence openers, sorted."""
    clean = F.regexp_replace(col(t), r"\$[^$]+\$", " ")
    found = F.regexp_extract_all(clean, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)?)\b"), F.lit(1))
    opener = "^(" + "|".join(OPENERS) + ")(?: |$)"
    bare = F.transform(found, lambda x: strip(F.regexp_replace(x, opener, "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: (x != "") & ~x.isin(OPENERS))))


def terms_prompt(t) -> Column:
    """T18"""
    return F.replace(F.lit(TERMS_TEMPLATE), F.lit("{problem_text}"), col(t))
