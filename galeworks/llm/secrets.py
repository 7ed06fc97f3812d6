"""Secret scan: fixed patterns plus sliding-window entropy over candidate strings (DataFrame functions only)."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the group whose length counts, and its least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
KINDS = [kind for kind, *_ in BASE] + ["entropy"]
#: Runs that the entropy scan looks at, and its window in characters.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character class of a candidate (the first that fits) and the bits a character that a window must reach. A window of ten
#: digits has 3.32 at most; of random 20-digit runs 999 in 1000 reach 2.3.
CLASSES = [("digits", r"^[0-9]+$", 2.3), ("hex", r"^[0-9a-fA-F]+$", 3.2), ("letters", r"^[A-Za-z]+$", 3.9), ("base64", r"", 3.9)]
#: A part of a candidate that is like a word: letters of one case, or with one leading capital.
_PART = r"(?:[A-Z]?[a-z]+|[A-Z]+)"
#: Parts of a candidate never reported: plain words and words joined by marks, identifiers, runs of one sign.
ALLOWED = [
    rf"^[-_/=+]*+{_PART}(?:[-_/=+]++{_PART})*+[-_/=+]*+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
]
#: Known examples: windows that touch one are exempt; what stands before and after is judged as a part of its own.
EXAMPLES = r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdef0123"
#: Elements of an array that a fold takes at a time, so that the arrays it appends to stay short.
BLOCK = 256

_SPAN = "struct<start:long,end:long,rank:int,kind:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs, `join` (a sum or a maximum) of 0 and all that stand before it.

    Blocks are folded apart and then shifted by the fold over the blocks before, so the work is linear in practice.
    """

    def fold(parts: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("before"))
        return F.aggregate(parts, start, lambda s, x: F.struct(join(s["total"], value(x)).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    def shifted(parts: Column) -> Column:
        return F.zip_with(parts, fold(parts, lambda p: p["total"])["before"], lambda p, base: F.transform(p["before"], lambda x: join(base, x)))

    return F.flatten(_let(_let(values, lambda v: F.transform(_blocks(v), lambda block: fold(block, lambda x: x))), shifted))


def _located(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """(span, word) of all leftmost, non-overlapping matches whose group has `least` characters.

    Matches and the text between them come from the same pattern, so running lengths give the places.
    """
    span = f"array<struct<span:{_SPAN},word:string>>"

    def parts(hits: Column) -> Column:
        sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        return F.arrays_zip(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), F.length).alias("gap"), hits.alias("hit"), F.transform(sized, F.length).alias("sized"))

    def placed(found: Column) -> Column:
        begins = _before(F.transform(found, lambda p: (p["gap"] + F.length(p["hit"])).cast("long")), lambda a, b: a + b)

        def spanned(part: Column, before: Column) -> Column:
            begin = before + part["gap"]
            place = F.struct(begin.alias("start"), (begin + F.length(part["hit"])).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"))
            return F.struct(place.alias("span"), part["hit"].alias("word"), part["sized"].alias("sized"))

        kept = F.filter(F.zip_with(found, begins, spanned), lambda x: x["sized"] >= least)
        return F.transform(kept, lambda x: F.struct(x["span"].alias("span"), x["word"].alias("word"))).cast(span)

    found = _let(_let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parts), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(span))


def highest_entropy(text: Column, window: int = WINDOW) -> Column:
    """Most bits a character that any window of `window` characters has; null for shorter texts. Texts are of ASCII alone.

    With S = sum of c * log2(c) over a window's character counts, its entropy is log2(window) - S / window. The counts are
    kept from step to step, as a string with a sign for each of 128 characters: the character that leaves a window lowers
    its own count by one and the one that enters raises its own, and S changes by these two counts alone.
    """
    zero = 48

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def moves(chars: Column) -> Column:  # the places before the text hold no sign: what leaves there counts nowhere else
        gone = F.concat(F.array_repeat(F.lit(""), window), F.slice(chars, 1, F.greatest(F.size(chars) - window, F.lit(0))))
        both = F.zip_with(chars, gone, lambda new, old: F.struct(F.ascii(new).alias("new"), F.ascii(old).alias("old")))

        def of(pair: Column, i: Column) -> Column:
            leaves = F.struct(pair["old"].alias("sign"), F.lit(-1).alias("by"), F.lit(False).alias("full"))
            return F.array(leaves, F.struct(pair["new"].alias("sign"), F.lit(1).alias("by"), (i >= window - 1).alias("full")))

        return F.flatten(F.transform(both, of))

    def move(state: Column, x: Column) -> Column:
        n = F.ascii(F.substring(state["counts"], x["sign"] + 1, F.lit(1))) - zero
        s = state["s"] + term(n + x["by"]) - term(n)
        counts = F.overlay(state["counts"], F.char(n + x["by"] + zero), x["sign"] + 1, F.lit(1))
        return F.struct(counts.alias("counts"), s.alias("s"), F.when(x["full"], F.least(state["low"], s)).otherwise(state["low"]).alias("low"))

    start = F.struct(F.repeat(F.lit(chr(zero)), F.lit(128)).alias("counts"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("low"))
    low = F.aggregate(_let(F.split(text, ""), moves), start, move, lambda s: s["low"])
    return F.when(F.length(text) >= window, F.lit(math.log2(window)) - low / window)


def _suspicious(word: Column) -> Column:
    """Whether a part of a candidate, known examples left out, is not allowed and reaches its class's bits."""

    def judged(part: Column) -> Column:
        least = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(part.rlike(pattern), F.lit(bits)).otherwise(least)
        allowed = F.length(part) < WINDOW
        for pattern in ALLOWED:
            allowed = allowed | part.rlike(pattern)
        return F.when(allowed, F.lit(False)).otherwise(highest_entropy(part) >= least)

    return F.exists(F.split(word, EXAMPLES, -1), judged)


def _base(text: Column) -> Column:
    found = [F.transform(_located(text, pattern, group, least, kind), lambda x: x["span"]) for kind, pattern, group, least in BASE]
    return F.array_sort(F.concat(*found))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans of every row of docs (doc_id, text): arrays of (start, end, rank, kind).

    Places count code points, ends are exclusive, spans are ordered by start and then kind. Null and empty texts have
    none. Added spans are candidates that touch no base span and have a part whose entropy reaches its class's bits. Parts
    are what stands between known examples; allowed parts are left out. Ids are passed through as they are, null or repeated.
    The work is in proportion to the text's length, however long a candidate is and however many there are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", _base(F.col("text")).alias("base"), _located(F.col("text"), CANDIDATE, 0, WINDOW, "entropy").alias("runs"))
    added = F.filter(_apart(F.col("runs"), F.col("base")), lambda r: _suspicious(r["word"]))
    return found.select("doc_id", "base", F.transform(added, lambda r: r["span"]).alias("added"))


def _apart(runs: Column, base: Column) -> Column:
    """The runs that touch no base span: those that begin earlier end before, those that begin later begin after.

    Both are put in one order, so that a running maximum of ends and one of starts, from the other side, are enough.
    """
    far = F.lit(1 << 40)
    named = F.transform(base, lambda b: F.struct(b.alias("span"), F.lit(None).cast("string").alias("word")))

    def marked(all_: Column) -> Column:
        is_base = lambda x: x["span"]["rank"] < KINDS.index("entropy")
        ends = _before(F.transform(all_, lambda x: F.when(is_base(x), x["span"]["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(_before(F.transform(F.reverse(all_), lambda x: F.when(is_base(x), far - x["span"]["start"]).otherwise(0)), F.greatest))
        kept = F.filter(F.arrays_zip(all_.alias("run"), ends.alias("end"), starts.alias("start")), lambda x: ~is_base(x["run"]) & (x["end"] <= x["run"]["span"]["start"]) & (far - x["start"] >= x["run"]["span"]["end"]))
        return F.transform(kept, lambda x: x["run"])

    return F.when((F.size(runs) > 0) & (F.size(base) > 0), _let(F.array_sort(F.concat(runs, named)), marked)).otherwise(runs)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every base and added span of text replaced by `mark` (overlapping and adjacent spans by one).

    Null texts stay null. Columns of docs stay as they are, but for text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = F.filter(_located(text, CANDIDATE, 0, WINDOW, "entropy"), lambda r: _suspicious(r["word"]))
    spans = F.array_sort(F.concat(_base(text), F.transform(runs, lambda r: r["span"])))
    out = docs.withColumn("__spans", spans)
    place = lambda at, n: (at.cast("int"), n.cast("int"))

    def gaps(found: Column) -> Column:  # what stays before each mark, as (at, start)
        ends = _before(F.transform(found, lambda x: x["end"]), F.greatest)
        both = F.zip_with(found, ends, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start")))
        return F.filter(both, lambda x, i: (x["start"] > x["at"]) | (i == 0))

    def pieces(block: Column) -> Column:  # a block's text is cut out once; its gaps are cut from that
        first = block[0]["at"]
        whole = F.substring(text, *place(first + 1, F.element_at(block, -1)["start"] - first))
        return _let(whole, lambda own: F.array_join(F.transform(block, lambda x: F.concat(F.substring(own, *place(x["at"] - first + 1, x["start"] - x["at"])), F.lit(mark))), ""))

    last = F.array_max(F.transform("__spans", lambda x: x["end"]))
    clean = F.concat(F.array_join(F.transform(_blocks_of(_let(F.col("__spans"), gaps)), pieces), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))
    return out.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))).drop("__spans")


def _blocks_of(values: Column) -> Column:
    return _let(values, _blocks)
