"""Line dedup with a fixed-depth tree of line templates (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeworks.llm.common import marked_slots, slot_filter, written

#: Leading tokens that are levels of the tree, after the level of the token count.
LEADING = 3
#: A template recurs when this many different texts hold it.
MIN_DOCS = 5
#: Tokens from which on a line is long.
LONG = 50
#: Share of a template's tokens that must be constant for it to count.
MIN_CONSTANT = 0.7

WILD = "<*>"
_WORD = r"[^\x20\x09-\x0D]+"


def _masked(tokens: Column, line: Column | None = None) -> Column:
    """Tokens with a digit made wild; those of a line without any are not looked at one by one."""
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILD)).otherwise(t))
    return masked if line is None else F.when(line.rlike("[0-9]"), masked).otherwise(tokens)


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_WORD), F.lit(0))


def _leaf(tokens: Column) -> Column:
    """128-bit name of a leaf: token count and leading tokens."""
    return F.unhex(F.md5(F.concat_ws("\x1f", F.size(tokens).cast("string"), _masked(F.slice(tokens, 1, LEADING)))))


def _counted(tokens: Column, short: bool) -> Column:
    """Whether a line has a leaf: more than LEADING tokens or, with `short`, a token without a digit."""
    long = F.size(tokens) > LEADING
    return long | F.exists(tokens, lambda t: ~t.rlike("[0-9]")) if short else long


def _long_lines(lined: DataFrame, least: int) -> DataFrame:
    """doc_id, mark and place of the lines of LONG tokens or more whose tokens, as they are, stand in `least` different texts."""
    lines = lined.select("doc_id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.length("line") >= 2 * LONG - 1)
    line = F.trim("line")
    plain = ~F.contains("line", F.lit("  "))  # words one space apart and no other sign between them: no pattern is needed
    for sign in "\t\x0b\x0c\r":
        plain = plain & ~F.contains("line", F.lit(sign))
    raw = _tokens(F.col("line"))
    n = F.when(plain, F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).otherwise(F.size(raw))
    tokens = lines.where(n >= LONG).select("doc_id", "mark", "at", F.unhex(F.md5(F.when(plain, line).otherwise(F.array_join(raw, " ")))).alias("whole"))
    lines = written(tokens, "long")
    shared = lines.select("mark", "whole").distinct().groupBy("whole").count().where(F.col("count") >= least)
    return lines.join(shared, "whole", "left_semi").select("doc_id", "mark", "at")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, short: bool = True, long_docs: int | None = 2) -> DataFrame:
    """doc_id, text without recurring lines, n_lines and n_dropped for every row of docs (doc_id, text).

    Lines are what stands between line ends. A line's leaf is its token count and its first LEADING tokens, tokens with a
    digit being wild. In leaves that `min_docs` different texts hold, a later token is constant if `min_docs` of the texts' distinct
    lines have it at its place, else wild. Lines whose template has a constant share of `min_constant` and stands in
    `min_docs` different texts are dropped from all of them, whole; the others stay as they are. Equal texts count as one, so a document
    and its copies alone keep all lines, however many copies there are. Null texts have no line and stay null; empty texts have one.
    Texts of any length are rows of tasks, never held together; other columns of docs are left out, so none can clash.

    All of a short line's tokens (LEADING at most) are levels of the tree, and it is a template of its own if one of them is constant,
    whatever the share; without `short` such lines are never dropped. Lines without a token always stay. Lines of LONG
    tokens or more are also dropped where `long_docs` different texts hold the same tokens, digits included; None leaves that out.
    """
    own = docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
    lined = own.where("text is not null")
    each = F.filter(F.transform(F.split("text", "\n", -1), _tokens), lambda t: _counted(t, short))
    leaves = lined.select(F.explode(F.array_distinct(F.transform(each, _leaf))).alias("leaf"))
    # Leaves of fewer rows have no recurring template. What the table of bits lets pass besides has none either, and is counted for nothing.
    hot = marked_slots(written(leaves.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves"), "leaf")
    lines = lined.select("doc_id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("raw", _tokens(F.col("line")))
    # A line without a leaf has an empty one: no filter, and no check for nulls, works out the tokens anew.
    leaf = F.coalesce(F.when(_counted(F.col("raw"), short), _leaf(F.col("raw"))), F.expr("x''"))
    lines = slot_filter(lines.select("doc_id", "mark", "at", "line", "raw", leaf.alias("leaf")), hot, "leaf")
    tokens = lines.select("doc_id", "mark", "at", "leaf", _masked(F.col("raw"), F.col("line")).alias("tokens"))
    # From here on a line is the name of its masked tokens, and a token a hash: rows stay short whatever the line's length.
    name = F.unhex(F.md5(F.concat_ws("\x1f", "tokens")))
    lead = F.size(F.filter(F.slice("tokens", 1, LEADING), lambda t: t != WILD))
    later = F.transform(F.slice("tokens", LEADING + 1, F.greatest(F.size("tokens") - LEADING, F.lit(1))), lambda t: F.when(t != WILD, F.xxhash64(t)))
    lines = written(tokens.select("doc_id", "mark", "at", "leaf", name.alias("shape"), F.size("tokens").alias("n"), lead.alias("lead"), later.alias("later")), "lines").where("leaf <> x''")  # asked of the written rows, so that no leaf is worked out for it
    once = lines.groupBy("mark", "leaf", "shape").agg(F.lit(1).alias("one"))
    shapes = written(lines.groupBy("leaf", "shape").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("later").alias("later")), "shapes")
    spread = once.groupBy("leaf", "shape").count().join(shapes, ["leaf", "shape"])
    fields = spread.select("leaf", "count", F.posexplode("later").alias("place", "token")).where("token is not null")
    fixed = written(fields.groupBy("leaf", "place", "token").agg(F.sum("count").alias("count")).where(F.col("count") >= min_docs).select("leaf", "place", "token"), "fields")
    spots = shapes.select("leaf", "shape", F.posexplode("later").alias("place", "token")).where("token is not null").join(fixed, ["leaf", "place", "token"])
    spots = spots.groupBy("leaf", "shape").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("spots"))
    known = shapes.select("leaf", "shape", "n", "lead").join(spots, ["leaf", "shape"], "left")
    share = (F.col("lead") + F.coalesce(F.size("spots"), F.lit(0))) / F.col("n")
    template = F.xxhash64("leaf", F.coalesce(F.to_json("spots"), F.lit("[]")))
    known = known.where((share >= min_constant) | (F.col("n") <= LEADING)).select("leaf", "shape", template.alias("template"))
    shaped = written(lines.select("doc_id", "mark", "at", "leaf", "shape").join(known, ["leaf", "shape"]).select("doc_id", "mark", "at", F.struct("leaf", "template").alias("template")), "templates")
    recurring = shaped.select("mark", "template").distinct().groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    bad = shaped.join(recurring, "template", "left_semi").select("doc_id", "mark", "at")
    if long_docs is not None:
        bad = bad.unionByName(_long_lines(lined, long_docs))
    gone = bad.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("its")).agg(F.collect_set("at").alias("gone"))
    # One kind of join whatever the size, and no sort of whole texts.
    out = own.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")) & F.col("mark").eqNullSafe(F.col("its")), "left").drop("of", "its")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
