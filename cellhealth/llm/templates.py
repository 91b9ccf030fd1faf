"""Line deduplication by a tree of line templates (DataFrame functions only).

A line is its words; a word with a digit is a variable field. The tree has fixed depth: token count, then
the first tokens. Under a leaf, a template is a line with its variable fields masked, and, for longer lines,
the same with one further quarter of the remaining tokens masked, so that lines differing in one field meet.

A line is shared when a template of it stands in at least ``MIN_TEXTS`` different texts. A template recurs when its lines stand in at
least ``MIN_AROUND`` different surroundings: the head of the nearest line before them (or after them) that is not shared. So a shared
passage of several lines goes or stays as one, and the share of texts that hold a line never keeps it; copies of one document repeat their
lines in the same surroundings and so stay comparable for near-copy removal. Every line of a recurring template is dropped; all counts
are over all lines. ``keep_own_text`` is the pipeline's form, which also drops documents that were nothing else.

Null texts stay null with no lines; lines without ``MIN_TOKENS`` words (blank ones too) are never dropped; the
kept lines keep their order and bytes. Documents are told apart by id and text: repeated rows fare alike, and
copies under several ids count as one text. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_TEXTS = 5
MIN_TOKENS = 3
#: Different surroundings a template needs, however many texts it stands in.
MIN_AROUND = MIN_TEXTS
#: Leading tokens that the tree branches on, tokens of the line's head, blocks the rest is masked by, and tokens a line needs for that.
LEADING, HEAD, BLOCKS, LONG = 2, 3, 4, 10
#: A masked word, possessive so that long words cost no more than their length.
_FIELD = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"
#: What a single blank takes the place of; lone blanks, the usual case, are left alone.
_BLANKS = r"[\x20\x09\x0B\x0C\x0D]{2,}|[\x09\x0B\x0C\x0D]"


def _masked_lines(text: Column) -> Column:
    """The text's lines with single blanks between words and variable fields masked."""
    spaced = F.regexp_replace(text, _BLANKS, " ")
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, _FIELD, "<*>")).otherwise(spaced)
    return F.split(masked, "\n")


def _head(line: Column) -> Column:
    return F.xxhash64(F.substring_index(line, " ", HEAD))


def _lines(docs: DataFrame) -> DataFrame:
    """One row a line with a word: document key, position, words, text, leaf, template hashes, head."""
    numbered = F.transform(_masked_lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    filled = docs.select("key", "key2", "whole", F.inline(F.filter(numbered, lambda x: x["line"] != "")))
    cut = filled.withColumn("head", _head(F.col("line"))).withColumn("tokens", F.split("line", " ")).withColumn("n", F.size("tokens"))
    leaf = F.xxhash64("n", F.slice("tokens", 1, LEADING))
    rest = F.greatest(F.col("n") - LEADING, F.lit(0))
    ends = [LEADING + F.floor(rest * i / BLOCKS).cast("int") for i in range(BLOCKS + 1)]
    blocks = [F.xxhash64(F.slice("tokens", ends[i] + 1, ends[i + 1] - ends[i])) for i in range(BLOCKS)]
    hashed = cut.select("key", "key2", "whole", "pos", "n", "head", leaf.alias("leaf"), *[b.alias(f"b{i}") for i, b in enumerate(blocks)])
    full = F.xxhash64(F.lit(-1), "leaf", *[f"b{i}" for i in range(BLOCKS)])
    partly = [F.xxhash64(F.lit(j), "leaf", *[f"b{i}" for i in range(BLOCKS) if i != j]) for j in range(BLOCKS)]
    templates = F.when(F.col("n") >= LONG, F.array(full, *partly)).otherwise(F.array(full))
    return hashed.select("key", "key2", "whole", "pos", "n", "head", "leaf", templates.alias("templates"))


def _recurring(lines: DataFrame) -> DataFrame:
    """Hashes of the templates that recur, their surroundings taken from outside the run of shared lines."""
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_TEXTS).select("leaf")
    spread = written(lines.join(leaves, "leaf").select("whole", "pos", F.explode("templates").alias("template")).distinct(), "spread")
    shared = spread.groupBy("template").agg(F.countDistinct("whole").alias("texts")).filter(F.col("texts") >= MIN_TEXTS)
    hits = written(spread.join(shared, "template"), "shared")
    marks = hits.select("whole", "pos").distinct().withColumn("shared", F.lit(True))
    own = lines.select("whole", "pos", "head").distinct().join(marks, ["whole", "pos"], "left").withColumn("own", F.when(F.col("shared").isNull(), F.col("head")))
    # One text's lines a window; the nearest line of its own on either side, or the text's edge.
    upto = lambda order: Window.partitionBy("whole").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda order, edge: F.coalesce(F.last("own", ignorenulls=True).over(upto(order)), F.lit(edge).cast("long"))
    around = own.withColumn("before", near(F.col("pos"), 1)).withColumn("after", near(F.col("pos").desc(), 2)).filter("shared").select("whole", "pos", "before", "after")
    met = hits.join(around, ["whole", "pos"]).groupBy("template").agg(F.countDistinct("before").alias("befores"), F.countDistinct("after").alias("afters"))
    return met.filter(F.greatest("befores", "afters") >= MIN_AROUND).select("template")


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` with its text cut, and ``__n_lines`` and ``__n_dropped``."""
    keyed = docs.withColumns({"__key": F.xxhash64(F.lit(1), "doc_id", "text"), "__key2": F.xxhash64(F.lit(2), "doc_id", "text")})
    sources = keyed.select(F.col("__key").alias("key"), F.col("__key2").alias("key2"), F.xxhash64(F.lit(3), "text").alias("whole"), "text")
    lines = written(_lines(sources), "lines")
    recurring = written(_recurring(lines), "recurring")
    hits = lines.filter(F.col("n") >= MIN_TOKENS).select("key", "key2", "pos", F.explode("templates").alias("template")).join(recurring, "template")
    # Few positions a document: its own lines at most.
    dropped = written(hits.groupBy(F.col("key").alias("__key"), F.col("key2").alias("__key2")).agg(F.collect_set("pos").alias("__dropped")), "dropped")
    # Behind a generator the lines are split once a text, not once a kept line; what is kept is a set difference, in the text's order.
    joined = keyed.join(dropped, ["__key", "__key2"], "left").select("*", F.explode(F.array(F.split("text", "\n"))).alias("__lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__dropped")
    rest = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(rest)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("__n_dropped"),
    )


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its text less the lines of recurring templates, plus ``n_lines`` and ``n_dropped``."""
    made = ("n_lines", "n_dropped")
    return _cut(docs).select(*[c for c in docs.columns if c not in made], *[F.col(f"__{c}").alias(c) for c in made])


def keep_own_text(docs: DataFrame) -> DataFrame:
    """The pipeline's form: documents less recurring lines; those of which no word is left go. ``n_chars`` follows the text."""
    out = _cut(docs)
    emptied = (F.col("__n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = F.col("__n_dropped") > 0
    chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.filter(~emptied).select(*[chars if c == "n_chars" else F.col(c) for c in docs.columns])
