"""Filter interaction audit by failing-id relations.

Each filter has a stored table of the rows that fail it (row number, part, label flags). For every filter and every set of filters
before it (a prefix; its order does not change what it leaves), left-anti joins with the prefix's tables leave the rows that this
filter removes, and a left-semi join with their union the redundant ones, which the prefix removed before. All prefixes go through the
same joins, as a column: a row of a table is expanded to the prefixes after it is dealt by its number, so nothing is shuffled once a
prefix, and the tables meet in hash joins of one partition. Counts per (part, filter, prefix) are small; the orders are
read off from them, and the survivors of an order follow from the part's rows less what its steps removed.

Filters: A under 50 words; B under 65 % distinct words; C over 5 % capitals A-Z; D a character of ``#$%&*|``; E the text of a
document with a lesser id. Null texts are empty (A, and E where another is empty). A null source is the part ``''``. Rows without an id
come after all ids for E, and carry no label; repeated rows each count, and of equal ids none is lesser. A document with several
label rows has a label that any of them gives. A part's shares of ``shapley`` are removals summed over all orders. An empty table gives no
rows; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"


def _alone(text: Column) -> dict[str, Column]:
    """The filters that a text fails by itself."""
    found = F.array_remove(F.split(text, SPACES), "")
    n, capitals = F.size(found), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)).cast("long") < MIN_DISTINCT * n.cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def failing_ids(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """A stored table (row, part, good, toxic) of the failing rows per filter, and the rows per part."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    marks = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in _alone(F.col("text")).items()])
    any_of = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(any_of("quality"), any_of("toxic"))
    facts = marks.join(flags, "doc_id", "left").withColumnRenamed("quality", "good").na.fill(0, ["good", "toxic"])
    facts = written(facts.withColumn("row", F.monotonically_increasing_id()), "facts")
    first = facts.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1")
    # One row a digest on this side, and stored: adaptive execution can then split the copies of a common text.
    repeats = facts.join(written(first.select("digest", "least"), "repeated"), "digest").filter("least < doc_id or doc_id is null and least is not null")
    tables = {k: written((repeats if k == "E" else facts.filter(F.col(k))).select("row", "part", "good", "toxic"), f"failing-{k}") for k in FILTERS}
    return tables, facts.groupBy("part").agg(F.count("*").alias("rows"))


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def prefix_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Per ``part``, ``bit`` (of the filter) and ``prefix`` (a set, as bits): rows removed, redundant, and labels lost."""
    every = reduce(DataFrame.unionByName, [t.select("row", "part", "good", "toxic", F.lit(_bit(k)).alias("bit")) for k, t in tables.items()])
    others = [F.when(F.col("bit") == _bit(k), F.array(*[F.lit(s) for s in range(1 << len(FILTERS)) if not s & _bit(k)])) for k in FILTERS]
    # Dealt by row number first: the expansion stays where its rows are.
    asked = every.repartition("row").select("*", F.explode(F.coalesce(*others)).alias("prefix"))
    removed = asked
    for k, t in tables.items():
        gone = t.select(F.col("row").alias("gone")).hint("shuffle_hash")
        removed = removed.join(gone, (F.col("row") == F.col("gone")) & (F.col("prefix").bitwiseAND(_bit(k)) != 0), "left_anti")
    before = reduce(DataFrame.unionByName, [t.select(F.col("row").alias("gone"), F.lit(_bit(k)).alias("by")) for k, t in tables.items()])
    redundant = asked.join(before.hint("shuffle_hash"), (F.col("row") == F.col("gone")) & (F.col("prefix").bitwiseAND(F.col("by")) != 0), "left_semi")
    n = lambda c: F.sum(c).cast("long")
    left = removed.groupBy("part", "bit", "prefix").agg(F.count("*").alias("removed"), n("good").alias("good_lost"), n("toxic").alias("toxic_lost"))
    over = redundant.groupBy("part", "bit", "prefix").agg(F.count("*").alias("redundant"))
    return left.join(over, ["part", "bit", "prefix"], "full").na.fill(0)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: counts of the filter at that step."""
    tables, totals = failing_ids(docs, labels)
    counts = written(prefix_counts(tables), "prefix-counts")
    order = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = totals.select("part", "rows", order).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {at}, 1)) - 1)")
    prefix = [F.when(F.col("step") > i, bit(i)).otherwise(0) for i in range(1, len(FILTERS))]
    asked = steps.withColumns({"bit": bit("step"), "prefix": reduce(lambda a, b: a + b, prefix)})
    at = asked.join(counts, ["part", "bit", "prefix"], "left").na.fill(0)
    rest = counts.filter(F.col("bit") + F.col("prefix") == (1 << len(FILTERS)) - 1).select("part", "bit", F.col("removed").alias("unique_fails"))
    share = at.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    whole = at.join(rest, ["part", "bit"], "left").join(share, ["part", "bit"]).na.fill(0)
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))  # five rows a window
    figures = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return whole.select("part", "filter_order", "step", (F.col("rows") - so_far).alias("kept"), *figures)
