"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source, targets are filled up to a ceiling on repetition, and each document is
emitted floor(rate) times plus one copy drawn by a hash with the probability of the fraction.

Null or empty texts have size 0 and are taken 0 words. A null source is a source of its own, last in
order. Repeated rows draw alike, as the hash sees the id and the text only. An empty table gives no
rows. Other columns of the documents pass through; columns made here replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix"


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the document alone."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / float(2**52)


def source_targets(sized: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """Per source its size and target, from rows with ``source`` and ``size``.

    Targets share the whole size by weight, a target ending at ``ceiling`` times its source. With sources
    in order of ceiling by weight, those that end there are a prefix, found from running totals in one pass
    over the sources' summary rows (one row a source, never documents).
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    most = F.col("source_size") * float(ceiling)
    by_reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_reach.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        weighed.withColumn("most", most)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / (F.col("weights") - F.col("gone")))
        .withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    )
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(open_level * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _planned(docs: DataFrame, weights, ceiling: float) -> DataFrame:
    """``docs`` with its own columns and ``__size``, ``__source_size``, ``__target`` and ``__copies``."""
    sized = docs.withColumn("__size", n_words(F.col("text")))
    # A stored summary of one row a source: the planner broadcasts it by its file size, or splits skewed sources.
    sums = source_targets(docs.select("source", n_words(F.col("text")).alias("size")), weights, ceiling)
    targets = written(sums.toDF("__source", "__source_size", "__target"), "targets")
    rate = F.coalesce(F.try_divide(F.col("__target"), F.col("__source_size")), F.lit(0.0))
    extra = draw(F.col("doc_id"), F.col("text")) < rate - F.floor(rate)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")
    return joined.withColumn("__copies", F.floor(rate) + extra.cast("long"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``: how often the mix takes each document."""
    made = ("size", "source_size", "target", "copies")
    planned = _planned(docs, weights, ceiling)
    return planned.select(*[c for c in docs.columns if c not in made], *[F.col(f"__{c}").alias(c) for c in made])


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """The mixed documents: each row as often as the plan takes it, with ``copy`` from 1."""
    taken = _planned(docs, weights, ceiling).filter(F.col("__copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("copy")
    return taken.select(*[c for c in docs.columns if c != "copy"], copies)
