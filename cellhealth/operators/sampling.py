"""Samples, splits and folds that can be replayed: rows are ordered by a digest of their id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the digest that name its bucket: 65,536 buckets per class.
_BUCKET_DIGITS = 4

RESERVOIR = 500
SEED = 42


def row_digest(ids: Sequence[str], seed: int = SEED) -> Column:
    """Pseudo-random but repeatable order of rows, from the columns that identify them."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def bounded_sample(
    rows: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    cap: int = RESERVOIR,
    seed: int = SEED,
    salts: int = 64,
) -> DataFrame:
    """A uniform sample of at most ``cap`` rows per key.

    Least digests per (key, salt) first, then per key: the second step sees at most ``cap * salts``
    rows of any key, however many it has.
    """
    digest = row_digest(ids, seed)
    salted = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)))
    for group in ([*keys, "salt"], list(keys)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("digest"))
        salted = salted.withColumn("place", place).filter(F.col("place") <= cap)
    return salted.drop("digest", "salt", "place")


def _digests_at_ranks(rows: DataFrame, label: str, ranks: Column) -> DataFrame:
    """``label, cuts``: the digests found at the given 1-based ranks of each class.

    ``ranks`` is an array expression over ``total``, the size of the class; ranks of 0 are left out.
    Bucket counts show which bucket holds a rank, and only those buckets are ordered row by row.
    """
    slim = rows.select(label, "digest", F.substring("digest", 1, _BUCKET_DIGITS).alias("bucket"))
    in_class = Window.partitionBy(label)
    upto = F.sum("n").over(in_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    buckets = (
        slim.groupBy(label, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", upto)
        .withColumn("total", F.sum("n").over(in_class))
    )
    wanted = (
        buckets.withColumn("rank", F.explode(F.array_distinct(ranks)))
        .filter("upto >= rank and upto - n < rank")
        .select(label, "bucket", (F.col("rank") - F.col("upto") + F.col("n")).alias("place"))
    )
    # At most one row per class and cut, hence a few rows.
    held = wanted.groupBy(label, "bucket").agg(F.collect_set("place").alias("places"))
    in_bucket = Window.partitionBy(label, "bucket").orderBy("digest")
    return (
        slim.join(held, [label, "bucket"])
        .withColumn("place", F.row_number().over(in_bucket))
        .filter(F.array_contains("places", F.col("place").cast("bigint")))
        .groupBy(label)
        .agg(F.sort_array(F.collect_set("digest")).alias("cuts"))
    )


def _with_cuts(rows: DataFrame, label: str, ids: Sequence[str], ranks: Column, seed: int) -> DataFrame:
    digested = rows.withColumn("digest", row_digest(ids, seed))
    cuts = _digests_at_ranks(digested, label, ranks)
    # One row per class: the rows themselves are not shuffled to be split.
    return digested.join(cuts, label, "left")


def stratified_split(
    rows: DataFrame, label: str, ids: Sequence[str], test_share: tuple[int, int] = (1, 5), seed: int = SEED
) -> DataFrame:
    """Adds ``is_test``: the same share of every class, rounded up, drawn by digest."""
    part, whole = test_share
    test_size = F.expr(f"(total * {part} + {whole - 1}) div {whole}")
    cut = _with_cuts(rows, label, ids, F.array(test_size), seed)
    return cut.withColumn("is_test", F.col("digest") <= F.element_at("cuts", 1)).drop("digest", "cuts")


def cross_validation_folds(
    rows: DataFrame, label: str, ids: Sequence[str], folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Adds ``fold``, 0 to ``folds - 1``: blocks of equal size within every class, by digest."""
    ends = F.filter(
        F.array(*[F.expr(f"total * {i} div {folds}") for i in range(1, folds)]), lambda rank: rank > 0
    )
    cut = _with_cuts(rows, label, ids, ends, seed)
    ahead = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<string>")), lambda c: F.col("digest") <= c))
    missing = F.lit(folds - 1)
    return cut.withColumn("fold", (missing - ahead).cast("int")).drop("digest", "cuts")
