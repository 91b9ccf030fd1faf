"""Helpers the text operators share: word rules, stored tables, hashes of words in numpy."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: A word, for Java and Python patterns alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows a side may have at most to be broadcast by hint; larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A piece of a text in a bounded sample holds at most this part of the budget.
SAMPLE_SHARE = 100


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document; one without id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and its size is known to the planner."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def place(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application in the shared folder."""
    return f"{checkpoint_root(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_written(spark: SparkSession) -> None:
    """Delete what ``written`` left for this application; call it when all results have been saved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/llm/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, hinted for a broadcast where its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= rows else df


def most_frequent(counts: DataFrame, n: str, most: int, also: Column | None = None) -> DataFrame:
    """The rows of a stored table whose count ``n`` reaches the lowest level that at most ``most`` rows reach.

    Levels are eighths of a doubling, some hundreds whatever the input; only their sizes are collected. Rows
    that ``also`` picks are added.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, cut = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        cut = row["level"]
    chosen = F.lit(False) if cut is None else level >= cut
    return counts.filter(chosen if also is None else chosen | also)


def budget_sample(docs: DataFrame, text: str, key: list[str], group: Column, budget: int, seed: int) -> DataFrame:
    """Pieces of ``docs`` chosen by a hash, at most ``budget`` characters a group, ``text`` being the piece.

    A text of at most budget / ``SAMPLE_SHARE`` characters is one piece and longer ones are cut into such, so none
    can fill the budget or end the sample early: a group's sample falls short of its budget by less than one piece
    unless the group is used up. Rows of equal key and text count once. Which pieces these are depends on the rows
    alone, not on their order or partitioning.
    """
    from pyspark.sql import Window

    most = max(1, budget // SAMPLE_SHARE)
    cut = F.when(F.length(text) <= most, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)))
    pieces = docs.withColumn("__group", group).withColumn("__row", F.xxhash64(F.lit(seed), "__group", *key))
    pieces = pieces.select("*", F.posexplode(cut).alias("__at", "__text"))
    pieces = pieces.withColumn("__piece", F.xxhash64(F.lit(seed), "__row", "__at"))
    sizes = written(pieces.groupBy("__group", "__piece").agg(F.max(F.length("__text")).alias("size")), "sample-pieces")
    total = sizes.groupBy("__group").agg(F.sum("size").alias("total"))
    # Twice the budget, of which the first pieces by hash that fit are taken: the ordered rows are bounded by it.
    share = F.pmod("__piece", F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sizes.join(total, "__group").withColumn("share", share).filter(F.col("share") * F.col("total") <= 2.0 * budget)
    upto = Window.partitionBy("__group").orderBy("share", "__piece").rowsBetween(Window.unboundedPreceding, 0)
    chosen = written(drawn.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= budget).select(F.col("__piece")), "sample")
    taken = pieces.join(small(chosen), "__piece", "left_semi").dropDuplicates(["__piece"])
    return taken.select(*[F.col("__text").alias(c) if c == text else F.col(c) for c in docs.columns])


# -- numpy ------------------------------------------------------------------------------------------

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_RANDOM = np.random.default_rng(20_240_301)
_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text hashed together.
_BLOCK = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of UTF-8 texts, A-Z folded, and where each text's words begin (and the last's end).

    Words are read eight bytes at a time; the loop goes on for those that are longer.
    """
    data = b"\n".join(texts)
    if fold:
        data = data.translate(_FOLD)
    a = np.frombuffer(b"\n" + data + b"\n" + bytes(8), np.uint8)
    space = (a[: len(data) + 2] == 32) | (a[: len(data) + 2] - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    eight = np.ndarray((len(a) - 7,), "<u8", buffer=a, strides=(1,))
    length = end - start
    h = length.astype(np.uint64) + _NEXT
    at, left, rows = start, length, None
    while len(at):
        part = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        if rows is None:
            h = mix(h ^ part * _NEXT)
        else:
            h[rows] = mix((h[rows] ^ part) * _NEXT)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(start, offsets)


def _blocks(texts: list[bytes]):
    """Runs of texts of a few million bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def shingle_sets(texts: list[bytes], n: int = 5):
    """Per text, the sorted distinct hashes of its n-word shingles; of fewer words, one for the whole sequence."""
    for block in _blocks(texts):
        w, bound = word_hashes(block)
        full = np.full(max(0, len(w) - n + 1), n, np.uint64)
        for k in range(n if len(full) else 0):
            full += w[k : len(full) + k] * _STEP[k]
        full = mix(full)
        for low, high in zip(bound[:-1], bound[1:]):
            if high - low >= n:
                s = np.sort(full[low : high - n + 1])
                new = s[1:] != s[:-1]
                yield s if new.all() else s[np.concatenate(([True], new))]
            elif high > low:
                m = int(high - low)
                yield mix((w[low:high] * _STEP[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m))
            else:
                yield w[low:low]
