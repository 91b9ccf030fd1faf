"""SimHash fingerprints and the search within a Hamming radius (DataFrame functions only).

A text's terms are its pairs of neighbouring words, A-Z folded, weighted by how often they occur (a single word
stands for itself). The 64 bits of a term's hash vote +1 or -1 for each occurrence, and the signs of the sums,
ties giving 0, are the fingerprint. Votes are counted with three bits' counters in each long, per piece of at most
2^18 terms, so that a document costs one partial row of 22 sums however long it is, and no group gathers terms.

The search puts each distinct fingerprint into permuted block tables: 64 bits are cut into radius + 3 blocks, and
for each choice of 3 of them the chosen blocks form a key. Two fingerprints within the radius agree on at
least 3 blocks, so some table holds both under one key; candidates are compared by their bit count.

Null and empty texts have no terms and the fingerprint 0. Equal texts have equal fingerprints. Rows are ordered
by id (null first), then text; repeated rows are neighbours of each other. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, words, written

BITS, LANES = 64, 22
#: Bits j, j + 22 and j + 44 of a hash, once shifted right by j.
_LANE_MASK = 1 | 1 << LANES | 1 << 2 * LANES
#: The top lane starts at bit 44: the sum of 2^18 terms stays within a long.
_PIECE_BITS = 18
RADIUS = 3
#: Rows an ordered bucket holds, about, up to the square of BUCKET_SIDE buckets; beyond, buckets grow and spill.
BUCKET_ROWS, BUCKET_SIDE = 4096, 64


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` (long) of every row; ``keys`` must tell the rows apart."""
    split = texts.select(*keys, words(lower_az(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    n = F.size("w")
    pairs = F.arrays_zip(F.when(n == 1, F.col("w")).otherwise(F.slice("w", 1, F.greatest(n - 1, F.lit(0)))).alias("one"), F.slice("w", 2, F.greatest(n - 1, F.lit(0))).alias("two"))
    terms = split.select(*keys, F.posexplode_outer(pairs).alias("__pos", "__term"))
    hashed = terms.select(*keys, F.shiftright(F.coalesce("__pos", F.lit(0)), _PIECE_BITS).alias("piece"), F.when(F.col("__term").isNotNull(), F.xxhash64("__term.one", "__term.two")).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANE_MASK))).alias(f"s{j}") for j in range(LANES)]
    pieces = hashed.groupBy(*keys, "piece").agg(F.count("h").alias("n"), *lanes)
    low = (1 << LANES) - 1
    ones = []
    for bit in range(BITS):
        lane, j = divmod(bit, LANES)
        ones.append(F.shiftrightunsigned(f"s{j}", lane * LANES).bitwiseAND(F.lit(low)) if lane < 2 else F.shiftrightunsigned(f"s{j}", 2 * LANES))
    counted = pieces.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"c{b}") for b, c in enumerate(ones)])
    sign = [F.when(2 * F.col(f"c{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    total = sign[0]
    for s in sign[1:]:
        total = total.bitwiseOR(s)
    return counted.select(*keys, total.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _bucketed(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """``docs`` with ``bucket``: ranges of ids in order, so that neighbours need no order over the whole table."""
    side = max(2, min(BUCKET_SIDE, int((docs.count() / bucket_rows) ** 0.5) + 1))
    marks = [i / side**2 for i in range(1, side**2)]
    cuts = docs.agg(F.percentile_approx("doc_id", marks, 10 * side**2).alias("cuts")).first()["cuts"] or []
    # Two digits: which run of cuts, then which cut in the run.
    runs = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[]]
    coarse = F.array(*[F.lit(r[0]).cast("long") for r in runs[1:]]) if len(runs) > 1 else F.array().cast("array<long>")
    fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in r]).cast("array<long>") for r in runs])
    run = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
    within = F.size(F.filter(F.element_at(fine, run + 1), lambda c: c <= F.col("doc_id")))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(run * (side + 1) + within))


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, ``next_text`` and the places ``at``, ``next_at`` of each row and its successor by id (cyclic).

    One shuffle by bucket of ids; a bucket's first row is also sent, as a ghost, to the end of the bucket before.
    """
    rows = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bucket_rows)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # The first row of each bucket and the bucket before it: summaries of one row a bucket.
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.count("*").alias("n"))
    ring = Window.orderBy("bucket")
    around = firsts.withColumn("before", F.lag("bucket").over(ring)).withColumn("last", F.max("bucket").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = written(around.select(F.col("bucket").alias("of"), "first", F.coalesce("before", "last").alias("before")), "heads")
    joined = rows.join(heads, F.col("bucket") == F.col("of"))
    is_first = F.struct("doc_id", "tie").eqNullSafe(F.col("first"))
    here = F.struct("bucket", F.lit(False).alias("ghost"), F.col("bucket").alias("home"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"), F.col("bucket").alias("home"))
    placed = joined.select("doc_id", "text", "tie", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("p"))
    placed = placed.select("p.*", "doc_id", "text", "tie")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie")
    place = F.row_number().over(order).cast("long")
    own = F.col("bucket") * F.lit(1 << 40) + place
    following = F.lead(F.struct("ghost", "home", "text")).over(order)
    seen = placed.withColumn("at", own).withColumn("follow", following)
    next_at = F.when(F.col("follow.ghost"), F.col("follow.home") * F.lit(1 << 40) + 1).otherwise(F.col("at") + 1)
    return seen.filter("not ghost").select("doc_id", "text", "at", next_at.alias("next_at"), F.col("follow.text").alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    text, next_text = F.coalesce(text, F.lit("")), F.coalesce(next_text, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(next_text, half))


def block_keys(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The keys of the permuted block tables: for each choice of 3 of radius + 3 blocks, its number and bits."""
    blocks = radius + 3
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), 3)):
        key = F.lit(number).cast("long")
        for b in chosen:
            width = ends[b + 1] - ends[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fingerprint, ends[b]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key)
    return F.array(*out)


def within_radius(asked: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b, distance``: distinct fingerprints of ``known`` within ``radius`` of each of ``asked``, itself left out."""
    tables = lambda df, name: df.select(F.col("fingerprint").alias(name)).distinct().select(name, F.explode(block_keys(F.col(name), radius)).alias("key"))
    met = tables(asked, "a").join(tables(known, "b"), "key")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return met.filter((F.col("a") != F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance")).distinct()
