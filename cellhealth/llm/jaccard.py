"""Exact Jaccard self-join of word shingles in the metric space of their distance.

Texts with the same set are one node from the start. Two sets with a similarity of at least t share one of
the first |x| - ceil(t |x|) + 1 of their shingles under any common order, and e + 1 of the first
|x| - ceil(t |x|) + e + 1 (the lesser e of the two, if it depends on the size). Each such shingle shared by two nodes or
more spans a region, every link lies within so many regions, and a node in fewer has no link. The order puts shingles that the data
repeat most last (their counts come from all texts; whatever they are, the order stays valid), which keeps
passages shared by unrelated texts from spanning regions.

A node's shingles that no other node in question has count against every link of it: with too many of them it
has none. A region's pivot is its node with the least share of such shingles, and the Voronoi cell of a pivot holds
every node of the regions it stands for, so linked nodes share a cell. Each node is first measured against the pivot
it shares most regions with; a cell whose nodes are then in one component is done. In others all nodes are
measured against the pivot, and two nodes of different components are compared where the triangle inequality,
their sizes, their shingles in the pivot and their own shingles leave room for a link. A large cell is
divided first: several pivots are measured against all its nodes, and nodes go to the cell of the nearest one and
to each that is at most 2 (1 - t) farther away, level by level; a cell that pivots do not divide is compared as it is,
whatever its size. So the result is exact: two texts have the same component if and only if a chain of links joins them.

Shingles are 64-bit hashes of words with A-Z folded, sets are named by 128 bits.

Null and empty texts have an empty set and no link. Texts of fewer words than a shingle have one shingle, the
whole sequence. Documents with a null id count as members; a component's id is its least non-null id (null
if there is none). Repeated rows give repeated rows. Other columns do not matter.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, most_frequent, shingle_sets, small, written
from .components import components

SIMILARITY = Fraction(4, 5)
SHINGLE = 5
#: The summary of often repeated shingles: kept a batch of texts, kept in all, least count.
HEAVY_BATCH, HEAVY_KEPT, HEAVY_LEAST = 100_000, 500_000, 4
#: A cell up to this size compares nodes directly; larger ones get so many pivots.
SMALL, PIVOTS = 256, 4
#: Sets share so many more of their first shingles: one for each EXTRA of the set's size.
EXTRA = 10
#: Nodes up to this number are told to the workers when sets are fetched; more are joined.
TOLD = 4_000_000
_WORLD = np.uint64(0xD1342543DE82EF95)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums over each set: a name that equal sets share."""
    out = np.zeros((2, len(sets)), np.uint64)
    some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    ends = np.cumsum([len(sets[i]) for i in some])
    at = 0
    while at < len(some):  # a million shingles at a time, one set at least
        begun = ends[at] - len(sets[some[at]])
        end = max(at + 1, int(np.searchsorted(ends, begun + (1 << 20), "right")))
        block = some[at:end]
        flat = np.concatenate([sets[i] for i in block])
        begin = np.concatenate(([0], ends[at : end - 1] - begun))
        out[0, block], out[1, block] = np.add.reduceat(mix(flat), begin), np.add.reduceat(mix(flat * _WORLD), begin)
        at = end
    return out.view(np.int64)


def _distinct_sets(batches, n: int):
    """Per batch, the names and sets not seen before in this task."""
    seen = set()
    for batch in batches:
        sets = list(shingle_sets(_texts(batch), n))
        found = []
        for name, s in zip(zip(*_names(sets).tolist()), sets):
            if len(s) and name not in seen:
                seen.add(name)
                found.append((name, s))
        yield found


def _counted(docs: DataFrame, n: int) -> DataFrame:
    """From one reading of the texts, rows of two kinds: a document's set (``kind`` 0: doc_id, size, name, name2),
    and a shingle that a batch of texts repeats most (``kind`` 1: shingle and count in name and size)."""
    fields = ["kind", "doc_id", "size", "name", "name2"]

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(_texts(batch), n))
            names = _names(sets)
            size = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int64)), batch.column("doc_id"), pa.array(size), pa.array(names[0]), pa.array(names[1])], fields)
            first = np.unique(names[0], return_index=True)[1]  # copies count once
            flat = np.sort(np.concatenate([np.empty(0, np.uint64), *[sets[i] for i in first]]))
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1])))
            count = np.diff(np.concatenate((begin, [len(flat)])))
            again = np.flatnonzero(count > 1)
            if len(again) > HEAVY_BATCH:
                again = again[np.argpartition(-count[again], HEAVY_BATCH)[:HEAVY_BATCH]]
            nothing = pa.nulls(len(again), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(again), np.int64)), nothing, pa.array(count[again]), pa.array(flat[begin[again]].view(np.int64)), nothing], fields)

    return docs.select("doc_id", "text").mapInArrow(run, "kind long, doc_id long, size long, name long, name2 long")


def _heavy(counted: DataFrame) -> pd.DataFrame:
    """The shingles repeated most, as far as batches of texts can tell, with a lower bound of their counts."""
    sums = counted.filter("kind = 1").groupBy(F.col("name").alias("shingle")).agg(F.sum("size").alias("n"))
    return most_frequent(written(sums.filter(F.col("n") >= HEAVY_LEAST), "heavy"), "n", HEAVY_KEPT).toPandas()


def _extra(size: int) -> int:
    """How many of its first shingles a set must share, at least, with a set it is linked to (of no larger size)."""
    return 1 + size // EXTRA


def _regions(docs: DataFrame, heavy: pd.DataFrame, n: int, similarity: Fraction, buckets: int) -> DataFrame:
    """``region, name`` for prefix shingles that several sets have."""
    by = np.argsort(heavy["shingle"].to_numpy(np.int64).view(np.uint64))
    token, count = heavy["shingle"].to_numpy(np.int64).view(np.uint64)[by], heavy["n"].to_numpy(np.int64)[by]
    held = docs.sparkSession.sparkContext.broadcast((token, count))  # HEAVY_KEPT entries at most

    def prefix(s: np.ndarray) -> np.ndarray:
        token, count = held.value
        length = len(s) - -(-similarity.numerator * len(s) // similarity.denominator) + _extra(len(s))
        if not len(token):
            return s[:length]
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        often = token[at] == s
        light = s[~often]
        if len(light) >= length:
            return light[:length]
        rest, weight = s[often], count[at[often]]
        return np.concatenate((light, rest[np.lexsort((rest, weight))][: length - len(light)]))

    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def deal(batches):
        for found in _distinct_sets(batches, n):
            if not found:
                continue
            parts = [prefix(s) for _, s in found]
            shingle = np.concatenate(parts)
            name = np.repeat(np.array([k[0] for k, _ in found], np.int64), [len(p) for p in parts])
            by = np.argsort(shingle)
            shingle, name = shingle[by], name[by]
            bucket, first = np.unique((shingle >> shift).astype(np.int64), return_index=True)
            ends = [*first[1:], len(shingle)]
            blobs = [[x[i:j].tobytes() for i, j in zip(first, ends)] for x in (shingle, name)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["bucket", "shingles", "names"])

    def shared(batches):
        kept = {}
        for batch in batches:
            for bucket, s, k in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shingles", "names"))):
                kept.setdefault(bucket, []).append((np.frombuffer(s, np.uint64), np.frombuffer(k, np.int64)))
        while kept:
            parts = kept.popitem()[1]
            s, k = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            by = np.lexsort((k, s))
            s, k = s[by], k[by]
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
            s, k = s[new], k[new]
            same = s[1:] == s[:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield pa.RecordBatch.from_arrays([pa.array(s[several].view(np.int64)), pa.array(k[several])], ["region", "name"])

    dealt = docs.select("text").mapInArrow(deal, "bucket long, shingles binary, names binary")
    return dealt.repartition("bucket").mapInArrow(shared, "region long, name long")


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``node, shingles`` (sorted hashes as binary) of the nodes asked for."""
    wanted = nodes.select("name", "name2", "node")
    told = None
    if nodes.count() <= TOLD:
        told = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.select("name").toPandas()["name"].to_numpy(np.int64)))

    def run(batches):
        for found in _distinct_sets(batches, n):
            if told is not None and found:
                names = np.array([k[0] for k, _ in found], np.int64)
                at = np.searchsorted(told.value, names)
                fits = told.value[np.minimum(at, len(told.value) - 1)] == names if len(told.value) else np.zeros(len(names), bool)
                found = [x for x, y in zip(found, fits) if y]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["name", "name2", "shingles"])

    made = docs.select("text").mapInArrow(run, "name long, name2 long, shingles binary")
    return made.join(wanted, ["name", "name2"]).groupBy("node").agg(F.first("shingles").alias("shingles"))


def _own(sets: DataFrame, buckets: int) -> DataFrame:
    """``node, own``: how many of a node's shingles no other node has."""
    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def deal(batches):
        for batch in batches:
            nodes, blobs = batch.column("node").to_pylist(), batch.column("shingles").to_pylist()
            if not blobs:
                continue
            shingle = np.frombuffer(b"".join(blobs), np.uint64)
            node = np.repeat(np.array(nodes, np.int64), [len(x) // 8 for x in blobs])
            by = np.argsort(shingle)
            shingle, node = shingle[by], node[by]
            bucket, first = np.unique((shingle >> shift).astype(np.int64), return_index=True)
            spans = list(zip(first, [*first[1:], len(shingle)]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *[pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (shingle, node)]], ["bucket", "shingles", "nodes"])

    def count(batches):
        kept = {}
        for batch in batches:
            for bucket, s, k in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shingles", "nodes"))):
                kept.setdefault(bucket, []).append((np.frombuffer(s, np.uint64), np.frombuffer(k, np.int64)))
        found = []
        while kept:
            parts = kept.popitem()[1]
            s, k = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            by = np.argsort(s)
            s, k = s[by], k[by]
            edge = np.concatenate(([True], s[1:] != s[:-1], [True]))
            found.append(k[edge[1:] & edge[:-1]])
        if found:
            node, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], ["node", "own"])

    dealt = sets.mapInArrow(deal, "bucket long, shingles binary, nodes binary").repartition("bucket")
    return dealt.mapInArrow(count, "node long, own long").groupBy("node").agg(F.sum("own").alias("own"))


def _measure(pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
    """``a, b, both, either`` for pairs of nodes; a node with many partners is spread over several groups."""
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(16)))
    right = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "shingles")
    left = salted.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")

    def run(batches):
        at, mine = None, None
        for batch in batches:
            out = []
            for a, part, b, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "shingles"))):
                s = np.frombuffer(blob, np.uint64)
                if b is None:
                    at, mine = (a, part), s
                    continue
                assert at == (a, part)
                both = len(np.intersect1d(mine, s, assume_unique=True))
                out.append((a, b, both, len(mine) + len(s) - both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "both", "either"])

    # A group's first row is its node's own set; the others follow in order, read as a stream.
    rows = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(rows.mapInArrow(run, "a long, b long, both long, either long"), tag)


def _fits(similarity: Fraction):
    return F.col("both") * similarity.denominator >= F.col("either") * similarity.numerator


def _absorb(roots: DataFrame, links: DataFrame) -> DataFrame:
    """New roots (node, root) after further links (a, b)."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").filter("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    between = written(between, "links")
    if not between.limit(1).count():
        return roots
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def _open(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of cells that hold several components still, with the cell's size."""
    members = cells.join(roots, "node")
    spans = members.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).filter("low != high")
    return members.join(spans.select("cell", "members"), "cell")


def _able(regions: DataFrame, similarity: Fraction) -> DataFrame:
    """Regions less the nodes that share too few shingles to be linked, and less those then alone."""
    least = 1 + F.floor(F.ceil(F.col("size") * similarity.numerator / similarity.denominator) / EXTRA)
    enough = regions.groupBy("node").agg(F.count("*").alias("held"), F.first("size").alias("size")).filter(F.col("held") >= least).select("node")
    left = regions.join(enough, "node")
    several = left.groupBy("region").agg(F.count("*").alias("held")).filter("held > 1").select("region")
    return left.join(several, "region")


def _alike(similarity: Fraction, a: str = "size_a", b: str = "size_b"):
    t, u = similarity.numerator, similarity.denominator
    return (F.col(a) * u >= F.col(b) * t) & (F.col(b) * u >= F.col(a) * t)


def _within(open_: DataFrame, similarity: Fraction, tried: DataFrame, elsewhere: DataFrame | None) -> DataFrame:
    """Pairs of different components in a cell that may be linked, by what is known of them, and were not measured yet.

    ``both`` is what a node has in common with the cell's pivot, ``d`` its distance, ``own`` its shingles that are its
    alone: two nodes have at most the lesser ``both`` and the lesser rest in common. ``elsewhere`` (node, more) has
    the regions of a node that these cells do not stand for; without it the number of regions is not used.
    """
    side = lambda x: open_.select("cell", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "own", "both", "d", "votes")])
    t, u = similarity.numerator, similarity.denominator
    rest = lambda x: F.col(f"size_{x}") - F.col(f"both_{x}") - F.col(f"own_{x}")
    common = F.least("both_a", "both_b") + F.least(rest("a"), rest("b"))
    room = common * (t + u) >= (F.col("size_a") + F.col("size_b")) * t
    near = F.abs(F.col("d_a") - F.col("d_b")) <= float(1 - similarity) + 1e-9
    a, b = side("a"), side("b")
    met = a.join(b, (a.cell == b.cell) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _alike(similarity) & room & near)
    pairs = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.sum(F.least("votes_a", "votes_b")).alias("held"), F.first(F.least("size_a", "size_b")).alias("size"))
    if elsewhere is not None:
        pairs = pairs.join(elsewhere.withColumnRenamed("node", "a"), "a", "left")
        pairs = pairs.filter(F.col("held") + F.coalesce("more", F.lit(0)) >= 1 + F.floor(F.col("size") / EXTRA))
    return pairs.select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _measured(members: DataFrame, tried: DataFrame) -> DataFrame:
    """Members (cell, pivot, node, size, ...) with ``both`` and ``d`` against their pivot; the pivot is at 0."""
    known = tried.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "both", (1 - F.col("both") / F.col("either")).alias("d"))
    found = members.join(known, (F.least("pivot", "node") == F.col("__a")) & (F.greatest("pivot", "node") == F.col("__b")), "left").drop("__a", "__b")
    itself = F.col("pivot") == F.col("node")
    return found.withColumn("both", F.when(itself, F.col("size")).otherwise(F.col("both"))).withColumn("d", F.when(itself, F.lit(0.0)).otherwise(F.col("d")))


def link_components(docs: DataFrame, similarity: Fraction = SIMILARITY, n: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for ``docs`` (doc_id, text); see the module's text."""
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    t, u = similarity.numerator, similarity.denominator
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = written(_counted(docs, n), "counted")
    signed = counted.filter("kind = 0").select("doc_id", F.col("size").alias("n_shingles"), "name", "name2")
    filled = signed.filter("n_shingles > 0")
    grouped = filled.groupBy("name", "name2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared = _regions(docs, _heavy(counted), n, similarity, buckets).join(nodes.select("name", "node", "size"), "name").select("region", "node", "size")
    regions = written(_able(written(shared, "shared"), similarity), "regions")
    sets = written(_sets(docs, regions.select("node").distinct().join(nodes, "node"), n), "sets")
    # Nodes with too many shingles of their own have no link.
    own = written(_own(sets, buckets), "own")
    regions = regions.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter((F.col("size") - F.col("own")) * u >= F.col("size") * t)
    regions = written(regions, "regions")

    rated = F.struct((F.col("own") / F.col("size")).alias("share"), "node", "size")
    pivots = regions.groupBy("region").agg(F.min(rated).alias("pivot"))
    met = regions.join(pivots, "region").select(F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size"), "node", "size", "own")
    cells = met.groupBy("pivot", "node").agg(F.first("pivot_size").alias("pivot_size"), F.first("size").alias("size"), F.first("own").alias("own"), F.count("*").alias("votes"))
    cells = written(cells, "cells")
    roots = written(cells.select("node").distinct().withColumn("root", F.col("node")), "roots")
    best = cells.filter((F.col("pivot") != F.col("node")) & _alike(similarity, "pivot_size", "size")).groupBy("node").agg(F.max(F.struct("votes", "pivot")).alias("best"))
    tried = _measure(best.select(F.col("best.pivot").alias("pivot"), "node").select(*_ordered("pivot", "node")).distinct(), sets, "star")
    roots = _absorb(roots, tried.filter(_fits(similarity)))

    cells = cells.select(F.col("pivot").alias("cell"), "pivot", "node", "size", "own", "votes")
    level = 0
    while True:
        open_ = written(_open(cells, roots), "open")
        if not open_.limit(1).count():
            break
        missing = open_.filter("pivot != node").select(*_ordered("pivot", "node")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = _measure(missing, sets, "cells")
        tried = written(tried.unionByName(found), "tried")
        roots = _absorb(roots, found.filter(_fits(similarity)))
        members = open_.select("cell", "pivot", "node", "size", "own", "votes")
        open_ = written(_measured(_open(members, roots), tried), "open")
        few, many = open_.filter(F.col("members") <= SMALL), open_.filter(F.col("members") > SMALL)
        more = many.groupBy("node").agg(F.sum("votes").alias("more")) if level == 0 else None
        found = _measure(_within(few, similarity, tried, more), sets, "pairs")
        tried = written(tried.unionByName(found), "tried")
        roots = _absorb(roots, found.filter(_fits(similarity)))
        if not many.limit(1).count():
            break
        # Pivots of the large cells, measured against all their nodes.
        order = Window.partitionBy("cell").orderBy("rank", "node")
        ranked = many.filter("pivot != node").withColumn("rank", F.xxhash64(F.lit(level), "node"))
        chosen = ranked.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= PIVOTS).select("cell", F.col("node").alias("chosen"))
        chosen = written(chosen, "pivots")
        spread = written(many.join(chosen, "cell").select("cell", "members", "node", "size", "own", F.col("chosen").alias("pivot")), "spread")
        ends = spread.filter("pivot != node").select(*_ordered("pivot", "node")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = _measure(ends, sets, "spread")
        tried = written(tried.unionByName(found), "tried")
        roots = _absorb(roots, found.filter(_fits(similarity)))
        window = Window.partitionBy("cell", "node")
        reach = F.min("d").over(window) + 2 * float(1 - similarity) + 1e-9
        near = _measured(spread, tried).withColumn("reach", reach).filter("d <= reach")
        near = written(near.select("cell", "members", "node", "size", "own", "pivot"), "near")
        held = near.groupBy("cell", "pivot").agg(F.count("*").alias("held"))
        worst = held.groupBy("cell").agg(F.max("held").alias("worst"))
        divided = written(near.join(worst, "cell").filter(F.col("worst") <= 0.8 * F.col("members")), "divided")
        # Cells that the pivots do not divide are compared as they are.
        whole = many.drop("root", "members").join(divided.select("cell").distinct(), "cell", "left_anti")
        found = _measure(_within(_open(whole, roots), similarity, tried, None), sets, "whole")
        tried = written(tried.unionByName(found), "tried")
        roots = _absorb(roots, found.filter(_fits(similarity)))
        cells = written(divided.select(F.xxhash64("cell", "pivot").alias("cell"), "pivot", "node", "size", "own", F.lit(0).cast("long").alias("votes")), "cells")
        level += 1

    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(placed.join(least, "root").select("name", "name2", "component_id"), "members")
    out = signed.join(known, ["name", "name2"], "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def keep_one(docs: DataFrame, similarity: Fraction = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """One document of each component, the one with the least id, once; documents without words stay.

    Rows are told apart by id and text, so that an id may stand on several texts; of a component's rows with the
    least id, the least row hash stays. Rows without id stay too, for nothing tells them apart.
    """
    hashed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    linked = link_components(hashed.select(F.col("__row").alias("doc_id"), "text"), similarity, n).filter("n_shingles > 0")
    named = hashed.filter("doc_id is not null").select("__row", F.col("doc_id").cast("long").alias("id")).distinct()
    counted = linked.groupBy(F.col("doc_id").alias("__row"), "component_id").agg(F.count("*").alias("rows"))
    members = written(counted.join(named, "__row"), "linked")
    stays = members.groupBy("component_id").agg(F.min(F.struct("id", "__row")).alias("least")).select(F.col("least.__row").alias("__row"))
    stays = written(stays, "stays")
    gone = written(members.select("__row").join(stays, "__row", "left_anti"), "gone")
    again = written(members.filter("rows > 1").join(stays, "__row", "left_semi").select("__row"), "again")
    kept = hashed.join(small(gone), "__row", "left_anti")
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    # Repeated rows of a document that stays: one of them.
    few = small(again)
    one = kept.join(few, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
    return kept.join(few, "__row", "left_anti").select(*docs.columns).unionByName(one)
