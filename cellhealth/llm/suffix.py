"""Removal of bytes covered by long strings that also start elsewhere, by suffix arrays.

Which strings can repeat is found first. The anchor of a string of ``LENGTH`` bytes is its 32-byte gram with the
least hash (the last such); equal strings have equal anchors at equal offsets, and consecutive strings mostly
share one. A string reaches 84 bytes before its anchor, or 116 from it on, so it can only repeat where an anchor
stands at two places with the same bytes on one of these sides. All documents' anchors are compared; the strings
of those that remain are dealt to shards by anchor. An anchor with very many places is dealt by
its hash together with the bytes that all strings of one range of offsets have in common, so no group gathers them.

A shard sorts its suffixes by Larsson-Sadakane refinement (groups of equal prefixes, lengths doubling, sorted ones
left alone) and takes common prefixes by Kasai's recurrence, run over all surroundings side by side. Suffixes
with ``LENGTH`` bytes in common that start at different places are marked. Where a key's surroundings fill
several shards, each shard's sorted suffixes are looked up in the earlier ones by binary search.

Texts are UTF-8 bytes, null counts as empty. Texts that stand in several rows, repeated rows included, are removed
whole when they have ``LENGTH`` bytes, and take part once. Documents are told apart by row; null ids pass
through. Equal texts and anchors are recognised by 64 bits of a hash; bytes decide what is marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, written

LENGTH, GRAM = 200, 32
_REACH = LENGTH - GRAM
#: A string reaches _LEFT bytes before its anchor, or else _RIGHT from it on.
_LEFT = _REACH // 2
_RIGHT = LENGTH - _LEFT
_LOW = np.uint64(0xFFFFFFFF)
#: Places of an anchor beyond which it is dealt by more bytes; offsets in one range of those; bytes of a shard.
MANY, RANGE, SHARD = 2_000, 24, 1 << 20
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SIDES = np.random.default_rng(9).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20


def _eights(a: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on, as numbers; ``a`` ends in 8 spare bytes at least."""
    return np.ndarray((len(a) - 7,), kind, buffer=a, strides=(1,))


def _extreme(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over each window, by doubling."""
    step = 1
    while 2 * step <= width:
        x = of(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors, and the greatest and least offset in strings they are the anchor of."""
    found = []
    for at in range(0, len(data), _CHUNK):
        piece = data[at : at + _CHUNK + LENGTH - 1]  # the strings that begin in this chunk
        n = len(piece)
        if n < LENGTH:
            break
        u = _eights(np.frombuffer(piece + bytes(8), np.uint8))
        grams = n - GRAM + 1
        h = u[:grams] * _K[0]
        for j in range(1, GRAM // 8):
            h += (u[8 * j : 8 * j + grams] ^ (h >> np.uint64(31))) * _K[j]
        h = mix(h)
        # The low half turns the least into the last of the least.
        order = (h & ~_LOW) | (_LOW - np.arange(grams, dtype=np.uint64))
        place = (_LOW - (_extreme(order, _REACH + 1, np.minimum) & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        place = place[first]
        found.append((place + at, h[place], place - first, place - last))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def sides(data: bytes, place: np.ndarray, most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bytes from an anchor on and of those before, 0 where no string of the anchor reaches so far."""
    u = _eights(np.frombuffer(data + bytes(8), np.uint8))
    out = []
    for begin, size, reaches in ((0, _RIGHT, least < _LEFT), (-_LEFT, _LEFT + GRAM, most >= _LEFT)):
        steps = np.array([*range(0, size - 7, 8), size - 8])
        eights = u[(place[reaches] + begin)[:, None] + steps]
        side = np.zeros(len(place), np.uint32)
        side[reaches] = (mix(((eights ^ (eights >> np.uint64(29))) * _SIDES[: len(steps)]).sum(axis=1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        out.append(side)
    return tuple(out)


def _text_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


#: What an anchor is dealt with: its hash, its text, its place, its strings' offsets, and the two sides.
_KINDS = {"hashes": np.uint64, "keys": np.int64, "places": np.uint32, "most": np.uint8, "least": np.uint8, "right": np.uint32, "left": np.uint32}


def _read(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: documents (size, key and digest of their text), and anchors by bucket."""
    fields = ["bucket", "doc_id", "n_bytes", "key", "sha", *_KINDS]
    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def run(batches):
        seen = set()
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            digests = [hashlib.sha256(t).digest() for t in texts]
            keys = [_text_key(d) for d in digests]
            none = [pa.nulls(len(texts), pa.binary())] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys, pa.int64()), pa.array([d.hex() for d in digests]), *none], fields)
            found = []
            for t, key in zip(texts, keys):
                if len(t) >= LENGTH and key not in seen:
                    seen.add(key)
                    place, h, most, least = anchors(t)
                    found.append((h, np.full(len(h), key), place, most, least, *sides(t, place, most, least)))
            if not found:
                continue
            columns = [np.concatenate([f[i] for f in found]).astype(kind) for i, kind in enumerate(_KINDS.values())]
            by = np.argsort(columns[0])
            columns = [c[by] for c in columns]
            bucket, first = np.unique((columns[0] >> shift).astype(np.int64), return_index=True)
            spans = list(zip(first, [*first[1:], len(by)]))
            blobs = [pa.array([c[i:j].tobytes() for i, j in spans], pa.binary()) for c in columns]
            empty = [pa.nulls(len(spans), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *empty, *blobs], fields)

    blobs = ", ".join(f"{c} binary" for c in _KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"bucket long, doc_id long, n_bytes long, key long, sha string, {blobs}")


def _again(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows share hash and side (not 0) with another."""
    by = np.lexsort((side, h))
    same = (h[by][1:] == h[by][:-1]) & (side[by][1:] == side[by][:-1]) & (side[by][1:] != 0)
    out = np.zeros(len(h), bool)
    out[by[1:][same]] = out[by[:-1][same]] = True
    return out


def _shared(dealt: DataFrame) -> DataFrame:
    """key, place, most, least, anchor, many: the anchors some string of which may repeat."""

    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", *_KINDS))):
                kept.setdefault(bucket, []).append(blobs)
        while kept:
            parts = kept.popitem()[1]
            columns = [np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, kind in enumerate(_KINDS.values())]
            h, key, place, most = columns[:4]
            by = np.lexsort((most, place, key, h))
            new = np.concatenate(([True], np.any([c[by][1:] != c[by][:-1] for c in (h, key, place, most)], axis=0)))
            columns = [c[by][new] for c in columns]
            some = _again(columns[0], columns[5]) | _again(columns[0], columns[6])
            h, key, place, most, least = [c[some] for c in columns[:5]]
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            count = np.diff(np.concatenate((begin, [len(h)])))
            many = np.repeat(count, count) > MANY
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, place.astype(np.int64), most.astype(np.int32), least.astype(np.int32), h.view(np.int64), many)], ["key", "place", "most", "least", "anchor", "many"])

    return dealt.repartition("bucket").mapInArrow(run, "key long, place long, most int, least int, anchor long, many boolean")


def _surroundings(data: bytes, place: int, most: int, least: int, anchor: int, many: bool):
    """(key to deal by, begin, bytes) of the strings an anchor stands for."""
    if not many:
        yield anchor, place - most, data[place - most : place - least + LENGTH]
        return
    for first in range(0, _REACH + 1, RANGE):
        last = min(first + RANGE - 1, _REACH)
        far, near = min(last, most), max(first, least)
        if far < near:
            continue
        common = data[place - first : place + LENGTH - last]
        core = hashlib.blake2b(common, digest_size=8, key=anchor.to_bytes(8, "big", signed=True) + bytes([first])).digest()
        yield int.from_bytes(core, "big", signed=True), place - far, data[place - far : place - near + LENGTH]


_PIECES = "shard long, key long, begin long, bytes binary"


def _pieces(texts: DataFrame) -> DataFrame:
    """Surroundings by shard key. Equal ones in a batch are sent once, with a row without bytes for each span that is thereby marked."""

    def run(batches):
        for batch in batches:
            groups: dict[tuple, list] = {}
            for key, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "all"))):
                for x in found:
                    for shard, begin, data in _surroundings(text, x["place"], x["most"], x["least"], x["anchor"], x["many"]):
                        groups.setdefault((shard, data), []).append((key, begin))
            out = []
            for (shard, data), held in groups.items():
                held = sorted(set(held))
                out.append((shard, *held[0], data))
                if len(held) > 1:
                    out.extend((None, key, begin, len(data).to_bytes(4, "big")) for key, begin in held)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "key", "begin", "bytes"])

    return texts.mapInArrow(run, _PIECES)


# -- suffix arrays ------------------------------------------------------------------------------------


def suffix_order(a: np.ndarray) -> np.ndarray:
    """The suffixes in order. ``a`` ends in 8 spare bytes.

    Refinement by Larsson and Sadakane: within groups that agree on h bytes, the groups of the suffixes h bytes
    farther on decide, doubling h; groups of one are left alone.
    """
    n = len(a) - 8
    eight = _eights(a, ">u8")[:n].astype(np.uint64)
    order = np.argsort(eight)
    sorted_ = eight[order]
    head = np.concatenate((np.ones(min(1, n), bool), sorted_[1:] != sorted_[:-1]))
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    h = 8
    while True:
        single = head & np.concatenate((head[1:], np.ones(min(1, n), bool)))
        at = np.flatnonzero(~single)
        if not len(at):
            break
        some = order[at]
        key = rank[some] * (n + 2) + rank[np.minimum(some + h, n)] + 1
        by = np.argsort(key)
        key = key[by]
        order[at] = some[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[at] |= new
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    return order


def common_prefixes(a: np.ndarray, order: np.ndarray, begin: np.ndarray, walk: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes in common, ``depth`` at most, of each of the sorted suffixes with the one before.

    Kasai's recurrence: if the suffixes one byte farther on are sorted here too, at most one byte less is in
    common. ``order`` has the suffixes of the first ``walk`` places of each piece from ``begin`` on; pieces are
    walked from there, all at once.
    """
    n = len(a) - 8
    spare = np.concatenate((a, np.zeros(depth + 8, np.uint8)))
    eight, common = _eights(spare), np.zeros(len(order), np.int64)
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    by_walk = np.argsort(-walk, kind="stable")
    begin, walk = begin[by_walk], walk[by_walk]
    held = np.zeros(len(begin), np.int64)
    for step in range(int(walk.max(initial=0))):
        live = int(np.searchsorted(-walk, -step, "left"))  # pieces that go on
        i = begin[:live] + step
        at = place[i]
        j = np.where(at > 0, order[at - 1], n)
        got = np.where(at > 0, held[:live], 0)
        more = np.flatnonzero((at > 0) & (got < depth))
        while len(more):  # eight bytes at a time
            more = more[eight[i[more] + got[more]] == eight[j[more] + got[more]]]
            got[more] += 8
            more = more[got[more] < depth]
        rest = np.flatnonzero((at > 0) & (got < depth))
        while len(rest):
            rest = rest[spare[i[rest] + got[rest]] == spare[j[rest] + got[rest]]]
            got[rest] += 1
            rest = rest[got[rest] < depth]
        got = np.minimum(np.minimum(got, depth), n - np.maximum(i, j))  # a suffix ends with the buffer
        common[at] = got
        held[:live] = np.where(place[np.minimum(j + 1, n)] >= 0, np.maximum(got - 1, 0), 0)
    return common


def _words(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each place as rows of numbers that compare like the bytes."""
    return _eights(a, ">u8")[at[:, None] + np.arange(0, LENGTH, 8)].astype(np.uint64)


def search(a: np.ndarray, starts: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each string of ``b`` from ``asked``, the first of the sorted ``starts`` of ``a`` with that string, or -1."""
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(starts), np.int64)
    want = _words(b, asked)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        have, mine = _words(a, starts[middle]), want[open_]
        differ = have != mine
        first = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        less = have[rows, first] < mine[rows, first]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    hit = np.full(len(asked), -1, np.int64)
    inside = np.flatnonzero(low < len(starts))
    same = (_words(a, starts[low[inside]]) == want[inside]).all(axis=1)
    hit[inside[same]] = low[inside[same]]
    return hit


class Shard:
    """Pieces (text key, begin, bytes) sorted together."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.pieces = pieces
        self.size = np.array([len(p[2]) for p in pieces], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.a = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(8), np.uint8)
        order = suffix_order(self.a)
        n = len(order)
        piece = np.repeat(np.arange(len(pieces)), self.size)
        offset = np.arange(n) - self.begin[piece]
        whole = offset + LENGTH <= self.size[piece]
        names = {key: i for i, key in enumerate(dict.fromkeys(p[0] for p in pieces))}
        text = np.array([names[p[0]] for p in pieces], np.int64)[piece]
        where = np.array([p[1] for p in pieces], np.int64)[piece] + offset
        self.starts = order[whole[order]]
        common = common_prefixes(self.a, self.starts, self.begin, np.maximum(self.size - LENGTH + 1, 0))
        self.group = np.cumsum(common < LENGTH)
        self.marked = np.zeros(n, bool)
        if len(self.starts):
            self.head = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
            self.count = np.diff(np.concatenate((self.head, [len(self.starts)])))
            value = text[self.starts] * (1 << 40) + where[self.starts]
            several = np.minimum.reduceat(value, self.head) != np.maximum.reduceat(value, self.head)
            self.marked[self.starts] = np.repeat(several, self.count)
        self.piece, self.offset = piece, offset

    def meet(self, other: Shard) -> None:
        """Mark the strings that this shard and another have in common (they hold different places)."""
        if not len(self.starts) or not len(other.starts):
            return
        mine = self.starts[self.head]  # each string once
        hit = search(other.a, other.starts, self.a, mine)
        found = np.flatnonzero(hit >= 0)
        for shard, heads in ((self, found), (other, np.searchsorted(other.head, hit[found], "right") - 1)):
            both = np.zeros(len(shard.head), bool)
            both[heads] = True
            shard.marked[shard.starts[np.repeat(both, shard.count)]] = True

    def spans(self):
        """(text key, begin, end) of the marked runs of each piece."""
        at = np.flatnonzero(self.marked)
        if not len(at):
            return
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(self.piece[at]) != 0)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        for i, j in zip(at[first].tolist(), at[last].tolist()):
            key, begin, _ = self.pieces[self.piece[i]]
            yield key, begin + int(self.offset[i]), begin + int(self.offset[j]) + LENGTH


def _marked(held: list[tuple[int, int, int, bytes]]):
    """Spans of one shard key's pieces, or of several keys' together: (shard, key, begin, bytes) rows sorted by shard."""
    groups: dict[tuple, list] = {}
    for shard, key, begin, data in held:
        groups.setdefault((shard, data), []).append((key, begin))
    several: dict[int, list] = {}
    for (shard, data), where in groups.items():
        where = sorted(set(where))
        if len(where) > 1:
            for key, begin in where:
                yield key, begin, begin + len(data)
        several.setdefault(shard, []).append((*where[0], data))
    pieces = [x for rows in several.values() if len(rows) > 1 for x in rows]
    shards: list[Shard] = []
    at = 0
    while at < len(pieces):
        size, end = 0, at
        while end < len(pieces) and size < SHARD:
            size += len(pieces[end][2])
            end += 1
        shards.append(Shard(pieces[at:end]))
        at = end
    for i, shard in enumerate(shards):
        for other in shards[:i]:
            shard.meet(other)
    for shard in shards:
        yield from shard.spans()


def _spans(pieces: DataFrame) -> DataFrame:
    """key, begin, end: what is removed of each text."""

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "begin", "bytes"))):
                if held and row[0] != held[-1][0] and size >= SHARD:
                    out.extend(_marked(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "begin", "end"])
        out = list(_marked(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "begin", "end"])

    known = pieces.filter("shard is null").select("key", "begin", (F.col("begin") + F.conv(F.hex("bytes"), 16, 10).cast("long")).alias("end"))
    dealt = pieces.filter("shard is not null").repartition("shard").sortWithinPartitions("shard")
    return known.unionByName(dealt.mapInArrow(run, "key long, begin long, end long"))


def removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left)."""
    runs: list[list[int]] = []
    for low, high in sorted(spans):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
        else:
            runs.append([low, high])
    left, at = [], 0
    for low, high in runs:
        left.append(text[at:low])
        at = high
    left.append(text[at:])
    return sum(h - l for l, h in runs), len(runs), b"".join(left)


def repeated_spans(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables by text: documents (doc_id, n_bytes, key, sha), texts with shared anchors (key, text), spans (key, begin, end)."""
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = _read(docs, buckets)
    read = written(read, "read")
    rows = read.filter("bucket is null").select("doc_id", "n_bytes", "key", "sha")
    shared = _shared(read.filter("bucket is not null").select("bucket", *_KINDS))
    lists = written(shared.groupBy("key").agg(F.collect_list(F.struct("place", "most", "least", "anchor", "many")).alias("all")), "shared")
    # One document stands for each text.
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least")).withColumnRenamed("key", "of")
    wanted = written(lists.join(least, lists.key == least.of).select("key", "least", "all"), "wanted")
    digest = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16), 16, -10).cast("long")
    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).filter(digest == F.col("key"))
    texts = written(met.select("key", F.col("text").cast("binary").alias("text"), "all"), "texts")
    return rows, texts.select("key", "text"), written(_spans(written(_pieces(texts), "pieces")), "spans")


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows, texts, spans = repeated_spans(docs, buckets)

    def run(batches):
        for batch in batches:
            out = []
            for key, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans"))):
                n, runs, left = removed(text, [(s["begin"], s["end"]) for s in found])
                out.append((key, n, runs, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["of", "removed", "runs", "left"])

    grouped = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    cut = texts.join(grouped, "key").mapInArrow(run, "of long, removed long, runs long, left string").dropDuplicates(["of"])
    copies = rows.groupBy("key").agg(F.count("*").alias("copies")).withColumnRenamed("key", "named")
    made = written(copies.join(cut, copies.named == cut.of, "left").filter((F.col("copies") > 1) | F.col("of").isNotNull()).drop("of"), "cut")
    joined = rows.join(made, rows.key == made.named, "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, some, none: F.when(whole, all_).otherwise(F.coalesce(some, none))
    return joined.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("runs"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("left"), F.col("sha")).alias("kept_sha256"),
    )
