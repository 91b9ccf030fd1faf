"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared in lower case and each run of white space as one blank. An item of m
characters may differ from a passage by k = floor(m * rate) edits. Cut into k + 1 pieces, at least one
piece must then stand in the passage unchanged; piece hits are found by an automaton over all pieces, and
around each hit the least edit distance between the whole item and any substring is taken by Myers'
bit-parallel recurrence. Overlapping surroundings of one item are verified together, so the work on a
document is bounded by its length times the items that hit it.

Every document is read whole and once for each block of items; items are a query set, told to the workers
in blocks of at most ``BLOCK_CHARS`` characters, however many there are.

Null or empty texts match nothing, nor do null or empty items. Items shorter than ``MIN_CHARS`` after
folding must match as they are (k = 0) and as whole words; of fewer than ``MIN_WORDS`` words they are reported but are no reason to
drop a document. Repeated items and rows give repeated results; null ids pass through, large ones exactly.
The automaton is that of the package pyahocorasick.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

RATE = 0.05
MIN_CHARS = 40
MIN_WORDS = 3
BLOCK_CHARS = 4_000_000
RESULT = "doc_id long, item_id long, distance int, start int, end int"
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def folded(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().split()).decode()


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate + 1e-9) if len(item) >= MIN_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of almost equal length, with their offsets."""
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:]) if b > a]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(least distance of the item to any substring of the text, end of the first such), if at most ``most``.

    Vertical differences of a column of the distance matrix are bits of two integers, updated in a few word
    operations a character.
    """
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = most + 1, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diag | plus) & full, plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~((eq | minus) | up) & full, up & (eq | minus)
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def _whole_words(text: str, low: int, high: int) -> bool:
    """Whether [low, high) of the text neither begins nor ends inside a word."""
    return not (low and text[low - 1].isalnum() and text[low].isalnum() or high < len(text) and text[high - 1].isalnum() and text[high].isalnum())


def _start(item: str, text: str, end: int, distance: int) -> int:
    """The latest start of a substring ending at ``end`` with that distance: the mirrored search, anchored."""
    back, mirrored = (np.frombuffer(x[::-1].encode("utf-32-le"), np.uint32) for x in (text[max(0, end - len(item) - distance) : end], item))
    row = span = np.arange(len(mirrored) + 1)
    for j, c in enumerate(back, 1):
        new = np.empty_like(row)
        new[0] = j
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (mirrored != c))
        row = np.minimum.accumulate(new - span) + span
        if row[-1] == distance:
            return end - j
    return end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items, self.most = items, [budget(t, rate) for _, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(items):
            for at, piece in pieces(item, self.most[i]):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None):
        """(item id, distance, start, end) of each item's best match in the folded text."""
        if self.empty or not text:
            return
        plain = folded(text)
        spans: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(plain):
            for i, at in where:
                k, size = self.most[i], len(self.items[i][1])
                if size < MIN_CHARS and not _whole_words(plain, last + 1 - size, last + 1):
                    continue
                low = max(0, last + 1 - length - at - k)
                high = min(len(plain), last + 1 - length - at + size + k)
                found = spans.setdefault(i, [])
                if found and low <= found[-1][1]:  # hits come from left to right
                    found[-1][0], found[-1][1] = min(low, found[-1][0]), max(high, found[-1][1])
                else:
                    found.append([low, high])
        for i, found in spans.items():
            name, item = self.items[i]
            best = None
            for low, high in found:
                hit = myers(item, plain[low:high], self.most[i])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                yield name, best[0], _start(item, plain, best[1], best[0]), best[1]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, start, end``: each document's best match of each item it contains, places
    in the folded text. ``docs`` has doc_id and text, ``items`` item_id and text."""
    spark = docs.sparkSession
    asked = items.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.col("item_id").cast("long"), "text")
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast([(i, t) for i, t in zip(mine["item_id"].to_pylist(), map(folded, mine["text"].to_pylist())) if t])

        def run(batches, held=held):
            matcher = Matcher(held.value, rate)
            for batch in batches:
                hits = [(d.as_py(), *hit) for d, t in zip(batch.column("doc_id"), batch.column("text")) for hit in matcher.find(t.as_py())]
                columns = list(zip(*hits)) or [()] * len(_RESULT)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """Documents that contain no item of ``MIN_WORDS`` words or more; rows of equal id and text fare alike."""
    telling = items.filter(F.regexp_count("text", F.lit(WORD)) >= MIN_WORDS)
    hashed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    # Found by row hash, so that null ids work too.
    leaks = matches(hashed.select(F.col("__row").alias("doc_id"), "text"), telling, rate)
    leaks = written(leaks.select(F.col("doc_id").alias("__row")).distinct(), "leaks")
    return hashed.join(leaks, "__row", "left_anti").select(*docs.columns)
