"""Language identification by prediction by partial matching.

Per language, byte counts after contexts of 0 to 3 bytes form a context tree. The probability of a byte
after a context is count / (total + distinct); with distinct / (total + distinct) the coder escapes to the
context one byte shorter, and from the empty one to the uniform code over 256 bytes (method C, no
exclusion, frozen counts). A text's code length in a language is exact under those counts, and the
language with the least code length wins.

The counts come from a bounded sample of labelled rows (``budget`` characters a language, chosen by hash);
scoring reads every byte of every text. All contexts of the sample are kept. A code length is a sum over the text's byte strings:
each order adds, for a context seen in a language, its escape, and, for a byte seen after it, what that byte's code differs by. The
strings of one and two bytes are rows of small full tables; the longer ones that occur lie, once, in hash tables that name the
languages that know them, so their memory follows the sample whatever the number of languages and byte values.

Null texts and texts without a letter give ``und`` with score 0; so does everything when nothing could be
learned. Languages with equal code lengths: the lesser name. Repeated rows score alike. Other columns of
the documents pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import budget_sample, fold

ORDER = 3
#: Characters a language learns from, at most.
BUDGET = 1_500_000
UNKNOWN = "und"
#: Bits a byte at which no model is better than none: such text is in no known language.
NO_MODEL_BITS = 8.0

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes scored together, and what a text is padded with, as after a line end.
_BLOCK = 1 << 18
_PAD = b"\n" * ORDER
_COUNTS = "lang string, gram long, n long"
_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


class Strings:
    """Byte strings, packed into numbers, and the entries (language, values) of each: a hash table with open addressing.

    The values are kept as entries or, where most languages know most strings, as a full row a string (``_FULL`` places an entry at most).
    """

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    _FULL = 4

    def __init__(self, many: int, keys: np.ndarray, langs: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.many, self.langs, self.values = many, langs[order], [v[order] for v in values]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)
        self.full: list[np.ndarray] | None = None
        if len(self.keys) * many <= self._FULL * len(keys):
            row = np.repeat(np.arange(len(self.keys)), np.diff(self.first))
            self.full = [np.zeros((len(self.keys) + 1, many), np.float32) for _ in values]  # the last row for strings not known
            for full, v in zip(self.full, self.values):
                full[row, self.langs] = v
            self.values = []
        self.bits = max(1, int(4 * len(self.keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rows, at = np.arange(len(self.keys), dtype=np.int32), self._place(self.keys)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of several, one gets the slot
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self._SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at, open_ = self._place(keys), np.arange(len(keys))
        while len(open_):
            row = self.slots[at]
            hit = (row >= 0) & (self.keys[row] == keys[open_])
            out[open_[hit]] = row[hit]
            on = (row >= 0) & ~hit
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, rows: np.ndarray, which: int, owner: np.ndarray, wide: np.ndarray, total: np.ndarray) -> None:
        """Add a value of every row to ``wide``, a row a position, or, from entries, to its owner's row of ``total``."""
        if self.full is not None:
            wide += self.full[which][rows]  # -1 is the last row
            return
        held = np.flatnonzero(rows >= 0)
        first = self.first[rows[held]]
        n = self.first[rows[held] + 1] - first
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = owner[np.repeat(held, n)] * self.many + self.langs[entry]
        total += np.bincount(place, self.values[which][entry], total.size).reshape(total.shape)


@dataclass
class ContextTree:
    """Bits of ``ORDER``-byte contexts in every language.

    ``single``: of a byte after a byte, and ``escape`` of a two-byte context (full tables, a row a pair of bytes); ``threes``: what a byte
    after two known bytes differs by, and the escape of three-byte contexts; ``fours``: what a byte after three known ones differs by.
    """

    languages: list[str]
    single: np.ndarray
    escape: np.ndarray
    threes: Strings
    fours: Strings

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of a text in each language."""
        return self.lengths_of([data])[0]

    def lengths_of(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language, a block of bytes at a time."""
        total = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), _BLOCK):
                piece = text[at : at + _BLOCK]
                held.append((i, text[at - ORDER : at] if at else _PAD, piece))
                size += len(piece)
                if size >= _BLOCK:
                    self._add(held, total)
                    held, size = [], 0
        self._add(held, total)
        return total

    def _add(self, pieces: list[tuple[int, bytes, bytes]], total: np.ndarray) -> None:
        if not pieces or not self.languages:
            return
        n_lang = len(self.languages)
        a = np.frombuffer(b"".join(x for _, before, piece in pieces for x in (before, piece)), np.uint8).astype(np.uint32)
        length = np.array([len(p) for *_, p in pieces])
        owner = np.repeat(np.arange(len(pieces)), length)
        at = np.arange(len(owner)) + ORDER * (owner + 1)  # where the texts' own bytes lie, between what stands before each
        gram = a[3:] | a[2:-1] << 8 | a[1:-2] << 16 | a[:-3] << 24
        four = gram[at - 3]
        wide = self.single[four & 0xFFFF] + self.escape[four >> 8 & 0xFFFF]
        bits = np.zeros((len(pieces), n_lang))
        # A three-byte string is a context where a byte follows, and itself a byte after two; both are looked up at once.
        three = self.threes.rows(a[2:] | a[1:-1] << 8 | a[:-2] << 16)
        for rows, table, which in ((three[at - 2], self.threes, 0), (three[at - 3], self.threes, 1), (self.fours.rows(four), self.fours, 0)):
            table.add(rows, which, owner, wide, bits)
        bits += np.add.reduceat(wide, np.cumsum(length) - length, axis=0, dtype=np.float64)
        np.add.at(total, [i for i, *_ in pieces], bits)


def _counted(batches):
    """How often each string of ``ORDER`` + 1 bytes occurs in a language, padded at the start; a string is packed into a number."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            seen = []
            for text in texts:
                a = np.frombuffer(_PAD + text.encode("utf-8", "replace"), np.uint8).astype(np.int64)
                seen.append(a[3:] | a[2:-1] << 8 | a[1:-2] << 16 | a[:-3] << 24)
            value, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": value, "n": n})


def fit(labelled: DataFrame, budget: int = BUDGET, seed: int = 8) -> ContextTree:
    """A context tree from rows with ``doc_id``, ``text`` and ``lang``; rows lacking a text or lang teach nothing."""
    known = labelled.filter("text is not null and lang is not null and text != ''").select("doc_id", "text", "lang")
    sample = budget_sample(known, "text", ["doc_id", "text"], F.col("lang"), budget, seed)
    counts = sample.select("lang", "text").mapInPandas(_counted, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # bounded by the sample: at most one row a sampled byte
    lang = table["lang"].combine_chunks().dictionary_encode()
    return build(lang.dictionary.to_pylist(), lang.indices.to_numpy(), table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy())


def _bits(gram: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one language: (strings of ``order`` + 1 bytes, bits of the last byte after the others, contexts, bits of their escapes)."""
    pair, where = np.unique(gram & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
    count = np.bincount(where, n, len(pair))
    context, place, kinds = np.unique(pair >> np.uint32(8), return_inverse=True, return_counts=True)
    whole = np.bincount(place, count, len(context)) + kinds
    return pair, np.log2(whole[place] / count), context, np.log2(whole / kinds)


def build(names: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> ContextTree:
    """The tables, one language after the other, from counted strings: memory in proportion to the strings."""
    order = sorted(range(len(names)), key=names.__getitem__)
    single, escape = (np.zeros((1 << 16, len(names)), np.float32) for _ in range(2))
    threes, fours = [], []
    for i, code in enumerate(order):
        own, times = gram[lang == code], n[lang == code]
        pair, bits, _, none = _bits(own, times, 0)
        after_none = np.full(256, none[0] + 8.0)
        after_none[pair] = bits
        pair, bits, context, missed = _bits(own, times, 1)
        after_one = np.tile(after_none, (256, 1))
        after_one[context] += missed[:, None]
        after_one.reshape(-1)[pair] = bits
        single[:, i] = after_one.reshape(-1)
        pair, after_two, context, missed = _bits(own, times, 2)
        escape[context, i] = missed
        less_two = after_two - missed[np.searchsorted(context, pair >> np.uint32(8))] - after_one.reshape(-1)[pair & np.uint32(0xFFFF)]
        four, after_three, long, missed = _bits(own, times, 3)
        lower = after_two[np.searchsorted(pair, four & np.uint32(0xFFFFFF))]
        less_three = after_three - missed[np.searchsorted(long, four >> np.uint32(8))] - lower
        every = np.union1d(pair, long)
        values = np.zeros((2, len(every)), np.float32)
        values[0, np.searchsorted(every, pair)] = less_two
        values[1, np.searchsorted(every, long)] = missed
        threes.append((every, np.full(len(every), i, np.uint16), *values))
        fours.append((four, np.full(len(four), i, np.uint16), less_three.astype(np.float32)))
    empty = (np.empty(0, np.uint32), np.empty(0, np.uint16), *[np.empty(0, np.float32)] * 2)
    joined = lambda parts, width: Strings(len(names), *[np.concatenate([empty[k], *[p[k] for p in parts]]) for k in range(width)])
    return ContextTree([names[c] for c in order], single, escape, joined(threes, 4), joined(fours, 3))


def predict_all(texts: list[str | None], tree: ContextTree) -> list[tuple[str, float, float | None]]:
    """(language, posterior under equal priors, bits a byte) of each text."""
    found: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
    asked = [i for i, t in enumerate(texts) if t is not None and tree.languages and _LETTER.search(t)]
    data = [texts[i].encode("utf-8", "replace") for i in asked]
    for i, d, bits in zip(asked, data, tree.lengths_of(data)):
        best = int(np.argmin(bits))
        share = float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())
        found[i] = tree.languages[best], share, float(bits[best] / len(d))
    return found


def predict(text: str | None, tree: ContextTree) -> tuple[str, float, float | None]:
    return predict_all([text], tree)[0]


def predictor(docs: DataFrame, tree: ContextTree):
    """A column function giving ``lang_pred``, ``score`` and ``bits_per_byte`` of a text."""
    held = docs.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def scored(batches):
        for texts in batches:
            yield pd.DataFrame(predict_all(list(texts), held.value), columns=["lang_pred", "score", "bits_per_byte"])

    from collections.abc import Iterator

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scored, _RESULT)


def identify(docs: DataFrame, tree: ContextTree, into: str = "__language") -> DataFrame:
    """``docs`` with a struct column of the prediction."""
    return docs.withColumn(into, predictor(docs, tree)(F.col("text")))


def training_rows(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    return docs.filter(fold(F.col("doc_id"), folds) != held)


def keep_known(docs: DataFrame, tree: ContextTree, most_bits: float = NO_MODEL_BITS) -> DataFrame:
    """Documents in a learned language: not ``und``, and coded in fewer bits a byte than without a model."""
    scored = identify(docs, tree)
    fits = (F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.bits_per_byte") < most_bits)
    return scored.filter(fits).drop("__language")


def is_held_out(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    return fold(doc_id, folds) == held
