"""Token alignment of two tokenizers.

A text is encoded by both, A (byte-level BPE) and B (pieces with byte fallback), as a blank and the text. Where a token of A and one
of B end at the same byte, a group of tokens ends. Every occurrence pair of an A and a B token in one group is a link; a pair of ids
counts the documents that hold it linked.

Most groups are one token of each with the same bytes. An array, made once from the vocabularies, maps an id of A to the id of B with its
bytes; links along it need A's id alone, so their documents are counted in vectors of the vocabulary's length, one a task, added
up to one. Only the other pairs of ids enter a shuffle. Their most frequent counts (``TOLD_PAIRS`` at most, a documented bound) are told
to the workers with the vectors; the links of all others are joined by pair and added up per document.

Vocabulary files are read once by the driver and told to the workers; their paths are parameters. Tokenizers are never trained.

Null and empty texts have no tokens, nor do those that either tokenizer does not give back byte by byte (one holding U+2581, say): all
counts are 0 and ``groups_sha256`` is ''. Special tokens' strings are plain text. Rows of equal or null ids are rows of their own, and
each counts as a document; an empty table gives no rows. Other columns do not matter. A task holds the distinct pairs of one text at a time.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import most_frequent, written

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: How the words of byte-level BPE are cut: a fixed value of that vocabulary.
WORDS_OF_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of pairs told to the workers, at most.
TOLD_PAIRS = 1_000_000
#: Links of one group that are written out pair by pair; of larger groups only distinct ids meet.
_GROUP_LINKS = 1 << 16
_SHIFT = 1 << 32
_LISTS = ("same", "same_n", "a", "b", "n")
STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ", ".join(f"{c} array<int>" for c in _LISTS)
RATED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and the identity map."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        letters = _byte_letters()
        found = json.loads(a_file)
        special = {t["id"] for t in found["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in found["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS_OF_A, mergeable_ranks=ranks, special_tokens={})
        self.long_a = tokenizers.Tokenizer.from_buffer(a_file)
        self.long_a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.size_a, self.size_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.bytes_a = {i: token for token, i in ranks.items()}
        self.bytes_b = [self._piece(i) for i in range(self.size_b)]
        self.length_a = np.zeros(self.size_a, np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        first: dict[bytes, int] = {}
        for i in sorted(range(self.size_b), key=lambda i: (self.b.is_byte(i), i)):  # pieces before single bytes
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                first.setdefault(self.bytes_b[i], i)
        self.identity = np.full(self.size_a, -1, np.int64)
        for i, token in self.bytes_a.items():
            self.identity[i] = first.get(token, -1)
        # Decimal ids with what follows them, for the groups' text: "," and "|" after A's, "," and ";" after B's.
        names = [f"{i}{end}" for end, size in ((",", self.size_a), ("|", self.size_a), (",", self.size_b), (";", self.size_b)) for i in range(size)]
        self.names = np.array(names, dtype="S").view(np.uint8).reshape(len(names), -1)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        whole = " " + text
        try:
            a = self.a.encode_to_numpy(whole, disallowed_special=())
        except ValueError:  # a run of blanks beyond its pattern's stack; the other library reads the same vocabulary, more slowly
            a = np.array(self.long_a.encode(whole, add_special_tokens=False).ids, np.int64)
        b = self.b.encode(text)
        data = whole.encode()
        if b"".join([self.bytes_b[i] for i in b]) != data or int(self.length_a[a].sum()) != len(data) or self.a.decode_bytes(a) != data:
            return None
        return a.astype(np.int64), np.array(b, np.int64)

    def align(self, text: str | None):
        """(n_a, n_b, groups, links, digest, ids of A linked by the map, their links, other pairs' A, B, links) of a text."""
        found = self.tokens(text)
        if found is None:
            none = np.empty(0, np.int64)
            return 0, 0, 0, 0, "", none, none, none, none, none
        a, b = found
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        stop_a, stop_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        start_a, start_b = np.concatenate(([0], stop_a[:-1])), np.concatenate(([0], stop_b[:-1]))
        n_a, n_b = stop_a - start_a, stop_b - start_b
        links = n_a * n_b
        regular = links == 1
        regular &= self.identity[a[start_a]] == b[start_b]
        keys, times = self._pairs(a, b, start_a, n_a, start_b, n_b, np.flatnonzero(~regular))
        left, right = keys // _SHIFT, keys % _SHIFT
        mapped = self.identity[left] == right
        same, where = np.unique(np.concatenate((a[start_a[regular]], left[mapped])), return_inverse=True)
        same_n = np.zeros(len(same), np.int64)
        np.add.at(same_n, where, np.concatenate((np.ones(int(regular.sum()), np.int64), times[mapped])))
        return len(a), len(b), len(ends), int(links.sum()), self._digest(a, b, stop_a, stop_b), same, same_n, left[~mapped], right[~mapped], times[~mapped]

    def _pairs(self, a, b, start_a, n_a, start_b, n_b, groups):
        """Distinct pairs of ids in these groups, as keys, and their links."""
        links = n_a[groups] * n_b[groups]
        keys, times = [], []
        for g in groups[links > _GROUP_LINKS]:
            x, n_x = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
            y, n_y = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
            keys.append((x[:, None] * _SHIFT + y).ravel())
            times.append((n_x[:, None] * n_y).ravel())
        few = links <= _GROUP_LINKS
        groups, links = groups[few], links[few]
        owner = np.repeat(groups, links)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(links) - links, links)
        keys.append(a[start_a[owner] + at // n_b[owner]] * _SHIFT + b[start_b[owner] + at % n_b[owner]])
        times.append(np.ones(len(owner), np.int64))
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate(times))
        return key, total

    def _digest(self, a, b, stop_a, stop_b) -> str:
        code_a, code_b = a.copy(), b + 2 * self.size_a
        code_a[stop_a - 1] += self.size_a
        code_b[stop_b - 1] += self.size_b
        # A group's tokens of A, then its tokens of B.
        place = np.concatenate((2 * np.searchsorted(stop_a, np.arange(len(a)), "right"), 2 * np.searchsorted(stop_b, np.arange(len(b)), "right") + 1))
        drawn = self.names[np.concatenate((code_a, code_b))[np.argsort(place, kind="stable")]].ravel()
        return hashlib.sha256(drawn[drawn != 0].tobytes()[:-1]).hexdigest()


_MADE: dict[bytes, Aligner] = {}


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    """One a worker process, however many tasks it runs."""
    key = b"".join(hashlib.sha256(f).digest() for f in files)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Aligner(*files)
    return _MADE[key]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int32)))


def token_groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Each document's tokens, groups and links; the links along the identity map and the others as lists."""
    files = docs.sparkSession.sparkContext.broadcast(tuple(_read(p) for p in (a_file, b_file)))  # two vocabulary files

    def run(batches):
        aligner = _aligner(files.value)
        for batch in batches:
            texts = batch.column("text")
            # A few texts at a time, whatever their length: their lists become rows before the next are read.
            for low in range(0, batch.num_rows, 256):
                found = [aligner.align(t.as_py()) for t in texts[low : low + 256]]
                columns = list(zip(*found))
                fixed = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low : low + 256], *fixed, *map(_lists, columns[5:])], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *_LISTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _vector(batches):
    """How many documents hold each id of A linked along the map, added up in one vector a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(batch.column("same").flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        found[: len(total)] += total
        total = found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["a", "n"])


def _dense(rows: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[rows["a"].to_numpy()] = rows["n"].to_numpy()
    return out


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, told_pairs: int = TOLD_PAIRS) -> DataFrame:
    """Per document: tokens, groups, links, links that are the most counted of their A id, and the sum of the links' counts."""
    spark = docs.sparkSession
    stored = written(token_groups(docs, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), "token-groups")
    vector = stored.select("same").mapInArrow(_vector, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    pairs = stored.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = written(pairs, "pairs")
    # Vectors over A's ids: the driver holds as many numbers as the vocabulary has tokens.
    along, beside = vector.toArrow(), pairs.groupBy("a").agg(F.max("n").alias("n")).toArrow()
    size = 1 + max([0, *(int(t["a"].to_numpy().max()) for t in (along, beside) if t.num_rows)])
    along, beside = _dense(along, size), _dense(beside, size)
    best = np.maximum(along, beside)
    known = most_frequent(pairs, "n", told_pairs)
    table = known.toArrow()  # at most told_pairs rows
    key = table["a"].to_numpy().astype(np.int64) * _SHIFT + table["b"].to_numpy()
    order = np.argsort(key)
    told = spark.sparkContext.broadcast((along, best, key[order], table["n"].to_numpy()[order]))
    whole = table.num_rows == pairs.count()

    def run(batches):
        along, best, key, count = told.value
        for batch in batches:
            yield _rated(batch, along, best, key, count)

    rated = stored.mapInArrow(run, RATED)
    if whole:
        return rated.drop("row", "a", "b", "n")
    rated = written(rated, "rated")
    rest = rated.select("row", F.inline(F.arrays_zip("a", "b", F.col("n").alias("times"))))
    top = spark.createDataFrame(pa.table({"a": pa.array(np.arange(size), pa.int32()), "best": pa.array(best)}))
    priced = rest.join(pairs.join(F.broadcast(top), "a"), ["a", "b"])  # a row an id of A
    sums = priced.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    joined = rated.join(sums, "row", "left").na.fill(0, ["more", "more_best"])
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more")).alias("count_sum"), "groups_sha256")


def _rated(batch: pa.RecordBatch, along, best, key, count) -> pa.RecordBatch:
    """Sums over the links whose counts are known here; the pairs of the others stay as lists."""
    rows = batch.num_rows
    column = lambda name: (batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(batch.column(name).offsets.to_numpy()))
    same, sizes = column("same")
    owner, times = np.repeat(np.arange(rows), sizes), column("same_n")[0]
    sums, tops = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    np.add.at(sums, owner, along[same] * times)
    np.add.at(tops, owner, (along[same] == best[same]) * times)
    a, sizes = column("a")
    b, n = column("b")[0], column("n")[0]
    owner, wanted = np.repeat(np.arange(rows), sizes), a * _SHIFT + b
    if len(key):
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        known = key[place] == wanted
        np.add.at(sums, owner[known], count[place[known]] * n[known])
        np.add.at(tops, owner[known], (count[place[known]] == best[a[known]]) * n[known])
    else:
        known = np.zeros(len(a), bool)
    left = np.bincount(owner[~known], minlength=rows)
    ends = pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[~known].astype(np.int32))) for x in (a, b, n)]
    named = {"row": batch.column("row"), **{c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(tops), "count_sum": pa.array(sums), "groups_sha256": batch.column("groups_sha256")}
    return pa.RecordBatch.from_arrays([*named.values(), *lists], names=[*named, "a", "b", "n"])
