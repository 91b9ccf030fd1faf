"""Chat formatting as prefix trees.

A conversation is the path of its turns. Conversations in order of their paths visit the tree depth-first: each
emits only the turns beyond what it shares with the one before, so shared turns are emitted once. The order is
made by range partitions; a partition is a pack, a sequence of its own, and shared turns are emitted once a pack.
A row of the output is a turn: its formatted text, where it stands in the pack, its position in the
conversation (its ancestors' lengths added up), the intervals of the pack that its tokens may attend to (its
ancestors', those that touch being one; and itself, causally), and the interval under the loss mask. Turns emitted one after
another touch, so a turn has one interval for each branching above it, not one for each ancestor. Tokens are code points.

Template: ``### Role: text </turn>`` and a line end. In texts and roles a backslash, ``#``, ``<``, and in roles a colon
or line end too, are written as a backslash and a letter, so control strings stand nowhere else; reading turns
them back.

Rows of a conversation are ordered by turn, then role, then text (null first); null texts and roles are empty
(a null role is kept apart in the template), repeated rows are repeated turns, rows without conv_id form one
conversation without id. Conversations with the same turns share one path. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_BACK = {v[1]: k for k, v in _CODES.items()}
_TEXT, _ROLE, _MARK = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)", re.S)
TURN_END = " </turn>\n"
#: In place of a role: none; before one that is not in lower case.
NO_ROLE, AS_IS = "\\0", "\\r"
LEARNED = "assistant"
PACK = """pack long, node long, start long, stop long, position long, ancestors array<struct<start:long,stop:long>>,
 loss_start long, loss_stop long, text string, path string"""

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.string()), ("keys", pa.list_(pa.string())), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
_PACK = pa.schema([*[(c, pa.int64()) for c in ("pack", "node", "start", "stop", "position")], ("ancestors", _SPAN), ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("text", pa.string()), ("path", pa.string())])
_FOUND = pa.schema([("path", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: _BACK.get(m[1], ""), text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(a formatted turn, begin and end of its text)."""
    if role is None:
        name = NO_ROLE
    elif role.capitalize().lower() == role:
        name = escape(role.capitalize(), True)
    else:
        name = AS_IS + escape(role, True)
    head = f"### {name}: "
    body = escape(text or "")
    return head + body + TURN_END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin and end of the escaped text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        assert formatted.startswith("### ", at), "not a formatted conversation"
        colon = formatted.index(": ", at)
        end = formatted.index(TURN_END, colon)
        name = formatted[at + 4 : colon]
        role = "" if name == NO_ROLE else unescape(name[2:]) if name.startswith(AS_IS) else unescape(name).lower()
        out.append((role, unescape(formatted[colon + 2 : end]), colon + 2, end))
        at = end + len(TURN_END)
    return out


def _paths(batches):
    """Each conversation's path: a running digest per turn, in order; rows come sorted within a task."""
    held, name, started = [], None, False

    def made():
        digest, keys = b"", []
        for role, text in held:
            content = b"%d:%s:%s" % (0 if role is None else 1, (role or "").encode() + b"\0", (text or "").encode())
            digest = hashlib.blake2b(digest + content, digest_size=16).digest()
            keys.append(digest.hex())
        return {"conv_id": name, "path": keys[-1], "keys": keys, "turns": [{"role": r, "text": t or ""} for r, t in held]}

    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if started and conv != name:
                out.append(made())
                held = []
            held.append((role, text))
            name, started = conv, True
        yield from _slices(out, _PATHS)
    if started:
        yield from _slices([made()], _PATHS)


def _slices(rows: list[dict], schema: pa.Schema):
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=schema)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, path, keys and turns of every conversation, from rows (conv_id, turn, role, text)."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    sorted_ = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return sorted_.mapInArrow(_paths, "conv_id long, path string, keys array<string>, turns array<struct<role:string,text:string>>")


class _Path:
    """The turns from the root to the present one, and the intervals they cover; cutting back undoes what was pushed."""

    def __init__(self):
        self.turns: list[tuple] = []  # each with its start and stop first
        self.spans: list[list[int]] = []
        self.length = 0

    def push(self, start: int, stop: int, *rest) -> None:
        if self.spans and self.spans[-1][1] == start:
            self.spans[-1][1] = stop
        else:
            self.spans.append([start, stop])
        self.turns.append((start, stop, *rest))
        self.length += stop - start

    def pop(self) -> None:
        start, stop, *_ = self.turns.pop()
        if self.spans[-1][0] == start:
            self.spans.pop()
        else:
            self.spans[-1][1] = start
        self.length -= stop - start


def _emit(batches):
    """Rows of one pack: depth-first, the turns a conversation does not share with the one before."""
    from pyspark import TaskContext

    pack, node, at, trail = TaskContext.get().partitionId(), 0, 0, _Path()
    for batch in batches:
        for name, keys, turns in zip(*(batch.column(c) for c in ("path", "keys", "turns"))):
            out, keys, turns = [], keys.as_py(), turns.as_py()
            same = 0
            while same < len(trail.turns) and same < len(keys) and trail.turns[same][2] == keys[same]:
                same += 1
            if same == len(keys):  # the same path again
                continue
            while len(trail.turns) > same:
                trail.pop()
            for i in range(same, len(keys)):
                text, low, high = render(turns[i]["role"], turns[i]["text"])
                learned = turns[i]["role"] == LEARNED
                spans = [{"start": a, "stop": b} for a, b in trail.spans]
                loss = {"loss_start": at + low if learned else None, "loss_stop": at + high if learned else None}
                ends = name.as_py() if i + 1 == len(keys) else None
                out.append({"pack": pack, "node": node, "start": at, "stop": at + len(text), "position": trail.length, "ancestors": spans, **loss, "text": text, "path": ends})
                trail.push(at, at + len(text), keys[i])
                node, at = node + 1, at + len(text)
            yield from _slices(out, _PACK)


def prefix_trees(paths: DataFrame) -> DataFrame:
    """The packed output of ``conversations`` rows, each distinct path once."""
    # Conversations with the same turns are one path; the rest is spread by ranges of paths.
    single = paths.groupBy("path").agg(F.first("keys").alias("keys"), F.first("turns").alias("turns"))
    return single.repartitionByRange("keys").sortWithinPartitions("keys").mapInArrow(_emit, PACK)


def _read(batches):
    """Each path's conversation from a pack's rows in order: the turns so far, cut back to where the row's position says."""
    trail, at = _Path(), None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["pack"] != at:
                trail, at = _Path(), row["pack"]
            while trail.length > row["position"]:
                trail.pop()
            assert trail.length == row["position"] and len(trail.spans) == len(row["ancestors"])
            assert not trail.spans or trail.spans[-1] == [row["ancestors"][-1]["start"], row["ancestors"][-1]["stop"]]
            trail.push(row["start"], row["stop"], row["text"], row["loss_start"], row["loss_stop"])
            if row["path"] is None:
                continue
            formatted = "".join(t[2] for t in trail.turns)
            turns = parse(formatted)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode())
            loss = "".join(unescape(text[low - start : high - start]) for start, _, text, low, high in trail.turns if low is not None)
            digests = {"turns_sha256": whole.hexdigest(), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest()}
            out.append({"path": row["path"], "n_turns": len(turns), "loss_chars": len(loss), "formatted_chars": len(formatted), **digests})
        yield from _slices(out, _FOUND)


def read_back(packs: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, what its formatted form says; ``members`` has conv_id and path."""
    rows = packs.repartition("pack").sortWithinPartitions("pack", "node")
    found = rows.mapInArrow(_read, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.select("conv_id", "path").join(found, "path").drop("path")


def format_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packs, members): the stored output, and which conversation has which path."""
    paths = written(conversations(rows), "paths")
    return written(prefix_trees(paths), "packs"), paths.select("conv_id", "path")
