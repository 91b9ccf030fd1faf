"""Language-model scoring with a gated recurrent network and a class-factored output.

Word counts are taken over all training rows. The most frequent words are the network's own, dealt to classes by
frequency; all others share one more class, within which a word has its smoothed share of the corpus counts, so the
model is a distribution over every word and one unseen word. P(word) = P(class | state) P(word | class, state).
How many words are the network's own follows the counts: those seen ``OWN_LEAST`` times, up to ``MOST_CLASSES`` squared.
The network (one gated layer, numpy) is trained by backpropagation truncated to windows, the state carried from
window to window. A sample of the training rows (``BUDGET`` characters, chosen by hash) gives the weights to begin
with; then all training rows are learned from, dealt by hash to rounds (``rounds_for`` the tokens): in a round every partition starts
from the same weights and goes over its rows, and the weights are averaged by tokens in a tree.

Scoring walks every text from its first word to its end token with the state carried along, many texts side by
side. Counts of frequent words (``KNOWN`` of them at most) are told to the workers; other words are joined with
the counts by a shuffle, summed per text.

Null and empty texts have one token, the end. Words are hashed to 64 bits, A-Z folded. Repeated rows score alike; rows
without id are training rows. Without any training row every probability is that of the untrained network.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import budget_sample, fold, most_frequent, word_hashes, written

CLASSES, PER_CLASS, HIDDEN, INPUT = 32, 32, 16, 16
OWN = CLASSES * PER_CLASS
#: Characters the network learns from, epochs, lanes and window of training; words told to the workers.
BUDGET, EPOCHS, LANES, WINDOW, RATE = 4_000_000, 2, 64, 32, 4e-3
#: Rounds over shards at least, tokens whose doublings add one each, the shards' lanes and rate, and shards averaged by one worker.
ROUNDS, ROUND_TOKENS, SHARD_LANES, SHARD_RATE, FAN = 2, 50_000_000, 256, 2e-3, 32
#: Occurrences that make a word the network's own beyond the first OWN, and classes (and words in each) at most.
OWN_LEAST, MOST_CLASSES = 200, 96
KNOWN = 200_000
SCORE_LANES, SCORE_WINDOW = 512, 128
#: Tokens whose softmax is taken at once.
BLOCK = 1024
_SLOTS = 22
END = np.uint64(0x5BD1E9955BD1E995)
LOG10 = math.log(10)


def _going(states: np.ndarray, real: np.ndarray | None, at: np.ndarray, weights: np.ndarray, calm: bool, back: tuple | None) -> np.ndarray:
    """Log of the softmax of ``states @ weights`` at one place a row, both being stacks: the states' last column is 1, the weights' last row the bias.

    ``real``: the rows that are no padding (none: all). Slopes by weights, bias and state are added to the arrays of ``back``.
    ``calm``: no exponential can overflow.
    """
    x = states @ weights
    if not calm:
        x -= x.max(axis=2, keepdims=True)
    real = np.arange(len(at)) if real is None else real
    place, flat = real * x.shape[2] + at, x.reshape(-1)
    logs = flat.take(place)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[2], x.dtype)
    sums = total.reshape(-1).take(real)
    logs -= np.log(sums)
    if back:
        by_weights, by_bias, by_state = back
        flat[place] -= sums
        share = np.zeros_like(total)
        share.reshape(-1)[real] = 1 / sums
        by_weights += (states[:, :, :-1] * share[:, :, None]).transpose(0, 2, 1) @ x
        by_bias += (share[:, None] @ x)[:, 0]
        slopes = x @ weights[:, :-1].transpose(0, 2, 1)
        slopes *= share[:, :, None]
        by_state += slopes.reshape(-1, slopes.shape[2]).take(real, axis=0)
    return logs


def _order(tokens: np.ndarray) -> np.ndarray:
    """The order by id; short numbers are sorted by their digits, which takes less time."""
    return np.argsort(tokens.astype(np.uint16) if tokens.max(initial=0) < 1 << 16 else tokens, kind="stable")


class Network:
    """Token ids below classes * per_class are words by falling frequency; that number is every other word. Class of a word: id // per_class."""

    def __init__(self, end: int, seed: int = 4, classes: int = CLASSES, per_class: int = PER_CLASS):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
        self.end, self.classes, self.per_class = end, classes, per_class
        self.w = {
            "E": normal(classes * per_class + 1, INPUT), "W": normal(INPUT, 3 * HIDDEN, scale=0.3), "b": np.zeros(3 * HIDDEN, np.float32), "U": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "A": normal(HIDDEN, classes + 1), "a": np.zeros(classes + 1, np.float32), "B": normal(classes, HIDDEN, per_class), "c": np.zeros((classes, per_class), np.float32),
        }

    def run(self, ids: np.ndarray, h: np.ndarray, keep: bool = False, given: tuple | None = None):
        """States before each token of ``ids`` (steps, lanes), the state after, and what going back needs.

        A state is a column here, so that each gate's values lie together. ``given``: what the gates are given by words, and the
        row of each token therein.
        """
        H, lanes = HIDDEN, ids.shape[1]
        words, rows = given or (self.given(), ids)
        turned = np.ascontiguousarray(self.w["U"].T)
        turned[: 2 * H] *= -1
        before = np.empty((*ids.shape, H), np.float32)
        h = np.ascontiguousarray(h.T, np.result_type(h, turned))
        trace = np.empty((len(ids) if keep else 1, 5 * H, lanes), h.dtype)
        ends = ids == self.end
        some = ends.any(axis=1)
        g = np.empty((3 * H, lanes), words.dtype)
        with np.errstate(over="ignore"):  # a gate of 1 / inf is 0
            for t, row in enumerate(rows):
                before[t] = h.T
                kept = trace[t if keep else 0]
                gates, n, u = kept[: 2 * H], kept[2 * H : 3 * H], kept[3 * H : 4 * H]
                if keep:
                    kept[4 * H :] = h
                g[...] = words.take(row, axis=0).T
                all_ = turned @ h
                u[...] = all_[2 * H :]
                np.add(g[: 2 * H], all_[: 2 * H], out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[H:], u, out=n)
                n += g[2 * H :]
                np.tanh(n, out=n)
                h = h - n
                h *= gates[:H]
                h += n
                if some[t]:
                    h[:, ends[t]] = 0
        return before, h.T, trace

    def given(self, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What the gates are given by each of the words; that of the first two with its sign turned, as ``run`` takes it."""
        out = self.w["E"][words] @ self.w["W"]
        out += self.w["b"]
        out[:, : 2 * HIDDEN] *= -1
        return out

    def log_probs(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None, by: np.ndarray | None = None):
        """Natural log of P(class), times P(word | class) for own words; with ``grads``, also the slope by state.

        Tokens are taken in the order of their ids (``by``), in blocks that stay in a core's cache. Classes with few tokens,
        which follow each other, share a block, each filled up to the largest of them.
        """
        w, H = self.w, states.shape[1]
        by = _order(tokens) if by is None else by
        tokens = tokens.take(by)
        group = tokens // self.per_class
        ordered = np.zeros((len(tokens) + 1, H + 1), states.dtype)  # the last one is padding
        states.take(by, axis=0, out=ordered[:-1, :H])
        ordered[:-1, H] = 1
        most = np.abs(states).max(initial=0)
        calm = max((np.abs(w[k]).sum(axis=-2) * most + np.abs(w[b])).max() for k, b in ("Aa", "Bc")) < 60
        logs, slope = np.empty(len(tokens), states.dtype), None
        if grads is not None:
            slope = np.zeros_like(states)
            grads.update({k: np.zeros_like(w[k]) for k in "AaBc"})

        def going(low, high, rows, real, at, weights, keys, index):
            part = slice(low, high)
            back = None if grads is None else (*(grads[k][index] for k in keys), slope[part])
            return _going(ordered[part][None] if rows is None else ordered.take(rows, axis=0), real, at[part], weights, calm, back)

        weights = np.concatenate([w["A"], w["a"][None]])[None]
        for low in range(0, len(tokens), BLOCK):
            high = min(low + BLOCK, len(tokens))
            logs[low:high] = going(low, high, None, None, group, weights, "Aa", None)
        weights = np.concatenate([w["B"], w["c"][:, None]], axis=1)
        at = tokens - group * self.per_class
        ends = np.searchsorted(group, np.arange(self.classes + 1))
        sizes, c = np.diff(ends), 0
        while c < self.classes:
            # As many classes as fit a block when each is as large as the largest of them.
            filled = np.maximum.accumulate(sizes[c : c + BLOCK]) * np.arange(1, len(sizes[c : c + BLOCK]) + 1)
            many = max(1, int(np.searchsorted(filled, BLOCK, side="right")))
            low, high = ends[c], ends[c + many]
            if many == 1:
                for a in range(low, high, BLOCK):
                    b = min(a + BLOCK, high)
                    logs[a:b] += going(a, b, None, None, at, weights[c : c + 1], "Bc", slice(c, c + 1))
            elif high > low:
                wide = np.arange(sizes[c : c + many].max())
                real = wide < sizes[c : c + many, None]
                rows = np.where(real, ends[c : c + many, None] + wide, len(tokens))
                logs[low:high] += going(low, high, rows, np.flatnonzero(real), at, weights[c : c + many], "Bc", slice(c, c + many))
            c += many
        out = np.empty_like(logs)
        out[by] = logs
        if slope is not None:
            turned, slope = slope, np.empty_like(slope)
            slope[by] = turned
        return out, slope

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Loss of a window, the state after it, and slopes by backpropagation through the window."""
        H, w = HIDDEN, self.w
        tokens = ids.reshape(-1)
        by = _order(tokens)
        starts = np.diff(tokens.take(by), prepend=-1) != 0
        first = np.flatnonzero(starts)
        words, place = tokens[by[first]], np.empty(len(tokens), np.int64)
        place[by] = np.cumsum(starts) - 1
        before, after, trace = self.run(ids, h, keep=True, given=(self.given(words), place.reshape(ids.shape)))
        grads: dict = {}
        logs, slope = self.log_probs(before.reshape(-1, H), tokens, grads, by)
        slope = np.ascontiguousarray(slope.reshape(before.shape).transpose(0, 2, 1))
        z, r, n, u, last = (trace[:, i * H : (i + 1) * H] for i in range(5))
        # Slopes of what goes into the gates by the state after the token; then, from the last token on, by the loss.
        over = (1 - z) * (1 - n * n)
        states, backs = np.empty((len(ids), 3, H, ids.shape[1]), trace.dtype), np.empty((len(ids), H, ids.shape[1]), trace.dtype)
        states[:, 0], states[:, 1], states[:, 2] = (last - n) * z * (1 - z), over * u * r * (1 - r), over * r
        back, ends = np.zeros(slope.shape[1:], trace.dtype), ids == self.end
        some = ends.any(axis=1)
        for t in range(len(ids) - 1, -1, -1):
            if some[t]:
                back[:, ends[t]] = 0
            backs[t] = back
            states[t] *= back
            back = back * z[t]
            back += w["U"] @ states[t].reshape(3 * H, -1)
            back += slope[t]
        flat = states.reshape(len(ids), 3 * H, -1).transpose(0, 2, 1).reshape(-1, 3 * H)
        grads["U"] = before.reshape(-1, H).T @ flat
        flat[:, 2 * H :] = (backs * over).transpose(0, 2, 1).reshape(-1, H)
        grads["W"], grads["b"] = w["E"].take(tokens, axis=0).T @ flat, np.ones(len(flat), flat.dtype) @ flat
        grads["E"] = np.zeros_like(w["E"])
        grads["E"][words] = np.add.reduceat((flat @ w["W"].T).take(by, axis=0), first, axis=0)
        for g in grads.values():
            g /= len(tokens)
        return -float(logs.sum()), after, grads

    def train(self, texts: list[np.ndarray], epochs: int = EPOCHS, lanes: int = LANES, window: int = WINDOW, rate: float = RATE, kept: dict | None = None) -> list[float]:
        """Loss per token of each epoch. Texts are token ids with their ends, run together in ``lanes`` streams.

        ``kept`` carries the slopes' running means from call to call."""
        if not texts:
            return []
        flat = np.concatenate(texts)
        lanes = max(1, min(lanes, len(flat) // window))
        steps = len(flat) // lanes
        ids = flat[: steps * lanes].reshape(lanes, steps).T
        windows = [ids[at : at + window] for at in range(0, steps, window)]
        # What does not fill the lanes goes last, in one lane.
        if steps * lanes < len(flat):
            windows.append(flat[steps * lanes :].reshape(-1, 1))
        kept = {} if kept is None else kept
        if not kept:
            kept.update(first={k: np.zeros_like(v) for k, v in self.w.items()}, second={k: np.zeros_like(v) for k, v in self.w.items()}, turn=0)
        first, second, turn = kept["first"], kept["second"], kept["turn"]
        losses = []
        for _ in range(epochs):
            h, total = np.zeros((lanes, HIDDEN), np.float32), 0.0
            for part in windows:
                loss, h, grads = self.step(part, h if part.shape[1] == len(h) else h[-1:])
                total += loss
                turn += 1
                speed, scale = rate / (1 + turn / 2000) / (1 - 0.9**turn), 1 / math.sqrt(1 - 0.999**turn)
                for k, g in grads.items():
                    np.clip(g, -1, 1, out=g)
                    first[k] *= 0.9
                    first[k] += 0.1 * g
                    np.square(g, out=g)
                    g *= 0.001
                    second[k] *= 0.999
                    second[k] += g
                    np.sqrt(second[k], out=g)
                    g *= scale
                    g += 1e-8
                    np.divide(first[k], g, out=g)
                    g *= speed
                    self.w[k] -= g
            losses.append(total / len(flat))
        kept["turn"] = turn
        return losses

    def flat(self) -> np.ndarray:
        """All weights in a row, by name."""
        return np.concatenate([self.w[k].reshape(-1) for k in sorted(self.w)]).astype(np.float64)

    def fill(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            size = self.w[k].size
            self.w[k] = flat[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size

    def score(self, texts: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
        """Natural log probability of each text's tokens, whole texts, state carried from window to window.

        Texts are dealt to lanes by length, the longest first. A window holds the lanes that still have tokens, so a text much
        longer than the others runs on alone, and memory follows the tokens and not the longest text.
        """
        out = np.zeros(len(texts))
        if not texts:
            return out
        lanes = min(lanes, len(texts))
        rows: list[list[int]] = [[] for _ in range(lanes)]
        open_ = [(0, lane) for lane in range(lanes)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            size, lane = heapq.heappop(open_)
            rows[lane].append(i)
            heapq.heappush(open_, (size + len(texts[i]), lane))
        rows.sort(key=lambda members: -sum(len(texts[i]) for i in members))
        streams = [np.concatenate([texts[i] for i in members]) for members in rows]
        owners = [np.repeat(np.array(members, np.int32), [len(texts[i]) for i in members]) for members in rows]
        full = np.array([len(s) for s in streams])
        h, given = np.zeros((lanes, HIDDEN), np.float32), self.given()
        for at in range(0, int(full[0]), window):
            running = int((full > at).sum())
            wide = min(window, int(full[0]) - at)
            ids, whose = np.full((running, wide), self.end, np.int32), np.full((running, wide), -1, np.int32)
            for lane in range(running):
                part = streams[lane][at : at + wide]
                ids[lane, : len(part)] = part
                whose[lane, : len(part)] = owners[lane][at : at + wide]
            before, h, _ = self.run(ids.T, h[:running], given=(given, ids.T))
            flat = whose.T.reshape(-1)
            some = flat >= 0
            logs, _ = self.log_probs(before.reshape(-1, HIDDEN)[some], ids.T.reshape(-1)[some])
            out += np.bincount(flat[some], weights=logs, minlength=len(texts))
        return out


class Lexicon:
    """Counts and ids of the told words, by hash: a direct table, and a binary search where two share a slot."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray, own: int = OWN):
        by = np.argsort(hashes)
        self.own = own
        self.hashes, self.counts, self.ids = hashes[by], counts[by], ids[by]
        self.table = np.zeros(1 << _SLOTS, np.int32)
        self.table[(self.hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)] = np.arange(len(by))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is told)."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.table[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)].astype(np.int64)
        hit = self.hashes[at] == h
        rest = np.flatnonzero(~hit)
        if len(rest):
            place = np.minimum(np.searchsorted(self.hashes, h[rest]), len(self.hashes) - 1)
            at[rest], hit[rest] = place, self.hashes[place] == h[rest]
        return at, hit


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _groups(texts: list[bytes], most: int = 1 << 23):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over whole texts, end tokens included."""

    def run(batches):
        for batch in batches:
            all_ = _bytes(batch)
            for low, high in _groups(all_):
                h = np.sort(np.concatenate((word_hashes(all_[low:high])[0], np.full(high - low, END))))
                begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(h[begin].view(np.int64)), pa.array(np.diff(np.concatenate((begin, [len(h)]))))], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _tokens(texts: list[bytes], lexicon: Lexicon):
    """For each text: hashes with the end token, and for all of them joined: places, told, network ids; and bounds."""
    h, bound = word_hashes(texts)
    ends = bound[1:]
    whole = np.insert(h, ends, END)
    bound = bound + np.arange(len(bound))
    place, told = lexicon.find(whole)
    ids = np.where(told, lexicon.ids[place] if len(lexicon.ids) else 0, lexicon.own).astype(np.int32)
    return whole, bound, place, told, ids


def fit(training: DataFrame, counts: DataFrame) -> tuple[Lexicon, Network, dict]:
    """Lexicon, trained network and corpus totals from training rows (doc_id, text) and their stored word counts."""
    spark = training.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    is_end = F.col("word") == int(np.array([END]).view(np.int64)[0])
    top = most_frequent(counts, "n", KNOWN, is_end).toPandas().sort_values(["n", "word"], ascending=[False, True])
    hashes, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    # The end is always one of the network's words.
    rank = np.arange(len(hashes))
    end = np.flatnonzero(hashes == END)
    end = int(end[0]) if len(end) else 0
    classes, per_class = sides(int((n >= OWN_LEAST).sum()))
    most = classes * per_class
    ids = np.where(rank < most, rank, most)
    if end >= most:
        ids[most - 1], ids[end] = most, most - 1
        end = most - 1
    lexicon = Lexicon(hashes, n, ids, most)
    own = int(n[ids < most].sum())
    totals = {"N": int(total["N"]), "V": int(total["V"]), "tail": int(total["N"]) - own, "tail_words": int(total["V"]) - int((ids < most).sum())}
    held = spark.sparkContext.broadcast(lexicon)  # KNOWN words at most

    def learn(batches):
        texts = [(x or "").encode() for pdf in batches for x in pdf["text"]]
        network = Network(end, classes=classes, per_class=per_class)
        if texts:
            order = np.random.default_rng(4).permutation(len(texts))
            texts = [texts[i] for i in order]
            _, bound, _, _, token = _tokens(texts, held.value)
            network.train([token[a:b] for a, b in zip(bound[:-1], bound[1:])])
        yield pd.DataFrame({"weights": [pickle.dumps(network)]})

    sample = budget_sample(training.filter("text is not null"), "text", ["doc_id", "text"], F.lit(0), BUDGET, 4)
    # One task, for the sample is bounded; ordered, so that reruns agree.
    rows = sample.select("doc_id", "text").repartition(1).sortWithinPartitions("doc_id", "text").mapInPandas(learn, "weights binary").collect()
    network = pickle.loads(rows[0]["weights"]) if rows else Network(end, classes=classes, per_class=per_class)
    rounds = rounds_for(totals["N"])
    for turn in range(rounds):
        network = _round(training.filter("text is not null"), turn, rounds, held, network)
    return lexicon, network, totals


def sides(often: int) -> tuple[int, int]:
    """Classes, and words in each, for so many words seen often; their cost follows the sum, so they are alike."""
    if often <= OWN:
        return CLASSES, OWN // CLASSES
    side = min(MOST_CLASSES, math.isqrt(often - 1) + 1)
    return side, side


def _mean(parts: pd.DataFrame) -> tuple[int, np.ndarray]:
    """Tokens and mean weights by tokens, added in the order of the shards."""
    parts = parts.sort_values("shard")
    tokens = parts["tokens"].to_numpy(np.int64)
    total = np.zeros(len(parts["weights"].iloc[0]) // 8)
    for n, weights in zip(tokens, parts["weights"]):
        total += n * np.frombuffer(weights, np.float64)
    return int(tokens.sum()), total / tokens.sum()


def _round(training: DataFrame, turn: int, rounds: int, lexicon, network: Network) -> Network:
    """The network after one of the rounds over its share of the training rows, each partition a shard."""
    held = training.sparkSession.sparkContext.broadcast(network)
    fields = ["shard", "tokens", "weights"]

    def learn(batches):
        import copy

        shard, tokens = TaskContext.get().partitionId(), 0
        mine, kept = copy.deepcopy(held.value), {}
        for batch in batches:
            all_ = _bytes(batch)
            for low, high in _groups(all_):
                _, bound, _, _, token = _tokens(all_[low:high], lexicon.value)
                tokens += len(token)
                mine.train([token], epochs=1, lanes=SHARD_LANES, rate=SHARD_RATE, kept=kept)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([tokens]), pa.array([mine.flat().tobytes()])], fields)

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        tokens, weights = _mean(parts)
        return pd.DataFrame({"shard": [int(parts["shard"].min()) // FAN], "tokens": [tokens], "weights": [weights.tobytes()]})

    rows = training.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(rounds)) == turn).select("text")
    schema = "shard long, tokens long, weights binary"
    means = written(rows.mapInArrow(learn, schema), "shards")
    # A tree: groups of shards are averaged until one row is left, the only one that comes to the driver.
    while means.limit(2).count() > 1:
        means = written(means.groupBy(F.floor(F.col("shard") / FAN)).applyInPandas(merged, schema), "shards")
    last = means.toPandas()
    if len(last):
        network.fill(_mean(last)[1])
    return network


def rounds_for(tokens: int) -> int:
    """Rounds over the training rows: one more for each doubling of the tokens."""
    return ROUNDS + int(math.log2(1 + tokens / ROUND_TOKENS))


def score(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, network: Network, totals: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((lexicon, network))
    fields = ["row", "doc_id", "n_tokens", "n_known", "told_logs", "tail_logs", "tail", "model", "word", "n"]

    def run(batches):
        lexicon, network = held.value
        logs = np.log10(lexicon.counts + 1.0)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            all_, names = _bytes(batch), batch.column("doc_id")
            for low, high in _groups(all_):
                whole, bound, place, told, ids = _tokens(all_[low:high], lexicon)
                begin, size = bound[:-1], np.diff(bound)
                sums = lambda x: np.add.reduceat(x, begin)
                worth = np.where(told, logs[place] if len(logs) else 0.0, 0.0)
                model = network.score([ids[a:b] for a, b in zip(bound[:-1], bound[1:])]) / LOG10
                rows = number + np.arange(high - low)
                number += high - low
                some = ids == lexicon.own
                columns = [rows, None, size, sums(told.astype(np.int64)), sums(worth), sums(np.where(some, worth, 0.0)), sums(some.astype(np.int64)), model]
                arrays = [names.slice(low, high - low) if c is None else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(high - low, pa.int64()), pa.nulls(high - low, pa.int64())], fields)
                other = np.flatnonzero(~told)
                if len(other):
                    owner = np.repeat(rows, size)[other]
                    by = np.lexsort((whole[other], owner))
                    owner, word = owner[by], whole[other][by]
                    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))))
                    n = np.diff(np.concatenate((new, [len(word)])))
                    empty = [pa.nulls(len(new), k) for k in (pa.int64(),) * 3 + (pa.float64(),) * 2 + (pa.int64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(owner[new]), *empty, pa.array(word[new].view(np.int64)), pa.array(n)], fields)

    schema = "row long, doc_id long, n_tokens long, n_known long, told_logs double, tail_logs double, tail long, model double, word long, n long"
    # Written at once, so that the row numbers of both kinds of rows come from the same run of a task.
    read = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "scored")
    asked = read.filter("word is not null").select("row", "word", F.col("n").alias("times"))
    met = asked.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    rows = read.filter("word is null").join(met, "row", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    whole = math.log10(totals["N"] + totals["V"] + 1)
    tail = math.log10(totals["tail"] + totals["tail_words"] + 1)
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        (F.col("told_logs") + logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model") + F.col("tail_logs") + logs - F.col("tail") * F.lit(tail)).alias("score"),
    )


def training_rows(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    return docs.filter(fold(F.col("doc_id"), folds) != held)


def is_held_out(doc_id, folds: int = 7, held: int = 2):
    return fold(doc_id, folds) == held
