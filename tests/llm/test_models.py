"""Operators that learn or draw, formatting, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import threading
import tracemalloc
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from fixtures import make, prose, rows  # noqa: F401
from oracle_check import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from cellhealth.llm import chat, common, langid, mixing, oracle, pii, queries, rnnlm


def test_words_are_hashed_alike():
    texts = ["", " \n", "One two\tTHREE", "x" * 30 + " y", "ünï " + "long" * 50, "a b a"]
    h, bound = common.word_hashes([t.encode() for t in texts])
    names = {}
    for t, low, high in zip(texts, bound[:-1], bound[1:]):
        w = brute.words(t)
        assert len(w) == high - low
        for word, x in zip(w, h[low:high]):
            assert names.setdefault(word, x) == x
    assert len(set(names.values())) == len(names)


def test_shingle_sets_by_size():
    texts = [prose(random.Random(i), i) for i in range(12)]
    assert [len(s) for s in common.shingle_sets([t.encode() for t in texts])] == [len(brute.shingles(t)) for t in texts]


# -- personal data ------------------------------------------------------------------------------------

SAMPLES = [
    "a@b@c.d a@b.c_d@e.f x.y@z-1.co.uk", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 10.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 5 " + "4" * 1500,
    "+1 (555) 555-5254 call 555-123-4567 phone: (415) 555-2671", "mail bob (at) example (dot) com now", None, "", "é😀 +49 30 123456789 😀 a@b.de",
    "+1 + 2 " * 50, "a" * 1500 + "@" + "b.c" * 3, "a@b.c " * 400,
]


def test_base_spans(make):
    numbered = list(enumerate(SAMPLES)) + [(0, SAMPLES[0]), (None, SAMPLES[3])]
    got = pii.find(make(numbered).withColumn("found", F.lit(1))).withColumn("base", pii.joined(F.filter("spans", lambda s: s["base"]))).collect()
    texts = dict(numbered)
    assert Counter((r.doc_id, r.base) for r in got) == Counter((d, brute.spans_text(brute.base_spans(t))) for d, t in numbered)
    for r in got:
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(texts[r.doc_id])
    extra = {texts[r.doc_id][s.start : s.end] for r in got for s in r.spans if not s.base}
    assert "bob (at) example (dot) com" in extra


def dense(rng, n):
    """Texts of n matches and more: numbers alone, and all kinds with strict and weak forms side by side."""
    numbers = "".join(f"{rng.randrange(1000)}{rng.choice((', ', ' x ', chr(10)))}" for _ in range(n))
    forms = ("a.b@c.de", "bob (at) c.org", "1.2.3.4", "4111 1111 1111 1111", "+49 30 123456789", "+1 415-555-2671", "415-555-2671", "(415) 555-2671", "17", "é😀", "card", "call ", "mail", "order no")
    return [numbers, "".join(rng.choice(forms) + rng.choice((" ", ", ", ",", " and a longer way to the next of them, ")) for _ in range(n))]


@pytest.mark.parametrize("block", [2, 32])
def test_many_matches_in_a_text(spark, make, monkeypatch, block):
    monkeypatch.setattr(pii, "_BLOCK", block)
    texts = dict(enumerate(dense(random.Random(4), 700) + dense(random.Random(5), 33)))
    docs = make(list(texts.items()))
    # Without the sums of sums this takes hours, so it is ended.
    late = threading.Timer(180, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        judged = {r.doc_id: r.found for r in pii.candidates(docs).collect()}
        found = {r.doc_id: r.spans for r in pii.find(docs, accept=0.0).collect()}
    finally:
        late.cancel()
    for d, text in texts.items():
        base = [(s.start, s.kind, s.end) for s in judged[d] if s.base]
        assert sorted(base) == [s[:3] for s in brute.base_spans(text)]
        weak = [(s.start, s.kind, s.end) for s in judged[d] if not s.base]
        assert all(re.fullmatch(pii.WEAK[pii.KINDS[k]].replace(r"\G|", ""), text[a:b]) for a, k, b in weak)
        for s in judged[d]:
            cue = lambda words: re.search(rf"(?i)\b(?:{words})", text[max(0, s.start - pii.CONTEXT) : s.start], re.ASCII)  # noqa: B023, E731
            assert s.v2 == (1 if cue(pii.CUES[pii.KINDS[s.kind]]) else -1 if cue(pii.AGAINST) else 0)
        apart = [w for w in weak if not any(w[1] == b[1] and w[0] < b[2] and b[0] < w[2] for b in base)]
        assert [(s.start, s.kind, s.end) for s in found[d]] == sorted(base + apart)
    assert len(texts[0]) > 3000 and any(not s.base for s in found[1]) and len(found[1]) < len(judged[1])


def test_reliabilities_find_the_better_labeler():
    rng = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        vote = lambda right: (1 if y else -1) if rng.random() < right else (-1 if y else 1)
        counts[vote(0.95), vote(0.9), vote(0.6), 0] += 1
    rows = [dict(zip(pii.FEATURES, (0, *k, 0, 0))) | {"n": n} for k, n in counts.items()]
    posterior, found = pii.reliabilities(rows)
    right = [found["rate"][0, j, True, 1] for j in range(3)]
    assert right[0] > right[2] and right[1] > right[2] and abs(right[0] - 0.95) < 0.05
    weights = pii.train(rows, posterior)
    score = lambda r: sum(weights.get(f, 0) for f in pii._inputs(r))
    assert all((score(r) > 0) == (posterior[0, r["v0"], r["v1"], r["v2"], r["v3"]] > 0.5) for r in rows if r["v0"] == r["v1"])


# -- mixing -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(queries.queries()[name](spark, MEDIUM), connect(MEDIUM), oracle.oracle_sql()[name]) is None


def shares(sizes, weights=(5, 2, 1), ceiling=3):
    """Targets by resharing, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(ceiling * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > ceiling * sizes[s]}
        if not over:
            return {s: ceiling * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def test_targets_against_resharing(spark):
    rng = random.Random(4)
    for trial in range(6):
        sizes = {s: rng.choice((0, 1, 5, 40, 1000, 9000)) for s in rng.sample(["a", "b", "B", "ä", "z", "", None], rng.randrange(1, 7))}
        found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        expected = shares(sizes)
        assert all(math.isclose(r.target, expected[r.source], abs_tol=1e-6) for r in found) and len(found) == len(sizes), sizes


def test_mix_copies(make, rows):
    docs = make(rows).withColumn("size", F.lit("clash"))
    plan = mixing.mix_plan(make(rows)).collect()
    assert all(r.size * r.copies <= 3 * r.size and abs(r.copies - (r.target / r.source_size if r.source_size else 0)) < 1 for r in plan)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy"] and out.count() == sum(r.copies for r in plan)
    assert Counter(map(str, out.collect())) == Counter(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(make([])).count() == 0


# -- languages ----------------------------------------------------------------------------------------


def plain_bits(counts, data):
    """Code length by the recurrence itself; counts: (context bytes) -> Counter of bytes."""
    total = 0.0
    padded = b"\n" * langid.ORDER + data
    for i in range(len(data)):
        p, symbol = 1 / 256, padded[i + langid.ORDER]
        for k in range(langid.ORDER + 1):
            seen = counts.get(padded[i + langid.ORDER - k : i + langid.ORDER])
            if seen:
                n, kinds = sum(seen.values()), len(seen)
                p = seen[symbol] / (n + kinds) if seen[symbol] else kinds / (n + kinds) * p
        total -= math.log2(p)
    return total


def test_code_lengths_are_exact(make):
    said = {"en": ["the cat sat", "on the mat"], "de": ["der hund läuft", None, ""]}
    docs = make([(i, t) for i, t in enumerate([t for ts in said.values() for t in ts])]).drop("lang")
    labels = docs.sparkSession.createDataFrame([(t, lang) for lang, ts in said.items() for t in ts if t], "text string, lang string")
    tree = langid.fit(docs.join(labels, "text", "left"))
    assert tree.languages == ["de", "en"]
    for text in ("the dog", "läuft der", "zzz", "\n\n", "é😀"):
        for lang, bits in zip(tree.languages, tree.code_lengths(text.encode())):
            counts = defaultdict(Counter)
            for t in said[lang]:
                padded = b"\n" * langid.ORDER + (t or "").encode()
                for i in range(langid.ORDER, len(padded)):
                    for k in range(langid.ORDER + 1):
                        counts[padded[i - k : i]][padded[i]] += 1
            assert math.isclose(bits, plain_bits(counts, text.encode()), rel_tol=1e-5)
    long = "the cat " * 60_000
    assert math.isclose(tree.code_lengths(long.encode())[1], sum(tree.code_lengths(long[:8].encode())[1:]) + 59_999 * (tree.code_lengths(long[:16].encode())[1] - tree.code_lengths(long[:8].encode())[1]), rel_tol=1e-3)
    assert langid.predict(None, tree) == ("und", 0.0, None) and langid.predict("123 !", tree)[0] == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = queries.queries()["op8_language"](spark, MEDIUM).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_long_texts_do_not_end_a_sample(make):
    rng = random.Random(9)
    short = [prose(rng, 8, 9000) for _ in range(400)]
    for seed in range(3):
        docs = make(list(enumerate([*short, *["long " * 4000 + str(i) for i in range(3)]])) + [(0, short[0])] * 500)
        got = [r.text for r in common.budget_sample(docs, "text", ["doc_id", "text"], F.lit(0), 10_000, seed).collect()]
        assert 9_900 <= sum(map(len, got)) <= 10_000 and max(map(len, got)) <= 100
    whole = make(list(enumerate(short[:20])))
    assert sorted(r.text for r in common.budget_sample(whole, "text", ["doc_id", "text"], F.lit(0), 1_000_000, 1).collect()) == sorted(short[:20])


def test_tables_follow_the_sample():
    """Many languages and byte values: memory in proportion to the strings of the sample, every context kept."""
    import tracemalloc

    rng, many = np.random.default_rng(3), 30
    grams = [np.unique(rng.integers(0, 200, (30_000, 4)).astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)) for _ in range(many)]
    lang = np.repeat(np.arange(many), [len(g) for g in grams])
    tracemalloc.start()
    tree = langid.build([f"l{i:02d}" for i in range(many)], lang, np.concatenate(grams), np.ones(len(lang), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and len(tree.fours.langs) == len(lang)
    for i in (0, 17):
        counts = defaultdict(Counter)
        for g in grams[i].tolist():
            text = g.to_bytes(4, "big")
            for k in range(4):
                counts[text[3 - k : 3]][text[3]] += 1
        data = b"".join(g.to_bytes(4, "big") for g in grams[i][:40].tolist()) + bytes(range(190, 256))
        assert math.isclose(tree.code_lengths(data)[i], plain_bits(counts, data), rel_tol=1e-5)


def test_lengths_do_not_depend_on_blocks(make, monkeypatch):
    tree = langid.fit(make([(i, prose(random.Random(i), 50)) for i in range(12)]))
    texts = [prose(random.Random(i), 3 * i).encode() for i in range(40)] + [b"", b"x"]
    whole = tree.lengths_of(texts)
    assert tree.fours.full is not None
    monkeypatch.setattr(langid.Strings, "_FULL", 0)
    sparse = langid.fit(make([(i, prose(random.Random(i), 50)) for i in range(12)]))
    assert sparse.fours.full is None and np.allclose(sparse.lengths_of(texts), whole)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert np.allclose(tree.lengths_of(texts), whole) and np.allclose([tree.code_lengths(t) for t in texts], whole)


def test_unlearned_languages(make):
    tree = langid.fit(make([]))
    assert tree.languages == [] and langid.predict("text", tree)[0] == "und"
    assert langid.keep_known(make([(1, "text")]), tree).count() == 0


# -- language model -----------------------------------------------------------------------------------


def test_slopes():
    net = rnnlm.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    ids, h = rng.integers(0, rnnlm.OWN + 1, (5, 4)), rng.normal(0, 0.3, (4, rnnlm.HIDDEN))
    ids[2, 1] = 3

    def loss():
        return -net.log_probs(net.run(ids, h.copy())[0].reshape(-1, rnnlm.HIDDEN).astype(np.float64), ids.reshape(-1))[0].sum()

    grads = net.step(ids, h.copy())[2]
    for k, at in {"U": (3, 7), "A": (2, 5), "a": (4,), "b": (9,), "c": (ids[0, 0] // rnnlm.PER_CLASS, 1), "E": (ids[0, 0], 1)}.items():
        held = net.w[k][at]
        net.w[k][at] = held + 1e-4
        up = loss()
        net.w[k][at] = held - 1e-4
        down = loss()
        net.w[k][at] = held
        assert math.isclose((up - down) / 2e-4, grads[k][at] * ids.size, rel_tol=2e-2, abs_tol=1e-4), k


def test_state_is_carried_and_scores_do_not_depend_on_company():
    net = rnnlm.Network(0)
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(1, rnnlm.OWN + 1, n), 0).astype(np.int32) for n in (0, 1, 5, 300, 40)]
    together = net.score(texts, lanes=2, window=7)
    assert np.allclose(together, [net.score([t], window=1000)[0] for t in texts], rtol=1e-4)


@pytest.mark.parametrize("known", [200_000, 30])
def test_language_model(make, rows, monkeypatch, known):
    monkeypatch.setattr(rnnlm, "KNOWN", known)
    monkeypatch.setattr(rnnlm, "EPOCHS", 1)
    if known == 30:
        monkeypatch.setattr(rnnlm, "OWN", 1024)
    monkeypatch.setattr(queries, "load", lambda *a: make(rows))
    got = queries.op4_language_model(None, "").collect()
    fold = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 7
    counts = Counter(w for d, t in rows if fold(d) != 2 for w in [*brute.words(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t in rows:
        w = [*brute.words(t), None]
        expected[d, fold(d) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 3)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_every_training_row_teaches(make, monkeypatch):
    rng = random.Random(3)
    docs = make([(i, prose(rng, 30, 40) if i % 2 else prose(rng, 30, 40).replace("w", "x")) for i in range(120)], 4).select("doc_id", "text")
    counts = common.written(rnnlm.word_counts(docs), "words")
    monkeypatch.setattr(rnnlm, "BUDGET", 100)
    seen = []
    for rounds in (0, 2):
        monkeypatch.setattr(rnnlm, "ROUNDS", rounds)
        lexicon, network, _ = rnnlm.fit(docs, counts)
        seen.append(network.flat())
    # Every word's own weights move, though the sample holds but a hundred characters; after the end the state is new.
    moved = [np.any(a != b) for a, b in zip(*(network_words(x, len(lexicon.ids)) for x in seen))]
    assert len(moved) == 81 and [i for i, x in enumerate(moved) if not x] == [network.end]
    again = rnnlm.fit(docs, counts)[1].flat()
    assert np.array_equal(seen[1], again)


def network_words(flat, many):
    """The input weights of the words, as ``flat`` lays them out."""
    at = rnnlm.HIDDEN * (rnnlm.CLASSES + 1) + rnnlm.CLASSES * rnnlm.HIDDEN * rnnlm.PER_CLASS
    return flat[at : at + many * rnnlm.INPUT].reshape(many, rnnlm.INPUT)


def test_the_network_has_more_words_where_more_are_frequent():
    assert [rnnlm.sides(n) for n in (0, 1024, 1025, 2500, 10**6)] == [(32, 32), (32, 32), (33, 33), (50, 50), (rnnlm.MOST_CLASSES,) * 2]
    wide = rnnlm.Network(0, classes=40, per_class=40)
    ids = np.arange(1601)
    logs = wide.log_probs(np.tile(np.linspace(-1, 1, rnnlm.HIDDEN, dtype=np.float32), (1601, 1)), ids)[0]
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)


def plain_score(net, tokens):
    """Log10 probability of a text by the recurrence, token by token."""
    w, h, total = {k: v.astype(np.float64) for k, v in net.w.items()}, np.zeros(rnnlm.HIDDEN), 0.0
    size = rnnlm.HIDDEN
    squash = lambda x: 1 / (1 + np.exp(-x))
    share = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for t in tokens:
        group = t // net.per_class
        p = share(h @ w["A"] + w["a"])[group]
        if group < net.classes:
            p *= share(h @ w["B"][group] + w["c"][group])[t % net.per_class]
        total += math.log10(p)
        g, u = w["E"][t] @ w["W"] + w["b"], h @ w["U"]
        z, r = squash(g[:size] + u[:size]), squash(g[size : 2 * size] + u[size : 2 * size])
        n = np.tanh(g[2 * size :] + r * u[2 * size :])
        h = (1 - z) * n + z * h
    return total


@pytest.mark.parametrize("known", [200_000, 40])
def test_scores_against_the_recurrence(make, rows, monkeypatch, known):
    """Every part of a score: the network's own words in context, told and untold words of the tail by their counts, unseen words."""
    monkeypatch.setattr(rnnlm, "KNOWN", known)
    monkeypatch.setattr(rnnlm, "EPOCHS", 1)
    monkeypatch.setattr(rnnlm, "sides", lambda often: (5, 6))
    held = {}
    fit = rnnlm.fit
    monkeypatch.setattr(rnnlm, "fit", lambda *a: held.setdefault("fit", fit(*a)))
    docs = make(rows[:60] + [(700, "words never seen before " * 3)])
    monkeypatch.setattr(queries, "load", lambda *a: docs)
    got = queries.op4_language_model(None, "").collect()
    lexicon, net, totals = held["fit"]
    fold = lambda d: zlib.crc32(str(d).encode()) % 7
    counts = Counter(w for d, t in rows[:60] if fold(d) != 2 for w in [*brute.words(t), None])
    if fold(700) != 2:
        counts.update(["words", "never", "seen", "before"] * 3 + [None])
    hashes = {w: common.word_hashes([w.encode()])[0][0] if w is not None else rnnlm.END for w in set(counts) | {w for _, t in rows[:60] for w in brute.words(t)} | {"words", "never", "seen", "before"}}
    ids = {}
    for w, h in hashes.items():
        at = np.flatnonzero(lexicon.hashes == h)
        ids[w] = int(lexicon.ids[at[0]]) if len(at) else lexicon.own
    tail = sum(n for w, n in counts.items() if ids[w] == lexicon.own)
    kinds = sum(ids[w] == lexicon.own for w in counts)
    texts = dict(rows[:60]) | {700: "words never seen before " * 3}
    for r in got:
        words = [*brute.words(texts[r.doc_id]), None]
        expected = plain_score(net, [ids[w] for w in words]) + sum(math.log10((counts[w] + 1) / (tail + kinds + 1)) for w in words if ids[w] == lexicon.own)
        assert math.isclose(r.score, expected, rel_tol=1e-3, abs_tol=1e-2)
    assert any(ids[w] == lexicon.own for w in counts)


def test_a_long_text_among_short_ones():
    """Memory follows the tokens, not the longest text times the lanes."""
    import tracemalloc

    rng, net = np.random.default_rng(2), rnnlm.Network(0)
    texts = [np.append(rng.integers(1, rnnlm.OWN, 60_000), 0).astype(np.int32)] + [np.append(rng.integers(1, rnnlm.OWN, 20), 0).astype(np.int32) for _ in range(511)]
    tracemalloc.start()
    together = net.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert np.allclose(together[:3], [net.score([t])[0] for t in texts[:3]], rtol=1e-4)


@pytest.mark.parametrize("scale", [1, 200])
def test_softmax_is_taken_in_blocks(scale):
    """Many tokens with many classes: right also where exponentials would overflow, and without a matrix of tokens by classes."""
    rng, net = np.random.default_rng(6), rnnlm.Network(0, classes=96, per_class=96)
    n = 40_000
    states, tokens = np.tanh(rng.normal(0, 1, (n, rnnlm.HIDDEN))).astype(np.float32), (9217 * rng.random(n) ** 3).astype(np.int32)
    tokens[0] = 96 * 96
    net.w = {k: v * np.float32(scale) for k, v in net.w.items()}
    tracemalloc.start()
    logs = net.log_probs(states, tokens, {})[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * 97 * 4
    for i in range(0, n, 400):
        at, s = int(tokens[i]), states[i].astype(np.float64)
        plain = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
        expected = plain(s @ net.w["A"] + net.w["a"])[at // 96]
        if at < 96 * 96:
            expected += plain(s @ net.w["B"][at // 96] + net.w["c"][at // 96])[at % 96]
        assert math.isclose(logs[i], expected, rel_tol=1e-4, abs_tol=1e-3)


def test_small_classes_share_a_block(monkeypatch):
    """Classes of unequal sizes, empty ones and one of several blocks: few products, and values and slopes as token by token."""
    rng, net = np.random.default_rng(8), rnnlm.Network(0, classes=40, per_class=30)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    group = np.concatenate([np.zeros(2600, int), *[np.full(n, c) for c, n in enumerate([0, 90, 70, 0, 71, 3, *[2] * 20, 0, 0, 5, 1], 3)], np.full(50, 40)])
    tokens = rng.permutation(np.where(group < 40, group * 30 + rng.integers(0, 30, len(group)), 1200))
    states, calls, going = np.tanh(rng.normal(0, 1, (len(tokens), rnnlm.HIDDEN))), [], rnnlm._going
    monkeypatch.setattr(rnnlm, "_going", lambda *a: calls.append(len(a[2])) or going(*a))
    grads = {}
    logs, slope = net.log_probs(states, tokens, grads)
    assert len(calls) <= 10 and sum(calls) == 2 * len(tokens) - 50 and max(calls) <= rnnlm.BLOCK
    assert np.allclose(logs, net.log_probs(states, tokens)[0])
    w, expected, slopes = net.w, {k: np.zeros_like(net.w[k]) for k in "AaBc"}, np.zeros_like(states)
    for i, (s, token) in enumerate(zip(states, tokens)):
        c, total = token // 30, 0.0
        for one, two, at, there in [("A", "a", c, ...)] + ([("B", "c", token % 30, c)] if c < 40 else []):
            share = np.exp(s @ w[one][there] + w[two][there])
            share /= share.sum()
            total += math.log(share[at])
            share[at] -= 1
            expected[one][there] += np.outer(s, share)
            expected[two][there] += share
            slopes[i] += w[one][there] @ share
        assert math.isclose(logs[i], total, rel_tol=1e-9)
    assert np.allclose(slope, slopes) and all(np.allclose(grads[k], expected[k]) for k in "AaBc")


def test_rounds_follow_the_tokens():
    found = [rnnlm.rounds_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)]
    assert found[0] == rnnlm.ROUNDS and found == sorted(found) and found[-1] > found[1] + 5


def test_weights_are_averaged_in_a_tree(spark, make, monkeypatch):
    """Seven shards by twos: one row in the end, the mean by tokens."""
    monkeypatch.setattr(rnnlm, "FAN", 2)
    texts = [(i, prose(random.Random(i), 30 + 5 * i)) for i in range(40)]
    docs = make(texts, 7).select("doc_id", "text")
    counts = common.written(rnnlm.word_counts(docs), "words")
    lexicon, net, _ = rnnlm.fit(docs, counts)
    assert np.isfinite(net.flat()).all()
    monkeypatch.setattr(rnnlm, "FAN", 64)
    assert np.allclose(rnnlm.fit(docs, counts)[1].flat(), net.flat(), atol=1e-5)


def test_model_beats_counts_on_held_out_texts(spark):
    got = [r for r in queries.op4_language_model(spark, SMALL).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# -- conversations ------------------------------------------------------------------------------------

TRICKY = ["x", r"\### Assistant: </turn> ok", " </turn>\n", r"\h\\", "", None, "ends <", " ", "é😀"]


def test_template_is_reversible():
    for role in ("user", "assistant", "System", "a:b\n#", None, "", "ÄB", "ß", "user "):
        for text in TRICKY:
            formatted = chat.render(role, text)[0]
            assert [x[:2] for x in chat.parse(formatted * 2)] == [(role or "", text or "")] * 2
            assert formatted.count("###") == formatted.count("</turn>") == 1


def test_conversations_read_back(spark):
    rng = random.Random(7)
    turns = [(c, i, ("user", "assistant", None)[min(2, (i % 2) + (rng.random() < 0.1))], rng.choice(TRICKY[: 2 + i])) for c in range(60) for i in range(rng.randrange(1, 7))]
    turns += [(None, 0, "user", "no id"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (900, None, "assistant", "no turn")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")).repartition(4)
    packs, members = chat.format_conversations(rows)
    held = defaultdict(list)
    for c, i, r, t in turns:
        held[c].append(((i is not None, i), (r is not None, r or ""), (t is not None, t or "")))
    expected = set()
    for c, found in held.items():
        said = [(r[1], t[1]) for _, r, t in sorted(found)]
        loss = "".join(t for r, t in said if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        chars = sum(len(chat.render(*x)[0]) for x in ((r[1] if r[0] else None, t[1]) for _, r, t in sorted(found)))
        expected.add((c, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), chars))
    assert {tuple(r) for r in chat.read_back(packs, members).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()} == expected
    for rows_ in [packs.filter(F.col("pack") == p.pack).orderBy("node").collect() for p in packs.select("pack").distinct().collect()]:
        assert [r.start for r in rows_] == [0, *[r.stop for r in rows_[:-1]]]  # one sequence
        assert len({(tuple(map(tuple, r.ancestors)), r.text) for r in rows_}) == len(rows_)  # each turn once
        assert all(a.stop < b.start for r in rows_ for a, b in zip(r.ancestors, r.ancestors[1:]))  # intervals that touch are one
    assert chat.format_conversations(rows.limit(0))[0].count() == 0


def test_large_ids_beside_none(spark):
    big = 2**53
    turns = [(c, i, "user", "hello") for c in (big, big + 1, None, 3) for i in range(2)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)
    found = chat.read_back(*chat.format_conversations(rows)).collect()
    assert Counter((r.conv_id, r.n_turns) for r in found) == Counter({(c, 2): 1 for c in (big, big + 1, None, 3)})


def test_long_conversations(spark):
    """20,000 turns, and one that shares half of them: intervals in proportion to the turns."""
    n = 20_000
    rows = spark.range(2 * n).select(F.floor(F.col("id") / n).alias("conv_id"), (F.col("id") % n).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when((F.col("id") >= n) & (F.col("id") % n >= n / 2), F.lit("other")).otherwise(F.concat(F.lit("t"), F.col("id") % n)).alias("text"))
    packs, members = chat.format_conversations(rows.repartition(4))
    assert packs.count() in (n + n // 2, 2 * n)  # in one pack, or one in each of two
    assert packs.agg(F.sum(F.size("ancestors"))).first()[0] <= 3 * n
    found = {r.conv_id: r for r in chat.read_back(packs, members).collect()}
    assert {c: r.n_turns for c, r in found.items()} == {0: n, 1: n}
    assert found[0].loss_chars == sum(len(f"t{i}") for i in range(1, n, 2))


# -- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark, make, rows):
    """Each stage's own input is given to its plain version."""
    docs = make(rows).withColumn("lang", F.lit("en")).withColumn("size", F.lit("clash"))
    kept = common.written(corpus_pipeline.language(spark, docs, SMALL), "t")
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert kept.columns == docs.columns and texts(kept) <= texts(docs)
    assert all(t and any(c.isalpha() for c in t) for _, t in texts(kept))
    cut = common.written(corpus_pipeline.lines(spark, kept, SMALL), "t")
    before = [(r.doc_id, r.text) for r in kept.collect()]
    assert texts(cut) == Counter((d, left) for (d, t), (_, _, n, left) in zip(before, brute.line_templates(before)) if not n or brute.words(left))
    one = common.written(corpus_pipeline.near_copies(spark, cut, SMALL), "t")
    before = [(r.doc_id, r.text) for r in cut.collect()]
    found = brute.components(before)
    assert {d for d, _ in texts(one) if d is not None} == {d for i, (d, _) in enumerate(before) if d is not None and found[i][1] == d}
    clean = common.written(corpus_pipeline.benchmark(spark, one, SMALL), "t")
    assert texts(clean) == texts(one)  # holds no item
    mixed = corpus_pipeline.mix(spark, clean, SMALL)
    assert mixed.columns == [*docs.columns, "copy"] and set(texts(mixed)) <= set(texts(clean))


def test_pipeline_removes_leaks_and_copies(spark):
    out = corpus_pipeline.run(spark, SMALL)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in out.select("doc_id", "text").distinct().collect()}
    assert not any(item in " ".join(t.lower().split()) for t in texts.values() for item in items)
    sets = Counter(brute.shingles(t) for t in texts.values())
    assert max(sets.values()) == 1
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stored_tables_can_be_cleared(spark):
    kept = common.written(spark.range(3), "t")
    assert kept.count() == 3
    path = kept.inputFiles()[0].rsplit("/", 2)[0]
    assert path.endswith(spark.sparkContext.applicationId)
