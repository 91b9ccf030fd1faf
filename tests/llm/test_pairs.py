"""Operators on copies and repeated text against their plain versions."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import brute
import numpy as np
import pytest
from fixtures import make, word, prose, rows  # noqa: F401
from pyspark.sql import functions as F

from cellhealth.llm import components, decontaminate, jaccard, simhash, suffix, templates


def test_jaccard_components(make, rows, monkeypatch):
    expected = Counter((rows[i][0], *found) if found[0] else (rows[i][0], 0, rows[i][0]) for i, found in brute.components(rows).items())
    assert Counter(map(tuple, jaccard.link_components(make(rows)).collect())) == expected
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    assert Counter(map(tuple, jaccard.link_components(make(rows, 5)).collect())) == expected


def test_jaccard_keeps_one_of_each(make, rows):
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(make(rows)).collect()]
    found = brute.components(rows)
    named = {d for i, (d, t) in enumerate(rows) if d is not None and (not found[i][0] or found[i][1] == d)}
    assert {d for d, _ in kept if d is not None} == named
    assert max(Counter(d for d, t in kept if d is not None and brute.words(t)).values()) == 1
    assert sum(d is None for d, _ in kept) == 3


def test_one_id_on_several_texts(make):
    rng = random.Random(12)
    a, b, c = (prose(rng, 40, 9000) for _ in range(3))
    # Id 5 stands on a copy of 1's text and on two texts of its own.
    kept = jaccard.keep_one(make([(1, a), (5, a), (5, b), (5, c), (5, c)])).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (5, b), (5, c)])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("many,shard", [(2000, 1 << 20), (2, 2000)])
def test_repeated_bytes(make, rows, monkeypatch, many, shard):
    monkeypatch.setattr(suffix, "MANY", many)
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "_CHUNK", 700 if many == 2 else suffix._CHUNK)
    assert Counter(map(tuple, suffix.remove_repeats(make(rows)).collect())) == Counter(brute.repeats(rows))


def test_suffix_order_and_common_prefixes():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(700)) + b"ab" * 150
    a = np.frombuffer(data + bytes(8), np.uint8)
    order = suffix.suffix_order(a)
    expected = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == expected
    common = suffix.common_prefixes(a, order, np.array([0]), np.array([len(data)]))
    for k in range(1, len(order)):
        x, y = data[order[k - 1] :], data[order[k] :]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[k] == min(n, suffix.LENGTH)


def test_line_templates(make, rows):
    got = templates.drop_recurring_lines(make(rows).withColumn("n_lines", F.lit("clash")))
    seen = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect())
    expected = brute.line_templates(rows)
    assert seen == Counter(expected)
    assert sum(x[2] for x in expected) > 8


def test_many_lines_in_one_text(make):
    """200,000 lines, half of them in ten texts: cut in time that follows the lines."""
    rng = random.Random(8)
    shared = [f"shared line {prose(rng, 3)} {word(i)}" for i in range(100_000)]
    own = [f"own line {word(i)} {prose(rng, 3)}" for i in range(100_000)]
    long = "\n".join(x for pair in zip(shared, own) for x in pair)
    texts = [long] + ["\n".join(x for s in shared[:60] for x in (s, f"here {word(i)} {word(rng.randrange(10**6))} it is")) for i in range(10)]
    start = time.time()
    out = {r.doc_id: r for r in templates.drop_recurring_lines(make(list(enumerate(texts)))).collect()}
    assert out[0].n_lines == 200_000 and out[0].n_dropped == 60 and out[0].text.split("\n")[:2] == own[:2]
    assert all(out[i].n_dropped == 60 for i in range(1, 11)) and time.time() - start < 120


def test_line_stage_keeps_columns_and_copies(make, rows):
    docs = make(rows).withColumn("n_lines", F.lit(1)).withColumn("key", F.lit("x"))
    out = templates.keep_own_text(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in out.collect())


def test_myers_against_the_matrix():
    rng = random.Random(5)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 100)))
        least, end = brute.least_distance(item, text)
        got = decontaminate.myers(item, text, len(item))
        assert got == (least, end) if least < len(item) else got[0] == len(item)
        assert decontaminate.myers(item, text, least - 1) is None if least else True


def test_decontamination(spark, make):
    rng = random.Random(6)
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (None, "short item"), (3, "twice twice")]
    docs = []
    for i, (_, t) in enumerate(items[:12]):
        spoiled = list(t)
        for _ in range(rng.randrange(0, 2 * decontaminate.budget(t))):
            spoiled[rng.randrange(len(spoiled))] = "#"
        docs.append((i, "before " + "".join(spoiled).upper().replace(" ", "  \n") + " after"))
    docs += [(90, "a short  Item here"), (91, "nothing"), (92, None), (93, ""), (None, items[0][1]), (0, docs[0][1])]
    found = decontaminate.matches(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, r.distance) for r in found.collect())
    expected = Counter()
    for d, t in docs:
        for i, item in items:
            plain = decontaminate.folded(item)
            if plain and (least := brute.least_distance(plain, decontaminate.folded(t))[0]) <= decontaminate.budget(plain):
                expected[d, i, least] += 1
    assert got == expected and 3 < len({k[0] for k in got}) < len(docs)
    for r in found.collect():
        text = decontaminate.folded(dict(docs[:12] + docs[12:16]).get(r.doc_id, items[0][1]))
        plain = decontaminate.folded(next(t for i, t in items if i == r.item_id and t and decontaminate.folded(t) in (decontaminate.folded(t),)))
        assert r.distance or plain != decontaminate.folded("q") and 0 <= r.start <= r.end <= len(text)


def test_large_ids_and_short_items(spark, make):
    big = 2**53
    docs = make([(big, "say ok to that"), (big + 1, "say ok to that"), (None, "say ok to that"), (4, "token broke"), (5, "ok")], 1)
    items = spark.createDataFrame([(big, "say ok to that"), (big + 1, "ok"), (None, "ok to")], "item_id long, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect())
    assert found == Counter([(d, i) for d in (big, big + 1, None) for i in (big, big + 1, None)] + [(5, big + 1)])
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {4, 5}


def test_decontamination_in_blocks(spark, make, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} " * 6) for i in range(9)], "item_id long, text string")
    docs = make([(i, "so " + f"item number {i} " * 7) for i in range(9)])
    whole = {tuple(r) for r in decontaminate.matches(docs, items).collect()}
    assert len(whole) >= 9
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert {tuple(r) for r in decontaminate.matches(docs, items).collect()} == whole
    assert decontaminate.drop_leaks(docs, items).count() == 0


def plain_fingerprint(spark, text):
    w = brute.words(text)
    terms = list(zip(w, w[1:])) or [(x, None) for x in w]
    if not terms:
        return 0
    hashes = [r[0] for r in spark.createDataFrame(terms, "one string, two string").select(F.xxhash64("one", "two")).collect()]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, make, rows, monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE_BITS", 5)
    some = rows[::9] + rows[-10:]
    docs = make(some).select(F.monotonically_increasing_id().alias("at"), "text")
    got = {r.at: r.fingerprint for r in simhash.fingerprints(docs, ["at"]).collect()}
    for r in docs.collect():
        assert got[r.at] & (1 << 64) - 1 == plain_fingerprint(spark, r.text)


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_neighbours(make, rows, bucket_rows):
    got = simhash.neighbours(make(rows), bucket_rows).collect()
    assert len(got) == len(rows)
    at = {r.at: r for r in got}
    assert len(at) == len(rows)
    order = sorted(got, key=lambda r: (r.at))
    step, seen = got[0], set()
    while step.at not in seen:
        seen.add(step.at)
        following = at[step.next_at]
        assert (following.text or None) == (step.next_text or None)
        step = following
    assert len(seen) == len(rows)  # one cycle
    ids = [r.doc_id if r.doc_id is not None else -1 for r in order]
    assert sorted(ids) == ids


def test_edited_text(make):
    docs = make([(1, "abcde"), (2, "xy"), (3, None), (4, "😀😀😀😀")])
    got = {r.doc_id: r.e for r in simhash.neighbours(docs).select("doc_id", simhash.edited(F.col("text"), F.col("next_text")).alias("e")).collect()}
    assert got == {1: "abcxy", 2: "x", 3: "", 4: "😀😀ab"}


def test_shared_passages_vanish_whole(make):
    rng = random.Random(5)
    footer = ["Contact", *[prose(rng, 6) for _ in range(4)], prose(rng, 14), "all rights reserved"]
    texts = ["\n".join((prose(rng, 12, 9000), prose(rng, 12, 9000), *footer)) for _ in range(50)]
    left = {r.doc_id: r.text for r in templates.keep_own_text(make(list(enumerate(texts)))).collect()}
    # Lines of fewer than three words are never dropped.
    assert left == {i: "\n".join(t.split("\n")[:3]) for i, t in enumerate(texts)}


def test_more_texts_do_not_keep_a_line(make):
    rng = random.Random(6)
    heads, line = [prose(rng, 3, 9000) for _ in range(6)], prose(rng, 8)
    for many in (6, 60):
        # Few heads, each followed by a text's own words, then the line that ends all texts.
        texts = [f"{heads[i % 6]} {prose(rng, 9, 9000)}\n{line}" for i in range(many)]
        left = {r.doc_id: r.text for r in templates.keep_own_text(make(list(enumerate(texts)))).collect()}
        assert left == {i: t.split("\n")[0] for i, t in enumerate(texts)}


def test_fingerprint_of_one_word_over_and_over(spark):
    text = F.array_join(F.array_repeat(F.lit("na"), 600_000), " ")
    got = simhash.fingerprints(spark.range(1).select("id", text.alias("text")), ["id"]).collect()
    assert got[0].fingerprint == spark.range(1).select(F.xxhash64(F.lit("na"), F.lit("na"))).first()[0]


def test_within_radius(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for p in prints[:40]]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    known = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {tuple(r) for r in simhash.within_radius(known, known).collect()}
    distance = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == {(a, b, distance(a, b)) for a in signed for b in signed if a != b and distance(a, b) <= 3}


def test_empty_tables(make, spark):
    none = make([])
    assert jaccard.link_components(none).count() == 0
    assert jaccard.keep_one(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert templates.keep_own_text(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.drop_leaks(make([(1, "x")]), items).count() == 1
    assert simhash.neighbours(none).count() == 0


def test_digest_of_nothing():
    assert suffix.removed(b"abc", [(0, 2), (1, 3)]) == (3, 1, b"")
    assert hashlib.sha256(b"").hexdigest() == brute.repeats([(1, None)])[0][4]
