"""Token alignment, exact copies and the filter audit against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pytest
from conftest import SMALL
from fixtures import make, prose, rows  # noqa: F401
from pyspark.sql import functions as F

from cellhealth.llm import alignment, audit, common, exact, queries

# -- token alignment ----------------------------------------------------------------------------------

ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "has ▁ inside", "tab\tand\n\n  two  blanks ", "Ünï çödé 😀 text 的是不", "a" * 5000, "\x00 null \x7f", " \n" * 800, "it's we'll DON'T 12345 3.14",
    "é" * 300 + "x", "", None, " ", "\r\n", "ﬁ ligature ﷺ", "á ½ ​ zero",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    import tokenizers as library

    a = library.Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("told", [alignment.TOLD_PAIRS, 7, 0])
def test_alignment(spark, make, rows, tokenizers, told):
    every = rows[:70] + list(enumerate(ODD, 5000)) + rows[-3:]
    docs = make(every).withColumn("same", F.lit("clash")).withColumn("row", F.lit(1))
    found = alignment.align(docs, told_pairs=told)
    assert set(found.columns) == set(COLUMNS)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == brute.alignment(every, *tokenizers)


def test_alignment_of_given_documents(spark, tokenizers):
    docs = common.load(spark, SMALL, "documents")
    expected = brute.alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], *tokenizers)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in queries.queries()["op11_token_alignment"](spark, SMALL).collect()) == expected


def test_alignment_of_nothing(spark, make):
    assert alignment.align(make([])).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(make([(1, None), (2, "")])).select(*COLUMNS).collect()] == [(0,) * 6 + ("",)] * 2


def test_large_groups_and_blank_runs(tokenizers):
    aligner = alignment.Aligner(alignment._read(alignment.A_FILE), alignment._read(alignment.B_FILE))
    blanks = " " * 400_000
    a, b = aligner.tokens(blanks)
    assert list(a) == tokenizers[0].encode(" " + blanks, add_special_tokens=False).ids
    found = aligner.align(blanks)
    assert found[3] >= len(a) and int(found[6].sum() + found[9].sum()) == found[3]


# -- exact copies -------------------------------------------------------------------------------------


def copies(rows):
    spaced = [(d, t.replace(" ", "  ")) for d, t in rows[:12] if t] + [(7, (rows[3][1] or "").replace(" ", "\x0b\n"))]
    return rows + spaced + [(3, " "), (4, "\t \r\n"), (-5, "a b"), (9, "ab"), (9, "ab"), (None, "a  b"), (2, "a b"), (1, "a" * 3000)]


@pytest.mark.parametrize("first_chars", [0, 150, 10**9])
def test_exact_copies(spark, make, rows, first_chars):
    every = copies(rows)
    docs = make(every).withColumn("digest", F.lit("clash")).withColumn("kept", F.lit(1))
    found = exact.decided(docs, first_chars=first_chars).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute.exact_copies(every)
    assert all(r.lang is None or r.lang in ("en", "de") for r in found)


def test_index_over_loads(spark, make, rows):
    path = common.place(spark, "index-test")
    index = exact.DigestIndex(spark, path, buckets=4)
    stage = lambda part, load: exact.staged(make(part), F.lit(load))
    first, second = stage(rows[:30], "monday's"), stage(rows[10:60], "tuesday")
    index.add(first, "monday's")
    before = sorted(map(tuple, index.rows().collect()), key=str)
    index.add(first, "monday's")  # a load that is repeated replaces itself
    assert sorted(map(tuple, index.rows().collect()), key=str) == before
    new = index.add(second, "tuesday")
    texts = {brute.re.sub(r"\s", "", t or "") for _, t in rows[:30]}
    assert new.count() == len({brute.re.sub(r"\s", "", t or "") for _, t in rows[10:60]} - texts)
    plan = second.select("digest").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1
    again = exact.DigestIndex(spark, path)
    assert again.buckets == 4 and again.rows().count() == index.rows().count()
    decided = again.decide(second).collect()
    known = dict(rows[:30])
    for r in decided:
        old = [d for d, t in known.items() if d is not None and r.doc_id is not None and brute.re.sub(r"\s", "", t or "") == brute.re.sub(r"\s", "", dict(rows)[r.doc_id] or "")]
        assert not (r.kept and old)


def test_exact_copies_of_nothing(make):
    assert exact.decided(make([])).count() == 0


# -- filters ------------------------------------------------------------------------------------------


def filter_rows():
    rng = random.Random(13)
    out = []
    for i in range(90):
        text = prose(rng, rng.choice((10, 49, 50, 60, 200)), rng.choice((20, 400, 4000)))
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(("", "", " #", " a|b", " $5"))
        out.append((i % 80, text, rng.choice(("s1", "s1", "s2", "", None))))
    return out + [(200 + i, r[1], "s2") for i, r in enumerate(out[:20])] + [(None, out[0][1], "s1"), (None, "only here", None), (None, "only here", "s3"), (300, None, "s1"), (301, "", "s2"), (302, "Ü" * 5 + "A", "s2"), (300, None, "s1")]


def test_filter_audit(spark):
    rows = filter_rows()
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 90, 3)] + [(6, 1, 1), (6, 0, None), (None, 1, 1), (300, 1, 0)]
    docs = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], "doc_id long, text string, source string, row int, A string").repartition(3)
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert got == brute.audit(rows, labels)


def test_filter_audit_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert audit.audit(none, labels).count() == 0
    clean = spark.createDataFrame([(1, " ".join(brute_word(i) for i in range(60)), None)], none.schema)
    rows = audit.audit(clean, labels).collect()
    assert len(rows) == 600 and all((r.part, r.kept, r.removed, r.shapley) == ("", 1, 0, 0) for r in rows)


def brute_word(i):
    return "w" + "abcdefghij"[i % 10] + "abcdefghij"[i // 10]


def test_prefix_joins_stay_where_rows_are(spark):
    docs = spark.createDataFrame([(d, t, s) for d, t, s in filter_rows()], "doc_id long, text string, source string")
    tables, _ = audit.failing_ids(docs, spark.createDataFrame([], "doc_id long, quality long, toxic long"))
    plan = audit.prefix_counts(tables)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("LeftAnti") == 5 and plan.count("LeftSemi") == 1 and "Nested" not in plan and "Cartesian" not in plan
