"""Rows the tests of the text operators share."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(i):
    return "w" + "".join("abcdefghij"[int(c)] for c in str(i))


def prose(rng, n, words=400):
    return " ".join(word(rng.randrange(words)) for _ in range(n))


def edited(rng, text, share):
    return " ".join("e" + word(rng.randrange(10**6)) if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1, base=40):
    """(doc_id, text) rows: prose, exact and near copies, shared lines, empty and null texts, repeated rows, null ids."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(base)]
    long = [t for t in texts if len(t) > 300]
    texts += long[:6] + [edited(rng, t, s) for t in long[:8] for s in (0.01, 0.02, 0.05, 0.2)]
    shared = prose(rng, 12)
    texts += ["\n".join((prose(rng, 20), shared, f"page {i} of the report number {i * 7} is here now for all", prose(rng, 15))) for i in range(8)]
    texts += ["", " \t\n", "one", "Ünï çödé 😀 text", "a" * 5000, "ab " * 900, None]
    rows = list(enumerate(texts, 100))
    return rows + rows[:3] + [(None, texts[0]), (None, None), (None, long[1])]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, in several partitions."""

    def build(rows, parts=3):
        full = [(d, t, ("en", "de", None)[i % 3], (None, "s1", "s2", "s3")[i % 4], None if t is None else len(t)) for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build
