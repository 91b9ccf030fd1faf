"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of its input;
the last adds ``copy``. Between stages the rows are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellhealth.llm import decontaminate, jaccard, langid, mixing, templates
from cellhealth.llm.common import load, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones go on."""
    tree = langid.fit(langid.training_rows(docs))
    return langid.keep_known(docs, tree)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out; documents that were nothing else go."""
    return templates.keep_own_text(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the least id."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mix", mix)]

#: The language model cannot be told in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
