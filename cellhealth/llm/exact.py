"""Exact deduplication against a persistent digest index (DataFrame and SQL functions only).

Texts are equal when they are after their white space is deleted; a text's digest is the SHA-256 of what is left. The index is a
table of one row a digest (which row stays, and the load that brought it), partitioned by load, bucketed and sorted by digest. A load
elects, per digest, the row with the most code points, then the least id; a sort-merge anti-join with the index leaves the digests
that are new, and those are appended. What an earlier load brought stays, so a load of longer texts goes first where the longest is
to stay. The index side of the joins is never shuffled, and its sorts are over buckets.

A load names the rows it brings and replaces what a load of that name brought before, so one that was broken off can be repeated.
The index lies under a path of the caller's and is opened again by it, in another session too; one writer at a time.

Null and empty texts, and those of white space alone, are one group. Ids may be null (they come after all others) or repeated: of
rows that are equal in length and id one stays, the first stored. An empty table gives no rows. Other columns pass through; columns
made here replace those of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, place, written

#: The query loads texts of so many code points or more first, then the others.
FIRST_CHARS = 2_000
_MADE = ("digest", "chars", "row", "load")


def staged(docs: DataFrame, load: Column) -> DataFrame:
    """``docs`` stored without their texts, with ``digest``, ``chars`` (code points), ``row`` (its number here) and ``load``."""
    text = F.coalesce("text", F.lit(""))
    made = docs.withColumns({"__digest": F.unhex(F.sha2(F.regexp_replace(text, SPACES, ""), 256)), "__chars": F.length(text).cast("long")})
    made = made.withColumns({"__row": F.monotonically_increasing_id(), "__load": load})
    own = [c for c in docs.columns if c not in (*_MADE, "text")]
    return written(made.select(*own, *[F.col(f"__{c}").alias(c) for c in _MADE]), "staged")


class DigestIndex:
    """The index under ``path``; made there, with ``buckets`` buckets, if there is none.

    A new index has as many buckets as the session has shuffle partitions; an existing one keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        settings = f"{self.path}/settings"
        folder = spark._jvm.org.apache.hadoop.fs.Path(settings, "_SUCCESS")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            wanted = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(wanted).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(settings)
        self.buckets = spark.read.parquet(settings).first()["buckets"]
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"create table if not exists {self.name} (digest binary, keep_id bigint, keep_row bigint, load string) using parquet"
            f" partitioned by (load) clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}/rows'"
        )

    def rows(self) -> DataFrame:
        """``digest, keep_id, keep_row, load``: for each digest, the row that stays and the load that brought it."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, load: str) -> DataFrame:
        """Append the digests of ``rows`` (as ``staged``) that the index lacks; returns what was appended."""
        first = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id").cast("long").alias("id"), F.col("row"))).alias("first")
        elected = rows.groupBy("digest").agg(first).select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))
        known = self.rows().filter(F.col("load") != load).select("digest").hint("merge")
        new = written(elected.join(known, "digest", "left_anti"), "new-digests")
        self.spark.catalog.dropTempView(f"{self.name}_new")
        new.repartition(self.buckets, "digest").createTempView(f"{self.name}_new")
        name = load.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"insert overwrite table {self.name} partition (load = '{name}') select digest, keep_id, keep_row from {self.name}_new")
        self.spark.catalog.dropTempView(f"{self.name}_new")
        return new

    def decide(self, rows: DataFrame) -> DataFrame:
        """``rows`` (as ``staged``, all loaded) with ``keep_id``, ``kept`` and ``group_size``, the rows here of equal text."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("size"), F.min("row").alias("row"), F.min("load").alias("by"))
        found = sizes.join(self.rows().hint("merge"), "digest")
        alone = (F.col("size") == 1) & (F.col("row") == F.col("keep_row")) & (F.col("by") == F.col("load"))
        shared = found.filter(~alone).select("digest", "size", F.col("keep_id").alias("__keep_id"), "keep_row", F.col("load").alias("keep_load"))
        # A row without a partner stays. Copies of one text are rows of one key: adaptive execution splits them, as the other side has one row a key.
        joined = rows.join(written(shared, "shared-digests"), "digest", "left")
        other, stays = F.col("size").isNotNull(), (F.col("keep_row") == F.col("row")) & (F.col("keep_load") == F.col("load"))
        own = [c for c in rows.columns if c not in ("keep_id", "kept", "group_size")]
        return joined.select(
            *own,
            F.when(other, F.col("__keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(stays, F.lit(True)).alias("kept"),
        )


def decided(docs: DataFrame, path: str | None = None, first_chars: int = FIRST_CHARS) -> DataFrame:
    """Every document with its decision, through an index of two loads: texts of ``first_chars`` code points or more, then the others."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or place(spark, "digest-index"))
    text = F.coalesce("text", F.lit(""))
    rows = staged(docs, F.when(F.length(text) >= first_chars, "long").otherwise("short"))
    for load in ("long", "short"):
        index.add(rows.filter(F.col("load") == load), load)
    return index.decide(rows)
