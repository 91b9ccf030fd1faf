"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Event times are UTC; skewed joins and small partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Event times are UTC: a session with another zone is told so and moved. All else stays the caller's."""
    zone = "spark.sql.session.timeZone"
    if spark.conf.get(zone) != SETTINGS[zone]:
        warnings.warn(f"{zone} was {spark.conf.get(zone)} and is now {SETTINGS[zone]}", stacklevel=2)
        spark.conf.set(zone, SETTINGS[zone])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder checkpoints go to: the cluster's shared one, from ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a folder of its own.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and context.getCheckpointDir() is None and not context.master == "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cellhealth-checkpoints-"))
    return shared or context.getCheckpointDir()


def tables_root(spark: SparkSession) -> str:
    """The folder of this application's stored tables, below the shared one."""
    return f"{checkpoint_root(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


_OWN_FOLDER: ContextVar[str | None] = ContextVar("own_folder", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What ``stored_table`` writes inside is deleted at the end: for the batches of a stream, which go on without one."""
    folder = f"{tables_root(spark)}/passing-{uuid.uuid4().hex[:12]}"
    token = _OWN_FOLDER.set(folder)
    try:
        yield
    finally:
        _OWN_FOLDER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: made once, read by what follows, and of a size the planner knows."""
    path = f"{_OWN_FOLDER.get() or tables_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_session(name: str, cores: int | str = 8, **extra: str) -> SparkSession:
    """A single-machine session, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
