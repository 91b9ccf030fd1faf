"""Stored tables: typed reads, replacement, the online table with its snapshots, and the table by day that streams append to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import lookup
from ..operators.latest import upsert_latest
from ..schemas import CELL_FEATURES, FeatureView

TECHNICAL_ID = "_id"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table of known type; empty if nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A whole stored table without its technical id."""
    return spark.read.parquet(path).drop(TECHNICAL_ID)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empty a table and keep it defined."""
    replace(empty(spark, schema), path)


class _Committed:
    """A table whose state is a numbered JSON list below ``commits``. Readers follow the highest list, so a write that dies half-way
    is never seen. Lists are created, never overwritten: of two writers at once, one fails."""

    def __init__(self, spark: SparkSession, path: str, keep: int):
        self._spark, self._path, self._keep = spark, path.rstrip("/"), keep

    def _files(self, name: str):
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return folder, folder.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf())

    def _commits(self) -> list[int]:
        folder, fs = self._files("commits")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _listed(self, number: int) -> dict:
        return json.loads(self._spark.read.text(f"{self._path}/commits/{number:010d}", wholetext=True).first()[0])

    def _newest(self) -> dict:
        numbers = self._commits()
        return self._listed(numbers[-1]) if numbers else {}

    def _commit(self, number: int, listed: dict) -> None:
        path, fs = self._files(f"commits/{number:010d}")
        try:
            out = fs.create(path, False)
        except Exception as failure:
            raise RuntimeError(f"{self._path} was written by another writer meanwhile") from failure
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()

    def _folders(self, listed: dict) -> set[str]:
        """The folders that a list names."""
        raise NotImplementedError

    def _clean(self, numbers: list[int]) -> None:
        """Drop lists beyond the newest few, and the folders only they name."""
        old, new = numbers[: -self._keep], numbers[-self._keep :]
        used = {f for n in new for f in self._folders(self._listed(n))}
        for number in old:
            for name in self._folders(self._listed(number)) - used:
                path, fs = self._files(name)
                fs.delete(path, True)
            path, fs = self._files(f"commits/{number:010d}")
            fs.delete(path, False)


class OnlineTable(_Committed):
    """Newest feature row per entity, in parts by a hash of the entity.

    An upsert rewrites only the parts its rows fall into, into a folder of its own, and then commits a list of where each part now
    lies; repeating one changes nothing. A lookup opens only the parts its entities fall into.
    """

    def __init__(self, spark: SparkSession, path: str, view: FeatureView = CELL_FEATURES, keep: int = 3, parts: int = 64):
        super().__init__(spark, path, keep)
        self._view, self._parts = view, parts

    def _folders(self, listed: dict) -> set[str]:
        return set(listed.values())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self._view.entity), F.lit(self._parts)).cast("int")

    def _touched(self, rows: DataFrame) -> list[str]:
        """The parts that rows fall into: at most as many as there are."""
        return [str(r[0]) for r in rows.select(self._part()).distinct().collect()]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return empty(self._spark, self._view.schema)
        return self._spark.read.schema(self._view.schema).parquet(*[f"{self._path}/{f}" for f in folders])

    def filled(self) -> bool:
        return bool(self._commits())

    def read(self) -> DataFrame:
        return self._rows(sorted(self._newest().values()))

    def lookup(self, asked: DataFrame, columns: Sequence[str] | None = None, now: Column | None = None) -> DataFrame:
        """One row per asked entity with its stored features, null where it has none (or, with ``now``, none within the view's
        ttl); only the parts asked for are read."""
        listed = self._newest()
        held = self._rows(sorted(listed[k] for k in self._touched(asked) if k in listed))
        return lookup(held, asked, self._view, columns, now)

    def upsert(self, fresh: DataFrame) -> None:
        """Merge feature rows in; of each entity the newest stays."""
        numbers = self._commits()
        listed = self._listed(numbers[-1]) if numbers else {}
        columns = self._view.schema.names
        touched = self._touched(fresh)
        if not touched:
            return
        held = self._rows([listed[k] for k in touched if k in listed])
        merged = upsert_latest(held.select(*columns), fresh.select(*columns), self._view.entity, self._view.event_time)
        folder = f"data/{uuid.uuid4().hex}"
        merged.select(*columns, self._part().alias("part")).repartition("part").write.partitionBy("part").parquet(f"{self._path}/{folder}")
        following = numbers[-1] + 1 if numbers else 1
        self._commit(following, listed | {k: f"{folder}/part={k}" for k in touched})
        self._clean([*numbers, following])


class DayTable(_Committed):
    """Rows partitioned by the day of a time, appended batch by batch and each batch once.

    A batch is written to a folder of its own, and the list then committed names the folder and the writer's last batch; a batch
    that comes again, after a failure between its commit and its stream's, is skipped. Readers see ``day`` and prune it. Batches
    make many small files, so every ``fan`` folders of a level are written together as one of the next: a row is rewritten once a
    level, and a reader opens at most ``fan`` folders a level.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time: str = "window_end", keep: int = 3, fan: int = 16):
        super().__init__(spark, path, keep)
        self._schema, self._time, self._fan = schema, time, fan

    def _folders(self, listed: dict) -> set[str]:
        return {name for level in listed.get("levels", []) for name in level}

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([*self._schema.fields, T.StructField("day", T.DateType())])
        if not folders:
            return empty(self._spark, schema)
        placed = T.StructType([*self._schema.fields, T.StructField("load", T.StringType()), T.StructField("day", T.DateType())])
        reader = self._spark.read.schema(placed).option("basePath", f"{self._path}/data")
        return reader.parquet(*[f"{self._path}/{f}" for f in folders]).drop("load")

    def read(self) -> DataFrame:
        return self._rows(sorted(self._folders(self._newest())))

    def _write(self, rows: DataFrame) -> list[str]:
        """The new folder, or none where there are no rows."""
        name = f"data/load={uuid.uuid4().hex}"
        rows.hint("rebalance", "day").write.partitionBy("day").parquet(f"{self._path}/{name}")
        folder, fs = self._files(name)
        return [name] if any(s.isDirectory() for s in fs.listStatus(folder)) else []

    def has(self, batch: int, writer: str) -> bool:
        return batch <= self._newest().get("batches", {}).get(writer, -1)

    def append(self, rows: DataFrame, batch: int, writer: str) -> bool:
        """Append a writer's batch unless it is there; says whether it did."""
        numbers = self._commits()
        listed = self._listed(numbers[-1]) if numbers else {"levels": [[]], "batches": {}}
        if batch <= listed["batches"].get(writer, -1):
            return False
        dated = rows.select(*self._schema.names, F.to_date(self._time).alias("day"))
        first, *above = listed["levels"]
        following = numbers[-1] + 1 if numbers else 1
        self._commit(following, {"levels": [first + self._write(dated), *above], "batches": listed["batches"] | {writer: batch}})
        self._clean([*numbers, following])
        return True

    def compact(self) -> None:
        """Write the folders of every full level together."""
        numbers = self._commits()
        if not numbers:
            return
        listed = self._listed(numbers[-1])
        levels = [list(level) for level in listed["levels"]]
        for i in range(len(levels)):
            if len(levels[i]) >= self._fan:
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1] += self._write(self._rows(levels[i]))
                levels[i] = []
        if levels != listed["levels"]:
            self._commit(numbers[-1] + 1, listed | {"levels": levels})
            self._clean([*numbers, numbers[-1] + 1])
