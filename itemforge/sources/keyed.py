"""A table of one row a key, kept as a base and the changes since, for streams whose keys may change at any time.

A micro-batch is combined by itself and appended as a change; the stream holds no state and needs no watermark. Every few changes
the base and the changes are combined to a new base. What is current is an entry of the folder's commit log, so a batch that is
replayed after a failure is written once, and readers see whole batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.sources.commits import CommitLog

#: Changes beside a base before they are combined.
CHANGES = 8


class KeyedTable:
    """combine: a function of rows that gives one row a key and may be applied to its own results."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, combine: Callable[[DataFrame], DataFrame], changes: int = CHANGES) -> None:
        self.spark, self.folder, self.schema, self.combine, self.changes = spark, folder, schema, combine, changes
        self.log = CommitLog(spark, folder)

    def _rows(self, parts: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, batch: DataFrame, number: int) -> None:
        """Take a micro-batch; one whose number has been taken changes nothing. For foreachBatch."""
        entry, state = self.log.latest()
        if number <= state.get("batch", -1):
            return
        parts, name = state.get("parts", []), f"change-{uuid.uuid4().hex}"
        self.combine(batch).write.parquet(f"{self.folder}/{name}")
        parts = [*parts, name]
        if len(parts) > self.changes:
            base = f"base-{uuid.uuid4().hex}"
            self.combine(self._rows(parts)).write.parquet(f"{self.folder}/{base}")
            parts = [base]
        self.log.commit(entry, {"batch": number, "parts": parts})

    def read(self) -> DataFrame:
        """One row a key as of the last batch taken."""
        return self.combine(self._rows(self.log.latest()[1].get("parts", [])))

    def clean(self) -> None:
        """Delete what the last entry does not name; nobody may read an older one meanwhile."""
        kept = {*self.log.latest()[1].get("parts", []), "_log"}
        path, fs = self.log._path, self.log._fs
        for status in fs.listStatus(path(self.folder)):
            if status.getPath().getName() not in kept and status.getPath().getName().split("-")[0] in ("base", "change"):
                fs.delete(status.getPath(), True)


def latest_by(keys: list[str], value: str, first: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Of rows with moment and seq, the last (or first) value of each key with its moment and seq."""
    pick = F.min_by if first else F.max_by
    return lambda rows: rows.groupBy(*keys).agg(pick(F.struct(value, "moment", "seq"), F.struct("moment", "seq")).alias("v")).select(*keys, "v.*")
