"""Writers of question banks: versions with a commit log, replacement by source, chunks of requests, files in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.sources.commits import CommitLog, Conflict


def write_version(rows: DataFrame, folder: str, version: str | None = None, after: int | None = None) -> str:
    """Write a new version beside the old ones, then commit it; returns the version's path.

    `after` is the number of the commit that the rows were made from (see last_commit): if another version has been
    committed since, this one is not and Conflict is raised. Without it the version follows whatever is last, again and again
    if others come in between. A writer that dies before its commit leaves a folder that no commit names.
    """
    version = version or uuid.uuid4().hex
    target = f"{folder}/version={version}"
    rows.write.parquet(target)
    log = CommitLog(rows.sparkSession, folder)
    while True:
        try:
            log.commit(log.latest()[0] if after is None else after, {"version": version})
            return target
        except Conflict:
            if after is not None:
                raise


def last_commit(spark: SparkSession, folder: str) -> int:
    """The number of the last commit, 0 if there is none."""
    return CommitLog(spark, folder).latest()[0]


def current_version(spark: SparkSession, folder: str) -> str | None:
    return CommitLog(spark, folder).latest()[1].get("version")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Every version committed, in order: the snapshots that can be read."""
    log = CommitLog(spark, folder)
    return [log.read(n)["version"] for n in log.numbers()]


def read_version(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The current version, or a snapshot by its name."""
    return spark.read.parquet(f"{folder}/version={version or current_version(spark, folder)}")


def replace_source(old: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """The old rows without those of one source, and the new ones."""
    return old.filter(~F.col(column).eqNullSafe(value)).unionByName(new, allowMissingColumns=True)


def write_source(rows: DataFrame, folder: str, column: str) -> None:
    """Replace the partitions of the sources that rows hold; others stay."""
    rows.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("errorifexists").json(folder)


def write_chunks(requests: DataFrame, folder: str) -> None:
    """One folder a chunk with its JSON requests in order."""
    body = F.to_json(F.struct("custom_id", "body"))
    requests.select("chunk", "place", body.alias("value")).repartition("chunk").sortWithinPartitions("chunk", "place").select("chunk", "value").write.partitionBy("chunk").text(folder)


def write_files(rows: DataFrame, folder: str, file: str = "file", order: str = "position") -> None:
    """Rows back to a folder for each source file, in their original order.

    A folder holds parts whose names sort as their rows do, so that a file of very many rows is many tasks' work.
    """
    rows.repartitionByRange(file, order).sortWithinPartitions(file, order).write.partitionBy(file).parquet(folder)
