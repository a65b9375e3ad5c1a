"""Outcomes of enrichment lines as a stream: which rejected lines were made good by another line.

outcomes: chunk, line, id (null where a line names none), accepted, moment (when the chunk arrived).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.sources.keyed import CHANGES, KeyedTable


def superseded(outcomes: DataFrame, delay: str = "1 day", apart: str = "30 days") -> DataFrame:
    """(chunk, line, superseded) of every rejected line, in append mode.

    A line whose id another line has, at most `apart` before or behind it, is superseded as soon as both are there; the others are
    settled when no such line can come any more. Of several acceptances of an id within the watermark one is kept. Chunks may be
    late by the delay; the state holds lines as far back as `apart` and the delay reach.
    """
    rows = outcomes.withWatermark("moment", delay)
    good = rows.filter("accepted").select(F.col("id").alias("good_id"), F.col("moment").alias("good_at")).dropDuplicatesWithinWatermark(["good_id"])
    near = F.expr(f"id = good_id AND good_at BETWEEN moment - INTERVAL {apart} AND moment + INTERVAL {apart}")
    return rows.filter("NOT accepted").join(good, near, "leftOuter").select("chunk", "line", F.col("good_id").isNotNull().alias("superseded"))


class Outcomes(NamedTuple):
    """What a stream of outcomes has brought: its rejected lines, and when each id was accepted."""

    rejected: KeyedTable
    accepted: KeyedTable


def outcome_tables(spark: SparkSession, folder: str, changes: int = CHANGES) -> Outcomes:
    rejected = KeyedTable(spark, f"{folder}/rejected", "chunk long, line long, id string, moment timestamp", lambda rows: rows, changes)
    return Outcomes(rejected, KeyedTable(spark, f"{folder}/accepted", "id string, moment timestamp", lambda rows: rows.distinct(), changes))


def write_outcomes(tables: Outcomes, batch: DataFrame, number: int) -> None:
    """Take a micro-batch; the stream holds no state. A batch that is replayed is taken once by each table. For foreachBatch."""
    tables.rejected.write(batch.filter("NOT accepted").select("chunk", "line", "id", "moment"), number)
    tables.accepted.write(batch.filter("accepted AND id IS NOT NULL").select("id", "moment"), number)


def superseded_so_far(tables: Outcomes, apart: str = "30 days") -> DataFrame:
    """(chunk, line, superseded) of every rejected line as of the last batch, by the rule of superseded(), for ids of any number of lines."""
    rows, good = tables.rejected.read(), tables.accepted.read().select(F.col("id").alias("good_id"), F.col("moment").alias("good_at"))
    near = F.expr(f"id = good_id AND good_at BETWEEN moment - INTERVAL {apart} AND moment + INTERVAL {apart}")
    flagged = lambda found, value: found.select("chunk", "line", F.lit(value).alias("superseded"))
    # lines without an id have nothing to meet; in a join all of them would be one task's
    named = rows.filter("id IS NOT NULL")
    return flagged(named.join(good, near, "left_semi"), True).unionByName(flagged(named.join(good, near, "left_anti"), False)).unionByName(flagged(rows.filter("id IS NULL"), False))
