"""Orders of banks, places in them, and first examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.sources.scratch import cut

COLLATION = "uk"
_INSIDE = (1 << 33) - 1


def collated(column: str, collation: str = COLLATION) -> Column:
    """A text column that sorts as the language's dictionaries do."""
    return F.collate(F.col(column), collation)


def bank_order(key: str = "question_id") -> list[Column]:
    """Subject, source type, topic and id of questions."""
    return [collated(c) for c in ("subject", "source_type", "topic", key)]


def group_order(key: str = "group_id") -> list[Column]:
    return [collated("subject"), collated(key)]


def exam_set_order() -> list[Column]:
    return [collated("subject"), collated("title")]


def with_places(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place from 0 in the whole order, which must be unique.

    Ranges of the order are sorted side by side; a row's number in its range and the sizes of the ranges before give
    its place, so that no task holds more than a range. One row a range is broadcast.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    ranged = cut(ranged, "ranges").withColumn("__range", F.shiftright("__row", 33))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__held"))
    before = sizes.withColumn("__before", F.sum("__held").over(Window.orderBy("__range")) - F.col("__held")).drop("__held")
    return ranged.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__row").bitwiseAND(F.lit(_INSIDE))).drop("__range", "__row", "__before")


def with_numbers(rows: DataFrame, key: str, *order: Column | str, name: str = "number") -> DataFrame:
    """rows with their number from 0 within their key; a key that very many rows share is split into ranges."""
    placed = with_places(rows, key, *order, name="__place")
    first = placed.groupBy(key).agg(F.min("__place").alias("__first"))
    return placed.join(first, key).withColumn(name, F.col("__place") - F.col("__first")).drop("__place", "__first")


def first_examples(rows: DataFrame, k: int, *order: Column | str, by: str | None = None) -> DataFrame:
    """The first k rows of the order, or of each value of `by`; each task keeps k rows before the shuffle."""
    if by is None:
        return rows.orderBy(*order).limit(k)
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, place): rows by label, and the label's place in the language's order."""
    return with_places(rows.groupBy(label).agg(F.count("*").alias("n")), collated(label), F.col(label))
