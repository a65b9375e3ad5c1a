"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, most_chars: int) -> DataFrame:
    """(doc_id, text, label) of at most per_class documents of either class outside the held-out fold.

    This is the bound of what a classifier is fitted on: per_class and most_chars are parameters of train(). Which
    documents is settled by a hash of the id, among texts of at most most_chars characters. A document with
    several label rows counts as 1 if any says so; rows that repeat a doc_id count once.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .filter(fold(F.col("doc_id"), folds) != held_out)
    )
    order = F.xxhash64("doc_id", F.lit(label))
    picked = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    text = docs.filter(F.length("text") <= most_chars).select("doc_id", "text")
    # at most 2 * per_class ids: a bounded broadcast
    return text.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
