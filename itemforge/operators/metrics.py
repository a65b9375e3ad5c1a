"""Counts, distributions and facets of question banks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.sources.scratch import cut


def source_counts(questions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All, imported and generated questions."""
    generated = F.col("source_type") == "generated"
    return questions.groupBy(*(by or [])).agg(F.count("*").alias("all"), F.count_if(~generated).alias("imported"), F.count_if(generated).alias("generated"))


def count_by(rows: DataFrame, *keys: Column | str, predicate: Column | None = None, name: str = "n") -> DataFrame:
    """Rows by keys; with a predicate, those that satisfy it (keys with none stay)."""
    return rows.groupBy(*keys).agg((F.count("*") if predicate is None else F.count_if(predicate)).alias(name))


def availability(questions: DataFrame) -> DataFrame:
    """Questions for every combination of source, topic, site and year, null standing for any (`any_` flags tell)."""
    source = F.when(F.col("source_type") == "generated", "generated").otherwise("imported")
    year = F.coalesce(F.col("source_year").cast("string"), F.lit(""))
    rows = questions.select("subject", source.alias("source"), "topic", F.coalesce("source_site", F.lit("")).alias("site"), year.alias("year"))
    return rows.cube("subject", "source", "topic", "site", "year").agg(F.count("*").alias("available"), F.grouping_id().alias("level")).filter("level < 16").select("subject", "source", "topic", "site", "year", "available")


def facet_bitmaps(rows: DataFrame, facets: list[str], number: str) -> DataFrame:
    """(facet, value, bucket, bits): which rows hold each value of each facet, as bitmaps over the rows' numbers (from 1).

    A null value counts as ''. A bitmap is of fixed size and covers 32,768 numbers, so the table grows with the values and the rows,
    and not with the combinations; tasks combine bitmaps before the shuffle.
    """
    held = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in facets))).alias("held")
    n = F.col(number).cast("bigint")
    pairs = rows.select(held, F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit"))
    return pairs.groupBy("held.facet", "held.value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


#: Combinations of values that one task counts in a bucket.
COMBINATIONS = 50_000


def _held_by_all(key: tuple, combinations: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """Rows of a bucket that each combination (number, positions of its values) finds: its values' bitmaps, one after the other, by AND."""
    place = {pair: i for i, pair in enumerate(zip(bitmaps.column("facet").to_pylist(), bitmaps.column("value").to_pylist(), strict=True))}
    bits = np.frombuffer(b"".join(bitmaps.column("bits").to_pylist()), np.uint64).reshape(len(place), -1) if place else None
    numbers, counts = [], []
    for combination, named in zip(combinations.column("combination").to_pylist(), combinations.column("named").to_pylist(), strict=True):
        places = [place.get((n["facet"], n["value"])) for n in named]
        if None not in places:
            numbers.append(combination)
            counts.append(int(np.bitwise_count(np.bitwise_and.reduce(bits[places])).sum()))
    return pa.table({"combination": pa.array(numbers, pa.string()), "n": pa.array(counts, pa.int64())})


def available(bitmaps: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, available): the rows that hold all values a request names; requests (request_id, facet, value), a row a value.

    Any combination of facets is an AND of their bitmaps, bucket by bucket; two values of one facet are held by no row.
    Each combination is counted once, however many requests name it. Bitmaps stay whole in a bucket's task, where the
    combinations come to them; they move once for every COMBINATIONS combinations.
    """
    named = F.sort_array(F.collect_set(F.struct("facet", "value")))
    asked = requests.groupBy("request_id").agg(named.alias("named")).withColumn("combination", F.sha2(F.to_json("named"), 256))
    asked = cut(asked, "asked")
    combinations = cut(asked.groupBy("combination").agg(F.first("named").alias("named")), "combinations")
    shards = combinations.count() // COMBINATIONS + 1
    shard = F.pmod(F.xxhash64("combination"), F.lit(shards))
    bitmaps = cut(bitmaps, "bitmaps")
    buckets = bitmaps.select(F.col("bucket").alias("at")).distinct()
    left = combinations.select("combination", "named", shard.alias("shard")).join(F.broadcast(buckets))  # a row for 32,768 rows
    right = bitmaps.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    counted = left.groupBy("at", "shard").cogroup(right.groupBy("bucket", "shard")).applyInArrow(_held_by_all, "combination string, n long")
    counts = counted.groupBy("combination").agg(F.sum("n").alias("n"))
    return asked.select("request_id", "combination").join(counts, "combination", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("available"))


def facet(rows: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Distinct values of a column with their rank: numbers first by value, then text; or by first place in `order`."""
    values = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
    if order:
        return values.agg(F.min(order).alias("first_seen"))
    return values.agg(F.count("*").alias("n")).withColumn("number", F.col("value").try_cast("int"))


def weighted_rollup(rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Counts by key and, under a null key, over all rows."""
    return rows.rollup(key).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def distribution_gaps(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Keys whose number of rows is not the expected one; expected (key, expected)."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    both = found.join(expected, key, "full_outer").select(key, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return both.filter("found <> expected")


def reason_histogram(rows: DataFrame, key: str, reasons: str = "reasons") -> DataFrame:
    """Rows with each reason; a row counts once a reason."""
    return rows.select(key, F.explode(F.array_distinct(reasons)).alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))


def pivot_reasons(rows: DataFrame, key: str, reason: str, values: list[str]) -> DataFrame:
    """One row a key with a column for each reason, 0 where it has none."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col(reason) == v).alias(v) for v in values))


def import_categories(questions: DataFrame) -> DataFrame:
    """Imported questions by category (official demo, or what a tag says, else the source type): all, with answers, for review."""
    tag = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    kind = F.when(F.col("source_type") == "official_demo", "official_demo").when(tag("official_collection"), "official_collection").when(tag("official_past_exam"), "official_past_exam").otherwise(F.col("source_type"))
    return questions.groupBy("subject", kind.alias("category")).agg(F.count("*").alias("total"), F.count_if(~tag("needs_answer_review")).alias("with_answers"), F.count_if(tag("needs_manual_review")).alias("needs_review"))
