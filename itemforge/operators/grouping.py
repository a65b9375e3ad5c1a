"""Groups of questions that share a passage, and exam sets of the pages they come from.

questions: question_id, subject, source_type, source_url, source_site, source_year, source_order, passage, tags, file_rank, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import normalize, slug
from itemforge.functions.urls import exam_set_id, exam_set_title, exam_set_variant, infer_year, source_order, source_site

LEAST_PASSAGE = 80


def derive_sources(questions: DataFrame) -> DataFrame:
    """Site, year and order of each question, computed anew."""
    rows = questions.drop("source_site", "source_year", "source_order")
    return rows.withColumns({
        "source_site": source_site(F.col("source_type"), F.col("source_url")),
        "source_year": infer_year(F.col("source_type"), F.col("question_id"), F.col("source_url"), F.col("tags")),
        "source_order": source_order(F.col("question_id"), F.col("source_url"), F.col("position")),
    })


def group_members(questions: DataFrame, least_passage: int = LEAST_PASSAGE, excluded: DataFrame | None = None) -> DataFrame:
    """Questions in groups, with group_id, group_order (from 1) and what the group's row needs.

    A group is two or more questions of one subject and site with one normal passage. Its order is a rank within the
    group; the attributes come from aggregates that combine before the shuffle.
    """
    site = F.coalesce("source_site", F.lit("unknown"))
    rows = questions.filter(F.length(F.trim("passage")) >= least_passage)
    if excluded is not None:
        rows = rows.join(excluded.select("question_id").distinct(), "question_id", "left_anti")
    form = normalize(F.trim("passage"))
    rows = rows.withColumns({"site": site, "form": F.sha1(form), "own_order": F.coalesce("source_order", F.col("position").cast("long"))})
    key = ["subject", "site", "form"]
    first = F.struct("own_order", "question_id")
    url = F.coalesce("source_url", F.lit(""))
    year = F.coalesce(F.col("source_year").cast("string"), F.lit(""))
    buckets = rows.groupBy(*key).agg(
        F.count("*").alias("group_size"),
        F.min_by("source_type", first).alias("group_source_type"),
        F.nullif(F.min_by(url, first), F.lit("")).alias("group_url"),
        F.min_by("passage", first).alias("group_passage"),
        F.when(F.min(year) == F.max(year), F.nullif(F.min(year), F.lit(""))).alias("group_year"),
        (F.min(url) != F.max(url)).alias("several_urls"),
    ).filter("group_size > 1")
    member = rows.join(buckets, key)
    group_id = F.concat(F.lit("qg-"), F.col("subject"), F.lit("-"), slug(F.col("site")), F.lit("-"), F.substring("form", 1, 10))
    order = Window.partitionBy("group_id").orderBy("own_order", "question_id")
    return member.withColumn("group_id", group_id).withColumn("group_order", F.row_number().over(order))


def auto_groups(members: DataFrame) -> DataFrame:
    """One row a group of group_members()."""
    tags = F.when(F.first("several_urls"), F.array(*map(F.lit, ("auto_grouped", "shared_passage", "multi_source_url_group")))).otherwise(F.array(F.lit("auto_grouped"), F.lit("shared_passage")))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("group_order", "question_id"))), lambda m: m["question_id"])
    return members.groupBy("group_id", "subject").agg(F.first("group_passage").alias("passage"), ids.alias("question_ids"), F.first("group_source_type").alias("source_type"), F.first("group_url").alias("source_url"), F.nullif(F.first("site"), F.lit("unknown")).alias("source_site"), F.first("group_year").alias("source_year"), tags.alias("tags"))


def with_group_fields(questions: DataFrame, members: DataFrame) -> DataFrame:
    """questions with group_id and group_order, null outside of groups."""
    return questions.drop("group_id", "group_order").join(members.select("question_id", "group_id", "group_order"), "question_id", "left")


def override(auto: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Manual rows win over automatic ones with their key; others are added."""
    return auto.join(manual.select(key).distinct(), key, "left_anti").unionByName(manual)


def exam_set_units(questions: DataFrame, members: DataFrame, set_id: Column | None = None) -> DataFrame:
    """(set_id, unit_order, type, question_id, group_id): units in the order of their first question.

    A grouped question belongs to the set of its group's first member, and a group is a unit once a set.
    """
    own = exam_set_id(F.col("subject"), F.col("question_id"), F.col("source_type"), F.col("source_site"), F.col("source_url"), F.col("source_year"), F.col("tags")) if set_id is None else set_id
    rows = questions.withColumn("own_set", own)
    lead = members.select("group_id", "question_id", "group_order").join(rows.select("question_id", "own_set"), "question_id").groupBy("group_id").agg(F.min_by("own_set", "group_order").alias("group_set"))
    grouped = with_group_fields(rows, members).join(lead, "group_id", "left")
    placed = grouped.withColumns({"set_id": F.when(F.col("group_id").isNotNull(), F.col("group_set")).otherwise(F.col("own_set")), "own_order": F.coalesce("source_order", F.col("position").cast("long"))}).filter("set_id IS NOT NULL")
    first = F.struct("own_order", "question_id")
    units = placed.groupBy("set_id", F.coalesce("group_id", "question_id").alias("unit"), F.col("group_id").isNotNull().alias("grouped")).agg(F.min(first).alias("first"))
    order = Window.partitionBy("set_id").orderBy("first")
    return units.select(
        "set_id",
        F.row_number().over(order).alias("unit_order"),
        F.when(F.col("grouped"), "group").otherwise("question").alias("type"),
        F.when(~F.col("grouped"), F.col("unit")).alias("question_id"),
        F.when(F.col("grouped"), F.col("unit")).alias("group_id"),
    )


def exam_sets(questions: DataFrame, units: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a set: attributes of its first question in file order, and its units.

    placed (question_id, set_id) tells the set of each question.
    """
    first = F.struct("file_rank", "position")
    rows = questions.join(placed.select("question_id", "set_id"), "question_id")
    title = exam_set_title(F.col("set_id"), F.col("subject"), F.col("source_site"), F.col("source_url"))
    variant = exam_set_variant(F.col("set_id"), F.col("source_site"), F.col("source_url"))
    rows = rows.withColumns({"title": title, "variant": variant})
    head = rows.groupBy("set_id").agg(F.min_by(F.struct("subject", "title", "source_type", "source_site", "source_url", F.col("source_year").alias("year"), "variant"), first).alias("head")).select("set_id", "head.*")
    listed = units.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("unit_order", "type", "question_id", "group_id"))).alias("units"))
    return head.join(listed, "set_id")


def primary_sets(units: DataFrame, members: DataFrame) -> DataFrame:
    """(question_id, set_id) of every question that a unit covers."""
    alone = units.filter("type = 'question'").select("question_id", "set_id")
    return alone.unionByName(units.filter("type = 'group'").select("group_id", "set_id").join(members.select("group_id", "question_id"), "group_id").select("question_id", "set_id"))


def set_sizes(units: DataFrame, members: DataFrame) -> DataFrame:
    """By set: its questions (a missing group has none) and its group units."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("held"))
    held = F.when(F.col("type") == "question", 1).otherwise(F.coalesce("held", F.lit(0)))
    return units.join(sizes, "group_id", "left").groupBy("set_id").agg(F.sum(held).cast("long").alias("questions"), F.count_if(F.col("type") == "group").alias("groups"))


def migration_totals(questions: DataFrame, members: DataFrame, units: DataFrame) -> DataFrame:
    """By subject: groups, grouped and standalone rows, and sets."""
    placed = primary_sets(units, members)
    rows = with_group_fields(questions, members).join(placed, "question_id", "left")
    return rows.groupBy("subject").agg(F.count_distinct("group_id").alias("groups"), F.count("group_id").alias("grouped"), F.count_if(F.col("group_id").isNull()).alias("standalone"), F.count_distinct("set_id").alias("exam_sets"), F.count_if(F.col("set_id").isNull()).alias("unmapped"))
