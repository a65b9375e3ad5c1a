"""Constraint checks. Every check gives rows (entity, entity_id, rule, detail); a clean bank gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import normalize, normalize_light, reasons

# Fixed values.
SUBJECT_IDS = ("tznk", "english", "management", "psychology-sociology")
QUESTION_TYPES = ("single_choice", "passage_single_choice")
DIFFICULTIES = ("easy", "medium", "hard")
SOURCE_TYPES = ("official_demo", "public_source", "generated", "manually_added")


def empty(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def not_in(c: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def violations(rows: DataFrame, entity: str, key: str, *cases: tuple[Column, str]) -> DataFrame:
    """One row for each case that holds, all read in one pass."""
    found = rows.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.explode(reasons(*cases)).alias("rule"))
    return found.withColumn("detail", F.lit(""))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def has_duplicate_options(options: Column, strict: bool = True) -> Column:
    """Whether two options have one normal form; the light form keeps punctuation apart."""
    normal = F.transform(options, normalize if strict else normalize_light)
    return F.size(F.array_distinct(normal)) < F.size(normal)


def question_rules(questions: DataFrame, subjects: tuple[str, ...] = SUBJECT_IDS) -> DataFrame:
    """Field rules of questions."""
    options = F.coalesce("options", F.array().cast("array<string>"))
    return violations(
        questions, "question", "question_id",
        (empty("question_id"), "empty id"),
        (empty("topic"), "empty topic"),
        (empty("question"), "empty question"),
        (empty("explanation"), "empty explanation"),
        (not_in("subject", subjects), "unknown subject"),
        (not_in("type", QUESTION_TYPES), "unknown type"),
        (not_in("difficulty", DIFFICULTIES), "unknown difficulty"),
        (not_in("source_type", SOURCE_TYPES), "unknown source type"),
        (F.col("source_url").isNotNull() & F.try_parse_url("source_url", F.lit("HOST")).isNull(), "bad address"),
        (F.size(options) < 4, "fewer than 4 options"),
        (F.exists(options, lambda o: F.trim(o) == ""), "empty option"),
        (F.coalesce(F.col("correct") < 0, F.lit(True)), "negative answer"),
        (F.coalesce(F.col("correct") >= F.size(options), F.lit(True)), "answer beyond options"),
        ((F.col("type") == "passage_single_choice") & empty("passage"), "passage is missing"),
    )


def duplicate_options(questions: DataFrame, strict: bool = False) -> DataFrame:
    return violations(questions, "question", "question_id", (has_duplicate_options(F.col("options"), strict), "duplicate options"))


def duplicate_ids(rows: DataFrame, entity: str, key: str, file: str, position: str) -> DataFrame:
    """Every row but the first of an id; detail is the first one's file."""
    order = Window.partitionBy(key).orderBy(file, position)
    ranked = rows.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.lit("duplicate id").alias("rule"), F.first(file).over(order).cast("string").alias("detail"), F.row_number().over(order).alias("n"))
    return ranked.filter("n > 1").drop("n")


def duplicate_texts(rows: DataFrame, key: str, subject: str, text: str) -> DataFrame:
    """Every row but the first of a normal form within its subject; detail is the first one's id.

    The first is found by an aggregate that combines before the shuffle, so a text that very many rows share is safe.
    """
    normal = rows.select(F.col(key).alias("entity_id"), F.col(subject).alias("subject"), F.sha2(normalize(F.col(text)), 256).alias("form"))
    first = normal.groupBy("subject", "form").agg(F.min("entity_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return normal.join(first, ["subject", "form"]).filter("entity_id > first").select(F.lit("question").alias("entity"), F.col("entity_id").cast("string"), F.lit("duplicate text").alias("rule"), F.col("first").cast("string").alias("detail"))


def unknown_references(rows: DataFrame, entity: str, key: str, reference: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """Rows whose reference is not known; null references pass."""
    missing = rows.filter(F.col(reference).isNotNull()).join(known.select(F.col(known_key).alias(reference)).distinct(), reference, "left_anti")
    return missing.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.lit(rule).alias("rule"), F.col(reference).cast("string").alias("detail"))


def group_rules(groups: DataFrame) -> DataFrame:
    """Field rules of groups (group_id, subject, passage, question_ids)."""
    return violations(groups, "group", "group_id", (empty("group_id"), "empty id"), (empty("passage"), "empty passage"), (F.coalesce(F.size("question_ids") < 1, F.lit(True)), "no questions"))


def set_rules(sets: DataFrame) -> DataFrame:
    """Field rules of exam sets (set_id, title, units of struct type, question_id, group_id)."""
    bad = F.exists("units", lambda u: ~(((u["type"] == "question") & u["question_id"].isNotNull()) | ((u["type"] == "group") & u["group_id"].isNotNull())))
    return violations(sets, "exam_set", "set_id", (empty("set_id"), "empty id"), (empty("title"), "empty title"), (F.coalesce(F.size("units") < 1, F.lit(True)), "no units"), (F.coalesce(bad, F.lit(False)), "bad unit"))


def memberships(groups: DataFrame) -> DataFrame:
    """(group_id, subject, member_order, question_id): one row a member, orders from 1."""
    return groups.select("group_id", F.col("subject").alias("group_subject"), F.posexplode("question_ids").alias("member_order", "question_id")).withColumn("member_order", F.col("member_order") + 1)


def group_integrity(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Groups against questions (question_id, subject, group_id, group_order)."""
    member = memberships(groups)
    joined = member.join(questions.select("question_id", F.col("subject").alias("question_subject"), F.col("group_id").alias("own_group"), "group_order", F.lit(1).alias("there")), "question_id", "left")
    there = F.col("there").isNotNull()
    pair = F.concat_ws(":", "group_id", "question_id")
    per_member = violations(
        joined.withColumn("pair", pair), "group", "pair",
        (~there, "missing question"),
        (there & (F.col("question_subject") != F.col("group_subject")), "subject differs"),
        (there & ~F.col("own_group").eqNullSafe(F.col("group_id")), "group id differs"),
        (there & ~F.col("group_order").eqNullSafe(F.col("member_order")), "group order differs"),
    )
    counted = lambda keys, rule, key: member.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("group").alias("entity"), key.cast("string").alias("entity_id"), F.lit(rule).alias("rule"), F.lit("").alias("detail"))
    many = member.select("group_id", "question_id").distinct().groupBy("question_id").agg(F.count("*").alias("n")).filter("n > 1")
    return union(
        per_member,
        counted(["group_id", "question_id"], "duplicate member", pair),
        many.select(F.lit("question").alias("entity"), F.col("question_id").cast("string").alias("entity_id"), F.lit("in several groups").alias("rule"), F.lit("").alias("detail")),
        groups.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("group").alias("entity"), F.col("group_id").cast("string").alias("entity_id"), F.lit("duplicate id").alias("rule"), F.lit("").alias("detail")),
        unknown_references(questions, "question", "question_id", "group_id", groups, "group_id", "missing group"),
    )


def set_units(sets: DataFrame) -> DataFrame:
    """(set_id, set_subject, unit_order, type, question_id, group_id): one row a unit."""
    units = sets.select("set_id", F.col("subject").alias("set_subject"), F.posexplode("units").alias("unit_order", "unit"))
    return units.select("set_id", "set_subject", "unit_order", "unit.*")


def covered_questions(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(set_id, unit_order, member_order, question_id): the questions that each set's units cover."""
    units = set_units(sets)
    alone = units.filter("type = 'question'").select("set_id", "unit_order", F.lit(1).alias("member_order"), "question_id")
    grouped = units.filter("type = 'group'").drop("question_id").join(memberships(groups), "group_id").select("set_id", "unit_order", "member_order", "question_id")
    return alone.unionByName(grouped)


def set_integrity(sets: DataFrame, groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Exam sets against groups and questions, and the coverage of the questions that name a set (set_id)."""
    units = set_units(sets).withColumn("unit", F.concat_ws(":", "set_id", "type", F.coalesce("question_id", "group_id")))
    bank = questions.select("question_id", F.col("subject").alias("question_subject"), "group_id")
    alone = units.filter("type = 'question'").drop("group_id").join(bank, "question_id", "left")
    known = groups.select("group_id", F.col("subject").alias("group_subject")).distinct()
    grouped = units.filter("type = 'group'").join(known, "group_id", "left")
    named = questions.filter(F.col("set_id").isNotNull()).select("question_id", "set_id")
    uncovered = named.join(covered_questions(sets, groups).select("set_id", "question_id").distinct(), ["set_id", "question_id"], "left_anti")
    plain = lambda rows, key, rule: rows.select(F.lit("exam_set").alias("entity"), F.col(key).cast("string").alias("entity_id"), F.lit(rule).alias("rule"), F.lit("").alias("detail"))
    return union(
        plain(sets.groupBy("set_id").agg(F.count("*").alias("n")).filter("n > 1"), "set_id", "duplicate id"),
        plain(units.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1"), "unit", "duplicate unit"),
        violations(alone, "exam_set", "unit", (F.col("question_subject").isNull(), "missing question"), (F.col("question_subject") != F.col("set_subject"), "subject differs"), (F.col("group_id").isNotNull(), "grouped question alone")),
        violations(grouped, "exam_set", "unit", (F.col("group_subject").isNull(), "missing group"), (F.col("group_subject") != F.col("set_subject"), "subject differs")),
        unknown_references(questions, "question", "question_id", "set_id", sets, "set_id", "missing exam set"),
        uncovered.join(sets.select("set_id").distinct(), "set_id", "left_semi").select(F.lit("question").alias("entity"), F.col("question_id").cast("string").alias("entity_id"), F.lit("not covered by its set").alias("rule"), F.col("set_id").cast("string").alias("detail")),
    )


def is_structurally_valid() -> Column:
    """What a merge asks of a question."""
    options = F.coalesce("options", F.array().cast("array<string>"))
    fine = ~empty("question") & ~empty("explanation") & (F.size(options) >= 4) & ~has_duplicate_options(options) & (F.col("correct") >= 0) & (F.col("correct") < F.size(options))
    return F.coalesce(fine & ((F.col("type") != "passage_single_choice") | ~empty("passage")), F.lit(False))


def generator_rules(rows: DataFrame) -> DataFrame:
    """Guards of generated rows: four different options, an answer in range, a passage where the type needs one."""
    return violations(
        rows, "generated", "question_id",
        (F.size("options") != 4, "not exactly 4 options"),
        (has_duplicate_options(F.col("options"), strict=False), "duplicate options"),
        (~F.coalesce((F.col("correct") >= 0) & (F.col("correct") < F.size("options")), F.lit(False)), "answer out of range"),
        ((F.col("type") == "passage_single_choice") & empty("passage"), "passage is missing"),
    )


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) for each field that an update has changed, and for rows that went or came ('missing', 'new')."""
    a = before.select(key, *(F.col(f).alias(f"before_{f}") for f in fields), F.lit(1).alias("was"))
    b = after.select(key, *(F.col(f).alias(f"after_{f}") for f in fields), F.lit(1).alias("is"))
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    cases = [(both & ~F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}")), f) for f in fields]
    found = reasons(*cases, (F.col("is").isNull(), "missing"), (F.col("was").isNull(), "new"))
    return a.join(b, key, "full_outer").select(key, F.explode(found).alias("field"))
