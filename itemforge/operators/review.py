"""Reviews of staged questions: sanitising, rule reasons, duplicates, decisions and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import quality
from itemforge.functions.html import REVIEW_ENTITIES, decode_entities
from itemforge.functions.text import normalize, reasons
from itemforge.operators.dedup import match_exact, match_near, seen_before
from itemforge.operators.filters import BLOCKING_TAGS, has_tag
from itemforge.operators.order import with_numbers
from itemforge.operators.rules import empty, has_duplicate_options

MALFORMED = r"(?i)<[^>]+>|&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);|(?<![A-Za-z0-9_])(?:undefined|null)(?![A-Za-z0-9_])"


def sanitize(questions: DataFrame) -> DataFrame:
    """Entities of the texts decoded, and whether that changed anything."""
    texts = ("question", "explanation", "passage")
    decoded = {c: decode_entities(F.col(c), REVIEW_ENTITIES) for c in texts}
    joined = decode_entities(F.array_join("options", "\u0001"), REVIEW_ENTITIES)
    decoded["options"] = F.when(F.size("options") > 0, F.split(joined, "\u0001")).otherwise(F.col("options"))
    before = F.struct(*texts, "options")
    out = questions.withColumn("before", before).withColumns(decoded)
    return out.withColumn("sanitized", ~F.col("before").eqNullSafe(F.struct(*texts, "options"))).drop("before")


def add_tags(tags: Column, *more: Column) -> Column:
    """The tags with more (null ones left out), each once."""
    return F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.array_compact(F.array(*more))))


def remove_tags(tags: Column, names: tuple[str, ...]) -> Column:
    return F.array_except(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, names)))


def apply_patch(questions: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Listed columns overwritten where the patch has a value."""
    fresh = patch.select(key, *(F.col(c).alias(f"patch_{c}") for c in columns))
    return questions.join(fresh, key, "left").withColumns({c: F.coalesce(f"patch_{c}", c) for c in columns}).drop(*(f"patch_{c}" for c in columns))


def patch_problems(questions: DataFrame, patch: DataFrame, key: str, column: str, marker: str) -> DataFrame:
    """(key, problem): patch ids that the bank lacks, and old values that do not match the marker."""
    joined = patch.select(key).distinct().join(questions.select(key, F.col(column).alias("old"), F.lit(1).alias("there")), key, "left")
    problem = F.when(F.col("there").isNull(), "unknown id").when(~F.coalesce(F.col("old").rlike(marker), F.lit(False)), "marker is missing")
    return joined.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def first_rule(rows: DataFrame, text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first pattern (of an ordered list) that the text matches, null for none."""
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(value)) for pattern, value in rules)) if rules else F.lit(None).cast("string")


def failed_anchor(trigger: Column, target: Column, anchors: list[tuple[str, str, str]]) -> Column:
    """The message of the first (pattern, expected, message) whose pattern is in trigger and whose expected is not in target."""
    return F.coalesce(*(F.when(trigger.rlike(p) & ~target.rlike(e), F.lit(m)) for p, e, m in anchors)) if anchors else F.lit(None).cast("string")


def structural_reasons() -> Column:
    """Reasons that a review of imported questions checks within one row."""
    tagged = [(has_tag(t), f"blocking tag present: {t}") for t in BLOCKING_TAGS]
    fields = F.concat(F.array("question", "explanation", F.coalesce("passage", F.lit(""))), F.col("options"))
    # The labels of these reasons.
    return reasons(
        (F.col("source_type") != "public_source", "sourceType is not public_source"),
        (empty("source_url"), "missing sourceUrl"),
        (empty("question"), "empty question text"),
        (F.size("options") < 4, "options length is below 4"),
        (has_duplicate_options(F.col("options")), "duplicate options inside question"),
        ((F.col("correct") < 0) | (F.col("correct") >= F.size("options")), "invalid correctAnswer index"),
        (empty("explanation"), "empty explanation"),
        *tagged,
        ((F.col("type") == "passage_single_choice") & empty("passage"), "passage_single_choice without passage"),
        (quality.any_artifact(fields), "obvious parsing artifact detected"),
    )


def with_duplicates(rows: DataFrame, bank: DataFrame, key: str = "question_id") -> DataFrame:
    """rows with duplicate_type (exact, batch, near or null) and duplicate_id. bank (id, subject, text); the last equal text counts."""
    texts = rows.select(F.col(key).alias("id"), "subject", F.col("question").alias("text"))
    exact = match_exact(texts, bank, last=True).select(F.col("id").alias(key), F.col("matched_id").alias("exact_id"))
    batch = seen_before(texts, normalize(F.col("text"))).select(F.col("id").alias(key), "previous_id")
    near = match_near(texts, bank).select(F.col("id").alias(key), "near_id")
    found = rows.join(exact, key, "left").join(batch, key, "left").join(near, key, "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("previous_id").isNotNull(), "batch").when(F.col("near_id").isNotNull(), "near")
    return found.withColumns({"duplicate_type": kind, "duplicate_id": F.coalesce(F.col("exact_id").cast("string"), F.col("previous_id").cast("string"), F.col("near_id").cast("string"))}).drop("exact_id", "previous_id", "near_id")


def review_imported(questions: DataFrame, bank: DataFrame, mirror_tags: tuple[str, ...] = ("zno_osvita", "official_past_exam_mirror"), manual_tag: str = "justschool") -> DataFrame:
    """Decisions on imported questions: reasons, tags to add, reviewed, and the duplicate. Exact ones are to be dropped."""
    rows = with_duplicates(sanitize(questions).withColumn("tags", remove_tags(F.col("tags"), ("formatting_review_recommended",))), bank)
    reason = structural_reasons()
    rows = rows.withColumn("reasons", reason)
    duplicate = F.col("duplicate_type").isNotNull()
    mirror = F.lit(True)
    for tag in mirror_tags:
        mirror = mirror & has_tag(tag)
    reviewed = ~duplicate & mirror & (F.size("reasons") == 0)
    manual = ~duplicate & has_tag(manual_tag) & ~reviewed
    artifact = F.array_contains("reasons", "obvious parsing artifact detected")
    more = F.concat(
        F.col("reasons"),
        F.array_compact(F.array(F.when(duplicate, F.concat(F.col("duplicate_type"), F.lit(" duplicate of "), F.col("duplicate_id"))), F.when(manual, "source requires manual editorial review"))),
    )
    table = (F.col("subject") == "tznk") & quality.is_table_like(F.col("passage"), F.col("question"))
    add = F.array_compact(F.array(F.when(duplicate | artifact | manual, "needs_manual_review"), F.when(table & ~duplicate, "formatting_review_recommended")))
    return rows.withColumns({"reviewed": reviewed, "reasons": more, "tags_to_add": add})


def review_generated(questions: DataFrame, bank: DataFrame, id_pattern: str, topics: list[str], anchors: list[tuple[str, str, str]], double_space: str = "  ", whole_target: bool = False) -> DataFrame:
    """Decisions on a generated batch: rule reasons, anchors, duplicates. whole_target tests anchors on option and explanation."""
    option = quality.correct_option(F.col("options"), F.col("correct"))
    target = F.concat_ws(" ", option, F.col("explanation")) if whole_target else option
    fields = [F.col("question"), F.col("explanation"), F.coalesce("passage", F.lit("")), F.array_join("options", "\n")]
    anchor = failed_anchor(F.concat_ws(" ", "question", "explanation"), target, anchors)
    # The labels of these reasons.
    rule = reasons(
        (~F.col("question_id").rlike(id_pattern), "id does not match the batch pattern"),
        (F.col("source_type") != "generated", "sourceType is not generated"),
        (F.col("source_url").isNotNull(), "sourceUrl must be null for generated questions"),
        (~F.col("topic").isin(topics), "topic is outside expected subject coverage"),
        (empty("subtopic"), "subtopic is empty"),
        (empty("question"), "question text is empty"),
        (F.size("options") != 4, "not exactly 4 options"),
        (has_duplicate_options(F.col("options")), "duplicate options inside question"),
        (quality.options_too_short(F.col("options")), "one or more options are too short to be useful distractors"),
        (F.coalesce((F.col("correct") < 0) | (F.col("correct") >= F.size("options")), F.lit(True)), "correctAnswer is not a valid zero-based option index"),
        (empty("explanation"), "explanation is empty"),
        (~empty("explanation") & ~quality.is_useful(F.col("explanation")), "explanation is too weak or does not clearly justify the answer"),
        (quality.is_malformed(MALFORMED, double_space, *fields), "malformed text artifact detected"),
        (anchor.isNotNull(), anchor),
    )
    rows = with_duplicates(questions.withColumn("reasons", rule), bank)
    more = F.concat("reasons", F.array_compact(F.array(F.when(F.col("duplicate_type").isNotNull(), F.concat(F.col("duplicate_type"), F.lit(" duplicate of "), F.col("duplicate_id"))))))
    return rows.withColumn("reasons", more).withColumn("reviewed", F.size("reasons") == 0)


def review_rewritten(questions: DataFrame, patch: DataFrame, patched_columns: list[str], bank: DataFrame, id_pattern: str, topics: list[str], anchors: list[tuple[str, str, str]]) -> DataFrame:
    """A batch patched, its difficulties set, reviewed by general and domain rules; with rewritten, reviewed and tags.

    rewritten tells whether the patch or the recommended difficulty changed the row. A row that fails gets the tag
    needs_manual_review, which others lose.
    """
    before = questions.withColumn("before", F.struct(*patched_columns, "difficulty"))
    rows = apply_patch(before, patch, "question_id", patched_columns)
    rows = rows.withColumn("difficulty", quality.recommended_difficulty(*(F.col(c) for c in ("subject", "topic", "subtopic", "question"))))
    rows = rows.withColumn("rewritten", ~F.col("before").eqNullSafe(F.struct(*patched_columns, "difficulty"))).drop("before")
    decisions = review_generated(rows, bank, id_pattern, topics, anchors)
    reason = F.concat("reasons", quality.domain_reasons())
    plain = remove_tags(F.col("tags"), ("needs_manual_review",))
    return decisions.withColumn("reasons", reason).withColumns({"reviewed": F.size("reasons") == 0, "tags": F.when(F.size("reasons") == 0, plain).otherwise(add_tags(plain, F.lit("needs_manual_review")))})


def review_first_batch(questions: DataFrame, patch: DataFrame, patched_columns: list[str], subtopic: Column, topic: str, order: str) -> DataFrame:
    """A batch patched, subtopics of one topic derived anew, reviewed unless tagged for review, answers rebalanced.

    rewritten tells of a patch, subtopic_changed and changed (the order of options) of the others.
    """
    rows = apply_patch(questions.join(patch.select("question_id", F.lit(True).alias("rewritten")), "question_id", "left"), patch, "question_id", patched_columns)
    rows = rows.withColumns({"rewritten": F.coalesce("rewritten", F.lit(False)), "old_subtopic": F.col("subtopic")})
    rows = rows.withColumn("subtopic", F.when(F.col("topic") == topic, subtopic).otherwise(F.col("subtopic")))
    rows = rows.withColumns({"subtopic_changed": ~F.col("subtopic").eqNullSafe(F.col("old_subtopic")), "reviewed": ~has_tag("needs_manual_review")}).drop("old_subtopic")
    return rebalance_answers(rows, order)


def with_gate(decisions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Decisions of a batch whose distribution must hold: with any gap every row needs a manual review."""
    failed = gaps.agg((F.count("*") > 0).alias("gate_failed"))  # one row
    rows = decisions.join(F.broadcast(failed))
    return rows.withColumns({
        "reviewed": F.col("reviewed") & ~F.col("gate_failed"),
        "tags": F.when(F.col("reviewed") & ~F.col("gate_failed"), remove_tags(F.col("tags"), ("needs_manual_review",))).otherwise(add_tags(F.col("tags"), F.lit("needs_manual_review"))),
    })


def tag_totals(decisions: DataFrame, tags: list[str]) -> DataFrame:
    """By source tag: rows with it, those reviewed, and those that need review."""
    rows = decisions.select("reviewed", F.explode(F.array_intersect(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("needs_review"))


def review_summary(decisions: DataFrame) -> DataFrame:
    """By subject, and over all under a null subject: total, reviewed, needing review, and duplicates by type.

    Decisions with a `rewritten` flag are counted by it, too.
    """
    kind = lambda t: F.count_if(F.col("duplicate_type") == t).alias(f"{t}_duplicates")
    more = [F.count_if("rewritten").alias("rewritten")] if "rewritten" in decisions.columns else []
    return decisions.rollup("subject").agg(*more, F.count("*").alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("needs_review"), kind("exact"), kind("batch"), kind("near"))


def rebalance_answers(questions: DataFrame, order: str) -> DataFrame:
    """The correct option of row i stands at i mod the number of options; the others keep their order."""
    numbered = with_numbers(questions, "subject", order, name="row_in_subject")
    rows = numbered.withColumn("target", F.pmod("row_in_subject", F.size("options")).cast("int")).drop("row_in_subject")
    others = F.filter("options", lambda o, i: i != F.col("correct"))
    moved = F.array_insert(others, F.col("target") + 1, F.element_at("options", F.col("correct").cast("int") + 1))
    return rows.withColumns({"options": moved, "changed": F.col("correct") != F.col("target"), "correct": F.col("target")}).drop("target")


def review_flagged(questions: DataFrame, patch: DataFrame, flag: str = "needs_answer_review", replacement: str = "explanation needs a manual check") -> DataFrame:
    """Flagged questions take the patch's answer; those without one keep the flag and get a replacement explanation."""
    rows = questions.join(patch.select("question_id", F.col("correct").alias("patch_correct")), "question_id", "left")
    flagged, patched = has_tag(flag), F.col("patch_correct").isNotNull()
    return rows.withColumns({
        "tags": F.when(flagged & patched, remove_tags(F.col("tags"), (flag,))).otherwise(F.coalesce("tags", F.array().cast("array<string>"))),
        "explanation": F.when(flagged & ~patched, replacement).otherwise(F.col("explanation")),
        "correct": F.when(flagged & patched, F.col("patch_correct")).otherwise(F.col("correct")),
    }).drop("patch_correct")
