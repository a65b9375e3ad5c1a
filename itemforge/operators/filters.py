"""Filters and request parameters of question banks.

questions: question_id, subject, type, topic, source_type, source_url, source_site, source_year, reviewed, tags, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BLOCKING_TAGS = ("needs_manual_review", "needs_answer_review", "parse_error")
MODES = ("practice", "exam", "mistakes")
SOURCE_FILTERS = ("all", "imported", "generated")
SELECTION_TYPES = ("random", "exam_set")
DEFAULT_MINUTES = 30


def by_source(source_filter: str) -> Column:
    """all, imported (whatever is not generated) or generated."""
    if source_filter == "generated":
        return F.col("source_type") == "generated"
    return F.col("source_type") != "generated" if source_filter == "imported" else F.lit(True)


def by_metadata(site: str | None = None, year: str | int | None = None) -> Column:
    """Site by equality; the year compared as text, null as the empty text."""
    kept = F.lit(True) if site is None else F.col("source_site") == site
    return kept if year is None else kept & (F.coalesce(F.col("source_year").cast("string"), F.lit("")) == str(year))


def by_topic(topic: str | None, mode: str = "practice") -> Column:
    return F.lit(True) if topic in (None, "all") or mode == "mistakes" else F.col("topic") == topic


def exam_sets_by(subject: str | None = None, source_filter: str = "all", site: str | None = None, year: str | int | None = None) -> Column:
    kept = by_source(source_filter) & by_metadata(site, year)
    return kept if subject is None else kept & (F.col("subject") == subject)


def has_tag(tag: str) -> Column:
    return F.coalesce(F.array_contains("tags", tag), F.lit(False))


def is_blocked() -> Column:
    return F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, BLOCKING_TAGS))), F.lit(False))


def is_generated_candidate() -> Column:
    """Reviewed, generated, without address, not blocked. An absent address counts as a null one."""
    return F.coalesce(F.col("reviewed"), F.lit(False)) & (F.col("source_type") == "generated") & F.col("source_url").isNull() & ~is_blocked()


def is_imported_candidate() -> Column:
    return F.coalesce(F.col("reviewed"), F.lit(False)) & (F.col("source_type") == "public_source") & (F.trim(F.coalesce("source_url", F.lit(""))) != "") & ~is_blocked()


def is_included() -> Column:
    """Sources (status) that are taken in."""
    return F.col("status").eqNullSafe("include")


def question_source_type(raw: Column) -> Column:
    """The source type of questions by that of the source they come from: only official demos keep theirs."""
    return F.when(raw == "official_demo", "official_demo").otherwise("public_source")


def lacks_tag(tag: str) -> Column:
    return ~has_tag(tag)


def retry_candidates(inputs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Inputs without an accepted output."""
    return inputs.join(accepted.select("id").distinct(), "id", "left_anti")


def coerce_requests(requests: DataFrame) -> DataFrame:
    """requests of raw text (mode, count, selection, source) as known values; anything else is the default."""
    known = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)).otherwise(values[0])
    number = F.col("count").try_cast("double")
    return requests.withColumns({
        "mode": known("mode", MODES),
        "selection": known("selection", SELECTION_TYPES),
        "source": known("source", SOURCE_FILTERS),
        "count": F.when(number > 0, F.floor(number)).otherwise(F.col("default_count")).cast("long"),
    })


def setup_defaults(setups: DataFrame) -> DataFrame:
    """setups (mode, available, recommended, exam_count, minutes, exam_minutes): question count and minutes.

    The count is the exam's or the recommended one, at most what is available; mistakes take all. At least 1.
    """
    exam, there = F.col("mode") == "exam", F.greatest(F.lit(1), "available")
    return setups.withColumns({
        "question_count": F.when(exam, F.least(F.coalesce("exam_count", "recommended"), there)).when(F.col("mode") == "mistakes", there).otherwise(F.least("recommended", there)).cast("long"),
        "duration_minutes": F.when(exam, F.coalesce("exam_minutes", "minutes", F.lit(DEFAULT_MINUTES))).otherwise(F.coalesce("minutes", F.lit(DEFAULT_MINUTES))).cast("long"),
    })
