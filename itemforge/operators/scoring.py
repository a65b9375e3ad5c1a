"""Scoring of attempts and the ledger of open mistakes.

answers: attempt_id, position, question_id, topic, selected (null if unanswered), correct, seq (orders equal positions).
attempts: attempt_id, learner, subject, mode, moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark(answers: DataFrame) -> DataFrame:
    """answers with is_correct; an unanswered question is wrong."""
    return answers.withColumn("is_correct", F.coalesce(F.col("selected") == F.col("correct"), F.lit(False)))


def percentage(correct: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(correct / total * 100)


def topic_scores(marked: DataFrame) -> DataFrame:
    """correct, total and percentage of each topic of each attempt."""
    out = marked.groupBy("attempt_id", "topic").agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))
    return out.withColumn("percentage", F.round(percentage(F.col("correct"), F.col("total")), 6))


def attempt_totals(marked: DataFrame) -> DataFrame:
    """score, total, percentage and the wrong questions in order, of each attempt."""
    wrong = F.sort_array(F.collect_list(F.when(~F.col("is_correct"), F.struct("position", "question_id"))))
    out = marked.groupBy("attempt_id").agg(F.count_if("is_correct").alias("score"), F.count("*").alias("total"), F.transform(wrong, lambda w: w["question_id"]).alias("wrong_ids"))
    return out.withColumn("percentage", F.round(percentage(F.col("score"), F.col("total")), 6))


def progress_summary(attempts: DataFrame, totals: DataFrame) -> DataFrame:
    """By learner: attempts, unweighted mean and best of their percentages, questions answered."""
    exact = percentage(F.col("score"), F.col("total"))
    return attempts.join(totals, "attempt_id").groupBy("learner").agg(
        F.count("*").alias("attempts"), F.round(F.avg(exact), 6).alias("mean_percentage"), F.max("percentage").alias("best_percentage"), F.sum("total").alias("questions")
    )


def newest_attempts(attempts: DataFrame, k: int = 100) -> DataFrame:
    """The newest k attempts of each learner, ties by attempt."""
    newest = Window.partitionBy("learner").orderBy(F.desc("moment"), F.desc("attempt_id"))
    return attempts.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def wrong_answers(marked: DataFrame) -> DataFrame:
    return marked.filter(~F.col("is_correct"))


def option_rows(questions: DataFrame, marked: DataFrame) -> DataFrame:
    """One row an option of each answered question: whether it is correct and whether it was selected."""
    options = questions.select("question_id", F.posexplode("options").alias("option_index", "option_text"))
    return marked.join(options, "question_id").withColumns({"option_correct": F.col("option_index") == F.col("correct"), "option_selected": F.coalesce(F.col("option_index") == F.col("selected"), F.lit(False))})


def passage_flags(answers: DataFrame) -> DataFrame:
    """answers (with group_id) with show_passage (the group differs from the row before), and place and size in the group.

    Rows are numbered once; both results follow that number, so equal rows cannot be ordered in two ways.
    """
    order = Window.partitionBy("attempt_id").orderBy("position", "question_id", "seq")
    group = Window.partitionBy("attempt_id", "group_id")
    numbered = answers.withColumns({"row_in_attempt": F.row_number().over(order), "group_before": F.lag("group_id").over(order)})
    return numbered.withColumns({
        "show_passage": F.col("group_id").isNotNull() & ~F.col("group_id").eqNullSafe(F.col("group_before")),
        "group_position": F.when(F.col("group_id").isNotNull(), F.row_number().over(group.orderBy("row_in_attempt"))),
        "group_size": F.when(F.col("group_id").isNotNull(), F.count("*").over(group)),
    }).drop("row_in_attempt", "group_before")


def mistakes_ledger(events: DataFrame) -> DataFrame:
    """events (learner, subject, question_id, moment, seq, is_correct): open mistakes.

    A correct answer closes a mistake; what is open counts the wrong answers since, and has the time of the last.
    """
    key = ["learner", "subject", "question_id"]
    place = F.struct("moment", "seq")
    closed = events.groupBy(*key).agg(F.max(F.when(F.col("is_correct"), place)).alias("closed"), F.max(place).alias("last"))
    # two steps, both combined before the shuffle: no ordering of a key's whole history
    since = events.filter(~F.col("is_correct")).join(closed.select(*key, "closed"), key).filter(F.col("closed").isNull() | (place > F.col("closed")))
    return since.groupBy(*key).agg(F.max("moment").alias("last_answered_at"), F.count("*").alias("times_wrong"))


def mistake_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("learner", "subject").agg(F.count("*").alias("open_mistakes"))


def mistakes_pool(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """The questions that some learner has an open mistake on."""
    return questions.join(ledger.select("question_id").distinct(), "question_id", "left_semi")


def last_answers(events: DataFrame, exam: bool = True) -> DataFrame:
    """events (attempt_id, question_id, option, moment, seq): an exam keeps the last answer, practice the first."""
    pick = F.max_by if exam else F.min_by
    return events.groupBy("attempt_id", "question_id").agg(pick("option", F.struct("moment", "seq")).alias("option"))


def within_time(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Events up to the attempt's end: its duration or its finish, whichever is first."""
    end = F.least(F.col("started") + F.make_dt_interval(mins=F.col("duration_minutes")), F.coalesce("finished", F.lit("9999-12-31").cast("timestamp")))
    return events.join(attempts.withColumn("ends", end).select("attempt_id", "ends"), "attempt_id").filter(F.col("moment") <= F.col("ends")).drop("ends")
