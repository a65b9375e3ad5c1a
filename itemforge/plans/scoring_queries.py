"""Queries of scoring, progress, filters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.operators import filters, metrics, scoring
from itemforge.plans import roles
from itemforge.plans.define import Queries
from itemforge.plans.roles import ANSWERS_SQL, QUESTIONS_SQL

query = Queries()


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mark(roles.answers(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked answers with learner, subject and time; seq orders the answers of one time."""
    attempts = roles.attempts(spark, sf_dir).select("attempt_id", "learner", "subject", "moment")
    return _marked(spark, sf_dir).join(attempts, "attempt_id").withColumn("seq", F.struct("attempt_id", "position", "seq"))


_PERCENT = "round(CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (is_correct) / count(*)::DOUBLE * 100 END, 6)"


@query(f"WITH {ANSWERS_SQL} SELECT attempt_id, topic, count(*) FILTER (is_correct) AS correct, count(*) AS total, {_PERCENT} AS percentage FROM marked GROUP BY 1, 2")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.topic_scores(_marked(spark, sf_dir))


@query(f"""WITH {ANSWERS_SQL} SELECT attempt_id, count(*) FILTER (is_correct) AS score, count(*) AS total, {_PERCENT} AS percentage,
coalesce(string_agg(question_id::VARCHAR, ',' ORDER BY position, question_id, seq) FILTER (NOT is_correct), '') AS wrong_ids FROM marked GROUP BY 1""")
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.attempt_totals(_marked(spark, sf_dir)).withColumn("wrong_ids", F.array_join("wrong_ids", ","))


@query(f"""WITH {ANSWERS_SQL}, t AS (SELECT attempt_id, count(*) AS total, count(*) FILTER (is_correct) / count(*)::DOUBLE * 100 AS percentage FROM marked GROUP BY 1)
SELECT learner, count(*) AS attempts, round(avg(percentage), 6) AS mean_percentage, round(max(percentage), 6) AS best_percentage, sum(total)::BIGINT AS questions
FROM attempts JOIN t USING (attempt_id) GROUP BY 1""")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.progress_summary(roles.attempts(spark, sf_dir), scoring.attempt_totals(_marked(spark, sf_dir)))


@query(f"""WITH {ANSWERS_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY moment DESC, attempt_id DESC) AS rank FROM attempts) WHERE rank <= 5""")
def recent_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.newest_attempts(roles.attempts(spark, sf_dir), 5)


@query("SELECT o_orderkey AS attempt_id, o_custkey AS learner, o_orderpriority AS subject, o_orderstatus AS mode, o_orderdate AS moment FROM orders WHERE o_orderkey = 42")
def attempt_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.attempts(spark, sf_dir).filter(F.col("attempt_id") == 42)


_LEDGER = f"""WITH {ANSWERS_SQL}, e AS (SELECT m.*, learner, subject, moment FROM marked m JOIN attempts USING (attempt_id)),
n AS (SELECT *, count(*) FILTER (is_correct) OVER (PARTITION BY learner, subject, question_id ORDER BY moment DESC, attempt_id DESC, position DESC, seq DESC) AS closed FROM e),
ledger AS (SELECT learner, subject, question_id, max(moment) AS last_answered_at, count(*) AS times_wrong FROM n WHERE closed = 0 GROUP BY 1, 2, 3)"""


@query(f"{_LEDGER} SELECT * FROM ledger")
def mistakes_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mistakes_ledger(_events(spark, sf_dir))


@query(f"{_LEDGER} SELECT learner, subject, count(*) AS open_mistakes FROM ledger GROUP BY 1, 2")
def mistake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mistake_counts(scoring.mistakes_ledger(_events(spark, sf_dir)))


@query(f"{_LEDGER} SELECT p_partkey AS question_id, p_name FROM part WHERE p_partkey IN (SELECT question_id FROM ledger)")
def mistakes_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), "p_name")
    return scoring.mistakes_pool(parts, scoring.mistakes_ledger(_events(spark, sf_dir)))


@query(f"WITH {ANSWERS_SQL} SELECT attempt_id, position, question_id, selected, correct FROM marked WHERE NOT is_correct")
def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.wrong_answers(_marked(spark, sf_dir)).select("attempt_id", "position", "question_id", "selected", "correct")


@query(f"""WITH {ANSWERS_SQL}, {QUESTIONS_SQL}, o AS (SELECT position AS qid, unnest(range(0, 4)) AS option_index, unnest(options) AS option_text FROM questions)
SELECT attempt_id, m.position, m.question_id, option_index::INT AS option_index, option_text, option_index = correct AS option_correct, coalesce(option_index = selected, false) AS option_selected
FROM marked m JOIN o ON m.question_id = o.qid""")
def option_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = roles.questions(spark, sf_dir).select(F.col("position").alias("question_id"), "options")
    return scoring.option_rows(bank, _marked(spark, sf_dir)).select("attempt_id", "position", "question_id", "option_index", "option_text", "option_correct", "option_selected")


@query(f"""WITH {ANSWERS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY position, question_id, seq) AS n FROM answers)
SELECT attempt_id, position, question_id, coalesce(group_id <> lag(group_id) OVER (PARTITION BY attempt_id ORDER BY n), true) AS show_passage,
row_number() OVER (PARTITION BY attempt_id, group_id ORDER BY n) AS group_position, count(*) OVER (PARTITION BY attempt_id, group_id) AS group_size FROM numbered""")
def passage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.passage_flags(roles.answers(spark, sf_dir)).select("attempt_id", "position", "question_id", "show_passage", "group_position", "group_size")


_CLICKS = "WITH e AS (SELECT user_id AS attempt_id, (props->>'$.k')::INT AS question_id, event_type AS option, ts AS moment, event_id AS seq FROM events)"


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("attempt_id"), F.get_json_object("props", "$.k").cast("int").alias("question_id"), F.col("event_type").alias("option"), F.col("ts").alias("moment"), F.col("event_id").alias("seq")
    )


@query(_CLICKS + " SELECT attempt_id, question_id, arg_max(option, {'a': moment, 'b': seq}) AS last_option, arg_min(option, {'a': moment, 'b': seq}) AS first_option FROM e GROUP BY 1, 2")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _clicks(spark, sf_dir)
    return scoring.last_answers(events).withColumnRenamed("option", "last_option").join(scoring.last_answers(events, exam=False).withColumnRenamed("option", "first_option"), ["attempt_id", "question_id"])


@query("""WITH a AS (SELECT user_id AS attempt_id, min(ts) AS started, min(ts) FILTER (event_type = 'purchase') AS finished FROM events GROUP BY 1),
d AS (SELECT attempt_id, least(started + INTERVAL 2 DAY, coalesce(finished, TIMESTAMP '9999-12-31')) AS ends FROM a)
SELECT event_id, user_id AS attempt_id, ts AS moment FROM events JOIN d ON user_id = attempt_id WHERE ts <= ends""")
def answers_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("attempt_id"), F.col("ts").alias("moment"), "event_type")
    attempts = rows.groupBy("attempt_id").agg(F.min("moment").alias("started"), F.min(F.when(F.col("event_type") == "purchase", F.col("moment"))).alias("finished")).withColumn("duration_minutes", F.lit(2 * 24 * 60))
    return scoring.within_time(rows, attempts).select("event_id", "attempt_id", "moment")


# ---------------------------------------------------------------- filters and counts


@query(f"WITH {QUESTIONS_SQL} SELECT subject, count(*) AS \"all\", count(*) FILTER (source_type <> 'generated') AS imported, count(*) FILTER (source_type = 'generated') AS generated FROM questions GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_counts(roles.questions(spark, sf_dir), ["subject"])


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, topic FROM questions WHERE source_type <> 'generated' AND source_site = 'brand2.example.org' AND source_year = 2011 AND topic = 'SMALL'")
def filtered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.by_source("imported") & filters.by_metadata("brand2.example.org", 2011) & filters.by_topic("SMALL")
    return roles.questions(spark, sf_dir).filter(kept).select("question_id", "topic")


_BLOCK = "len(list_intersect(tags, ['needs_manual_review','needs_answer_review','parse_error'])) > 0"


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, reviewed AND source_type = 'generated' AND source_url IS NULL AND NOT {_BLOCK} AS generated_candidate,
reviewed AND source_type = 'public_source' AND trim(coalesce(source_url, '')) <> '' AND NOT {_BLOCK} AS imported_candidate FROM questions""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.questions(spark, sf_dir).select("question_id", filters.is_generated_candidate().alias("generated_candidate"), filters.is_imported_candidate().alias("imported_candidate"))


@query("""WITH r AS (SELECT user_id, event_type AS mode, (props->>'$.k') AS count, CASE WHEN user_id % 2 = 0 THEN 'exam_set' ELSE event_type END AS selection,
CASE user_id % 3 WHEN 0 THEN 'generated' WHEN 1 THEN 'imported' ELSE 'x' END AS source, event_id FROM events)
SELECT event_id, 'practice' AS mode, CASE WHEN count::DOUBLE > 0 THEN floor(count::DOUBLE)::BIGINT ELSE 20 END AS count, CASE WHEN selection = 'exam_set' THEN selection ELSE 'random' END AS selection,
CASE WHEN source IN ('generated', 'imported') THEN source ELSE 'all' END AS source FROM r""")
def coerced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = roles.read(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("mode"),
        F.get_json_object("props", "$.k").alias("count"),
        F.when(F.col("user_id") % 2 == 0, "exam_set").otherwise(F.col("event_type")).alias("selection"),
        F.when(F.col("user_id") % 3 == 0, "generated").when(F.col("user_id") % 3 == 1, "imported").otherwise("x").alias("source"),
        F.lit(20).alias("default_count"),
    )
    return filters.coerce_requests(raw).select("event_id", "mode", "count", "selection", "source")


@query("""SELECT c_custkey AS id, mode, CASE WHEN mode = 'mistakes' THEN greatest(1, a) WHEN mode = 'exam' THEN least(coalesce(x, 20), greatest(1, a)) ELSE least(20, greatest(1, a)) END::BIGINT AS question_count,
CASE WHEN mode = 'exam' THEN coalesce(m, 30) ELSE 30 END::BIGINT AS duration_minutes FROM (SELECT c_custkey, ['practice','exam','mistakes'][(c_custkey % 3 + 1)::INT] AS mode, c_nationkey AS a,
CASE WHEN c_custkey % 2 = 0 THEN 30 END AS x, CASE WHEN c_custkey % 5 = 0 THEN 75 END AS m FROM customer)""")
def setup_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    setups = roles.read(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.element_at(F.array(*map(F.lit, filters.MODES)), (k % 3 + 1).cast("int")).alias("mode"),
        F.col("c_nationkey").alias("available"),
        F.lit(20).alias("recommended"),
        F.when(k % 2 == 0, 30).alias("exam_count"),
        F.lit(None).cast("int").alias("minutes"),
        F.when(k % 5 == 0, 75).alias("exam_minutes"),
    )
    return filters.setup_defaults(setups).select("id", "mode", "question_count", "duration_minutes")


@query(f"""WITH {QUESTIONS_SQL} SELECT subject, CASE WHEN source_type = 'generated' THEN 'generated' ELSE 'imported' END AS source, topic, source_site AS site, source_year::VARCHAR AS year, count(*) AS available
FROM questions GROUP BY subject, CUBE (CASE WHEN source_type = 'generated' THEN 'generated' ELSE 'imported' END, topic, source_site, source_year::VARCHAR)""")
def availability_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.availability(roles.questions(spark, sf_dir))


@query(f"""WITH {QUESTIONS_SQL}, q AS (SELECT *, CASE WHEN source_type = 'generated' THEN 'generated' ELSE 'imported' END AS source FROM questions),
r AS (SELECT c_custkey AS request_id, ['tznk','english','management','psychology-sociology'][(c_custkey % 4 + 1)::INT] AS subject, CASE c_custkey % 3 WHEN 1 THEN 'imported' WHEN 2 THEN 'generated' END AS source,
  CASE WHEN c_custkey % 2 = 0 THEN p_type END AS topic, CASE WHEN c_custkey % 5 = 0 THEN 2000 + c_custkey % 25 END AS year FROM customer LEFT JOIN part ON p_partkey = c_custkey)
SELECT r.request_id, count(q.position) AS available FROM r LEFT JOIN q ON q.subject = r.subject AND coalesce(r.source, q.source) = q.source AND coalesce(r.topic, q.topic) = q.topic AND coalesce(r.year, q.source_year) = q.source_year GROUP BY 1""")
def availability_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests for questions of a subject and, some of them, of a source, topic or year; counted by bitmaps."""
    questions = roles.questions(spark, sf_dir).withColumn("source", F.when(F.col("source_type") == "generated", "generated").otherwise("imported"))
    bitmaps = metrics.facet_bitmaps(questions.withColumnRenamed("source_year", "year"), ["subject", "source", "topic", "year"], "position")
    k = F.col("c_custkey")
    topics = roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), "p_type")
    subject = F.element_at(F.array(*map(F.lit, roles.SUBJECTS)), (k % 4 + 1).cast("int"))
    wanted = {"subject": subject, "source": F.when(k % 3 == 1, "imported").when(k % 3 == 2, "generated"), "topic": F.when(k % 2 == 0, F.col("p_type")), "year": F.when(k % 5 == 0, (2000 + k % 25).cast("string"))}
    rows = roles.read(spark, sf_dir, "customer").select("c_custkey").join(topics, "c_custkey", "left")
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in wanted.items())))
    requests = rows.select(k.alias("request_id"), pairs.alias("p")).select("request_id", "p.*").filter("value IS NOT NULL")
    return metrics.available(bitmaps, requests)


@query(f"""WITH {QUESTIONS_SQL} SELECT 'topic' AS facet, topic AS value, min(position) AS rank FROM questions GROUP BY 1, 2
UNION ALL SELECT 'site', source_site, count(*) FROM questions GROUP BY 1, 2
UNION ALL SELECT 'year', source_year::VARCHAR, row_number() OVER (ORDER BY source_year) FROM questions GROUP BY source_year""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = roles.questions(spark, sf_dir)
    years = metrics.facet(bank, "source_year")  # a few dozen rows: the ranking may meet in one task
    rank = F.row_number().over(Window.orderBy(F.col("number").asc_nulls_last(), "value"))
    return (
        metrics.facet(bank, "topic", "position").select(F.lit("topic").alias("facet"), "value", F.col("first_seen").alias("rank"))
        .unionByName(metrics.facet(bank, "source_site").select(F.lit("site").alias("facet"), "value", F.col("n").alias("rank")))
        .unionByName(years.select(F.lit("year").alias("facet"), "value", rank.cast("long").alias("rank")))
    )


@query(f"WITH {QUESTIONS_SQL} SELECT subject, count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER ({_BLOCK}) AS blocked FROM questions GROUP BY ROLLUP (subject)")
def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_rollup(roles.questions(spark, sf_dir), "subject", reviewed=F.col("reviewed"), blocked=filters.is_blocked())


@query(f"""WITH {QUESTIONS_SQL}, f AS (SELECT difficulty, count(*) AS found FROM questions GROUP BY 1), e AS (SELECT * FROM (VALUES ('easy', 500), ('medium', 1100), ('hard', 400)) t(difficulty, expected))
SELECT coalesce(f.difficulty, e.difficulty) AS difficulty, coalesce(found, 0) AS found, coalesce(expected, 0)::BIGINT AS expected FROM f FULL JOIN e ON f.difficulty = e.difficulty WHERE coalesce(found, 0) <> coalesce(expected, 0)""")
def distribution_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("easy", 500), ("medium", 1100), ("hard", 400)], "difficulty string, expected long")
    return metrics.distribution_gaps(roles.questions(spark, sf_dir), "difficulty", expected)


@query(f"""WITH {QUESTIONS_SQL} SELECT subject, source_type, difficulty, count(*) AS n FROM questions GROUP BY 1, 2, 3""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_by(roles.questions(spark, sf_dir), "subject", "source_type", "difficulty")
