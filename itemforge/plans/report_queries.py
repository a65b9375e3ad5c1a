"""Queries of orders, reports, simple and third-party merges, and sources.

Where a rule needs Ukrainian text, short fixed texts are mixed into the tables, in the query and in its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators import filters, grouping, merge, metrics, order, review
from itemforge.plans import enrichment, extraction, roles
from itemforge.plans.bank_queries import _CONVERSATIONS, _conversations
from itemforge.plans.define import Queries
from itemforge.plans.quiz_queries import _SETS, LEAST, _bank, _units
from itemforge.plans.review_queries import _ANCHORS
from itemforge.plans.roles import QUESTIONS_SQL, normal_sql

query = Queries()

_TOPICS = ("Їжа", "Ґрунт", "Гроші", "Єдність", "інше", "Apple", "Інше")
_TOPICS_SQL = "['Їжа','Ґрунт','Гроші','Єдність','інше','Apple','Інше']"
_UK = f"{QUESTIONS_SQL}, uk AS (SELECT * REPLACE ({_TOPICS_SQL}[(position % 7 + 1)::INT] AS topic) FROM questions)"


def _uk(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.element_at(F.array(*map(F.lit, _TOPICS)), (F.col("position") % 7 + 1).cast("int"))
    return roles.questions(spark, sf_dir).withColumn("topic", topic)


# ---------------------------------------------------------------- orders


@query(f"WITH {_UK} SELECT question_id, topic, row_number() OVER (ORDER BY subject COLLATE uk, source_type COLLATE uk, topic COLLATE uk, question_id COLLATE uk) - 1 AS place FROM uk")
def bank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_places(_uk(spark, sf_dir), *order.bank_order()).select("question_id", "topic", "place")


@query(f"""WITH {_CONVERSATIONS} SELECT 'group' AS what, group_id AS id, row_number() OVER (ORDER BY subject COLLATE uk, group_id COLLATE uk) - 1 AS place FROM groups
UNION ALL SELECT 'exam_set', s_suppkey::VARCHAR, row_number() OVER (ORDER BY {_TOPICS_SQL}[s_nationkey % 3 + 1] COLLATE uk, s_name COLLATE uk) - 1 FROM supplier""")
def group_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = order.with_places(_conversations(spark, sf_dir)[0].select("group_id", "subject"), *order.group_order())
    subject = F.element_at(F.array(*map(F.lit, _TOPICS)), F.col("s_nationkey") % 3 + 1)
    sets = roles.read(spark, sf_dir, "supplier").select("s_suppkey", subject.alias("subject"), F.col("s_name").alias("title"))
    sets = order.with_places(sets, *order.exam_set_order())
    return groups.select(F.lit("group").alias("what"), F.col("group_id").alias("id"), "place").unionByName(sets.select(F.lit("exam_set").alias("what"), F.col("s_suppkey").cast("string").alias("id"), "place"))


@query(f"WITH {_UK} SELECT topic, n, row_number() OVER (ORDER BY topic COLLATE uk, topic) - 1 AS place FROM (SELECT topic, count(*) AS n FROM uk GROUP BY 1)")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.label_counts(_uk(spark, sf_dir), "topic")


@query(f"""WITH {QUESTIONS_SQL}, bad AS (SELECT * FROM questions WHERE trim(explanation) = '' OR list_contains(tags, 'needs_manual_review'))
SELECT 'all' AS list, question_id FROM (SELECT question_id FROM bad ORDER BY position LIMIT 20) UNION ALL
SELECT subject, question_id FROM (SELECT subject, question_id, row_number() OVER (PARTITION BY subject ORDER BY position) AS n FROM bad) WHERE n <= 12""")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 questionable rows of the bank, and the first 12 of each subject."""
    bad = roles.questions(spark, sf_dir).filter((F.trim("explanation") == "") | filters.has_tag("needs_manual_review"))
    every = order.first_examples(bad, 20, "position").select(F.lit("all").alias("list"), "question_id")
    return every.unionByName(order.first_examples(bad, 12, "position", by="subject").select(F.col("subject").alias("list"), "question_id"))


# ---------------------------------------------------------------- sources, sets


@query("""SELECT s_suppkey AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'official_demo' ELSE 'public_source' END AS source_type FROM supplier WHERE s_suppkey % 4 = 1""")
def included_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources of several kinds, one in four of them included."""
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, "official_demo").when(k % 3 == 1, "official_past_exam").otherwise("official_collection")
    status = F.when(k % 4 == 1, "include").when(k % 4 == 2, "skip").when(k % 4 == 3, "manual")
    sources = roles.read(spark, sf_dir, "supplier").select(k.alias("source"), raw.alias("raw"), status.alias("status"))
    return sources.filter(filters.is_included()).select("source", filters.question_source_type(F.col("raw")).alias("source_type"))


@query(f"""WITH {_SETS} SELECT set_id, count(*) AS questions, count(DISTINCT group_id) AS groups FROM (
SELECT u.set_id, u.group_id FROM units u WHERE u.type = 'question' UNION ALL SELECT u.set_id, u.group_id FROM units u JOIN members m ON u.group_id = m.group_id) GROUP BY 1""")
def exam_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    members = grouping.group_members(bank, LEAST)
    return grouping.set_sizes(_units(bank, members), members)


# ---------------------------------------------------------------- merges without near duplicates, and of imports


def _fold_sql(candidate: str, valid: str) -> str:
    """Decisions of a merge of odd documents into even ones, by a walk over those that conflict."""
    return f"""x AS (SELECT doc_id AS id, lang AS subject, 'q' || CASE WHEN doc_id % 9 = 1 THEN doc_id // 90 ELSE doc_id END AS question_id, {normal_sql('text')} AS n, {candidate} AS candidate, {valid} AS valid, 'part-' || doc_id % 6 AS file FROM documents),
pairs AS (SELECT a.id AS low, b.id AS high, CASE WHEN a.question_id = b.question_id THEN 0 ELSE 1 END AS why, a.id % 2 = 0 AS bank FROM x a JOIN x b ON b.id % 2 = 1 AND b.candidate AND b.valid AND (a.id % 2 = 0 OR a.id < b.id AND a.candidate AND a.valid)
  AND (a.question_id = b.question_id OR a.subject = b.subject AND a.n = b.n)),
todo AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM x WHERE id % 2 = 1 AND candidate AND valid AND (id IN (SELECT high FROM pairs) OR id IN (SELECT low FROM pairs)) AND id NOT IN (SELECT high FROM pairs WHERE bank)),
walk AS (SELECT 0 AS i, []::BIGINT[] AS taken UNION ALL SELECT w.i + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs c WHERE c.high = t.id AND NOT c.bank AND list_contains(w.taken, c.low)) THEN w.taken ELSE list_append(w.taken, t.id) END FROM walk w JOIN todo t ON t.i = w.i + 1),
taken AS (SELECT unnest(taken) AS id FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1)),
why AS (SELECT high AS id, min(why) AS why FROM pairs WHERE bank OR low IN (SELECT id FROM taken) GROUP BY 1),
decisions AS (SELECT x.*, CASE WHEN NOT candidate THEN 'not_reviewed_or_blocked' WHEN NOT valid THEN 'invalid_structure' WHEN why = 0 THEN 'duplicate_id' WHEN why = 1 THEN 'duplicate_question_text' END AS reason FROM x LEFT JOIN why ON x.id = why.id WHERE x.id % 2 = 1)"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("id")
    rows = roles.texts(spark, sf_dir).withColumns({"question_id": F.concat(F.lit("q"), F.when(k % 9 == 1, F.floor(k / 90)).otherwise(k).cast("string")), "file": F.concat(F.lit("part-"), (k % 6).cast("string"))})
    return rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")


_SIMPLE = _fold_sql("true", "true")


@query(f"""WITH RECURSIVE {_SIMPLE}, merged AS (SELECT id, subject, question_id FROM x WHERE id % 2 = 0 UNION ALL SELECT id, subject, question_id FROM decisions WHERE reason IS NULL)
SELECT id, row_number() OVER (ORDER BY subject COLLATE uk, question_id COLLATE uk, id) - 1 AS place FROM merged""")
def simple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that neither an id nor a text of the bank precedes join it; the whole in bank order."""
    staged, bank = _halves(spark, sf_dir)
    whole = merge.merged_bank(merge.simple_merge(staged, bank), staged, bank)
    return order.with_places(whole.select("id", "subject", "question_id"), order.collated("subject"), order.collated("question_id"), "id").select("id", "place")


_THIRD = _fold_sql("doc_id % 5 <> 0 AND doc_id % 7 <> 1 AND doc_id % 8 <> 3", "doc_id % 11 <> 0")


def _third_party(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Odd documents as reviewed imports: some unreviewed, some without address, some blocked, some unsound."""
    staged, bank = _halves(spark, sf_dir)
    k = F.col("id")
    staged = staged.withColumns({
        "reviewed": k % 5 != 0, "source_type": F.lit("public_source"), "source_url": F.when(k % 7 != 1, "https://h/"), "tags": F.when(k % 8 == 3, F.array(F.lit("parse_error"))), "valid": k % 11 != 0,
    })
    return staged.withColumn("candidate", filters.is_imported_candidate()), bank


@query(f"WITH RECURSIVE {_THIRD} SELECT id, reason, reason IS NOT NULL AND reason NOT IN ('duplicate_id', 'duplicate_question_text') AS retained FROM decisions")
def third_party_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known ids and texts leave the staging, whatever else is skipped stays in it."""
    decisions = merge.merge_decisions(*_third_party(spark, sf_dir), near=False)
    kept = merge.retained(decisions, drop_duplicates=True).select("id", F.lit(True).alias("kept"))
    return decisions.join(kept, "id", "left").select("id", "reason", F.coalesce("kept", F.lit(False)).alias("retained"))


@query(f"WITH RECURSIVE {_THIRD} SELECT file, count(*) AS before, count(*) FILTER (reason IS NULL) AS merged, count(reason) AS left FROM decisions GROUP BY 1")
def merge_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged, bank = _third_party(spark, sf_dir)
    return merge.file_stats(merge.merge_decisions(staged, bank, near=False), staged)


# ---------------------------------------------------------------- reviews of generated batches as a whole

_TOPIC_LIST = ["SMALL", "LARGE", "PROMO"]
#: Every fifth row is dressed as one that passes all rules, so that rows are accepted, too.
_SOUND_TEXTS = {"source_type": "generated", "topic": "SMALL", "passage": "a short text", "explanation": "The text names the first of them, and the other three belong to different groups."}
_SOUND_OPTIONS = ("first answer", "second answer", "third answer", "fourth answer")
_SOUND = f"""* REPLACE ({", ".join(f"CASE WHEN position % 5 = 1 THEN '{v}' ELSE {c} END AS {c}" for c, v in _SOUND_TEXTS.items())}, CASE WHEN position % 5 = 1 THEN NULL ELSE source_url END AS source_url,
CASE WHEN position % 5 = 1 THEN {list(_SOUND_OPTIONS)} ELSE options END AS options, CASE WHEN position % 5 = 1 THEN 'sound question ' || position ELSE question END AS question)"""


def _sound(rows: DataFrame) -> DataFrame:
    fifth = F.col("position") % 5 == 1
    dressed = {c: F.when(fifth, v).otherwise(F.col(c)) for c, v in _SOUND_TEXTS.items()}
    return rows.withColumns(dressed | {
        "source_url": F.when(~fifth, F.col("source_url")), "options": F.when(fifth, F.array(*map(F.lit, _SOUND_OPTIONS))).otherwise(F.col("options")),
        "question": F.when(fifth, F.concat(F.lit("sound question "), F.col("position").cast("string"))).otherwise(F.col("question")),
    })


_IDS = "^[a-z-]+[0-9]*[1-8]$"  # ids that end in 0 or 9 are not of the batch
_RULES = f"""CASE WHEN NOT regexp_matches(question_id, '{_IDS}') THEN 'id does not match the batch pattern' END, CASE WHEN source_type <> 'generated' THEN 'sourceType is not generated' END, CASE WHEN source_url IS NOT NULL THEN 'sourceUrl must be null for generated questions' END,
CASE WHEN topic NOT IN ('SMALL', 'LARGE', 'PROMO') THEN 'topic is outside expected subject coverage' END,
CASE WHEN len(list_distinct(list_transform(options, lambda x: {normal_sql('x')}))) < 4 THEN 'duplicate options inside question' END,
CASE WHEN trim(explanation) = '' THEN 'explanation is empty' WHEN length(explanation) < 45 THEN 'explanation is too weak or does not clearly justify the answer' END,
CASE WHEN regexp_matches(question || ' ' || explanation, '(?i)widget') AND NOT regexp_matches(options[(correct + 1)::INT], '(?i)small') THEN 'a widget is small' WHEN regexp_matches(question || ' ' || explanation, '(?i)ring') AND NOT regexp_matches(options[(correct + 1)::INT], '(?i)ring|red') THEN 'a ring is a ring' END"""
_DUPLICATES = f"""sound AS (SELECT {_SOUND} FROM questions),
known AS (SELECT subject, {normal_sql('question')} AS n, max('k' || position) AS m FROM sound WHERE position % 10 = 0 GROUP BY 1, 2),
batch AS (SELECT * FROM sound WHERE position % 10 <> 0)"""


def _known_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One part in ten as the bank, the others as the batch under review."""
    rows = _sound(roles.questions(spark, sf_dir))
    known = rows.filter("position % 10 = 0").select(F.concat(F.lit("k"), F.col("position").cast("string")).alias("id"), "subject", F.col("question").alias("text"))
    return known, rows.filter("position % 10 <> 0")


@query(f"""WITH {QUESTIONS_SQL}, {_DUPLICATES},
d AS (SELECT b.*, k.m, lag(question_id) OVER (PARTITION BY b.subject, {normal_sql('question')} ORDER BY question_id) AS p FROM batch b LEFT JOIN known k ON b.subject = k.subject AND {normal_sql('question')} = k.n),
r AS (SELECT *, list_filter([{_RULES}, CASE WHEN m IS NOT NULL THEN 'exact duplicate of ' || m WHEN p IS NOT NULL THEN 'batch duplicate of ' || p END], lambda r: r IS NOT NULL) AS reasons FROM d)
SELECT question_id, array_to_string(reasons, ';') AS reasons, subject <> 'english' AND len(reasons) = 0 AS reviewed, subject = 'english' OR len(reasons) > 0 AS flagged FROM r""")
def generated_batch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, anchors and duplicates of a batch a subject, each with a gate over its difficulties: one row too many is expected of english, which so does not pass."""
    known, batch = _known_and_batch(spark, sf_dir)
    decisions = review.review_generated(batch, known, _IDS, _TOPIC_LIST, _ANCHORS)
    expected = batch.groupBy("subject", "difficulty").agg(F.count("*").alias("n")).select("subject", "difficulty", (F.col("n") + (F.col("subject") == "english").cast("long")).alias("expected"))
    out = None
    for subject in roles.SUBJECTS:
        of = F.col("subject") == subject
        gated = review.with_gate(decisions.filter(of), metrics.distribution_gaps(batch.filter(of), "difficulty", expected.filter(of).drop("subject")))
        out = gated if out is None else out.unionByName(gated)
    return out.select("question_id", F.array_join("reasons", ";").alias("reasons"), "reviewed", F.array_contains("tags", "needs_manual_review").alias("flagged"))


_DOMAIN = """uk0 AS (SELECT * REPLACE (CASE WHEN position % 3 = 0 THEN 'Чому поняття «' || passage || '» важливе' WHEN position % 3 = 1 THEN 'У завданні наведено опис: ' || passage ELSE question END AS question,
  CASE WHEN position % 5 = 1 THEN list_append(tags, 'self_checked_single_answer') ELSE tags END AS tags, CASE WHEN position % 4 = 0 THEN ['Послідовності', 'Критичне читання', 'Інше'][(position % 3 + 1)::INT] WHEN position % 4 = 1 THEN ['Vocabulary', 'Grammar', 'Reading'][(position % 3 + 1)::INT] ELSE topic END AS topic,
  CASE WHEN position % 9 = 2 THEN '' ELSE passage END AS passage, CASE WHEN position % 12 = 5 THEN 'Purpose' ELSE subtopic END AS subtopic) FROM questions)"""


def _domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("position")
    of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int"))
    return roles.questions(spark, sf_dir).withColumns({
        "question": F.when(k % 3 == 0, F.concat(F.lit("Чому поняття «"), F.col("passage"), F.lit("» важливе"))).when(k % 3 == 1, F.concat(F.lit("У завданні наведено опис: "), F.col("passage"))).otherwise(F.col("question")),
        "tags": F.when(k % 5 == 1, F.array_append("tags", F.lit("self_checked_single_answer"))).otherwise(F.col("tags")),
        "topic": F.when(k % 4 == 0, of("Послідовності", "Критичне читання", "Інше")).when(k % 4 == 1, of("Vocabulary", "Grammar", "Reading")).otherwise(F.col("topic")),
        "passage": F.when(k % 9 == 2, "").otherwise(F.col("passage")),
        "subtopic": F.when(k % 12 == 5, "Purpose").otherwise(F.col("subtopic")),
    })


#: A text of 40 words, so that two that differ in one more word are near duplicates.
_LONG = " ".join(f"w{i}" for i in range(40))

_REWRITTEN = f"""{_DOMAIN}, uk1 AS (SELECT {_SOUND} FROM uk0), patched AS (SELECT * REPLACE (CASE WHEN position % 50 = 0 THEN '{_LONG} ' || position ELSE question END AS question), question AS old FROM uk1),
known AS (SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda t: t <> '') AS t FROM (SELECT subject, id, {normal_sql('text')} AS n FROM
  (SELECT subject, 'k' || position AS id, question AS text FROM uk1 WHERE position % 7 = 0 UNION ALL SELECT subject, 'n' || position, '{_LONG} old' || position FROM uk1 WHERE position % 100 = 0))),
exact AS (SELECT subject, n, max(id) AS m FROM known GROUP BY 1, 2),
forms AS (SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda t: t <> '') AS t FROM (SELECT question_id, subject, {normal_sql('question')} AS n FROM patched)),
near AS (SELECT question_id, min(b.id) AS near_id FROM forms a JOIN known b ON a.subject = b.subject AND least(length(a.n), length(b.n)) >= 80 AND least(length(a.n), length(b.n)) >= 0.9 * greatest(length(a.n), length(b.n))
  WHERE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.94 GROUP BY 1),
hard AS (SELECT *, CASE subject WHEN 'tznk' THEN CASE WHEN topic = 'Послідовності' THEN 'easy' WHEN topic = 'Критичне читання' THEN 'hard' ELSE 'medium' END
  WHEN 'english' THEN CASE WHEN topic = 'Vocabulary' THEN 'easy' WHEN topic = 'Grammar' OR subtopic = 'Purpose' THEN 'medium' ELSE 'easy' END
  ELSE CASE WHEN starts_with(question, 'У завданні наведено опис') THEN 'easy' WHEN starts_with(question, 'Чому поняття') THEN 'hard' ELSE 'medium' END END AS wanted FROM patched),
lagged AS (SELECT hard.*, m, near_id, lag(question_id) OVER (PARTITION BY hard.subject, {normal_sql('question')} ORDER BY question_id) AS p FROM hard
  LEFT JOIN exact ON hard.subject = exact.subject AND {normal_sql('question')} = exact.n LEFT JOIN near USING (question_id)),
domain AS (SELECT *, question <> old OR difficulty <> wanted AS rewritten, list_filter([CASE WHEN NOT regexp_matches(question_id, '{_IDS}') THEN 'id does not match the batch pattern' END, CASE WHEN source_type <> 'generated' THEN 'sourceType is not generated' END, CASE WHEN source_url IS NOT NULL THEN 'sourceUrl must be null for generated questions' END,
  CASE WHEN topic NOT IN ('SMALL', 'Послідовності', 'Vocabulary') THEN 'topic is outside expected subject coverage' END,
  CASE WHEN len(list_distinct(list_transform(options, lambda x: {normal_sql('x')}))) < 4 THEN 'duplicate options inside question' END,
  CASE WHEN trim(explanation) = '' THEN 'explanation is empty' WHEN length(explanation) < 45 THEN 'explanation is too weak or does not clearly justify the answer' END,
  CASE WHEN m IS NOT NULL THEN 'exact duplicate of ' || m WHEN p IS NOT NULL THEN 'batch duplicate of ' || p WHEN near_id IS NOT NULL THEN 'near duplicate of ' || near_id END,
  CASE WHEN subject = 'tznk' AND NOT list_contains(tags, 'self_checked_single_answer') THEN 'not checked for a single answer' END,
  CASE WHEN subject = 'tznk' AND type = 'passage_single_choice' AND trim(passage) = '' THEN 'reasoning question without its passage' END,
  CASE WHEN subject = 'english' AND type = 'passage_single_choice' AND trim(passage) = '' THEN 'reading question without its passage' END,
  CASE WHEN subject = 'english' AND regexp_matches(question, '[А-ЯІЇЄҐа-яіїєґ]') THEN 'Cyrillic letters in an English question' END,
  CASE WHEN subject IN ('management', 'psychology-sociology') AND starts_with(question, 'Чому поняття') THEN 'distractors of a rationale item need an editor' END], lambda r: r IS NOT NULL) AS reasons FROM lagged)"""


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sound(_domain(spark, sf_dir))
    k = F.col("position").cast("string")
    patch = rows.filter("position % 50 = 0").select("question_id", F.concat(F.lit(f"{_LONG} "), k).alias("question"))
    known = rows.filter("position % 7 = 0").select(F.concat(F.lit("k"), k).alias("id"), "subject", F.col("question").alias("text"))
    known = known.unionByName(rows.filter("position % 100 = 0").select(F.concat(F.lit("n"), k).alias("id"), "subject", F.concat(F.lit(f"{_LONG} old"), k).alias("text")))
    return review.review_rewritten(rows, patch, ["question"], known, _IDS, ["SMALL", "Послідовності", "Vocabulary"], [])


@query(f"""WITH {QUESTIONS_SQL}, {_REWRITTEN} SELECT question_id, wanted AS difficulty, rewritten, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS reviewed,
array_to_string(list_concat(list_filter(tags, lambda t: t <> 'needs_manual_review'), CASE WHEN len(reasons) > 0 THEN ['needs_manual_review'] ELSE [] END), ',') AS tags FROM domain""")
def rewritten_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir).select("question_id", "difficulty", "rewritten", F.array_join("reasons", ";").alias("reasons"), "reviewed", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {QUESTIONS_SQL}, {_REWRITTEN} SELECT subject, count(*) FILTER (rewritten) AS rewritten, count(*) AS total, count(*) FILTER (len(reasons) = 0) AS reviewed, count(*) FILTER (len(reasons) > 0) AS needs_review,
count(m) AS exact_duplicates, count(p) FILTER (m IS NULL) AS batch_duplicates, count(near_id) FILTER (m IS NULL AND p IS NULL) AS near_duplicates FROM domain GROUP BY ROLLUP (subject)""")
def rewritten_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_summary(_rewritten(spark, sf_dir))


@query(f"""WITH {QUESTIONS_SQL}, {_REWRITTEN}, t AS (SELECT len(reasons) = 0 AS reviewed, unnest(['self_checked_single_answer', 'year 2010', 'year 2011']) AS tag, tags FROM domain)
SELECT tag, count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (NOT reviewed) AS needs_review FROM t WHERE list_contains(tags, tag) GROUP BY 1""")
def review_tag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.tag_totals(_rewritten(spark, sf_dir), ["self_checked_single_answer", "year 2010", "year 2011"])


_READING = ("What does the passage imply?", "The main focus is", "Which word describes it?", "Where is it?")


@query(f"""WITH {QUESTIONS_SQL}, f AS (SELECT *, ['What does the passage imply?', 'The main focus is', 'Which word describes it?', 'Where is it?'][(position % 4 + 1)::INT] AS q, CASE WHEN position % 3 = 0 THEN 'Reading comprehension' ELSE topic END AS t FROM questions),
g AS (SELECT *, CASE WHEN position % 40 = 3 THEN 'Which idea is supported?' ELSE q END AS q2 FROM f),
h AS (SELECT *, CASE WHEN t <> 'Reading comprehension' THEN subtopic WHEN q2 = 'The main focus is' THEN 'Main idea' WHEN q2 IN ('What does the passage imply?', 'Which idea is supported?') THEN 'Inference' WHEN q2 = 'Which word describes it?' THEN 'Vocabulary in context' ELSE 'Detail understanding' END AS s FROM g),
i AS (SELECT *, ((row_number() OVER (PARTITION BY subject ORDER BY position) - 1) % 4)::INT AS target FROM h)
SELECT question_id, position % 40 = 3 AS rewritten, s AS subtopic, s <> subtopic AS subtopic_changed, NOT list_contains(tags, 'needs_manual_review') AS reviewed, target AS correct, correct <> target AS changed FROM i""")
def first_batch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("position")
    rows = roles.questions(spark, sf_dir).withColumns({"question": F.element_at(F.array(*map(F.lit, _READING)), (k % 4 + 1).cast("int")), "topic": F.when(k % 3 == 0, "Reading comprehension").otherwise(F.col("topic"))})
    patch = rows.filter("position % 40 = 3").select("question_id", F.lit("Which idea is supported?").alias("question"))
    out = review.review_first_batch(rows, patch, ["question"], extraction.generated_reading_subtopic(F.col("question")), "Reading comprehension", "position")
    return out.select("question_id", "rewritten", "subtopic", "subtopic_changed", "reviewed", F.col("correct").cast("int").alias("correct"), "changed")


# ---------------------------------------------------------------- candidates of enrichment


@query(f"""WITH {QUESTIONS_SQL}, c AS (SELECT *, CASE WHEN position % 13 = 0 THEN ' ' ELSE question_id END AS id, CASE WHEN position % 17 = 0 THEN '' ELSE passage END AS p, CASE WHEN position % 19 = 0 THEN 7 ELSE correct END AS a FROM questions WHERE subject IN ('english', 'tznk'))
SELECT 'candidate' AS entity, id AS entity_id, rule, '' AS detail FROM (SELECT id, unnest([CASE WHEN trim(id) = '' THEN 'empty id' END, CASE WHEN subject <> 'english' THEN 'subject is not expected' END, CASE WHEN p = '' THEN 'empty passage' END,
CASE WHEN a = 7 THEN 'answer references no option' END, CASE WHEN type = 'passage_single_choice' AND p = '' THEN 'passage is required' END]) AS rule FROM c) WHERE rule IS NOT NULL""")
def candidate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("position")
    rows = roles.questions(spark, sf_dir).filter(F.col("subject").isin("english", "tznk"))
    rows = rows.withColumns({"id": F.when(k % 13 == 0, " ").otherwise(F.col("question_id")), "passage": F.when(k % 17 == 0, "").otherwise(F.col("passage")), "correct": F.when(k % 19 == 0, 7).otherwise(F.col("correct"))})
    return enrichment.candidate_rules(rows, ("english",))


@query(f"""WITH {QUESTIONS_SQL}, a AS (SELECT * FROM questions WHERE position % 3 = 0 AND position % 2 = 0) SELECT subject, count(*) AS applied, count(DISTINCT topic) AS changed_files FROM a GROUP BY 1""")
def applied_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third question has an output, those with even places were accepted; topics stand for files."""
    bank = roles.questions(spark, sf_dir).withColumns({"path": F.col("topic"), "by_option": F.lit(None).cast("array<string>")})
    accepted = bank.filter("position % 3 = 0 AND position % 2 = 0").select(F.col("question_id").alias("id"), F.lit("new").alias("improved"), F.array().cast("array<string>").alias("by_option"), F.array(F.lit("t")).alias("tags"))
    return enrichment.applied_stats(enrichment.apply_outputs(bank, accepted))


@query(f"""WITH {QUESTIONS_SQL}, i AS (SELECT subject, position // 350 + 1 AS chunk FROM questions GROUP BY 1, 2)
SELECT 'retry' AS index, max(chunk) AS chunk FROM i WHERE chunk % 2 = 1 UNION ALL SELECT 'sent', max(chunk) + 1 FROM i UNION ALL SELECT 'empty', 1""")
def next_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next chunk where odd chunks are unsent retries, where all were sent, and where there is none."""
    chunk = F.floor(F.col("position") / 350) + 1
    index = enrichment.chunk_index(roles.questions(spark, sf_dir).select(chunk.alias("chunk"), F.col("position").alias("place")))
    retry = enrichment.next_chunk(index.withColumn("retry", F.col("chunk") % 2 == 1))
    sent = enrichment.next_chunk(index.withColumns({"retry": F.lit(True), "status": F.lit("submitted")}))
    none = enrichment.next_chunk(index.limit(0).withColumn("retry", F.lit(False)))
    name = lambda rows, n: rows.select(F.lit(n).alias("index"), "chunk")
    return name(retry, "retry").unionByName(name(sent, "sent")).unionByName(name(none, "empty"))
