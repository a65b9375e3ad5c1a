"""Queries of quality flags, reviews and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import quality, text
from itemforge.operators import metrics, review
from itemforge.plans import extraction, generation, roles
from itemforge.plans.define import Queries
from itemforge.plans.roles import QUESTIONS_SQL, normal_sql

query = Queries()


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
t AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*\\d+[.)]\\s+') THEN 'numbered-list' WHEN regexp_matches(line, '^\\s*[-*•]\\s+') THEN 'bulleted-list' ELSE 'text' END AS kind FROM l)
SELECT doc_id, n AS line_number, kind, sum(CASE WHEN kind IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS segment FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM t)""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by type, and the run of equal types that each is in (a heading is a run of its own)."""
    from pyspark.sql import Window

    lines = roles.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    kinds = lines.withColumn("kind", quality.line_type(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("line_number")
    new = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    return kinds.withColumn("new", new.cast("int")).select("doc_id", "line_number", "kind", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


_MIXED = "text || CASE doc_id % 3 WHEN 0 THEN repeat('Їжак живе у лісі. ', 20) WHEN 1 THEN repeat('Слово ', 400) ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, {_MIXED} AS text FROM documents), n AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{{Cyrillic}}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) AS latin FROM d)
SELECT *, cyrillic >= 120 AND cyrillic >= 0.35 * (cyrillic + latin) AS mostly_cyrillic FROM n""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    t = F.concat("text", F.when(k == 0, F.repeat(F.lit("Їжак живе у лісі. "), 20)).when(k == 1, F.repeat(F.lit("Слово "), 400)).otherwise(""))
    return roles.read(spark, sf_dir, "documents").select("doc_id", text.script_letters(t, "Cyrillic").cast("long").alias("cyrillic"), text.script_letters(t, "Latin").cast("long").alias("latin"), text.mostly_cyrillic(t).alias("mostly_cyrillic"))


#: Explanations of several kinds in place of the parts' own: empty, in full style, placeholders, general phrases, English.
_STYLE = "Тут правильна відповідь: перша. Чому правильна відповідь саме ця. Чому не інші варіанти: А. ні. Б. ні. В. ні. Г. ні. A. no. B. no. C. no. D. no. Як запам’ятати: повторити. Коротко: так. "
_KINDS = ("", _STYLE + "Додатковий текст. " * 40, "Офіційне джерело позначає цей варіант як правильний.", "Інші варіанти описують інше і не відповідають умові.", "The answer is here. A. B. C. D.", _STYLE)
_EXPLAINED = f"""{QUESTIONS_SQL}, told AS (SELECT * REPLACE (CASE WHEN position % 7 = 6 THEN explanation ELSE [{', '.join("'" + k + "'" for k in _KINDS)}][(position % 7 + 1)::INT] END AS explanation, CASE WHEN position % 5 = 0 THEN '' ELSE passage END AS passage) FROM questions),
weak AS (SELECT question_id, subject, list_filter([CASE WHEN trim(explanation) = '' THEN 'empty_explanation' END, CASE WHEN contains(explanation, 'Офіційне джерело позначає цей варіант як правильний') THEN 'placeholder_explanation' END,
CASE WHEN NOT (contains(explanation, 'Тут правильна відповідь') AND contains(explanation, 'Чому правильна відповідь') AND contains(explanation, 'Чому не інші варіанти') AND contains(explanation, 'Як запам’ятати') AND contains(explanation, 'Коротко:')) THEN 'not_style_v2' END,
CASE WHEN length(trim(explanation)) < 700 THEN 'too_short_for_style_v2' END, CASE WHEN regexp_matches(explanation, '(?i)Інші варіанти (описують|стосуються).+не (відповідають|пояснюють)') THEN 'generic_distractor_explanation' END,
CASE WHEN NOT CASE WHEN subject = 'english' THEN contains(explanation, 'A.') AND contains(explanation, 'B.') AND contains(explanation, 'C.') AND contains(explanation, 'D.') ELSE contains(explanation, 'А.') AND contains(explanation, 'Б.') AND contains(explanation, 'В.') AND contains(explanation, 'Г.') END THEN 'missing_option_by_option_explanation' END,
CASE WHEN subject = 'english' AND regexp_matches(trim(explanation), '^(The|This|Correct|Option|Because|In this)') THEN 'english_explanation_not_ukrainian_first' END, CASE WHEN type = 'passage_single_choice' AND passage = '' THEN 'passage_question_without_passage' END], lambda x: x IS NOT NULL) AS reasons FROM told)"""


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("position")
    kind = F.element_at(F.array(*map(F.lit, (*_KINDS, ""))), (k % 7 + 1).cast("int"))
    rows = roles.questions(spark, sf_dir).withColumns({"explanation": F.when(k % 7 == 6, F.col("explanation")).otherwise(kind), "passage": F.when(k % 5 == 0, "").otherwise(F.col("passage"))})
    return rows.withColumn("reasons", quality.weak_reasons(*(F.col(c) for c in ("subject", "type", "passage", "options", "explanation"))))


@query(f"WITH {_EXPLAINED} SELECT question_id, array_to_string(reasons, ',') AS reasons FROM weak")
def weak_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).select("question_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_EXPLAINED} SELECT subject, reason, count(*) AS n FROM (SELECT subject, unnest(reasons) AS reason FROM weak) GROUP BY 1, 2")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reason_histogram(_explained(spark, sf_dir), "subject")


@query(f"""SELECT doc_id, regexp_matches(text, '(?i)&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);') OR regexp_matches(text, '(?i)(Facebook|Twitter)') AS artifact, regexp_matches(text, '(?i)source[^.]{{0,120}}does not provide') OR trim(text) = '' AS placeholder,
length(text) >= 45 AND NOT contains({normal_sql('text')}, 'needs manual review') AS useful, CASE WHEN regexp_extract(text, '«([^»]{{20,260}})»', 1) <> '' THEN 'quoted' WHEN regexp_extract(text, ':\\s*([^?]{{25,260}})', 1) <> '' THEN 'colon' ELSE 'plain' END AS focus FROM documents""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    plain = F.regexp_replace(text.collapse_spaces(t), r"\?$", "")
    focus = F.when(t.rlike("«[^»]{20,260}»"), "quoted").when(quality.question_focus(t) != plain, "colon").otherwise("plain")
    return roles.read(spark, sf_dir, "documents").select("doc_id", quality.has_artifact(t).alias("artifact"), quality.is_placeholder(t).alias("placeholder"), quality.is_useful(t).alias("useful"), focus.alias("focus"))


@query("""SELECT d.doc_id, b.item_id, contains(nd, trim(substr(nb, 1, 140))) AND nb <> '' AS mentioned FROM (SELECT doc_id, """ + normal_sql("text") + " AS nd FROM documents) d, (SELECT item_id, " + normal_sql("text") + """ AS nb FROM benchmark) b WHERE d.doc_id % 40 = b.item_id""")
def option_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = roles.read(spark, sf_dir, "documents"), roles.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("option"))
    return docs.withColumn("item_id", F.col("doc_id") % 40).join(items, "item_id").select("doc_id", "item_id", text.option_mentioned(F.col("text"), F.col("option")).alias("mentioned"))


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Odd documents as imported questions, even ones as the bank; labels give tags."""
    k = F.col("doc_id")
    labels = roles.read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    rows = roles.read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    mirror = F.when(F.coalesce(F.col("quality"), F.lit(1)) == 1, F.array(F.lit("zno_osvita"), F.lit("official_past_exam_mirror"))).otherwise(F.array(F.lit("justschool")))
    questions = rows.filter(k % 2 == 1).select(
        k.alias("question_id"), F.col("lang").alias("subject"), F.when(k % 5 == 0, "passage_single_choice").otherwise("single_choice").alias("type"), F.lit("public_source").alias("source_type"), F.lit("https://h/").alias("source_url"),
        F.col("text").alias("question"), F.when(k % 10 == 1, "p").alias("passage"), F.array(F.lit("a1"), F.lit("b2"), F.lit("c3"), F.when(k % 7 == 0, "a1!").otherwise("d4")).alias("options"), (k % 5).alias("correct"), F.lit("because &amp; so").alias("explanation"),
        F.concat(mirror, F.when(F.col("toxic") == 1, F.array(F.lit("parse_error"))).otherwise(F.array().cast("array<string>"))).alias("tags"),
    )
    return questions, rows.filter(k % 2 == 0).select(k.alias("id"), F.col("lang").alias("subject"), "text")


_REVIEW = f"""x AS (SELECT d.doc_id, lang AS subject, {normal_sql('text')} AS n, text, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id),
xt AS MATERIALIZED (SELECT *, length(n) AS c, list_filter(list_distinct(string_split(n, ' ')), lambda t: t <> '') AS t FROM x),
e AS (SELECT a.doc_id, max(b.doc_id) AS m FROM xt a JOIN xt b ON a.subject = b.subject AND a.n = b.n AND b.doc_id % 2 = 0 WHERE a.doc_id % 2 = 1 GROUP BY 1),
p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY subject, n ORDER BY doc_id) AS m FROM xt WHERE doc_id % 2 = 1),
s AS (SELECT a.doc_id, min(b.doc_id) AS m FROM xt a JOIN xt b ON a.subject = b.subject AND b.doc_id % 2 = 0 AND least(a.c, b.c) >= 80 AND least(a.c, b.c) >= 0.9 * greatest(a.c, b.c) WHERE a.doc_id % 2 = 1
  AND len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.94 GROUP BY 1),
q AS (SELECT x.doc_id, subject, quality, CASE WHEN e.m IS NOT NULL THEN 'exact' WHEN p.m IS NOT NULL THEN 'batch' WHEN s.m IS NOT NULL THEN 'near' END AS duplicate_type, coalesce(e.m, p.m, s.m) AS duplicate_id,
  list_filter([CASE WHEN trim(text) = '' THEN 'empty question text' END, CASE WHEN x.doc_id % 7 = 0 THEN NULL END, CASE WHEN x.doc_id % 5 >= 4 THEN 'invalid correctAnswer index' END, CASE WHEN toxic = 1 THEN 'blocking tag present: parse_error' END,
   CASE WHEN x.doc_id % 5 = 0 AND x.doc_id % 10 <> 1 THEN 'passage_single_choice without passage' END, CASE WHEN regexp_matches(text, '(?i)&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);') THEN 'obvious parsing artifact detected' END], lambda r: r IS NOT NULL) AS r0
  FROM x LEFT JOIN e ON x.doc_id = e.doc_id LEFT JOIN p ON x.doc_id = p.doc_id LEFT JOIN s ON x.doc_id = s.doc_id WHERE x.doc_id % 2 = 1),
q2 AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN list_sort(list_append(r0, 'duplicate options inside question')) ELSE list_sort(r0) END AS r0) FROM q),
decisions AS (SELECT doc_id, subject, duplicate_type, duplicate_id::VARCHAR AS duplicate_id, duplicate_type IS NULL AND quality = 1 AND len(r0) = 0 AS reviewed,
  list_sort(list_concat(r0, list_filter([CASE WHEN duplicate_type IS NOT NULL THEN duplicate_type || ' duplicate of ' || duplicate_id END, CASE WHEN duplicate_type IS NULL AND quality = 0 THEN 'source requires manual editorial review' END], lambda r: r IS NOT NULL))) AS reasons FROM q2)"""


@query(f"WITH {_REVIEW} SELECT doc_id AS question_id, duplicate_type, duplicate_id, reviewed, array_to_string(reasons, ';') AS reasons FROM decisions")
def imported_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = review.review_imported(*_imported(spark, sf_dir))
    return decisions.select("question_id", "duplicate_type", "duplicate_id", "reviewed", F.array_join(F.sort_array("reasons"), ";").alias("reasons"))


@query(f"""WITH {_REVIEW} SELECT subject, count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (NOT reviewed) AS needs_review, count(*) FILTER (duplicate_type = 'exact') AS exact_duplicates,
count(*) FILTER (duplicate_type = 'batch') AS batch_duplicates, count(*) FILTER (duplicate_type = 'near') AS near_duplicates FROM decisions GROUP BY ROLLUP (subject)""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_summary(review.review_imported(*_imported(spark, sf_dir)))


_ANCHORS = [(r"(?i)widget", r"(?i)small", "a widget is small"), (r"(?i)ring", r"(?i)ring|red", "a ring is a ring")]


@query(f"""WITH {QUESTIONS_SQL}, a AS (SELECT *, question || ' ' || explanation AS t, options[(correct + 1)::INT] AS o FROM questions)
SELECT question_id, array_to_string(list_filter([CASE WHEN source_type <> 'generated' THEN 'sourceType is not generated' END, CASE WHEN source_url IS NOT NULL THEN 'sourceUrl must be null for generated questions' END,
CASE WHEN topic NOT IN ('SMALL', 'LARGE', 'PROMO') THEN 'topic is outside expected subject coverage' END, CASE WHEN position % 11 = 0 THEN NULL END,
CASE WHEN len(list_distinct(list_transform(options, lambda x: {normal_sql('x')}))) < 4 THEN 'duplicate options inside question' END,
CASE WHEN trim(explanation) = '' THEN 'explanation is empty' WHEN length(explanation) < 45 THEN 'explanation is too weak or does not clearly justify the answer' END,
CASE WHEN regexp_matches(t, '(?i)widget') AND NOT regexp_matches(o, '(?i)small') THEN 'a widget is small' WHEN regexp_matches(t, '(?i)ring') AND NOT regexp_matches(o, '(?i)ring|red') THEN 'a ring is a ring' END], lambda r: r IS NOT NULL), ';') AS rule_reasons FROM a""")
def generated_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = roles.read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("tznk").alias("subject"), "text")
    decisions = review.review_generated(roles.questions(spark, sf_dir), bank, "^[a-z-]+[0-9]+$", ["SMALL", "LARGE", "PROMO"], _ANCHORS)
    return decisions.select("question_id", F.array_join(F.filter("reasons", lambda r: ~r.contains("duplicate of")), ";").alias("rule_reasons"))


@query(f"""WITH {QUESTIONS_SQL}, r AS (SELECT *, ((row_number() OVER (PARTITION BY subject ORDER BY position) - 1) % 4)::INT AS target FROM questions), o AS (SELECT *, list_concat(options[1:correct::INT], options[correct::INT + 2:4]) AS others FROM r)
SELECT question_id, array_to_string(list_concat(list_append(others[1:target], options[correct::INT + 1]), others[target + 1:3]), '|') AS options, target AS correct, correct <> target AS changed FROM o""")
def rebalanced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.rebalance_answers(roles.questions(spark, sf_dir), "position")
    return out.select("question_id", F.array_join("options", "|").alias("options"), F.col("correct").cast("int").alias("correct"), "changed")


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, CASE WHEN position % 6 = 0 AND position % 4 = 0 THEN 3 ELSE correct END::BIGINT AS correct, position % 6 = 0 AND position % 4 <> 0 AS flagged, array_to_string(CASE WHEN position % 4 = 0 THEN list_filter(tags, lambda t: t <> 'needs_manual_review') ELSE tags END, ',') AS tags FROM questions""")
def flagged_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = roles.questions(spark, sf_dir)
    patch = bank.filter("position % 4 = 0").select("question_id", F.lit(3).alias("correct"))
    out = review.review_flagged(bank, patch, "needs_manual_review")
    return out.select("question_id", F.col("correct").cast("long").alias("correct"), (F.col("explanation") == "explanation needs a manual check").alias("flagged"), F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, CASE WHEN position % 50 = 0 THEN 'patched' ELSE question END AS question, CASE WHEN position % 11 = 0 THEN 'unmatched' ELSE 'fine' END AS marker FROM questions""")
def patched_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = roles.questions(spark, sf_dir)
    patched = review.apply_patch(bank, bank.filter("position % 50 = 0").select("question_id", F.lit("patched").alias("question")), "question_id", ["question"])
    problems = review.patch_problems(bank, bank, "question_id", "explanation", " is ")
    return patched.join(problems, "question_id", "left").select("question_id", "question", F.when(F.col("problem").isNull(), "fine").otherwise("unmatched").alias("marker"))


# ---------------------------------------------------------------- generation from parts as concepts

_CONCEPTS = """c AS (SELECT p_type AS topic, p_partkey AS place, row_number() OVER (ORDER BY p_partkey) - 1 AS all_place, p_name || ' ' || p_partkey AS term, p_brand AS definition, 's' || p_size AS scenario, 'a' || p_partkey AS action, 'r' || p_partkey AS rationale,
  row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS ring, count(*) OVER (PARTITION BY p_type) AS n FROM part),
t AS (SELECT * FROM (VALUES ('SMALL', 900, 0), ('LARGE', 400, 900), ('PROMO', 700, 1300)) v(topic, count, before)),
i AS (SELECT topic, before, unnest(range(0, count)) AS i FROM t),
items AS (SELECT c.*, before + i AS serial, (i // n) % 5 AS variant FROM i JOIN c ON i.topic = c.topic AND i.i % c.n = c.ring)"""


#: Questions and explanations by variant.
_SENTENCES = (
    ["What is «{definition}»?", "Що це: {scenario}?", "What does {term} mean?", "In {scenario}, what does {term} ask for?", "Why {term}?"],
    ["{definition} is {term}", "{term}.", "{term}.", "{action}: {rationale}", "{term}."],
)


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    concepts = roles.read(spark, sf_dir, "part").select(
        F.col("p_type").alias("topic"), k.alias("place"), k.alias("all_place"), F.concat_ws(" ", "p_name", k.cast("string")).alias("term"), F.col("p_brand").alias("definition"),
        F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("scenario"), F.concat(F.lit("a"), k.cast("string")).alias("action"), F.concat(F.lit("r"), k.cast("string")).alias("rationale"), F.lit("").alias("passage"),
    )
    targets = spark.createDataFrame([("SMALL", 900, 0), ("LARGE", 400, 1), ("PROMO", 700, 2)], "topic string, count long, topic_place int")
    return concepts, targets


@query(f"""WITH {_CONCEPTS}, total AS (SELECT count(*) AS m FROM part), k AS (SELECT unnest([0, 1, 2]) AS k),
d AS (SELECT serial, k, (serial + variant + k) % (m - 1) + CASE WHEN (serial + variant + k) % (m - 1) >= all_place THEN 1 ELSE 0 END AS p, variant FROM items, k, total),
x AS (SELECT serial, string_agg(CASE WHEN variant <= 1 THEN o.term WHEN variant = 2 THEN o.definition WHEN variant = 3 THEN o.action ELSE o.rationale END, '|' ORDER BY k) AS distractors FROM d JOIN c o ON d.p = o.all_place GROUP BY 1)
SELECT items.serial, items.variant, term, CASE variant WHEN 0 THEN 'What is «' || definition || '»?' WHEN 1 THEN 'Що це: ' || scenario || '?' WHEN 2 THEN 'What does ' || term || ' mean?' WHEN 3 THEN 'In ' || scenario || ', what does ' || term || ' ask for?' ELSE 'Why ' || term || '?' END AS question,
CASE variant WHEN 0 THEN definition || ' is ' || term WHEN 3 THEN action || ': ' || rationale ELSE term || '.' END AS explanation, distractors FROM items JOIN x ON items.serial = x.serial""")
def concept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, targets = _concepts(spark, sf_dir)
    items = generation.expand_concepts(concepts, targets).withColumns(generation.fill_template(*_SENTENCES))
    return generation.distractors(items, concepts).select("serial", "variant", "term", "question", "explanation", F.array_join("distractors", "|").alias("distractors"))


@query(f"""WITH {_CONCEPTS} SELECT 'gen-' || CASE WHEN serial + 1 < 1000 THEN lpad((serial + 1)::VARCHAR, 3, '0') ELSE (serial + 1)::VARCHAR END AS question_id, serial, 'single_choice' AS type, ((4 - serial % 4) % 4)::INT AS correct,
CASE WHEN serial % 5 = 4 THEN 'hard' WHEN serial % 4 = 0 OR serial % 20 = 1 THEN 'easy' ELSE 'medium' END AS difficulty FROM items WHERE variant <> 2""")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, targets = _concepts(spark, sf_dir)
    items = generation.expand_concepts(concepts, targets).withColumns(generation.fill_template(*_SENTENCES)).filter("variant <> 2")
    return generation.seed_rows(generation.distractors(items, concepts), "gen").select("question_id", "serial", "type", "correct", "difficulty")


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, array_to_string(list_concat(options[(position % 4 + 1)::INT:4], options[1:(position % 4)::INT]), '|') AS options FROM questions""")
def option_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.questions(spark, sf_dir).select("question_id", F.array_join(generation.rotate_options(F.col("options"), F.col("position")), "|").alias("options"))


@query("""WITH n AS (SELECT count(*) AS n FROM part), i AS (SELECT p_partkey AS i, n, floor(n * 0.25 + 0.5) AS easy, floor(n * 0.2 + 0.5) AS hard FROM part, n)
SELECT row_number() OVER (ORDER BY (i * 37 + 11) % n, i) - 1 AS position, CASE WHEN i < easy THEN 'easy' WHEN i < n - hard THEN 'medium' ELSE 'hard' END AS difficulty FROM i""")
def quota_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = roles.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    return generation.quota_difficulties(parts.count(), parts).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {QUESTIONS_SQL}, t AS (SELECT *, list_concat(tags, list_filter([CASE WHEN position % 7 = 0 THEN 'official_collection' END, CASE WHEN position % 3 = 0 THEN 'official_past_exam' END, CASE WHEN position % 5 = 0 THEN 'needs_answer_review' END], lambda x: x IS NOT NULL)) AS all_tags FROM questions)
SELECT subject, CASE WHEN source_type = 'official_demo' THEN 'official_demo' WHEN position % 7 = 0 THEN 'official_collection' WHEN position % 3 = 0 THEN 'official_past_exam' ELSE source_type END AS category, count(*) AS total,
count(*) FILTER (NOT list_contains(all_tags, 'needs_answer_review')) AS with_answers, count(*) FILTER (list_contains(all_tags, 'needs_manual_review')) AS needs_review FROM t GROUP BY 1, 2""")
def import_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("position")
    more = F.array_compact(F.array(F.when(k % 7 == 0, "official_collection"), F.when(k % 3 == 0, "official_past_exam"), F.when(k % 5 == 0, "needs_answer_review")))
    return metrics.import_categories(roles.questions(spark, sf_dir).withColumn("tags", F.concat("tags", more)))


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, CASE subject WHEN 'tznk' THEN 'medium' WHEN 'english' THEN 'easy' ELSE 'medium' END AS recommended, CASE WHEN subject = 'tznk' THEN 'not checked for a single answer' ELSE '' END AS reasons FROM questions""")
def domain_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    recommended = quality.recommended_difficulty(*(F.col(c) for c in ("subject", "topic", "subtopic", "question")))
    return roles.questions(spark, sf_dir).select("question_id", recommended.alias("recommended"), F.array_join(quality.domain_reasons(), ";").alias("reasons"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'What is the main idea of the passage about ' || c || '?' WHEN 1 THEN 'In the passage about ' || c || ', what can be inferred here?' ELSE 'Which colour?' END AS question,
CASE p_size % 3 WHEN 0 THEN 'Main idea' WHEN 1 THEN 'Inference' ELSE 'Detail understanding' END AS subtopic FROM (SELECT *, CASE WHEN contains(p_name, 'ring') THEN 'rings' WHEN contains(p_name, 'red') THEN 'red things' ELSE 'parts' END AS c FROM part)""")
def contextual_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    plain = F.when(size == 0, "What is the passage mainly about?").when(size == 1, "What can be inferred here?").otherwise("Which colour?")
    made = extraction.with_context(plain, F.col("p_name"), [("ring", "rings"), ("red", "red things")], "parts")
    return roles.read(spark, sf_dir, "part").select("p_partkey", made.alias("question")).withColumn("subtopic", extraction.generated_reading_subtopic(F.col("question")))
