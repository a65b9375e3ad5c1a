"""Queries of constraints, duplicates and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions.text import normalize
from itemforge.operators import dedup, rules
from itemforge.plans import roles
from itemforge.plans.define import Queries
from itemforge.plans.roles import QUESTIONS_SQL, normal_sql

query = Queries()


def _conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as groups, one-unit sets of them, and turns as questions; some turns are off on purpose."""
    rows = roles.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    qid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    gid = F.concat(F.lit("g"), F.col("conv_id").cast("string"))
    subject = F.when(F.col("conv_id") % 2 == 0, "english").otherwise("tznk")
    members = F.transform(F.sort_array(F.collect_set(F.struct("turn", qid.alias("q")))), lambda m: m["q"])
    groups = rows.filter(F.col("conv_id") % 13 != 0).groupBy("conv_id").agg(members.alias("question_ids")).select(gid.alias("group_id"), subject.alias("subject"), F.when(F.col("conv_id") % 17 == 0, "").otherwise("text").alias("passage"), "question_ids")
    questions = rows.filter((F.col("conv_id") + F.col("turn")) % 19 != 0).groupBy("conv_id", "turn").agg(F.min("role").alias("role")).select(
        qid.alias("question_id"), F.when(F.col("turn") == 5, "management").otherwise(subject).alias("subject"), gid.alias("group_id"),
        F.when(F.col("turn") == 3, 9).otherwise(F.col("turn") + 1).alias("group_order"), F.concat(F.lit("s"), (F.col("conv_id") % 40).cast("string")).alias("set_id"),
    )
    unit = F.struct(F.lit("group").alias("type"), F.lit(None).cast("string").alias("question_id"), gid.alias("group_id"))
    sets = rows.filter(F.col("conv_id") % 40 != 39).select("conv_id").distinct().groupBy((F.col("conv_id") % 40).alias("s")).agg(F.sort_array(F.collect_list(unit)).alias("units")).select(
        F.concat(F.lit("s"), F.col("s").cast("string")).alias("set_id"), F.lit("english").alias("subject"), F.when(F.col("s") == 7, "").otherwise("t").alias("title"), "units"
    )
    return groups, sets, questions


_CONVERSATIONS = """c AS (SELECT DISTINCT conv_id, turn, conv_id || '-' || turn AS qid, 'g' || conv_id AS gid, CASE WHEN conv_id % 2 = 0 THEN 'english' ELSE 'tznk' END AS subject FROM conversations),
members AS (SELECT gid AS group_id, subject AS group_subject, qid AS question_id, row_number() OVER (PARTITION BY gid ORDER BY turn) AS member_order FROM c WHERE conv_id % 13 <> 0),
questions AS (SELECT qid AS question_id, CASE WHEN turn = 5 THEN 'management' ELSE subject END AS subject, gid AS group_id, CASE WHEN turn = 3 THEN 9 ELSE turn + 1 END AS group_order, 's' || (conv_id % 40) AS set_id FROM c WHERE (conv_id + turn) % 19 <> 0),
groups AS (SELECT DISTINCT gid AS group_id, subject, CASE WHEN conv_id % 17 = 0 THEN '' ELSE 'text' END AS passage FROM c WHERE conv_id % 13 <> 0),
units AS (SELECT DISTINCT 's' || (conv_id % 40) AS set_id, gid AS group_id FROM c WHERE conv_id % 40 <> 39),
sets AS (SELECT DISTINCT set_id FROM units)"""


@query(f"""WITH {QUESTIONS_SQL}, v AS (SELECT question_id, [CASE WHEN trim(explanation) = '' THEN 'empty explanation' END, CASE WHEN difficulty NOT IN ('easy','medium') THEN NULL END,
CASE WHEN subject NOT IN ('tznk','english','management') THEN 'unknown subject' END, CASE WHEN type = 'passage_single_choice' AND trim(passage) = '' THEN 'passage is missing' END] AS r FROM questions)
SELECT 'question' AS entity, question_id AS entity_id, rule, '' AS detail FROM (SELECT question_id, unnest(r) AS rule FROM v) WHERE rule IS NOT NULL""")
def question_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rules, for a bank that knows three subjects."""
    return rules.question_rules(roles.questions(spark, sf_dir), rules.SUBJECT_IDS[:3])


_LIGHT = "list_transform(options, lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))"


@query(f"""WITH {QUESTIONS_SQL} SELECT 'question' AS entity, question_id AS entity_id, 'duplicate options' AS rule, '' AS detail FROM questions WHERE len(list_distinct({_LIGHT})) < len(options)""")
def duplicate_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_options(roles.questions(spark, sf_dir))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % 500, o_orderdate ORDER BY o_orderpriority, o_orderkey) AS n,
first_value(o_orderpriority) OVER (PARTITION BY o_custkey % 500, o_orderdate ORDER BY o_orderpriority, o_orderkey) AS f, (o_custkey % 500) || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS id FROM orders)
SELECT 'attempt' AS entity, id AS entity_id, 'duplicate id' AS rule, f AS detail FROM r WHERE n > 1""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.read(spark, sf_dir, "orders").withColumn("id", F.concat_ws(" ", (F.col("o_custkey") % 500).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return rules.duplicate_ids(rows, "attempt", "id", "o_orderpriority", "o_orderkey")


@query(f"""WITH n AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, {normal_sql('text')}) AS first FROM documents)
SELECT 'question' AS entity, doc_id::VARCHAR AS entity_id, 'duplicate text' AS rule, first::VARCHAR AS detail FROM n WHERE doc_id > first""")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_texts(roles.texts(spark, sf_dir), "id", "subject", "text")


@query("""SELECT 'order' AS entity, o_orderkey::VARCHAR AS entity_id, 'unknown learner' AS rule, o_custkey::VARCHAR AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def unknown_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = roles.read(spark, sf_dir, "customer").filter("c_nationkey < 5")
    return rules.unknown_references(roles.read(spark, sf_dir, "orders"), "order", "o_orderkey", "o_custkey", known, "c_custkey", "unknown learner")


@query(f"WITH {_CONVERSATIONS} SELECT 'group' AS entity, group_id AS entity_id, 'empty passage' AS rule, '' AS detail FROM groups WHERE passage = ''")
def group_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.group_rules(_conversations(spark, sf_dir)[0])


@query(f"WITH {_CONVERSATIONS} SELECT 'exam_set' AS entity, set_id AS entity_id, 'empty title' AS rule, '' AS detail FROM sets WHERE set_id = 's7'")
def exam_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.set_rules(_conversations(spark, sf_dir)[1])


@query(f"""WITH {_CONVERSATIONS}, j AS (SELECT m.*, q.subject, q.group_order, q.question_id IS NOT NULL AS there FROM members m LEFT JOIN questions q ON m.question_id = q.question_id)
SELECT 'group' AS entity, group_id || ':' || question_id AS entity_id, 'missing question' AS rule, '' AS detail FROM j WHERE NOT there
UNION ALL SELECT 'group', group_id || ':' || question_id, 'subject differs', '' FROM j WHERE there AND subject <> group_subject
UNION ALL SELECT 'group', group_id || ':' || question_id, 'group order differs', '' FROM j WHERE there AND group_order <> member_order
UNION ALL SELECT 'question', question_id, 'missing group', group_id FROM questions WHERE group_id NOT IN (SELECT group_id FROM groups)""")
def group_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, questions = _conversations(spark, sf_dir)
    return rules.group_integrity(groups, questions)


@query(f"""WITH {_CONVERSATIONS}, u AS (SELECT u.*, g.subject FROM units u LEFT JOIN groups g ON u.group_id = g.group_id)
SELECT 'exam_set' AS entity, set_id || ':group:' || group_id AS entity_id, 'missing group' AS rule, '' AS detail FROM u WHERE subject IS NULL
UNION ALL SELECT 'exam_set', set_id || ':group:' || group_id, 'subject differs', '' FROM u WHERE subject <> 'english'
UNION ALL SELECT 'question', question_id, 'missing exam set', set_id FROM questions WHERE set_id NOT IN (SELECT set_id FROM sets)
UNION ALL SELECT 'question', q.question_id, 'not covered by its set', q.set_id FROM questions q WHERE q.set_id IN (SELECT set_id FROM sets) AND NOT EXISTS (
  SELECT 1 FROM units u JOIN members m ON u.group_id = m.group_id WHERE u.set_id = q.set_id AND m.question_id = q.question_id)""")
def exam_set_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, sets, questions = _conversations(spark, sf_dir)
    return rules.set_integrity(sets, groups, questions)


@query(f"WITH {_CONVERSATIONS} SELECT u.set_id, count(DISTINCT m.question_id) AS questions, count(DISTINCT u.group_id) AS groups FROM units u JOIN members m ON u.group_id = m.group_id GROUP BY 1")
def exam_set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, sets, _ = _conversations(spark, sf_dir)
    covered = rules.covered_questions(sets, groups).select("set_id", "question_id", "unit_order").distinct()
    return covered.groupBy("set_id").agg(F.count_distinct("question_id").alias("questions"), F.count_distinct("unit_order").alias("groups"))


_STRICT = "list_transform(options, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, trim(explanation) <> '' AND len(list_distinct({_STRICT})) = 4 AS valid FROM questions")
def structural_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.questions(spark, sf_dir).select("question_id", rules.is_structurally_valid().alias("valid"))


@query(f"""WITH {QUESTIONS_SQL} SELECT 'generated' AS entity, question_id AS entity_id, 'duplicate options' AS rule, '' AS detail FROM questions WHERE len(list_distinct({_LIGHT})) < 4""")
def generator_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.generator_rules(roles.questions(spark, sf_dir))


@query(f"""WITH {QUESTIONS_SQL} SELECT question_id, 'explanation' AS field FROM questions WHERE position % 11 = 0 AND position % 97 <> 1
UNION ALL SELECT question_id, 'missing' FROM questions WHERE position % 97 = 1""")
def immutable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update that fills empty explanations and loses a few rows, held against the bank before it."""
    before = roles.questions(spark, sf_dir)
    after = before.filter("position % 97 <> 1 OR position % 11 = 0 AND position % 97 <> 1").withColumn("explanation", F.when(F.col("explanation") == "", "filled").otherwise(F.col("explanation")))
    changed = rules.changed_fields(before, after, "question_id", ["question", "options", "correct", "explanation", "tags"])
    return changed


# ---------------------------------------------------------------- duplicates


@query(f"SELECT doc_id AS id, {normal_sql('text')} AS normal, len(list_filter(list_distinct(string_split({normal_sql('text')}, ' ')), lambda t: t <> ''))::INT AS tokens FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.functions.text import tokens

    return roles.texts(spark, sf_dir).withColumn("normal", normalize(F.col("text"))).select("id", "normal", F.size(tokens(F.col("normal"))).alias("tokens"))


_FIRST = "min(doc_id) OVER (PARTITION BY lang, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id AS id, {_FIRST} AS first_id, doc_id = {_FIRST} AS kept FROM documents")
def batch_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.functions.text import normalize_light

    return dedup.first_in_batch(roles.texts(spark, sf_dir), normalize_light(F.col("text"))).select("id", "first_id", (F.col("id") == F.col("first_id")).alias("kept"))


@query(f"SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY lang, {normal_sql('text')} ORDER BY doc_id) AS previous_id FROM documents")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.seen_before(roles.texts(spark, sf_dir), normalize(F.col("text"))).select("id", "previous_id")


_BANK = f"b AS (SELECT lang AS subject, {normal_sql('text')} AS n, min(doc_id) AS f, max(doc_id) AS l FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document is either a candidate (odd id) or in the bank (even id); its first line is its passage."""
    rows = roles.texts(spark, sf_dir).withColumns({"passage": F.element_at(F.split("text", "\n"), 1), "options": F.array("subject", "site")})
    return rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")


@query(f"WITH {_BANK} SELECT doc_id AS id, f AS first_match, l AS last_match FROM documents d LEFT JOIN b ON d.lang = b.subject AND {normal_sql('d.text')} = b.n WHERE doc_id % 2 = 1")
def duplicate_of_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, bank = _halves(spark, sf_dir)
    both = dedup.match_exact(rows, bank).withColumnRenamed("matched_id", "first_match")
    return dedup.match_exact(both, bank, last=True).select("id", "first_match", F.col("matched_id").alias("last_match"))


_TOKENS = f"""d AS (SELECT doc_id, lang, n, length(n) AS c, list_filter(list_distinct(string_split(n, ' ')), lambda t: t <> '') AS t FROM (SELECT doc_id, lang, {normal_sql('text')} AS n FROM documents)),
firsts AS (SELECT lang, n, min(doc_id) AS doc_id, any_value(c) AS c, any_value(t) AS t FROM d WHERE c >= 80 GROUP BY 1, 2)"""
_NEAR = "a.lang = b.lang AND least(a.c, b.c) >= 0.9 * greatest(a.c, b.c)"
_SIM = "len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"


@query(f"WITH {_TOKENS} SELECT a.doc_id AS left_id, b.doc_id AS right_id, round({_SIM}, 9) AS similarity FROM firsts a JOIN firsts b ON {_NEAR} AND a.doc_id < b.doc_id WHERE {_SIM} >= 0.94")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(roles.texts(spark, sf_dir))


_IMPORT = f"""WITH {_TOKENS}, x AS (SELECT d.*, string_split(text, chr(10))[1] AS p, text, source FROM d JOIN documents USING (doc_id, lang)),
odd AS (SELECT * FROM x WHERE doc_id % 2 = 1), even AS (SELECT * FROM x WHERE doc_id % 2 = 0),
e AS (SELECT o.doc_id, min(v.doc_id) AS m FROM odd o JOIN even v ON o.lang = v.lang AND o.n = v.n GROUP BY 1),
p AS (SELECT o.doc_id, min(v.doc_id) AS m FROM odd o JOIN even v ON o.lang = v.lang AND o.source = v.source AND {normal_sql('o.p')} = {normal_sql('v.p')} AND {normal_sql('o.p')} <> '' GROUP BY 1),
s AS (SELECT a.doc_id, min(b.doc_id) AS m FROM odd a JOIN even b ON {_NEAR} AND a.c >= 80 AND b.c >= 80 WHERE {_SIM} >= 0.94 GROUP BY 1),
f AS (SELECT o.doc_id, o.lang, o.n, CASE WHEN e.m IS NOT NULL THEN 'exact_duplicate' WHEN p.m IS NOT NULL THEN 'same_passage_and_options' WHEN s.m IS NOT NULL THEN 'near_duplicate' END AS reason, coalesce(e.m, p.m, s.m) AS m
  FROM odd o LEFT JOIN e USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, n) AS first FROM f WHERE reason IS NULL),
decisions AS (SELECT f.doc_id AS id, f.lang AS subject, coalesce(reason, CASE WHEN first <> f.doc_id THEN 'duplicate_in_batch' END) AS reason, coalesce(m, CASE WHEN first <> f.doc_id THEN first END) AS matched_id FROM f LEFT JOIN k USING (doc_id))"""


@query(f"{_IMPORT} SELECT id, reason, matched_id FROM decisions")
def import_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.import_decisions(*_halves(spark, sf_dir)).select("id", "reason", "matched_id")


@query(f"""{_IMPORT} SELECT subject, count(*) AS total, count(*) FILTER (reason = 'exact_duplicate') AS exact_duplicate, count(*) FILTER (reason = 'same_passage_and_options') AS same_passage_and_options,
count(*) FILTER (reason = 'near_duplicate') AS near_duplicate, count(*) FILTER (reason = 'duplicate_in_batch') AS duplicate_in_batch FROM decisions GROUP BY 1""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.operators.metrics import pivot_reasons

    return pivot_reasons(dedup.import_decisions(*_halves(spark, sf_dir)), "subject", "reason", ["exact_duplicate", "same_passage_and_options", "near_duplicate", "duplicate_in_batch"])
