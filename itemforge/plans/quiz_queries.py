"""Queries of grouping, exam sets, quizzes and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions.text import normalize, slug, stable_hash
from itemforge.operators import grouping, merge, quiz
from itemforge.plans import roles
from itemforge.plans.define import Queries
from itemforge.plans.roles import QUESTIONS_SQL, normal_sql

query = Queries()

#: The parts' names are short, so passages count from this many characters here.
LEAST = 5


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = grouping.derive_sources(roles.questions(spark, sf_dir))
    return bank.withColumn("file_rank", F.when(F.col("subject") == "tznk", 0).when(F.col("subject") == "english", 1).when(F.col("subject") == "management", 2).otherwise(3))


_GROUPS = f"""{QUESTIONS_SQL},
m0 AS (SELECT *, position AS source_order, 'qg-' || subject || '-' || left(regexp_replace(regexp_replace(lower(source_site), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) || '-' || left(sha1({normal_sql('passage')}), 10) AS gid FROM questions WHERE length(passage) >= {LEAST}),
members AS (SELECT *, gid AS group_id, count(*) OVER (PARTITION BY gid) AS group_size, row_number() OVER (PARTITION BY gid ORDER BY source_order, question_id) AS group_order FROM m0 QUALIFY group_size > 1)"""


@query(f"""WITH {_GROUPS} SELECT group_id, any_value(subject) AS subject, string_agg(question_id, ',' ORDER BY group_order) AS question_ids, arg_min(source_type, group_order) AS source_type,
arg_min(coalesce(source_url, ''), group_order) AS source_url, any_value(source_site) AS source_site,
CASE WHEN any_value(source_site) = 'generated' THEN NULL WHEN min(source_year) = max(source_year) THEN min(source_year)::VARCHAR END AS source_year,
CASE WHEN count(DISTINCT coalesce(source_url, '')) > 1 THEN 'auto_grouped,shared_passage,multi_source_url_group' ELSE 'auto_grouped,shared_passage' END AS tags FROM members GROUP BY 1""")
def auto_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.auto_groups(grouping.group_members(_bank(spark, sf_dir), LEAST))
    return groups.select("group_id", "subject", F.array_join("question_ids", ",").alias("question_ids"), "source_type", F.coalesce("source_url", F.lit("")).alias("source_url"), "source_site", "source_year", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_GROUPS} SELECT q.question_id, m.group_id, m.group_order FROM questions q LEFT JOIN members m ON q.question_id = m.question_id")
def group_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    return grouping.with_group_fields(bank, grouping.group_members(bank, LEAST)).select("question_id", "group_id", "group_order")


_SETS = f"""{_GROUPS}, own AS (SELECT q.*, m.group_id, m.group_order, CASE WHEN source_type_q <> 'generated' THEN q.subject || ':' || q.source_site END AS own_set FROM (SELECT *, source_type AS source_type_q FROM questions) q LEFT JOIN (SELECT question_id, group_id, group_order FROM members) m ON q.question_id = m.question_id),
lead_set AS (SELECT group_id, own_set AS group_set FROM own WHERE group_order = 1),
placed AS (SELECT o.*, CASE WHEN o.group_id IS NULL THEN own_set ELSE group_set END AS set_id FROM own o LEFT JOIN lead_set l ON o.group_id = l.group_id),
u AS (SELECT set_id, coalesce(group_id, question_id) AS unit, group_id IS NOT NULL AS grouped, min(position) AS p FROM placed WHERE set_id IS NOT NULL GROUP BY 1, 2, 3),
units AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY p) AS unit_order, CASE WHEN grouped THEN 'group' ELSE 'question' END AS type, CASE WHEN NOT grouped THEN unit END AS question_id, CASE WHEN grouped THEN unit END AS group_id FROM u)"""


def _units(bank: DataFrame, members: DataFrame) -> DataFrame:
    set_id = F.when(F.col("source_type") != "generated", F.concat_ws(":", "subject", "source_site"))
    return grouping.exam_set_units(bank, members, set_id)


@query(f"WITH {_SETS} SELECT * FROM units")
def exam_set_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    return _units(bank, grouping.group_members(bank, LEAST))


@query(f"""WITH {_SETS}, h AS (SELECT set_id, arg_min(subject, position) AS subject, arg_min(source_site, position) AS source_site, arg_min(source_url, position) AS source_url, arg_min(source_year, position) AS year FROM placed WHERE set_id IS NOT NULL GROUP BY 1)
SELECT h.*, CASE h.subject WHEN 'tznk' THEN 'ТЗНК' WHEN 'english' THEN 'Англійська мова' WHEN 'management' THEN 'Управління та адміністрування' ELSE 'Психологія та соціологія' END || ': ' || h.source_site AS title,
NULL::VARCHAR AS variant, (SELECT count(*) FROM units u WHERE u.set_id = h.set_id) AS units FROM h""")
def exam_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir).withColumn("source_year", F.regexp_extract(F.element_at("tags", -1), "[0-9]+", 0).cast("int"))
    members = grouping.group_members(_bank(spark, sf_dir), LEAST)
    units = _units(bank, members)
    sets = grouping.exam_sets(bank, units, grouping.primary_sets(units, members))
    return sets.select("set_id", "subject", "source_site", "source_url", F.col("year").cast("int").alias("year"), "title", "variant", F.size("units").cast("long").alias("units"))


@query(f"""WITH {_SETS} SELECT subject, count(DISTINCT group_id) AS groups, count(group_id) AS grouped, count(*) FILTER (group_id IS NULL) AS standalone, count(DISTINCT set_id) AS exam_sets,
count(*) FILTER (set_id IS NULL) AS unmapped FROM placed GROUP BY 1""")
def migration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    members = grouping.group_members(bank, LEAST)
    return grouping.migration_totals(bank, members, _units(bank, members))


@query("""WITH x AS (SELECT p_brand AS key, count(*) AS n, 'auto' AS origin FROM part GROUP BY 1), m AS (SELECT s_name AS key, s_nationkey AS n, 'manual' AS origin FROM supplier WHERE s_nationkey < 3 UNION ALL SELECT 'Brand#2', 0, 'manual')
SELECT * FROM m UNION ALL SELECT * FROM x WHERE key NOT IN (SELECT key FROM m)""")
def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = roles.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("auto"))
    manual = roles.read(spark, sf_dir, "supplier").filter("s_nationkey < 3").select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("long").alias("n"), F.lit("manual").alias("origin"))
    manual = manual.unionByName(spark.createDataFrame([("Brand#2", 0, "manual")], "key string, n long, origin string"))
    return grouping.override(auto, manual, "key")


@query(f"SELECT url, page_id, left(sha1(url), 10) AS hash, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) AS slug, {normal_sql('url')} AS normal FROM pages")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return roles.read(spark, sf_dir, "pages").select("url", "page_id", stable_hash(url).alias("hash"), slug(url).alias("slug"), normalize(url).alias("normal"))


# ---------------------------------------------------------------- quizzes: orders are requests, their parts are eligible

_QUIZ = f"""members AS (SELECT 'g' || (p_partkey // 3) AS group_id, p_partkey AS question_id, p_partkey % 3 + 1 AS group_order FROM part WHERE p_partkey % 12 < 9),
sizes AS (SELECT group_id, count(*) AS n FROM members GROUP BY 1),
eligible AS (SELECT DISTINCT o_custkey AS request_id, l_partkey AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT e.*, question_id AS position, group_id FROM eligible e LEFT JOIN members m USING (question_id)),
units0 AS (SELECT request_id, group_id, CASE WHEN group_id IS NULL THEN question_id END AS question_id, min(position) AS unit_position, count(*) AS there FROM e GROUP BY 1, 2, 3),
units AS (SELECT u.*, coalesce(n, 1) AS size FROM units0 u LEFT JOIN sizes USING (group_id))"""


def _quiz(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Eligible questions (a customer may have one in several orders), members, the bank, and the parts to deal the eligible ones over."""
    k = F.col("p_partkey")
    parts = roles.read(spark, sf_dir, "part")
    members = parts.filter(k % 12 < 9).select(F.concat(F.lit("g"), F.floor(k / 3).cast("string")).alias("group_id"), k.alias("question_id"), (k % 3 + 1).alias("group_order"))
    lines = roles.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("question_id"))
    dealt = roles.parts(lines)
    orders = roles.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("request_id"))
    eligible = orders.repartition(dealt, "o_orderkey").join(lines.repartition(dealt, "o_orderkey"), "o_orderkey").select("request_id", "question_id", F.col("question_id").alias("position"))
    return eligible, members, parts.select(k.alias("question_id")), dealt


_TYPE = "CASE WHEN group_id IS NULL THEN 'question' ELSE 'group' END AS type"


@query(f"WITH {_QUIZ} SELECT request_id, unit_position, {_TYPE}, question_id, group_id, size FROM units WHERE group_id IS NULL OR there = size")
def quiz_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible, members, _, dealt = _quiz(spark, sf_dir)
    return quiz.build_units(eligible, members, parts=dealt)


@query(f"WITH {_QUIZ} SELECT request_id, unit_position, {_TYPE}, question_id, group_id, size FROM units")
def quiz_units_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible, members, _, dealt = _quiz(spark, sf_dir)
    return quiz.build_units(eligible, members, any_member=True, parts=dealt)


@query(f"WITH {_QUIZ} SELECT request_id, sum(size)::BIGINT AS questions, count(*) AS units, count(*) FILTER (group_id IS NOT NULL) AS groups FROM units GROUP BY 1")
def quiz_unit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible, members, _, dealt = _quiz(spark, sf_dir)
    return quiz.unit_totals(quiz.build_units(eligible, members, any_member=True, parts=dealt))


def _select(order: str) -> str:
    """The walk over the units of each request in an order."""
    return f"""{_QUIZ}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS i, request_id % 12 AS budget FROM units),
fold AS (SELECT request_id, i, CASE WHEN size <= budget THEN size ELSE 0 END AS total, size <= budget AS taken FROM r WHERE i = 1
  UNION ALL SELECT r.request_id, r.i, f.total + CASE WHEN f.total + r.size <= r.budget THEN r.size ELSE 0 END, f.total + r.size <= r.budget FROM fold f JOIN r ON r.request_id = f.request_id AND r.i = f.i + 1),
chosen AS (SELECT r.* FROM r JOIN fold f ON r.request_id = f.request_id AND r.i = f.i WHERE budget > 0 AND (taken OR (r.i = 1 AND (SELECT max(total) FROM fold g WHERE g.request_id = r.request_id) = 0))),
flat AS (SELECT request_id, i, 0 AS member, question_id, NULL::VARCHAR AS group_id FROM chosen WHERE group_id IS NULL
  UNION ALL SELECT request_id, i, group_order, m.question_id, group_id FROM chosen c JOIN members m USING (group_id))"""


_SELECT = _select("unit_position")
_FLAT = """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY i, member, question_id) AS place, question_id, group_id,
CASE WHEN group_id IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, i ORDER BY member, question_id) END AS order_in_group,
CASE WHEN group_id IS NOT NULL THEN count(*) OVER (PARTITION BY request_id, i) END AS total_in_group FROM flat"""


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 12).alias("budget"), F.col("c_custkey").alias("seed"))


@query(f"WITH RECURSIVE {_SELECT} SELECT request_id, unit_position, {_TYPE}, question_id, group_id, size FROM chosen")
def quiz_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible, members, _, dealt = _quiz(spark, sf_dir)
    return quiz.select_units(quiz.build_units(eligible, members, any_member=True, parts=dealt), _budgets(spark, sf_dir))


@query(f"WITH RECURSIVE {_SELECT} {_FLAT}")
def quiz_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible, members, bank, dealt = _quiz(spark, sf_dir)
    chosen = quiz.select_units(quiz.build_units(eligible, members, any_member=True, parts=dealt), _budgets(spark, sf_dir))
    return quiz.flatten(chosen, members, bank)


_UNIT = "coalesce(group_id, question_id::VARCHAR)"


@query(f"WITH RECURSIVE {_select(f"md5(request_id || '|' || {_UNIT}), {_UNIT}")} {_FLAT}")
def quiz_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole quizzes: units, seeded order, budget, flattening. The seed of a request is its number."""
    eligible, members, bank, dealt = _quiz(spark, sf_dir)
    return quiz.assemble(eligible, members, bank, _budgets(spark, sf_dir), any_member=True, parts=dealt)


# ---------------------------------------------------------------- merges: odd documents are staged, even ones the bank


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = roles.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    rows = roles.texts(spark, sf_dir).join(labels, "id", "left")
    rows = rows.select(
        "id", "subject", F.concat(F.lit("q"), F.when(F.col("id") % 9 == 1, F.floor(F.col("id") / 90)).otherwise(F.col("id")).cast("string")).alias("question_id"), "text",
        (F.coalesce(F.col("quality"), F.lit(1)) == 1).alias("candidate"), (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("valid"),
    )
    return rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")


_MERGE = f"""x AS (SELECT d.doc_id AS id, lang AS subject, 'q' || CASE WHEN d.doc_id % 9 = 1 THEN d.doc_id // 90 ELSE d.doc_id END AS question_id, {normal_sql('text')} AS n, length({normal_sql('text')}) AS c,
  coalesce(quality, 1) = 1 AS candidate, coalesce(toxic, 0) = 0 AS valid FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
xt AS MATERIALIZED (SELECT *, list_filter(list_distinct(string_split(n, ' ')), lambda t: t <> '') AS t FROM x),
conflicts AS MATERIALIZED (SELECT a.id AS low, b.id AS high, CASE WHEN a.question_id = b.question_id THEN 0 WHEN a.subject = b.subject AND a.n = b.n THEN 1 ELSE 2 END AS why, a.id % 2 = 0 AS bank
  FROM xt a JOIN xt b ON b.id % 2 = 1 AND a.id <> b.id AND (a.id % 2 = 0 OR a.id < b.id) AND b.candidate AND b.valid AND (a.id % 2 = 0 OR a.candidate AND a.valid)
   AND (a.question_id = b.question_id OR a.subject = b.subject AND (a.n = b.n OR least(a.c, b.c) >= 80 AND least(a.c, b.c) >= 0.9 * greatest(a.c, b.c)
     AND len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.94))),
todo AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM x WHERE id % 2 = 1 AND candidate AND valid AND (id IN (SELECT high FROM conflicts) OR id IN (SELECT low FROM conflicts)) AND id NOT IN (SELECT high FROM conflicts WHERE bank)),
walk AS (SELECT 0 AS i, []::BIGINT[] AS taken UNION ALL SELECT w.i + 1, CASE WHEN EXISTS (SELECT 1 FROM conflicts c WHERE c.high = t.id AND NOT c.bank AND list_contains(w.taken, c.low)) THEN w.taken ELSE list_append(w.taken, t.id) END
  FROM walk w JOIN todo t ON t.i = w.i + 1),
accepted AS (SELECT unnest(taken) AS id FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1)),
why AS (SELECT high AS id, min(why) AS why FROM conflicts WHERE bank OR low IN (SELECT id FROM accepted) GROUP BY 1),
decisions AS (SELECT x.id, subject, question_id, candidate, valid, CASE WHEN NOT candidate THEN 'not_reviewed_or_blocked' WHEN NOT valid THEN 'invalid_structure'
  WHEN why = 0 THEN 'duplicate_id' WHEN why = 1 THEN 'duplicate_question_text' WHEN why = 2 THEN 'near_duplicate_question_text' END AS reason FROM x LEFT JOIN why ON x.id = why.id WHERE x.id % 2 = 1)"""


@query(f"WITH RECURSIVE {_MERGE} SELECT * FROM decisions")
def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_decisions(*_staged(spark, sf_dir))


@query(f"""WITH RECURSIVE {_MERGE} SELECT subject, (SELECT count(*) FROM x b WHERE b.subject = d.subject AND b.id % 2 = 0) AS before, count(*) AS staged, count(*) FILTER (candidate) AS candidates, count(*) FILTER (reason IS NULL) AS merged,
count(reason) AS skipped, {', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in merge.REASONS)}, (SELECT count(*) FROM x b WHERE b.subject = d.subject AND b.id % 2 = 0) + count(*) FILTER (reason IS NULL) AS after FROM decisions d GROUP BY 1""")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged, bank = _staged(spark, sf_dir)
    return merge.merge_stats(merge.merge_decisions(staged, bank), bank)


@query(f"WITH RECURSIVE {_MERGE} SELECT id, reason, reason NOT IN ('duplicate_id', 'duplicate_question_text') AS kept_by_both FROM decisions WHERE reason IS NOT NULL")
def merge_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a merge leaves in staging, and whether one that drops duplicates leaves them too."""
    decisions = merge.merge_decisions(*_staged(spark, sf_dir))
    strict = merge.retained(decisions, drop_duplicates=True).select("id", F.lit(True).alias("strict"))
    return merge.retained(decisions).join(strict, "id", "left").select("id", "reason", F.coalesce("strict", F.lit(False)).alias("kept_by_both"))
