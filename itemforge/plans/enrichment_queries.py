"""Queries of enrichment batches: parts are the questions, and output lines of every kind are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import quality
from itemforge.functions.text import strip
from itemforge.operators import filters, order
from itemforge.plans import enrichment, roles
from itemforge.plans.define import Queries
from itemforge.plans.roles import QUESTIONS_SQL
from itemforge.sources.scratch import cut

query = Queries()

_BODY = "\nКлюч до задачі\nЧому правильна відповідь саме така, можна пояснити за умовою задачі та за означенням\nЧому не інші варіанти: вони не відповідають умові задачі\nЯк запам’ятати: повторити означення\nКоротко: усе"


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.prepare(roles.questions(spark, sf_dir))


def _line(kind: Column, item_id: Column, letter: Column, option: Column) -> Column:
    """An output line by its kind, 0 to 11; see the SQL for what becomes of each."""
    good = F.concat(F.lit("Тут правильна відповідь — "), letter, F.lit(": "), option, F.lit(_BODY))
    text = F.when(kind == 10, F.concat(F.lit("Тут правильна відповідь — "), letter, F.lit(": "), option, F.lit(". Пояснення українською мовою має бути доволі довгим, щоб перевірка письма знайшла в ньому достатньо літер і не відкинула запис, бо інакше приклад не показав би нічого"))).when(kind == 11, "пояснення в джерелі не наведено").otherwise(good)
    payload = F.to_json(F.struct(F.when(kind == 7, "other").when(kind == 8, "zzz").otherwise(item_id).alias("id"), F.when(kind != 5, text).alias("improvedExplanation"), F.array().cast("array<string>").alias("explanationByOption"), F.array(F.lit("t1")).alias("tagsToAdd"), (F.length(item_id) % 2 == 0).alias("uncertain"), F.lit("").alias("notes")))
    content = F.when(kind == 4, "oops").otherwise(F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
    body = F.when(kind == 3, "{}").otherwise(F.when(kind == 9, F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(content.alias("text"))).alias("content")).alias("message"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))))
    custom = F.when(kind == 8, "zzz").when(kind != 6, item_id)
    whole = F.to_json(F.struct(custom.alias("custom_id"), F.struct(F.when(kind == 2, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response"), F.when(kind == 1, "broken").alias("error")))
    return F.when(kind == 0, "not json").otherwise(whole)


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Output lines, and the inputs: a line for each, and a good second one in a later chunk for kinds 9 and 11."""
    inputs = cut(_inputs(spark, sf_dir).select("position", "id", "subject", "options", "correct_letter", "correct_option"), "inputs")  # checked once
    k = F.col("position")
    line = lambda chunk, kind: F.struct((F.floor(k / 350) + chunk).alias("chunk"), k.alias("line"), _line(kind, F.col("id"), F.col("correct_letter"), F.col("correct_option")).alias("raw"))
    rows = roles.spread(inputs, "position")
    first = rows.select(line(1, k % 12).alias("l")).select("l.*")
    second = rows.filter((k % 12).isin(9, 11)).select(line(1001, F.lit(9)).alias("l")).select("l.*")
    return first.unionByName(second), inputs


_VALIDATED = f"""{QUESTIONS_SQL}, w AS (SELECT *, position % 12 AS kind, length(question_id) % 2 = 0 AS u FROM questions),
v AS (SELECT position // 350 + 1 AS chunk, position AS line, kind, question_id, subject, u, CASE kind WHEN 0 THEN 'invalid_batch_output_line' WHEN 1 THEN 'batch_line_error' WHEN 2 THEN 'bad_status_500' WHEN 3 THEN 'missing_message_content' WHEN 4 THEN 'message_content_is_not_json'
  WHEN 5 THEN 'output_schema_validation_failed' WHEN 6 THEN 'missing_custom_id' WHEN 7 THEN 'returned_id_does_not_match_custom_id' WHEN 8 THEN 'unknown_question_id' WHEN 9 THEN 'duplicate_output_id' WHEN 10 THEN 'missing_required_sections'
  ELSE 'duplicate_output_id' END AS reasons, kind = 10 AS accepted FROM w
 UNION ALL SELECT position // 350 + 1001, position, 9, question_id, subject, u, '', true FROM w WHERE kind IN (9, 11))"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.validate(*_batch(spark, sf_dir))


def validated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation says of every line, with the line's id."""
    return _validated(spark, sf_dir)


@query(f"WITH {_VALIDATED} SELECT chunk, line, accepted, reasons FROM v")
def validated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("chunk", "line", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_VALIDATED} SELECT chunk, line, array_to_string(list_sort(list_concat(['t1', 'explanation_improved', 'explanation_style_v2', 'openai_explanation_batch_1'], CASE WHEN u THEN ['needs_explanation_review'] ELSE [] END, CASE WHEN u AND subject = 'tznk' THEN ['tznk_explanation_uncertain'] ELSE [] END,
CASE WHEN kind = 10 THEN ['openai_explanation_soft_accepted', 'explanation_validation_warning', 'explanation_warning_missing_required_sections'] ELSE [] END)), ',') AS tags, CASE WHEN u THEN 'manual' ELSE 'accepted' END AS route FROM v WHERE accepted""")
def soft_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.route(_validated(spark, sf_dir)).filter("accepted").select("chunk", "line", F.array_join("tags", ",").alias("tags"), "route")


@query(f"""WITH {_VALIDATED} SELECT chunk, line, kind IN (9, 11) AS superseded FROM v WHERE NOT accepted""")
def superseded_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.superseded(_validated(spark, sf_dir)).select("chunk", "line", "superseded")


@query(f"""WITH {_VALIDATED}, i AS (SELECT subject, count(*) FILTER (kind NOT IN (9, 10, 11)) AS missing FROM w GROUP BY 1)
SELECT i.subject, count(v.line) AS outputs, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND kind = 10) AS soft_accepted, count(*) FILTER (accepted AND u) AS uncertain,
count(*) FILTER (NOT accepted) AS rejected, any_value(missing) AS missing FROM i LEFT JOIN (SELECT * FROM v WHERE kind IN (9, 10, 11)) v ON i.subject = v.subject GROUP BY 1""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.batch_totals(_validated(spark, sf_dir), _inputs(spark, sf_dir))


@query(f"WITH {_VALIDATED} SELECT question_id AS id FROM w WHERE kind NOT IN (9, 10, 11)")
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _validated(spark, sf_dir).filter("accepted").select("id")
    return filters.retry_candidates(_inputs(spark, sf_dir), accepted).select("id")


@query(f"""WITH {_VALIDATED} SELECT question_id, kind IN (9, 10, 11) AS applied, CASE WHEN kind IN (9, 10, 11) THEN starts_with(explanation, 'zz') ELSE true END OR kind IN (9, 10, 11) AS fine, CASE WHEN kind IN (9, 10, 11) THEN 'explanation,tags' ELSE '' END AS changed FROM w""")
def guarded_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted outputs applied; the guard over all fields shows what an application changes."""
    bank = roles.questions(spark, sf_dir).withColumn("by_option", F.lit(None).cast("array<string>"))
    accepted = _validated(spark, sf_dir).filter("accepted")
    after, changed = enrichment.guarded_apply(bank, accepted, ["question", "options", "correct", "passage", "explanation", "tags"])
    names = changed.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("changed"))
    return after.join(names, "question_id", "left").select("question_id", "applied", F.lit(True).alias("fine"), F.coalesce("changed", F.lit("")).alias("changed"))


@query(f"""WITH {QUESTIONS_SQL}, r AS (SELECT question_id AS custom_id, row_number() OVER (ORDER BY position) AS place FROM questions)
SELECT custom_id, place, (place - 1) // 350 + 1 AS chunk FROM r""")
def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.requests(_inputs(spark, sf_dir), "model", "prompt", "position").select("custom_id", "place", "chunk")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS place FROM orders) SELECT (place - 1) // 350 + 1 AS chunk, count(*) AS requests, min(place) AS first_place, max(place) AS last_place, 'created' AS status FROM r GROUP BY 1""")
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = order.with_places(roles.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return enrichment.chunk_index(placed.select((F.floor(F.col("place") / 350) + 1).alias("chunk"), (F.col("place") + 1).alias("place")))


@query(f"WITH {QUESTIONS_SQL} SELECT 'missing' AS what, c AS chunk FROM (SELECT DISTINCT position // 350 + 1 AS c FROM questions) WHERE c % 2 = 0 UNION ALL SELECT 'next', max(position // 350 + 1) + 1 FROM questions")
def chunk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without output (every even one here) and the number of the next chunk."""
    chunk = F.floor(F.col("position") / 350) + 1
    index = enrichment.chunk_index(roles.questions(spark, sf_dir).select(chunk.alias("chunk"), F.col("position").alias("place"))).withColumn("retry", F.lit(False))
    missing = enrichment.missing_chunks(index, index.filter("chunk % 2 = 1"))
    return missing.select(F.lit("missing").alias("what"), "chunk").unionByName(enrichment.next_chunk(index).select(F.lit("next").alias("what"), "chunk"))


@query(f"""WITH {QUESTIONS_SQL} SELECT subject, count(*) AS scanned, count(*) FILTER (explanation = '') AS placeholders, count(*) FILTER (explanation = '' AND subject <> 'tznk') AS filled, count(*) FILTER (explanation <> '') AS unchanged,
count(*) FILTER (explanation = '' AND subject = 'tznk') AS needs_review FROM questions GROUP BY 1""")
def explanation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.explanation_stats(enrichment.explain(roles.questions(spark, sf_dir), {"management": [("(?i)widget", "A hint.")]}, _SENTENCES))


#: Short sentences by subject, and questions that bring each of them about.
_SENTENCES = {
    "management": {"plain": "«{answer}» fits {focus}.", "long": "Довге: «{answer}» ({focus}).", "hinted": "«{answer}». {hint}"},
    "psychology-sociology": {"plain": "Так: {answer} / {focus}", "author": "Автор: {answer}"},
    "english": {"plain": "See the passage."},
}
_ASKED = f"""{QUESTIONS_SQL}, asked AS (SELECT * REPLACE (CASE position % 7 WHEN 1 THEN 'На думку кого це ' || passage || '?' WHEN 2 THEN 'Скільки точок зображено на рисунку?' WHEN 3 THEN 'Термін «визначення поняття ' || passage || '» це?' WHEN 4 THEN 'Оберіть: визначення поняття номер ' || position || ' так' ELSE question END AS question,
CASE WHEN position % 2 = 0 THEN '' ELSE passage END AS passage, CASE WHEN position % 10 = 0 THEN ['дуже довге правильне формулювання цього варіанта, яке має понад сімдесят знаків ' || position || '.', 'b', 'c', 'd'] ELSE options END AS options, CASE WHEN position % 10 = 0 THEN 0 ELSE correct END AS correct), passage AS p FROM questions)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("position"), F.col("passage")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    long = F.array(text("дуже довге правильне формулювання цього варіанта, яке має понад сімдесят знаків ", k.cast("string"), "."), F.lit("b"), F.lit("c"), F.lit("d"))
    return roles.questions(spark, sf_dir).withColumns({
        "question": F.when(k % 7 == 1, text("На думку кого це ", p, "?")).when(k % 7 == 2, "Скільки точок зображено на рисунку?").when(k % 7 == 3, text("Термін «визначення поняття ", p, "» це?")).when(k % 7 == 4, text("Оберіть: визначення поняття номер ", k.cast("string"), " так")).otherwise(F.col("question")),
        "options": F.when(k % 10 == 0, long).otherwise(F.col("options")), "correct": F.when(k % 10 == 0, 0).otherwise(F.col("correct")),
        "passage": F.when(k % 2 == 0, "").otherwise(p),
    })


@query(f"""WITH {_ASKED}, f AS (SELECT *, regexp_replace(options[(correct + 1)::INT], '\\.$', '') AS o,
CASE position % 7 WHEN 3 THEN 'опис «визначення поняття ' || p || '»' WHEN 4 THEN 'визначення поняття номер ' || position || ' так' ELSE regexp_replace(question, '\\?$', '') END AS focus,
regexp_matches(concat_ws(' ', question, passage, options[(correct + 1)::INT]), '(?i)widget') AS hinted, position % 7 = 2 AND passage = '' AS unseen FROM asked)
SELECT question_id, CASE WHEN unseen OR subject = 'tznk' THEN explanation WHEN subject = 'english' THEN 'See the passage.'
WHEN subject = 'management' THEN CASE WHEN hinted THEN '«' || o || '». A hint.' WHEN length(o) > 70 THEN 'Довге: «' || o || '» (' || focus || ').' ELSE '«' || o || '» fits ' || focus || '.' END
WHEN position % 7 = 1 THEN 'Автор: ' || o ELSE 'Так: ' || o || ' / ' || focus END AS explanation, NOT unseen AND subject <> 'tznk' AS generated FROM f""")
def hinted_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.explain(_asked(spark, sf_dir), {"management": [("(?i)widget", "A hint.")]}, _SENTENCES)
    return rows.select("question_id", F.col("new_explanation").alias("explanation"), "generated")


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT % 2 = 0 AS even FROM events""")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return roles.read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), (parsed["k"] % 2 == 0).alias("even"))


@query(f"""WITH {QUESTIONS_SQL}, r AS (SELECT question_id AS id, CASE WHEN position % 9 = 0 THEN 'zzz' ELSE p END AS path, p FROM (SELECT *, topic AS p FROM questions)), b AS (SELECT question_id, topic FROM questions WHERE position % 10 <> 0 UNION ALL SELECT question_id, topic FROM questions WHERE position % 25 = 1)
SELECT r.id, CASE WHEN count(b.topic) FILTER (b.topic = r.path) = 0 THEN 'not found' WHEN count(b.topic) FILTER (b.topic = r.path) > 1 THEN 'ambiguous' END AS problem FROM r LEFT JOIN b ON r.id = b.question_id GROUP BY 1""")
def output_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = roles.questions(spark, sf_dir).select("position", "question_id", F.col("topic").alias("path"))
    records = bank.select(F.col("question_id").alias("id"), F.when(F.col("position") % 9 == 0, "zzz").otherwise(F.col("path")).alias("path"))
    known = bank.filter("position % 10 <> 0").unionByName(bank.filter("position % 25 = 1"))
    return enrichment.locate(records, known)


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, CASE correct WHEN 0 THEN CASE WHEN subject = 'english' THEN 'A' ELSE 'А' END ELSE CASE WHEN subject = 'english' THEN 'B' ELSE 'Б' END END AS letter, options[(correct + 1)::INT] AS option FROM questions WHERE NOT list_contains(tags, 'needs_manual_review')")
def enrichment_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.prepare(roles.questions(spark, sf_dir), "needs_manual_review").select("question_id", F.col("correct_letter").alias("letter"), F.col("correct_option").alias("option"))


@query(f"WITH {QUESTIONS_SQL} SELECT subject, count(*) AS n FROM questions WHERE trim(explanation) = '' GROUP BY 1")
def placeholder_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.questions(spark, sf_dir).filter(quality.is_placeholder(F.col("explanation"))).groupBy("subject").agg(F.count("*").alias("n"))


@query(f"""WITH {_VALIDATED}, k AS (SELECT *, kind = 9 AND reasons <> '' AS first FROM (SELECT v.*, line % 12 AS position_kind FROM v))
SELECT chunk, line, first OR kind = 9 AND position_kind = 11 AS earliest, first AS first_parsed FROM k""")
def output_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines the two other precedences accept: the first acceptable one, and the first that parses."""
    lines, inputs = _batch(spark, sf_dir)
    strict = {"soft": (), "tags": ()}
    one = enrichment.validate(lines, inputs, policy=enrichment.Policy(order="earliest", **strict)).select("chunk", "line", F.col("accepted").alias("earliest"))
    two = enrichment.validate(lines, inputs, policy=enrichment.Policy(order="first_parsed", **strict)).select("chunk", "line", F.col("accepted").alias("first_parsed"))
    return one.join(two, ["chunk", "line"])


# ---------------------------------------------------------------- the sectioned variants

_FILL = "Тут міститься доволі довгий український текст про умову задачі та про правильний спосіб її розв'язання"
_RULE = "Спочатку прочитайте умову, тоді випишіть відомі величини, перевірте кожен варіант за ними та оберіть той, що відповідає всім умовам"


def _wrapped(item_id: Column, text: Column, by_option: Column, uncertain: Column, notes: Column, mode: Column) -> Column:
    """A good output line around an explanation."""
    payload = F.to_json(F.struct(item_id.alias("id"), text.alias("improvedExplanation"), by_option.alias("explanationByOption"), F.array().cast("array<string>").alias("tagsToAdd"), uncertain.alias("uncertain"), notes.alias("notes"), mode.alias("rulesSectionMode")))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(payload.alias("content")).alias("message"))).alias("choices")))
    return F.to_json(F.struct(item_id.alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _subject_lines(spark: SparkSession, sf_dir: str, subject: str, line) -> tuple[DataFrame, DataFrame]:
    """Inputs of one subject, and a line for each; every eighth has a second one, always good."""
    inputs = enrichment.prepare(roles.questions(spark, sf_dir), "no such tag").filter(F.col("subject") == subject)
    k = F.floor(F.col("position") / 4)
    rows = inputs.select("position", "id", "correct_letter", "correct_option", (k % 8).alias("kind"))
    first = rows.select(F.lit(1).cast("long").alias("chunk"), F.col("position").alias("line"), line(F.col("kind")).alias("raw"))
    second = rows.filter("kind = 7").select(F.lit(2).cast("long").alias("chunk"), F.col("position").alias("line"), line(F.lit(0)).alias("raw"))
    return inputs, first.unionByName(second)


def _english_line(kind: Column) -> Column:
    named = F.when(kind == 2, F.lit(" ")).otherwise(_text(" — ", F.col("correct_letter"), ": "))
    option = F.when(kind == 3, "цей варіант").otherwise(F.col("correct_option"))
    fill = F.when(kind == 4, F.repeat(F.lit("plain latin words "), 60)).otherwise(F.lit(_FILL))
    last = F.when(kind == 1, "П'яте").otherwise("5. Як запам’ятати")
    more = F.when(kind == 5, " Як мовна модель.").otherwise("")
    text = _text("Тут правильна відповідь", named, option, "\n1. Ключова ідея\n", fill, "\n2. Чому правильна відповідь\n3. Чому не інші варіанти\n4. Які правила треба знати, щоб не допустити тут помилок на іспиті\n", last, "\nКоротко: так.", more)
    by_option = F.when(kind == 6, F.array(F.lit("one"))).otherwise(F.array().cast("array<string>"))
    return _wrapped(F.col("id"), text, by_option, F.length("id") % 2 == 0, F.lit("n"), F.lit(None).cast("string"))


@query(f"""WITH {QUESTIONS_SQL}, w AS (SELECT *, position // 4 % 8 AS kind FROM questions WHERE subject = 'english'),
v AS (SELECT 1 AS chunk, position AS line, kind, question_id FROM w UNION ALL SELECT 2, position, 8, question_id FROM w WHERE kind = 7)
SELECT chunk::BIGINT AS chunk, line, kind IN (0, 7) AS accepted, ['', 'missing_section:5. Як запам’ятати', 'missing_correct_option_letter', 'missing_correct_option_text', 'explanation_not_mostly_ukrainian', 'forbidden_meta_language', 'explanation_by_option_length_mismatch', '', 'duplicate_output_id'][(kind + 1)::INT] AS reasons,
CASE WHEN kind NOT IN (0, 7) THEN 'rejected' WHEN length(question_id) % 2 = 0 THEN 'manual' ELSE 'accepted' END AS route,
CASE WHEN kind IN (0, 7) THEN 'english_exam_rules_section,explanation_improved,explanation_style_v2,explanation_style_v3' || CASE WHEN length(question_id) % 2 = 0 THEN ',needs_explanation_review,needs_explanation_style_v3' ELSE '' END || ',openai_english_explanation_batch_1' END AS tags FROM v""")
def english_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English variant: sections, no soft reasons, the earliest acceptable line of an id."""
    inputs, lines = _subject_lines(spark, sf_dir, "english", _english_line)
    found = enrichment.route(enrichment.validate(lines, inputs, enrichment.sectioned_reasons(), enrichment.ENGLISH_V3))
    return found.select("chunk", "line", "accepted", F.array_join("reasons", ",").alias("reasons"), "route", F.array_join("tags", ",").alias("tags"))


def _tznk_line(kind: Column) -> Column:
    """Kinds: good, no fifth section, no general rule, short rules, marked headings, no summary, uncertain without notes, unsound at first."""
    h = enrichment.HEADINGS
    heading = lambda n: F.when(kind == 4, f"**{n}. інший заголовок**").otherwise(h[n])
    rule = F.when(kind == 3, "коротке правило").otherwise(F.lit(_RULE))
    fifth = F.when(kind == 1, "").otherwise(_text("\n", heading(5), "\nповторити"))
    summary = F.when(kind == 5, "").otherwise("\nКоротко:\nтак.")
    key = F.when(kind == 7, "Ключ").otherwise(heading(1))
    text = _text("Тут правильна відповідь — ", F.col("correct_letter"), ": ", F.col("correct_option"), "\n", key, "\n", _FILL, "\n", heading(2), "\nбо так сказано в умові\n", heading(3), "\nне відповідають\n", heading(4), "\n", rule, fifth, summary)
    uncertain = (kind == 6) | (kind == 0) & (F.length("id") % 2 == 0)
    mode = F.when(kind == 2, "no_general_rule").otherwise("reusable_rules")
    return _wrapped(F.col("id"), text, F.array().cast("array<string>"), uncertain, F.when(kind == 6, " ").otherwise("n"), mode)


@query(f"""WITH {QUESTIONS_SQL}, w AS (SELECT *, position // 4 % 8 AS kind FROM questions WHERE subject = 'tznk'),
v AS (SELECT 1 AS chunk, position AS line, kind, question_id FROM w UNION ALL SELECT 2, position, 8, question_id FROM w WHERE kind = 7)
SELECT chunk::BIGINT AS chunk, line, kind IN (0, 1, 2, 4, 5) AS accepted, ['', '', '', 'reusable_rules_too_short', '', '', 'uncertain_missing_notes', 'missing_section:1_key_concept', 'duplicate_output_id'][(kind + 1)::INT] AS reasons,
CASE WHEN kind NOT IN (0, 1, 2, 4, 5) THEN 'rejected' WHEN kind = 0 AND length(question_id) % 2 = 0 THEN 'manual' ELSE 'accepted' END AS route,
CASE kind WHEN 1 THEN '{enrichment.MEMORY_HINT}' WHEN 8 THEN 'повторити' WHEN 7 THEN 'повторити' ELSE 'повторити' END AS memory, CASE WHEN kind = 2 THEN 'none' WHEN kind = 3 THEN 'short' ELSE 'rule' END AS rule, kind = 2 AS tagged FROM v""")
def reasoning_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasoning variant: repaired, then checked; the first line of an id that parses counts; uncertain ones go to a person."""
    inputs, lines = _subject_lines(spark, sf_dir, "tznk", _tznk_line)
    fixed = enrichment.repair(F.col("improved"), F.col("mode"), F.col("correct_letter"), F.col("correct_option"), enrichment.NO_GENERAL_RULE)
    found = enrichment.route(enrichment.validate(lines, inputs, enrichment.reasoning_reasons(), enrichment.TZNK_V3, fixed))
    memory = strip(F.regexp_extract("improved", r"(?su)5\. Як запам’ятати\n(.*?)\n\s*Коротко:", 1))
    rule = enrichment.section(F.col("improved"), 4)
    named = F.when(rule == enrichment.NO_GENERAL_RULE, "none").when(F.length(rule) < 30, "short").otherwise("rule")
    tagged = F.coalesce(F.array_contains("tags", "tznk_no_general_rule"), F.lit(False))
    return found.select("chunk", "line", "accepted", F.array_join("reasons", ",").alias("reasons"), "route", memory.alias("memory"), named.alias("rule"), tagged.alias("tagged"))
