"""Queries of HTML clean-up and extraction. The driver's pages hold no task cards, so a page is dressed as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import html, quality, urls
from itemforge.plans import extraction, roles
from itemforge.plans.define import Queries

query = Queries()

_TIDY = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_STRIP = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>\\s*<p[^>]*>', chr(10) || chr(10), 'g'), '(?i)</div>\\s*<div[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_NAMES = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


@query(f"SELECT page_id, {_TIDY(_NAMES(_STRIP('html')))} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.read(spark, sf_dir, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query(f"""WITH p AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda h: {_TIDY(_NAMES(_STRIP('h')))}), lambda t: t <> '') AS l FROM pages)
SELECT page_id, unnest(range(0, len(l)))::INT AS place, unnest(l) AS paragraph FROM p WHERE len(l) > 0 UNION ALL SELECT page_id, 0, {_TIDY(_NAMES(_STRIP('html')))} FROM p WHERE len(l) = 0""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.paragraphs(F.col("html"))).alias("place", "paragraph"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/:?#]+)', 1)), '^www\\.', '') AS site, nullif(regexp_extract(regexp_replace(url, '[?#].*', ''), '-([0-9]+)$', 1), '')::BIGINT AS suffix,
nullif(regexp_extract(url, '(?:^|[^A-Za-z0-9_])(20[0-9]{2})(?:[^A-Za-z0-9_]|$)', 1), '')::INT AS year FROM pages""")
def page_site_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return roles.read(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("site"), urls.id_suffix(F.regexp_replace(url, "[?#].*", "")).alias("suffix"), urls.infer_year(F.lit("public_source"), url, F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("year"))


_SET_ROWS = """r AS (SELECT p_partkey AS k, ['tznk','english','management','psychology-sociology'][(p_partkey % 4 + 1)::INT] AS subject, CASE WHEN p_size % 3 = 0 THEN 'generated' ELSE 'public_source' END AS source_type,
  CASE p_partkey % 3 WHEN 0 THEN 'https://zno.osvita.ua/a/all/' || (p_size * 15) || '/' WHEN 1 THEN 'https://zno.osvita.ua/a/list.html' ELSE 'https://example.org/' || p_size END AS url,
  CASE WHEN p_partkey % 3 < 2 THEN 'zno.osvita.ua' ELSE 'example.org' END AS host FROM part),
o AS (SELECT *, CASE p_partkey_mod WHEN 0 THEN nullif(regexp_extract(url, '/all/([0-9]+)/$', 1), '')::BIGINT WHEN 1 THEN 0 END AS page_offset FROM (SELECT *, k % 3 AS p_partkey_mod FROM r))"""


@query(f"""WITH {_SET_ROWS} SELECT k, page_offset, CASE WHEN source_type = 'generated' THEN 'generated' ELSE host END AS site, coalesce(page_offset * 1000 + k, k) AS source_order,
CASE WHEN source_type <> 'generated' AND host = 'zno.osvita.ua' THEN subject || '-zno-osvita-' || page_offset END AS set_id,
CASE WHEN source_type <> 'generated' AND host = 'zno.osvita.ua' THEN 'Архівна сторінка ' || page_offset END AS variant FROM o""")
def source_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://zno.osvita.ua/a/all/"), (size * 15).cast("string"), F.lit("/"))).when(k % 3 == 1, "https://zno.osvita.ua/a/list.html").otherwise(F.concat(F.lit("https://example.org/"), size.cast("string")))
    rows = roles.read(spark, sf_dir, "part").select(k.alias("k"), F.element_at(F.array(*map(F.lit, roles.SUBJECTS)), (k % 4 + 1).cast("int")).alias("subject"), F.when(size % 3 == 0, "generated").otherwise("public_source").alias("source_type"), url.alias("url"), F.concat(F.lit("x-"), k.cast("string")).alias("id"))
    rows = rows.withColumn("site", urls.source_site(F.col("source_type"), F.col("url")))
    set_id = urls.exam_set_id(F.col("subject"), F.col("id"), F.col("source_type"), F.col("site"), F.col("url"), F.lit(None).cast("int"), F.lit(None).cast("array<string>"))
    return rows.select("k", urls.page_offset(F.col("url")).alias("page_offset"), "site", urls.source_order(F.col("id"), F.col("url"), F.lit(0)).alias("source_order"), set_id.alias("set_id"), F.when(set_id.isNotNull(), urls.exam_set_variant(set_id, F.col("site"), F.col("url"))).alias("variant"))


@query("""WITH s AS (SELECT page_id AS source, 'https://h/' || page_id AS base, (page_id * 7) % 100 AS total FROM pages)
SELECT source, total::INT AS total, o::INT AS "offset", CASE WHEN o = 0 THEN base || '/list.html' ELSE base || '/all/' || o || '/' END AS url FROM (SELECT *, unnest(range(0, total, 15)) AS o FROM s)""")
def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    sources = roles.read(spark, sf_dir, "pages").select(k.alias("source"), F.concat(F.lit("https://h/"), k.cast("string")).alias("base"), F.concat(F.lit("Завдання 1 з "), (k * 7 % 100).cast("string")).alias("html"))
    return extraction.list_pages(sources).select("source", "total", "offset", "url")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '' WHEN (page_id * 5) % 50 = 0 THEN 'https://h/' || (page_id % 3) || '/list.html' ELSE 'https://h/' || (page_id % 3) || '/all/' || ((page_id * 5) % 50) || '/' END AS url FROM pages""")
def file_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    files = roles.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("data/raw/f"), (k % 3).cast("string"), F.lit("/page-"), F.lpad((k * 5 % 50).cast("string"), 4, "0"), F.lit(".html")).alias("path"))
    sources = spark.createDataFrame([("f0", "https://h/0"), ("f1", "https://h/1")], "folder string, base string")
    return extraction.address_of_file(files, sources).select("page_id", "url")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dressed as task cards: the question from the title, options from the menu."""
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    items = F.regexp_extract_all("html", F.lit("<li><a[^>]*>(.*?)</a>"), 1)
    card = F.concat(
        F.lit('<div class="task-card x" id="q1"><div class="counter">Завдання '), (k % 60).cast("string"), F.lit(' з 60</div><input name="q[id]" value="'), k.cast("string"), F.lit('"><input name="q[tip]" type="hidden" value="'),
        F.when(k % 10 == 0, "2").otherwise("1"), F.lit('"><input name="result" value="'), F.substring(F.lit("ABCDEFG"), (k % 7 + 1).cast("int"), F.lit(1)), F.lit('"><div class="question"> <p>'), title, F.lit('</p></div> <div class="clear"></div><div class="answers">'),
        F.array_join(F.transform(items, lambda i: F.concat(F.lit('<div class="answer"><span class="marker">A</span>'), i, F.lit("</div>"))), ""), F.lit('</div> <div class="clear mb10">'),
    )
    return roles.read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("<html>"), card, card).alias("html"))


@query(f"""WITH p AS (SELECT page_id, url, {_TIDY(_NAMES("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS q, list_filter(list_transform(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a>', 1), lambda x: trim(x)), lambda x: x <> '') AS o FROM pages), b AS (SELECT unnest([0, 1])::INT AS block_order)
SELECT page_id, block_order, (page_id % 60)::INT AS number, page_id::VARCHAR AS source_id, q AS question, array_to_string(o, '|') AS options, CASE WHEN page_id % 7 < 5 THEN (page_id % 7)::INT END AS correct,
CASE WHEN page_id % 10 <> 0 AND page_id % 7 < 5 AND len(o) >= 4 THEN 'high' ELSE 'low' END AS confidence,
CASE WHEN page_id % 10 = 0 OR page_id % 7 >= 5 OR len(o) < 4 OR q = '' THEN 'unsupported or incomplete task block' END AS skip_reason FROM p, b""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.task_blocks(_cards(spark, sf_dir)).drop("url", "explanation").withColumn("options", F.array_join("options", "|"))


@query("""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a>', 1), lambda x: trim(x)), lambda x: x <> '') AS o FROM pages)
SELECT page_id, (page_id % 40)::INT AS number, 'Question ' || (page_id % 40) AS question, array_to_string(o, '|') AS options, CASE WHEN page_id % 9 < len(o) THEN (page_id % 9)::INT END AS correct, CASE WHEN page_id % 9 < len(o) THEN 'high' ELSE 'low' END AS confidence
FROM p WHERE len(o) > 0 AND page_id % 40 <= 30""")
def choice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    items = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<li><a[^>]*>(.*?)</a>"), 1), lambda x: F.trim(x)), lambda x: x != "")
    buttons = F.array_join(F.transform(items, lambda x, i: F.concat(F.lit('<a class="b button-choice" d-button-text="'), x, F.lit('" d-ca-score="'), F.when(i == k % 9, "1").otherwise("0"), F.lit('">'))), "")
    pages = roles.read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit('<div class="inside-form-block t-question q-num-'), (k % 40).cast("string"), F.lit('"><h2> </h2>'), buttons).alias("html"))
    return extraction.choice_blocks(pages).select("page_id", "number", "question", F.array_join("options", "|").alias("options"), "correct", "confidence")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as a printed test: every fifth line opens an item, the next four are options, some marked."""
    lines = roles.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda l: F.trim(F.translate(l, "©\f\r", "")))).alias("line_number", "line")).filter("line <> ''")
    n = F.col("line_number")
    dressed = F.when(n % 6 == 0, F.concat((n % 997 + 1).cast("string"), F.lit(". "), "line")).when(n % 6 < 5, F.concat(F.when((n + F.col("doc_id")) % 7 == 0, "(x) ").otherwise("() "), "line")).otherwise(F.col("line"))
    return lines.select("doc_id", "line_number", dressed.alias("line"), F.lit(1).alias("page"))


_LINES = r"""l0 AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS n, unnest(s) AS raw FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: trim(translate(l, '©' || chr(12) || chr(13), ''))) AS s FROM documents)),
l1 AS (SELECT doc_id, n, CASE WHEN n % 6 = 0 THEN (n % 997 + 1) || '. ' || raw WHEN n % 6 < 5 THEN CASE WHEN (n + doc_id) % 7 = 0 THEN '(x) ' ELSE '() ' END || raw ELSE raw END AS line FROM l0 WHERE raw <> ''),
l2 AS (SELECT *, regexp_matches(line, '^\d{1,3}\.\s+') AS starts, regexp_matches(line, '(?i)^\((x\s*)?\)') AND NOT regexp_matches(line, '^\d{1,3}\.\s+') AS opts FROM l1 WHERE NOT regexp_matches(line, '^\d+$')),
l AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS item FROM l2),
m AS (SELECT *, sum(CASE WHEN opts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item ORDER BY n) AS opt FROM l WHERE item > 0),
parts AS (SELECT doc_id, item, opt, trim(regexp_replace(string_agg(CASE WHEN starts THEN regexp_replace(line, '^\d{1,3}\.\s+', '') WHEN opts THEN regexp_replace(line, '(?i)^\((x\s*)?\)\s*', '') ELSE line END, ' ' ORDER BY n), '\s+', ' ', 'g')) AS text,
  max(CASE WHEN starts THEN regexp_extract(line, '^(\d{1,3})\.', 1)::INT END) AS number, bool_or(opts AND regexp_matches(line, '(?i)^\(x')) AS marked FROM m GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY opt) - 1 AS i FROM (SELECT * REPLACE (trim(regexp_replace(text, '^\(?[xXхХ]?\)?\s*', '')) AS text) FROM parts WHERE opt > 0) WHERE text <> ''),
items AS (SELECT p.doc_id, p.item, p.number, p.text AS question, (SELECT string_agg(o.text, '|' ORDER BY o.i) FROM o WHERE o.doc_id = p.doc_id AND o.item = p.item AND o.i < 4) AS options,
  (SELECT min(o.i) FROM o WHERE o.doc_id = p.doc_id AND o.item = p.item AND marked) AS correct, (SELECT count(*) FROM o WHERE o.doc_id = p.doc_id AND o.item = p.item) AS k FROM parts p WHERE p.opt = 0)"""


@query(f"WITH {_LINES} SELECT doc_id, item, number::INT AS number, question, options, correct::INT AS correct, CASE WHEN correct IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM items WHERE k >= 4 AND question <> ''")
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = extraction.complete_items(extraction.numbered_items(_lines(spark, sf_dir)))
    return items.select("doc_id", "item", "number", "question", F.array_join("options", "|").alias("options"), "correct", "confidence")


@query(f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id, item) AS s FROM items WHERE k >= 4 AND question <> '')
SELECT 's' || (doc_id % 4) || '-doc-' || CASE WHEN s < 1000 THEN lpad(s::VARCHAR, 3, '0') ELSE s::VARCHAR END AS question_id, doc_id, item, coalesce(correct, 0)::INT AS correct, CASE WHEN correct IS NULL THEN 'needs_manual_review,needs_answer_review' ELSE '' END AS tags, correct IS NOT NULL AS reviewed FROM r""")
def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = extraction.complete_items(extraction.numbered_items(_lines(spark, sf_dir)))
    raw = items.withColumns({"subject": F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")), "position": F.struct("doc_id", "item")})
    return extraction.to_questions(raw, "doc").select("question_id", "position.doc_id", "position.item", "correct", F.array_join("tags", ",").alias("tags"), "reviewed")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS number, max(l_suppkey * 10 + l_partkey % 10) AS last FROM lineitem GROUP BY 1, 2) SELECT doc_id, number, (last % 4)::INT AS correct FROM c""")
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_suppkey") * 10 + F.col("l_partkey") % 10
    lines = roles.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("line_number"), F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1))).alias("line"))
    return extraction.answer_key(lines)


@query("""SELECT doc_id, n - 1 AS place, n AS number, l AS block FROM (SELECT doc_id, unnest(range(1, len(s) + 1))::INT AS n, trim(unnest(s)) AS l FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^[0-9]+\\. ', '')), lambda x: x <> '') AS s FROM documents)) WHERE n BETWEEN 2 AND 5""")
def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[0-9]+\. ", "")), lambda x: x != "")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return extraction.numbered_blocks(roles.read(spark, sf_dir, "documents").select("doc_id", numbered.alias("text")), 2, 5)


_TOPIC = "CASE WHEN contains(low, 'скільки') OR regexp_matches(low, '[0-9]') THEN 'Кількісні міркування' WHEN contains(low, 'твердження') OR contains(low, 'умов') OR contains(low, 'груп') THEN 'Аналітичне мислення' WHEN contains(low, 'текст') THEN 'Критичне читання' ELSE 'Логічне мислення' END"


@query(f"""SELECT doc_id, CASE WHEN contains(low, 'main idea') OR contains(low, 'main purpose') OR contains(low, 'main topic') THEN 'Main idea' WHEN contains(low, 'infer') OR contains(low, 'suggest') OR contains(low, 'imply') THEN 'Inference'
WHEN contains(low, 'mean') OR contains(low, 'refer') THEN 'Vocabulary in context' ELSE 'Detail understanding' END AS reading, {_TOPIC} AS reasoning,
CASE WHEN doc_id % 40 <= 11 THEN 'Reading comprehension' WHEN doc_id % 4 = 0 THEN 'Cloze tests' ELSE 'Use of English' END AS english, CASE WHEN lang = 'de' THEN 'medium' WHEN doc_id % 10 IN (0, 9) THEN 'hard' WHEN doc_id % 10 <= 2 THEN 'easy' ELSE 'medium' END AS difficulty FROM (SELECT *, lower(text) AS low FROM documents)""")
def text_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, k = F.col("text"), F.col("doc_id")
    subject = F.when(F.col("lang") == "de", "management").otherwise(F.col("lang"))
    return roles.read(spark, sf_dir, "documents").select("doc_id", extraction.reading_subtopic(text).alias("reading"), extraction.reasoning_topic(text).alias("reasoning"), extraction.english_topic(k % 40, F.when(k % 4 == 0, F.concat(text, F.lit(" ______"))).otherwise(F.lit("none"))).alias("english"), extraction.difficulty_of(subject, k).alias("difficulty"))


# ---------------------------------------------------------------- two columns, clean-up, explanations


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents printed in two columns: the line's first 54 characters at the left, the whole line as test text at the right."""
    lines = roles.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda l: F.trim(F.translate(l, "©\f\r\t", "")))).alias("line_number", "line")).filter("line <> ''")
    n = F.col("line_number")
    right = F.when(n % 6 == 0, F.concat((n % 99 + 1).cast("string"), F.lit(" "), "line")).when(n % 6 < 5, F.concat(F.substring(F.lit("DABCD"), n % 6 + 1, F.lit(1)), F.lit(" "), "line")).otherwise(F.col("line"))
    return lines.select("doc_id", "line_number", F.concat(F.rpad(F.substring("line", 1, 54), 54, " "), right).alias("line"), F.lit(1).alias("page"))


_COLUMNS = r"""c0 AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS n, unnest(s) AS raw FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: trim(translate(l, '©' || chr(12) || chr(13) || chr(9), ''))) AS s FROM documents)),
c1 AS (SELECT doc_id, n, trim(substr(raw, 1, 54)) AS left_line, CASE WHEN n % 6 = 0 THEN (n % 99 + 1) || ' ' || raw WHEN n % 6 < 5 THEN substr('DABCD', n % 6 + 1, 1) || ' ' || raw ELSE raw END AS line FROM c0 WHERE raw <> ''),
passages AS (SELECT doc_id, trim(regexp_replace(string_agg(left_line, ' ' ORDER BY n), '\s+', ' ', 'g')) AS passage FROM c1 WHERE left_line <> '' GROUP BY 1),
c2 AS (SELECT *, regexp_matches(line, '^\d{1,2}\s') AS starts, regexp_matches(line, '^[A-D]\s.') AS opts FROM c1 WHERE NOT regexp_matches(line, '^\d+$')),
c3 AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS item FROM c2),
c4 AS (SELECT *, sum(CASE WHEN opts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item ORDER BY n) AS opt FROM c3 WHERE item > 0),
c5 AS (SELECT doc_id, item, opt, trim(regexp_replace(string_agg(CASE WHEN starts THEN regexp_replace(line, '^\d{1,2}\s+', '') WHEN opts THEN regexp_replace(line, '^[A-D]\s+', '') ELSE line END, ' ' ORDER BY n), '\s+', ' ', 'g')) AS text, max(CASE WHEN starts THEN regexp_extract(line, '^(\d{1,2})', 1)::INT END) AS number FROM c4 GROUP BY 1, 2, 3),
c6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY opt) AS i FROM c5 WHERE opt > 0),
c7 AS (SELECT q.doc_id, q.item, q.number, q.text AS question, (SELECT string_agg(text, '|' ORDER BY i) FROM c6 o WHERE o.doc_id = q.doc_id AND o.item = q.item AND i <= 4) AS options, (SELECT count(*) FROM c6 o WHERE o.doc_id = q.doc_id AND o.item = q.item) AS held FROM c5 q WHERE q.opt = 0)"""


@query(f"""WITH {_COLUMNS} SELECT doc_id, item, number, question, options, CASE WHEN (number + doc_id) % 3 = 0 THEN ((number + doc_id) % 4)::INT END AS correct, CASE WHEN (number + doc_id) % 3 = 0 THEN 'medium' ELSE 'low' END AS confidence, sha256(passage) AS passage
FROM c7 JOIN passages USING (doc_id) WHERE held >= 4 AND question <> ''""")
def column_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two-column pages with answers from a key that knows every third number."""
    n = F.col("number")
    numbers = roles.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("number")).filter((n + F.col("doc_id")) % 3 == 0)
    key = extraction.answer_key(numbers.select("doc_id", n.alias("line_number"), F.concat(n.cast("string"), F.lit(".  "), F.substring(F.lit("ABCD"), ((n + F.col("doc_id")) % 4 + 1).cast("int"), F.lit(1))).alias("line")))
    items = extraction.column_items(extraction.two_columns(_columns(spark, sf_dir)), key)
    return items.select("doc_id", "item", "number", "question", F.array_join("options", "|").alias("options"), "correct", "confidence", F.sha2("passage", 256).alias("passage"))


_HEADS = ("Пояснення Правильна відповідь - B. ", "Правильна відповідь: Г, бо так.\n", "ПОЯСНЕННЯ\n\n\n\n", "", "правильна відповідь - a")


@query(r"""WITH h AS (SELECT doc_id, ['Пояснення Правильна відповідь - B. ', 'Правильна відповідь: Г, бо так.' || chr(10), 'ПОЯСНЕННЯ' || chr(10) || chr(10) || chr(10) || chr(10), '', 'правильна відповідь - a'][(doc_id % 5 + 1)::INT] || text AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '^\s*Пояснення\s*', '', 'i') AS t FROM h), b AS (SELECT doc_id, regexp_replace(t, 'Правильна відповідь\s*[-:]\s*[A-DА-Г](?:\.[^
]*)?', '', 'gi') AS t FROM a)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, 'Правильна відповідь\s*[-:]\s*[A-DА-Г][^.
]*(?:\.|
)?', '', 'gi'), '
{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS stripped FROM b""")
def stripped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations without what gives the answer away, over every document behind one of five beginnings."""
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return roles.read(spark, sf_dir, "documents").select("doc_id", F.sha2(html.strip_answer(F.concat(head, "text")), 256).alias("stripped"))


@query(r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Known Title' || chr(10) WHEN doc_id % 3 = 1 THEN ' |' || chr(10) ELSE '' END || replace(text, chr(10), '|' || chr(10)) AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\|$', '')) AS ls FROM p), k AS (SELECT *, list_filter(ls, lambda x: x <> '') AS held FROM l)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\bth\b', 'the', 'g'), '
{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS passage, CASE WHEN held[1] = 'Known Title' AND len(held) > 1 THEN held[2] ELSE coalesce(held[1], 'nothing') END AS first_line,
CASE WHEN doc_id % 4 = 1 THEN 'They are.|b' ELSE 'one|b' END AS options, doc_id % 4 = 1 AS fixed, CASE WHEN doc_id % 2 = 0 THEN trim('[[' || substr(string_split(t, ']]')[1], 1)) END AS marked FROM k JOIN p USING (doc_id)""")
def cleaned_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and options of an import cleaned, the first line that names a passage, and a part between marks."""
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 0, "Known Title\n").when(k % 3 == 1, " |\n").otherwise(""), F.replace("text", F.lit("\n"), F.lit("|\n")))
    options = html.fix_options(F.array(F.when(k % 4 == 1, "hey are.").otherwise("one"), F.lit("b")), {"hey are.": "They are."})
    marked = html.between(F.when(k % 2 == 0, F.concat(F.lit("x [["), "t", F.lit("]] y"))).otherwise("none"), "[[", "]]")
    rows = roles.read(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return rows.select(
        "doc_id", F.sha2(html.fix_words(html.clean_passage(F.col("t")), {"th": "the"}), 256).alias("passage"), html.first_line(F.col("t"), ("Known Title",), "nothing").alias("first_line"),
        F.array_join(options["options"], "|").alias("options"), options["fixed"].alias("fixed"), marked.alias("marked"),
    )


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'By the passage: ' || lang || '.' WHEN 1 THEN lang || ' fills the gap.' ELSE text || ' - ' || lang END AS explanation FROM documents""")
def answer_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("doc_id") % 3 == 0, "Reading comprehension").when(F.col("doc_id") % 3 == 1, "Cloze tests").otherwise("Use of English")
    made = extraction.answer_explanation(F.col("text"), F.col("lang"), topic, {"Reading comprehension": "By the passage: {option}.", "Cloze tests": "{option} fills the gap."}, "{question} - {option}")
    return roles.read(spark, sf_dir, "documents").select("doc_id", made.alias("explanation"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS n, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT doc_id, n AS line_number, trim(x) AS line FROM l""")
def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dressed as headings and list items, and cleaned again."""
    n = F.col("line_number")
    lines = roles.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "x"))
    plain = lines.withColumn("x", F.trim("x"))
    dressed = F.when(n % 3 == 1, quality.clean_heading(F.concat(F.lit(" **"), "x", F.lit("** ")))).when(n % 3 == 2, F.trim(F.regexp_replace(quality.strip_marker(F.concat(F.lit(" 12) \u0001"), "x")), "\u0001", ""))).otherwise(F.col("x"))
    return plain.select("doc_id", "line_number", dressed.alias("line"))
