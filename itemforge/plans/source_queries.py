"""Queries of readers and writers: parts become files of a bank in the shared folder and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.functions import text
from itemforge.operators import filters, rules
from itemforge.plans import enrichment, roles
from itemforge.plans.bank_queries import _CONVERSATIONS, _conversations
from itemforge.plans.define import Queries
from itemforge.plans.roles import QUESTIONS_SQL
from itemforge.sources import banks, sinks
from itemforge.sources.scratch import shared

query = Queries()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the columns of a bank's files."""
    rows = roles.questions(spark, sf_dir)
    return rows.select(
        F.col("question_id").alias("id"), "subject", "type", "topic", "subtopic", "difficulty", F.col("source_type").alias("sourceType"), F.col("source_url").alias("sourceUrl"), F.col("source_site").alias("sourceSite"),
        F.col("source_year").cast("string").alias("sourceYear"), "reviewed", "question", "passage", "options", F.col("correct").cast("int").alias("correctAnswer"), "explanation", "tags", "position",
    )


@query(f"""WITH {QUESTIONS_SQL}, p AS (SELECT *, CASE WHEN subject IN ('tznk', 'english') THEN 'public' ELSE 'staged' END AS part FROM questions)
SELECT part, question_id AS id, subject, len(options) AS options, list_contains(tags, 'needs_manual_review') AS flagged, dense_rank() OVER (ORDER BY part, subject) - 1 AS file_rank FROM p""")
def bank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON banks written by subject, two of them public and two staged; read with the rank of their bank."""
    folder, bank = _folder(spark, "bank"), _bank(spark, sf_dir)
    for subject in roles.SUBJECTS:
        part = "public" if subject in ("tznk", "english") else "staged"
        sinks.write_json(bank.filter(F.col("subject") == subject), f"{folder}/{part}/{subject}")
    read = banks.read_bank(spark, f"{folder}/public/*", staged=f"{folder}/staged/*", one_array=False)
    part = F.regexp_extract("file", "/(public|staged)/", 1)
    return read.select(part.alias("part"), "id", "subject", F.size("options").cast("long").alias("options"), filters.has_tag("needs_manual_review").alias("flagged"), F.col("file_rank").cast("long").alias("file_rank"))


@query(f"""WITH {QUESTIONS_SQL}, b AS (SELECT * FROM questions WHERE NOT list_contains(tags, 'needs_manual_review')) SELECT 'bank' AS source, count(*) AS n FROM b UNION ALL SELECT 'missing', 0
UNION ALL SELECT 'bundle', count(*) FROM questions WHERE subject = 'english' UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'subject', 1 UNION ALL SELECT 'sets', count(*) FROM questions WHERE subject = 'english' AND source_type <> 'generated' AND source_year = 2011""")
def bank_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison bank without a tag, a source that is missing, and the bundles of a known and an unknown subject."""
    bank = _bank(spark, sf_dir)
    halves = [bank.filter("position % 2 = 0"), bank.filter("position % 2 = 1")]
    missing = banks.read_json(spark, f"{_folder(spark, 'none')}/none.json", banks.GROUPS, optional=True)
    subjects = spark.createDataFrame([(s,) for s in roles.SUBJECTS], "id string")
    sets = bank.withColumnsRenamed({"sourceType": "source_type", "sourceSite": "source_site", "sourceYear": "source_year"})
    known, unknown = banks.subject_bundle(spark, subjects, bank, missing, sets, "english"), banks.subject_bundle(spark, subjects, bank, missing, missing, "nobody")
    held = known["exam_sets"].filter(filters.exam_sets_by("english", "imported", None, 2011))
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    parts = [count("missing", missing), count("bundle", known["questions"]), count("subject", known["subject"]), count("unknown", bank.limit(0) if unknown is None else bank), count("sets", held)]
    out = count("bank", banks.comparison_bank(halves, "needs_manual_review"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query(f"""WITH {_CONVERSATIONS} SELECT 'group' AS kind, g.group_id AS id, string_agg(m.question_id, ',' ORDER BY m.member_order) AS members, g.passage AS text FROM groups g JOIN members m USING (group_id) WHERE g.subject = 'english' GROUP BY g.group_id, g.passage
UNION ALL SELECT 'exam_set', set_id, string_agg(group_id, ',' ORDER BY group_id), CASE WHEN set_id = 's7' THEN '' ELSE 't' END FROM units GROUP BY set_id""")
def bank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and exam sets written as JSON and read back: those of one subject with their members in order."""
    folder, (groups, sets, _) = _folder(spark, "groups"), _conversations(spark, sf_dir)
    sinks.write_json(groups.withColumnsRenamed({"group_id": "id", "question_ids": "questionIds"}), f"{folder}/groups")
    units = F.transform("units", lambda u: F.struct(u["type"].alias("type"), u["question_id"].alias("questionId"), u["group_id"].alias("groupId")))
    sinks.write_json(sets.withColumn("units", units).withColumnRenamed("set_id", "id"), f"{folder}/sets")
    read = lambda name, schema: banks.read_json(spark, f"{folder}/{name}", schema, optional=True, one_array=False)
    subjects = spark.createDataFrame([(s,) for s in roles.SUBJECTS], "id string")
    bundle = banks.subject_bundle(spark, subjects, read("none", banks.QUESTIONS), read("groups", banks.GROUPS), read("sets", banks.EXAM_SETS), "english")
    held = bundle["groups"].select(F.lit("group").alias("kind"), "id", F.array_join("questionIds", ",").alias("members"), F.col("passage").alias("text"))
    return held.unionByName(bundle["exam_sets"].select(F.lit("exam_set").alias("kind"), "id", F.array_join("units.groupId", ",").alias("members"), F.col("title").alias("text")))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS place FROM customer), c AS (SELECT *, (place - 1) // 350 + 1 AS chunk FROM r)
SELECT chunk, count(*) AS lines, min(c_custkey) AS first_id, max(c_custkey) AS last_id, false AS missing FROM c WHERE chunk % 3 <> 0 GROUP BY 1
UNION ALL SELECT chunk, 0, NULL, NULL, true FROM (SELECT DISTINCT chunk FROM c WHERE chunk % 3 = 0) UNION ALL SELECT max(chunk) + 1, 0, NULL, NULL, true FROM c""")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written in chunks; every third chunk has no file, and the index knows one chunk more."""
    folder = _folder(spark, "chunks")
    customers = roles.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("s").alias("subject"), F.col("c_name").alias("question"), F.array("c_mktsegment").alias("options"), F.lit("A").alias("correct_letter"), F.lit("o").alias("correct_option"))
    requests = enrichment.requests(customers, "model", "prompt", "id")
    sinks.write_chunks(requests.filter("chunk % 3 <> 0"), folder)
    index = requests.select("chunk").distinct()
    index = index.unionByName(index.agg((F.max("chunk") + 1).alias("chunk")))
    lines = banks.read_chunks(spark, index, f"{folder}/chunk=*")
    ids = F.from_json("raw", "custom_id long")["custom_id"]
    found = lines.groupBy("chunk").agg(F.count("*").alias("lines"), F.min(ids).alias("first_id"), F.max(ids).alias("last_id")).withColumn("missing", F.lit(False))
    none = enrichment.missing_chunks(index, lines).select("chunk", F.lit(0).cast("long").alias("lines"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("last_id"), F.lit(True).alias("missing"))
    return found.unionByName(none)


@query("""WITH e AS (SELECT event_id % 5 + 1 AS chunk, event_id % 7 = 0 AS broken FROM events WHERE event_id % 5 <> 2)
SELECT 'chunks' AS source, i.chunk, count(e.chunk) AS lines, count(*) FILTER (broken) AS errors, count(e.chunk) = 0 AS missing FROM range(1, 7) i(chunk) LEFT JOIN e ON e.chunk = i.chunk GROUP BY i.chunk
UNION ALL SELECT 'legacy', 0, count(*), count(*) FILTER (event_id % 7 = 0), false FROM events WHERE event_id % 3 = 0""")
def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as output lines in chunks, one of which has no file and one is not there at all; every seventh line is broken. The same of one old file."""
    folder, k = _folder(spark, "outputs"), F.col("event_id")
    line = F.when(k % 7 == 0, F.concat(F.lit('{"custom_id": '), k.cast("string"))).otherwise(F.to_json(F.struct(k.cast("string").alias("custom_id"))))
    lines = roles.read(spark, sf_dir, "events").select((k % 5 + 1).alias("chunk"), k, line.alias("value"))
    lines.filter("chunk <> 3").select("chunk", "value").write.partitionBy("chunk").text(f"{folder}/chunks")
    lines.filter("event_id % 3 = 0").select("value").write.text(f"{folder}/old")
    index = spark.range(1, 7).withColumnRenamed("id", "chunk")
    new = banks.chunk_report(index, banks.read_chunks(spark, index, f"{folder}/chunks/chunk=*"))
    old = banks.chunk_report(spark.range(1).withColumnRenamed("id", "chunk"), banks.read_chunks(spark, index, f"{folder}/none/chunk=*", legacy=f"{folder}/old"))
    return new.withColumn("source", F.lit("chunks")).unionByName(old.withColumn("source", F.lit("legacy")))


@query("SELECT event_id, (props->>'$.k')::INT AS k, event_id % 10 <> 0 AS sound FROM events WHERE event_id % 7 <> 0 AND event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, false FROM events WHERE event_id % 7 <> 0 AND event_id % 10 = 0")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, some blank and some broken; blank ones go, broken ones have no fields."""
    folder, k = _folder(spark, "lines"), F.col("event_id")
    line = F.when(k % 7 == 0, "  ").when(k % 10 == 0, F.concat(F.lit("{broken "), k.cast("string"))).otherwise(F.concat(F.lit(" "), F.to_json(F.struct("event_id", "props"))))
    roles.read(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    lines = banks.read_lines(spark, folder, "event_id long, props string")
    return lines.select("parsed.event_id", F.get_json_object("parsed.props", "$.k").cast("int").alias("k"), F.col("parsed.event_id").isNotNull().alias("sound"))


@query(f"""WITH {QUESTIONS_SQL} SELECT 'current' AS what, source_type, count(*) AS n FROM questions WHERE source_type <> 'generated' GROUP BY 2 UNION ALL SELECT 'current', 'generated', count(*) FROM questions WHERE position % 10 = 0
UNION ALL SELECT 'snapshot', source_type, count(*) FROM questions GROUP BY 2 UNION ALL SELECT 'partitions', CASE WHEN source_type = 'generated' THEN 'generated' ELSE source_type END, CASE WHEN source_type = 'generated' THEN (SELECT count(*) FROM questions WHERE position % 10 = 0) ELSE count(*) END FROM questions GROUP BY source_type""")
def replaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank whose generated rows are replaced: the current version, the snapshot before it, and partitions replaced in place."""
    folder, old = _folder(spark, "versions"), roles.questions(spark, sf_dir).select("position", "source_type")
    new = old.filter("position % 10 = 0").withColumn("source_type", F.lit("generated"))
    sinks.write_version(old, folder, "one")
    sinks.write_version(sinks.replace_source(old, new, "source_type", "generated"), folder, "two")
    sinks.write_source(old, f"{folder}/parts", "source_type")
    sinks.write_source(new, f"{folder}/parts", "source_type")
    count = lambda rows, name: rows.groupBy("source_type").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "source_type", "n")
    return count(sinks.read_version(spark, folder), "current").unionByName(count(sinks.read_version(spark, folder, "one"), "snapshot")).unionByName(count(spark.read.parquet(f"{folder}/parts"), "partitions"))


@query(f"WITH {QUESTIONS_SQL} SELECT topic AS file, count(*) AS n, min(position) AS first_row, true AS in_order FROM questions GROUP BY 1")
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written back to a folder for each topic; the order of each file is that of its rows."""
    folder = _folder(spark, "files")
    sinks.write_files(roles.questions(spark, sf_dir).select(F.col("topic").alias("file"), "position"), folder)
    read = spark.read.schema("position long, file string").parquet(folder).select("file", "position", F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_path").alias("path"))
    inside = F.lag("position").over(Window.partitionBy("path").orderBy("row"))  # a part is a range, one task's work when written
    parts = read.withColumn("before", inside).groupBy("file", "path").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.bool_and(F.coalesce(F.col("before") < F.col("position"), F.lit(True))).alias("ordered"))
    parts = parts.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("path")))  # one row a part
    return parts.groupBy("file").agg(F.sum("n").alias("n"), F.min("first").alias("first_row"), F.bool_and(F.col("ordered") & F.coalesce(F.col("before") < F.col("first"), F.lit(True))).alias("in_order"))


@query("""SELECT s_suppkey AS id, s_name AS path, 'duplicate id' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE n > 1
UNION ALL SELECT s_suppkey, s_name, 'indexed' FROM supplier""")
def raw_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a raw index keyed by path, and as subjects whose nation is their id: all but the first of an id are duplicates."""
    rows = roles.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("path"), F.col("s_nationkey").cast("string").alias("nation"))
    known = banks.keyed_index(rows, [rows.orderBy("id").first()["path"]])
    double = rules.duplicate_ids(rows, "subject", "nation", "nation", "id")
    ranked = rows.join(double.select(F.col("entity_id").alias("nation")).distinct(), "nation")
    first = ranked.groupBy("nation").agg(F.min("id").alias("first"))
    return ranked.join(first, "nation").filter("id > first").select("id", "path", F.lit("duplicate id").alias("rule")).unionByName(known.select("id", "path", F.lit("indexed").alias("rule")))


@query("SELECT o_orderkey, floor(o_totalprice / 1000 + 0.5)::BIGINT AS whole FROM orders")
def whole_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.read(spark, sf_dir, "orders").select("o_orderkey", text.whole_percentage(F.col("o_totalprice") / 1000).alias("whole"))
