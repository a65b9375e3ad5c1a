"""The driver's tables in the roles of a question bank, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions.urls import source_site

SUBJECTS = ("tznk", "english", "management", "psychology-sociology")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, tasks: int = 4) -> DataFrame:
    """rows dealt over all cores, `tasks` a core: a small file is read by one or two tasks, whatever its rows cost later."""
    return rows.repartition(tasks * rows.sparkSession.sparkContext.defaultParallelism, key)


#: Rows of a part, where a table is dealt over parts by its size.
PART_ROWS = 500_000


def parts(rows: DataFrame) -> int:
    """Parts for a table of Parquet, whose footers tell its rows: a part a core at least, and none of many more than PART_ROWS rows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions: the topic is the type, the site the brand, the passage the name."""
    k, size = F.col("p_partkey"), F.col("p_size")
    subject = F.element_at(F.array(*map(F.lit, SUBJECTS)), (k % 4 + 1).cast("int"))
    source_type = F.element_at(F.array(*map(F.lit, ("official_demo", "public_source", "generated", "manually_added"))), (size % 4 + 1).cast("int"))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    url = F.when(source_type == "generated", F.lit(None)).otherwise(F.concat(F.lit("https://www."), brand, F.lit(".example.org/all/"), (k % 7 * 15).cast("string"), F.lit("/")))
    rows = spread(read(spark, sf_dir, "part"), "p_partkey").select(
        k.alias("position"),
        F.concat(subject, F.lit("-"), k.cast("string")).alias("question_id"),
        subject.alias("subject"),
        F.when(size % 3 == 0, "passage_single_choice").otherwise("single_choice").alias("type"),
        F.col("p_type").alias("topic"),
        F.col("p_brand").alias("subtopic"),
        F.when(size <= 15, "easy").when(size <= 35, "medium").otherwise("hard").alias("difficulty"),
        source_type.alias("source_type"),
        url.alias("source_url"),
        (2000 + size % 25).alias("source_year"),
        (k % 5 != 0).alias("reviewed"),
        F.concat_ws(" ", "p_name", "p_type", (size % 7).cast("string")).alias("question"),
        F.col("p_name").alias("passage"),
        F.array(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.when(size % 10 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("size "), size.cast("string")))).alias("options"),
        (size % 2).alias("correct"),
        F.when(k % 11 == 0, "").otherwise(F.concat_ws(" ", "p_name", F.lit("is"), "p_type")).alias("explanation"),
        F.array_compact(F.array(F.when(k % 6 == 0, "needs_manual_review"), F.concat(F.lit("year "), (2000 + size % 25).cast("string")))).alias("tags"),
    )
    return rows.withColumn("source_site", source_site(F.col("source_type"), F.col("source_url")))


QUESTIONS_SQL = """
q0 AS (SELECT *, p_partkey AS position, ['tznk','english','management','psychology-sociology'][(p_partkey % 4 + 1)::INT] AS subject,
  ['official_demo','public_source','generated','manually_added'][(p_size % 4 + 1)::INT] AS source_type,
  lower(replace(p_brand, '#', '')) AS brand FROM part),
questions AS (SELECT position, subject || '-' || p_partkey AS question_id, subject,
  CASE WHEN p_size % 3 = 0 THEN 'passage_single_choice' ELSE 'single_choice' END AS type, p_type AS topic, p_brand AS subtopic,
  CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 35 THEN 'medium' ELSE 'hard' END AS difficulty, source_type,
  CASE WHEN source_type <> 'generated' THEN 'https://www.' || brand || '.example.org/all/' || (p_partkey % 7 * 15) || '/' END AS source_url,
  2000 + p_size % 25 AS source_year, p_partkey % 5 <> 0 AS reviewed, p_name || ' ' || p_type || ' ' || (p_size % 7) AS question, p_name AS passage,
  [p_name, p_brand, p_type, CASE WHEN p_size % 10 = 0 THEN upper(p_name) ELSE 'size ' || p_size END] AS options, p_size % 2 AS correct,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' is ' || p_type END AS explanation,
  list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'needs_manual_review' END, 'year ' || (2000 + p_size % 25)], lambda x: x IS NOT NULL) AS tags,
  CASE WHEN source_type = 'generated' THEN 'generated' ELSE brand || '.example.org' END AS source_site FROM q0)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts of learners."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("learner"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("mode"), F.col("o_orderdate").alias("moment")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers: A selects option 0, R option 1, N none."""
    selected = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"), selected.alias("selected"), F.col("l_suppkey").alias("seq"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("topic"), (F.col("p_size") % 2).alias("correct"), F.col("p_name").alias("group_id"))
    return lines.join(parts, "question_id")


ANSWERS_SQL = """
answers AS (SELECT l_orderkey AS attempt_id, l_linenumber AS position, l_partkey AS question_id, l_suppkey AS seq, p_type AS topic, p_size % 2 AS correct, p_name AS group_id,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS selected FROM lineitem JOIN part ON l_partkey = p_partkey),
marked AS (SELECT *, coalesce(selected = correct, false) AS is_correct FROM answers),
attempts AS (SELECT o_orderkey AS attempt_id, o_custkey AS learner, o_orderpriority AS subject, o_orderstatus AS mode, o_orderdate AS moment FROM orders)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidate question texts; subject is the language."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("site"), "text")


def normal_sql(column: str) -> str:
    """The normal form of functions.text.normalize in DuckDB."""
    return f"trim(regexp_replace(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
