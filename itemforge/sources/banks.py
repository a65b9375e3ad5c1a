"""Readers of question banks: subjects, questions, groups, exam sets, output lines; missing sources are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = "id string, title string, fullTitle string, description string, questionFile string, recommendedQuestionCount int, examQuestionCount int, defaultDurationMinutes int, examDurationMinutes int, accent string"
QUESTIONS = (
    "id string, subject string, type string, topic string, subtopic string, difficulty string, sourceType string, sourceUrl string, sourceSite string, sourceYear string, sourceExamSetId string, "
    "sourceQuestionOrder int, groupId string, groupOrder int, reviewed boolean, question string, passage string, imageUrl string, options array<string>, correctAnswer int, explanation string, explanationByOption array<string>, tags array<string>"
)
GROUPS = "id string, subject string, title string, passage string, questionIds array<string>, sourceType string, sourceUrl string, sourceSite string, sourceYear string, tags array<string>"
EXAM_SETS = "id string, subject string, title string, description string, sourceType string, sourceSite string, sourceUrl string, year string, variant string, tags array<string>, units array<struct<type: string, questionId: string, groupId: string>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file system of the path holds something there (globs too)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: str, optional: bool = False, one_array: bool = True) -> DataFrame:
    """A JSON array (or a folder of JSON lines) by an explicit schema, nothing inferred; an optional source that is missing is empty."""
    if optional and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=one_array)


def read_bank(spark: SparkSession, path: str, schema: str = QUESTIONS, staged: str | None = None, one_array: bool = True) -> DataFrame:
    """All files of a bank, public ones first, then staged ones; file, file_rank and position tell a row's place.

    Files rank by name within their part. A file of one JSON array is one task's work. Without one_array a bank is a folder of
    JSON lines, as write_json leaves it: its parts are many tasks' work and have the folder's name and rank.
    """
    parts = [(0, path)] + ([(1, staged)] if staged and path_exists(spark, staged) else [])
    path_of = F.col("_metadata.file_path")
    file, rows = path_of if one_array else F.regexp_replace(path_of, "/[^/]*$", ""), None
    for part, place in parts:
        read = spark.read.schema(schema).json(place, multiLine=one_array).select("*", file.alias("file"), F.monotonically_increasing_id().alias("position"), F.lit(part).alias("part"))
        rows = read if rows is None else rows.unionByName(read)
    files = rows.select("part", "file").distinct()
    from pyspark.sql import Window

    ranks = files.withColumn("file_rank", F.row_number().over(Window.orderBy("part", "file")) - 1)  # one row a file
    return rows.join(ranks.drop("part"), "file").drop("part")  # adaptive execution broadcasts the ranks if they are small


def comparison_bank(banks: list[DataFrame], without_tag: str | None = None) -> DataFrame:
    """The union of banks, without the rows that carry a tag."""
    whole = banks[0]
    for bank in banks[1:]:
        whole = whole.unionByName(bank)
    return whole if without_tag is None else whole.filter(~F.coalesce(F.array_contains("tags", without_tag), F.lit(False)))


def subject_bundle(spark: SparkSession, subjects: DataFrame, questions: DataFrame, groups: DataFrame, exam_sets: DataFrame, subject: str) -> dict[str, DataFrame] | None:
    """The subject's row, questions, groups and exam sets, each a filter that reaches its scan; None if unknown."""
    row = subjects.filter(F.col("id") == subject).limit(1)
    if not row.count():
        return None
    return {"subject": row, "questions": questions.filter(F.col("subject") == subject), "groups": groups.filter(F.col("subject") == subject), "exam_sets": exam_sets.filter(F.col("subject") == subject)}


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines: trimmed, blank ones dropped; raw keeps the text and parsed is null where it does not fit."""
    lines = spark.read.text(path).select(F.trim("value").alias("raw"), F.col("_metadata.file_path").alias("file")).filter("raw <> ''")
    return lines.withColumn("parsed", F.from_json("raw", schema))


def read_chunks(spark: SparkSession, index: DataFrame, pattern: str, legacy: str | None = None) -> DataFrame:
    """(chunk, line, raw) of the output files of the index's chunks; a single old file where no chunk has one.

    pattern holds one * for the chunk number, in a file's name or in a folder chunk=*.
    """
    if not path_exists(spark, pattern):
        if legacy and path_exists(spark, legacy):
            return spark.read.text(legacy).select(F.lit(0).cast("long").alias("chunk"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("raw")).filter("raw <> ''")
        return spark.createDataFrame([], "chunk long, line long, raw string")
    path = F.col("_metadata.file_path")
    number = F.coalesce(F.nullif(F.regexp_extract(path, r"/chunk=(\d+)/[^/]*$", 1), F.lit("")), F.regexp_extract(path, r"(\d+)[^/\d]*$", 1)).cast("long")
    lines = spark.read.text(pattern).select(number.alias("chunk"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("raw")).filter("raw <> ''")
    return lines.join(index.select("chunk"), "chunk", "left_semi")


def chunk_report(index: DataFrame, lines: DataFrame, schema: str = "custom_id string") -> DataFrame:
    """(chunk, lines, errors, missing) of every chunk of the index, of lines as read_chunks gives them.

    errors counts the lines that are no JSON of the schema; a chunk without any line is missing. Combined before the shuffle.
    """
    parsed = F.from_json("raw", f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    held = lines.groupBy("chunk").agg(F.count("*").alias("lines"), F.count_if(parsed["broken"].isNotNull()).alias("errors"))
    report = index.select("chunk").distinct().join(held, "chunk", "left")
    return report.select("chunk", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("errors", F.lit(0)).alias("errors"), F.col("lines").isNull().alias("missing"))


def keyed_index(index: DataFrame, required: list[str]) -> DataFrame:
    """An index by local path; an error names the required paths that it lacks."""
    held = {r[0] for r in index.filter(F.col("path").isin(required)).select("path").distinct().collect()}  # at most the required ones
    missing = sorted(set(required) - held)
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return index.dropDuplicates(["path"])
