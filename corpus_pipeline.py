"""A corpus for training: language, lines, near copies, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir), with docs in the columns of documents, and works on all that its predecessor
kept. run() writes every stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import language, pieces
from itemforge.llm.common import remove, stored, table, written
from itemforge.llm.decontaminate import clean_documents
from itemforge.llm.jaccard import first_of_classes
from itemforge.llm.line_dedup import dedup_lines

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Keys of rejected or renamed rows that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000

#: Language ID and pieces are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their identified language as lang; those that have none (no letters, null, empty) go.

    The language is the one that text, declaration and source together make likeliest, so a wrong or missing declaration is
    mended for what follows; where there is nothing to learn from the declaration stays. Each row is judged by its own values, also
    where ids repeat or are null. Repeated rows stay. An empty table gives no rows; other columns than those of documents go.
    """
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5("text"), F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    marked = _documents(docs).withColumn("row_key", key)
    found = language.identify(marked, "row_key", "lang", "source").withColumn("named", F.nullif("language", F.lit("und")))
    # only rows that go or change: the declaration stands at the end of the key
    found = found.filter(F.col("rejected") | ~F.endswith("row_key", F.concat(F.lit("|"), "named")))
    found = stored(found.select("row_key", "rejected", "named").distinct(), "judged")
    if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        found = F.broadcast(found)  # few keys of some 60 bytes, so the texts stay where they are
    judged = marked.join(found, "row_key", "left").filter(~F.coalesce("rejected", F.lit(False)))
    return _documents(judged.withColumn("lang", F.coalesce("named", "lang")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id owns; what loses its last words goes, null texts become empty.

    Rows that repeat an id count as one document; rows with a null id own no line and lose none. An empty table gives no
    rows; other columns than those of documents go.
    """
    kept = dedup_lines(_documents(docs))
    left = (F.col("n_dropped") == 0) | (F.btrim(F.col("kept_text"), F.lit(" \t\n\x0b\x0c\r")) != "")
    return kept.filter(left).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id (see first_of_classes).

    Different texts under one id are documents of their own; rows with a null id are in no class and stay. Texts without
    words are copies of each other. An empty table gives no rows; other columns than those of documents go.
    """
    return first_of_classes(_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, each row by its own text, whatever its id (also null or repeated).

    Null and empty texts have no windows and stay. An empty table gives no rows; other columns than those of documents go.
    """
    return clean_documents(_documents(docs), table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pieces, n_pieces, and lossless: whether decoding gives the text back.

    One row per input row; null and empty texts have no pieces; a null id has the key 0. An empty table gives no rows.
    """
    both = pieces.round_trip(_documents(docs))
    return both.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and its input, go as soon as its result is stored."""
    docs, first = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        remove(spark, first, written() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
