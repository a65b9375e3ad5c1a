"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import byte_bpe, language, negatives, periods, pieces, quality, toxicity, wrappers
from itemforge.llm.common import table
from itemforge.llm.decontaminate import contamination
from itemforge.llm.jaccard import near_duplicates
from itemforge.llm.line_dedup import dedup_lines
from itemforge.llm.media import media_digests
from itemforge.llm.oracles import ORACLES
from itemforge.llm.secrets import scan_secrets


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: pieces, a digest of their ids, and whether the text came back."""
    both = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"), "decoded_sha256", "lossless")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), "doc_id", "lang", "source")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over pages, where markup language, address suffix and domain are evidence, too."""
    return language.identify_pages(table(spark, sf_dir, "pages"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, with stretches planted by id; the strongest one, and digests of all and of the text without repeats."""
    found = periods.find_runs(periods.with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", periods.strongest(F.col("runs")))
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    digests = [F.sha2(periods.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, *digests)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every hundredth vector, the first rows of other labels whose score is 30 to 90 hundredths of a positive's; a seventh of the labels are shifted."""
    rows = negatives.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 256.0)
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", shifted.cast("int")), F.col("id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of the public byte-level vocabulary, and the bytes that they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pieces": op7_pieces,
    "op8_language": op8_language,
    "page_languages": page_languages,
    "op9_html_extraction": op9_html_extraction,
    "op10_media": op10_media,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}
