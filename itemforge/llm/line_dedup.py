"""Line deduplication over levelled sorted runs of line hashes.

The corpus is taken in batches of ascending document ids. The runs hold every line key seen so far with the
document that owns it; a new batch is merge-anti-joined with each run and what remains becomes a run of its own.
When a level has FANOUT runs they are merged into one sorted run of the next level, so a line key is rewritten once
per level. Runs are bucketed and sorted tables, so that a merge join reads them without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, new_folder, stored

BATCHES = 4
#: Ids that settle where the batches part; the parting changes no result.
EDGE_SAMPLE = 1000
FANOUT = 3
MIN_KEY_CHARS = 10
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _digest(line: str) -> bytes | None:
    key = line.strip(SPACES).translate(_FOLD)
    return hashlib.md5(key.encode()).digest() if len(key) >= MIN_KEY_CHARS else None


class LineRuns:
    """Levels of runs (line_hash, owner). No line hash is in two runs."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        # the files lie in the shared folder, the catalog only knows their buckets and order
        run.write.format("parquet").option("path", new_folder(self.spark, name)).bucketBy(self.buckets, "line_hash").sortBy("line_hash").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, batch: DataFrame) -> None:
        """batch (line_hash, owner), unique in line_hash: keep what no run holds as a new run, compacting full levels."""
        fresh = batch
        for run in self.tables():
            fresh = fresh.join(run.select("line_hash").hint("merge"), "line_hash", "left_anti")
        self._write(fresh, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        merged = self.spark.table(names[0])
        for name in names[1:]:
            merged = merged.unionByName(self.spark.table(name))
        self._write(merged.repartition(self.buckets, "line_hash"), level + 1)
        self._forget(names)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Take the runs out of the catalog; no DataFrame that reads them works any more."""
        self._forget([name for level in self.levels for name in level])
        self.levels = [[]]

    def owners(self) -> DataFrame:
        first, *rest = self.tables()
        for run in rest:
            first = first.unionByName(run)
        return first


def batch_edges(docs: DataFrame, batches: int) -> list:
    """Ids that part the documents into about equal batches by ascending id, of any type that has an order."""
    picked = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(EDGE_SAMPLE)
    ids = picked.agg(F.sort_array(F.collect_list("doc_id"))).first()[0]
    return list(dict.fromkeys(ids[len(ids) * i // batches] for i in range(1, batches))) if ids else []


def repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, drops array<binary>): for each document the hashes of its lines that a smaller doc_id owns."""
    spark = docs.sparkSession
    edges = batch_edges(docs, batches)
    batch = sum(((F.col("doc_id") > F.lit(e)).cast("int") for e in edges), F.lit(0))
    key = line_key(F.col("line"))
    lines = (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
        .filter(F.length(key) >= MIN_KEY_CHARS)
        .select("doc_id", F.unhex(F.md5(key)).alias("line_hash"), batch.alias("batch"))
    )
    lines = stored(lines, "lines", ["batch"])
    runs = LineRuns(spark)
    for i in range(len(edges) + 1):
        runs.add(lines.filter(F.col("batch") == i).groupBy("line_hash").agg(F.min("doc_id").alias("owner")))
    found = lines.join(runs.owners(), "line_hash").filter(F.col("doc_id") != F.col("owner")).groupBy("doc_id").agg(F.collect_set("line_hash").alias("drops"))
    found = stored(found, "drops")
    runs.close()
    return found


def _keep(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    kept, dropped = [], []
    for value, hashes in zip(text, drops, strict=True):
        if hashes is None:
            kept.append(None)
            dropped.append(0)
            continue
        owned = {bytes(h) for h in hashes}
        lines = (value or "").split("\n")
        left = [line for line in lines if _digest(line) not in owned]
        kept.append("\n".join(left))
        dropped.append(len(lines) - len(left))
    return pd.DataFrame({"kept": kept, "n_dropped": dropped})


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text, others) with kept_text, n_lines and n_dropped in place of text.

    A key of ten or more code points that two documents hold loses its lines in all but the smallest doc_id.
    Ids may be of any type that has an order. Null text counts as one empty line. Rows with a null doc_id own nothing and lose nothing. Rows that repeat a
    doc_id count as one document. Columns named like the results are replaced. A text of any length is split whole; an
    empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "kept_text", "n_lines", "n_dropped", "drops", "result")]
    drops = repeated_lines(docs.select("doc_id", "text"), batches)
    joined = docs.select(*others, F.coalesce("text", F.lit("")).alias("text")).join(drops, "doc_id", "left")
    keep = F.pandas_udf(_keep, "kept string, n_dropped long")
    result = joined.withColumn("result", keep(F.when(F.col("drops").isNotNull(), F.col("text")), F.col("drops")))
    return result.select(
        *others,
        F.coalesce("result.kept", "text").alias("kept_text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.col("result.n_dropped").alias("n_dropped"),
    )
