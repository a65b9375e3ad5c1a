"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from byte trigrams (a bounded sample of declared rows fits them). They are combined with the
declared markup language, the address suffix, and priors of the host that are smoothed over its domain, its suffix
and the whole corpus. Priors and the reliability of declarations are sums of text posteriors by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, stored

PER_LANGUAGE = 400
LEAST_TEXTS = 2  # different declared texts with letters, to count as a language
BUCKETS = 1 << 16
BLOCK, BLOCKS_AT_ONCE = 256, 2  # languages of a table (64 MB at most), and tables that tasks hold at once
HELD_CELLS = 1 << 21  # numbers of vectors that a task holds while it adds them up
SMOOTH = 0.05
TEMPER = 0.15  # neighbouring trigrams share bytes, so their evidence is not independent
HOST_WEIGHT, LEVEL_WEIGHT, DECLARED_WEIGHT = 5.0, 10.0, 20.0
CHUNK = 1 << 17  # bytes of a text whose trigrams are counted at once
LEAST_LETTERS = 1  # a text without letters has no language
LETTER, NO_LETTERS = r"\p{L}", r"\P{L}+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _buckets(data: np.ndarray, buckets: int) -> np.ndarray:
    """Trigram bucket at every byte but the last two."""
    code = data[:-2].astype(np.uint32) * np.uint32(65599) + data[1:-1].astype(np.uint32) * np.uint32(2654435761) + data[2:].astype(np.uint32) * np.uint32(40503)
    return ((code ^ code >> np.uint32(15)) & np.uint32(buckets - 1)).astype(np.int64)


def _fold(text: str | None) -> bytes:
    """Lower case, every run of non-letters one space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def _sides(host: Column) -> tuple[Column, Column]:
    """Domain (last two labels, three behind a two-letter suffix with a short second label) and suffix of a host."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    short = (F.length(F.element_at(labels, -1)) == 2) & (n >= 3) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    domain = F.when(n <= 2, F.lower(host)).otherwise(F.array_join(F.slice(labels, F.when(short, n - 2).otherwise(n - 1), 3), "."))
    return domain, F.when(n >= 2, F.element_at(labels, -1)).otherwise(F.lit(""))


def _profile(text: str, buckets: int) -> np.ndarray:
    """Shares of the trigram buckets in a text."""
    data = np.frombuffer(_fold(text), dtype=np.uint8)
    counts = np.zeros(buckets)
    for at in range(0, len(data) - 2, CHUNK):
        counts += np.bincount(_buckets(data[at : at + CHUNK + 2], buckets), minlength=buckets)
    return counts / max(1, len(data))


def _known(rows: DataFrame) -> DataFrame:
    """Every declared value with LEAST_TEXTS different texts is a language, whatever its share of the rows; held counts its texts."""
    texts = rows.select("declared", "text_hash").distinct()  # copies of a text count once
    return stored(texts.groupBy("declared").agg(F.count("*").alias("held")).filter(F.col("held") >= LEAST_TEXTS), "declared")


def _profiles(rows: DataFrame, known: DataFrame, per_language: int) -> DataFrame:
    """(declared, profile): the trigram shares of about per_language texts of each language, added up."""

    def profiles(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a language: rows come by language."""
        last, total = None, np.zeros(BUCKETS)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([total.tobytes()], pa.binary())], ["declared", "profile"])
        for batch in source:
            for declared, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if declared != last:
                    if last is not None:
                        yield out()
                    last, total = declared, np.zeros(BUCKETS)
                total += _profile(text.as_py(), BUCKETS)
        if last is not None:
            yield out()

    # a share of each language by a hash of the text, so that no task sends more than its part of the sample
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("held")) * (1 << 30)
    picked = rows.join(known, "declared").filter(F.pmod("text_hash", F.lit(1 << 30)) < share)
    picked = picked.groupBy("declared", "text_hash").agg(F.min("text").alias("text"))
    sample = picked.repartition("declared").sortWithinPartitions("declared", "text_hash").select("declared", "text")
    return stored(sample.mapInArrow(profiles, "declared string, profile binary"), "profiles")


def _fit(rows: DataFrame, per_language: int) -> tuple[list[str], Iterator[np.ndarray]]:
    """The languages, and the log-likelihoods by trigram bucket in blocks of BLOCK languages; the driver holds one block at a time."""
    rows = rows.filter(F.col("declared").isNotNull() & F.col("text").rlike(LETTER)).withColumn("text_hash", F.xxhash64("text"))
    known = _known(rows)
    languages = sorted(r.declared for r in known.select("declared").toLocalIterator())
    if not languages:
        return [], iter(())
    profiles = _profiles(rows, known, per_language)

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, len(languages), BLOCK):
            names = {name: k for k, name in enumerate(languages[at : at + BLOCK])}
            table = np.full((BUCKETS, len(names)), SMOOTH + 1e-4)
            for r in profiles.filter(F.col("declared").between(languages[at], languages[min(at + BLOCK, len(languages)) - 1])).toLocalIterator():
                table[:, names[r.declared]] += np.frombuffer(r.profile)
            yield np.log(table / table.sum(axis=0)).astype(np.float32)

    return languages, blocks()


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """rows (text, declared): the languages, and log-likelihoods by trigram bucket, for models that fit into the driver."""
    languages, blocks = _fit(rows, per_language)
    return languages, np.concatenate(list(blocks), axis=1) if languages else np.zeros((BUCKETS, 1), np.float32)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _softmax(logs: np.ndarray) -> np.ndarray:
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def likelihoods(docs: DataFrame, blocks: Iterator[np.ndarray], n: int, keep: list[str]) -> DataFrame:
    """The kept columns with `loglik` (one for each language, tempered, 0 for the likeliest) and `p`, as probabilities.

    A pass over the text for each block of languages; after BLOCKS_AT_ONCE of them the rows are written, and the blocks'
    tables leave the executors.
    """
    context, rows, sent = docs.sparkSession.sparkContext, docs.select(*keep, F.array().cast("array<double>").alias("loglik"), "text"), []
    head = _schema(docs.select(*keep))
    for k, table in enumerate(blocks):
        last = (k + 1) * BLOCK >= n
        sent.append(context.broadcast(table))
        rows = rows.mapInArrow(_block_pass(sent[-1], last), f"{head}, loglik array<double>, {'p array<double>' if last else 'text string'}")
        if last or len(sent) == BLOCKS_AT_ONCE:
            rows = stored(rows, "language")
            for old in sent:
                old.unpersist()
            sent = []
    return rows


def _block_pass(sent, last: bool):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        width = table.shape[1]
        chunk = min(CHUNK, max(1024, (1 << 22) // width))
        for batch in source:
            texts, out = batch.column(batch.num_columns - 1), np.zeros((batch.num_rows, width))
            for i, text in enumerate(texts):
                data = np.frombuffer(_fold(text.as_py()), dtype=np.uint8)
                for at in range(0, len(data) - 2, chunk):
                    out[i] += np.add.reduce(table[_buckets(data[at : at + chunk + 2], len(table))], axis=0, dtype=np.float64)
            before = batch.column(batch.num_columns - 2)
            logs = np.concatenate([_matrix(before, len(before[0]) if len(before) else 0), TEMPER * out], axis=1)
            columns = list(batch.columns[:-2])
            if last:
                logs -= logs.max(axis=1, keepdims=True)
                columns += [_lists(logs), _lists(_softmax(logs))]
            else:
                columns += [_lists(logs), texts]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "p" if last else "text"])

    return batches


def _added(rows: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """By keys, the vectors of the rows added up as `sums`: in the task first, then by sorted keys."""
    picked = rows.select(*keys, F.col(column).alias("sums"))

    def out(found: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in found], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, _lists(np.array(list(found.values())).reshape(len(found), n))], [*keys, "sums"])

    kinds = [pa.string()] * len(keys)

    def fold(source: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """whole: rows come by keys, and each gets one row."""
        found: dict[tuple, np.ndarray] = {}
        for batch in source:
            for key, vector in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), _matrix(batch.column(len(keys)), n), strict=True):
                if key in found:
                    found[key] += vector
                    continue
                if len(found) * n > HELD_CELLS:
                    yield out(found)
                    found = {}
                found[key] = vector.copy()
        if found:
            yield out(found)

    schema = _schema(picked)
    partial = picked.mapInArrow(lambda s: fold(s, False), schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda s: fold(s, True), schema)


def _smooth(sums: np.ndarray, weight: float, parent: np.ndarray) -> np.ndarray:
    """Dirichlet smoothing of a level's sums towards its parent's distribution."""
    return (sums + weight * parent) / (sums.sum(axis=1, keepdims=True) + weight)


def _mapped(rows: DataFrame, keep: list[str], vectors: list[str], name: str, n: int, function) -> DataFrame:
    """The kept columns and a vector made of others by a function of matrices."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = function(*(_matrix(c, n) for c in batch.columns[len(keep) :]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _lists(made)], [*keep, name])

    picked = rows.select(*keep, *vectors)
    return picked.mapInArrow(batches, f"{_schema(picked.select(*keep))}, {name} array<double>")


def _constant(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def identify(docs: DataFrame, key: str = "doc_id", declared: str | None = None, host: str | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per input row: key, language, probability, text_language, letters and rejected.

    declared names the column with the declared language, host the one with the address's host; either may be None.
    letters counts the letters of any script. A text without them (null, empty, digits, emoji) has the language 'und',
    probability 0 and is rejected; no other text is. Null declarations and hosts are their own value. Ties go to the
    first language by name. Repeated rows give repeated results; other columns are ignored; a text of any length counts
    whole; an empty table gives no rows. Without declared rows to learn from every language is 'und' with probability 0.
    Any number of declared values may be languages: they are compared in blocks, each with a table of the same size.
    """
    bound_batches(docs.sparkSession)
    declared_col = F.lower(F.regexp_replace(F.col(declared), "[-_].*", "")) if declared else F.lit(None).cast("string")
    host_col = F.lower(F.col(host)) if host else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), declared_col.alias("declared"), F.coalesce(host_col, F.lit("")).alias("host"), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), NO_LETTERS, "")).cast("long").alias("letters"), "text")
    languages, blocks = _fit(rows.select("text", "declared"), per_language)
    n = len(languages)
    if not n:
        return rows.select(F.col("key").alias(key), F.lit("und").alias("language"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_language"), "letters", (F.col("letters") < LEAST_LETTERS).alias("rejected"))
    # the texts stay behind: what follows moves a few numbers a row
    domain, suffix = _sides(F.col("host"))
    rows = rows.withColumns({"declared": F.coalesce("declared", F.lit("")), "domain": domain, "suffix": suffix})
    scored = likelihoods(rows, blocks, n, ["key", "declared", "host", "domain", "suffix", "letters"])

    host_keys = ["host", "domain", "suffix"]
    sums = stored(_added(scored.filter(F.col("letters") >= LEAST_LETTERS), [*host_keys, "declared"], "p", n), "sums")
    hosts, said = _added(sums, host_keys, "sums", n), _added(sums, ["declared"], "sums", n)
    every = _added(sums.withColumn("all", F.lit("")), ["all"], "sums", n).collect()
    totals = np.array(every[0].sums) if every else np.zeros(n)
    mass = float(totals.sum())
    root = (totals + 1.0) / (mass + n)
    by_domain, by_suffix = _added(hosts, ["domain"], "sums", n).withColumnRenamed("sums", "domain_sums"), _added(hosts, ["suffix"], "sums", n).withColumnRenamed("sums", "suffix_sums")
    levels = hosts.join(by_suffix, "suffix").join(by_domain, "domain")
    prior = lambda own, at_domain, at_suffix: _smooth(own, HOST_WEIGHT, _smooth(at_domain, LEVEL_WEIGHT, _smooth(at_suffix, LEVEL_WEIGHT, root)))
    priors = _mapped(levels, ["host"], ["sums", "domain_sums", "suffix_sums"], "prior", n, prior)
    # P(declared | language), smoothed towards the share of the declaration among all rows
    reliability = lambda own: (own + DECLARED_WEIGHT * own.sum(axis=1, keepdims=True) / max(mass, 1e-9)) / (totals + DECLARED_WEIGHT)
    said = _mapped(said, ["declared"], ["sums"], "reliability", n, reliability)
    fused = scored.select("key", "declared", "host", "letters", "loglik").join(said, "declared", "left").join(priors, "host", "left")
    fused = fused.select("key", "letters", "loglik", F.coalesce("prior", _constant(root)).alias("prior"), F.coalesce("reliability", _constant(np.ones(n))).alias("reliability"))

    def decide(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            letters = batch.column(1).to_numpy()
            logs, priors, reliable = (_matrix(c, n) for c in batch.columns[2:])
            posterior = _softmax(logs + np.log(priors) + np.log(reliable))
            best, by_text, certain = posterior.argmax(axis=1), logs.argmax(axis=1), letters >= LEAST_LETTERS
            name = lambda places: pa.array([languages[k] if c else "und" for k, c in zip(places.tolist(), certain.tolist(), strict=True)], pa.string())
            probability = np.where(certain, np.round(posterior.max(axis=1, initial=0.0), 9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), name(best), pa.array(probability), name(by_text), batch.column(1), pa.array(~certain)], ["key", "language", "probability", "text_language", "letters", "rejected"])

    kind = fused.schema["key"].dataType.simpleString()
    return fused.mapInArrow(decide, f"key {kind}, language string, probability double, text_language string, letters bigint, rejected boolean").withColumnRenamed("key", key)


def identify_pages(pages: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """identify() over raw pages: the declaration is the html tag's lang, the host the address's, the text untagged.

    Null html has no text and is rejected; a page without a lang or with an odd address has null evidence there.
    """
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select(
        "page_id",
        F.nullif(F.regexp_extract("html", r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1), F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract("url", r"(?i)^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")).alias("host"),
        text.alias("text"),
    )
    return identify(rows, "page_id", "declared", "host", per_language)
