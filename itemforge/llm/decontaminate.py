"""Benchmark decontamination: scan token windows against a broadcast hash set of test n-grams, verify, remove.

Spark derives the windows of the benchmark's items. They are broadcast in blocks of at most BLOCK_WINDOWS windows and
BLOCK_BYTES bytes, a block a pass over the training text; the hits of several passes meet by a digest of the text,
as equal texts have equal hits. So what the driver and a task hold never grows beyond one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, stored

WINDOW = 10
BLOCK_WINDOWS, BLOCK_BYTES = 1_000_000, 128 << 20
#: Bytes that separate words become a space, A-Z becomes a-z, all other bytes stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of that many words."""
    out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width if len(out) else 0):
            out = (out + hashes[j : j + len(out)]) * _PRIME
            out ^= out >> np.uint64(29)
    return out


def windows_of(words: list[bytes], window: int) -> tuple[int, np.ndarray, list[bytes]]:
    """Width, hashes and words of an item's windows; an item of fewer words is one window."""
    width = min(window, len(words))
    spelled = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if width else []
    return width, window_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), width) if width else np.empty(0, np.uint64), spelled


class WindowSet:
    """A block of (width, hash as signed number, window, item), sorted by hash, in flat arrays."""

    def __init__(self, widths: Sequence[int], hashes: Sequence[int], windows: list[bytes], items: list[str]) -> None:
        self.tables = {}
        self.words: dict[bytes, int] = {}  # of the windows, with their hashes
        for window in windows:
            for word in window.split(b" "):
                if word not in self.words:
                    self.words[word] = xxhash.xxh64_intdigest(word)
        width, code = np.array(widths, dtype=np.int64), np.array(hashes, dtype=np.int64).view(np.uint64)
        self.names = sorted(set(items))
        number = {n: i for i, n in enumerate(self.names)}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            at = at[np.argsort(code[at], kind="stable")]
            edges = np.cumsum([0, *(len(windows[i]) for i in at)])
            self.tables[w] = code[at], edges, b"".join([windows[i] for i in at]), np.array([number[items[i]] for i in at], dtype=np.int32)

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> WindowSet:
        rows = [(width, code, spelled, item) for item, words in items for width, codes, windows in [windows_of(words, window)] for code, spelled in zip(codes.view(np.int64).tolist(), windows, strict=True)]
        return cls(*(list(c) for c in zip(*rows, strict=True))) if rows else cls([], [], [], [])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """The words inside verified windows (a flag each), and the items that these windows are from."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        get = self.words.get
        known = [i for i, w in enumerate(words) if w in self.words]
        if not known:
            return hit, items
        places = np.array(known)
        hashes = np.fromiter((get(words[i]) for i in known), dtype=np.uint64, count=len(known))
        for width, (table, edges, spelled, item) in self.tables.items():
            found = window_hashes(hashes, width)
            whole = places[width - 1 :] - places[: len(found)] == width - 1  # words of the block, one behind the other
            near = np.searchsorted(table, found)
            for at in np.flatnonzero(whole & (table[np.minimum(near, len(table) - 1)] == found)).tolist():
                start, k = known[at], int(near[at])
                window = b" ".join(words[start : start + width])
                while k < len(table) and table[k] == found[at]:
                    if spelled[edges[k] : edges[k + 1]] == window:  # the words themselves, not their hash
                        hit[start : start + width] = True
                        items.add(self.names[item[k]])
                    k += 1
        return hit, items


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(width, hash, window, item): the different windows of each item. Items without words or without an id have none."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width, codes, spelled = windows_of(words_of(text), window)
                for a in range(0, len(spelled), 100_000):
                    part = spelled[a : a + 100_000]
                    columns = [pa.array([width] * len(part), pa.int32()), pa.array(codes[a : a + 100_000].view(np.int64)), pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["width", "hash", "window", "item"])

    named = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(batches, "width int, hash long, window binary, item string").distinct()


_HITS = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_HITS_SQL = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>>"


def _scanned(rows: DataFrame, windows: WindowSet) -> tuple[DataFrame, object]:
    """rows with __hits, and the broadcast; the last column is the text and goes."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for value in batch.column(batch.num_columns - 1):
                words = words_of(value.as_py())
                hit, items = shared.value.scan(words)
                places = np.flatnonzero(hit)
                out.append({"n_words": len(words), "starts": places, "ends": places + 1, "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _HITS)], [*batch.schema.names[:-1], "__hits"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(batches, f"{head}, __hits {_HITS_SQL}"), shared


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, others) with __hits: n_words, the hit words (starts, and ends one further), and the items that occur.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. An item with fewer than `window`
    words is one window of its own length. Null or empty text has no words; an item or benchmark without words hits
    nothing. Repeated rows and ids give repeated results; a text of any length is scanned whole; an empty table gives
    no rows. The number of blocks changes the plan and no result.
    """
    bound_batches(docs.sparkSession)
    known = stored(benchmark_windows(benchmark, window), "windows")
    count, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("window") + F.length("item")), F.lit(0))).collect()[0]
    blocks = max(1, math.ceil(count / block_windows), math.ceil(size / block_bytes))
    # by window and item, so that a window which very many items hold is spread, too
    dealt = known.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    block = lambda k: WindowSet(*(c.to_pylist() for c in dealt.filter(F.col("block") == k).select("width", "hash", "window", "item").toArrow().columns))
    columns = docs.columns
    if blocks == 1:
        return _scanned(docs.select(*columns, F.col("text").alias("__text")), block(0))[0]
    parts = None
    for k in range(blocks):
        found, shared = _scanned(docs.select(F.md5("text").alias("key"), "text"), block(k))
        part = stored(found.filter(F.size("__hits.items") > 0).groupBy("key").agg(F.first("__hits").alias("h")), "hits")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    united = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"h.{name}"))))
    whole = parts.groupBy("key").agg(united("starts").alias("starts"), united("items").alias("items")).withColumnRenamed("key", "__key")
    none = F.array().cast("array<bigint>")
    hits = F.struct(
        F.length(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _WORD, "\u0001"), "[^\u0001]+", "")).cast("long").alias("n_words"),
        F.coalesce("starts", none).alias("starts"),
        F.coalesce(F.transform("starts", lambda s: s + 1), none).alias("ends"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    base = docs.select(F.struct(*columns).alias("__row"), "text", F.md5("text").alias("__key"))
    return base.join(whole, "__key", "left").select("__row.*", hits.alias("__hits"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per input row: doc_id, n_words, starts, ends and items (see with_hits). Other columns are ignored."""
    return with_hits(docs.select("doc_id", "text"), benchmark, window, block_windows).select("doc_id", "__hits.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a benchmark window; each row by its own text, whatever its id."""
    return with_hits(docs, benchmark, window).filter(F.size("__hits.items") == 0).drop("__hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per document (see find_hits)."""
    hits = find_hits(docs, benchmark, window)
    n_hit = F.size("starts").cast("long")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the hit words of the given word spans."""
    if not text or not len(starts):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    first, last = edge[0::2], edge[1::2]
    out, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        out.append(raw[at : first[start]])
        at = last[end - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

