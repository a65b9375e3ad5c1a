"""Periodic runs of words: tiles a period octave, Z-functions at tile boundaries, fragments stitched by document and period.

A run is a stretch of consecutive words with smallest period q and length of at least max(24, 3 * q) that no neighbouring
word extends. For a period p, the places i whose word equals the word at i + p form intervals; a run of period p is an interval
of at least max(24, 3 * p) - p places. In the octave of the periods P to 2 * P - 1 such an interval meets a multiple of
max(16, 2 * P), the octave's boundaries. A boundary's Z-functions tell how far the interval reaches to either side, at most
as far as the next boundary; pieces of longer intervals meet again by document and period.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm.common import SLICE_CHARS, bound_batches, stored

#: What separates words, and the words between.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words that a tile is about; the tiles of a document of at most so many are solved where they are cut.
TILE_WORDS = 1 << 15
#: Words on either side of a boundary that must agree before a tile's Z-functions are computed (of the 8 at least that a fragment has there).
PROBE = 8
WORDS_AT_ONCE = 500_000

RUN = "struct<start: bigint, length: bigint, period: bigint>"
FRAGMENT = "struct<period: int, start: int, end: int>"
TILE = "struct<first: int, last: int, offset: int, low: int, high: int, codes: array<int>>"


def step_of(octave: int) -> int:
    """Distance of the boundaries of an octave; every run's interval is at least as long."""
    return max(16, 2 * octave)


def z_function(s: list[int]) -> list[int]:
    """For each place, how many symbols from there on equal those at the start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def _prime_divisors(p: int) -> tuple[int, ...]:
    found, q = [], 2
    while q * q <= p:
        if p % q == 0:
            found.append(q)
            while p % q == 0:
                p //= q
        q += 1
    return (*found, p) if p > 1 else tuple(found)


def _at_boundary(w: np.ndarray, b: int, octave: int, most: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the octave's fragments at boundary b, places in w; of powers only the primitive period."""
    step = step_of(octave)
    ahead = z_function(w[b : b + step + 2 * octave].tolist())
    behind = w[max(0, b - step) : b][::-1].tolist()
    mirrored = w[max(0, b - step) : b + 2 * octave][::-1].tolist()
    back = z_function([*behind, -1, *mirrored])[len(behind) + 1 :]
    found = []
    for p in range(octave, min(2 * octave - 1, most, len(w) - b) + 1):
        right = min(step, ahead[p]) if p < len(ahead) else 0
        at = len(mirrored) - (b - max(0, b - step)) - p
        left = min(step, back[at]) if 0 <= at < len(back) else 0
        if left + right >= step and not any(ahead[p // q] >= p - p // q for q in _prime_divisors(p)):
            found.append((p, b - left, b + right))
    return found


def _agree(first: np.ndarray, second: np.ndarray, b: np.ndarray, periods: np.ndarray, steps: range) -> np.ndarray:
    """The boundaries that have a period under which the words at all the given steps from them agree."""
    last = len(first) - 1
    at = steps[0]
    rows, columns = np.nonzero(first[np.clip(b + at, -1, last)][:, None] == second[np.minimum(b[:, None] + periods + at, last)])
    place, shift = b[rows], periods[columns]
    for i in steps:
        if not len(place):
            break
        same = first[np.clip(place + i, -1, last)] == second[np.minimum(place + shift + i, last)]
        place, shift = place[same], shift[same]
    return place


def solve(w: np.ndarray, offset: int, n: int, first_octave: int, last_octave: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) at the boundaries from low to before high of a document of n words; w begins at word `offset`."""
    most = n // LEAST_TIMES
    one, two = np.append(w, -1), np.append(w, -2)  # the last place, also as place -1, equals nothing
    found, octave = [], first_octave
    while octave <= min(last_octave, most):
        step = step_of(octave)
        b = np.arange(-(-low // step) * step, min(high, n - octave + 1), step) - offset
        periods = np.arange(octave, min(2 * octave - 1, most) + 1)
        if len(b):
            near = np.concatenate([_agree(one, two, b, periods, range(PROBE)), _agree(one, two, b, periods, range(-1, -1 - PROBE, -1))])
            for place in np.unique(near).tolist():
                found += [(p, s + offset, e + offset) for p, s, e in _at_boundary(w, place, octave, most)]
        octave *= 2
    return found


def tiles(w: np.ndarray, tile_words: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(first octave, last octave, offset, low, high, codes). Octaves whose boundaries are near each other share their tiles."""
    n = len(w)
    last_shared = max(1, tile_words // 16)
    octave = 1
    while octave <= n // LEAST_TIMES:
        until = last_shared if octave < last_shared else octave
        step = step_of(until)
        width = max(tile_words, step)
        for low in range(0, n, width):
            start = max(0, low - step)
            yield octave, until, start, low, low + width, w[start : low + width + step + 2 * until]
        octave = 2 * until


def coded(text: str) -> tuple[np.ndarray, list[str]]:
    """The words of a text as numbers, and the distinct words."""
    place: dict[str, int] = {}
    if len(text) <= SLICE_CHARS:
        codes = array("i", [place.setdefault(word, len(place)) for word in WORD.findall(text)])
    else:
        codes, words = array("i"), WORD.finditer(text)
        while block := [place.setdefault(m.group(), len(place)) for m in islice(words, WORDS_AT_ONCE)]:
            codes.extend(block)
    return np.frombuffer(codes, np.int32) if codes else np.zeros(0, np.int32), list(place)


def _cut(docs: DataFrame, id_column: str, text_column: str, tile_words: int) -> DataFrame:
    """A row for each document with its words and the fragments found so far, and a row for each tile that is still to be solved."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column))
    schema = f"row_key bigint, id {picked.schema[0].dataType.simpleString()}, is_doc boolean, n_words bigint, words string, pending boolean, fragments array<{FRAGMENT}>, tile {TILE}"
    fragment, tile = pa.list_(pa.struct([(c, pa.int32()) for c in ("period", "start", "end")])), pa.struct([*((c, pa.int32()) for c in ("first", "last", "offset", "low", "high")), ("codes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_key = TaskContext.get().partitionId() << 36  # a number of its own for every row, also where ids repeat

        def batch_of(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), kind, pa.bool_(), pa.int64(), pa.string(), pa.bool_(), fragment, tile]
            names = ["row_key", "id", "is_doc", "n_words", "words", "pending", "fragments", "tile"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row_key += 1
                w, known = coded(text or "")
                n, here, pending = len(w), [], False
                if n > tile_words:
                    pending = True
                    for first, last, offset, low, high, codes in tiles(w, tile_words):
                        yield batch_of(batch.schema.types[0], [(row_key, key, False, n, None, True, None, {"first": first, "last": last, "offset": offset, "low": low, "high": high, "codes": codes})])
                elif n >= LEAST_WORDS:
                    here = [{"period": p, "start": s, "end": e} for p, s, e in solve(w, 0, n, 1, n, 0, n)]
                rows.append((row_key, key, True, n, " ".join([known[c] for c in w.tolist()]), pending or bool(here), here, None))
                held += len(text or "")
                if held >= SLICE_CHARS:
                    yield batch_of(batch.schema.types[0], rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(batch.schema.types[0], rows)

    return picked.mapInArrow(run, schema)


def _solved(cut: DataFrame) -> DataFrame:
    """The fragments of the tiles that were shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = solve(np.array(r["codes"], np.int32), r["offset"], r["n_words"], r["first"], r["last"], r["low"], r["high"])
                p, s, e = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([r["row_key"]] * len(found), pa.int64()), *(pa.array(c, pa.int32()) for c in (p, s, e))], names=["row_key", "period", "start", "end"])

    rows = cut.filter(~F.col("is_doc")).select("row_key", "n_words", "tile.*")
    return rows.repartition("row_key", "first", "offset").mapInArrow(run, "row_key bigint, period int, start int, end int")


def _stitched(fragments: DataFrame) -> DataFrame:
    """row_key, runs: fragments of a document and period that overlap or touch are one interval; those long enough are runs."""
    by = Window.partitionBy("row_key", "period").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    parts = parts.withColumn("part", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("row_key", "period", "part").agg(F.min("start").cast("bigint").alias("start"), F.max("end").alias("end"))
    period = F.col("period").cast("bigint")
    whole = whole.select("row_key", F.struct("start", (F.col("end") - F.col("start") + period).alias("length"), period.alias("period")).alias("run"))
    long = whole.filter((F.col("run.length") >= LEAST_WORDS) & (F.col("run.length") >= LEAST_TIMES * F.col("run.period")))
    return long.groupBy("row_key").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space; runs are (start, length, period)."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _collapsed(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = [collapse(w.split(" "), [(r["start"], r["length"], r["period"]) for r in found]) if found else w for w, found in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return rows.select("id", "n_words", "words", "runs").mapInArrow(run, f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tile_words: int = TILE_WORDS) -> DataFrame:
    """id_column, n_words, runs (array of start, length, period by start, then period) and collapsed text of every row.

    Words are what white space (ASCII) separates. Null and empty texts have no words and no runs, and collapse to empty text;
    repeated rows and null ids give rows of their own; an empty table gives no rows; other columns go. A document of more than
    tile_words words spreads over tasks as tiles of every octave; tile_words (a power of two, 16 at least) changes no result.
    """
    if tile_words < 16 or tile_words & (tile_words - 1):
        raise ValueError("tile_words must be a power of two, 16 at least")
    bound_batches(docs.sparkSession)
    cut = stored(_cut(docs, id_column, text_column, tile_words), "runs", compression="zstd")
    fragments = cut.filter("is_doc and size(fragments) > 0").select("row_key", F.inline("fragments")).unionByName(_solved(cut))
    whole = cut.filter("is_doc").select("row_key", "id", "n_words", "words", "pending")
    none = F.array().cast(f"array<{RUN}>")
    quiet = whole.filter(~F.col("pending")).select("id", "n_words", none.alias("runs"), F.col("words").alias("collapsed"))
    found = whole.filter("pending").join(_stitched(fragments), "row_key", "left").withColumn("runs", F.coalesce("runs", none))
    return quiet.unionByName(_collapsed(found)).withColumnRenamed("id", id_column)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: first by start, then period); null if there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def run_lines(runs: Column) -> Column:
    """Every run's start,length,period and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by the hash of its id repeats a stretch of its words to the end.

    With h the CRC of the id as text, g = floor(h / 10) and n words: if h % 10 = 0 and n > 0, each word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those of null ids, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    # the words are a column of their own, made only where they are needed
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("left", F.col("n") - F.col("a"))
    rows = rows.withColumn("p", (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("bigint"))
    unit = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil(F.col("left") / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), F.col("left").cast("int"))
    joined = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, joined).otherwise(F.col("text")).alias("text"))
