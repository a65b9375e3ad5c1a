"""Byte-level BPE: whole words by a minimal perfect hash, all others by a heap over linked bytes; ids decode losslessly."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import SLICE_CHARS, bound_batches, by_slices

#: Words of one text that are handled together, if the text is longer than a slice.
WORDS_AT_ONCE = 500_000
#: Distinct words whose ids a task remembers; beyond that it starts anew.
WORDS_KNOWN = 500_000
#: Keys that share a displacement in the perfect hash, on average.
BUCKET_KEYS = 2
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1


class PerfectHash:
    """Maps n distinct byte strings onto the places 0 to n - 1; other strings land anywhere, so the caller compares.

    A key's 128-bit hash gives a bucket and a start. Each bucket has one displacement under which its keys take
    places of their own; buckets are settled from the largest to the smallest, and a lone key names its place directly.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // BUCKET_KEYS)
        halves = self._halves(keys)
        bucket = (halves[:, 1] % np.uint64(self.buckets)).tolist() if keys else []
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for k, b in enumerate(bucket):
            held[b].append(k)
        low = halves[:, 0].tolist() if keys else []
        shift = [0] * self.buckets
        self.key_at = np.full(self.size, -1, np.int64)
        taken = bytearray(self.size)
        for b in sorted(range(self.buckets), key=lambda b: -len(held[b])):
            if len(held[b]) < 2:
                break
            d = 0
            while True:
                places = [((((low[k] ^ (d * _STEP & _ALL)) * _MIX) & _ALL) >> 16) % self.size for k in held[b]]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    break
                d += 1
            shift[b] = d
            for k, p in zip(held[b], places, strict=True):
                taken[p], self.key_at[p] = 1, k
        free = (p for p in range(self.size) if not taken[p])
        for b, p in zip((b for b in range(self.buckets) if len(held[b]) == 1), free, strict=True):
            shift[b], self.key_at[p] = -1 - p, held[b][0]
        self.shift = np.array(shift, np.int64)

    @staticmethod
    def _halves(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)[:, ::-1]

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The number of the key that sits where each given string leads."""
        if not keys or not self.size:
            return np.full(len(keys), -1, np.int64)
        halves = self._halves(keys)
        shift = self.shift[(halves[:, 1] % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            turned = (halves[:, 0] ^ (np.maximum(shift, 0).astype(np.uint64) * np.uint64(_STEP))) * np.uint64(_MIX)
        place = ((turned >> np.uint64(16)) % np.uint64(self.size)).astype(np.int64)
        return self.key_at[np.where(shift < 0, -1 - shift, place)]


class Vocabulary:
    """Tokens and their ranks, which are their ids, with the perfect hash over the tokens.

    known remembers the ids of words met before: place of a word, and the ids of all places one after the other.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.plain = pattern, plain_pattern(pattern)
        self.tokens = list(ranks)
        self.ids = [ranks[t] for t in self.tokens]
        self.rank = ranks
        places = np.full(max(self.ids, default=-1) + 2, -1, np.int64)  # the last one is of ids that are too large
        places[self.ids] = np.arange(len(self.tokens))
        self.place_of_id = places
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_bytes = np.array([len(t) for t in self.tokens], np.int32)
        self.token_begin = np.cumsum(self.token_bytes, dtype=np.int32) - self.token_bytes
        self.longest = max(map(len, self.tokens), default=0)
        self.hash = PerfectHash(self.tokens)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = array("i"), array("i")

    def learn(self, words: list[str]) -> None:
        """Look up words that are not known: the perfect hash first, the heap for what it does not hold."""
        raw = [w.encode("utf-8") for w in words]
        for word, key, k in zip(words, raw, self.hash.places(raw).tolist(), strict=True):
            self.known[word] = len(self.sizes)
            ids = (self.ids[k],) if k >= 0 and self.tokens[k] == key else merge(key, self.rank, self.longest)
            self.flat.extend(ids)
            self.sizes.append(len(ids))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        if len(self.known) > WORDS_KNOWN:
            self.forget()
        codes = list(map(self.known.get, words))
        if fresh := [w for w, c in zip(words, codes, strict=True) if c is None]:
            self.learn(list(dict.fromkeys(fresh)))
            codes = list(map(self.known.get, words))
        places, each = np.array(codes, np.int64), np.array(self.sizes, np.int64)
        count = each[places]
        begin = np.cumsum(count) - count
        return np.array(self.flat, np.int32)[np.repeat((np.cumsum(each) - each)[places] - begin, count) + np.arange(int(count.sum()))], count

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of texts whose ids stand one after the other, so many of each."""
        places = self.place_of_id[np.clip(ids, -1, len(self.place_of_id) - 1)]
        if len(places) and places.min() < 0:
            raise KeyError("the vocabulary lacks an id")
        count = self.token_bytes[places]
        ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        shift = self.token_begin[places] - ends[:-1]
        kept = np.int32 if ends[-1] < 1 << 31 else np.int64
        data = self.blob[np.repeat(shift.astype(kept), count) + np.arange(ends[-1], dtype=kept)].tobytes()
        edges = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905


def merge(word: bytes, rank: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a word by merging its bytes: always the neighbours of the lowest joint rank, the leftmost of equals.

    An entry of the agenda is rank, begin and end in one number.
    """
    n, joint = len(word), rank.get
    bits = n.bit_length()
    low = (1 << bits) - 1
    stop = list(range(1, n + 1))  # where the token that starts here ends; 0 if none starts here
    before = list(range(-1, n))  # where the token in front of this one starts
    agenda = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := joint(word[i : i + 2])) is not None]
    heapify(agenda)
    while agenda:
        entry = heappop(agenda)
        i, end = entry >> bits & low, entry & low
        middle = stop[i]
        if not middle or middle >= n or stop[middle] != end:
            continue  # one of the two has been merged meanwhile
        stop[i], stop[middle] = end, 0
        if end < n:
            before[end], after = i, stop[end]
            if after - i <= longest and (r := joint(word[i:after])) is not None:
                heappush(agenda, (r << bits | i) << bits | after)
        if i:
            first = before[i]
            if end - first <= longest and (r := joint(word[first:end])) is not None:
                heappush(agenda, (r << bits | first) << bits | end)
    ids, i = [], 0
    while i < n:
        ids.append(rank[word[i : stop[i]]])
        i = stop[i]
    return ids


def plain_pattern(pattern: str) -> str:
    """The pattern for the standard re module and texts of the basic plane: letters, digits and white space as ranges of code points."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    code = lambda c: f"\\u{ord(c):04x}"
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ranges = "".join(f"{code(m[0][0])}-{code(m[0][-1])}" for m in regex.finditer(f"{name}+", every))
        parts = re.split(r"(\[\^?[^]]*\])", pattern)  # sets and what is between them
        pattern = "".join(part.replace(name, ranges) if k % 2 else part.replace(name, f"[{ranges}]") for k, part in enumerate(parts))
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{ranges}]")
    return pattern


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank. Every single byte must be a token, so that any text can be encoded."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} lacks the single bytes {missing[:5]}")
    return ranks


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _words(text: str, plain: re.Pattern, full: regex.Pattern) -> Iterator[list[str]]:
    pattern = full if _BEYOND.search(text) else plain
    if len(text) <= SLICE_CHARS:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while block := [m.group() for m in islice(found, WORDS_AT_ONCE)]:
        yield block


def encode_texts(texts: list[str], words_of: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has."""
    plain, full = re.compile(words_of.plain), regex.compile(words_of.pattern)
    out, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    words: list[str] = []
    owners: list[tuple[int, int]] = []

    def settle() -> None:
        ids, count = words_of.encode_words(words)
        out.append(ids)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = 0
        for t, k in owners:
            sizes[t] += ends[at + k] - ends[at]
            at += k
        words.clear()
        owners.clear()

    for t, text in enumerate(texts):
        for block in _words(text, plain, full):
            words += block
            owners.append((t, len(block)))
            if len(words) >= WORDS_AT_ONCE:
                settle()
    if words:
        settle()
    return np.concatenate(out), sizes


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """id_column and ids (array of int) of every row's whole text; with `decoded` also the bytes that the ids give back.

    Each match of the pattern is encoded by itself, without special tokens. Null and empty texts have no ids (and decode
    to no bytes); repeated rows give repeated results; an empty table gives no rows; other columns go. The driver reads
    the ranks from `path` and raises if there are none; the vocabulary (a bounded file) is sent to the executors once.
    Letters and digits are those of the Unicode version that the installed regex module knows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in by_slices(texts):
                ids, sizes = encode_texts(texts[start:end], words_of)
                places = np.concatenate([[0], np.cumsum(sizes)])
                columns = [batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array(words_of.decode(ids, sizes), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select(F.col(id_column), F.col(text_column))
    kind = picked.schema[0].dataType.simpleString()
    names = [id_column, "ids", *(["decoded"] if decoded else [])]
    return picked.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id_column and decoded (bytes) of every row's ids, null for null ids; an id that the vocabulary lacks is an error."""
    spark = encoded.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.array([len(v) if v.is_valid else 0 for v in lists], np.int64)
            found = sent.value.decode(lists.flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d if v.is_valid else None for d, v in zip(found, lists, strict=True)], pa.binary())], names=[id_column, "decoded"])

    picked = encoded.select(F.col(id_column), F.col("ids"))
    return picked.mapInArrow(run, f"`{id_column}` {picked.schema[0].dataType.simpleString()}, decoded binary")
