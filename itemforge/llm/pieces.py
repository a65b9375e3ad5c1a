"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type model joins the adjacent symbols whose union has the best score, the leftmost of equals, until no union
is a piece. Each candidate merge is skipped where a keyed hash of (seed, document, span in the document) falls below
the dropout rate, so a seed and a document settle a segmentation, and every occurrence of a word draws its own. With
dropout 0 the result is the model's own. Characters without a piece, U+2581 among them, become byte pieces, so that
decoding gives back every text exactly.

Occurrences share work where they skip alike: every word that a slice holds more than once is merged once without
dropout, and an occurrence that skips none of these merges has that result. The others are merged by their own draws. Short words advance
together, each by its own next agenda entry; long ones have an agenda each. A long word is cut first between characters
that stand together in no piece, so that text without spaces falls into short words where the model has few pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, by_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, DROPOUT = 13, 0.1
SHORT = 48  # symbols of a word that advances with others
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, SHORT)  # of the rows that words are laid in
ROWS = 1 << 15  # words that advance together
SLICE = 500_000  # characters whose words are segmented together
SPACE = "▁"
#: No piece spans these parts of a text: a run of spaces with the word behind it, a word, a run of line ends.
_PARTS = re.compile(r" +[^ \n]*|[^ \n]+|\n+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLOTS = 20
_NONE = np.iinfo(np.int32).max


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """Tables of a merge-type model with byte pieces; a few megabytes."""

    piece_bytes: list[bytes]
    char_ids: np.ndarray  # by code point, -1 without a piece
    byte_base: int
    pair_keys: list[np.ndarray]  # two open tables of left * size + right
    pair_merged: list[np.ndarray]
    rank: np.ndarray  # by piece: smaller merges first, equal scores share a rank
    size: int
    together: np.ndarray  # sorted codes of the neighbouring characters inside pieces

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        is_byte = [model.is_byte(i) for i in range(size)]
        plain = {p: i for i, p in enumerate(pieces) if not is_byte[i] and not model.is_control(i) and not model.is_unknown(i)}
        char_ids = np.full(0x110000, -1, dtype=np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                char_ids[ord(p)] = i
        char_ids[ord(" ")], char_ids[ord(SPACE)] = char_ids[ord(SPACE)], -1
        scores = np.array([model.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = {plain[p[:k]] * size + plain[p[k:]]: i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        keys, merged, left = [], [], pairs
        for salt in range(4):
            table, values, rest = np.full(1 << _SLOTS, -1, np.int64), np.full(1 << _SLOTS, -1, np.int32), {}
            for key, slot in zip(left, cls._slot(np.array(list(left), dtype=np.int64), salt).tolist(), strict=True):
                if table[slot] >= 0:
                    rest[key] = left[key]
                else:
                    table[slot], values[slot] = key, left[key]
            keys.append(table)
            merged.append(values)
            left = rest
            if not left:
                break
        assert not left, "the pair tables are too small"
        raw = [bytes([int(p[3:-1], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(pieces, is_byte, strict=True)]
        spelled = [p.replace(SPACE, " ") for p in plain if len(p) > 1]
        together = np.unique(np.array([ord(x) << 21 | ord(y) for p in spelled for x, y in zip(p, p[1:], strict=False)], dtype=np.int64))
        return cls(raw, char_ids, is_byte.index(True), keys, merged, rank, size, together)

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, piece) of each pair, for agendas of one word."""
        found = [(k[k >= 0].tolist(), m[k >= 0].tolist()) for k, m in zip(self.pair_keys, self.pair_merged, strict=True)]
        rank = self.rank.tolist()
        return {k: (rank[m], m) for keys, merged in found for k, m in zip(keys, merged, strict=True)}

    def cut(self, word: str) -> list[str]:
        """The word in parts that no piece reaches across."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.searchsorted(self.together, pairs)
        at[at == len(self.together)] = 0
        edges = [0, *(np.flatnonzero(self.together[at] != pairs) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    @staticmethod
    def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) + np.uint64(salt * 7919)) * _A >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 for none; negative ids have none."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        out = np.full(len(keys), -1, dtype=np.int32)
        todo = np.arange(len(keys))
        for salt, (table, values) in enumerate(zip(self.pair_keys, self.pair_merged, strict=True)):
            slot = self._slot(keys[todo], salt)
            hit = table[slot] == keys[todo]
            out[todo[hit]] = values[slot[hit]]
            todo = todo[~hit & (table[slot] >= 0)]  # an empty slot holds no pair in any later table
            if not len(todo):
                break
        return out


def _skipped(keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        span = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
        return _mix(keys + span * _A) < limit


_MASK = (1 << 64) - 1
_INT = tuple(int(c) for c in (_A, _B, _C))


def _agenda(v: Vocabulary, symbols: list[int], key: int, offset: int, limit: int) -> list[int]:
    """One long word by its own agenda of candidate merges."""
    n, size, pairs, (a, b, c) = len(symbols), v.size, v.pairs, _INT
    symbols, end = list(symbols), list(range(1, n + 1))
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, entries: list) -> None:
        j = after[i] if i >= 0 else -1
        if j < 0 or symbols[i] < 0 or symbols[j] < 0:
            return
        found = pairs.get(symbols[i] * size + symbols[j])
        if found is None:
            return
        if limit:  # _skipped() of one span
            x = key + (offset + i << 42 ^ offset + j << 21 ^ offset + end[j]) * a & _MASK
            x = (x ^ x >> 30) * b & _MASK
            x = (x ^ x >> 27) * c & _MASK
            if x ^ x >> 31 < limit:
                return
        entries.append((found[0], i, j, end[j], found[1]))

    for i in range(n):
        offer(i, agenda)
    heapq.heapify(agenda)
    alive = [True] * n
    while agenda:
        _, i, j, stop, merged = heapq.heappop(agenda)
        if not alive[i] or not alive[j] or after[i] != j or end[j] != stop or end[i] != j:
            continue
        symbols[i], end[i], after[i], alive[j] = merged, stop, after[j], False
        if after[i] >= 0:
            before[after[i]] = i
        new: list = []
        offer(before[i], new)
        offer(i, new)
        for entry in new:
            heapq.heappush(agenda, entry)
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def _together(v: Vocabulary, base: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, items: np.ndarray, keys: np.ndarray, offsets: np.ndarray, limit: np.uint64, merges: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Short words side by side, one a row: every step does the best merge of each row that has one."""
    column = np.arange(width)
    alive = column < lengths[:, None]
    symbol = np.where(alive, base[np.minimum(starts[:, None] + column, len(base) - 1)], -1)
    after = np.tile((column + 1).astype(np.int16), (len(items), 1))
    before = np.tile((column - 1).astype(np.int16), (len(items), 1))
    target = np.full(symbol.shape, -1, np.int32)
    order = np.full(symbol.shape, _NONE, np.int32)

    def offer(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """The candidate of the symbols at i and j, neighbours."""
        merged = v.merge(symbol[row, i], symbol[row, j])
        has = np.flatnonzero(merged >= 0)
        if limit and len(has):
            r, offset = row[has], offsets[row[has]]
            has = has[~_skipped(keys[r], i[has] + offset, j[has] + offset, after[r, j[has]] + offset, limit)]
        order[row, i] = _NONE
        r, k, m = row[has], i[has], merged[has]
        target[r, k], order[r, k] = m, v.rank[m] * SHORT + k

    if width > 1:
        row, i = np.nonzero(alive[:, 1:])
        offer(row, i, i + 1)
    row = np.arange(len(items) if width > 1 else 0)
    while len(row):
        held = order[row]
        i = held.argmin(axis=1)
        going = held[np.arange(len(row)), i] < _NONE
        row, i = row[going], i[going]
        j = after[row, i].astype(np.int64)
        stop = after[row, j].astype(np.int64)
        if merges is not None:
            merges.append((items[row], i, j, stop))
        symbol[row, i], after[row, i] = target[row, i], stop
        alive[row, j], order[row, j], order[row, i] = False, _NONE, _NONE
        more = stop < lengths[row]
        before[row[more], stop[more]] = i[more]
        left = before[row, i].astype(np.int64)
        has = left >= 0
        # the pairs behind and before the new symbol
        offer(np.concatenate([row[more], row[has]]), np.concatenate([i[more], left[has]]), np.concatenate([stop[more], i[has]]))
    return np.repeat(items, alive.sum(axis=1)).astype(np.int32), symbol[alive]


def _segment(v: Vocabulary, words: list[str], which: np.ndarray, keys: np.ndarray, offsets: np.ndarray, limit: np.uint64, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of item i (word which[i] at offsets[i] of the text with keys[i]): a flat array, and its bounds.

    A negative symbol is a character without a piece: code point - 1 - 2**21. merges takes arrays (item, start, middle, end) of the merges of short words.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    base = v.char_ids[codes]
    base = np.where(base >= 0, base, codes.astype(np.int32) - (1 << 21) - 1)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    n = lengths[which]
    done: list[tuple[np.ndarray, np.ndarray]] = []  # items, their symbols in order
    for i in np.flatnonzero(n > SHORT).tolist():
        w = which[i]
        out = _agenda(v, base[starts[w] : starts[w] + lengths[w]].tolist(), int(keys[i]), int(offsets[i]), int(limit))
        done.append((np.full(len(out), i, np.int32), np.array(out, dtype=np.int32)))
    least = 0
    for width in WIDTHS:
        rows = np.flatnonzero((n > least) & (n <= min(width, SHORT)))
        least = width
        for a in range(0, len(rows), ROWS):
            part = rows[a : a + ROWS]
            done.append(_together(v, base, starts[which[part]], n[part], width, part, keys[part], offsets[part], limit, merges))
    items = np.concatenate([np.empty(0, np.int32), *(d[0] for d in done)])
    symbols = np.concatenate([np.empty(0, np.int32), *(d[1] for d in done)])
    order = np.argsort(items, kind="stable")
    sizes = np.bincount(items, minlength=len(which))
    return symbols[order], np.concatenate(([0], np.cumsum(sizes)))


def _with_bytes(v: Vocabulary, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece as the pieces of their UTF-8 bytes."""
    at = np.flatnonzero(symbols < 0)
    if not len(at):
        return symbols.astype(np.int32), bounds
    code = symbols[at].astype(np.int64) + (1 << 21) + 1
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    sizes = np.ones(len(symbols), dtype=np.int64)
    sizes[at] = width
    place = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(place[-1], dtype=np.int32)
    plain = symbols >= 0
    out[place[:-1][plain]] = symbols[plain]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
    for k in range(4):
        has = width > k
        shift = 6 * (width[has] - 1 - k)
        value = code[has] >> shift
        value = np.where(k == 0, value | lead[has], (value & 0x3F) | 0x80)
        out[place[at[has]] + k] = v.byte_base + value
    return out, place[bounds]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, dropout: float = DROPOUT) -> None:
        self.v, self.seed = vocabulary, np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        self.limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; keys (one a text) vary the segmentation of equal texts."""
        ids: defaultdict[str, int] = defaultdict(count().__next__)
        tokens, counts = [], []
        for text in texts:
            parts = _PARTS.findall(" " + text) if text else []
            tokens += map(ids.__getitem__, parts)
            counts.append(len(parts))
        if not tokens:
            return [np.empty(0, np.int32)] * len(texts)
        words, size, token = list(ids), np.array(counts), np.array(tokens, dtype=np.int64)
        token, size = self._cut(ids, words, token, size)
        words = list(ids)
        lengths = np.fromiter(map(len, words), np.int64, len(words))[token]
        ends = np.cumsum(lengths)
        with np.errstate(over="ignore"):
            document = _mix(np.array([k & _MASK for k in keys], dtype=np.uint64) * _A + _mix(self.seed * _B + _C))
        first = np.cumsum(size) - size
        offsets = ends - lengths - np.repeat((ends - lengths)[np.minimum(first, len(token) - 1)], size)
        symbols, bounds, item = self._items(words, token, np.repeat(document, size), offsets)
        begin, length = bounds[:-1][item], np.diff(bounds)[item]
        place = np.cumsum(length) - length
        flat = symbols[np.arange(int(length.sum())) + np.repeat(begin - place, length)]
        edges = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(size)))]
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _cut(self, ids: defaultdict[str, int], words: list[str], token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Long words replaced by their parts."""
        parts = {i: [ids[p] for p in self.v.cut(w)] for i, w in enumerate(words) if len(w) > SHORT}
        if not parts:
            return token, size
        long = np.isin(token, np.array(list(parts)))
        n = np.ones(len(token), dtype=np.int64)
        n[long] = [len(parts[t]) for t in token[long].tolist()]
        out, place = np.repeat(token, n), np.cumsum(n) - n
        for at, t in zip(place[long].tolist(), token[long].tolist(), strict=True):
            out[at : at + len(parts[t])] = parts[t]
        edges = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(size)))]
        return out, np.diff(edges)

    def _items(self, words: list[str], token: np.ndarray, keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of each item with their bounds, and the item of each occurrence: first the words, then own draws."""
        merges: list[tuple] = []
        every = np.arange(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # with dropout a long word, and one that occurs once, has no shared result
        alone = (lengths > SHORT) | (np.bincount(token, minlength=len(words)) == 1)
        shared = every if not self.limit else np.flatnonzero(~alone)
        flat, inner = _segment(self.v, words, shared, np.zeros(len(shared), np.uint64), np.zeros(len(shared), np.int64), np.uint64(0), merges)
        plain = np.zeros(len(words), np.int64)
        plain[shared] = np.arange(len(shared))
        item = plain[token]
        if self.limit:
            own = alone[token]
            if merges:
                of, start, middle, end = (np.concatenate(c) for c in zip(*merges, strict=True))
                order = np.argsort(of, kind="stable")
                of, start, middle, end = of[order], start[order], middle[order], end[order]
                held = np.bincount(of, minlength=len(shared))
                first = np.cumsum(held) - held
                for a in range(0, len(token), 1 << 18):
                    short = a + np.flatnonzero(~own[a : a + (1 << 18)])
                    n = held[item[short]]
                    at = np.arange(int(n.sum())) + np.repeat(first[item[short]] - (np.cumsum(n) - n), n)
                    offset = np.repeat(offsets[short], n)
                    skips = _skipped(np.repeat(keys[short], n), start[at] + offset, middle[at] + offset, end[at] + offset, self.limit)
                    own[np.repeat(short, n)[skips]] = True
            drawn = np.flatnonzero(own)
            other, outer = _segment(self.v, words, token[drawn], keys[drawn], offsets[drawn], self.limit)
            item[drawn] = len(shared) + np.arange(len(drawn))
            flat, inner = np.concatenate([flat, other]), np.concatenate([inner, inner[-1] + outer[1:]])
        return (*_with_bytes(self.v, flat, inner), item)


def decode(vocabulary: Vocabulary, ids: np.ndarray | list[int] | None) -> str:
    """The text of piece ids; the space that encoding puts in front is taken off."""
    table = vocabulary.piece_bytes
    return b"".join(map(table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids or []))[1:].decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """The columns of docs with `pieces` (array of piece ids).

    Null text and empty text have no pieces; a text of any length is encoded whole. The key of a document is its doc_id
    (0 for null, a hash where it is no integer), so repeated rows get equal pieces. A column named pieces is replaced,
    others stay; an empty table gives no rows. The model's tables, of fixed size, are read by the driver and broadcast.
    """
    return _encoded(docs, model, seed, dropout, decoding=False)


def _encoded(docs: DataFrame, model: str, seed: int, dropout: float, decoding: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    added = ["pieces", "decoded_sha256", "lossless"] if decoding else ["pieces"]
    head = [c for c in docs.columns if c not in added]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, seed, dropout)
        for batch in source:
            texts, keys = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            flat, sizes, digests, same = [np.empty(0, np.int32)], [0], [], []
            for a, b in by_slices(texts, SLICE):
                for text, ids in zip(texts[a:b], encoder.encode(texts[a:b], keys[a:b]), strict=True):
                    flat.append(ids)
                    sizes.append(len(ids))
                    if decoding:
                        back = decode(shared.value, ids)
                        digests.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                        same.append(back == (text or ""))
            columns = [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))]
            if decoding:
                columns += [pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*batch.schema.names[:-2], *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*head).schema)
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = docs.select(*head, F.col("text").alias("__text"), F.coalesce(key, F.lit(0).cast("long")).alias("__key"))
    return rows.mapInArrow(batches, f"{schema}, pieces array<int>" + (", decoded_sha256 string, lossless boolean" if decoding else ""))


def round_trip(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """encode_documents() with `decoded_sha256`, the digest of what its pieces decode to, and `lossless`.

    The task that encodes a text decodes its pieces too, so only one Python worker a task holds the tables.
    """
    return _encoded(docs, model, seed, dropout, decoding=True)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of encoded with `decoded`, the text of `pieces`; null pieces give the empty text."""
    bound_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    head = [c for c in encoded.columns if c != "decoded"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column(batch.num_columns - 1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decode(shared.value, flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*head).schema)
    return encoded.select(*head, F.coalesce("pieces", F.array().cast("array<int>")).alias("__pieces")).mapInArrow(batches, f"{schema}, decoded string")
