"""Near-duplicate join on word n-grams: MinHash LSH forest, then exact Jaccard.

1. Every text becomes a set of word n-grams with a MinHash signature; texts with equal sets are one vertex.
2. Each trie holds the vertices under the signature from its own place on, as one sorted run; shortest prefixes share no
   value between tries. Neighbours in a run tell the longest prefix that a vertex shares with any other. Matches are
   shortened to LEAST_DEPTH values, where the tries together find far more than TARGET_RECALL of the pairs at the threshold.
   That leaves room: where a crowd holds the shortest prefix, a vertex keeps a longer one, in as many tries as the target
   allows, the most crowded ones. A crowd that shares a passage but is not similar so falls apart.
3. Vertices under one prefix are compared by their whole signatures, in blocks where they are many; what is far from
   the threshold drops.
4. Connected survivors are verified exactly, block against block, from the texts. A task's output is a row for each
   of its vertices: its links in the block and one linked vertex, never a row for each pair.
5. Verified links give the classes.

Nothing is capped: larger crowds and clusters only make more blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, by_slices, stored
from itemforge.llm.decontaminate import words_of

NGRAM, THRESHOLD = 5, 0.8
VALUES, TARGET_RECALL = 128, 0.9999
LEAST_DEPTH, LONGER = 4, (6, 8)  # lengths of a matched prefix
CROWD = 64  # vertices under a prefix
BUCKET_BLOCK = 1024  # vertices
VERIFY_BLOCK, VERIFY_ROWS = 200_000, 500  # n-grams and vertices
SIGMAS = 5.0
HUB_EDGES, HUBS = 1000, 2000  # edges that make a hub, and how many hubs there may be: a bounded broadcast
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def recall(trees: int, depth: int, similarity: float = THRESHOLD) -> float:
    """The probability that so many trees of disjoint prefixes find a pair of that similarity."""
    return 1 - (1 - similarity**depth) ** trees


def trees_needed(target: float = TARGET_RECALL, depth: int = LEAST_DEPTH, similarity: float = THRESHOLD) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - similarity**depth))


# ---------------------------------------------------------------- sets and signatures


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def ngram_sets(texts: list[str | None], n: int = NGRAM) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its word n-grams; a text of fewer words is one gram of them all."""
    ids: dict[bytes, int] = {}
    tokens, sizes = [], []
    for text in texts:
        words = words_of(text)
        tokens += [ids.setdefault(w, len(ids)) for w in words]
        sizes.append(len(words))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids], dtype=np.uint64)
    flat = hashes[np.array(tokens, dtype=np.int64)] if tokens else np.empty(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for size in sizes:
            words, at = flat[at : at + size], at + size
            width = min(n, size)
            if not size:
                out.append(np.empty(0, np.uint64))
                continue
            grams = np.zeros(size - width + 1, dtype=np.uint64)
            for j in range(width):
                grams = _mix(grams * _PRIME + words[j : size - width + 1 + j])
            out.append(np.unique(grams))
    return out


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240501)
    return r.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, count, dtype=np.uint64)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), 2048):
            values = (a[:, None] * grams[None, i : i + 2048] + b[:, None]) >> np.uint64(32)
            out = np.minimum(out, values.min(axis=1).astype(np.uint32))
    return out


def fingerprint(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sketches(n: int) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_functions(VALUES)
        for batch in source:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints, counts, signatures, compact = [], [], [], []
            known: dict[bytes, tuple[bytes, bytes]] = {}  # copies in the batch are sketched once
            for i, j in by_slices(texts):
                for grams in ngram_sets(texts[i:j], n):
                    mark = fingerprint(grams)
                    if mark not in known:
                        s = signature(grams, a, b)
                        known[mark] = (s.astype(">u4").tobytes(), s.astype(np.uint8).tobytes())
                    prints.append(mark)
                    counts.append(len(grams))
                    signatures.append(known[mark][0])
                    compact.append(known[mark][1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary()), pa.array(compact, pa.binary())], ["doc_id", "digest", "vertex", "grams", "signature", "compact"])

    return batches


# ---------------------------------------------------------------- grouped work over sorted partitions


def in_groups(df: DataFrame, keys: list[str], function: Callable[[list[pa.Array], np.ndarray], list], schema: str, names: list[str]) -> DataFrame:
    """Hash the rows by keys, sort, and give function the columns of whole groups with the groups' bounds.

    Several groups come in one call; a group that the Arrow batch cuts waits for the next one. Keys come first.
    """
    arrow_types: dict[str, pa.DataType] = {"binary": pa.binary(), "long": pa.int64()}
    fields = [(f.split()[0], arrow_types[f.split()[1]]) for f in schema.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def run(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            n = table.num_rows
            new = np.zeros(n, dtype=bool)
            new[0] = True
            for c in columns[: len(keys)]:
                values = np.array(c.to_pylist(), dtype=object)
                new[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(new)
            cut = n if last else int(starts[-1])
            rest = None if last else table.slice(cut)
            if not cut:
                return None, rest
            bounds = np.append(starts[starts < cut], cut)
            out = function([c.slice(0, cut) for c in columns[len(keys) :]], bounds)
            return pa.RecordBatch.from_arrays([pa.array(o, t) for o, (_, t) in zip(out, fields, strict=True)], [f for f, _ in fields]), rest

        for batch in source:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            done, held = run(table, False)
            if done is not None and done.num_rows:
                yield done
        if held is not None and held.num_rows:
            done, _ = run(held, True)
            if done is not None and done.num_rows:
                yield done

    return df.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while (p := self.parent.get(x, x)) != root:
            self.parent[x], x = root, p
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> tuple[list[int], list[int]]:
        members = [x for x in self.parent if self.find(x) != x]
        return members, [self.find(x) for x in members]


def _join_components(union: _Union, adjacent: np.ndarray, names: np.ndarray) -> None:
    """Unite the components of a boolean adjacency matrix by breadth-first steps."""
    left = np.ones(len(adjacent), dtype=bool)
    for i in range(len(adjacent)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            reached = np.flatnonzero(adjacent[front].any(axis=0) & left)
            left[reached] = False
            for j in reached.tolist():
                union.join(int(names[i]), int(names[j]))
            front = reached


def _similar_in_buckets(columns: list[pa.Array], bounds: np.ndarray, least: int) -> list:
    """Stars of vertices whose compact signatures agree in `least` places, within each bucket block."""
    vertex = columns[0].to_pylist()
    marks = np.frombuffer(b"".join(columns[1].to_pylist()), dtype=np.uint8).reshape(len(vertex), -1)
    union, sizes = _Union(), np.diff(bounds)
    small = sizes <= 16
    group = np.repeat(np.arange(len(sizes)), sizes)
    for shift in range(1, int(sizes[small].max(initial=1))):
        at = np.flatnonzero((group[shift:] == group[:-shift]) & small[group[shift:]])
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            for x in part[np.count_nonzero(marks[part] == marks[part + shift], axis=1) >= least].tolist():
                union.join(x, x + shift)
    for k in np.flatnonzero(~small).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        block = marks[a:b]
        adjacent = np.zeros((b - a, b - a), dtype=bool)
        for i in range(0, b - a, 128):
            same = np.zeros((min(128, b - a - i), b - a), dtype=np.uint8)
            for t in range(block.shape[1]):
                same += block[i : i + 128, t, None] == block[None, :, t]
            adjacent[i : i + 128] = same >= least
        _join_components(union, adjacent, np.arange(a, b))
    members, roots = union.stars()
    return [[vertex[i] for i in members], [vertex[i] for i in roots]]


def pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets: common grams by matrix product, rare ones by their holders."""
    m = len(sets)
    out = np.zeros((m, m), dtype=np.int64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    grams, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    frequent = held > 16
    rare = ~frequent[column] & (held[column] > 1)
    o, c = owner[rare], column[rare]
    for shift in range(1, 16):
        at = np.flatnonzero(c[shift:] == c[:-shift]) if shift < len(c) else np.empty(0, np.int64)
        if not len(at):
            break
        both = np.bincount(o[at] * m + o[at + shift], minlength=m * m).reshape(m, m)
        out += both + both.T
    number = np.cumsum(frequent) - 1
    often = frequent[column]
    o, c = owner[often], number[column[often]]
    for a in range(0, int(frequent.sum()), 4096):
        part = (c >= a) & (c < a + 4096)
        dense = np.zeros((m, min(4096, int(frequent.sum()) - a)), dtype=np.float32)
        dense[o[part], c[part] - a] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _verified(columns: list[pa.Array], bounds: np.ndarray, threshold: Fraction) -> list:
    """For each vertex of each block pair: the documents it links to there, and one vertex of its linked cluster."""
    vertex, side, own, copies = columns[0].to_pylist(), np.array(columns[1].to_pylist()), np.array(columns[2].to_pylist(), dtype=bool), np.array(columns[3].to_pylist())
    sets = [np.frombuffer(s, dtype=np.uint64) for s in columns[4].to_pylist()]
    union, links = _Union(), np.zeros(len(vertex), dtype=np.int64)
    p, q = threshold.numerator, threshold.denominator
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows = np.array(list({v: i for i, v in reversed(list(enumerate(vertex[a:b], a)))}.values()))  # a vertex once
        if len(rows) < 2:
            continue
        sizes = np.array([len(sets[i]) for i in rows])
        common = pair_counts([sets[i] for i in rows])
        # common / (x + y - common) >= p / q
        linked = (p + q) * common >= p * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if not own[a]:  # two blocks: pairs inside one of them belong to that block's own group
            linked &= side[rows, None] != side[None, rows]
        links[rows] = linked @ copies[rows]
        _join_components(union, linked, rows)
    has = np.flatnonzero(links).tolist()
    return [[vertex[i] for i in has], links[has].tolist(), [vertex[union.find(i)] for i in has]]


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for edges (u, v): the smallest vertex of each component, by large-star and small-star steps.

    Each round is written to the shared folder. Vertices without an edge are absent.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def with_least(e: DataFrame, total: int) -> DataFrame:
        """Edges with the least neighbour of u. Hubs are broadcast, so that no task reads all edges of one."""
        most = max(HUB_EDGES, total // HUBS)
        least = e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("held"))
        if total <= most:
            return e.join(least.drop("held"), "u")
        least = stored(least, "least")
        hubs = least.filter(F.col("held") > most).drop("held")
        if not hubs.limit(1).count():
            return e.join(least.drop("held"), "u")
        return e.join(F.broadcast(hubs), "u").unionByName(e.join(F.broadcast(hubs), "u", "left_anti").join(least.filter(F.col("held") <= most).drop("held"), "u"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])

    edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        large = with_least(both(edges), 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        held = with_least(large, before[0])
        small = held.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(held.select("u", F.col("least").alias("v"))).distinct()
        edges = stored(small, "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root"))).distinct()


# ---------------------------------------------------------------- the forest


def _places(column: pa.Array) -> np.ndarray:
    """The rows of a binary column of one length as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def shared_lengths(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, a byte for the tree and four for each value: the values that each has in common with the key after it, -1 in another tree."""
    equal = keys[1:] == keys[:-1]
    values = equal[:, 1:].reshape(len(equal), (keys.shape[1] - 1) // 4, 4).all(axis=2)
    return np.where(equal[:, 0], np.cumprod(values, axis=1).sum(axis=1), -1)


def _matched(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted run (key, vertex), the rows that share LEAST_DEPTH values or more with a neighbour, and how many.

    The first and the last row of a run may have a neighbour in another one: they count as matched to the end.
    """
    deepest = LONGER[-1]
    held: tuple[bytes, bytes] | None = None
    above = deepest  # what the held row shares with the row before it

    def rows(keys: list[bytes], vertices: list[bytes], shared: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vertices, pa.binary()), pa.array(shared, pa.int32())], ["key", "vertex", "shared"])

    for batch in source:
        if not batch.num_rows:
            continue
        keys, vertices = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if held:
            keys, vertices = [held[0], *keys], [held[1], *vertices]
        lengths = shared_lengths(_places(pa.array(keys, pa.binary())))
        around = np.append(above, lengths)
        most = np.maximum(around[:-1], lengths)
        keep = np.flatnonzero(most >= LEAST_DEPTH).tolist()
        if keep:
            yield rows([keys[i] for i in keep], [vertices[i] for i in keep], most[keep].tolist())
        held, above = (keys[-1], vertices[-1]), int(around[-1])
    if held:
        yield rows([held[0]], [held[1]], [deepest])


def _node(depth: int) -> Column:
    """A key of a prefix of that many values; the tree is the first byte."""
    return F.xxhash64(F.lit(depth), F.substring("key", 1, 1 + 4 * depth))


def long_trees(target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> int:
    """In how many trees a vertex may keep a longer prefix: those of both vertices of a pair leave enough others for the target."""
    trees = VALUES // LEAST_DEPTH
    return max(0, trees - trees_needed(target, LEAST_DEPTH, threshold)) // 2


def forest(vertices: DataFrame, target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> DataFrame:
    """(node, vertex, held) for vertices (vertex, signature): the prefixes matched, held by more than one vertex.

    The tries are sorted runs: prefixes of up to LONGER[-1] values, in ranges of their order, so that neighbours share the
    longest prefix there is. Rows that share less than LEAST_DEPTH values with both neighbours leave at once, without a
    further shuffle. A match is shortened to LEAST_DEPTH where no crowd holds that prefix; elsewhere to the shortest that
    no crowd holds, in long_trees() trees of a vertex at most, the most crowded ones, and to LEAST_DEPTH in its others. A
    vertex stays listed under the longer prefixes that others keep, so that a pair meets at the longer of its two.
    """
    trees, deepest = VALUES // LEAST_DEPTH, LONGER[-1]
    around = F.concat("signature", F.substring("signature", 1, 4 * deepest))  # a prefix that begins near the end goes on from the start
    key = [F.concat(F.lit(bytes([t])), F.substring(around, t * 4 * LEAST_DEPTH + 1, 4 * deepest)) for t in range(trees)]
    runs = vertices.select(F.explode(F.array(*key)).alias("key"), "vertex")
    runs = runs.repartitionByRange("key", "vertex").sortWithinPartitions("key", "vertex")
    trie = stored(runs.mapInArrow(_matched, "key binary, vertex binary, shared int"), "trie")

    def sized(rows: DataFrame, depth: int) -> DataFrame:
        """Rows with their node at that depth and how many rows it has."""
        rows = rows.withColumn("node", _node(depth))
        return rows.join(rows.groupBy("node").agg(F.count("*").alias("held")), "node")

    met = stored(sized(trie, LEAST_DEPTH).filter("held > 1"), "forest")
    found = met.filter(F.col("held") <= CROWD).select("node", "vertex", "held")
    crowded = stored(met.filter(F.col("held") > CROWD).select("key", "vertex", "shared", F.col("held").alias("crowd")), "crowded")
    if not crowded.limit(1).count():
        return found
    crowded = crowded.withColumn("depth", F.lit(deepest))
    for depth in reversed(LONGER[:-1]):
        # a row alone under its prefix has no row in the count and keeps it: longer prefixes have no other row either
        counts = crowded.filter(F.col("shared") >= depth).groupBy(_node(depth).alias("node")).agg(F.count("*").alias("n"))
        counts = counts.filter(F.col("n") > CROWD).withColumn("full", F.lit(True)).drop("n")
        full = (F.col("shared") >= depth) & F.coalesce("full", F.lit(False))
        crowded = crowded.withColumn("node", _node(depth)).join(counts, "node", "left").withColumn("depth", F.when(full, F.col("depth")).otherwise(F.lit(depth))).drop("node", "full")
    place = F.row_number().over(Window.partitionBy("vertex").orderBy(F.desc("crowd"), "key"))
    crowded = crowded.withColumn("depth", F.when(place > long_trees(target, threshold), F.lit(LEAST_DEPTH)).otherwise(F.col("depth")))
    lengths = F.filter(F.array(*(F.lit(d) for d in (LEAST_DEPTH, *LONGER))), lambda d: (d >= F.col("depth")) & (d <= F.col("shared")))
    listed = crowded.select("key", "vertex", "depth", F.explode(lengths).alias("length"))
    node = F.coalesce(*(F.when(F.col("length") == d, _node(d)) for d in (LEAST_DEPTH, *LONGER)))
    listed = stored(listed.select(node.alias("node"), "vertex", (F.col("length") == F.col("depth")).alias("own")), "listed")
    # a longer prefix that is nobody's own has all its vertices together under a shorter one
    wanted = listed.groupBy("node").agg(F.count("*").alias("held"), F.bool_or("own").alias("own")).filter("own AND held > 1").drop("own")
    return found.unionByName(listed.drop("own").join(wanted, "node").select("node", "vertex", "held"))


# ---------------------------------------------------------------- the join


def _classes(docs: DataFrame, threshold: float, n: int, target: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, vertex), and vertices (vertex, first_doc, copies, class_id, leader, n_links)."""
    bound_batches(docs.sparkSession)
    exact = Fraction(threshold).limit_denominator(1000)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    rows = stored(docs.select("doc_id", F.md5("text").alias("digest"), "text").mapInArrow(_sketches(n), f"doc_id {kind}, digest string, vertex binary, grams long, signature binary, compact binary"), "sketches")
    vertices = stored(
        rows.groupBy("vertex").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.min("grams").alias("grams"), F.min("signature").alias("signature"), F.min("compact").alias("compact")),
        "vertices",
    )
    met = forest(vertices.filter("grams > 0").select("vertex", "signature"), target, threshold)
    blocks = F.ceil(F.col("held") / BUCKET_BLOCK).cast("int")
    member = met.select("node", "vertex", blocks.alias("blocks"), F.pmod(F.xxhash64("vertex", "node"), blocks).alias("block"))
    member = member.join(vertices.select("vertex", "compact"), "vertex")
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    member = member.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    least = int(VALUES * threshold - SIGMAS * (VALUES * threshold * (1 - threshold)) ** 0.5)
    stars = in_groups(member, ["node", "low", "high"], lambda c, b: _similar_in_buckets(c, b, least), "u binary, v binary", ["vertex", "compact"])

    cluster = components(stars)
    loads = cluster.join(vertices.select("vertex", "grams", "first_doc", "copies"), "vertex")
    loads = stored(loads, "clusters")
    sizes = loads.groupBy("root").agg(F.ceil(F.greatest(F.sum("grams") / VERIFY_BLOCK, F.count("*") / VERIFY_ROWS)).cast("int").alias("blocks"))
    wanted = loads.join(sizes, "root").select("root", "vertex", F.col("first_doc").alias("doc_id"), "copies", "blocks")
    # the candidates grow with the corpus, so neither side of this join may be broadcast
    texts = docs.join(wanted.hint("merge"), "doc_id")

    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            values, prints = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            keep, out = [], []
            at = 0
            for i, j in by_slices(values):
                for grams in ngram_sets(values[i:j], n):
                    if fingerprint(grams) == prints[at]:  # another row with this doc_id may hold another text
                        keep.append(at)
                        out.append(grams.tobytes())
                    at += 1
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), kept.column(3), kept.column(4), pa.array(out, pa.binary())], ["vertex", "root", "copies", "blocks", "grams"])

    held = texts.select("vertex", "text", "root", "copies", "blocks").mapInArrow(sets, "vertex binary, root binary, copies long, blocks int, grams binary")
    held = held.withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    held = held.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "own": (F.col("block") == F.col("other")).cast("long")})
    linked = stored(in_groups(held, ["root", "low", "high"], lambda c, b: _verified(c, b, exact), "vertex binary, links long, u binary", ["vertex", "block", "own", "copies", "grams"]), "links")

    counts = linked.groupBy("vertex").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("vertex").alias("u"), F.col("u").alias("v")))
    first = classes.join(vertices.select("vertex", "first_doc"), "vertex").groupBy("root").agg(F.min(F.struct("first_doc", "vertex")).alias("first"))
    named = vertices.select("vertex", "first_doc", "copies").join(counts, "vertex", "left").join(classes.join(first, "root").select("vertex", "first"), "vertex", "left")
    named = named.select("vertex", "first_doc", "copies", F.coalesce("first.first_doc", "first_doc").alias("class_id"), F.coalesce("first.vertex", "vertex").alias("leader"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "digest", "vertex"), named


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, target: float = TARGET_RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id and n_links.

    Two documents are linked if the Jaccard similarity of their word n-gram sets is at least the threshold; n_links
    counts the other documents a document is linked to, its copies among them. class_id is the smallest doc_id that
    chains of links reach. Texts without words (null, empty) have the empty set and are copies of each other. Rows
    with a null doc_id are in no class (null) and have no links. Repeated rows count as copies, and texts under one
    doc_id are compared as texts of their own; other columns are ignored. An empty table gives no rows.
    """
    rows, named = _classes(docs, threshold, n, target)
    unnamed = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    # texts with very many copies are few: they are broadcast, so that no task reads all copies of one
    named = stored(named.select("vertex", "copies", "class_id", "n_links"), "named")
    hot = F.col("copies") > max(HUB_EDGES, rows.count() // HUBS)
    hubs = F.broadcast(named.filter(hot))
    copies = rows.select("doc_id", "vertex")
    met = copies.join(hubs, "vertex").unionByName(copies.join(hubs, "vertex", "left_anti").join(named.filter(~hot), "vertex"))
    return met.select("doc_id", "class_id", "n_links").unionByName(unnamed)


def first_of_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, target: float = TARGET_RECALL) -> DataFrame:
    """The rows of docs (doc_id, text, others) that stay when of each class only its first document does.

    The first has the smallest doc_id of the class and, where that id has several texts in it, one of them; of its
    repeated rows one stays. Every other text under the same doc_id is judged by its own class. Rows with a null doc_id
    are in no class and stay.
    """
    rows, named = _classes(docs, threshold, n, target)
    lead = named.filter("vertex = leader").select("vertex", F.col("first_doc").alias("doc_id"))
    lead = rows.join(lead, ["doc_id", "vertex"]).groupBy("doc_id", "vertex").agg(F.min(F.coalesce("digest", F.lit(""))).alias("__digest")).select("doc_id", "__digest")
    marked = docs.withColumn("__digest", F.coalesce(F.md5("text"), F.lit("")))
    kept = marked.join(lead, ["doc_id", "__digest"], "left_semi").dropDuplicates(["doc_id", "__digest"])
    return kept.unionByName(marked.filter(F.col("doc_id").isNull())).select(*docs.columns)
