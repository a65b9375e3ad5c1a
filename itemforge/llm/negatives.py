"""Hard negatives by a multiway hyperplane tree that keeps, for each split point, the distance ranges of its siblings' subtrees.

Scores are integer inner products. A window of scores is an annulus of distances around the anchor, whose radii follow from the
norms in a subtree; a subtree goes as soon as its range of distances from any split point of its node misses the annulus.
What is left is compared exactly, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, stored

#: Rows that the tree is fitted on, and whose scores bound what an anchor still looks for. Every row is indexed.
SAMPLE = 4096
ARITY, LEAF_SAMPLE, DEPTH = 8, 48, 4
#: Rows of a block of the index, anchors of a block, and blocks of a leaf that meet an anchor's block under one key.
BLOCK, ANCHORS, BLOCKS_A_KEY = 2048, 256, 8
#: Sums up to this are exact in doubles.
EXACT = 2.0**53
#: Bounds of a window that is open; no score is as far out.
NONE, ALL = -(2**63), 2**63 - 1

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass
class Tree:
    """points: split points by node; children: by node, another node's number or -1 - leaf; paths: (node, child) down to each leaf."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)  # by node: smallest distance from split point i to the rows of child j
    high: list[np.ndarray] = field(default_factory=list)
    norms: list[np.ndarray] = field(default_factory=list)  # by node and child: least and greatest square of a row's norm

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest split point at every node (the first of equally near ones)."""
        found = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            nearest = _distances(x[rows], self.points[node]).argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                part = rows[nearest == j]
                if child < 0:
                    found[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return found

    def spans(self, leaf: int, x: np.ndarray) -> tuple[list[float], list[float]]:
        """Least and greatest distance of rows of a leaf from every split point on their way, then of the squared norms."""
        square = (x * x).sum(axis=1)
        columns = [_distances(x, self.points[node]) for node, _ in self.paths[leaf]] + [square[:, None]]
        every = np.concatenate(columns, axis=1)
        return every.min(axis=0).tolist(), every.max(axis=0).tolist()

    def learn_ranges(self, spans: dict[int, tuple[list[float], list[float]]]) -> None:
        """Ranges of all subtrees from those of the leaves. What holds no row has an empty range."""
        for points in self.points:
            m = len(points)
            self.low.append(np.full((m, m), np.inf))
            self.high.append(np.full((m, m), -np.inf))
            self.norms.append(np.stack([np.full(m, np.inf), np.full(m, -np.inf)]))
        for leaf, (low, high) in spans.items():
            at = 0
            for node, j in self.paths[leaf]:
                m = len(self.points[node])
                self.low[node][:, j] = np.minimum(self.low[node][:, j], low[at : at + m])
                self.high[node][:, j] = np.maximum(self.high[node][:, j], high[at : at + m])
                self.norms[node][0, j] = min(self.norms[node][0, j], low[-1])
                self.norms[node][1, j] = max(self.norms[node][1, j], high[-1])
                at += m

    def search(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that it may answer): rows x of scores q.x from least to most."""
        if not self.points:
            yield 0, np.arange(len(q))
            return
        square, least, most = (q * q).sum(axis=1), least.astype(np.float64), most.astype(np.float64)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            d = _distances(q[rows], self.points[node])[:, :, None]
            slack = 1e-6 * (1 + np.sqrt(square[rows]) + np.sqrt(np.maximum(self.norms[node][1].max(), 0)))[:, None, None]
            outer = np.sqrt(np.maximum(square[rows][:, None] + self.norms[node][1] - 2 * least[rows][:, None], 0))[:, None, :]
            inner = np.sqrt(np.maximum(square[rows][:, None] + self.norms[node][0] - 2 * most[rows][:, None], 0))[:, None, :]
            inner = np.where(np.isfinite(inner), inner, 0)
            near = self.low[node][None] <= d + outer + slack
            far = self.high[node][None] >= np.maximum(d - outer, inner - d) - slack
            alive = (near & far).all(axis=1) & np.isfinite(self.norms[node][0])
            for j, child in enumerate(self.children[node]):
                part = rows[alive[:, j]]
                if len(part):
                    if child < 0:
                        yield -1 - child, part
                    else:
                        todo.append((child, part))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def fit_tree(x: np.ndarray, arity: int = ARITY, leaf_rows: int = LEAF_SAMPLE, depth: int = DEPTH) -> Tree:
    """Split points are rows far from each other: each next one is the farthest from those chosen."""
    tree = Tree()

    def grow(rows: np.ndarray, path: list[tuple[int, int]]) -> int:
        chosen: list[int] = []
        if len(rows) > leaf_rows and len(path) < depth:
            away = _distances(x[rows], x[rows].mean(axis=0, keepdims=True))[:, 0]
            while len(chosen) < arity and away.max() > 0:
                chosen.append(int(rows[away.argmax()]))
                away = np.minimum(away, _distances(x[rows], x[chosen[-1:]])[:, 0]) if len(chosen) > 1 else _distances(x[rows], x[chosen])[:, 0]
        if len(chosen) < 2:
            tree.paths.append(path)
            return -len(tree.paths)
        node = len(tree.points)
        tree.points.append(x[chosen])
        tree.children.append([])
        nearest = _distances(x[rows], x[chosen]).argmin(axis=1)
        tree.children[node] = [grow(rows[nearest == j], [*path, (node, j)]) for j in range(len(chosen))]
        return node

    grow(np.arange(len(x)), [])
    return tree


def _top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[place < k]


def _kth(score: np.ndarray, k: int, otherwise: np.ndarray) -> np.ndarray:
    """The k-th highest score of each row, or the given bound where fewer are above NONE."""
    if score.shape[1] < k:
        return otherwise
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return np.where(kth > NONE, kth, otherwise)


@dataclass
class Sample:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products, by way of doubles where these are exact."""
    return (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _indexed(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """number (of its own for each row), id, label, is_anchor, leaf, vector as padded doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            x = _padded(batch.column(3), width)
            leaves = tree.leaves_of(x)
            numbers = pa.array(np.arange(number, number + len(x)))
            number += len(x)
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns[:3], pa.array(leaves.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["number", "id", "label", "is_anchor", "leaf", "vector"])

    return rows.mapInArrow(run, "number bigint, id bigint, label int, is_anchor boolean, leaf int, vector binary")


def _padded(column: pa.Array, width: int) -> np.ndarray:
    x = np.zeros((len(column), width))
    sizes = np.array([len(v) for v in column])
    if len(column):
        x[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(s) for s in sizes])] = column.flatten().to_numpy(zero_copy_only=False)
    return x


def _by_leaf(leaf: Column, values: dict[int, int]) -> Column:
    """A number for each leaf; there are few leaves."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), leaf) if values else F.lit(0)


def _blocks(rows: DataFrame, group: Column, count: Column, tree: Tree | None, width: int) -> DataFrame:
    """The rows of a group in `count` blocks: group, block, ids, labels, vectors as bytes, with a tree also their spans of distances."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(-1, width)
        spans = tree.spans(part.column("leaf")[0].as_py(), x) if tree else ([], [])
        values = [key[0].as_py(), key[1].as_py(), *_bytes(ids.astype(np.int64), labels.astype(np.int32), x), *spans]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

    keyed = rows.withColumn("group", group).withColumn("block", F.pmod(F.xxhash64("number"), count).cast("int"))
    return keyed.groupBy("group", "block").applyInArrow(run, "group int, block int, ids binary, labels binary, vectors binary, low array<double>, high array<double>")


BLOCK_SCHEMA = pa.schema([("group", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


@dataclass
class Windows:
    """What is looked for, one entry a query: the anchor's place in its block, its partner so far, and the scores wanted."""

    place: np.ndarray
    rank: np.ndarray
    partner: np.ndarray
    partner_score: np.ndarray
    least: np.ndarray
    most: np.ndarray


@dataclass
class Searcher:
    """What tasks need for a pass over the index: wanted are the first k of each window, of the anchor's label (same) or of all others."""

    tree: Tree
    sample: Sample
    groups: dict[int, int]
    width: int
    exact: bool
    same: bool
    k: int

    def wanted(self, labels: np.ndarray, ids: np.ndarray, other_labels: np.ndarray, other_ids: np.ndarray) -> np.ndarray:
        equal = labels[:, None] == other_labels
        return (equal if self.same else ~equal) & (ids[:, None] != other_ids)

    def raised(self, w: Windows, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The least score that can still matter: the sample alone has k rows that are as good."""
        score = _products(vectors, self.sample.vectors, self.exact)[w.place]
        fits = self.wanted(labels, ids, self.sample.labels, self.sample.ids)[w.place] & (score >= w.least[:, None]) & (score <= w.most[:, None])
        return _kth(np.where(fits, score, NONE), self.k, w.least)

    def dealt(self, block: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, w: Windows) -> Iterator[tuple]:
        """A row for each leaf (and part of its blocks) that the tree leaves to some of the windows."""
        least = self.raised(w, ids, labels, vectors)
        for leaf, queries in self.tree.search(vectors[w.place], least, w.most):
            places, place = np.unique(w.place[queries], return_inverse=True)
            held = _bytes(ids[places], labels[places], vectors[places], places.astype(np.int32), place.astype(np.int32), w.rank[queries], w.partner[queries], w.partner_score[queries], least[queries], w.most[queries])
            for part in range(self.groups.get(leaf, 0)):
                yield (leaf, part, block, *held)

    def compared(self, r: dict) -> tuple[np.ndarray, ...]:
        """The first k of each window among the rows of a block."""
        ids, labels = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_labels"], np.int32)
        vectors = np.frombuffer(r["a_vectors"], np.float64).reshape(-1, self.width)
        places, place = np.frombuffer(r["places"], np.int32), np.frombuffer(r["place"], np.int32)
        rank, partner, partner_score = np.frombuffer(r["ranks"], np.int32), np.frombuffer(r["partners"], np.int64), np.frombuffer(r["partner_scores"], np.int64)
        least, most = np.frombuffer(r["least"], np.int64), np.frombuffer(r["most"], np.int64)
        other_ids, other_labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int32)
        score = _products(vectors, np.frombuffer(r["vectors"], np.float64).reshape(-1, self.width), self.exact)
        fits = self.wanted(labels, ids, other_labels, other_ids)
        q, row = np.nonzero(fits[place] & (score[place] >= least[:, None]) & (score[place] <= most[:, None]))
        found = score[place[q], row]
        top = _top(q, found, other_ids[row], self.k)
        q, row, found = q[top], row[top], found[top]
        anchor = (np.int64(r["a_block"]) << np.int64(20)) + places[place[q]]
        return anchor, ids[place[q]], rank[q], partner[q], partner_score[q], other_ids[row], found


DEALT = "leaf int, part int, a_block bigint, a_ids binary, a_labels binary, a_vectors binary, places binary, place binary, ranks binary, partners binary, partner_scores binary, least binary, most binary"
FOUND = "anchor bigint, anchor_id bigint, window int, partner bigint, partner_score bigint, found_id bigint, score bigint"


def _pass(anchors: DataFrame, index: DataFrame, searcher: Searcher) -> DataFrame:
    """The first k rows of every window: FOUND and their rank. anchors: blocks with windows (place, rank, partner, score), null for one open window each."""
    names = [c.split()[0] for c in DEALT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 10]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, vectors = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int32), np.frombuffer(r["vectors"], np.float64).reshape(-1, searcher.width)
                w = _open_windows(len(ids)) if r["windows"] is None else _negative_windows(r["windows"])
                for row in searcher.dealt(r["a_block"], ids, labels, vectors, w):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(searcher.compared(r), [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)], names=found_names)

    found_names = [c.split()[0] for c in FOUND.split(", ")]
    dealt = anchors.select("a_block", "ids", "labels", "vectors", "windows").mapInArrow(deal, DEALT)
    blocks = index.select(F.col("group").alias("leaf"), F.floor(F.col("block") / BLOCKS_A_KEY).cast("int").alias("part"), "ids", "labels", "vectors")
    found = dealt.hint("shuffle_merge").join(blocks, ["leaf", "part"]).drop("leaf", "part").mapInArrow(compare, FOUND)
    first = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= searcher.k)


def _open_windows(n: int) -> Windows:
    zero = np.zeros(n, np.int64)
    return Windows(np.arange(n), zero.astype(np.int32), zero, zero, np.full(n, NONE), np.full(n, ALL))


def _negative_windows(rows: list[dict]) -> Windows:
    """Of each positive score s the integers from 30 to 90 hundredths of it, none if s < 0."""
    place, rank, partner, score = (np.array([r[c] for r in rows], np.int64) for c in ("place", "rank", "partner", "score"))
    tens, ones = score // 10, score % 10  # no product leaves the range of longs
    least, most = 3 * tens - (-3 * ones // 10), 9 * tens + 9 * ones // 10
    some = least <= most
    return Windows(place[some], rank[some].astype(np.int32), partner[some], score[some], least[some], most[some])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """RESULT: for each anchor and each of its first positives, the first rows of other labels with 30 to 90 hundredths of the positive's score.

    rows: id (bigint), label (int), vector (array of whole numbers as doubles), none of them null; is_anchor says which are
    anchors. Higher scores come first, ties by smaller id. A row with the anchor's id is no partner of it; rows that repeat an id
    take part each, so repeated anchors give repeated results. Vectors shorter than the longest count as ending in zeros. Inner
    products that a long cannot hold are an error. An empty table, or one without anchors, gives no rows.

    The tree is fitted on at most SAMPLE rows; every row is indexed, and the search is exact.
    """
    bound_batches(rows.sparkSession)
    rows = stored(rows.select("id", "label", is_anchor.alias("is_anchor"), "vector"), "vectors")
    size = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    width, largest = max(size[0] or 0, 1), size[1] or 0.0
    if width * largest * largest >= 2.0**63:
        raise ValueError("inner products do not fit into a long")
    exact = width * largest * largest <= EXACT
    picked = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("vector")).limit(SAMPLE).select("id", "label", "vector").collect()
    vectors = _padded(pa.array([r.vector for r in picked], pa.list_(pa.float64())), width)
    sample = Sample(np.array([r.id for r in picked], np.int64), np.array([r.label for r in picked], np.int32), vectors)
    tree = fit_tree(sample.vectors)

    keyed = stored(_indexed(rows, tree, width), "keyed")
    counts = keyed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).collect()  # few leaves
    blocks = {r.leaf: -(-r.n // BLOCK) for r in counts}
    leaf = F.col("leaf")
    index = stored(_blocks(keyed, leaf, _by_leaf(leaf, blocks), tree, width), "index")
    spans: dict[int, tuple[list, list]] = {}
    ranges = index.select("group", F.posexplode(F.arrays_zip("low", "high"))).groupBy("group", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    for r in ranges.orderBy("group", "pos").collect():
        low, high = spans.setdefault(r.group, ([], []))
        low.append(r.low)
        high.append(r.high)
    tree.learn_ranges(spans)

    # anchors of one branch of the root share their blocks, so that a block meets few subtrees and is not too small
    branch = {r.leaf: tree.paths[r.leaf][0][1] if tree.paths[r.leaf] else 0 for r in counts}
    held = {b: -(-sum(r.anchors for r in counts if branch[r.leaf] == b) // ANCHORS) for b in branch.values()}
    anchors = _blocks(keyed.filter("is_anchor"), _by_leaf(leaf, branch), _by_leaf(leaf, {x: max(1, held[b]) for x, b in branch.items()}), None, width)
    anchors = stored(anchors.withColumn("a_block", F.shiftleft(F.col("group").cast("bigint"), 32) + F.col("block")), "anchors")
    groups = {x: -(-n // BLOCKS_A_KEY) for x, n in blocks.items()}

    windows = "array<struct<place: bigint, rank: int, partner: bigint, score: bigint>>"
    first = _pass(anchors.withColumn("windows", F.lit(None).cast(windows)), index, Searcher(tree, sample, groups, width, exact, True, positives))
    partners = F.struct((F.col("anchor") % (1 << 20)).alias("place"), "rank", F.col("found_id").alias("partner"), "score")
    wanted = first.groupBy(F.shiftright("anchor", 20).alias("a_block")).agg(F.collect_list(partners).alias("windows"))
    last = _pass(anchors.join(wanted, "a_block"), index, Searcher(tree, sample, groups, width, exact, False, negatives))
    return last.select("anchor_id", F.col("partner").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("partner_score").alias("positive_score"), F.col("score").alias("negative_score"))


def whole_vectors(table: DataFrame, id_column: str, label_column: str, vector_column: str, scale: float) -> DataFrame:
    """id, label, vector for mine(): components times the scale, rounded down. Rows with a null id, label, vector or component, or with one that is not finite, go."""
    scaled = F.transform(F.col(vector_column), lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is greater than infinity
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("int").alias("label"), scaled.alias("v"), finite.alias("finite"))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return rows.filter("id IS NOT NULL AND label IS NOT NULL AND finite").select("id", "label", whole.alias("vector"))
