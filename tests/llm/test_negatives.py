"""Hard negatives against brute force, the tree's ranges, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemforge.llm import negatives
from tests.conftest import rows_of


def mined_by_hand(rows, is_anchor, k=5, m=10):
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, [int(x) for x in v] + [0] * (width - len(v))) for i, label, v in rows]
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:k]:
            near = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:m]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(near)]
    return sorted(out, key=repr)


def vectors_of(seed, n, width=6, clusters=5, spread=40):
    r = np.random.default_rng(seed)
    centres = r.integers(-250, 250, (clusters, width))
    return [(i, int(r.integers(0, 4)), (centres[r.integers(0, clusters)] + r.integers(-spread, spread + 1, width)).astype(float).tolist()) for i in range(n)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label int, vector array<double>")


@pytest.mark.parametrize(("seed", "block", "anchors", "sample"), [(1, 2048, 256, 4096), (2, 16, 4, 120), (3, 7, 2, 8), (4, 50, 3, 60)])
def test_results_equal_brute_force(spark, monkeypatch, seed, block, anchors, sample):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("SAMPLE", sample), ("LEAF_SAMPLE", 8), ("BLOCKS_A_KEY", 2)):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives.fit_tree, "__defaults__", (3, 8, 4))
    rows = vectors_of(seed, 400, spread=5 * seed)
    # ties, exact copies, a repeated row, a repeated id, short and empty vectors
    rows += [(1000 + i, 1, rows[0][2]) for i in range(30)] + [rows[20]] + [(30, 2, rows[9][2])] + [(2000, 1, rows[3][2][:3]), (2001, 3, [])]
    found = negatives.mine(table_of(spark, rows), F.col("id") % 10 == 0)
    assert rows_of(found) == mined_by_hand(rows, lambda i: i % 10 == 0)
    assert found.count() > 100


def test_large_components_stay_whole_numbers(spark):
    r = random.Random(5)
    rows = [(i, i % 2, [float(r.randint(2**29, 2**30)) for _ in range(3)]) for i in range(60)]
    found = negatives.mine(table_of(spark, rows), F.col("id") % 10 == 0)
    assert rows_of(found) == mined_by_hand(rows, lambda i: i % 10 == 0)
    with pytest.raises(ValueError):
        negatives.mine(table_of(spark, [(0, 1, [2.0**40])]), F.lit(True))


def test_rows_that_take_no_part(spark):
    odd = [(100, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (None, 2, [0.5, 0.5]), (8, 2, [-0.001, 0.7])]
    table = spark.createDataFrame([(*r, "x", 1) for r in odd], "vec_id bigint, label int, embedding array<float>, vector string, leaf int")
    rows = negatives.whole_vectors(table, "vec_id", "label", "embedding", 256.0)
    assert rows_of(rows) == sorted([(1, 1, [256.0, 64.0]), (100, 1, [256.0, 128.0]), (2, 2, [128.0, 128.0]), (8, 2, [-1.0, 179.0])], key=repr)
    found = negatives.mine(rows, F.col("id") % 100 == 0)
    assert rows_of(found) == [(100, 1, 1, 2, 256 * 256 + 128 * 64, 128 * 256 + 128 * 128), (100, 1, 2, 8, 256 * 256 + 128 * 64, -256 + 128 * 179)][: len(rows_of(found))]
    assert negatives.mine(rows.limit(0), F.lit(True)).count() == 0 and negatives.mine(rows, F.lit(False)).count() == 0


def test_searches_lose_no_row_and_skip_subtrees():
    """Every row within a window is in a leaf that the search names; windows around near rows skip most leaves."""
    x = np.array([v for _, _, v in vectors_of(6, 3000, width=8, clusters=30, spread=12)])
    tree = negatives.fit_tree(x[:600], 5, 20, 4)
    leaves = tree.leaves_of(x)
    tree.learn_ranges({leaf: tree.spans(leaf, x[leaves == leaf]) for leaf in np.unique(leaves).tolist()})
    q = x[:50]
    score = (q @ x.T).astype(np.int64)
    for least, most in ((np.sort(score, axis=1)[:, -5], np.full(50, negatives.ALL)), (np.sort(score, axis=1)[:, 900], np.sort(score, axis=1)[:, 960])):
        named = np.zeros((50, len(tree.paths)), bool)
        for leaf, queries in tree.search(q, least, most):
            named[queries, leaf] = True
        row, column = np.nonzero((score >= least[:, None]) & (score <= most[:, None]))
        assert named[row, leaves[column]].all()
        assert named.mean() < 0.7
