"""Periodic runs against their definition, by tiles of any size, and the query against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemforge.llm import periods
from itemforge.llm.common import table
from itemforge.llm.queries import QUERIES
from tests.conftest import rows_of
from tests.llm.test_operators import ODD, ODD_IDS, SF, frame


def runs_by_hand(words):
    """Every maximal stretch of its smallest period, by trying all periods."""
    known = {}
    w = np.array([known.setdefault(x, len(known)) for x in words], np.int64)
    n, found = len(w), set()
    for p in range(1, n // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = e - s + p
            if length >= max(24, 3 * p) and not any((s, length) == (a, b) for a, b, _ in found):
                found.add((s, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def row_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_words(r):
    """Words of few kinds with repeated stretches, some of them inside each other."""
    words = []
    for _ in range(r.randint(1, 6)):
        unit = [r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(1, 30))]
        if r.random() < 0.3:
            unit = unit * r.randint(2, 4) + [r.choice("xyz")]
        words += unit * r.randint(1, 7) + unit[: r.randint(0, len(unit))] if r.random() < 0.7 else [str(r.random()) for _ in range(r.randint(0, 40))]
    return words


@pytest.mark.parametrize("tile_words", [16, 64, 1 << 15])
def test_runs_equal_brute_force_in_tiles_of_any_size(spark, tile_words):
    r = random.Random(tile_words)
    texts = [" ".join(periodic_words(r)) for _ in range(250)] + [" ".join(["a"] * k) for k in (23, 24, 25, 500)] + [" ".join("ab" * k) for k in (11, 12, 300)]
    found = {x.doc_id: x for x in periods.find_runs(frame(spark, texts), tile_words=tile_words).collect()}
    for i, text in enumerate(texts):
        runs = runs_by_hand(text.split(" "))
        assert [tuple(x) for x in found[i].runs] == runs, text
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert found[i].collapsed == " ".join(w for k, w in enumerate(text.split(" ")) if k not in gone)
    assert sum(bool(x.runs) for x in found.values()) > 150


def test_z_function():
    r = random.Random(2)
    for _ in range(200):
        s = [r.choice([0, 0, 1]) for _ in range(r.randint(0, 40))]
        assert periods.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_query_equals_a_plain_version(spark):
    wanted = [row_by_hand(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = QUERIES["op11_periodic_runs"](spark, SF)
    assert found.columns == columns and {t for c, t in found.dtypes if not c.endswith("sha256")} == {"bigint"}
    assert rows_of(found) == sorted(wanted, key=repr)
    assert sum(w[1] > 0 for w in wanted) > 10


def test_edge_cases(spark):
    docs = frame(spark, ODD, ODD_IDS)
    found = periods.find_runs(docs).collect()
    assert sorted(((x.doc_id, x.n_words) for x in found), key=repr) == sorted(((i, len((t or "").split())) for i, t in zip(ODD_IDS, ODD, strict=True)), key=repr)
    long = next(x for x in found if x.n_words == 30_000)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert periods.find_runs(frame(spark, [])).count() == 0
    planted = rows_of(periods.with_planted_runs(docs))
    assert [r for r in planted if r[0] is None] == [(None, " ")] and len(planted) == len(ODD)
    with pytest.raises(ValueError):
        periods.find_runs(docs, tile_words=100)


def test_ties_go_to_the_first_run(spark):
    text = " ".join(["a b c"] * 10 + ["x"] + ["d e f"] * 10 + ["y"] + ["g h"] * 14)
    row = periods.find_runs(frame(spark, [text])).select(periods.strongest(F.col("runs")).alias("r")).first()
    assert tuple(row.r) == (62, 28, 2)
    text = " ".join(["a b c"] * 10 + ["x"] + ["d e f"] * 10)
    row = periods.find_runs(frame(spark, [text])).select(periods.strongest(F.col("runs")).alias("r")).first()
    assert tuple(row.r) == (0, 30, 3)


