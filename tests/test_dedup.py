"""Near duplicates against all pairs of token sets."""

import random

from itemforge.operators import dedup
from tests.conftest import rows_of


def similar_by_hand(left, right, threshold, ratio):
    out = {}
    for i, s, t in left:
        for j, u, v in right:
            if s == u and t != v and len(set(t.split()) & set(v.split())) / len(set(t.split()) | set(v.split())) >= threshold and min(len(t), len(v)) >= ratio * max(len(t), len(v)):
                out[i, j] = len(set(t.split()) & set(v.split())) / len(set(t.split()) | set(v.split()))
    return out


def texts_of(seed, n):
    """Texts in families, whose members differ in a few words, with words that most texts hold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    while len(rows) < n:
        base = [r.choice(words[:12]) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(4, 60))]
        for _ in range(r.randint(1, 5)):
            own = [r.choice(words) if r.random() < 0.04 else w for w in base][: len(base) - r.randint(0, 2)]
            rows.append((len(rows), r.choice("ab"), " ".join(own)))
    return rows[:n]


def test_similar_pairs_equal_all_pairs(spark, monkeypatch):
    rows = texts_of(1, 260)
    table = spark.createDataFrame(rows, "id long, subject string, text string")
    for threshold, frequent in ((0.94, 1000), (0.8, 5), (0.5, 40)):
        monkeypatch.setattr(dedup, "FREQUENT", frequent)
        first = {}
        for i, s, t in rows:
            first.setdefault((s, t), i)
        wanted = {(i, j): x for (i, j), x in similar_by_hand(rows, rows, threshold, 0.7).items() if i < j and first[rows[i][1:]] == i and first[rows[j][1:]] == j}
        found = dedup.similar_pairs(table, threshold, least=1, ratio=0.7)
        assert rows_of(found) == sorted(((i, j, round(x, 9)) for (i, j), x in wanted.items()), key=repr) and len(wanted) > 10


def test_near_matches_of_two_tables_equal_all_pairs(spark):
    rows, bank = texts_of(2, 150), texts_of(2, 250)[100:]
    tables = [spark.createDataFrame(x, "id long, subject string, text string") for x in (rows, bank)]
    for threshold in (0.9, 0.6):
        pairs = similar_by_hand(rows, bank, threshold, 0.7) | {(i, j): 1.0 for i, s, t in rows for j, u, v in bank if (s, t) == (u, v)}
        wanted = {i: min(j for k, j in pairs if k == i) for i, _ in pairs}
        assert rows_of(dedup.match_near(*tables, threshold, least=1, ratio=0.7)) == sorted(wanted.items(), key=repr) and len(wanted) > 30
