"""Brute force, round trips, held-out accuracy and edge cases of the training-data operators."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemforge.llm import common, decontaminate, jaccard, language, line_dedup, media, pieces, quality, secrets, toxicity, wrappers
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, drops string, score double, class_id int"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", 0, "x", "y", 1.0, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["", None, "x" * 200_000, "same line here\n" * 3, "same line here\n" * 3, "\n\n", " ", "word " * 30_000, "é▁\x00😀\t"]
ODD_IDS = [0, 1, 2, 3, 3, 4, None, 5, 6]


# ---------------------------------------------------------------- secrets


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (("t", b"aki"), ("t", b"kia")))
    query = secrets.trigram_query("(api_?key|token)x")
    index = secrets.TrigramIndex([b"an apikeyx", b"API_KEYX", b"tokenx", b"toke nx", b""], np.ones(1 << 24, bool))
    assert index.find(query).tolist() == [0, 1, 2]


def test_every_match_satisfies_its_query():
    r = random.Random(1)
    scanner = secrets.Scanner()
    parts = ["password=", "Api_Key: '", "AKIA", "token:", "secret = \"", "abcdef0123456789", "ABCDEFGHIJ0123456789", " ", "é", "a.b", "----- ", "eyJhb", ".eyJ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(800)]
    for text, spans in zip(texts, scanner.scan(texts), strict=True):
        wanted = sorted((m.start(), k, m.end()) for k, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.min_chars)
        assert spans == wanted


def test_secret_scan_edge_cases(spark):
    found = secrets.scan_secrets(frame(spark, ODD, ODD_IDS)).collect()
    assert len(found) == len(ODD) and {r.n_assign for r in found} == {0}
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- classifiers


def test_quality_held_out(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    scored = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.85


def test_quality_covers_the_whole_document():
    net = quality.Network.start(1)
    texts = [b"a" * 5000 + b"Z!" * 40, b"a" * 5080, b"", b"short", b"q" * 300_000]
    together = quality.scores(net, texts)
    assert np.allclose(together, [quality.scores(net, [t])[0] for t in texts], atol=1e-5)
    assert together[0] != together[1]


def plain_quality(net, text):
    """The network by its definition: every filter at every step, the maximum in every chunk, the mean of the chunks."""
    half, step, wide = quality.HALF, quality.STEP, 2 * quality.STEP
    size = -(-(len(text) + step) // half) * half
    vectors = [net.embedding[b].astype(np.float64) for b in text.ljust(size, b"\0")] + [np.zeros(quality.EMBEDDING)] * step
    maxima = []
    for h in range(0, size, half):
        values = [[sum(float(vectors[at + j] @ net.filters[j * quality.EMBEDDING : (j + 1) * quality.EMBEDDING, f]) for j in range(wide)) for f in range(quality.FILTERS)] for at in range(h, h + half, step)]
        maxima.append([max(0.0, max(v[f] for v in values) + float(net.filter_bias[f])) for f in range(quality.FILTERS)])
    chunks = [[max(x) for x in zip(a, b, strict=True)] for a, b in zip(maxima, maxima[1:])] or maxima
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)]
    return 1 / (1 + np.exp(-(sum(m * float(w) for m, w in zip(mean, net.weights, strict=True)) + float(net.bias[0]))))


def test_quality_equals_a_plain_convolution():
    r = np.random.default_rng(2)
    net = quality.Network.start(5)
    net.filter_bias[:] = r.normal(0, 0.1, quality.FILTERS)
    texts = [b"", b"abc", r.integers(1, 256, 508, dtype=np.uint8).tobytes(), r.integers(1, 256, 509, dtype=np.uint8).tobytes(), r.integers(1, 256, 1700, dtype=np.uint8).tobytes()]
    assert np.allclose(quality.scores(net, texts), [plain_quality(net, t) for t in texts], atol=1e-5)


def test_quality_gradient_lowers_the_loss():
    texts, labels = [b"good words here " * 20, b"BAD!! BAD!! " * 25] * 40, np.array([1.0, 0.0] * 40)
    assert np.all((quality.scores(quality.fit(texts, labels), texts) > 0.5) == (labels == 1))


def test_toxicity_held_out(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.95


def brute_segments(scores):
    """Maximal segments by their definition: every proper subsegment scores less, and no supersegment has the property."""
    n = len(scores)
    total = lambda a, b: sum(scores[a:b])
    good = {(a, b) for a in range(n) for b in range(a + 1, n + 1) if total(a, b) > 1e-12 and all(total(c, d) < total(a, b) - 1e-12 for c in range(a, b) for d in range(c + 1, b + 1) if (c, d) != (a, b))}
    return sorted(s for s in good if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in good))


def test_segments_equal_their_definition():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 14)
        hits = sorted(r.sample(range(n), r.randint(0, min(5, n))))
        found = [(i, r.choice([0.11, 0.37, 0.9, 2.3])) for i in hits]
        scores = [toxicity.GAP] * n
        for i, s in found:
            scores[i] = s
        assert sorted((a, b) for a, b, _ in toxicity.segments(found)) == brute_segments(scores)


def test_segments_with_negative_scores_equal_their_definition_in_linear_time():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 14)
        found = [(i, r.choice([-1.3, -0.41, 0.37, 0.9, 2.3])) for i in sorted(r.sample(range(n), r.randint(0, n)))]
        scores = [toxicity.GAP] * n
        for i, s in found:
            scores[i] = s
        assert sorted((a, b) for a, b, _ in toxicity.segments(found)) == brute_segments(scores)
    start = time.perf_counter()
    apart = int(1.8 / -toxicity.GAP) + 1  # a gap costs more than what stands on either side
    assert len(toxicity.segments([(apart * i, 0.9) for i in range(100_000)])) == 100_000
    assert time.perf_counter() - start < 1


def test_toxicity_model_equals_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) + (" awful vile" if i % 4 == 0 else "") for i in range(240)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    kept = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5]
    terms = {i: {f"w{t}" for t in texts[i].split()} | {f"s{t[:5]}" for t in texts[i].split() if len(t) > 5} for i in kept}
    n = [sum(len(terms[i]) for i in kept if (i % 4 == 0) == y) for y in (False, True)]
    held = lambda w, y: sum(f"w{w}" in terms[i] for i in kept if (i % 4 == 0) == y)
    wanted = {w: toxicity.log_odds(held(w, True), held(w, False), n[1], n[0]) for w in {*words, "awful", "vile"}}
    wanted = {w: s for w, s in wanted.items() if s < 0 or s > 0 and held(w, True) >= 4}
    assert model.words.keys() == wanted.keys() and all(abs(model.words[w] - s) < 1e-9 for w, s in wanted.items())
    token = lambda w: wanted.get(w, 0.0) + toxicity.GAP
    clean = [[token(w) for w in texts[i].split()] for i in kept if i % 4]
    histogram, tail = {}, []
    for scores in clean:
        for s in scores:
            histogram[round(s, 2)] = histogram.get(round(s, 2), 0) + 1
        tail += [round(sum(scores[a:b]), 2) for a, b in brute_segments_fast(scores) if sum(scores[a:b]) >= toxicity.TAIL]
    assert np.allclose((model.rate, model.k), toxicity.fit_tail(histogram, tail))
    for r_ in toxicity.score_toxicity(docs, model).collect()[:60]:
        scores = [token(w) for w in texts[r_.doc_id].split()]
        base = np.log(model.k * len(scores) + 1)
        passages = [(a, b, model.rate * sum(scores[a:b]) - base) for a, b in brute_segments_fast(scores)]
        big = [p for p in passages if p[2] >= -np.log(toxicity.EXPECTED)]
        x = sum(p[2] for p in big) if big else min(max((p[2] for p in passages), default=-base - 3), -np.log(toxicity.EXPECTED))
        assert abs(r_.score - 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))) < 1e-6
        assert sorted(zip(r_.passage_starts, r_.passage_ends)) == sorted((a, b) for a, b, _ in big)


def brute_segments_fast(scores):
    """Maximal segments by the textbook recursion: the best segment, then the parts before and behind it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = best[2:]
    return [*brute_segments_fast(scores[:a]), (a, b), *((a2 + b, b2 + b) for a2, b2 in brute_segments_fast(scores[b:]))]


def test_classifiers_take_odd_rows_and_missing_labels(spark):
    docs = frame(spark, ODD, ODD_IDS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (quality.score_quality(docs, quality.train(docs, labels)), toxicity.score_toxicity(docs, toxicity.train(docs, labels))):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score_quality(frame(spark, []), quality.Network.start(0)).count() == 0


# ---------------------------------------------------------------- line dedup


def dedup_by_hand(rows):
    keys = {}
    norm = lambda line: line.strip(line_dedup.SPACES).translate(line_dedup._FOLD)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(norm(line)) >= 10:
                keys[norm(line)] = min(keys.get(norm(line), i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if i is None or keys.get(norm(line), i) == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_line_dedup_equals_brute_force(spark, batches):
    r = random.Random(batches)
    lines = ["a common line", "A COMMON LINE\t", "short", "", "another common line", *(f"a rare line {i}" for i in range(30))]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(3, "a common line"), (None, "a common line"), (99, None)]
    found = line_dedup.dedup_lines(frame(spark, [t for _, t in rows], [i for i, _ in rows]), batches)
    assert rows_of(found, "doc_id", "kept_text", "n_lines", "n_dropped") == dedup_by_hand(rows)


def test_line_dedup_edge_cases(spark):
    found = line_dedup.dedup_lines(frame(spark, ODD, ODD_IDS))
    assert rows_of(found, "doc_id", "kept_text", "n_lines", "n_dropped") == dedup_by_hand(list(zip(ODD_IDS, ODD, strict=True)))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_takes_ids_of_any_type(spark):
    texts = ["a shared line here\nfirst", "a shared line here\nsecond", "other", "a shared line here"]
    docs = frame(spark, texts, [3, 20, 100, None])
    days = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int"))
    for ids, loser in ((F.col("doc_id").cast("string"), "3"), (days, "2020-01-21")):  # "20" is before "3"
        rows = line_dedup.dedup_lines(docs.withColumn("doc_id", ids)).collect()
        assert len(rows) == 4 and {str(r.doc_id): r.n_dropped for r in rows if r.n_dropped} == {loser: 1}


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(bytes([j]), i) for j in range(i, i + 3)], "line_hash binary, owner long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert rows_of(runs.owners()) == [(bytes([j]), max(0, j - 2)) for j in range(6)]
    runs.close()


# ---------------------------------------------------------------- decontamination


def test_blocks_and_spans_equal_one_pass(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(0, 40, 5)] + [(90, "tiny item"), (91, ""), (92, None)], "item_id long, text string")
    docs = frame(spark, [" ".join(f"W{j}" for j in range(3, 30)), "a TINY, item here", "w1 w2 w3", "", None])
    one = rows_of(decontaminate.find_hits(docs, items).selectExpr("doc_id", "n_words", "array_size(flatten(transform(arrays_zip(starts, ends), s -> sequence(s.starts, s.ends - 1)))) AS hit", "array_sort(items) AS items"))
    many = rows_of(decontaminate.find_hits(docs, items, block_windows=13).selectExpr("doc_id", "n_words", "array_size(starts) AS hit", "items"))
    assert one == many and one[1][2:] == (2, ["90"])
    assert decontaminate.remove_spans("Ab, c-d é f!", [1, 3], [3, 4]) == "Ab,   f!"


def test_blocks_keep_repeated_and_null_rows_apart(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(0, 40, 5)], "item_id long, text string")
    hit, other = " ".join(f"w{j}" for j in range(3, 30)), " ".join(f"w{j}" for j in range(26, 52)) + " and more"
    docs = frame(spark, [hit, hit, other, "clean", hit, None, other], [1, 1, 1, None, None, None, 7])
    one, many = (rows_of(decontaminate.find_hits(docs, items, block_windows=n)) for n in (2_000_000, 13))
    assert one == many and len(many) == 7


def hits_by_hand(text, items, window=10):
    words, hit, found = decontaminate.words_of(text), set(), set()
    for item, other in items:
        own = decontaminate.words_of(other)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("limit", [10**6, 40, 7])
def test_hits_equal_brute_force_in_any_number_of_blocks(spark, limit):
    r = random.Random(8)
    words = [f"Ж{i}" if i % 5 == 0 else f"w{i}" for i in range(7)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 8, 12]))) for i in range(12)] + [(13, None), (None, "w1 w2"), (1, "w1, W2! w3")]
    rows = [(r.choice([1, 2, None]), r.choice([text(30), text(3), None, "", "a b c"])) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "items", 3) for i, t in rows], "doc_id long, text string, starts string, items int")
    found = decontaminate.find_hits(docs, spark.createDataFrame(items, "item_id long, text string"), window=4, block_windows=limit)
    known = [(i, t) for i, t in items if i is not None]
    wanted = sorted(((i, *hits_by_hand(t, known, 4)) for i, t in rows), key=repr)
    assert sorted(((f.doc_id, f.n_words, f.starts, f.items) for f in found.collect()), key=repr) == wanted
    clean = decontaminate.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id", "text") == sorted(((i, t) for i, t in rows if not hits_by_hand(t, known, 4)[2]), key=repr)


def test_decontamination_edge_cases(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(frame(spark, ODD, ODD_IDS), empty).collect()
    assert len(found) == len(ODD) and not any(r.contaminated for r in found)
    assert {r.items_sha256 for r in found} == {hashlib.sha256(b"").hexdigest()}


# ---------------------------------------------------------------- Jaccard join


def test_trees_meet_the_target():
    needed = jaccard.trees_needed()
    assert jaccard.recall(needed, jaccard.LEAST_DEPTH) >= jaccard.TARGET_RECALL > jaccard.recall(needed - 1, jaccard.LEAST_DEPTH)
    assert needed < jaccard.VALUES // jaccard.LEAST_DEPTH


def pairs_near_the_threshold(seed, count):
    """Texts in pairs whose similarity is just at or just below the threshold."""
    r, rows = random.Random(seed), []
    for _ in range(count):
        words = [f"w{r.randrange(10**7)}" for _ in range(104)]  # 100 n-grams
        other = list(words)
        other[50 : 50 + r.choice([6, 7, 8])] = [f"v{r.randrange(10**7)}" for _ in range(r.choice([6, 7, 8]))]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    return rows


def test_recall_at_the_threshold_and_inside_crowds(spark, monkeypatch):
    """Linked pairs at 0.80 to 0.85, alone and in a crowd that shares a long passage, are all found."""
    monkeypatch.setattr(jaccard, "CROWD", 6)
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = pairs_near_the_threshold(7, 150)
    rows += [(len(rows) + i, f"{passage} {t}") for i, (_, t) in enumerate(pairs_near_the_threshold(8, 60))]
    r.shuffle(rows)
    found = jaccard.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    wanted = links_by_hand(rows)
    assert rows_of(found) == wanted and sum(links for *_, links in wanted) > 150


def test_crowds_keep_longer_prefixes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 3)
    a, b = jaccard._hash_functions(jaccard.VALUES)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:50], r.integers(0, 2**63, 30, dtype=np.uint64)])) for _ in range(40)]
    rows = [(bytes([i]), jaccard.signature(s, a, b).astype(">u4").tobytes()) for i, s in enumerate(sets)]
    found = jaccard.forest(spark.createDataFrame([(bytearray(v), bytearray(s)) for v, s in rows], "vertex binary, signature binary")).collect()
    short = {}
    for tree in range(jaccard.VALUES // jaccard.LEAST_DEPTH):
        for v, s in rows:
            short.setdefault((tree, s[16 * tree : 16 * tree + 16]), set()).add(v)
    crowds = {v: sum(len(m) > 3 for m in short.values() if v in m) for v, _ in rows}
    per_node = {}
    for f in found:
        per_node.setdefault(f.node, []).append(bytes(f.vertex))
        assert f.held > 1
    calm = sum(1 for m in short.values() if 1 < len(m) <= 3)
    assert calm <= len(per_node) and sum(crowds.values()) > 0
    kept = {v: sum(v in m for m in per_node.values()) for v, _ in rows}
    assert all(kept[v] <= sum(len(m) > 1 for m in short.values() if v in m) for v, _ in rows)


def common_values(x, y):
    """Values that two prefixes of tries share, -1 in different ones."""
    if x[0] != y[0]:
        return -1
    same = [x[i : i + 4] == y[i : i + 4] for i in range(1, len(x), 4)]
    return same.index(False) if False in same else len(same)


@pytest.mark.parametrize("rows_a_batch", [1, 3, 1000])
def test_sorted_runs_keep_what_shares_a_prefix_with_a_neighbour(rows_a_batch):
    r = random.Random(rows_a_batch)
    keys = sorted(bytes([r.randrange(2)]) + b"".join(bytes([0, 0, 0, r.choice([1, 1, 1, 2])]) for _ in range(jaccard.LONGER[-1])) for _ in range(120))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows_a_batch], pa.binary()), pa.array([b"%d" % j for j in range(i, min(120, i + rows_a_batch))], pa.binary())], ["key", "vertex"]) for i in range(0, 120, rows_a_batch)]
    found = [tuple(row.values()) for b in jaccard._matched(iter(batches)) for row in b.to_pylist()]
    wanted = []
    for i, key in enumerate(keys):
        most = max(common_values(key, keys[j]) if 0 <= j < 120 else jaccard.LONGER[-1] for j in (i - 1, i + 1))
        # no other key of the run shares more than the neighbours do
        assert 0 < i < 119 and most == max(common_values(key, k) for j, k in enumerate(keys) if j != i) or i in (0, 119)
        if most >= jaccard.LEAST_DEPTH:
            wanted.append((key, b"%d" % i, most))
    assert found == wanted and len(wanted) < 120
    assert list(jaccard._matched(iter([]))) == []


def test_pairs_of_many_shared_prefixes_meet_in_the_forest(spark, monkeypatch):
    """Whatever prefixes crowds lengthen: a pair that shares more short ones than both may lengthen is under one node."""
    monkeypatch.setattr(jaccard, "CROWD", 2)
    r, width = random.Random(4), 4 * jaccard.LEAST_DEPTH
    parts = [[bytes(r.randrange(256) for _ in range(width)) for _ in range(3)] for _ in range(jaccard.VALUES // jaccard.LEAST_DEPTH)]
    rows = [(bytes([v]), b"".join(r.choice(p) if r.random() < 0.9 else bytes(r.randrange(256) for _ in range(width)) for p in parts)) for v in range(40)]
    found = jaccard.forest(spark.createDataFrame([(bytearray(v), bytearray(s)) for v, s in rows], "vertex binary, signature binary")).collect()
    nodes = {}
    for f in found:
        nodes.setdefault(f.node, []).append(bytes(f.vertex))
    assert all(f.held == len(nodes[f.node]) == len(set(nodes[f.node])) for f in found)
    met = {(u, v) for members in nodes.values() for u in members for v in members}
    many = 0
    for u, s in rows:
        for v, t in rows:
            shared = sum(s[i : i + width] == t[i : i + width] for i in range(0, len(s), width))
            assert shared > 0 or (u, v) not in met
            if u < v and shared > 2 * jaccard.long_trees():
                many += 1
                assert (u, v) in met
    assert many and jaccard.VALUES // jaccard.LEAST_DEPTH - 2 * jaccard.long_trees() >= jaccard.trees_needed()


def test_first_of_classes_keeps_each_text_of_an_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (None, a), (8, None), (9, ""), (6, "Eight nine ten eleven twelve thirteen fourteen!")]
    kept = jaccard.first_of_classes(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert rows_of(kept, "doc_id", "text") == sorted([(3, a), (5, b), (None, a), (8, None)], key=repr)
    assert set(kept.columns) == {c.split()[0] for c in DOCS.split(", ")}


def test_components_split_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_EDGES", 3)
    edges = [(i, 1000) for i in range(40)] + [(i, i + 1) for i in range(2000, 2030)] + [(5, 5)]
    found = {(r.vertex, r.root) for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {(i, 0) for i in [*range(40), 1000]} | {(i, 2000) for i in range(2000, 2031)}


def test_pair_counts_equal_set_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 90, r.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    counts = jaccard.pair_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def links_by_hand(rows):
    sets = []
    for _, text in rows:
        words = decontaminate.words_of(text)
        n = min(5, len(words))
        sets.append(frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and sets[a]:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], least[find(i)], links[i]) for i in range(len(rows))), key=repr)


def near_copies(seed, groups=12, size=9):
    r, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(8, 90))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("blocks", [False, True])
def test_join_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:  # buckets and clusters fall into many blocks, copies and edges have hubs
        monkeypatch.setattr(jaccard, "HUB_EDGES", 1)
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
        monkeypatch.setattr(jaccard, "VERIFY_ROWS", 3)
    rows = [*near_copies(4), (500, ""), (501, None), (502, "one two"), (503, "One, two!")]
    found = jaccard.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert rows_of(found) == links_by_hand(rows)


def test_join_edge_cases(spark):
    found = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(frame(spark, ODD, ODD_IDS)).collect()}
    assert (None, None, 0) in found and (3, 3, 1) in found
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    texts = ["Hello world", "  a  b\n\nc ", "\x00é😀\t", "x" * 120 + " the" * 9, "日本語 テスト", " ", "", "a" + " " * 70 + "b", "Schön, naïve 12.5%!"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = pieces.Encoder(pieces.Vocabulary.load(), dropout=0).encode(texts, [0] * len(texts))
    assert [o.tolist() for o in own] == library.encode(texts)


def test_dropout_is_seeded_varied_and_lossless(monkeypatch):
    v = pieces.Vocabulary.load()
    texts = ["thoughtful segmentation ▁ of everything " * 4, "é▁\x00😀\t", "", None, "q" * 500]
    one, two = pieces.Encoder(v).encode(texts, [1, 2, 3, 4, 5]), pieces.Encoder(v, seed=99).encode(texts, [1, 2, 3, 4, 5])
    assert [o.tolist() for o in one] == [o.tolist() for o in pieces.Encoder(v).encode(texts, [1, 2, 3, 4, 5])]
    assert one[0].tolist() != two[0].tolist() and one[0].tolist() != pieces.Encoder(v).encode(texts[:1], [8])[0].tolist()
    assert [pieces.decode(v, o) for o in one] == [t or "" for t in texts] == [pieces.decode(v, o) for o in two]
    monkeypatch.setattr(pieces, "SHORT", 0)  # every word by its own agenda
    assert [o.tolist() for o in one] == [o.tolist() for o in pieces.Encoder(v).encode(texts, [1, 2, 3, 4, 5])]


def merged_by_hand(v, text, key, seed, limit):
    """The whole text as one word: join the best adjacent pair that its span's hash does not skip, until none is left."""
    mix = lambda x: int(pieces._mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])
    a, b, c = int(pieces._A), int(pieces._B), int(pieces._C)
    document = mix((key & (2**64 - 1)) * a + mix(seed * b + c))
    spans = [(i, i + 1, int(v.char_ids[ord(ch)])) for i, ch in enumerate(" " + text)]
    while True:
        best = None
        for k, ((s, m, x), (_, e, y)) in enumerate(zip(spans, spans[1:])):
            found = int(v.merge(np.array([x]), np.array([y]))[0]) if x >= 0 and y >= 0 else -1
            if found >= 0 and mix(document + (s << 42 ^ m << 21 ^ e) * a) >= limit and (best is None or (int(v.rank[found]), s) < best[:2]):
                best = int(v.rank[found]), s, k, found
        if best is None:
            return [p for s, e, x in spans for p in ([x] if x >= 0 else [v.byte_base + n for n in (" " + text)[s:e].encode()])]
        spans[best[2] : best[2] + 2] = [(spans[best[2]][0], spans[best[2] + 1][1], best[3])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_dropout_equals_brute_force(dropout):
    v, r = pieces.Vocabulary.load(), random.Random(5)
    texts = ["segmentation of the international everything " * 3, "".join(r.choice("abcdeghinorst") for _ in range(90)), "naïve 日本語の文章 ▁x\n\n\n  b", "the the the the the"]
    encoder = pieces.Encoder(v, seed=77, dropout=dropout)
    found = [o.tolist() for o in encoder.encode(texts, [3, -4, 2**40, 9])]
    assert found == [merged_by_hand(v, t, k, 77, int(encoder.limit)) for t, k in zip(texts, [3, -4, 2**40, 9], strict=True)]


def test_occurrences_of_a_word_vary():
    v = pieces.Vocabulary.load()
    ids = pieces.Encoder(v, dropout=0.3).encode(["thoughtfulness " * 500], [1])[0]
    words = {w for w in " ".join(map(str, ids)).split(str(int(v.char_ids[ord(" ")])))}
    assert len(words) > 20 and pieces.decode(v, ids) == "thoughtfulness " * 500


def test_words_that_occur_once_are_merged_once(monkeypatch):
    v, merged = pieces.Vocabulary.load(), []
    keep = pieces._segment
    monkeypatch.setattr(pieces, "_segment", lambda v, words, which, *more: merged.extend(words[w] for w in which) or keep(v, words, which, *more))
    text = "thoughtful segmentation of the international everything"
    one = pieces.Encoder(v, dropout=0.6).encode([text], [1])[0]
    assert sorted(merged) == sorted(" " + w for w in text.split())
    merged.clear()
    assert pieces.Encoder(v, dropout=0.6).encode([text, text], [1, 1])[0].tolist() == one.tolist() and len(merged) > 6


def test_long_parts_are_quick():
    v, r = pieces.Vocabulary.load(), random.Random(6)
    pieces.Encoder(v).encode(["warm"], [0])
    for text in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000)), "東京都は日本の首都です。" * 3300, "ab" * 20_000):
        start = time.perf_counter()
        ids = pieces.Encoder(v).encode([text], [1])[0]
        assert time.perf_counter() - start < 1 and pieces.decode(v, ids) == text


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a", "some text"), (None, "some text"), ("a", "some text")], "doc_id string, text string")
    found = pieces.encode_documents(rows).collect()
    assert len(found) == 3 and found[0].pieces == found[2].pieces


def test_piece_documents_edge_cases(spark):
    docs = frame(spark, ODD, ODD_IDS)
    back = pieces.decode_documents(pieces.encode_documents(docs)).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(ODD)
    assert all(r.lossless for r in pieces.round_trip(docs).collect())
    assert pieces.round_trip(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- language, pages, media


def test_language_agrees_with_most_declarations(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify(docs, "doc_id", "lang", "source").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in found]) > 0.98 and np.mean([r.text_language == r.lang for r in found]) > 0.98
    bare = language.identify(docs, "doc_id", "lang").count()
    pages = language.identify_pages(common.table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert bare == 1000 and np.mean([r.language in ("en", "de", "fr", "es") for r in pages]) > 0.98


def test_language_rejects_only_texts_without_letters(spark):
    docs = frame(spark, [*ODD, "123 !"], [*ODD_IDS, 9])
    rejected = [r.doc_id for r in language.identify(docs, "doc_id", "lang", "source").collect() if r.rejected]
    assert sorted(map(str, rejected)) == ["0", "1", "4", "9", "None"]
    assert language.identify(frame(spark, []), "doc_id", "lang", "source").count() == 0


def test_language_without_declarations(spark):
    docs = frame(spark, ["some words", "😀 – 12", "", None, "слово"])
    for found in (language.identify(docs, "doc_id"), language.identify(docs, "doc_id", host="source")):
        assert sorted((r.doc_id, r.language, r.probability, r.letters, r.rejected) for r in found.collect()) == [(0, "und", 0.0, 9, False), (1, "und", 0.0, 0, True), (2, "und", 0.0, 0, True), (3, "und", 0.0, 0, True), (4, "und", 0.0, 5, False)]


def test_fused_posterior_equals_brute_force(spark):
    r = random.Random(11)
    vocabulary = {"en": "the and of house garden with that".split(), "de": "der und haus garten nicht mit dass".split(), "fr": "le et maison jardin avec que pas".split()}
    rows = []
    for i in range(90):
        spoken = r.choice(["en", "en", "de", "fr"])
        declared = spoken if r.random() < 0.7 else r.choice(["en", "de", None, "xx"])
        host = r.choice({"en": ["a.site.co.uk", "b.site.co.uk", "News.com"], "de": ["x.blatt.de", "y.blatt.de"], "fr": ["z.fr", None, "news.com"]}[spoken])
        rows.append((i, " ".join(r.choice(vocabulary[spoken]) for _ in range(r.randint(1, 6))) if i % 15 else r.choice(["", "12", None]), declared, host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, table = language.train(docs.select("text", language.F.col("lang").alias("declared")))
    n, logs = len(names), {}
    for i, text, _, _ in rows:
        data = b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())) + b" "
        total = sum((table[language._buckets(np.frombuffer(data[k : k + 3], np.uint8), len(table))[0]].astype(np.float64) for k in range(len(data) - 2)), np.zeros(n))
        logs[i] = language.TEMPER * (total - total.max()) if len(data) > 2 else np.zeros(n)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    certain = [row for row in rows if row[1] and any(c.isalpha() for c in row[1])]
    add = lambda f: {k: sum(softmax(logs[i]) for i, _, d, h in certain if f(d, h) == k) for k in {f(d, h) for _, _, d, h in certain}}
    low = lambda h: (h or "").lower()
    suffix = lambda h: low(h).split(".")[-1] if low(h).count(".") else ""
    domain = lambda h: {"a.site.co.uk": "site.co.uk", "b.site.co.uk": "site.co.uk", "x.blatt.de": "blatt.de", "y.blatt.de": "blatt.de"}.get(low(h), low(h))
    every = add(lambda d, h: 0)[0]
    root = (every + 1) / (every.sum() + n)
    smooth = lambda sums, weight, parent: (sums + weight * parent) / (sums.sum() + weight)
    suffixes, domains, hosts, said = add(lambda d, h: suffix(h)), add(lambda d, h: domain(h)), add(lambda d, h: low(h)), add(lambda d, h: d or "")
    found = {x.doc_id: x for x in language.identify(docs, "doc_id", "lang", "source").collect()}
    for i, text, d, h in rows:
        if (i, text, d, h) not in certain:
            assert (found[i].language, found[i].probability, found[i].rejected) == ("und", 0.0, True)
            continue
        prior = smooth(hosts[low(h)], language.HOST_WEIGHT, smooth(domains[domain(h)], language.LEVEL_WEIGHT, smooth(suffixes[suffix(h)], language.LEVEL_WEIGHT, root)))
        sums = said[d or ""]
        reliability = (sums + language.DECLARED_WEIGHT * sums.sum() / every.sum()) / (every + language.DECLARED_WEIGHT)
        posterior = softmax(logs[i] + np.log(prior) + np.log(reliability))
        assert found[i].language == names[int(posterior.argmax())] and abs(found[i].probability - posterior.max()) < 1e-6


def test_blocks_of_languages_equal_one_table(spark, monkeypatch):
    docs = common.table(spark, SF, "documents")
    whole = rows_of(language.identify(docs, "doc_id", "lang", "source"), "doc_id", "language", "probability", "text_language")
    monkeypatch.setattr(language, "BLOCK", 1)
    monkeypatch.setattr(language, "HELD_CELLS", 4)
    found = rows_of(language.identify(docs, "doc_id", "lang", "source"), "doc_id", "language", "probability", "text_language")
    assert [(i, a, t) for i, a, _, t in found] == [(i, a, t) for i, a, _, t in whole]
    assert all(abs(p - q) < 1e-8 for (_, _, p, _), (_, _, q, _) in zip(found, whole, strict=True))


def test_rare_long_and_many_languages_are_candidates(spark):
    english = spark.range(6000).selectExpr("id AS doc_id", "concat('the house and the garden of number ', id) AS text", "'en' AS lang")
    rare = [(10_000 + i, f"talossa on kissa ja järvellä vene {'yksi kaksi kolme neljä viisi kuusi'.split()[i]}", "fi") for i in range(5)]
    long = [(20_000 + i, f"huset ligger ved sjøen og båten er rød {i} " * 600, "nb") for i in range(3)]
    docs = english.unionByName(spark.createDataFrame(rare + long, "doc_id long, text string, lang string"))
    found = {r.doc_id: r.language for r in language.identify(docs, "doc_id", "lang").filter("doc_id >= 10000").collect()}
    assert found == {i: code for i, _, code in rare + long}
    many = spark.createDataFrame([(f"word{i} text{j}", f"l{i:03}") for i in range(70) for j in range(2)], "text string, declared string")
    assert len(language.train(many)[0]) == 70


PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body><nav><ul><li>menu<li>more</ul></nav><header>site</header>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One<br>two  <b>three<p class="ad">Buy</p><p>Four <span class="share">tweet</span>five
<div class="newsletter"><form>mail</form></div><ul><li>x<li>y</ul><section id="comments"><article>No!</article></section></article><aside>side</aside><footer>f</footer>"""


def test_main_text_of_a_marked_page():
    assert wrappers.main_text(PAGE) == "A & B\n\nOne two three\n\nFour five\n\nx\n\ny"
    assert wrappers.main_text(None) == wrappers.main_text("") == wrappers.main_text("<nav>a</nav>") == ""


def test_wrappers_find_the_region_of_an_unmarked_host(spark):
    page = lambda i: f"<html><body><div class='top'><p>Our Site</p></div><div class='text'><p>Story {i} goes here and on.</p><p>It ends {i * 7}.</p></div><div class='low'><p>Read on</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(7, None, None), (8, "x", "")]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Story 3 goes here and on.\n\nIt ends 21." and found[7] == found[8] == ""
    inferred = wrappers.infer_wrappers(spark.createDataFrame(rows[:6], "page_id long, url string, html string")).collect()
    assert len(inferred) == 1 and inferred[0].pages == 6


def test_wrappers_clean_marked_pages_and_weigh_marks(spark):
    page = lambda i: f"<html><body><article><h1>Title {i}</h1><div class='k'>Follow our site</div><p>Story {i} goes here.</p></article><div class='z'>Note {i}</div></body></html>"
    teaser = f"<html><body><article><p>Teaser</p></article><div class='t'><p>{'The long story of a page. ' * 9}</p></div></body></html>"
    rows = [(i, f"http://m.example/{i}", page(i)) for i in range(5)] + [(9, "http://t.example/", teaser)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Title 3\n\nStory 3 goes here." and "The long story" in found[9]


def test_repeated_headings_and_paragraphs_of_an_article_stay(spark):
    marked = "<html><body><nav>Menu</nav><article><header><h1>Headline {0}</h1><nav>Up</nav></header><h2>Summary</h2><p>Story {0} goes here.</p><p>All rights are with the author.</p><footer>Foot</footer></article><header>Site</header><p>Read us daily</p></body></html>"
    bare = "<html><body><div class='top'><p>Our Site</p></div><div class='text'><p>Intro {0}.</p><h2>Summary</h2><p>Story {0} goes here.</p></div><div class='low'><p>Read on</p></div></body></html>"
    rows = [(i, f"http://{host}.example/{i}", page.format(i)) for host, page, first in (("m", marked, 0), ("b", bare, 10)) for i in range(first, first + 6)]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Headline {i}\n\nSummary\n\nStory {i} goes here.\n\nAll rights are with the author." for i in range(6))
    assert all(found[i] == f"Intro {i}.\n\nSummary\n\nStory {i} goes here." for i in range(10, 16))


def test_unmarked_pages_keep_every_varying_region(spark):
    page = lambda i: f"<html><body><div class='top'>Our Site</div><h1>Title {i}</h1><div class='content'><section class='intro'><p>Intro {i}</p></section><section class='body'><p>The longer story {i} goes here.</p></section></div></body></html>"
    other = "<html><body><table><tr><td>Another template</td></tr></table></body></html>"
    one = "<html><body><h1>Only</h1><div class='a'><p>A short article.</p></div></body></html>"
    yes = "<html><body><ul><li>Same<li>Same</ul><p>End {}</p></body></html>"
    rows = [(i, f"http://v.example/{i}", page(i)) for i in range(5)] + [(9, "http://v.example/9", other)] + [(i, f"http://c.example/{i}", one) for i in range(20, 26)]
    rows += [(30, "http://y.example/", yes.format(0)), *((i, "http://y.example/", f"<html><body><p>End {i}</p></body></html>") for i in (31, 32))]
    found = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Title 3\n\nIntro 3\n\nThe longer story 3 goes here." and found[9] == "Another template"
    assert all(found[i] == "Only\n\nA short article." for i in range(20, 26)) and found[30] == "Same\n\nSame\n\nEnd 0"
    counts = {r.host: (r.pages, r.copies) for r in wrappers.infer_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert counts["c.example"] == (1, 6) and counts["v.example"] == (6, 6)


def test_alignment_makes_optional_and_repeated_groups():
    a = wrappers.wrapper_of(wrappers.read_page("<div><h2>t</h2><p>a<p>b<table><tr><td>1</table></div>"))
    b = wrappers.wrapper_of(wrappers.read_page("<div><h2>t</h2><p>c</div>"))
    assert wrappers.expression(wrappers.merge_wrappers(a, b)) == '<div> <h2> "t" </h2> ( <p> #TEXT </p> )+ ( <table> <tr> <td> "1" </td> </tr> </table> )? </div>'


def tokens_of(node):
    """A page's tree as the string of its block tags and texts."""
    return "".join("#" if c[0] is None else f"<{c[0]}>{tokens_of(c)}</{c[0]}>" for c in node[1])


def regex_of(node):
    """The wrapper as a regular expression over such strings."""
    inner = "#" if node[0] == "#" else "".join(map(regex_of, node[3]))
    body = f"<{re.escape(node[0])}>{inner}</{re.escape(node[0])}>" if node[0] and node[0][0] not in "(#" else inner
    return f"(?:{body})" + ("*" if node[1] and node[2] else "+" if node[2] else "?" if node[1] else "")


def random_page(r, i):
    """A page of one template with optional and repeated parts, and its article."""
    article, out = [f"Title {i}"], [f"<html><body><div class='brand'>The Daily</div><div class='article-header'><h1>Title {i}</h1></div><form action='/'><input name='state'>"]
    for k in range(r.randint(1, 5)):
        text = f"Paragraph {k} of story {i} with {r.randrange(10**6)} words."
        article.append(text)
        out.append(f"<p>{text}</p>")
        if r.random() < 0.4:
            pair = [f"Term {r.randrange(10**6)}", f"Meaning {r.randrange(10**6)}"]
            for _ in range(r.randint(1, 3)):
                article += pair
                out.append(f"<h3>{pair[0]}</h3><blockquote>{pair[1]}</blockquote>")
    if r.random() < 0.5:
        article.append(f"Table {i}")
        out.append(f"<table><tr><td>Table {i}</td></tr></table>")
    out.append("</form><div class='x1'>Read us daily</div>" + ("<div class='sidebar'>more</div>" if r.random() < 0.5 else "") + "</body></html>")
    return "".join(out), "\n\n".join(article)


@pytest.mark.parametrize("seed", range(6))
def test_the_wrapper_matches_every_page_of_its_host(seed):
    r = random.Random(seed)
    pages = [random_page(r, i) for i in range(12)]
    trees = [wrappers.read_page(html) for html, _ in pages]
    wrapper = wrappers.wrapper_of(trees[0])
    for tree in trees[1:]:
        wrapper = wrappers.merge_wrappers(wrapper, wrappers.wrapper_of(tree))
    expression, guide = re.compile(regex_of(wrapper)), wrappers.Guide(wrappers.guide_of(wrapper, len(pages)))
    for tree, (html, article) in zip(trees, pages, strict=True):
        assert expression.fullmatch(tokens_of(tree)) and guide.read(tree, [])
        assert wrappers.main_text(html, guide) == article
    wide = wrappers.wrapper_of(wrappers.read_page("".join(f"<div class='{'ab'[i % 7 % 2]}{chr(97 + i % 5)}'>{i}</div><p>{i}" for i in range(200))))
    assert re.fullmatch(regex_of(wide), tokens_of(wrappers.read_page("<p>x<div class='ac'>y</div>")))


def test_names_and_forms_are_weighed():
    body = "".join(f"<p>Sentence {i} of the body.</p>" for i in range(9))
    parts = "<div class='article-header'><h1>Head</h1></div>{}<div class='related-work'>Work</div><div class='commentary'>Note</div><div class='search-results'>Hits</div>"
    wanted = "Head\n\n" + "\n\n".join(f"Sentence {i} of the body." for i in range(9)) + "\n\nWork\n\nNote\n\nHits"
    assert wrappers.main_text(f"<body><form id='aspnet'>{parts.format(body)}</form></body>") == wanted
    assert wrappers.main_text(f"<body>{parts.format(body)}<form>Your mail</form><div class='site-footer'>f</div><div id='comments'>{body * 3}</div></body>") == wanted
    assert wrappers.main_text(f"<article>Teaser</article><main>{body}</main>").startswith("Sentence 0")


def test_many_hosts_in_a_task_and_odd_pages(spark):
    page = "<html><body><div class='z'>Menu</div><h1>T {0}</h1><p>Story {0} of the host.</p></body></html>"
    many = spark.range(9000).selectExpr("id AS page_id", "concat('http://h', id % 3000, '.example/', id) AS url", f"replace('{page}', '{{0}}', id) AS html".replace("'z'", "\\'z\\'"))
    found = wrappers.extract(many.coalesce(2))
    assert found.count() == 9000 and wrappers.infer_wrappers(many).count() == 3000
    assert rows_of(found.selectExpr("text = concat('T ', page_id, '\n\nStory ', page_id, ' of the host.') AS same").distinct()) == [(True,)]
    long = "<p>word</p>" * 40_000
    odd = [(1, None, long), (1, None, long), (None, "http://a", ""), (2, "::", None)]
    rows = spark.createDataFrame([(*o, "x", "y", "z") for o in odd], "page_id long, url string, html string, host string, guide string, key string")
    assert sorted(r.n_chars for r in wrappers.extract(rows).collect()) == [0, 0, 239_998, 239_998]
    assert wrappers.extract(rows.limit(0)).count() == 0


def test_media_round_trip_and_carving(spark):
    import gzip
    import struct

    payload = b"some payload" * 20
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    inside = payload + png + gzip.compress(b"x" * 50) + b"RIFF but no wave " + b"%PDF-1"
    stored = media.store_wav(inside + bytes(-len(inside) % 64))
    kind, found = media.correct_type(stored, "text/plain")
    assert kind == "audio/wav" and {m.type for m in found} == {"image/png", "application/gzip"}
    carved = next(m for m in found if m.type == "image/png")
    assert stored[carved.start : carved.end] == png and media.read_wav(stored)[: len(inside)] == inside
    assert media.correct_type(stored[:-1], "text/plain")[0] == "text/plain"
    rows = media.media_digests(frame(spark, ODD, ODD_IDS)).collect()
    for r, text in zip(rows, ODD, strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_media_columns_equal_plain_ones(spark):
    import io
    import wave

    texts = ["", "some text", "é" * 77, "x" * 64, "PK\x03\x04 %PDF-1 RIFF", None, "some text"]
    for row in media.media_digests(frame(spark, texts)).collect():
        raw = (texts[row.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.SAMPLE_RATE, 0, "NONE", ""))
            w.writeframes(payload)
        assert (row.media_bytes, row.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        samples = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert row.feature == f"type=audio/wav|declared=text/plain|n={len(samples)}|sum={sum(samples)}|energy={sum(s * s for s in samples)}|crossings={crossings}|peak={max(map(abs, samples))}|carved="
    assert media.media_digests(frame(spark, [])).count() == 0


def flac_file(blocks):
    """A FLAC stream of constant mono blocks of 16 bits."""
    crc = lambda table, bits, data: __import__("functools").reduce(lambda c, b: (c << 8 & (1 << bits) - 1) ^ table[(c >> bits - 8) ^ b], data, 0)
    info = bytes(10) + ((44100 << 44) | (15 << 36) | sum(n for n, _ in blocks)).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\0\0\0\x22" + info + b"\x81\0\0\x05" + b"\0" * 5
    for i, (n, value) in enumerate(blocks):
        head = bytes([0xFF, 0xF8, 0x60, 0x00, i, n - 1])
        head += bytes([crc(media._CRC8, 8, head)])
        frame_ = head + b"\0" + value.to_bytes(2, "big")
        out += frame_ + crc(media._CRC16, 16, frame_).to_bytes(2, "big")
    return out


def test_flac_is_carved_to_its_length_and_signatures_stay_linear():
    stream = flac_file([(192, 5), (100, 77), (17, 4242)])
    found = media.sniff(b"ab" + stream + b"behind it fLaC\0\0\0\x22")
    assert [(m.type, m.start, m.end) for m in found] == [("audio/flac", 2, 2 + len(stream))]
    assert not media.sniff(stream[:-1]) and not media.sniff(stream[:60] + b"!" + stream[61:])
    start = time.perf_counter()
    media.sniff(b"%PDF-PK\x03\x04 " * 40_000)
    assert time.perf_counter() - start < 2


def test_shared_folders_are_removed(spark):
    first = common.written()
    path = common.stored(spark.range(3), "gone").inputFiles()[0]
    common.remove(spark, first)
    assert common.written() == first and not __import__("os").path.exists(path.removeprefix("file://"))


def test_line_runs_leave_the_catalog(spark):
    line_dedup.dedup_lines(frame(spark, ["one long line\nand more", "one long line"])).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]
