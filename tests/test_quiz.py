"""The eight-question fixture: two groups of three and four, two exam sets."""

import random

import pytest

from pyspark.sql import functions as F

from itemforge.operators import filters, grouping, merge, quiz, scoring
from itemforge.sources import scratch
from tests.conftest import rows_of

QUESTIONS = ["eng-1", "eng-2", "eng-3", "eng-standalone", "m-1", "m-2", "m-3", "m-4"]
GROUPS = {"g-eng": ["eng-1", "eng-2", "eng-3"], "g-m": ["m-1", "m-2", "m-3", "m-4"]}


@pytest.fixture
def bank(spark):
    members = [(g, q, i + 1) for g, qs in GROUPS.items() for i, q in enumerate(qs)]
    return spark.createDataFrame([(q,) for q in QUESTIONS], "question_id string"), spark.createDataFrame(members, "group_id string, question_id string, group_order int")


def eligible(spark, ids, request=1):
    return spark.createDataFrame([(request, q, i) for i, q in enumerate(ids)], "request_id int, question_id string, position int")


def budgets(spark, budget, request=1):
    return spark.createDataFrame([(request, budget, 7)], "request_id int, budget int, seed int")


def test_group_is_built_once_and_keeps_member_order(spark, bank):
    questions, members = bank
    units = quiz.build_units(eligible(spark, QUESTIONS[:4]), members)
    assert [r[0] for r in units.orderBy("unit_position").select("type").collect()] == ["group", "question"]
    flat = quiz.flatten(units, members, questions).orderBy("place").collect()
    assert [r.question_id for r in flat] == QUESTIONS[:4]
    assert [(r.order_in_group, r.total_in_group) for r in flat] == [(1, 3), (2, 3), (3, 3), (None, None)]


def test_selection_never_splits_a_group(spark, bank):
    units = quiz.build_units(eligible(spark, QUESTIONS[:4]), bank[1])
    chosen = quiz.select_units(units, budgets(spark, 2)).collect()
    assert [(r.type, r.question_id) for r in chosen] == [("question", "eng-standalone")]


def test_a_lone_group_beyond_the_budget_is_taken(spark, bank):
    units = quiz.build_units(eligible(spark, QUESTIONS[4:]), bank[1])
    assert quiz.flatten(quiz.select_units(units, budgets(spark, 2)), bank[1], bank[0]).count() == 4
    assert quiz.select_units(units, budgets(spark, 0)).count() == 0


def test_one_wrong_member_brings_the_whole_group(spark, bank):
    assert quiz.build_units(eligible(spark, ["eng-2"]), bank[1]).count() == 0
    units = quiz.build_units(eligible(spark, ["eng-2"]), bank[1], any_member=True)
    assert quiz.flatten(units, bank[1], bank[0]).count() == 3


def test_exam_set_filter(spark):
    sets = spark.createDataFrame([("english-2024", "english", "public_source", "s", "2024"), ("english-2023", "english", "generated", "s", "2023"), ("m", "management", "public_source", "s", None)], "set_id string, subject string, source_type string, source_site string, source_year string")
    assert rows_of(sets.filter(filters.exam_sets_by("english", "imported", "s", 2024)), "set_id") == [("english-2024",)]
    assert rows_of(sets.filter(filters.exam_sets_by(year="")), "set_id") == [("m",)]


def test_selection_equals_a_sequential_fold(spark):
    r = random.Random(3)
    rows, wanted = [], {}
    for request in range(60):
        sizes = [r.choice([0, 1, 1, 2, 3, 5]) for _ in range(r.randint(1, 8))]
        budget, total, taken, deferred = request % 9, 0, [], []
        for i, size in enumerate(sizes):
            rows.append((request, i, "group", None, f"g{i}", size))
            if size and total + size <= budget:
                total, taken = total + size, [*taken, i]
            elif size:
                deferred.append(i)
        wanted[request] = (taken or deferred[:1]) if budget > 0 else []
    units = spark.createDataFrame(rows, "request_id int, unit_position int, type string, question_id string, group_id string, size long")
    budget = spark.createDataFrame([(i, i % 9, 1) for i in range(60)], "request_id int, budget int, seed int")
    found = quiz.select_units(units, budget).groupBy("request_id").agg({"unit_position": "collect_list"}).collect()
    assert {r[0]: sorted(r[1]) for r in found} == {k: v for k, v in wanted.items() if v}


def test_assembly_is_reproducible_and_within_budget(spark, bank):
    questions, members = bank
    one, two = (quiz.assemble(eligible(spark, QUESTIONS), members, questions, budgets(spark, 5)).orderBy("place").collect() for _ in range(2))
    assert one == two and 1 <= len(one) <= 5


def test_greedy_acceptance_equals_the_sequential_walk(spark):
    r = random.Random(5)
    edges, wanted, base = [], {}, 0
    for _ in range(40):
        n = r.randint(1, 9)
        own = {(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 12))) if a != b}
        for i in range(n):
            wanted[base + i] = not any(wanted[base + a] for a, b in own if b == i)
        edges += [(base + a, base + b) for a, b in own]
        base += n
    claims = [(f"{a}-{b}", i) for a, b in edges for i in (a, b)]
    found = merge.greedy_accept(spark.range(base), spark.createDataFrame(claims, "key string, id long"))
    assert {r.id: r.accepted for r in found.collect()} == wanted and found.count() == base


def test_greedy_acceptance_of_shared_keys_equals_the_sequential_walk(spark):
    r = random.Random(6)
    claims = {(f"{part}:{r.randint(0, 7)}", 20 * part + i) for part in range(30) for i in range(20) for _ in range(r.randint(0, 3))}
    held, wanted = set(), {}
    for i in range(600):
        own = {k for k, j in claims if j == i}
        wanted[i] = not own & held
        held |= own if wanted[i] else set()
    found = merge.greedy_accept(spark.range(600), spark.createDataFrame(sorted(claims), "key string, id long"))
    assert {r.id: r.accepted for r in found.collect()} == wanted


def test_long_chains_take_few_rounds_and_crowds_no_pairs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(merge, "cut", lambda df, name="cut": written.append(name) or scratch.cut(df, name))
    n = 10_000
    chain = spark.range(n - 1).selectExpr("concat('c', id) AS key", "explode(array(id, id + 1)) AS id")
    crowd = spark.range(n, n + 100_000).selectExpr("'one' AS key", "id")
    found = merge.greedy_accept(spark.range(n + 100_000), chain.unionByName(crowd))
    assert found.filter("accepted").agg(F.count("*"), F.sum("id")).first()[:] == (n // 2 + 1, sum(range(0, n, 2)) + n)
    assert written.count("pointers") <= 20 and written.count("seen") <= 3


def test_a_row_rejected_by_id_leaves_its_text_free(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    staged = spark.createDataFrame([(1, "s", "known", text, True, True), (2, "s", "fresh", text, True, True), (3, "s", "late", text, True, True)], "id long, subject string, question_id string, text string, candidate boolean, valid boolean")
    bank = spark.createDataFrame([(9, "s", "known", "other")], "id long, subject string, question_id string, text string")
    assert rows_of(merge.merge_decisions(staged, bank), "id", "reason") == [(1, "duplicate_id"), (2, None), (3, "duplicate_question_text")]
    decisions = merge.merge_decisions(staged, bank)
    assert merge.retained(decisions).count() == 2 and merge.retained(decisions, drop_duplicates=True).count() == 0


def test_unanswered_is_wrong_and_the_mean_is_unweighted(spark):
    answers = spark.createDataFrame([(1, 1, 10, "a", None, 0, 0), (1, 2, 11, "a", 1, 1, 0), (2, 1, 10, "a", 0, 0, 0)], "attempt_id long, position int, question_id long, topic string, selected int, correct int, seq long")
    totals = scoring.attempt_totals(scoring.mark(answers))
    assert rows_of(totals, "attempt_id", "score", "percentage", "wrong_ids") == [(1, 1, 50.0, [10]), (2, 1, 100.0, [])]
    attempts = spark.createDataFrame([(1, 5), (2, 5)], "attempt_id long, learner long")
    assert rows_of(scoring.progress_summary(attempts, totals)) == [(5, 2, 75.0, 100.0, 3)]


def test_groups_need_two_rows_and_a_long_passage(spark):
    long, short = "p" * 90, "p" * 20
    rows = [("s-1", long, "u1", 2020), ("s-2", long.upper(), "u2", 2020), ("s-3", short, "u", 2020), ("s-4", "q" * 90, "u", 2020)]
    bank = spark.createDataFrame([(q, "s", "public_source", u, "h", y, i, p, i) for i, (q, p, u, y) in enumerate(rows)], "question_id string, subject string, source_type string, source_url string, source_site string, source_year int, source_order long, passage string, position long")
    group = grouping.auto_groups(grouping.group_members(bank)).collect()
    assert [(g.question_ids, g.source_year, g.tags[-1]) for g in group] == [(["s-1", "s-2"], "2020", "multi_source_url_group")]
