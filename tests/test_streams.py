"""Streams whose events come late and out of order, held against their batch forms."""

import random
import tempfile
from glob import glob

from itemforge.operators import scoring
from itemforge.plans import registry
from itemforge.sources.scratch import shared
from itemforge.streaming import outcomes, state
from tests.conftest import rows_of

ANSWERS = "learner long, subject string, question_id string, moment timestamp, seq long, is_correct boolean"
EVENTS = "attempt_id long, moment timestamp, seq long, kind string, minutes int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("moment timestamp", "at long")).selectExpr(*(c.split()[0] if "moment" not in c else "timestamp_micros(at * 60000000) AS moment" for c in schema.split(", ")))


def in_slices(rows, count, late, r):
    """Rows by the time they arrive: at most `late` minutes behind their own time, counted from the last row's."""
    arrived = sorted(rows, key=lambda row: row[-1] + r.randint(0, late))
    size = -(-len(arrived) // count)
    return [arrived[i : i + size] for i in range(0, len(arrived), size)]


def run_closed(closed, folder):
    with state.rocks(closed.sparkSession):
        closed.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_late_answers_give_the_batch_ledger(spark):
    r = random.Random(3)
    answers = [(r.randint(1, 5), r.choice("ab"), f"q{r.randint(1, 6)}", t, i, r.random() < 0.4) for i, t in enumerate(r.randint(0, 4000) for _ in range(400))]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame(spark, [], ANSWERS).write.parquet(f"{folder}/in")
    updates = state.ledger_updates(state.read_folder(spark, f"{folder}/in", ANSWERS, 1000), "3 hours", slots=2)
    for part in in_slices([(*a, a[3]) for a in answers], 6, 90, r):
        frame(spark, [p[:-1] for p in part], ANSWERS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        state.keep_latest(updates, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    wanted = scoring.mistakes_ledger(frame(spark, answers, ANSWERS))
    assert rows_of(state.open_mistakes(spark, f"{folder}/out"), "learner", "subject", "question_id", "last_answered_at", "times_wrong") == rows_of(wanted, "learner", "subject", "question_id", "last_answered_at", "times_wrong")


def test_late_events_settle_attempts(spark):
    r = random.Random(5)
    events = []
    for attempt in range(12):
        start = r.randint(0, 2000)
        for _ in range(r.randint(1, 12)):
            events.append((attempt, start + r.randint(0, 140), len(events), "finish" if r.random() < 0.15 else "answer", 60))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame(spark, [], EVENTS).write.parquet(f"{folder}/in")
    closed = state.closed_attempts(state.read_folder(spark, f"{folder}/in", EVENTS, 1000), "3 hours")
    parts = in_slices([(*e, e[1]) for e in events], 5, 90, r)
    for part in [*([p[:-1] for p in part] for part in parts), [(-1, 10**6, -1, "answer", 1)]]:
        frame(spark, part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_closed(closed, folder)
    found = spark.read.schema("attempt_id long, closed_at timestamp, answered long, reason string").parquet(f"{folder}/out").filter("attempt_id >= 0")
    wanted = []
    for attempt in range(12):
        own = [e for e in events if e[0] == attempt]
        end = min(e[1] for e in own) + 60
        finish = min((e[1] for e in own if e[3] == "finish" and e[1] <= end), default=None)
        last = end if finish is None else finish
        wanted.append((attempt, last * 60, sum(e[3] == "answer" and e[1] <= last for e in own), "time" if finish is None else "finish"))
    assert rows_of(found.selectExpr("attempt_id", "unix_seconds(closed_at)", "answered", "reason")) == sorted(wanted, key=repr)


def held(spark, checkpoint, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).count()


def test_the_ledger_holds_open_entries_only(spark):
    """Closed entries leave the state when the watermark has passed their correct answer; open ones keep numbers, not places."""
    rows = [(i % 40, "a", f"q{j}", i, 10 * i + j, (i + j) % 3 > 0) for i in range(240) for j in range(3)]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame(spark, [], ANSWERS).write.parquet(f"{folder}/in")
    updates = state.ledger_updates(state.read_folder(spark, f"{folder}/in", ANSWERS, 1000), "10 minutes", slots=1)
    far = (99, "a", "q", 10**6, 10**6, False)
    for part in (rows[:360], rows[360:], [far]):
        frame(spark, part, ANSWERS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        state.keep_latest(updates, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    wanted = scoring.mistakes_ledger(frame(spark, [*rows, far], ANSWERS))
    columns = ["learner", "subject", "question_id", "last_answered_at", "times_wrong"]
    assert rows_of(state.open_mistakes(spark, f"{folder}/out"), *columns) == rows_of(wanted, *columns)
    assert held(spark, f"{folder}/checkpoint", "entries") == wanted.count() < 120
    places = spark.read.format("statestore").option("stateVarName", "entries").load(f"{folder}/checkpoint").selectExpr("sum(size(user_map_value.open)) AS n").first().n
    assert places == 1  # of the last answer alone; all others are settled


def test_long_attempts_append_and_are_read_once(spark):
    """An attempt of very many events over several batches is counted at its end; what was held then goes."""
    n = 40_000
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame(spark, [], EVENTS).write.parquet(f"{folder}/in")
    closed = state.closed_attempts(state.read_folder(spark, f"{folder}/in", EVENTS, 1000), "1 minute")
    for k in range(4):
        own = spark.range(k * n // 4, (k + 1) * n // 4).selectExpr("7L AS attempt_id", "timestamp_micros((id + 1) * 1000) AS moment", "id AS seq", "'answer' AS kind", "60 AS minutes")
        own.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_closed(closed, folder)
        assert held_list(spark, folder) == (k + 1) * n // 4
    frame(spark, [(-1, 10**6, -1, "answer", 1)], EVENTS).write.mode("append").parquet(f"{folder}/in")
    run_closed(closed, folder)
    found = spark.read.schema("attempt_id long, closed_at timestamp, answered long, reason string").parquet(f"{folder}/out").filter("attempt_id >= 0")
    assert rows_of(found.selectExpr("attempt_id", "unix_seconds(closed_at)", "answered", "reason")) == [(7, 3600, n, "time")]
    assert held_list(spark, folder) == 1  # the event that moved the watermark


def held_list(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "answers").load(f"{folder}/checkpoint").count()


def test_final_answers_of_any_age(spark):
    """Batches out of order, a batch that is replayed, and changes combined to a base give the batch form for exams and practice."""
    r = random.Random(8)
    schema = "attempt_id long, question_id int, option string, moment timestamp, seq long"
    events = [(r.randint(1, 9), r.randint(1, 12), r.choice("abcd"), r.randint(0, 10**6), i) for i in range(600)]
    rows = lambda part: spark.createDataFrame(part, schema.replace("moment timestamp", "at long")).selectExpr("attempt_id", "question_id", "option", "timestamp_micros(at) AS moment", "seq")
    for exam in (True, False):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        table = state.final_answers(spark, folder, exam, changes=3)
        for number in range(9):
            table.write(rows(events[number::9]), number)
            if number % 4 == 0:
                table.write(rows(events[:50]), number)  # taken already, as after a failure
        wanted = rows_of(scoring.last_answers(rows(events), exam), "attempt_id", "question_id", "option")
        assert rows_of(table.read(), "attempt_id", "question_id", "option") == wanted
        parts = table.log.latest()[1]["parts"]
        assert len(parts) <= 4 and parts[0].startswith("base-")
        table.clean()
        assert rows_of(table.read(), "attempt_id", "question_id", "option") == wanted
        assert spark.read.schema(schema).parquet(*(f"{folder}/{p}" for p in parts)).count() < 4 * len(wanted)


def test_the_keyed_ledger_takes_answers_of_any_age_and_replayed_batches(spark):
    r = random.Random(8)
    answers = [(r.randint(1, 5), r.choice("ab"), f"q{r.randint(1, 6)}", r.randint(0, 4000), i, r.random() < 0.4) for i in range(400)]
    table = state.ledger_table(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), changes=1)
    for number in range(4):
        batch = frame(spark, answers[number * 100 : number * 100 + 100], ANSWERS)
        state.write_answers(table, batch, number)
        state.write_answers(table, batch, number)
    wanted = scoring.mistakes_ledger(frame(spark, answers, ANSWERS))
    columns = ("learner", "subject", "question_id", "last_answered_at", "times_wrong")
    assert rows_of(state.open_entries(table), *columns) == rows_of(wanted, *columns)


def test_superseded_lines_of_any_age_equal_brute_force(spark):
    r = random.Random(8)
    schema, day = "chunk long, line long, id string, accepted boolean, moment timestamp", 24 * 60
    rows = [(i // 20, i, r.choice([None, "zzz", *(f"q{k}" for k in range(60))]), r.random() < 0.3, r.randint(0, 90) * day) for i in range(500)]
    rows = [(c, n, name, accepted and name != "zzz", at) for c, n, name, accepted, at in rows]
    tables = outcomes.outcome_tables(spark, f"{shared(spark)}/outcomes-test", changes=2)
    for number in (0, 1, 2, 2, 3, 1, 4):  # batches 2 and 1 are replayed
        outcomes.write_outcomes(tables, frame(spark, rows[number * 100 : number * 100 + 100], schema), number)
    good = [(name, at) for _, _, name, accepted, at in rows if accepted and name]
    wanted = [(c, n, any(name == g and abs(at - when) <= 10 * day for g, when in good)) for c, n, name, accepted, at in rows if not accepted]
    assert rows_of(outcomes.superseded_so_far(tables, "10 days"), "chunk", "line", "superseded") == sorted(wanted, key=repr)
    assert len({w[2] for w in wanted}) == 2


def test_superseded_stream_holds_no_state(spark):
    folder = shared(spark).removeprefix("file:")
    before = set(glob(f"{folder}/outcomes-*/checkpoint"))
    assert registry.QUERIES["superseded_stream"](spark, "/root/testdata/sf0.001").count() > 0
    new = set(glob(f"{folder}/outcomes-*/checkpoint")) - before
    assert len(new) == 1 and not [f for c in new for f in glob(f"{c}/state/*/*")]
