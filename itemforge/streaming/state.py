"""Streaming forms of the mistakes ledger, of final answers and of timed attempts, on typed state in RocksDB.

answers: learner, subject, question_id, moment (timestamp), seq (long), is_correct. Sources are folders of Parquet files;
a new file is a new micro-batch. Times in the state are microseconds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from itemforge.sources.keyed import KeyedTable, latest_by

LEDGER = "learner long, subject string, question_id string, last_answered_at timestamp, times_wrong long"
NEVER = -(2**62)
#: Entries that may be settled at about the same time share a timer.
BUCKET_MS = 3_600_000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, whose checkpoints are the changes of a batch."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_folder(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _micros(rows: pd.DataFrame) -> list[int]:
    return rows["moment"].to_numpy().astype("datetime64[us]").astype("int64").tolist()


#: Parts that a learner's entries are split into, so that a learner of very many answers is several keys.
SLOTS = 2


class Ledger(StatefulProcessor):
    """entries holds, by subject and question, the place of the last correct answer, the settled wrong answers behind it (their
    number and the last time), and the places of the others; a batch reads and writes the entries that it touches.

    A wrong answer is settled when the watermark has passed it: nothing that is still to come can precede it. due names
    the entries to look at when the watermark passes an hour; an entry without wrong answers goes as soon as its correct
    answer is settled. So the state holds open mistakes, and single answers only as far back as late data may reach.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "subject string, question_id string", "closed_at long, closed_seq long, settled long, settled_at long, open array<struct<at: long, seq: long>>")
        self.due = handle.getMapState("due", "at long", "names array<struct<subject: string, question_id: string>>")

    def _load(self, name: tuple) -> list | None:
        if not self.entries.containsKey(name):
            return None
        closed_at, closed_seq, settled, settled_at, places = self.entries.getValue(name)
        return [(closed_at, closed_seq), settled, settled_at, [tuple(p) for p in places]]

    def _save(self, name: tuple, entry: list, settled: int) -> None:
        """Count what the watermark has passed; an entry of which nothing can matter any more goes."""
        old = [place for place in entry[3] if place[0] < settled]
        if old:
            entry[1:] = entry[1] + len(old), max(p[0] for p in old), [p for p in entry[3] if p[0] >= settled]
        if entry[1] or entry[3] or entry[0][0] >= settled:
            self.entries.updateValue(name, (*entry[0], entry[1], entry[2], entry[3]))
        elif self.entries.containsKey(name):
            self.entries.removeKey(name)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        touched: dict[tuple, list[tuple[int, int, bool]]] = defaultdict(list)
        for part in rows:
            for subject, question, time, seq, right in zip(part["subject"].tolist(), part["question_id"].tolist(), _micros(part), part["seq"].tolist(), part["is_correct"].tolist(), strict=True):
                if time >= settled:  # else later than the watermark allows
                    touched[subject, question].append((time, seq, right))
        found, due = [], defaultdict(list)
        for name, answers in touched.items():
            entry = self._load(name) or [(NEVER, NEVER), 0, None, []]
            if correct := [answer[:2] for answer in answers if answer[2]]:
                entry[0], entry[1], entry[2] = max(entry[0], *correct), 0, None  # behind all settled ones
            entry[3] = sorted({p for p in [*entry[3], *(answer[:2] for answer in answers if not answer[2])] if p > entry[0]})
            last = entry[3][-1][0] if entry[3] else entry[2]
            found.append((key[0], *name, None if last is None else pd.Timestamp(last, unit="us"), entry[1] + len(entry[3])))
            due[(max(answer[0] for answer in answers) // 1000 // BUCKET_MS + 1) * BUCKET_MS].append(name)
            self._save(name, entry, settled)
        for at, names in due.items():
            if self.due.containsKey((at,)):
                names = list(dict.fromkeys([*map(tuple, self.due.getValue((at,))[0]), *names]))
            else:
                self.handle.registerTimer(at)
            self.due.updateValue((at,), (names,))
        if found:
            yield pd.DataFrame(found, columns=["learner", "subject", "question_id", "last_answered_at", "times_wrong"]).astype({"last_answered_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, settled = (expiredTimerInfo.getExpiryTimeInMs(),), timerValues.getCurrentWatermarkInMs() * 1000
        for name in map(tuple, self.due.getValue(at)[0]):
            if entry := self._load(name):
                self._save(name, entry, settled)
        self.due.removeKey(at)
        return iter(())

    def close(self) -> None:
        pass


def ledger_updates(answers: DataFrame, delay: str = "2 days", slots: int = SLOTS) -> DataFrame:
    """A stream of the entries that changed; times_wrong 0 tells that an entry closed. Answers may be late by the delay.

    Start it inside of rocks(). Equal (moment, seq) of a question are one answer.
    """
    slot = F.pmod(F.xxhash64("subject", "question_id"), F.lit(slots))
    rows = answers.withWatermark("moment", delay).withColumn("slot", slot)
    return rows.groupBy("learner", "slot").transformWithStateInPandas(Ledger(), LEDGER, "update", "EventTime")


def keep_latest(updates: DataFrame, folder: str, checkpoint: str):
    """Run the updates to the end of what is there; each batch is a folder of its own, so a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number:09d}")

    with rocks(updates.sparkSession):
        return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_mistakes(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger as of the last batch."""
    rows = spark.read.schema(f"{LEDGER}, batch int").parquet(folder)
    key = ["learner", "subject", "question_id"]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct("last_answered_at", "times_wrong"), "batch").alias("e"))
    return newest.select(*key, "e.*").filter("times_wrong > 0")


def combined_ledger(rows: DataFrame) -> DataFrame:
    """One row a question of a learner: the place of the last correct answer, and those of the wrong ones behind it.

    May be applied to its own results, in any order and more than once: equal places are one answer.
    """
    both = rows.groupBy("learner", "subject", "question_id").agg(F.max("closed").alias("closed"), F.array_distinct(F.flatten(F.collect_list("open"))).alias("open"))
    return both.withColumn("open", F.filter("open", lambda place: F.col("closed").isNull() | (place > F.col("closed"))))


def ledger_table(spark: SparkSession, folder: str, changes: int = 8) -> KeyedTable:
    """The ledger of answers of any age as a keyed table, for streams whose batches touch many learners: its work is joins and
    groups of a batch, without calls to a state for each entry. It keeps the places of open wrong answers; a learner of very
    many is many keys. write_answers() takes micro-batches, open_entries() reads.
    """
    place = "struct<moment: timestamp, seq: long>"
    return KeyedTable(spark, folder, f"learner long, subject string, question_id string, closed {place}, open array<{place}>", combined_ledger, changes)


def write_answers(table: KeyedTable, batch: DataFrame, number: int) -> None:
    """A micro-batch of answers; for foreachBatch."""
    place = F.struct("moment", "seq")
    none = F.array().cast("array<struct<moment: timestamp, seq: long>>")
    table.write(batch.select("learner", "subject", "question_id", F.when(F.col("is_correct"), place).alias("closed"), F.when(F.col("is_correct"), none).otherwise(F.array(place)).alias("open")), number)


def open_entries(table: KeyedTable) -> DataFrame:
    """LEDGER of the questions with wrong answers behind the last correct one."""
    rows = table.read().filter(F.size("open") > 0)
    return rows.select("learner", "subject", "question_id", F.array_max("open")["moment"].alias("last_answered_at"), F.size("open").cast("long").alias("times_wrong"))


def final_answers(spark: SparkSession, folder: str, exam: bool = True, id_type: str = "int", changes: int = 8) -> KeyedTable:
    """A table of the last answers of exams, or the first ones of practice, for events (attempt_id, question_id, option, moment, seq) of any age.

    Its write() takes micro-batches; read() gives attempt_id, question_id, option, moment and seq.
    """
    schema = f"attempt_id long, question_id {id_type}, option string, moment timestamp, seq long"
    return KeyedTable(spark, folder, schema, latest_by(["attempt_id", "question_id"], "option", first=not exam), changes)


#: How long a closed attempt is remembered, so that late answers open no second one.
REMEMBERED_MS = 365 * 24 * 3600 * 1000


class TimedAttempt(StatefulProcessor):
    """bounds holds an attempt's first event, the first finish and the timer that is set; answers a list of times that only grows.

    When the watermark passes the end or the finish, start, end and answers are settled, whatever order the events came in;
    only then is the list read, once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bounds = handle.getValueState("bounds", "start long, seq long, minutes long, finish long, timer long, closed boolean")
        self.answers = handle.getListState("answers", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.bounds.get() if self.bounds.exists() else None
        now = timerValues.getCurrentWatermarkInMs()
        if known and known[5]:  # nothing changes a closed attempt, but it is remembered for longer
            self._set((*known[:4], now + REMEMBERED_MS, True), known[4])
            return
        first, finish = (tuple(known[:3]), known[3]) if known else (None, None)
        times = []
        for part in rows:
            for time, seq, kind, minutes in zip(_micros(part), part["seq"].tolist(), part["kind"].tolist(), part["minutes"].tolist(), strict=True):
                first = min(first, (time, seq, int(minutes))) if first else (time, seq, int(minutes))
                if kind == "finish":
                    finish = time if finish is None else min(finish, time)
                elif kind == "answer":
                    times.append(time)
        end = first[0] + first[2] * 60_000_000
        if times := [(time,) for time in times if time <= end]:  # an earlier start can only move the end forward
            self.answers.appendList(times)
        last = min(end, finish) if finish is not None else end
        self._set((*first, finish, max(last // 1000, now) + 1, False), known[4] if known else None)
        return
        yield

    def _set(self, bounds: tuple, timer: int | None) -> None:
        if bounds[4] != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(bounds[4])
        self.bounds.update(bounds)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, seq, minutes, finish, _, closed = self.bounds.get()
        if closed:
            self.bounds.clear()
            return
        end = start + minutes * 60_000_000
        by_finish = finish is not None and finish <= end
        last = finish if by_finish else end
        answered = sum(at <= last for (at,) in self.answers.get())
        self.answers.clear()
        self._set((start, seq, minutes, finish, timerValues.getCurrentWatermarkInMs() + REMEMBERED_MS, True), None)
        yield pd.DataFrame({"attempt_id": [key[0]], "closed_at": [pd.Timestamp(last, unit="us")], "answered": [answered], "reason": ["finish" if by_finish else "time"]}).astype({"closed_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def closed_attempts(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """events (attempt_id, moment, seq, kind, minutes): each attempt once, as the watermark passes its end or its finish.

    kind is answer, finish or anything else (which only counts as the attempt's start). Start it inside of rocks().
    """
    schema = "attempt_id long, closed_at timestamp, answered long, reason string"
    return events.withWatermark("moment", delay).groupBy("attempt_id").transformWithStateInPandas(TimedAttempt(), schema, "append", "EventTime")
