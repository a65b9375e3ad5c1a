import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest

from itemforge.sources import banks, commits, sinks
from tests.conftest import rows_of


def test_bank_files_keep_their_order_and_place(spark, tmp_path):
    for folder, name, ids in (("public", "b.json", ["b1", "b2"]), ("public", "a.json", ["a1"]), ("staged", "a.json", ["z"])):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps([{"id": i, "subject": "tznk", "tags": ["t"] if i == "b1" else None, "other": 1} for i in ids], indent=1))
    bank = banks.read_bank(spark, f"{tmp_path}/public/*.json", staged=f"{tmp_path}/staged/*.json")
    assert [r.id for r in bank.orderBy("file_rank", "position").collect()] == ["a1", "b1", "b2", "z"]
    assert banks.comparison_bank([bank], "t").count() == 3
    assert banks.read_json(spark, f"{tmp_path}/none.json", banks.GROUPS, optional=True).count() == 0
    empty = banks.read_json(spark, f"{tmp_path}/none.json", banks.GROUPS, optional=True)
    assert banks.subject_bundle(spark, bank, bank, empty, empty, "nobody") is None
    assert banks.subject_bundle(spark, bank, bank, empty, empty, "z")["questions"].count() == 0


def test_lines_and_chunks(spark, tmp_path):
    (tmp_path / "out-1.jsonl").write_text('{"custom_id": "a"}\n\n  \nbad\n')
    lines = banks.read_lines(spark, f"{tmp_path}/out-1.jsonl", "custom_id string")
    assert rows_of(lines.select("parsed.custom_id", "raw")) == sorted([("a", '{"custom_id": "a"}'), (None, "bad")], key=repr)
    index = spark.createDataFrame([(1,), (2,)], "chunk long")
    assert rows_of(banks.read_chunks(spark, index, f"{tmp_path}/out-*.jsonl"), "chunk", "raw") == [(1, "bad"), (1, '{"custom_id": "a"}')]
    assert banks.read_chunks(spark, index, f"{tmp_path}/no-*.jsonl", f"{tmp_path}/out-1.jsonl").count() == 2
    with pytest.raises(FileNotFoundError):
        banks.keyed_index(spark.createDataFrame([("a",)], "path string"), ["a", "b"])


def test_versions_sources_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, source string")
    folder = str(tmp_path / "bank")
    sinks.write_version(rows, folder, "one")
    sinks.write_version(sinks.replace_source(rows, spark.createDataFrame([(3, "x")], "id int, source string"), "source", "x"), folder, "two")
    assert rows_of(sinks.read_version(spark, folder)) == [(2, "y"), (3, "x")]
    assert rows_of(sinks.read_version(spark, folder, "one")) == [(1, "x"), (2, "y")]
    parts = str(tmp_path / "parts")
    sinks.write_source(rows, parts, "source")
    sinks.write_source(spark.createDataFrame([(9, "x")], "id int, source string"), parts, "source")
    assert rows_of(spark.read.parquet(parts), "id") == [(2,), (9,)]
    requests = spark.createDataFrame([(i // 2 + 1, i, f"c{i}", "{}") for i in range(5)], "chunk long, place long, custom_id string, body string")
    sinks.write_chunks(requests, str(tmp_path / "chunks"))
    assert spark.read.text(str(tmp_path / "chunks")).groupBy("chunk").count().count() == 3
    sinks.write_files(rows.withColumnsRenamed({"source": "file", "id": "position"}), str(tmp_path / "files"))
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_parts_of_a_bank_and_of_a_file_keep_rank_and_order(spark, tmp_path):
    """A bank of several parts has one rank; the parts of a file, by name, hold its rows in order."""
    rows = spark.range(4000).selectExpr("cast(id as string) AS id", "'english' AS subject")
    for folder in ("public/b", "public/a", "staged/c"):
        sinks.write_json(rows.repartition(3), f"{tmp_path}/{folder}")
    bank = banks.read_bank(spark, f"{tmp_path}/public/*", staged=f"{tmp_path}/staged/*", one_array=False)
    held = bank.selectExpr("regexp_extract(file, '[^/]*$', 0) AS name", "file_rank", "position").groupBy("name", "file_rank").agg({"*": "count"})
    assert rows_of(held) == [("a", 0, 4000), ("b", 1, 4000), ("c", 2, 4000)]
    # each stays several parts: no task writes a bank alone
    assert len(list((tmp_path / "public" / "a").glob("part-*.json"))) == 3
    files = spark.range(4000).selectExpr("if(id % 10 = 0, 'small', 'big') AS file", "4000 - id AS position")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_files(files, str(tmp_path / "files"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "files" / "file=big").glob("part-*.parquet"))
    found = [r for part in parts for r in pq.read_table(part, partitioning=None)["position"].to_pylist()]
    assert len(parts) > 1 and found == sorted(4000 - i for i in range(4000) if i % 10)
    assert banks.read_json(spark, f"{tmp_path}/public/a", banks.GROUPS, optional=True, one_array=False).count() == 4000


def test_one_of_two_writers_wins(spark, tmp_path):
    """Both read the same version; the second to commit learns of it, and nothing of the first is lost."""
    rows, folder = spark.createDataFrame([(1, "x")], "id int, source string"), str(tmp_path / "bank")
    sinks.write_version(rows, folder, "one")
    seen = sinks.last_commit(spark, folder)
    sinks.write_version(rows.unionByName(spark.createDataFrame([(2, "a")], rows.schema)), folder, "a", after=seen)
    with pytest.raises(commits.Conflict):
        sinks.write_version(rows.unionByName(spark.createDataFrame([(3, "b")], rows.schema)), folder, "b", after=seen)
    assert sinks.current_version(spark, folder) == "a" and rows_of(sinks.read_version(spark, folder), "id") == [(1,), (2,)]
    sinks.write_version(sinks.read_version(spark, folder).unionByName(spark.createDataFrame([(3, "b")], rows.schema)), folder, "c", after=sinks.last_commit(spark, folder))
    assert sinks.versions(spark, folder) == ["one", "a", "c"] and rows_of(sinks.read_version(spark, folder), "id") == [(1,), (2,), (3,)]


def test_many_writers_commit_once_each(spark, tmp_path):
    log, done = commits.CommitLog(spark, str(tmp_path / "log")), []

    def work(name):
        for k in range(5):
            while True:
                try:
                    done.append(log.commit(log.latest()[0], {"name": name, "k": k}))
                    break
                except commits.Conflict:
                    continue

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(work, range(6)))
    assert sorted(done) == log.numbers() == list(range(1, 31))
    assert sorted((e["name"], e["k"]) for e in map(log.read, log.numbers())) == [(n, k) for n in range(6) for k in range(5)]


def test_a_crash_between_the_steps_leaves_the_version_before(spark, tmp_path, monkeypatch):
    rows, folder = spark.createDataFrame([(1, "x")], "id int, source string"), str(tmp_path / "bank")
    sinks.write_version(rows, folder, "one")

    def crash(self, fresh, entry):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "_publish", crash)
        with pytest.raises(RuntimeError):
            sinks.write_version(rows.limit(0), folder, "two")
    (tmp_path / "bank/_log/.half.tmp").write_text('{"vers')  # an entry that was never moved
    assert sinks.current_version(spark, folder) == "one" and sinks.read_version(spark, folder).count() == 1
    assert sinks.current_version(spark, str(tmp_path / "none")) is None
    sinks.write_version(rows.limit(0), folder, "three")
    assert sinks.versions(spark, folder) == ["one", "three"]
