"""What changes with the size of the tables: constants, growth of joins, work in one task."""

import os
import random
import tempfile
from collections import Counter

import pyarrow.compute as pc
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from itemforge.functions import text
from itemforge.operators import dedup, metrics, quiz
from itemforge.plans import enrichment, enrichment_queries, registry, roles
from tests.conftest import rows_of
from tests.oracle import TABLES, differences

SF = "/root/testdata/sf0.001"


def with_table(folder, name, change):
    """The smallest tables in a folder, one of them changed."""
    for table in TABLES:
        if table != name:
            os.symlink(f"{SF}/{table}.parquet", folder / f"{table}.parquet")
    pq.write_table(change(pq.read_table(f"{SF}/{name}.parquet")), folder / f"{name}.parquet")
    return str(folder)


def test_precedence_of_outputs_in_chunks_behind_the_thousandth(spark, tmp_path):
    shift = lambda t: t.set_column(t.schema.get_field_index("p_partkey"), "p_partkey", pc.add(t["p_partkey"], 420_000))
    folder = with_table(tmp_path, "part", shift)
    assert not differences(spark, registry.QUERIES["output_precedence"], registry.ORACLES["output_precedence"], folder)


def test_texts_of_few_frequent_words_meet_only_if_similar(spark):
    """Texts of 60 of 90 words share most first tokens, whatever their order; links bring together near copies only."""
    r = random.Random(5)
    words = [f"word{i}" for i in range(90)]
    rows = [(i, "s", " ".join(r.sample(words, 60))) for i in range(300)]
    rows += [(300 + i, "s", f"{rows[i][2]} more") for i in range(20)]
    forms = dedup._forms(spark.createDataFrame(rows, "id long, subject string, text string"), 1)[1].cache()
    candidates = dedup._by_parts(forms, forms, 0.94, 0.9, True).count()
    assert 20 <= candidates < 1000  # of 51,040 pairs
    assert dedup.similar_forms(forms, forms, 0.94, 0.9).count() == 20


def test_first_of_very_many_near_copies_is_found_without_all_pairs(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(40))
    table = lambda rows: spark.createDataFrame(rows, "id long, subject string, text string")
    # 1 to 5 share links with every row and resemble only one; behind them all 200 are near
    bank = table([(i, "s", f"{base} {'x' * 20} {'y' * 20} {i} z{i}") for i in range(1, 6)] + [(i, "s", f"{base} old{i}") for i in range(10, 210)])
    rows = table([(1000 + i, "s", f"{base} new{i}") for i in range(300)])
    tried = []
    keep = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda candidates, *more: tried.append(candidates.count()) or keep(candidates, *more))
    found = dedup.match_near(rows, bank)
    assert rows_of(found) == [(1000 + i, 10) for i in range(300)]
    assert sum(tried) < 300 * 60  # of 300 * 205 pairs


def test_bitmaps_move_once_for_all_requests_of_a_combination(spark, monkeypatch):
    rows = spark.range(1, 70_001).selectExpr("id", "cast(id % 3 AS string) a", "cast(id % 5 AS string) b")
    asked = [(i, f, v) for i in range(600) for f, v in (("a", str(i % 3)), ("b", str(i % 4)))] + [(600, "a", "0"), (600, "a", "1"), (601, "a", "no")]
    keep = metrics._held_by_all
    folder = tempfile.mkdtemp(prefix="counted-", dir="/tmp")

    def noting(key, combinations, bitmaps):
        with open(f"{folder}/{key[0].as_py()}-{key[1].as_py()}", "a") as out:
            print(combinations.num_rows, bitmaps.num_rows, file=out)
        return keep(key, combinations, bitmaps)

    monkeypatch.setattr(metrics, "_held_by_all", noting)
    found = metrics.available(metrics.facet_bitmaps(rows, ["a", "b"], "id"), spark.createDataFrame(asked, "request_id long, facet string, value string"))
    by_hand = [(i, sum(1 for n in range(1, 70_001) if n % 3 == i % 3 and n % 5 == i % 4)) for i in range(12)]
    assert rows_of(found) == sorted([(i, by_hand[i % 12][1]) for i in range(600)] + [(600, 0), (601, 0)], key=repr)
    counted = [tuple(map(int, line.split())) for name in os.listdir(folder) for line in open(f"{folder}/{name}")]
    assert sum(c for c, _ in counted) == 3 * 14 and sum(b for _, b in counted) == 3 * 8  # three buckets, 14 combinations, 8 values


def test_questions_are_dealt_over_all_cores(spark):
    assert roles.questions(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_output_lines_are_parsed_and_checked_once(spark):
    lines, inputs = enrichment_queries._batch(spark, SF)
    read = spark.sparkContext.accumulator(0)

    def seen(raw):
        read.add(1)
        return raw

    found = enrichment.validate(lines.withColumn("raw", F.udf(seen, "string")("raw")), inputs)
    assert found.filter("accepted").count() > 0 and read.value == lines.count()


def test_strip_takes_every_white_space_from_both_ends_only(spark):
    spaces = [chr(i) for i in range(1, 0x10000) if chr(i).isspace() and not 0x1C <= i <= 0x1F]
    rows = spark.createDataFrame([(f"{c}{c}a{c}b {c}\n",) for c in spaces] + [("",), (None,), (" \n",)], "t string")
    stripped = rows_of(rows.select(text.strip(F.col("t"))))
    assert stripped == sorted([(f"a{c}b",) for c in spaces] + [("",), (None,), ("",)], key=repr)
    plan = rows.select(text.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # a pattern walks through the whole text


def test_questions_without_a_group_are_not_one_task(spark):
    """Sizes that a join by group would bring: all questions without a group have the same key there, null."""
    members = spark.createDataFrame([(f"g{i // 3}", i, i % 3) for i in range(300)], "group_id string, question_id long, group_order int")
    eligible = spark.range(4000).selectExpr("id % 40 request_id", "id question_id", "id position")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        units = quiz.build_units(eligible, members, any_member=True).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    held = Counter(u.task for u in units if u.type == "question")
    assert sum(held.values()) == 3700 and max(held.values()) < 1300


def test_eligible_questions_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(roles, "PART_ROWS", 300)
    parts = roles.parts(roles.read(spark, SF, "lineitem"))
    assert parts > 15
    units = registry.QUERIES["quiz_units"](spark, SF)
    assert units.rdd.getNumPartitions() == parts
    assert not differences(spark, registry.QUERIES["quiz_units"], registry.ORACLES["quiz_units"], SF)
