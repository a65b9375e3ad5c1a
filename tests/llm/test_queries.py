import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from itemforge.llm import common, decontaminate, language, line_dedup
from itemforge.llm.common import table
from itemforge.llm.queries import ORACLES, QUERIES
from tests.conftest import rows_of
from tests.llm.test_operators import ODD, ODD_IDS, dedup_by_hand, frame, links_by_hand, near_copies
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert not differences(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_a_row_for_each_input_row(spark, name):
    source = "pages" if name in ("op9_html_extraction", "page_languages") else "documents"
    assert QUERIES[name](spark, SF).count() == table(spark, SF, source).count()


def test_stages_equal_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(kept) == {i for i, t in rows if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            wanted = {i: t for i, t, _, dropped in dedup_by_hand(rows) if not dropped or t.strip(line_dedup.SPACES)}
            assert {i: r.text for i, r in kept.items()} == wanted
        elif name == "jaccard_join":
            assert set(kept) == {c for _, c, _ in links_by_hand(rows)}
        elif name == "decontamination":
            windows = [tuple(w[i : i + n]) for r in table(spark, SF, "benchmark").collect() if (w := decontaminate.words_of(r.text)) for n in [min(10, len(w))] for i in range(len(w) - n + 1)]
            sizes, known = {len(w) for w in windows}, set(windows)
            hit = lambda w: any(tuple(w[i : i + n]) in known for n in sizes for i in range(len(w) - n + 1))
            assert set(kept) == {i for i, t in rows if not hit(decontaminate.words_of(t))}
        else:
            assert set(kept) == {i for i, _ in rows} and all(r.lossless for r in kept.values())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)


def test_run_applies_every_stage(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() <= table(spark, SF, "documents").count()


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = frame(spark, [*ODD, "some words here", "some words here"], [*ODD_IDS, 20, None])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: rows_of(df, "doc_id", "text")
    wanted = {
        "language_id": [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)],
        "line_dedup": [(i, t) for i, t, _, dropped in dedup_by_hand(rows) if not dropped or t.strip(line_dedup.SPACES)],
        "decontamination": rows,
    }
    for name, left in wanted.items():
        assert pairs(stages[name](spark, docs, SF)) == sorted(left, key=repr)
    kept = pairs(stages["jaccard_join"](spark, docs, SF))
    assert [r for r in kept if r[0] is None] == sorted((r for r in rows if r[0] is None), key=repr)
    assert {i for i, _ in kept if i is not None} == {c for _, c, _ in links_by_hand([r for r in rows if r[0] is not None])}
    pieces = stages["sentence_pieces"](spark, docs, SF).collect()
    assert len(pieces) == len(rows) and all(r.lossless for r in pieces)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert name == "sentence_pieces" or set(stage(spark, docs.limit(0), SF).columns) == set(corpus_pipeline.COLUMNS)


def test_near_copies_left_by_the_pipeline(spark):
    """Of planted groups of near copies, exact copies and texts of their own, one row a group stays, whatever line dedup took."""
    rows = near_copies(12, groups=8, size=6)
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = common.stored(stage(spark, docs, SF), name)
    left = {r.doc_id for r in docs.collect()}
    assert left == {c for _, c, _ in links_by_hand(rows)}


def test_identified_languages_are_what_follows_is_told(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    wrong = docs.withColumn("lang", F.when((F.col("doc_id") % 50 == 3) & (F.length("text") > 300), F.when(F.col("lang") == "de", "fr").otherwise("de")).when(F.col("doc_id") % 50 == 4, None).otherwise(F.col("lang")))
    found = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, wrong, SF).collect()}
    told = language.identify(wrong, "doc_id", "lang", "source").filter("NOT rejected").collect()
    assert found == {r.doc_id: r.language for r in told}
    planted = [(r.doc_id, r.lang) for r in docs.filter("doc_id % 50 = 3 AND length(text) > 300").collect() if r.doc_id in found]
    assert planted and sum(found[i] == lang for i, lang in planted) > 0.9 * len(planted)
