import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemforge.functions import html, quality, text, urls
from itemforge.operators import dedup, rules
from itemforge.plans import enrichment, extraction
from tests.conftest import rows_of


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items())).select(column).first()[0]


def test_normal_forms(spark):
    assert one(spark, text.normalize(F.col("t")), t=" Ґанок, «Дім» — 2+2! ") == "ґанок дім 2 2"
    assert one(spark, text.slug(F.col("t")), t="--A b.C--") == "a-b-c"
    assert one(spark, text.clean_option(F.col("t")), t="(x)  so   it is") == "so it is"
    assert one(spark, text.whole_percentage(F.lit(2.5))  , t="") == 3
    assert one(spark, rules.has_duplicate_options(F.col("o")), o=["+", "-"]) is True
    assert one(spark, rules.has_duplicate_options(F.col("o"), strict=False), o=["+", "-"]) is False


def test_entities_go_in_one_pass(spark):
    decode = lambda t: one(spark, html.decode_entities(F.col("t")), t=t)
    assert decode("&amp;#39;") == "&#39;"
    assert decode("&amp;lt;") == "&lt;"
    assert decode("&#39;&#x41;&AMP;&unknown;&nbsp;") == "'A&AMP;&unknown; "


def test_years_and_hosts(spark):
    year = lambda i, u="": one(spark, urls.infer_year(F.lit("public_source"), F.col("i"), F.col("u"), F.lit(None).cast("array<string>")), i=i, u=u)
    assert (year("a-2024-1"), year("a_2024_1"), year("x", "http://h/2019/")) == (2024, None, 2019)
    assert one(spark, urls.host(F.col("u")), u="https://WWW.Example.org/a") == "example.org"


def test_cyrillic_letter_in_the_first_line(spark):
    named = lambda t, letter: one(spark, quality.first_line_names(F.col("t"), F.col("l")), t=t, l=letter)
    assert named("відповідь — A. text", "A") and named("відповідь — Б: text", "Б")
    assert not named("відповідь — Б. text", "Б") and not named("x\n— A", "A")


def test_repair_adds_sections_and_a_summary(spark):
    source = "Тут правильна відповідь — Б:\n1. ключ\na\n2. чому\nb\n3. не інші\nc\n4. правила\nсвій текст\nКоротко\nкінець"
    fixed = one(spark, enrichment.repair(F.col("t"), F.lit("reusable_rules"), F.lit("Б"), F.lit("o"), "нема"), t=source)
    assert "5. Як запам’ятати" in fixed and "Коротко:" in fixed and "свій текст" in fixed
    bare = one(spark, enrichment.repair(F.col("t"), F.lit("no_general_rule"), F.lit("Б"), F.lit("o"), "нема"), t="x")
    assert bare.endswith("Правильна відповідь — Б: «o».")


def test_two_columns_and_marks(spark):
    lines = spark.createDataFrame([(1, 0, "left".ljust(54) + "1. What?", 1), (1, 1, "text".ljust(54) + "(x) yes", 1), (1, 2, "".ljust(54) + "() no", 1)], "doc_id int, line_number int, line string, page int")
    items = extraction.numbered_items(extraction.two_columns(lines)).collect()
    assert [(r.number, r.question, r.options, r.correct) for r in items] == [(1, "What?", ["yes", "no"], 0)]
    assert one(spark, html.between(F.col("t"), "<<", ">>"), t="a << b >> c") == "<< b"


def brute(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(11)
    base = [" ".join(r.sample([f"w{i}" for i in range(60)], 30)) for _ in range(8)]
    texts = []
    for t in base:
        for _ in range(6):
            words = t.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randrange(50)}"
            texts.append(" ".join(words))
    texts += ["", None, texts[0]]
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, subject string, text string")
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    ids = sorted(first.values())
    wanted = [(a, b) for a in ids for b in ids if a < b and min(len(texts[a]), len(texts[b])) >= 0.9 * max(len(texts[a]), len(texts[b])) and brute(texts[a], texts[b]) >= 0.8]
    assert rows_of(dedup.similar_pairs(rows, threshold=0.8), "left_id", "right_id") == sorted(wanted, key=repr) and wanted


@given(st.lists(st.integers(0, 9), max_size=30))
def test_ledger_fold_by_hand(values):
    """The rule that the batch and the stream follow: what is open counts the wrong answers since the last correct one."""
    wrong = 0
    for v in values:
        wrong = 0 if v < 4 else wrong + 1
    assert wrong == next((i for i, v in enumerate(reversed(values)) if v < 4), len(values))
