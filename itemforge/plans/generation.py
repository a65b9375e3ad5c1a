"""Generation of items from concepts, and arrangements of options and difficulties.

concepts: topic, subtopic, term, definition, scenario, action, rationale, and place (their order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import fill, first_true, zero_padded
from itemforge.operators.order import with_places

VARIANTS = 5


def expand_concepts(concepts: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (topic, count, topic_place): item i of a topic takes concept i mod n in variant floor(i / n) mod 5.

    serial numbers the items over all topics in the order of topic_place.
    """
    ranked = concepts.withColumn("ring", F.row_number().over(Window.partitionBy("topic").orderBy("place")) - 1)
    sizes = ranked.groupBy("topic").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("topic_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = targets.withColumn("before", before).join(sizes, "topic")  # one row a topic
    items = wanted.select("topic", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)).alias("i"))
    items = items.select("topic", (F.col("before") + F.col("i")).alias("serial"), (F.col("i") % F.col("n")).alias("ring"), (F.floor(F.col("i") / F.col("n")) % VARIANTS).alias("variant"))
    return items.join(ranked, ["topic", "ring"])


def fill_template(questions: list[str], explanations: list[str]) -> dict[str, Column]:
    """question, answer and explanation of an expanded concept: the caller's sentences of its variant, filled.

    Sentences name the concept's fields in braces: {term}, {definition}, {scenario}, {action}, {rationale}.
    """
    fields = {c: F.col(c) for c in ("term", "definition", "scenario", "action", "rationale")}
    of = lambda sentences: first_true(*((F.col("variant") == i, fill(s, **fields)) for i, s in enumerate(sentences[:-1])), otherwise=fill(sentences[-1], **fields))
    return {"question": of(questions), "answer": answer_field(), "explanation": of(explanations)}


def answer_field() -> Column:
    """The field of a concept that its variant asks for."""
    v = F.col("variant")
    return first_true((v <= 1, F.col("term")), (v == 2, F.col("definition")), (v == 3, F.col("action")), otherwise=F.col("rationale"))


def distractors(items: DataFrame, concepts: DataFrame, count: int = 3) -> DataFrame:
    """items (serial, variant, term, all_place) with `distractors`: the ring positions serial + variant + k of the other concepts.

    The ring without the own term is the whole ring with the places behind it moved up by one. Terms are distinct.
    """
    total = concepts.count()
    ring = concepts.select(F.col("all_place").alias("other_place"), *(F.col(c).alias(f"other_{c}") for c in ("term", "definition", "action", "rationale")))
    at = (F.col("serial") + F.col("variant") + F.col("k")) % (total - 1)
    picks = items.select("serial", "variant", "all_place", F.explode(F.array(*map(F.lit, range(count)))).alias("k")).withColumn("at", at)
    picks = picks.withColumn("other_place", F.col("at") + (F.col("at") >= F.col("all_place")).cast("long")).join(ring, "other_place")
    v = F.col("variant")
    field = first_true((v <= 1, F.col("other_term")), (v == 2, F.col("other_definition")), (v == 3, F.col("other_action")), otherwise=F.col("other_rationale"))
    lists = picks.select("serial", F.struct("k", field.alias("text")).alias("d")).groupBy("serial").agg(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["text"]).alias("distractors"))
    return items.join(lists, "serial")


def rotate_options(options: Column, index: Column) -> Column:
    """The options rotated left by the index."""
    shift = F.pmod(index, F.size(options)).cast("int")
    return F.concat(F.slice(options, shift + 1, F.size(options)), F.slice(options, F.lit(1), shift))


def rotated_answer(options: Column, index: Column) -> Column:
    """Where the first option stands behind rotate_options."""
    return (F.array_position(rotate_options(options, index), F.element_at(options, 1)) - 1).cast("int")


def difficulty_by_index(index: Column) -> Column:
    return first_true((index % 5 == 4, "hard"), ((index % 4 == 0) | (index % 20 == 1), "easy"), otherwise="medium")


def quota_difficulties(total: int, spark_range: DataFrame) -> DataFrame:
    """spark_range (i from 0 to total - 1): a quarter easy, a fifth hard, the rest medium, in the order of (i * 37 + 11) mod total.

    Quota counts round half up. Ranks of equal keys follow i.
    """
    easy, hard = int(total * 0.25 + 0.5), int(total * 0.2 + 0.5)
    value = first_true((F.col("i") < easy, "easy"), (F.col("i") < total - hard, "medium"), otherwise="hard")
    keyed = spark_range.select("i", ((F.col("i") * 37 + 11) % total).alias("key"), value.alias("difficulty"))
    return with_places(keyed, "key", "i", name="position").select("position", "difficulty")


def seed_rows(items: DataFrame, prefix: str, width: int = 3) -> DataFrame:
    """Question rows of items (serial, question, answer, distractors, passage): padded id, rotated options, difficulty."""
    options = F.concat(F.array("answer"), F.col("distractors"))
    return items.withColumns({
        "question_id": F.concat(F.lit(f"{prefix}-"), zero_padded(F.col("serial") + 1, width)),
        "type": F.when(F.coalesce("passage", F.lit("")) != "", "passage_single_choice").otherwise("single_choice"),
        "correct": rotated_answer(options, F.col("serial")),
        "options": rotate_options(options, F.col("serial")),
        "difficulty": difficulty_by_index(F.col("serial")),
    })
