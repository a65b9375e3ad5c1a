"""Assembly of quizzes: units of questions and groups, selection under a budget, flattening.

requests: request_id, and what the caller filters by. Every request is one group of rows, so requests run in parallel.
eligible: request_id, question_id, position (the order to walk). members: group_id, question_id, group_order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owners(members: DataFrame) -> DataFrame:
    """(question_id, group_id): the last group that lists a question owns it."""
    return members.groupBy("question_id").agg(F.max("group_id").alias("group_id"))


def build_units(eligible: DataFrame, members: DataFrame, any_member: bool = False, parts: int | None = None) -> DataFrame:
    """(request_id, unit_position, type, question_id, group_id, size): units in the order of their first question.

    A group is a unit if all its members are eligible, or with any_member if one is; else its questions are left out.
    parts: tasks that the eligible rows are dealt over, whatever their bytes, so that it bounds the memory of one task.
    """
    sizes = members.groupBy("group_id").agg(F.count("*").alias("group_size"), F.count_distinct("question_id").alias("group_questions"))
    # sizes come with the owner: a later join by group would bring all questions without one to one task
    owned = owners(members).join(sizes, "group_id", "left")
    unit = ["request_id", "group_id", "alone"]
    rows = eligible.select("request_id", "question_id", "position").join(owned, "question_id", "left").withColumn("alone", F.when(F.col("group_id").isNull(), F.col("question_id")))
    rows = rows.repartition(parts, *unit) if parts else rows
    questions = rows.groupBy(*unit, "question_id").agg(F.min("position").alias("position"), F.min("group_size").alias("group_size"), F.min("group_questions").alias("group_questions"))
    units = questions.groupBy(*unit).agg(F.min("position").alias("unit_position"), F.count("question_id").alias("there"), F.min("group_size").alias("group_size"), F.min("group_questions").alias("group_questions"))
    whole = F.col("group_id").isNull() | (F.lit(True) if any_member else F.col("there") == F.col("group_questions"))
    return units.filter(whole).select(
        "request_id", "unit_position", F.when(F.col("group_id").isNull(), "question").otherwise("group").alias("type"), F.col("alone").alias("question_id"), "group_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("size")
    )


def shuffle_key(seed: Column, unit: Column) -> Column:
    """A reproducible random order: sort by this key, then by the unit."""
    return F.md5(F.concat_ws("|", seed.cast("string"), unit))


def select_units(units: DataFrame, budgets: DataFrame, order: str = "unit_position") -> DataFrame:
    """units that fit the budget (request_id, budget): each is taken if it still fits, else passed over.

    Units without questions are no units; a budget of 0 takes none; where nothing fits the first one is taken.
    A request is one row, its units an ordered array. The fold carries the sum and the numbers of the units taken.
    """
    item = F.struct(order, "type", "question_id", "group_id", "size")
    lists = units.filter("size > 0").groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("units"))
    rows = lists.join(budgets.select("request_id", F.col("budget").cast("long").alias("budget")), "request_id").filter("budget > 0")
    # only what fits the budget alone can be taken, and at most `budget` units are: the fold walks these sizes only
    numbered = F.transform("units", lambda u, i: F.struct(u["size"].alias("size"), i.alias("i")))
    fitting = F.filter(numbered, lambda u: u["size"] <= F.col("budget"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("picked"))

    def step(state: Column, unit: Column) -> Column:
        fits = state["sum"] + unit["size"] <= F.col("budget")
        # a full budget leaves the state as it is, so the array is copied at most `budget` times
        return F.when(fits, F.struct((state["sum"] + unit["size"]).alias("sum"), F.array_append(state["picked"], unit["i"]).alias("picked"))).otherwise(state)

    picked = F.aggregate(fitting, start, step, lambda s: s["picked"])
    chosen = rows.withColumn("picked", picked).withColumn("picked", F.when(F.size("picked") == 0, F.array(F.lit(0))).otherwise(F.col("picked")))
    return chosen.select("request_id", F.explode(F.transform("picked", lambda i: F.element_at("units", i + 1))).alias("unit")).select("request_id", "unit.*")


def flatten(units: DataFrame, members: DataFrame, questions: DataFrame, order: str = "unit_position") -> DataFrame:
    """(request_id, place, question_id, group_id, order_in_group, total_in_group): the questions of units, in order.

    Ids that the bank does not know vanish; order and total count those that are there.
    """
    known = questions.select("question_id").distinct()
    alone = units.filter("type = 'question'").select("request_id", order, F.lit(0).alias("member"), "question_id", F.lit(None).cast("string").alias("group_id"))
    grouped = units.filter("type = 'group'").drop("question_id").join(members.select("group_id", "question_id", F.col("group_order").alias("member")), "group_id").select("request_id", order, "member", "question_id", "group_id")
    rows = alone.unionByName(grouped.select(alone.columns)).join(known, "question_id", "left_semi")
    unit = Window.partitionBy("request_id", order)
    walk = Window.partitionBy("request_id").orderBy(order, "member", "question_id")
    in_group = F.col("group_id").isNotNull()
    return rows.select(
        "request_id", F.row_number().over(walk).alias("place"), "question_id", "group_id",
        F.when(in_group, F.row_number().over(unit.orderBy("member", "question_id"))).alias("order_in_group"),
        F.when(in_group, F.count("*").over(unit)).alias("total_in_group"),
    )


def unit_totals(units: DataFrame) -> DataFrame:
    """Questions, units and groups of each request."""
    return units.groupBy("request_id").agg(F.sum("size").alias("questions"), F.count("*").alias("units"), F.count_if(F.col("type") == "group").alias("groups"))


def assemble(eligible: DataFrame, members: DataFrame, questions: DataFrame, budgets: DataFrame, any_member: bool = False, parts: int | None = None) -> DataFrame:
    """Quizzes of requests: units, seeded order (budgets carries seed), selection, flattening."""
    units = build_units(eligible, members, any_member, parts).join(budgets.select("request_id", "seed"), "request_id")
    unit = F.coalesce(F.col("group_id").cast("string"), F.col("question_id").cast("string"))
    shuffled = units.withColumn("unit_position", F.struct(shuffle_key(F.col("seed"), unit).alias("key"), unit.alias("unit")))
    return flatten(select_units(shuffled, budgets), members, questions)
