"""Merging staged questions into a bank: an ordered chain of reasons, where only accepted rows block later ones.

staged: id, subject, question_id, text, candidate (may be merged at all), valid (structure is sound); id gives the order.
bank: question_id, subject, text, and an id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.operators.dedup import match_exact, match_near, similar_pairs, text_key
from itemforge.sources.scratch import cut

REASONS = ("not_reviewed_or_blocked", "invalid_structure", "duplicate_id", "duplicate_question_text", "near_duplicate_question_text")


def greedy_accept(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, accepted): walking the ids upwards and accepting each that shares no key with an accepted one.

    nodes (id), claims (key, id): a key is anything that only one accepted row may hold; an edge is a key of two rows.
    A round finds, by key, the first accepted row and the first two undecided ones. A row behind an accepted one is rejected,
    one without undecided rows before it is accepted, and one with a single undecided row before it has the opposite fate of
    that row, whatever it is: its pointer. Pointers are doubled until they end at rows without one, so that a chain of n rows takes
    about log2(n) steps; a key of n rows costs n rows a round, not their pairs.
    """
    ids = nodes.select("id").distinct()
    open_claims = cut(claims.select("key", "id").distinct(), "claims")
    shared = open_claims.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1").select("key")
    open_claims = cut(open_claims.join(shared, "key"), "claims")
    free = ids.join(open_claims.select("id").distinct(), "id", "left_anti").withColumn("accepted", F.lit(True))
    decided = [free]
    taken = open_claims.select("key").limit(0)  # keys that an accepted row holds
    while open_claims.limit(1).count():
        first = open_claims.groupBy("key").agg(F.min("id").alias("first"))
        marked = open_claims.join(first, "key").join(taken.withColumn("is_taken", F.lit(True)), "key", "left")
        second = marked.filter("id > first").groupBy("key").agg(F.min("id").alias("second"))
        marked = marked.join(second, "key", "left")
        before = F.when(F.col("id") == F.col("first"), 0).when(F.col("id") == F.col("second"), 1).otherwise(2)
        seen = marked.groupBy("id").agg(F.bool_or(F.coalesce("is_taken", F.lit(False))).alias("blocked"), F.max(before).alias("most"), F.min(F.when(before == 1, F.col("first"))).alias("low"), F.max(F.when(before == 1, F.col("first"))).alias("high"))
        state = F.when(F.col("blocked"), False).when(F.col("most") == 0, True)
        only = F.when(state.isNull() & (F.col("most") == 1) & (F.col("low") == F.col("high")), F.col("low"))
        seen = cut(seen.select("id", state.alias("accepted"), only.alias("target")), "seen")
        states = _followed(seen)
        settled = cut(states.filter("accepted IS NOT NULL"), "settled")
        decided.append(settled)
        taken = cut(open_claims.join(settled.filter("accepted").select("id"), "id", "left_semi").select("key").unionByName(taken).distinct(), "taken")
        open_claims = cut(open_claims.join(settled.select("id"), "id", "left_anti"), "claims")
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def _followed(seen: DataFrame) -> DataFrame:
    """(id, accepted) of rows (id, accepted, target): what points to a decided row, also over others, has a state by its distance."""
    rows = seen.select("id", "accepted", "target", F.lit(True).alias("opposite"))
    while rows.filter("target IS NOT NULL").limit(1).count():
        ahead = rows.select(F.col("id").alias("target"), F.col("accepted").alias("fate"), F.col("target").alias("next"), F.col("opposite").alias("turned"))
        step = rows.join(ahead, "target", "left")
        state = F.coalesce("accepted", F.when(F.col("fate").isNotNull(), F.col("fate") != F.col("opposite")))
        follow = F.when(state.isNull(), F.col("next"))
        # over two opposites fates are equal again; what ends at a row that waits for others waits, too
        rows = cut(step.select("id", state.alias("accepted"), follow.alias("target"), F.when(follow.isNotNull(), F.col("opposite") != F.col("turned")).otherwise(F.col("opposite")).alias("opposite")), "pointers")
    return rows.select("id", "accepted")


def merge_decisions(staged: DataFrame, bank: DataFrame, near: bool = True) -> DataFrame:
    """staged with reason, null where the row is merged.

    Equal (question_id, normal text) rows of the staging behave alike, so only the first of them joins the graph and
    the rest follow it: if it is accepted they are duplicates by id, and if it is not they fail for its reason.
    """
    known_ids = bank.select("question_id").distinct().withColumn("id_known", F.lit(True))
    found = match_exact(staged.join(known_ids, "question_id", "left"), bank).withColumnRenamed("matched_id", "text_match").withColumn("form", text_key(F.col("text")))
    near_bank = match_near(staged, bank) if near else staged.select("id", F.lit(None).alias("near_id")).limit(0)
    found = found.join(near_bank, "id", "left")
    early = F.when(~F.col("candidate"), REASONS[0]).when(~F.col("valid"), REASONS[1]).when(F.col("id_known"), REASONS[2]).when(F.col("text_match").isNotNull(), REASONS[3]).when(F.col("near_id").isNotNull(), REASONS[4])
    found = cut(found.withColumn("early", early).select("id", "subject", "question_id", "text", "form", "candidate", "valid", "early"))
    open_rows = found.filter("early IS NULL")
    first = open_rows.groupBy("subject", "question_id", "form").agg(F.min("id").alias("lead"))
    led = open_rows.join(first, ["subject", "question_id", "form"])
    leads = led.filter("id = lead")
    claims = leads.select(F.concat(F.lit("i|"), "question_id").alias("key"), "id", F.lit(0).alias("why"))
    claims = claims.unionByName(leads.select(F.concat_ws("|", F.lit("t"), "subject", "form").alias("key"), "id", F.lit(1).alias("why")))
    if near:
        pairs = similar_pairs(leads.select("id", "subject", "text")).select(F.concat_ws("|", F.lit("n"), "left_id", "right_id").alias("key"), F.explode(F.array("left_id", "right_id")).alias("rep"))
        # a pair stands for its forms; leads of one form share their text's key as well
        forms = leads.select(F.col("id").alias("rep"), "subject", "form")
        near_claims = pairs.join(forms, "rep").join(leads.select("id", "subject", "form"), ["subject", "form"]).select("key", "id", F.lit(2).alias("why"))
        claims = claims.unionByName(near_claims)
    claims = cut(claims, "why")
    decided = cut(greedy_accept(leads, claims), "decided")
    holders = claims.join(decided.filter("accepted").select("id"), "id", "left_semi").groupBy("key").agg(F.min("id").alias("holder"))
    why = claims.join(holders, "key").filter("id > holder").groupBy("id").agg(F.min("why").alias("why"))
    late = decided.join(why, "id", "left").select(F.col("id").alias("lead"), "accepted", "why")
    followed = led.select("id", "lead").join(late, "lead")
    reason = F.when(F.col("id") == F.col("lead"), F.when(~F.col("accepted"), F.element_at(F.array(*map(F.lit, REASONS[2:])), F.col("why") + 1)))
    follower = F.when(F.col("accepted"), REASONS[2]).otherwise(F.element_at(F.array(*map(F.lit, REASONS[2:])), F.col("why") + 1))
    followed = followed.select("id", F.when(F.col("id") == F.col("lead"), reason).otherwise(follower).alias("late"))
    # a row that the bank rules out by its text may be preceded by an accepted one with its id or its text
    taken = leads.join(decided.filter("accepted").select("id"), "id", "left_semi")
    by_id = taken.select("question_id", F.col("id").alias("same_id"))
    by_text = taken.select("subject", "form", F.col("id").alias("same_text"))
    out = found.join(followed, "id", "left").join(by_id, "question_id", "left").join(by_text, ["subject", "form"], "left")
    ruled_out = F.when(F.col("early").isin(*REASONS[3:]) & (F.col("same_id") < F.col("id")), REASONS[2]).when((F.col("early") == REASONS[4]) & (F.col("same_text") < F.col("id")), REASONS[3])
    return out.select("id", "subject", "question_id", "candidate", "valid", F.coalesce(ruled_out, "early", "late").alias("reason"))


def simple_merge(staged: DataFrame, bank: DataFrame) -> DataFrame:
    """merge_decisions without review, structure and near duplicates: known ids and texts are skipped."""
    return merge_decisions(staged.withColumns({"candidate": F.lit(True), "valid": F.lit(True)}), bank, near=False)


def retained(decisions: DataFrame, drop_duplicates: bool = False) -> DataFrame:
    """What stays in staging: every skipped row, or with drop_duplicates those that are no duplicates by id or text."""
    skipped = decisions.filter("reason IS NOT NULL")
    return skipped.filter(~F.col("reason").isin(*REASONS[2:4])) if drop_duplicates else skipped


def file_stats(decisions: DataFrame, staged: DataFrame, file: str = "file") -> DataFrame:
    """By staging file: rows before, merged, and what is left."""
    rows = decisions.join(staged.select("id", file), "id")
    return rows.groupBy(file).agg(F.count("*").alias("before"), F.count_if(F.col("reason").isNull()).alias("merged"), F.count("reason").alias("left"))


def merged_bank(decisions: DataFrame, staged: DataFrame, bank: DataFrame) -> DataFrame:
    """The bank with the merged rows behind it; columns that one side lacks are null."""
    taken = staged.join(decisions.filter("reason IS NULL").select("id"), "id", "left_semi")
    return bank.unionByName(taken, allowMissingColumns=True)


def merge_stats(decisions: DataFrame, before: DataFrame) -> DataFrame:
    """By subject: bank rows before, candidates, merged, skipped, rows after, and rows by reason."""
    merged = F.col("reason").isNull()
    stats = decisions.groupBy("subject").agg(F.count("*").alias("staged"), F.count_if("candidate").alias("candidates"), F.count_if(merged).alias("merged"), F.count_if(~merged).alias("skipped"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))
    out = before.groupBy("subject").agg(F.count("*").alias("before")).join(stats, "subject", "full_outer").na.fill(0)
    return out.withColumn("after", F.col("before") + F.col("merged"))
