"""Exact and near duplicates of texts.

rows carry id, subject and text, and where they come in batches an order by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import jaccard, normalize, tokens
from itemforge.operators.order import with_places
from itemforge.sources.scratch import cut

LEAST_CHARS, LENGTH_RATIO, SIMILARITY = 80, 0.9, 0.94


def text_key(text: Column) -> Column:
    """A fixed-width key of a text's normal form."""
    return F.sha2(normalize(text), 256)


def match_exact(rows: DataFrame, bank: DataFrame, last: bool = False) -> DataFrame:
    """rows with matched_id: the first (or last) bank item of the same subject and normal text, null for none."""
    pick = F.max if last else F.min
    known = bank.groupBy("subject", text_key(F.col("text")).alias("form")).agg(pick("id").alias("matched_id"))
    return rows.withColumn("form", text_key(F.col("text"))).join(known, ["subject", "form"], "left").drop("form")


def content_key(passage: Column, options: Column) -> Column:
    """A key of a non-empty passage and its option list; null without a passage."""
    form = normalize(passage)
    return F.when(form != "", F.sha2(F.concat_ws("␟", form, F.array_join(F.transform(options, normalize), "␞")), 256))


def match_content(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """rows with content_id: the first bank item of the same subject, passage and options, null for none."""
    known = bank.groupBy("subject", content_key(F.col("passage"), F.col("options")).alias("key")).agg(F.min("id").alias("content_id")).filter("key IS NOT NULL")
    return rows.withColumn("key", content_key(F.col("passage"), F.col("options"))).join(known, ["subject", "key"], "left").drop("key")


def first_in_batch(rows: DataFrame, form: Column) -> DataFrame:
    """rows with first_id: the smallest id of the same subject and form. A row is the first if it is its own."""
    keyed = rows.withColumn("form", F.sha2(form, 256))
    first = keyed.groupBy("subject", "form").agg(F.min("id").alias("first_id"))
    return keyed.join(first, ["subject", "form"]).drop("form")


def seen_before(rows: DataFrame, form: Column) -> DataFrame:
    """rows with previous_id: the row before with the same subject and form, null for the first."""
    placed = cut(with_places(rows.withColumn("form", F.sha2(form, 256)), "subject", "form", "id"), "placed")
    before = placed.select((F.col("place") + 1).alias("place"), F.struct("subject", "form").alias("key_before"), F.col("id").alias("id_before"))
    # places are unique, so a text that very many rows share meets in no single task
    same = F.col("key_before").eqNullSafe(F.struct("subject", "form"))
    return placed.join(before, "place", "left").withColumn("previous_id", F.when(same, F.col("id_before"))).drop("form", "place", "key_before", "id_before")


def _forms(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their normal form, and each form once with its tokens (copies meet once)."""
    normal = rows.withColumn("normal", normalize(F.col("text"))).filter(F.length("normal") >= least)
    keyed = normal.select("id", "subject", F.sha2("normal", 256).alias("form"), "normal")
    forms = keyed.groupBy("subject", "form").agg(F.min("normal").alias("normal"))
    forms = forms.select("subject", "form", F.length("normal").alias("chars"), F.transform(tokens(F.col("normal")), lambda t: F.xxhash64(t)).alias("tokens"))
    return keyed.select("id", "subject", "form"), forms


#: Tokens that come last in the order of all tokens, the most frequent one at the end, and the forms in which they are counted.
FREQUENT, ORDER_SAMPLE = 1000, 2000


def _prefixes(forms: DataFrame, frequent: list[int], threshold: float, width: float) -> DataFrame:
    """The first tokens of each form in the order of all tokens: those two similar sets share one of them, with its place."""
    common = (F.split(F.lit(",".join(map(str, frequent))), ",") if frequent else F.array()).cast("array<bigint>")  # one constant
    order = F.concat(F.array_sort(F.array_except("tokens", common)), F.array_intersect(common, F.col("tokens")))
    n = F.size("tokens")
    kept = (n - F.ceil(threshold * n - 1e-9) + 1).cast("int")
    rows = forms.filter(n > 0).select("subject", "form", "chars", n.alias("n"), F.floor(F.ln(n.cast("double")) / width).cast("int").alias("class"), F.slice(order, F.lit(1), kept).alias("prefix"))
    return rows.select("subject", "form", "chars", "n", "class", F.posexplode("prefix").alias("place", "token"))


#: Thresholds from which sets meet by equal parts; below, where parts would hold a few tokens only, by their first tokens.
LEAST_BY_PARTS = 0.85
#: Bytes of an Arrow batch of token sets, where the session sets no other bound.
BATCH_BYTES = 4 << 20


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both schemes of each set: the sum of its tokens in every part."""
    for batch in batches:
        n, tokens = batch.column("n").to_numpy(), batch.column("tokens").flatten().to_numpy().view(np.uint64)
        for name in ("own", "next"):
            parts = batch.column(f"{name}_parts").to_numpy().astype(np.int64)
            ends = np.cumsum(parts)
            sums = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
            np.add.at(sums, np.repeat(ends - parts, n) + (tokens % np.repeat(parts, n).astype(np.uint64)).astype(np.int64), tokens)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(sums.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "subject", "chars", "n", f"{name}_scheme")), lists], ["id", "subject", "chars", "n", "scheme", "sums"])


def _parts(forms: DataFrame, threshold: float) -> DataFrame:
    """(link, id, chars, n): links of which two similar sets of a subject share one.

    Sizes fall into classes whose width is the threshold's, so similar sets are of one class or of neighbours. The sets of a scheme,
    a class and the one below it, differ in `most` tokens at most if they are similar. Tokens are dealt over most + 1 parts,
    and each token in which two sets differ spoils one part at most: one part at least is equal in both. A part holds
    (1 + threshold) / (1 - threshold) / 2 tokens on average, so frequent tokens alone make no two sets meet.
    """
    width = 1e-9 - 1.000001 * math.log(threshold)
    n = F.size("tokens")
    own = F.floor(F.ln(n.cast("double")) / width).cast("int")
    most = lambda scheme: F.floor(2 * F.ceil(F.exp((scheme + 1) * F.lit(width)) * (1 + 1e-9)) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)
    rows = forms.filter(n > 0).select(form_id(), "subject", "chars", n.alias("n"), own.alias("own_scheme"), (own + 1).alias("next_scheme"), (most(own) + 1).cast("int").alias("own_parts"), (most(own + 1) + 1).cast("int").alias("next_parts"), "tokens")
    summed = rows.mapInArrow(_sums, "id long, subject string, chars int, n int, scheme int, sums array<long>")
    summed = summed.select("id", "subject", "chars", "n", "scheme", F.posexplode("sums").alias("part", "sum"))
    return summed.select(F.xxhash64("subject", "scheme", "part", "sum").alias("link"), "id", "chars", "n")


def form_id() -> Column:
    return F.xxhash64("subject", "form").alias("id")


def _fits(threshold: float, ratio: float) -> Column:
    """Lengths and set sizes that similar texts have."""
    return (F.least("left_chars", "right_chars") >= ratio * F.greatest("left_chars", "right_chars")) & (F.least("left_n", "right_n") >= (threshold - 1e-9) * F.greatest("left_n", "right_n"))


def _side(side: str, lists: DataFrame) -> DataFrame:
    return lists.withColumnsRenamed({c: f"{side}_{c}" for c in ("form", "id", "chars", "n", "place")})


def _by_parts(left: DataFrame, right: DataFrame, threshold: float, ratio: float, same: bool) -> DataFrame:
    """(left_id, right_id): ids of forms that share a link and fit."""
    fits = _fits(threshold, ratio)
    fits &= F.struct("left_n", "left_id") < F.struct("right_n", "right_id") if same else F.col("left_id") != F.col("right_id")
    lists = _parts(left, threshold)
    return _side("left", lists).join(_side("right", lists if same else _parts(right, threshold)), "link").filter(fits).select("left_id", "right_id").distinct()


def _by_prefixes(left: DataFrame, right: DataFrame, threshold: float, ratio: float, same: bool) -> DataFrame:
    """(left_id, right_id) by prefix filtering: in an order of all tokens that puts frequent ones last, two sets that similar share one
    of the first n - ceil(threshold * n) + 1 of each.

    Any order gives the same pairs, so the frequent tokens are those of a bounded sample of forms, and no token is joined with its frequency.
    Lists of a token are split by classes of set size, whose width is the threshold's; and a token that two sets share first
    leaves min(n - place) tokens at most to share, which must reach what the threshold asks for.
    """
    both = left if same else left.unionByName(right)
    sample = both.select("form", "tokens").orderBy("form").limit(ORDER_SAMPLE)  # forms are digests
    counted = sample.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1").orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    frequent, width = [r.token for r in reversed(counted)], 1e-9 - 1.000001 * math.log(threshold)
    of = lambda side, forms: _side(side, _prefixes(forms, frequent, threshold, width).withColumn("id", form_id()).drop("form"))
    near_classes = F.array(*(F.col("class") + F.lit(k) for k in ((0, 1) if same else (-1, 0, 1))))
    lists = of("left", left).withColumn("class", F.explode(near_classes))
    # as many tokens must be shared as threshold / (1 + threshold) of both sets together
    fits = _fits(threshold, ratio) & (F.least(F.col("left_n") - F.col("left_place"), F.col("right_n") - F.col("right_place")) >= threshold / (1 + threshold) * (F.col("left_n") + F.col("right_n")) - 1e-6)
    fits &= F.struct("left_n", "left_id") < F.struct("right_n", "right_id") if same else F.col("left_id") != F.col("right_id")
    return lists.join(of("right", right), ["subject", "class", "token"]).filter(fits).select("left_id", "right_id").distinct()


def _verified(candidates: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """candidates (left_id, right_id, more) whose token sets reach the threshold, with subject, left_form, right_form and similarity."""
    left_sets = left.select(form_id().alias("left_id"), "subject", F.col("form").alias("left_form"), F.col("tokens").alias("left_tokens"))
    right_sets = right.select(form_id().alias("right_id"), F.col("form").alias("right_form"), F.col("tokens").alias("right_tokens"))
    checked = candidates.join(left_sets, "left_id").join(right_sets, "right_id")
    return checked.withColumn("similarity", jaccard(F.col("left_tokens"), F.col("right_tokens"))).filter(F.col("similarity") >= threshold).drop("left_tokens", "right_tokens")


def similar_forms(left: DataFrame, right: DataFrame, threshold: float, ratio: float) -> DataFrame:
    """(subject, left_form, right_form, similarity) of different forms whose token sets reach the threshold; exact.

    High thresholds meet by equal parts, which only near duplicates share, low ones by first tokens. Of one table
    with itself each pair comes once, the smaller set on the left.
    """
    same = left is right
    _bound_batches(left)
    left = cut(left, "forms")
    right = left if same else cut(right, "forms")
    meet = _by_parts if threshold >= LEAST_BY_PARTS else _by_prefixes
    return _verified(meet(left, right, threshold, ratio, same), left, right, threshold).select("subject", "left_form", "right_form", "similarity")


def _bound_batches(rows: DataFrame) -> None:
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Forms of a link that the first round tries, and by how much more the next ones try.
FIRST_TRIED, MORE_TRIED = 4, 16


def nearest_forms(left: DataFrame, right: DataFrame, threshold: float, ratio: float) -> DataFrame:
    """(subject, form, near_id): forms of the left that are equal or similar to one of the right, and the smallest near_id of those.

    Forms of a link are tried in the order of their near_id, a few in the first round and more in each later one; a form whose
    smallest untried near_id is behind the one it has is done. So a form that resembles very many costs a few comparisons.
    """
    _bound_batches(left)
    left, right = cut(left, "forms"), cut(right, "forms")
    best = cut(left.select("subject", "form").join(right, ["subject", "form"]).select(form_id(), "near_id"), "nearest")
    mine = cut(_side("left", _parts(left, threshold)), "links")
    known = _parts(right, threshold).join(right.select(form_id(), "near_id"), "id").withColumn("place", F.row_number().over(Window.partitionBy("link").orderBy("near_id", "id")))
    known = cut(_side("right", known.join(mine.select("link").distinct(), "link", "left_semi")), "links")
    start, tried = 1, FIRST_TRIED
    while True:
        ahead = known.filter(F.col("right_place") == start).select("link", F.col("near_id").alias("ahead"))
        bound = best.select(F.col("id").alias("left_id"), F.col("near_id").alias("bound"))
        mine = cut(mine.drop("bound").join(ahead, "link").join(bound, "left_id", "left").filter(F.col("bound").isNull() | (F.col("ahead") < F.col("bound"))).drop("ahead"), "links")
        if not mine.limit(1).count():
            break
        window = known.filter(F.col("right_place").between(start, start + tried - 1))
        fits = _fits(threshold, ratio) & (F.col("left_id") != F.col("right_id")) & (F.col("bound").isNull() | (F.col("near_id") < F.col("bound")))
        candidates = mine.join(window, "link").filter(fits).select("left_id", "right_id", "near_id").distinct()
        found = _verified(candidates, left, right, threshold).select(F.col("left_id").alias("id"), "near_id")
        best = cut(best.unionByName(found).groupBy("id").agg(F.min("near_id").alias("near_id")), "nearest")
        start, tried = start + tried, tried * MORE_TRIED
    return left.select("subject", "form", form_id()).join(best, "id").select("subject", "form", "near_id")


def similar_pairs(rows: DataFrame, threshold: float = SIMILARITY, least: int = LEAST_CHARS, ratio: float = LENGTH_RATIO) -> DataFrame:
    """(left_id, right_id, similarity): different forms that are near duplicates, each by its smallest id."""
    keyed, forms = _forms(rows, least)
    first = keyed.groupBy("subject", "form").agg(F.min("id").alias("id"))
    name = lambda side: first.select("subject", F.col("form").alias(f"{side}_form"), F.col("id").alias(f"{side}_id"))
    pairs = similar_forms(forms, forms, threshold, ratio)
    named = pairs.join(name("left"), ["subject", "left_form"]).join(name("right"), ["subject", "right_form"])
    return named.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), F.round("similarity", 9).alias("similarity"))


def match_near(rows: DataFrame, bank: DataFrame, threshold: float = SIMILARITY, least: int = LEAST_CHARS, ratio: float = LENGTH_RATIO) -> DataFrame:
    """(id, near_id): rows with a near duplicate (or equal text) in the bank, and its smallest id."""
    keyed, forms = _forms(rows, least)
    known, known_forms = _forms(bank, least)
    first = known.groupBy("subject", "form").agg(F.min("id").alias("near_id"))
    if threshold >= LEAST_BY_PARTS:
        found = nearest_forms(forms, known_forms.join(first, ["subject", "form"]), threshold, ratio)
    else:
        pairs = similar_forms(forms, known_forms, threshold, ratio).select("subject", "left_form", "right_form")
        equal = forms.join(first, ["subject", "form"]).select("subject", F.col("form").alias("left_form"), F.col("form").alias("right_form"))
        found = pairs.unionByName(equal).join(first.withColumnRenamed("form", "right_form"), ["subject", "right_form"]).groupBy("subject", F.col("left_form").alias("form")).agg(F.min("near_id").alias("near_id"))
    return keyed.join(found, ["subject", "form"]).select("id", "near_id")


def import_decisions(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """rows (id, subject, text, passage, options) with reason and matched_id, null where the row is kept.

    Against the bank: exact text, then same passage and options, then near duplicate; then exact text of a kept
    earlier row of the batch.
    """
    found = match_content(match_exact(rows, bank), bank).join(match_near(rows, bank), "id", "left")
    reason = F.when(F.col("matched_id").isNotNull(), "exact_duplicate").when(F.col("content_id").isNotNull(), "same_passage_and_options").when(F.col("near_id").isNotNull(), "near_duplicate")
    found = found.withColumn("reason", reason).withColumn("matched_id", F.coalesce("matched_id", "content_id", "near_id")).drop("content_id", "near_id")
    kept = first_in_batch(found.filter("reason IS NULL").select("id", "subject", "text"), normalize(F.col("text"))).filter("id <> first_id").select("id", "first_id")
    out = found.join(kept, "id", "left")
    return out.withColumns({"reason": F.coalesce("reason", F.when(F.col("first_id").isNotNull(), "duplicate_in_batch")), "matched_id": F.coalesce("matched_id", "first_id")}).drop("first_id")
