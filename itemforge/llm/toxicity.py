"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors.

Word and stem counts of a bounded labelled sample give every term its own log-odds with a Dirichlet prior, drawn
towards zero by their standard error; a token scores its log-odds plus GAP, so that the mean score is negative. One
linear scan finds all maximal scoring segments of a document. A segment of score S in a document of n tokens has the
expected number K * n * exp(-lambda * S) by chance (Karlin and Altschul); lambda and K are fitted to the scores of the
sample's clean texts. Segments below EXPECTED are significant. Their evidence is added up and mapped to a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches
from itemforge.llm.labelled import fold, sample

FOLDS, HELD_OUT = 5, 0
#: Bounds of the sample that is fitted: documents a class, and the longest text that may be in it.
PER_CLASS, MOST_CHARS = 8000, 100_000
STEM = 5
PRIOR = 0.5
SHRINK = 2.0  # standard errors by which log-odds are drawn towards zero
LEAST_DOCS, LEAST_SHARE = 4, 0.005
MOST_TERMS = 200_000  # of either sign, those with the most evidence
# GAP, TAIL and SETTLED gave the fewest errors when each of the training folds was scored by a model of the other three.
GAP = -0.02
TAIL = 1.5  # segment scores from here on are held to follow the tail of the extreme-value law
EXPECTED = 0.01
SETTLED = 6.0
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    offset: float = -2.0

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Tokens of the text, and (position, score) of those with log-odds; every other token scores GAP."""
        tokens = WORD.findall(text.lower()) if text else []
        word, stem = self.words.get, self.stems.get
        found = []
        for i, token in enumerate(tokens):
            odds = word(token)
            if odds is None and len(token) > STEM:
                odds = stem(token[:STEM])
            if odds:
                found.append((i, odds + GAP))
        return len(tokens), found

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens, and the maximal segments (first token, end token, evidence)."""
        n, found = self.hits(text)
        base = math.log(self.k * max(n, 1) + 1)
        return n, [(a, b, self.rate * s - base) for a, b, s in segments(found)]

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        n, found = self.passages(text)
        significant = [p for p in found if p[2] >= -math.log(EXPECTED)]
        best = max((p[2] for p in found), default=-math.log(self.k * max(n, 1) + 1) - 3)
        return sum(p[2] for p in significant) if significant else min(best, -math.log(EXPECTED)), significant

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def segments(found: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) of the given scores with GAP for each token between them.

    An entry of the stack keeps the place of the nearest one with a smaller sum before it, so that what a search has
    passed over once is never looked at again; where there is none, all entries are final.
    """
    out: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest smaller
    total, last = 0.0, -1
    for position, score in found:
        before = total + GAP * (position - last - 1)
        total, last = before + score, position
        if score <= 0:
            continue
        start, left = position, before
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0:
                out += [(s[0], s[1], s[3] - s[2]) for s in stack]
                stack = [(start, position + 1, left, total, -1)]
                break
            if stack[k][3] >= total:
                stack.append((start, position + 1, left, total, k))
                break
            start, left, following = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = following
    return out + [(s[0], s[1], s[3] - s[2]) for s in stack]


def _terms(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        sketches, terms, sizes = [], [], []
        for value in batch.column(0):
            tokens = WORD.findall((value.as_py() or "").lower())
            sketches.append(min((zlib.crc32(" ".join(tokens[i : i + 5]).encode()) for i in range(max(1, len(tokens) - 4))), default=0))
            terms.append(list({f"w{t}" for t in tokens} | {f"s{t[:STEM]}" for t in tokens if len(t) > STEM}))
            sizes.append(len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(sketches, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(sizes, pa.int64()), batch.column(1)], ["sketch", "terms", "tokens", "label"])


def log_odds(y1: float, y0: float, n1: float, n0: float) -> float:
    """Log-odds of a term in y1 of n1 and y0 of n0 counts under a Dirichlet prior, SHRINK standard errors nearer zero."""
    a = PRIOR + 0.01 * (y1 + y0)
    odds = math.log((y1 + a) / (n1 - y1 + a)) - math.log((y0 + a) / (n0 - y0 + a))
    return math.copysign(max(0.0, abs(odds) - SHRINK * math.sqrt(1 / (y1 + a) + 1 / (y0 + a))), odds)


def _log_odds(y1, y0, n1: int, n0: int):
    a = PRIOR + 0.01 * (y1 + y0)
    odds = F.log((y1 + a) / (F.lit(n1) - y1 + a)) - F.log((y0 + a) / (F.lit(n0) - y0 + a))
    return F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - SHRINK * F.sqrt(1 / (y1 + a) + 1 / (y0 + a)))


def fit_tail(histogram: dict[float, int], tail: list[float]) -> tuple[float, float]:
    """lambda and K from clean texts: token scores with their counts, and the segment scores of TAIL and more.

    The lambda that makes the mean of exp(lambda * score) one is what the token scores say. The excess over TAIL is
    exponential, so its median says another one; the smaller counts. A few texts that were labelled clean by mistake
    move neither much.
    """
    n = sum(histogram.values())
    scores, shares = np.array(list(histogram), dtype=np.float64), np.array(list(histogram.values()), dtype=np.float64) / max(n, 1)
    low, high = 1e-3, 2.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if float(shares @ np.exp(middle * scores)) < 1 else (low, middle)
    rate = min(low, math.log(2) / max(1e-6, float(np.median([s - TAIL for s in tail]))) if tail else low)
    return rate, (len(tail) + 1) / max(n, 1) * math.exp(rate * TAIL)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, most_terms: int = MOST_TERMS) -> Model:
    """Fit log-odds, extreme-value law and calibration. Near copies in the sample (equal minimal shingle) count once.

    The sample holds at most per_class documents of either class, of at most most_chars characters; the model has at most
    most_terms terms.
    """
    bound_batches(docs.sparkSession)
    texts = sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class, most_chars).select("text", "label")
    rows = texts.mapInArrow(_terms, "sketch long, terms array<string>, tokens long, label int")
    once = rows.groupBy("label", "sketch").agg(F.min_by(F.struct("terms", "tokens"), F.struct("tokens", "terms")).alias("d")).select("label", "d.*").persist()
    docs_of = {r["label"]: r for r in once.groupBy("label").agg(F.count("*").alias("docs"), F.sum(F.size("terms")).alias("n")).collect()}
    model = Model()
    if set(docs_of) != {0, 1}:
        once.unpersist()
        model.offset = 5.0 if 1 in docs_of else -5.0
        return model
    counted = once.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"))
    # a term that tells toxic texts must be in several of them, or it tells one text's topic
    known = (
        counted.withColumn("odds", _log_odds(F.col("y1"), F.col("y0"), docs_of[1]["n"], docs_of[0]["n"]))
        .filter((F.col("odds") < 0) | (F.col("odds") > 0) & (F.col("y1") >= max(LEAST_DOCS, LEAST_SHARE * docs_of[1]["docs"])))
        .orderBy(F.desc(F.abs("odds") * (F.col("y1") + F.col("y0"))), "term")
        .limit(most_terms)
        .select("term", "odds")
        .collect()
    )
    once.unpersist()
    model.words = {r["term"][1:]: r["odds"] for r in known if r["term"][0] == "w"}
    model.stems = {r["term"][1:]: r["odds"] for r in known if r["term"][0] == "s" and r["odds"] > 0}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chance(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token scores and tail segments of clean texts, counted by rounded score."""
        tokens, tail = Counter(), Counter()
        for batch in source:
            for value in batch.column(0):
                n, found = shared.value.hits(value.as_py())
                tokens.update(round(s, 2) for _, s in found)
                tokens[GAP] += n - len(found)
                tail.update(round(s, 2) for _, _, s in segments(found) if s >= TAIL)
        both = [(kind, score, n) for kind, counts in (("token", tokens), ("tail", tail)) for score, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*both, strict=True)) or [[]] * 3, (pa.string(), pa.float64(), pa.int64()), strict=True)], ["kind", "score", "n"])

    # by score and not by text: a few thousand rows
    counts = texts.filter("label = 0").select("text").mapInArrow(chance, "kind string, score double, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).collect()
    model.rate, model.k = fit_tail({r["score"]: r["n"] for r in counts if r["kind"] == "token"}, [r["score"] for r in counts if r["kind"] == "tail" for _ in range(r["n"])])
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([fitted.value.evidence(t.as_py())[0] for t in batch.column(0)], pa.float64()), batch.column(1)], ["x", "label"])

    pairs = texts.mapInArrow(evidence, "x double, label int").collect()  # two numbers a sample text
    model.slope, model.offset = _logistic(np.array([r[0] for r in pairs]), np.array([r[1] for r in pairs], dtype=np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a ridge; evidence is cut at SETTLED, beyond which it says no more."""
    a = np.stack([np.clip(x, -SETTLED, SETTLED), np.ones_like(x)], axis=1)
    w = np.array([0.5, -1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1.0, 1e-2])
        w = w - np.linalg.solve(hessian, a.T @ (p - y) + np.array([1.0, 1e-2]) * (w - [0.5, -1.0]))
    return max(1e-3, float(w[0])), float(w[1])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (token ranges) of every row, by the text alone.

    Null and empty texts have no tokens and no passages. A null doc_id is not held out. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows. A text of any length is scanned whole, in time
    in proportion to it. Without labels of both classes there are no log-odds and the score is constant.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's most_terms
    span = pa.list_(pa.int64())

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out, starts, ends = [], [], []
            for value in batch.column(2):
                x, found = shared.value.evidence(value.as_py())
                out.append(shared.value.probability(x))
                starts.append([f[0] for f in found])
                ends.append([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array(starts, span), pa.array(ends, span)], ["doc_id", "held_out", "score", "passage_starts", "passage_ends"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, "text").mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, passage_starts array<long>, passage_ends array<long>")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
