"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived (a string that matches must hold the
trigrams). The index of a block of documents has a posting list for every trigram that the queries name; the lists
are united and intersected as the query says, and only the documents left are verified with the expression. A rule
without mandatory trigrams is verified on every document. Trigrams are of UTF-8 bytes with A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from itemforge.llm.common import bound_batches, by_slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group that must have min_chars characters; 0 is the whole match.
    group: int = 0
    min_chars: int = 1


BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]+=*", 0, 27),
    Rule("webhook", r"https://hooks\.[a-z]+\.com/[A-Za-z0-9/_-]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES

# ---------------------------------------------------------------- queries from expressions
# A query is None (matches anything), ("t", trigram), ("and", queries) or ("or", queries).

_MOST_STRINGS = 64


def _and(parts: list) -> tuple | None:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list) -> tuple | None:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(strings: set[str]) -> tuple | None:
    """Each of the strings' trigrams; None if a string is too short to have one."""
    return _or([_and([("t", raw[i : i + 3]) for i in range(len(raw) - 2)]) for raw in (s.lower().encode() for s in sorted(strings))])


def _walk(node) -> tuple[set[str] | None, tuple | None]:
    """The strings that a parsed expression stands for (lower case; None if too many), and a query it implies."""
    exact: set[str] | None = {""}
    queries: list = []
    pending: set[str] = {""}

    def flush() -> None:
        queries.append(_trigrams(pending))

    for op, arg in node:
        if op is K.LITERAL:
            strings, query = {chr(arg).lower()}, None
        elif op is K.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is K.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is K.RANGE and value[1] - value[0] < 16:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            strings, query = (chars if chars and len(chars) <= 3 else None), None
        elif op is K.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif op is K.BRANCH:
            sides = [_walk(branch) for branch in arg[1]]
            strings = set().union(*(s for s, _ in sides)) if all(s is not None for s, _ in sides) else None
            query = _or([q if s is None else _trigrams(s) for s, q in sides])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                strings, query = strings | {""}, None
            elif low == 0:
                strings, query = None, None
            elif (low, high) != (1, 1):
                query = query if strings is None else _trigrams(strings)
                strings = None
        elif op is K.AT:
            continue
        else:
            strings, query = None, None
        joined = {a + b for a in pending for b in strings} if strings is not None and len(pending) * len(strings) <= _MOST_STRINGS else None
        if joined is None:
            flush()
            queries.append(query if strings is None else _trigrams(strings))
            pending, exact = (strings if strings is not None else {""}), None
        else:
            pending = joined
            queries.append(query)
    if exact is not None:
        exact = pending
    flush()
    return exact, _and(queries)


def trigram_query(pattern: str) -> tuple | None:
    """The Boolean trigram query that every text with a match satisfies; None if the expression has none."""
    return _walk(_parser.parse(pattern))[1]


def query_trigrams(query: tuple | None) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "t" else set().union(*map(query_trigrams, query[1]))


# ---------------------------------------------------------------- index

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class TrigramIndex:
    """Posting lists of a block of documents, for the trigrams that some query names."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray) -> None:
        """wanted: a flag for each of the 2**24 trigrams."""
        self.size = len(texts)
        # three separators, so no trigram spans two documents
        data = np.frombuffer(b"\0\0\0".join(texts).translate(_LOWER), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])))[:-1]
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        codes = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]
        at = np.flatnonzero(wanted[codes])
        pairs = np.unique(codes[at].astype(np.int64) * self.size + np.searchsorted(starts, at, side="right") - 1)
        terms, docs = np.divmod(pairs, self.size)
        edges = np.flatnonzero(np.diff(terms)) + 1
        self.postings = {int(t[0]): d for t, d in zip(np.split(terms, edges), np.split(docs, edges), strict=True) if len(t)}

    def find(self, query: tuple | None) -> np.ndarray:
        """Ascending document numbers that satisfy the query."""
        if query is None:
            return np.arange(self.size)
        if query[0] == "t":
            return self.postings.get(_code(query[1]), np.empty(0, dtype=np.int64))
        found = sorted((self.find(q) for q in query[1]), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.expressions = [re.compile(r.pattern, re.ASCII) for r in rules]
        # a long bare class is scanned by its minimum length; the greedy run it finds is the same
        for i, rule in enumerate(rules):
            if rule.group == 0 and rule.min_chars > 1 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
                self.expressions[i] = re.compile(f"{rule.pattern[:-1]}{{{rule.min_chars},}}", re.ASCII)
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        for query in self.queries:
            self.wanted[[_code(t) for t in query_trigrams(query)]] = True

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule number, end) in code points."""
        index = TrigramIndex([t.encode("utf-8", "surrogatepass") for t in texts], self.wanted)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(zip(self.rules, self.expressions, self.queries, strict=True)):
            for i in index.find(query).tolist():
                for m in expression.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_chars:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per input row: doc_id, n_<kind> for the first three kinds, base_sha256 (their spans) and spans (all).

    Spans are kind:start:end by start and then by the rules' order, comma-joined. Null text counts as empty; a row
    without a match has zero counts and empty spans. Repeated rows give repeated results; other columns are ignored.
    """
    base = len(BASE_RULES)
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in source:
            texts = batch.column(1).to_pylist()
            rows = []
            for a, b in by_slices(texts):
                for spans in scanner.scan([t or "" for t in texts[a:b]]):
                    named = [f"{rules[k].kind}:{start}:{end}" for start, k, end in spans]
                    first = ",".join(n for n, (_, k, _) in zip(named, spans, strict=True) if k < base)
                    rows.append((*(sum(k == i for _, k, _ in spans) for i in range(base)), hashlib.sha256(first.encode()).hexdigest(), ",".join(named)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
