"""Text functions: normal forms, similarity, hashes, slugs, letters, scripts, percentages."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Option letters by alphabet.
LATIN_LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H", "I", "J")
UKRAINIAN_LETTERS = ("А", "Б", "В", "Г", "Д", "Е", "Є", "Ж", "З", "И")
#: The alphabet that explanations without Є are checked by.
OLD_UKRAINIAN_LETTERS = ("А", "Б", "В", "Г", "Д", "Е", "Ж", "З")

#: Fixed value: every character of Unicode's White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize(text: Column) -> Column:
    """Lower case; what is no letter, digit or space becomes a space; runs of spaces become one; trimmed."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def normalize_light(text: Column) -> Column:
    """Lower case, runs of any white space become one space, trimmed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends. Only the ends are looked at, so a long text costs no more than a short one."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_option(text: Column) -> Column:
    """Without a leading (x) mark (Latin or Cyrillic letter, either bracket optional)."""
    return collapse_spaces(F.regexp_replace(text, r"(?iu)^\(?[xх]?\)?\s*", ""))


def clean_final_dot(text: Column) -> Column:
    return F.regexp_replace(collapse_spaces(text), r"\.$", "")


def tokens(normalized: Column) -> Column:
    """The set of tokens of a normal form, as an array."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays, 0 where either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def stable_hash(text: Column) -> Column:
    """First ten hex digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 10)


def slug(text: Column) -> Column:
    """a-z and 0-9 with single dashes between; one dash at either end goes, then the first 60 characters stay."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 60)


def option_letter(subject: Column, index: Column, other: tuple[str, ...] = UKRAINIAN_LETTERS) -> Column:
    """The letter of a zero-based option in the subject's alphabet; its number where letters run out."""
    latin, ukrainian = (F.array(*map(F.lit, a)) for a in (LATIN_LETTERS, other))
    letters = F.when(subject == "english", latin).otherwise(ukrainian)
    return F.coalesce(F.try_element_at(letters, (index + 1).cast("int")), (index + 1).cast("string"))


def whole_percentage(value: Column) -> Column:
    """Rounded half up, towards positive infinity."""
    return F.floor(value + 0.5).cast("long")


def option_mentioned(explanation: Column, option: Column, most: int = 140) -> Column:
    """The option's normal form (its first characters if long) stands in the explanation's; empty options do not."""
    wanted = F.trim(F.substring(normalize(option), 1, most))
    return (wanted != "") & F.contains(normalize(explanation), wanted)


def script_letters(text: Column, script: str) -> Column:
    """Letters of a Unicode script, such as Cyrillic or Latin."""
    return F.length(F.regexp_replace(text, rf"[^\p{{Is{script}}}]", ""))


def mostly_cyrillic(text: Column, share: float = 0.35, least: int = 120) -> Column:
    cyrillic, latin = script_letters(text, "Cyrillic"), script_letters(text, "Latin")
    return (cyrillic >= least) & (cyrillic >= share * (cyrillic + latin))


def first_true(*cases: tuple[Column, str | Column], otherwise: str | Column | None = None) -> Column:
    """The value of the first case that holds."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) or v is None else v
    return reduce(lambda rest, case: F.when(case[0], as_column(case[1])).otherwise(rest), reversed(cases), as_column(otherwise))


def reasons(*cases: tuple[Column, str | Column]) -> Column:
    """The values of all cases that hold, in order."""
    marks = F.array(*(F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in cases))
    return F.filter(marks, lambda m: m.isNotNull())


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def contains_all(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(text, F.lit(w)) for w in words))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def zero_padded(number: Column, width: int) -> Column:
    """The number with leading zeros up to the width; longer numbers stay whole."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def fill(template: str, **values: Column) -> Column:
    """A caller's sentence with {name} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p))
