"""Functions of HTML text: entities, tags, paragraphs, clean-up."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.text import strip

# Three tables of named entities, from the narrowest to the widest.
BASIC_ENTITIES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " "}
ARCHIVE_ENTITIES = BASIC_ENTITIES | {"ndash": "-", "mdash": "-", "hellip": "...", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"'}
REVIEW_ENTITIES = ARCHIVE_ENTITIES | {"laquo": "«", "raquo": "»"}


def _numeric(texts: pd.Series) -> pd.Series:
    """Decimal, then hexadecimal references as their characters; code points out of range stay as they are."""

    def char(base: int):
        return lambda m: chr(int(m[1], base)) if int(m[1], base) < 0x110000 and not 0xD800 <= int(m[1], base) < 0xE000 else m[0]

    return texts.str.replace(r"&#(\d+);", char(10), regex=True).str.replace(r"&#[xX]([0-9a-fA-F]+);", char(16), regex=True)


def decode_entities(text: Column, table: Mapping[str, str] = ARCHIVE_ENTITIES) -> Column:
    """Numeric references, then named ones, one pass each: &amp;#39; becomes &#39;. Names match in lower case only.

    The pass over numeric references runs only on texts that hold one; the rest stays in the JVM. An ampersand that a
    name gives is marked until the pass is over, so that it starts no new name.
    """
    numeric = F.pandas_udf(_numeric, "string")
    text = F.coalesce(numeric(F.when(F.contains(text, F.lit("&#")), text)), text)
    marked = reduce(lambda t, e: F.replace(t, F.lit(f"&{e[0]};"), F.lit(e[1])), ((k, v) for k, v in table.items() if k != "amp"), F.replace(text, F.lit("&amp;"), F.lit("")))
    return F.replace(marked, F.lit(""), F.lit("&"))


def strip_tags(html: Column, scripts: bool = True) -> Column:
    """Line ends for breaks and paragraphs, a space for every other tag; scripts and styles go."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ") if scripts else html
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p>\s*<p[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"(?i)</div>\s*<div[^>]*>", "\n") if scripts else text
    return F.regexp_replace(text, r"<[^>]+>", " ")


def tidy(text: Column) -> Column:
    """No zero-width or hard spaces, no spaces at line ends, at most one empty line and one space in a row; trimmed."""
    text = F.replace(F.replace(text, F.lit("​"), F.lit("")), F.lit(" "), F.lit(" "))
    for pattern, to in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def html_to_text(html: Column, table: Mapping[str, str] = ARCHIVE_ENTITIES) -> Column:
    return tidy(decode_entities(strip_tags(html), table))


def paragraphs(html: Column) -> Column:
    """Texts of the closed paragraphs, the whole text where there is none; empty ones go."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    plain = lambda h: tidy(_names_only(strip_tags(h)))
    found = F.filter(F.transform(inner, plain), lambda t: t != "")
    whole = plain(html)
    return F.when(F.size(found) > 0, found).otherwise(F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole)))


def _names_only(text: Column, table: Mapping[str, str] = ARCHIVE_ENTITIES) -> Column:
    """Named references only: a lambda over an array cannot call Python, so callers decode numbers before."""
    marked = reduce(lambda t, e: F.replace(t, F.lit(f"&{e[0]};"), F.lit(e[1])), ((k, v) for k, v in table.items() if k != "amp"), F.replace(text, F.lit("&amp;"), F.lit("")))
    return F.replace(marked, F.lit(""), F.lit("&"))


def strip_answer(explanation: Column) -> Column:
    """Without the heading and the sentence that gives the answer away."""
    text = F.regexp_replace(explanation, r"(?iu)^\s*Пояснення\s*", "")
    text = F.regexp_replace(text, r"(?iu)Правильна відповідь\s*[-:]\s*[A-DА-Г](?:\.[^\n]*)?", "")
    text = F.regexp_replace(text, r"(?iu)Правильна відповідь\s*[-:]\s*[A-DА-Г][^.\n]*(?:\.|\n)?", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def lines_of(text: Column) -> Column:
    """Trimmed lines without a final bar."""
    return F.transform(F.split(text, "\n"), lambda l: F.regexp_replace(strip(l), r"\|$", ""))


def first_line(passage: Column, skipped: tuple[str, ...] = ("Cafes Around the World",), default: str = "the passage") -> Column:
    """The first line that holds text, the second one behind a known title."""
    held = F.filter(lines_of(passage), lambda l: l != "")
    second = F.try_element_at(held, F.lit(2))
    first = F.try_element_at(held, F.lit(1))
    return F.coalesce(F.when(first.isin(*skipped), second), first, F.lit(default))


def clean_passage(passage: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(lines_of(passage), "\n"), r"\n{3,}", "\n\n"))


def fix_options(options: Column, typos: dict[str, str]) -> Column:
    """The options with known typos of a source replaced, and whether one was: a struct of options and fixed."""
    table = F.create_map(*(F.lit(x) for pair in typos.items() for x in pair))
    fixed = F.transform(options, lambda o: F.coalesce(F.try_element_at(table, o), o))
    return F.struct(fixed.alias("options"), (~fixed.eqNullSafe(options)).alias("fixed"))


def fix_words(text: Column, words: dict[str, str]) -> Column:
    """Known misspelt words of a source, as whole words."""
    return reduce(lambda t, w: F.regexp_replace(t, rf"(?<![A-Za-z0-9_]){w[0]}(?![A-Za-z0-9_])", w[1]), words.items(), text)


def strip_noise(line: Column) -> Column:
    """A line of a printed page without form feeds, copyright tails and the legend of marks."""
    line = F.regexp_replace(F.replace(line, F.lit("\f"), F.lit("")), r"©.*$", "")
    return strip(F.replace(line, F.lit("(x) – правильний варіант відповіді на завдання"), F.lit("")))


def between(text: Column, start: str, end: str) -> Column:
    """From the start mark up to the end mark behind it (or to the end), trimmed; null without a start."""
    at = F.instr(text, start)
    rest = F.substr(text, at)
    stop = F.locate(end, rest, len(start) + 1)
    return F.when(at > 0, strip(F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)))
