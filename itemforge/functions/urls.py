"""Functions of addresses, ids and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.text import first_true, stable_hash

# Hosts whose pages are ordered, and the titles of official sets.
ARCHIVE_HOST = "zno.osvita.ua"
OFFICIAL_HOST = "testportal.gov.ua"
SUBJECT_TITLES = {"tznk": "ТЗНК", "english": "Англійська мова", "management": "Управління та адміністрування", "psychology-sociology": "Психологія та соціологія"}
OFFICIAL_TITLES = {
    "management-testportal-yefvv-2024": "ЄФВВ 2024: Управління та адміністрування",
    "psych-soc-testportal-yefvv-2024": "ЄФВВ 2024: Психологія та соціологія",
    "tznk-testportal-demo-2024": "Демонстраційний ЄВІ ТЗНК 2024",
    "english-testportal-demo-2023": "Демонстраційний ЄВІ Англійська мова 2023",
}


def host(url: Column) -> Column:
    """The lower-case host without www., null where the address has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def source_site(source_type: Column, url: Column) -> Column:
    return F.when(source_type == "generated", F.lit("generated")).otherwise(host(F.nullif(url, F.lit(""))))


def infer_year(source_type: Column, item_id: Column, url: Column, tags: Column) -> Column:
    """The first year 20dd of the id, then the address, then the tags; null for generated items. ASCII word bounds."""
    candidates = F.concat(F.array(item_id, F.coalesce(url, F.lit(""))), F.coalesce(tags, F.array().cast("array<string>")))
    years = F.transform(candidates, lambda c: F.nullif(F.regexp_extract(c, r"(?<![A-Za-z0-9_])(20[0-9]{2})(?![A-Za-z0-9_])", 1), F.lit("")))
    return F.when(source_type == "generated", F.lit(None)).otherwise(F.try_element_at(F.filter(years, lambda y: y.isNotNull()), F.lit(1))).cast("int")


def page_offset(url: Column, archive: str = ARCHIVE_HOST) -> Column:
    """The offset of an archive page: 0 for the list page, n for /all/n/, null elsewhere."""
    listed = F.when(F.endswith(url, F.lit("/list.html")), F.lit("0")).otherwise(F.regexp_extract(url, r"/all/([0-9]+)/?$", 1))
    return F.when(F.contains(url, F.lit(archive)), F.try_to_number(F.nullif(listed, F.lit("")), F.lit("999999999"))).cast("long")


def id_suffix(item_id: Column) -> Column:
    """The number behind the last dash of an id."""
    return F.nullif(F.regexp_extract(item_id, r"-([0-9]+)$", 1), F.lit("")).cast("long")


def source_order(item_id: Column, url: Column, position: Column, archive: str = ARCHIVE_HOST, official: str = OFFICIAL_HOST) -> Column:
    """The id's number on official pages; offset * 1000 + number on archive pages; the number, or position + 1."""
    number, offset = id_suffix(item_id), page_offset(url, archive)
    own = F.coalesce(number, position.cast("long") + 1)
    return F.when(F.contains(url, F.lit(official)) & number.isNotNull(), number).when(offset.isNotNull(), offset * 1000 + own).otherwise(own)


def exam_set_id(subject: Column, item_id: Column, source_type: Column, site: Column, url: Column, year: Column, tags: Column, archive: str = ARCHIVE_HOST, official: str = OFFICIAL_HOST) -> Column:
    """The set of an item by its official source or its archive page; null for generated and other items."""
    offset = page_offset(url, archive)
    official_id = first_true(
        ((subject == "management") & item_id.startswith("management-yefvv-2024-"), "management-testportal-yefvv-2024"),
        ((subject == "psychology-sociology") & item_id.startswith("psych-soc-yefvv-2024-"), "psych-soc-testportal-yefvv-2024"),
        ((subject == "tznk") & F.coalesce(F.array_contains(tags, "tznk-demo-2024"), F.lit(False)), "tznk-testportal-demo-2024"),
        ((subject == "english") & F.coalesce(F.array_contains(tags, "english-demo-2023"), F.lit(False)), "english-testportal-demo-2023"),
        otherwise=F.concat(subject, F.lit("-testportal-"), year.cast("string"), F.lit("-"), F.substring(stable_hash(F.coalesce(url, item_id)), 1, 6)),
    )
    archive_id = F.concat(subject, F.lit("-zno-osvita-"), F.coalesce(offset.cast("string"), F.substring(stable_hash(url), 1, 6)))
    return F.when(source_type == "generated", F.lit(None)).otherwise(F.coalesce(F.when((site == official) & year.isNotNull(), official_id), F.when(site == archive, archive_id)))


def exam_set_title(set_id: Column, subject: Column, site: Column, url: Column, archive: str = ARCHIVE_HOST) -> Column:
    name = first_true(*((subject == k, v) for k, v in SUBJECT_TITLES.items()), otherwise=subject)
    offset = page_offset(url, archive)
    return first_true(
        *((set_id == k, v) for k, v in OFFICIAL_TITLES.items()),
        (site == archive, F.concat(F.lit("ZNO Освіта: "), name, F.coalesce(F.concat(F.lit(", архів "), offset.cast("string")), F.lit("")))),
        otherwise=F.concat(name, F.lit(": "), F.coalesce(site, F.lit("джерело"))),
    )


def exam_set_variant(set_id: Column, site: Column, url: Column, archive: str = ARCHIVE_HOST) -> Column:
    offset = page_offset(url, archive)
    return first_true(
        (F.contains(set_id, F.lit("testportal-demo")), "Демонстраційний варіант"),
        (F.contains(set_id, F.lit("testportal-yefvv")), "Офіційна добірка"),
        (site == archive, F.concat_ws(" ", F.lit("Архівна сторінка"), offset.cast("string"))),
    )


def list_url(base: Column, offset: Column) -> Column:
    """The address of the list page at an offset."""
    return F.when(offset == 0, F.concat(base, F.lit("/list.html"))).otherwise(F.concat(base, F.lit("/all/"), offset.cast("string"), F.lit("/")))
