"""Small parsers of ids, addresses, names and cells, as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that mark an English document, and the site whose paths are filings.
ENGLISH = r"tiếng anh|english|\(en\)|\ben\b"
SITE, FILING_PATH = "https://cafef.vn", "/du-lieu/"


def clean_url(url: Column, site: str = SITE) -> Column:
    """The address without tracking parameters at its end, made absolute where it is a path."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"\?utm_[^#]*$", "")
    return F.when(bare.startswith("/"), F.concat(F.lit(site), bare)).otherwise(bare)


def url_kind(url: Column, path: str = FILING_PATH) -> Column:
    """cbtt (a filing) by the path's start, else bai_bao (an article)."""
    return F.when(F.coalesce(url, F.lit("")).startswith(path), "cbtt").otherwise("bai_bao")


def accession(compact: Column) -> Column:
    """18 digits as 10-2-6."""
    return F.regexp_replace(compact, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")


def coefficient(cell: Column) -> Column:
    """struct(coef, se, stars) of a cell such as "0.0025* (0.0015)"; null fields where it is none."""
    shape = r"^\s*(-?[\d.]+)(\**)\s*\((-?[\d.]+)\)"
    part = lambda i: F.regexp_extract(cell, shape, i)
    met = cell.rlike(shape)
    return F.struct(
        F.when(met, part(1).try_cast("double")).alias("coef"),
        F.when(met, part(3).try_cast("double")).alias("se"),
        F.when(met, part(2)).alias("stars"),
    )


def fiscal_year(title: Column) -> Column:
    """The last year 20xx that a title names, or null."""
    return F.try_element_at(F.regexp_extract_all(title, F.lit(r"20\d{2}"), F.lit(0)), F.lit(-1)).cast("int")


def language(name: Column) -> Column:
    """en if a file's name says so, else vi."""
    return F.when(F.lower(F.coalesce(name, F.lit(""))).rlike("(?U)" + ENGLISH), "en").otherwise("vi")


def fenced_json(answer: Column, schema: str) -> Column:
    """The JSON object of an answer, which may stand in a code fence or among other words."""
    bare = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(bare.rlike(r"(?s)^\{.*\}$"), bare).otherwise(inner), schema)


def epoch_date(stamp: Column, hours: int = 7) -> Column:
    """Local time of a "/Date(ms)/" stamp, as a timestamp without zone at the given offset."""
    ms = F.regexp_extract(stamp, r"\d+", 0).try_cast("long")
    return F.timestamp_millis(ms + hours * 3_600_000).cast("timestamp_ntz")


def acceptance(stamp: Column, close_hour: int = 16) -> tuple[Column, Column]:
    """(date, after close) of an acceptance time, read to the second and taken as local time."""
    at = F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return F.to_date(at), F.hour(at) >= close_hour
