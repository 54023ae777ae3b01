"""Keys, addresses and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: Column) -> Column:
    """A notice's address: https for http, lower-case host, no fragment, and of the query all but the key xxgkhide.

    An address without a scheme is taken as https. Null for an empty one, so that empty addresses never match each other.
    """
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda kv: (kv != "") & (F.lower(F.split_part(kv, F.lit("="), F.lit(1))) != "xxgkhide"))
    full = F.concat(
        F.when(scheme.isin("", "http"), "https").otherwise(scheme), F.lit("://"), F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), F.regexp_extract(rest, "^[^/?]*([^?]*)", 1),
        F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(text != "", full)


def source_key(url: Column) -> Column:
    """Lower-case host and path alone, without a slash at the end: equal for a page and its variants in a list."""
    text = F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.nullif(F.regexp_replace(F.concat(F.lower(F.regexp_extract(text, "^[^/]*", 0)), F.regexp_extract(text, "^[^/]*(.*)$", 1)), "/+$", ""), F.lit(""))


def person_id(bureau: Column, name: Column) -> Column:
    return F.concat_ws(":", bureau, name)


def post_id(bureau: Column, dept: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", bureau, dept, title)), 1, 16)


def is_day(text: Column) -> Column:
    """Whether a text begins with a real ISO date."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.substring(text, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def title_date(title: Column) -> Column:
    """The date in 2025年12月11日, as ISO text; null for none or an impossible one."""
    parts = [F.regexp_extract(title, "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", i) for i in (1, 2, 3)]
    return F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date").cast("string")


def json_list(text: Column) -> Column:
    """An array of strings, empty where the JSON is bad or missing."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
