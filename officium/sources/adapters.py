"""Lists and registries in the forms that sites give them: XML, JSON, almost-JSON, wrapped HTML; candidates for addresses.

All are expressions over landed texts; nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import HEAD
from ..operators.tables import merge, until
from .notices import text_day

RECORDS = "PAGECOUNT string, REC array<struct<TITLE: string, URL: string, DOCRELTIME: string>>"
DOCS = "docs array<struct<title: string, url: string, time: string>>"


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def _items(rows: DataFrame, items: Column) -> DataFrame:
    """path, at, title, url, day of items; each address of a page once, where it is first; those without a title or address go."""
    rows = rows.select("path", F.posexplode(items).alias("at", "x"))
    rows = rows.select("path", "at", F.trim("x.title").alias("title"), https(F.trim("x.url")).alias("url"), text_day(F.col("x.time")).alias("day")).where("title <> '' AND url <> ''")
    first = rows.groupBy("path", "url").agg(F.min_by(F.struct("at", "title", "day"), "at").alias("f"))
    return first.select("path", "f.at", "f.title", "url", "f.day")


def xml_items(pages: DataFrame) -> DataFrame:
    """Items of XML lists (path, text): RECS with REC of TITLE, URL and DOCRELTIME. Broken XML has none."""
    parsed = pages.withColumn("_r", F.from_xml("text", RECORDS, {"mode": "PERMISSIVE"}))
    return _items(parsed, F.transform("_r.REC", lambda r: F.struct(r["TITLE"].alias("title"), r["URL"].alias("url"), r["DOCRELTIME"].alias("time"))))


def json_items(pages: DataFrame) -> DataFrame:
    """Items of JSON lists (path, text): docs of title, url and time.

    Placeholders that some servers put without double quotes, '###...###', are read as empty texts. From a text that still is
    no JSON the triples of title, url and time are taken by pattern.
    """
    text = F.regexp_replace("text", "'###[^']*###'", '""')
    word = lambda name: f'"{name}"\\s*:\\s*"((?:\\\\.|[^"\\\\])*)"'
    triple = f"{word('title')}[^{{}}]*?{word('url')}[^{{}}]*?{word('time')}"
    found = F.transform(F.regexp_extract_all(text, F.lit(triple), F.lit(0)), lambda m: F.struct(*[F.regexp_extract(m, triple, i).alias(n) for i, n in ((1, "title"), (2, "url"), (3, "time"))]))
    return _items(pages, F.coalesce(F.from_json(text, DOCS)["docs"], found))


def unwrapped(page: Column) -> Column:
    """The HTML in a page's CDATA parts, one after the other; the page itself where it has none."""
    parts = F.regexp_extract_all(page, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), F.lit(1))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(page)


def whole_list(items: DataFrame, size: int, most: int = 40) -> DataFrame:
    """Items (list, page, url) of a list's pages up to its first short page or the second that brings nothing new, as a reader would turn them.

    most is the number of pages that a list may have.
    """
    fresh = items.where(F.col("page") < most).groupBy("list", "url").agg(F.min("page").alias("_first"))
    counts = items.where(F.col("page") < most).groupBy("list", "page").agg(F.count(F.lit(1)).alias("_n"))
    new = fresh.groupBy("list", F.col("_first").alias("page")).agg(F.count(F.lit(1)).alias("_new"))
    before = Window.partitionBy("list").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = counts.join(new, ["list", "page"], "left")
    stop = (F.min("_n").over(before) < size) | (F.count_if(F.col("_new").isNull()).over(before) >= 2)
    pages = until(pages.withColumn("_end", stop), ["list"], [F.col("page")], F.col("_end")).select("list", F.col("page").alias("_first"))
    return fresh.join(pages, ["list", "_first"]).select("list", F.col("_first").alias("page"), "url")


# ---------------------------------------------------------------- registry of sites
SITE = ("code", "name", "level", "parent", "home_url", "list_url", "leader_url", "region")


def _folder(url: Column) -> Column:
    whole = url.contains("?") | url.endswith("/") | url.rlike(r"(?i)\.s?html?$")
    return F.when((url != "") & ~whole, F.concat(url, F.lit("/"))).otherwise(url)


def sites(entries: DataFrame) -> DataFrame:
    """Registry entries (SITE) as sites: what can be read, with the addresses that others imply. Entries without a code or any
    list are left out; a level that isn't city or district becomes city."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    listed, leader = text("list_url"), text("leader_url")
    seed = F.coalesce(F.nullif(listed, F.lit("")), leader)
    home = F.when(text("home_url") != "", text("home_url")).when(seed.contains("/xxgk/"), F.concat(F.regexp_extract(seed, "^(.*)/xxgk/", 1), F.lit("/"))).otherwise(seed)
    rows = entries.where((text("code") != "") & (seed != "")).select(
        text("code").alias("code"), F.coalesce(F.nullif(text("name"), F.lit("")), text("code")).alias("name"), F.when(F.col("level").isin("city", "district"), F.col("level")).otherwise("city").alias("level"), "parent",
        home.alias("home_url"), _folder(listed).alias("list_url"), _folder(leader).alias("leader_url"), "region")
    implied = F.regexp_replace("list_url", "/xxgk/(?:rsrm|rsxx)/", "/xxgk/ldjj/")
    return rows.withColumn("leader_url", F.when(F.col("leader_url") == "", implied).otherwise(F.col("leader_url")))


def merge_sites(old: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (SITE) with new entries: by code, what they give wins."""
    keep = lambda rows: rows.where("code <> ''").select(*SITE)
    return merge(keep(old), keep(new).dropDuplicates(["code"]), ["code"]).drop("state")


def guessed_name(text: Column, code: Column) -> Column:
    """A bureau's name in a link's text, the text where it is short and about taxes, else the code."""
    text = F.trim(F.coalesce(text, F.lit("")))
    named = F.regexp_extract(text, f"((?:{HEAD})?[一-龥]{{2,20}}税务局)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.when((F.length(text) <= 20) & text.contains("税务"), text), code)


def guessed_level(name: Column) -> Column:
    return F.when(name.rlike("[区县旗盟]"), "district").otherwise("city")


def bureau_name(short: Column) -> Column:
    """A city's short name as its bureau's full one."""
    text = F.trim(F.coalesce(short, F.lit("")))
    full = F.when(text.startswith(HEAD), text).otherwise(F.concat(F.lit(HEAD), text))
    return F.when(text == "", "市税务局").when(text.endswith("税务局"), full).when(text.rlike("[区县旗盟市]$"), F.concat(F.lit(HEAD), text, F.lit("税务局"))).otherwise(F.concat(F.lit(HEAD), text, F.lit("市税务局")))


def merge_candidates(found: DataFrame) -> DataFrame:
    """One candidate a code of those found (code, at, name, list_url, leader_url, notes): at is their order.

    An address is replaced by later ones only while the notes so far say that one was guessed or is missing; the last of the
    longest names stays, a bare code only if it was first; notes are kept once each, in order.
    """
    before = Window.partitionBy("code").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    unsure = F.exists(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n.rlike("guessed|missing"))
    rows = found.withColumns({"_open": F.coalesce(F.max(unsure).over(before), F.lit(False)), "_first": F.row_number().over(Window.partitionBy("code").orderBy("at")) == 1})

    def address(c: str) -> Column:
        given = F.coalesce(c, F.lit("")) != ""
        return F.coalesce(F.max_by(F.when(given & F.col("_open"), F.col(c)), F.when(given & F.col("_open"), F.col("at"))), F.min_by(F.when(given, F.col(c)), F.when(given, F.col("at"))))

    fits = F.col("_first") | (F.col("name") != F.col("code"))
    size = F.when(fits, F.struct(F.length(F.coalesce("name", F.lit(""))), "at"))
    made = rows.groupBy("code").agg(F.max_by("name", size).alias("name"), address("list_url").alias("list_url"), address("leader_url").alias("leader_url"))
    notes = found.select("code", "at", F.posexplode("notes").alias("k", "note")).groupBy("code", "note").agg(F.min(F.struct("at", "k")).alias("_at"))
    listed = notes.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "note"))), lambda x: x["note"]).alias("notes"))
    return made.join(listed, "code", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def first_valid(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Per code the first address that is a list: code, url, n_items, rejected, needs_user.

    candidates: code, url, place (of its source, best first). pages (url, n_items, text) as fetched: one is a list if it has
    items, or speaks of 任免 in over 2000 characters. An address of several sources counts at the best of them.
    """
    once = candidates.where("url <> ''").groupBy("code", "url").agg(F.min("place").alias("place"))
    is_list = (F.col("n_items") > 0) | (F.col("text").contains("任免") & (F.length("text") > 2000))
    rows = once.join(pages, "url", "left").withColumn("_ok", F.coalesce(is_list, F.lit(False)))
    best = F.min(F.when(F.col("_ok"), F.struct("place", "url", "n_items"))).alias("b")
    rows = rows.groupBy("code").agg(best, F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("place", "url")))).alias("r"))
    before = F.filter("r", lambda x: F.col("b").isNull() | (x["place"] < F.col("b.place")))
    found = rows.select("code", "b.url", "b.n_items", F.transform(before, lambda x: x["url"]).alias("rejected"), F.col("b").isNull().alias("needs_user"))
    none = candidates.select("code").distinct().join(found, "code", "left_anti")
    return found.unionByName(none.withColumns({"rejected": F.array().cast("array<string>"), "needs_user": F.lit(True)}), allowMissingColumns=True)
