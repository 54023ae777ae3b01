"""Bureaus and their lists out of links: child sites, kinds of pages, what seeds lead to, the best of several addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adapters import guessed_level, guessed_name
from .notices import list_items
from .staging import staged

# Paths of bureaus' sections, what names a list of appointments or of leaders, parts that are no bureau.
SECTION = r"(?i)/([a-z][a-z0-9]{1,12})/xxgk/(?:rsrm|rsxx|ldjj|ldjs)(?:/|$)"
LIST_HINT, LEADER_HINT = "(?i)人事(?:任免|信息)|任免工作人员|rsrm|rsxx", "(?i)领导(?:简介|介绍)|ldjj|ldjs"
NO_CODES = ("xxgk", "web", "col", "static", "images")
# Titles of rows in lists of appointments: words that keep or drop a row, texts that are sections' names, ends of lists' paths.
KEEP, DROP = "任免|任命|任职|免去|免职", "招录|招聘|体检|公示|面试|成绩|采购|招标|征求意见"
SECTION_NAMES = ("人事任免", "人事信息", "任免", "任职信息", "人事管理")
LIST_ENDS = "(?i)/(?:rsrm|rsxx|jgrs|rsgl|ldjj|ldzl)$"
_DAY = r"^20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?$"


def site_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def resolved(base: Column, href: Column) -> Column:
    """A link's address on its page: absolute, from the site's root, or from the page's folder."""
    folder = F.concat(site_of(base), F.regexp_replace(F.regexp_replace(F.concat(path_of(base), F.lit("")), "^$", "/"), "[^/]*$", ""))
    return F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^[a-zA-Z]+:", 0), href)).when(href.startswith("/"), F.concat(site_of(base), href)).otherwise(F.concat(folder, F.regexp_replace(href, r"^\./", "")))


def appointment_title(title: Column, href: Column) -> Column:
    """Whether a list's row is a notice of appointments, by its title; sections' names and bare days only with a notice's address."""
    text = F.trim(F.coalesce(title, F.lit("")))
    named = (text == "人事任免") & href.rlike(r"(?i)/t\d{8}_\d+\.(?:s?html?|htm)$")
    dated = text.rlike(_DAY) & href.rlike(r"(?i)/(?:rsrm|rsxx|rsgl)(?:/|$).*\.(?:s?html?|htm)|/\d{5,}\.htm")
    return F.when(text.isin(*SECTION_NAMES), named).otherwise(~text.rlike(DROP) & (text.rlike(KEEP) | dated))


def list_address(url: Column) -> Column:
    """Whether an address is a list's, not a notice's."""
    path = F.regexp_replace(F.lower(path_of(url)), "/+$", "")
    return (path == "") | path.rlike(LIST_ENDS)


def list_text(titles: Column) -> Column:
    """Whether a page's titles (array) are a list's: five or more speak of 任免, none appoints."""
    return (F.size(F.filter(titles, lambda t: t.contains("任免"))) >= 5) & ~F.exists(titles, lambda t: t.rlike("任命|免去"))


def appointment_rows(pages: DataFrame) -> DataFrame:
    """path, url, title, day of the rows of lists of appointments: pages (path, base, html), base being the page's address.

    Rows that the title test drops are left out; addresses are the pages' own.
    """
    rows = list_items(pages).join(pages.select("path", "base"), "path")
    rows = rows.where(F.coalesce(appointment_title(F.col("title"), F.col("url")), F.lit(False)))
    return rows.select("path", resolved(F.col("base"), F.col("url")).alias("url"), "title", "day", "at")


def child_sites(links: DataFrame) -> DataFrame:
    """Bureaus that a page's links lead to: code, name, level, home_url, list_url, leader_url, list_found, leader_found, notes.

    links: page_url, href, text, place. Links to the page's own site count whose path has a bureau's section; a bureau's first
    link names it. Addresses that no link names are guessed, and noted.
    """
    rows = links.where("href <> '' AND NOT lower(href) LIKE 'javascript:%'").withColumn("url", resolved(F.col("page_url"), F.col("href")))
    rows = rows.where(site_of(F.col("url")) == site_of(F.col("page_url"))).withColumn("code", F.lower(F.regexp_extract(path_of(F.col("url")), SECTION, 1)))
    rows = rows.where((F.col("code") != "") & ~F.col("code").isin(*NO_CODES))
    hinted = lambda p: F.bool_or(F.lower(path_of(F.col("url"))).rlike(p) | F.coalesce("text", F.lit("")).rlike(p))
    name = guessed_name(F.col("text"), F.col("code"))
    found = rows.groupBy("code").agg(
        F.min_by(name, "place").alias("name"), F.concat(F.min_by(site_of(F.col("url")), "place"), F.lit("/"), F.col("code"), F.lit("/")).alias("home_url"), hinted(LIST_HINT).alias("list_found"), hinted(LEADER_HINT).alias("leader_found"))
    notes = F.filter(F.array(F.when(~F.col("list_found"), "appointment_url_guessed"), F.when(~F.col("leader_found"), "leader_url_guessed")), lambda n: n.isNotNull())
    return found.select("code", "name", guessed_level(F.col("name")).alias("level"), "home_url", F.concat("home_url", F.lit("xxgk/rsrm/")).alias("list_url"), F.concat("home_url", F.lit("xxgk/ldjj/")).alias("leader_url"), "list_found", "leader_found", notes.alias("notes"))


def discovered(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages that seeds (page) lead to over links (page, target), and by how many steps: page, depth. It ends when a step finds nothing new.

    Each round reads the links of the pages that are new, and what is known is only compared, so a round costs what it finds.
    """
    links = staged(links.select("page", "target").distinct(), "links")
    fresh = known = staged(seeds.select("page").distinct().withColumn("depth", F.lit(0)), "reached")
    depth = 0
    while True:
        depth += 1
        step = links.join(fresh.select("page"), "page").select(F.col("target").alias("page")).distinct()
        fresh = staged(step.join(known.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not fresh.limit(1).count():
            return known
        known = known.unionByName(fresh)


def discovered_by_words(words: DataFrame, named: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same where a page leads to all pages of its words: words (page, word), named (target, word).

    A word that is reached gives its pages once, in the round that reaches it, so pages that link to it and pages that it names
    are never paired.
    """
    words, named = staged(words.distinct(), "words"), staged(named.distinct(), "named")
    fresh = known = staged(seeds.select("page").distinct().withColumn("depth", F.lit(0)), "reached")
    said, depth = None, 0
    while True:
        depth += 1
        step = words.join(fresh.select("page"), "page", "left_semi").select("word").distinct()
        new = staged(step if said is None else step.join(said, "word", "left_anti"), "said")
        said = new if said is None else said.unionByName(new)
        step = named.join(new, "word", "left_semi").select(F.col("target").alias("page")).distinct()
        fresh = staged(step.join(known.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not fresh.limit(1).count():
            return known
        known = known.unionByName(fresh)


def best_address(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Per code the address whose page has most rows of a list, the first (by place) of equal ones; null if none has any.

    candidates: code, url, place; pages: url, html. Columns: code, url, score.
    """
    link = r"(?is)<a [^>]*href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
    rows = F.filter(F.regexp_extract_all("html", F.lit(link), F.lit(0)), lambda a: appointment_title(F.regexp_replace(F.regexp_extract(a, link, 2), "<[^>]*>", ""), F.regexp_extract(a, link, 1)))
    scores = pages.select("url", F.size(rows).cast("long").alias("score")).groupBy("url").agg(F.max("score").alias("score"))
    joined = candidates.join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    best = joined.groupBy("code").agg(F.max_by(F.struct("url", "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select("code", F.when(F.col("b.score") > 0, F.col("b.url")).alias("url"), "b.score")
