"""Sources and sinks: landed JSON payloads, HTML pages, CSV exports, outbox rows."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.urls import title_date

NOTICE = "bureau_code string, title string, source_url string, published_at string, doc_no string, issuer string, issued_on string, raw_text string"
EVENT = "person_name string, action string, department_raw string, title_raw string, probation_years int, effective_on string, source_url string, notice_title string, raw_clause string"
PAYLOAD = f"bureau string, notices array<struct<{NOTICE.replace(' string', ':string')}>>, events array<struct<{EVENT.replace(' string', ':string').replace(' int', ':int')}>>"


def read_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Notices and events of landed crawl results (JSON arrays of objects)."""
    rows = spark.read.schema(PAYLOAD).option("multiLine", True).json(path)
    notices = rows.select("bureau", F.explode("notices").alias("x")).select("bureau", "x.*")
    return notices, rows.select("bureau", F.explode("events").alias("x")).select("bureau", "x.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path and text of landed HTML files; UTF-8, else GB18030, bad bytes dropped."""

    @F.pandas_udf(StringType())
    def decoded(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            for name in ("utf-8", "gb18030"):
                try:
                    return raw.decode(name)
                except UnicodeDecodeError:
                    pass
            return raw.decode("utf-8", "ignore")

        return content.map(one)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(path).select("path", decoded("content").alias("html"))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as characters; Spark has no function for it."""
    return text.map(lambda s: None if s is None else _html.unescape(s))


def page_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1))


def page_links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit("(?i)<a [^>]*href=\"([^\"#]+)\""), F.lit(1))


def visible_text(page: Column) -> Column:
    """Text without scripts, styles and tags; line breaks at br and block ends."""
    text = F.regexp_replace(page, "(?is)<(script|style)[^>]*>.*?</\\1>", "")
    text = F.regexp_replace(text, "(?i)<br[^>]*>|</(p|div|li|tr|h[1-6])>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "[ \\t\\u3000]+", " "))


_ITEM = r"(?is)<a [^>]*href=\"([^\"#]+)\"[^>]*>(.*?)</a>([^<]*(?:<span[^>]*>[^<]*</span>)?)"


def item_day(url: Column, text: Column) -> Column:
    """A list row's day: as its address has it, else an ISO or a Chinese one in the text beside it; null for none or an impossible one."""
    part = lambda c, p, i: F.regexp_extract(c, p, i)
    art, file, iso, zh = r"/art/(20\d{2})/(\d{1,2})/(\d{1,2})/", r"(?i)/t(20\d{2})(\d{2})(\d{2})_\d+\.(?:s?html?|htm)\b", r"(20\d{2})-(\d{2})-(\d{2})", r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
    day = lambda c, p: F.when(c.rlike(p), F.concat_ws("-", part(c, p, 1), F.lpad(part(c, p, 2), 2, "0"), F.lpad(part(c, p, 3), 2, "0"))).try_cast("date").cast("string")
    return F.coalesce(day(url, art), day(url, file), day(text, iso), day(text, zh), day(url, iso))


def list_items(pages: DataFrame) -> DataFrame:
    """title, url and day of the anchors of list pages (path, html), once per page and url, in page order."""
    got = lambda m, i: F.regexp_extract(m, _ITEM, i)
    found = F.transform(F.regexp_extract_all("html", F.lit(_ITEM), F.lit(0)), lambda m, i: F.struct(got(m, 1).alias("url"), i.alias("at"), got(m, 2).alias("title"), got(m, 3).alias("rest")))
    rows = pages.select("path", F.explode(found).alias("x")).select("path", "x.*")
    first = rows.groupBy("path", "url").agg(F.min(F.struct("at", "title", "rest")).alias("x")).select("path", "url", "x.*")
    return first.select("path", "url", "at", F.regexp_replace(unescape(F.col("title")), r"(?U)<[^>]+>|\s+", "").alias("title"), item_day(F.col("url"), F.col("rest")).alias("day"))


def _labelled(text: Column, label: str) -> Column:
    return text_day(F.regexp_extract(text, f"{label}[:：]?\\s*([0-9]{{4}}[-/.年][0-9]{{1,2}}[-/.月][0-9]{{1,2}})", 1))


def text_day(text: Column) -> Column:
    """The first day written in a text, as ISO text; null for none or an impossible one."""
    part = lambda i: F.regexp_extract(text, "([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", i)
    return F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date").cast("string")


def issued_on(title: Column, text: Column, meta: Column, published: Column) -> Column:
    """The day of a notice: in its title, else as labelled in its text, else the page's, else the list's."""
    return F.coalesce(title_date(title), *[_labelled(text, x) for x in ("发文日期", "发布日期", "发布时间")], text_day(meta), F.substring(published, 1, 10))


def doc_number(raw: Column) -> Column:
    """A document's number such as 沪税任〔2026〕117号, without what stands around it; null for anything else."""
    text = F.regexp_replace(raw, "(?U)\\s+", "")
    found = F.regexp_extract(text, "([一-龥A-Za-z]{2,20}[〔\\[][0-9]{4}[〕\\]][0-9]{1,5}号)", 1)
    return F.nullif(F.when(~found.rlike("打印|微信|字号"), found).otherwise(""), F.lit(""))


def plain_title(title: Column) -> Column:
    """A notice's title without tags and without the decision's day at its end."""
    text = F.regexp_replace(F.regexp_replace(title, "<[^>]*>", ""), "(?U)\\s+", " ")
    return F.trim(F.regexp_replace(text, "\\s*[（(][0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日[）)].*$", ""))


def details(pages: DataFrame) -> DataFrame:
    """path, title, issued_on, doc_no, text of notices' pages (path, html), ready for extract.appointment_events."""
    meta = lambda name: F.nullif(F.regexp_extract("html", f'(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    rows = pages.withColumns({"_text": unescape(visible_text(F.col("html"))), "_title": unescape(F.coalesce(meta("ArticleTitle"), page_title(F.col("html"))))})
    day = issued_on(F.col("_title"), F.col("_text"), meta("PubDate"), F.lit(None).cast("string"))
    return rows.select("path", plain_title(F.col("_title")).alias("title"), day.alias("issued_on"), doc_number(F.col("_text")).alias("doc_no"), F.col("_text").alias("text"))


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def append_outbox(digests: DataFrame, path: str) -> None:
    """Digest rows for a mailer to take; sending is not this engine's work."""
    digests.withColumn("status", F.lit("queued")).write.mode("append").parquet(path)
