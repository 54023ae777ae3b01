"""Audits of the registry of sites: what fails and why, entries that are no bureaus, parents that are read by hand.

Registry entries: code, name, list_url, notes (an array); further columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link labels that were taken for bureaus' names; what marks an entry without posts; how a reason says that the list itself is missing.
JUNK_NAMES = (
    "通知公告", "纳税咨询", "办税指南", "办税日历", "优化营商", "时政要闻", "银税互动", "发票举报", "互动交流", "意见征集", "新闻动态", "热点问答",
    "纳税人学堂", "基层动态", "我要查询", "隐私声明", "媒体视点", "专题专栏", "下载中心", "长者专区", "三分局市税务局")
NO_POSTS = "NO_APPT"
LIST_MISSING = "站点无"


def counted(sites: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Sites with the number of rows that each table (name: table and its column of codes) has of them; 0 for none.

    Rows are counted before the join, which then has one row a code.
    """
    def beside(out: DataFrame, item: tuple[str, tuple[DataFrame, str]]) -> DataFrame:
        name, (rows, column) = item
        n = rows.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias(name))
        return out.join(n, "code", "left").withColumn(name, F.coalesce(name, F.lit(0)))

    return reduce(beside, tables.items(), sites)


def _listed() -> Column:
    return F.coalesce(F.col("list_url"), F.lit("")) != ""


def failures(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Sites (list_url, events, notices, heads) with failure, why nothing was found, and monitoring, whether to look again.

    known: codes of sites known to publish no appointments. A site without data counts as failed only where its list had heads.
    """
    rows = sites.join(known.select("code").distinct().withColumn("_known", F.lit(True)), "code", "left")
    bare = (F.col("events") == 0) & (F.col("notices") == 0)
    failure = F.when(F.col("_known"), "known_no_appt").when(bare & ~_listed(), "no_url_no_data").when(bare & (F.col("heads") == 0), "zero_appt_data").otherwise("real_failure")
    monitoring = F.when(F.col("_known"), "known").when(~_listed(), "no_url").when(bare, "zero_data").otherwise("monitor")
    return rows.withColumns({"failure": failure, "monitoring": monitoring}).drop("_known")


def is_junk(code: Column, name: Column, codes: list[str] = ()) -> Column:
    """Whether an entry is no bureau: one of a few given codes, or named by a link's label."""
    listed = F.coalesce(code.isin(*codes), F.lit(False)) if codes else F.lit(False)
    return listed | F.coalesce(name.rlike("|".join(JUNK_NAMES)), F.lit(False))


def pruned(entries: DataFrame, empty: DataFrame, named: dict[str, str] | None = None, codes: list[str] = ()) -> DataFrame:
    """Entries without junk. Those known to be without posts get this and the reason as notes, once each, and lose their
    list's address where the list itself is missing; the address of an empty list stays, to be looked at again.

    empty: code, reason, one row a code. named: reasons by a part of the name, for codes that empty doesn't have.
    """
    rows = entries.where(~is_junk(F.col("code"), F.col("name"), codes)).join(empty.select("code", F.col("reason").alias("_reason")), "code", "left")
    by_name = [F.when(F.col("name").contains(part), F.lit(reason)) for part, reason in (named or {}).items()]
    rows = rows.withColumn("_reason", F.coalesce("_reason", *by_name))
    notes = F.coalesce("notes", F.array().cast("array<string>"))
    lacks = lambda note: F.filter(F.array(note), lambda n: ~F.coalesce(F.array_contains(notes, n), F.lit(False)))
    marked = F.concat(notes, lacks(F.lit(NO_POSTS)), lacks(F.col("_reason")))
    rows = rows.withColumns({
        "list_url": F.when(~F.coalesce(F.col("_reason").startswith(LIST_MISSING), F.lit(False)), F.col("list_url")),
        "notes": F.when(F.col("_reason").isNotNull(), marked).otherwise(notes)})
    return rows.select(*entries.columns)


def by_hand(parents: DataFrame, files: DataFrame, manual: list[str]) -> DataFrame:
    """Parents (code) with skipped: whether they are read by hand and files (parent, path below its folder) hold such pages."""
    page = F.col("path").rlike(r"^(?:ingest_report\.json|[^/]*\.html|[^/]+/manifest\.json)$")
    filled = files.where(page & F.col("parent").isin(*manual)).select(F.col("parent").alias("code")).distinct().withColumn("skipped", F.lit(True))
    return parents.join(filled, "code", "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
