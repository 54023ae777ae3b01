"""Posts' archives straight from events: who holds a department's posts, who held them, and what ended each term.

Within an archive (a bureau's department) a person holds one post at a time: their next appointment ends the one before
(replaced), a leave of theirs ends whatever they hold. A post that one person holds at a time also ends with anybody's next appointment
to it (succeeded). A second appointment on the day of the first takes its place without a term of its own. So a term's end is the
nearest of the person's next event and the post's next appointment, which are two windows over the archive's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.persons import plausible_name
from ..functions.titles import classify_change, several_holders
from ..functions.units import post_department
from .history import is_leave


def _blank(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def keyed(events: DataFrame) -> DataFrame:
    """Events of people whose name can be one, with post_dept: the department, below a named sub-unit if there is one."""
    text = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    return events.where(plausible_name(F.col("person"))).withColumn("post_dept", post_department(F.col("dept"), text("unit"), text("bureau_name")))


def matched(events: DataFrame, bureau, dept: str, title: str | None = None) -> DataFrame:
    """A bureau's keyed events of a department (blanks left out, contained ones too, also in department and title together) and title.

    Where these are of several departments and one is named exactly, only that one's.
    """
    rows = events.where(F.col("bureau") == bureau)
    if title:
        rows = rows.where(F.coalesce("title", F.lit("")).contains(title))
    want = "".join(dept.split())
    own = _blank(F.col("post_dept"))
    rows = rows.where(own.contains(want) | _blank(F.concat(F.coalesce("dept", F.lit("")), F.coalesce("title", F.lit("")))).contains(want))
    exact = rows.select("post_dept").distinct().where(_blank(F.col("post_dept")) == want).limit(1).count()
    return rows.where(own == want) if exact else rows


def terms(events: DataFrame, archive: list[str]) -> DataFrame:
    """The terms of each archive: its keys, person, title, post_dept, id, since, ended_on, end_change_type, is_current.

    events: keyed ones. Rows that repeat a person's act in a post on a day count once, the first.
    """
    again = Window.partitionBy(*archive, "person", "action", F.coalesce("dept", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("day", F.lit(""))).orderBy("id")
    rows = events.withColumn("_again", F.row_number().over(again)).where("_again = 1").withColumns({"_leave": is_leave(events), "_title": F.coalesce("title", F.lit(""))})
    order = [F.coalesce("day", F.lit("")), F.col("id")]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*archive).orderBy(*order)))
    text = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    kind = classify_change(F.col("action"), F.col("title"), F.col("dept"), text("notice_title"), text("clause"), none, none)
    event = F.struct("n", "day", F.col("_leave").alias("leave"), "person", kind.alias("kind"))
    own = F.lead(event).over(Window.partitionBy(*archive, "person").orderBy("n"))
    # From the last event back, so that the frame only grows: one to the end is read anew for each row.
    post = Window.partitionBy(*archive, "post_dept", "_title").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_own": own, "_next": F.min(F.when(~F.col("_leave"), event)).over(post)}).where("NOT _leave")
    end = F.when(several_holders(F.col("title")), F.col("_own")).otherwise(F.least("_own", "_next"))
    rows = rows.withColumn("_end", end)
    mine = F.col("_end.person") == F.col("person")
    again_that_day = mine & ~F.col("_end.leave") & F.col("_end.day").eqNullSafe(F.col("day"))
    why = F.when(F.col("_end.leave"), F.col("_end.kind")).when(mine, "replaced").when(F.col("_end").isNotNull(), "succeeded")
    rows = rows.where(~F.coalesce(again_that_day, F.lit(False)))
    return rows.select(*archive, "person", "title", *[c for c in ("post_dept",) if c not in archive], "id", F.col("day").alias("since"), F.col("_end.day").alias("ended_on"), why.alias("end_change_type"), F.col("_end").isNull().alias("is_current"))


def post_archive(events: DataFrame, bureau, dept: str, title: str | None = None) -> DataFrame:
    """The terms of one archive: those who hold a post first, then past ones, each newest first."""
    found = terms(matched(keyed(events), bureau, dept, title), ["bureau"])
    return found.orderBy(F.desc("is_current"), F.desc(F.coalesce("ended_on", F.lit(""))), F.desc("since"), F.desc("id"))


def archives(events: DataFrame) -> DataFrame:
    """The terms of every bureau's every department."""
    return terms(keyed(events), ["bureau", "post_dept"])
