"""Search and browsing: optional predicates, pages with totals, matches of text, as DataFrame steps.

Each predicate is left out where its parameter is None, so that only what is asked for reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.persons import plausible_name
from . import history


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_contains(columns: list[str], q: str) -> Column:
    """Whether one of the columns contains q."""
    found = F.lit(False)
    for c in columns:
        found = found | _text(F.col(c)).contains(q)
    return found


def within_days(day: Column, start: str | None, end: str | None) -> Column:
    """Whether a day (ISO text) is in the range; rows without a day only where there is no lower bound."""
    d = F.substring(_text(day), 1, 10)
    dated = F.lit(True)
    if start is not None:
        dated = dated & (d >= start)
    if end is not None:
        dated = dated & (d <= end)
    return F.when(d == "", F.lit(start is None)).otherwise(dated)


def dated_within(day: Column, start: str | None, end: str | None) -> Column:
    """Whether a day (ISO text) is in the range; never where it is null, whichever bound is given."""
    d = F.substring(day, 1, 10)
    found = day.isNotNull() if start is not None or end is not None else F.lit(True)
    if start is not None:
        found = found & (d >= start)
    if end is not None:
        found = found & (d <= end)
    return F.coalesce(found, F.lit(False))


def issued_day(issued: Column, published: Column) -> Column:
    """The day a notice counts from: when it was issued, else published, else none."""
    return F.coalesce(issued, F.substring(published, 1, 10), F.lit(""))


def same_compact(c: Column, q: str, inside: bool = False) -> Column:
    """Whether a text equals q (or has it inside) when blanks, also wide ones, are left out of both."""
    bare = lambda x: F.translate(x, " 　", "")
    return bare(_text(c)).contains(bare(F.lit(q))) if inside else bare(_text(c)) == bare(F.lit(q))


def title_not_deputy(title: Column, q: str) -> Column:
    """The title itself, or one that contains it but not as its deputy's."""
    return F.coalesce((title == q) | (title.contains(q) & ~title.contains("副" + q)), F.lit(False))


def prefer_exact(rows: DataFrame, title: str | None, dept: str | None) -> DataFrame:
    """The rows that match best: title and department exactly if any do, else the title, else all.

    Only the best quality, one number, is gathered; the rows are not.
    """
    t = F.coalesce(F.col("title") == title, F.lit(False)) if title else F.lit(False)
    d = F.coalesce(F.col("dept") == dept, F.lit(False)) if dept else F.lit(False)
    rows = rows.withColumn("_quality", F.when(t & d, 2).when(t, 1).otherwise(0))
    return beside(rows, rows.agg(F.max("_quality").alias("_best"))).where("_quality = _best").drop("_quality", "_best")


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int | None = 50, totals: dict[str, Column] | None = None) -> DataFrame:
    """A page of rows in order, with total, the number of all rows; limit None or 0 gives all from the offset on.

    totals: more aggregates over all rows, as columns. A page comes out of one pass over rows: the numbers are observed while its
    rows (at most offset + limit of each task) are found, so it is made when this is called.
    """
    sums = {"total": F.count(F.lit(1)), **(totals or {})}
    if not limit:
        out = rows.orderBy(*order)
        return beside(out.offset(offset) if offset else out, rows.agg(*[c.alias(n) for n, c in sums.items()]))
    seen = Observation()
    found = rows.observe(seen, *[c.alias(n) for n, c in sums.items()]).orderBy(*order).offset(offset).limit(limit).collect()
    numbers = seen.get if found else dict.fromkeys(sums, 0)
    return rows.sparkSession.createDataFrame(found, rows.schema).withColumns({n: F.lit(numbers[n]).cast("long") for n in sums})


MOST_CHANGES = 500


def changes_page(rows: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of changes, newest first and undated ones last; limit 0 gives all, but at most MOST_CHANGES."""
    return page(rows, [F.desc(_text(F.col("day"))), F.desc("id")], offset, limit or MOST_CHANGES)


def changes(events: DataFrame, types: list[str] | None = None, bureaus: list | None = None, start: str | None = None, end: str | None = None, q: str | None = None) -> DataFrame:
    """Events with prev_title, prev_dept and change_type; only those asked for, and of people whose name can be one.

    A type follows from the person's rows before, so bureaus and names reach the scan, days and texts only what comes after.
    """
    events = events.where(plausible_name(F.col("person")))
    if bureaus is not None:
        events = events.where(F.col("bureau").isin(*bureaus))
    text = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    kind = titles.classify_change(F.col("action"), F.col("title"), F.col("dept"), text("notice_title"), text("clause"), F.col("prev_title"), F.col("prev_dept"))
    rows = history.with_previous(events).withColumn("change_type", kind)
    if start is not None or end is not None:
        rows = rows.where(dated_within(F.col("day"), start, end))
    if q:
        rows = rows.where(any_contains([c for c in ("person", "title", "dept", "notice_title") if c in rows.columns], q))
    return rows.where(F.col("change_type").isin(*types)) if types else rows


def people(events: DataFrame, units: DataFrame, title: str | None = None, dept: str | None = None, name: str | None = None, levels: list[str] | None = None) -> DataFrame:
    """People with their current posts and units (bureau, unit, level), and sort keys: rank_level, rank_title."""
    rows = history.current_posts(events.where(plausible_name(F.col("person"))))
    if title:
        rows = rows.where(title_not_deputy(F.col("title"), title))
    if dept:
        rows = rows.where(_text(F.col("dept")).contains(dept))
    if name:
        rows = rows.where(F.col("person").contains(name))
    rows = rows.join(units, "bureau", "left")
    if levels:
        rows = rows.where(F.col("level").isin(*levels))
    return rows.withColumns({"rank_level": titles.level_rank(F.col("level")), "rank_title": titles.title_sort_rank(F.col("title"))})


def longest_match(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (text) with key: that of the longest of names (name, key, place) which stands in the text; ties go to the
    first place; null for none.

    Not every text meets every name: a text's parts of the lengths that names have are its keys of an equi-join.
    """
    lengths = [r[0] for r in names.select(F.length("name").alias("n")).where("n > 1").distinct().orderBy("n").collect()]  # a few tens
    part = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    parts = [F.when(F.length("text") >= n, part(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    distinct = texts.select("text").distinct()
    found = distinct.select("text", F.explode(F.array_distinct(F.concat(*parts))).alias("name")) if parts else distinct.select("text", F.lit(None).cast("string").alias("name"))
    best = found.join(names, "name").groupBy("text").agg(F.max_by("key", F.struct(F.length("name"), -F.col("place"))).alias("key"))
    return texts.join(best, "text", "left")


def hits(events: DataFrame, duties: DataFrame, title: str | None = None, dept: str | None = None, name: str | None = None) -> DataFrame:
    """Who answers a search, and why: bureau, person, reasons, sources and roles (sorted).

    A title is looked for in leaders' duties and in events, a department in what leaders supervise (role supervisor) and in
    events' departments and titles (role appointee), a name alone in both. events: bureau, person, title, dept; duties: bureau,
    person, title, departments (array).
    """
    def source(rows: DataFrame, name_: str, found: list[tuple[Column, Column, str | None]]) -> DataFrame:
        made = [F.when(F.coalesce(cond, F.lit(False)), F.struct(reason.alias("reason"), F.lit(role).cast("string").alias("role"))) for cond, reason, role in found]
        rows = rows.where(plausible_name(F.col("person")) & (F.col("person").contains(name) if name else F.lit(True)))
        return rows.select("bureau", "person", F.lit(name_).alias("source"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("why"))

    said = lambda kind, c: F.concat(F.lit(kind + ":"), F.coalesce(c, F.lit("")))
    of_leaders, of_events = [], []
    if title:
        of_leaders.append((title_not_deputy(F.col("title"), title), said("leader_title", F.col("title")), None))
        of_events.append((title_not_deputy(F.col("title"), title), said("event_title", F.col("title")), None))
    if dept:
        of_leaders.append((F.exists("departments", lambda d: d.contains(dept)), F.lit("supervises:" + dept), "supervisor"))
        of_events += [(_text(F.col("dept")).contains(dept), said("event_dept", F.col("dept")), "appointee"), (_text(F.col("title")).contains(dept), said("event_title_dept", F.col("title")), "appointee")]
    if name and not title and not dept:
        of_leaders.append((F.lit(True), F.lit("leader_name"), None))
        of_events.append((F.lit(True), F.lit("event_name"), None))
    rows = source(duties, "leader", of_leaders).unionByName(source(events, "event", of_events))
    sets = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("bureau", "person").agg(sets("why.reason").alias("reasons"), sets("source").alias("sources"), sets("why.role").alias("roles"))


def people_found(events: DataFrame, duties: DataFrame, sites: DataFrame, title: str | None = None, dept: str | None = None, name: str | None = None, level: str | None = None,
                 bureaus: list | None = None, start: str | None = None, end: str | None = None, role: str | None = None) -> DataFrame:
    """People who answer a search, with their unit and current post, and whether they are in one.

    Without title, department and name these are all people who have an event or a duty. Days ask for an event in the range; leaders who were
    found by what they supervise need none. Sort keys: rank_level, rank_title. sites: bureau, unit, level.
    """
    if bureaus is not None:
        events, duties = events.where(F.col("bureau").isin(*bureaus)), duties.where(F.col("bureau").isin(*bureaus))
    if title or dept or name:
        found = hits(events, duties, title, dept, name)
    else:
        everyone = events.select("bureau", "person", F.lit("event").alias("source")).unionByName(duties.select("bureau", "person", F.lit("leader").alias("source")))
        none = F.array().cast("array<string>")
        found = everyone.where(plausible_name(F.col("person"))).groupBy("bureau", "person").agg(F.array_sort(F.collect_set("source")).alias("sources")).select("bureau", "person", none.alias("reasons"), "sources", none.alias("roles"))
    if role:
        found = found.where(F.array_contains("roles", role))
    if start is not None or end is not None:
        dated = events.where(dated_within(F.col("day"), start, end)).select("bureau", "person").distinct().withColumn("_dated", F.lit(True))
        found = found.join(dated, ["bureau", "person"], "left").where(F.col("_dated") | F.array_contains("roles", "supervisor")).drop("_dated")
    found = found.join(F.broadcast(sites), "bureau", "left")
    if level:
        found = found.where(F.col("level") == level)
    now = history.people_now(events, duties)
    found = found.join(now, ["bureau", "person"], "left")
    return found.withColumns({"is_current": F.coalesce("is_current", F.lit(False)), "rank_level": titles.level_rank(F.col("level")), "rank_title": titles.title_sort_rank(F.col("title"))})


def people_page(found: DataFrame, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """A page of people_found by rank, with total and current_count, the number of all who are in a post."""
    order = [F.col("rank_level"), F.col("unit"), F.col("rank_title"), F.col("person"), F.col("bureau")]
    return page(found, order, offset, limit, {"current_count": F.count_if("is_current")})
