"""Where people work: units resolved to registered bureaus, departments' leaders and staff, leaders' departments, profiles.

sites: code, name, level, parent, place (the order that breaks ties). They are a registry of some hundreds of bureaus.
duties: id, bureau, person, title, duty_summary, departments (an array), url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles, units
from . import history, search


def _names(sites: DataFrame) -> DataFrame:
    """name, key, place of registered bureaus: the full name, the short one with and without its last word."""
    short = units.short_name(F.col("name"))
    local = sites.where("level <> 'headquarters'")
    forms = F.array(F.col("name"), F.concat(short, F.lit("税务局")), short)
    rows = local.select(F.explode(forms).alias("name"), F.col("code").alias("key"), "place")
    return rows.groupBy("name").agg(F.min_by("key", "place").alias("key"), F.min("place").alias("place"))


def _units(rows: DataFrame, sites: DataFrame, unit: str = "unit") -> DataFrame:
    """_unit, named for each distinct unit: the code of the bureau whose longest name stands in it, the head's where it is the head."""
    texts = rows.select(F.col(unit).alias("text")).where("text IS NOT NULL").distinct()
    found = search.longest_match(texts, _names(sites)).select(F.col("text").alias("_unit"), F.col("key").alias("_key"))
    found = search.beside(found, sites.where("level = 'headquarters'").agg(F.min("code").alias("_head")))
    return found.select("_unit", F.coalesce("_key", F.when(units.is_head(F.col("_unit")), F.col("_head"))).alias("named"))


def named_bureaus(rows: DataFrame, sites: DataFrame, unit: str = "unit") -> DataFrame:
    """rows with named: the code of the bureau that a unit's text names; null for none."""
    return rows.join(_units(rows, sites, unit), F.col(unit) == F.col("_unit"), "left").drop("_unit")


def _region(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "([一-龥]{2,12}(?:省|市|自治区))", 1), F.lit(""))


def displayed(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """rows (bureau, unit, dept, title) with what is shown of them: org_level and posting_bureau of where they work, category,
    unit_display, region_display, title_display, department_display and head_bucket.

    A unit's own bureau counts before the one that appointed; a local unit that is not registered has its wording's level. What
    a unit's text says is found once for each distinct text, what a bureau shows once for each bureau.
    """
    above = sites.select(F.col("code").alias("parent"), units.short_name(F.col("name")).alias("_above"))
    shown = sites.select("code", "name", "level", "parent", units.short_name(F.col("name")).alias("short")).join(F.broadcast(above), "parent", "left")
    shown = shown.select("code", "name", "level", "short", F.when((F.col("level") == "district") & F.col("_above").isNotNull(), F.col("_above")).otherwise(F.col("short")).alias("region"))
    site = lambda key, prefix: shown.select(F.col("code").alias(key), *[F.col(c).alias(prefix + c) for c in ("name", "level", "short", "region")])
    said = _units(rows, sites).withColumn("_clean", F.nullif(units.posting_unit(F.col("_unit")), F.lit("")))
    said = said.withColumns({"_worded": units.level_of_unit(F.col("_unit")), "_short": F.when(F.col("_clean").isNotNull(), units.short_name(F.col("_clean"))), "_place": _region(F.col("_unit"))})
    said = said.join(F.broadcast(site("named", "_at_")), "named", "left")
    rows = rows.join(said, F.col("unit") == F.col("_unit"), "left").join(F.broadcast(site("bureau", "_own_")), "bureau", "left")
    # Of an appointment by the head office to a unit that is neither the head nor registered, nothing of the head is shown but its name.
    own = F.col("named").isNull() & ~((F.col("_own_level") == "headquarters") & (F.trim(F.coalesce("unit", F.lit(""))) != ""))
    rows = rows.withColumns({
        "org_level": F.coalesce("_at_level", "_worded", "_own_level"), "posting_bureau": F.coalesce("named", "bureau"), "_name": F.coalesce("_at_name", F.when(own, F.col("_own_name"))),
        "unit_display": F.coalesce("_short", "_at_short", "_own_short", F.lit("—")), "region_display": F.coalesce(_region(F.col("dept")), "_place", "_at_region", F.when(own, F.col("_own_region")), "_own_short", F.lit("—"))})
    rows = rows.withColumn("category", units.category(F.col("dept"), F.col("title"), F.col("unit"), F.col("org_level"), F.col("_name")))
    rows = rows.withColumns({"title_display": units.title_display(F.col("title"), F.col("title")), "department_display": units.department_label(F.col("dept")), "category_label": units.category_label(F.col("category"))})
    rows = rows.withColumn("head_bucket", F.when(F.col("org_level") == "headquarters", units.head_bucket(F.col("category"), F.col("dept"), F.col("unit_display"), F.col("unit"))).otherwise(0))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def display_order() -> list[Column]:
    """The order of displayed people: level, place in the head office, unit, title's rank, name, bureau."""
    return [titles.level_rank(F.col("org_level")), F.col("head_bucket"), F.col("unit_display"), titles.title_sort_rank(F.col("title")), F.col("person"), F.col("bureau")]


def own_only(rows: DataFrame, sites: DataFrame, code: str) -> DataFrame:
    """The rows (unit) that are posts of a bureau itself, not of one below it."""
    site = sites.withColumn("short", units.short_name(F.col("name"))).where(F.col("code") == code).agg(*[F.first(c).alias(f"_{c}") for c in ("code", "name", "short", "level")])
    kept = rows.columns
    rows = search.beside(named_bureaus(rows, sites), site).withColumn("_primary", units.primary_bureau(F.col("unit")))
    rows = rows.withColumn("_rest", units.after_bureau(F.col("_primary"), F.col("_short")))
    own = units.in_bureau_itself(*[F.col(c) for c in ("_primary", "_rest", "_name", "_short", "_level", "named", "_code")])
    return rows.withColumn("_own", own).where("_own").select(*kept)


def codes_of_category(sites: DataFrame, category: str, level: str | None = None) -> DataFrame:
    """The codes of the bureaus of a category, and of those whose parent is of it."""
    if category in ("internal", "direct", "dispatched"):
        return sites.where((F.col("level") == "headquarters") & F.lit(level in (None, "headquarters"))).select("code")
    none = F.lit(None).cast("string")
    own = sites.withColumn("_of", units.category(none, none, none, F.col("level"), F.col("name")))
    parent = own.select(F.col("code").alias("parent"), F.col("_of").alias("_above"))
    rows = own.join(F.broadcast(parent), "parent", "left").where((F.col("level") != "headquarters") & ((F.col("_of") == category) | F.coalesce(F.col("_above") == category, F.lit(False))))
    return (rows.where(F.col("level") == level) if level else rows).select("code")


# ---------------------------------------------------------------- departments and their leaders
def department_matches(raw: Column, asked: Column | str, level: Column) -> Column:
    """Whether a department's raw text is the one asked for: holds it, or one of its parts does under its normal name."""
    q = F.lit(asked) if isinstance(asked, str) else asked
    part = lambda p: titles.once(titles.department_name(p, level), lambda name: F.coalesce(p.contains(q) | name.contains(q) | q.contains(name), F.lit(False)))
    return F.coalesce(raw.contains(q), F.lit(False)) | F.exists(titles.split_departments(raw), part) | F.coalesce(titles.department_name(raw, level).contains(q), F.lit(False))


def supervisors(duties: DataFrame, sites: DataFrame, department: str, levels: list[str] | None = None, bureau: str | None = None) -> DataFrame:
    """The leaders in charge of a department: with matched (their departments that match), level, region and parent."""
    if bureau is not None:
        duties = duties.where(F.col("bureau") == bureau)
    site = sites.select(F.col("code").alias("bureau"), "level", "parent", units.short_name(F.col("name")).alias("region"))
    rows = duties.join(F.broadcast(site), "bureau", "left").withColumn("level", units.level(F.col("level")))
    if levels:
        rows = rows.where(F.col("level").isin(*levels))
    return rows.withColumn("matched", F.filter("departments", lambda d: department_matches(d, department, F.col("level")))).where(F.size("matched") > 0)


def latest_duties(duties: DataFrame) -> DataFrame:
    """Each leader's newest duty."""
    return duties.groupBy("bureau", "person").agg(F.max_by(F.struct("id", "title", "duty_summary", "departments", "url"), "id").alias("x")).select("bureau", "person", "x.*")


def overseen(duties: DataFrame, people: DataFrame, name: str, bureau: str | None = None, or_tenure: bool = False) -> DataFrame:
    """The departments that a person of this name is in charge of, by bureau; with or_tenure, where no duty names
    them, the departments of their posts (people: bureau, person, title, dept). Columns: bureau, person, title, departments, source."""
    mine = lambda rows: rows.where((F.col("person") == name) & (F.lit(bureau is None) | (F.col("bureau") == F.lit(bureau))))
    found = latest_duties(mine(duties)).select("bureau", "person", "title", F.coalesce("departments", F.array().cast("array<string>")).alias("departments"), F.lit("leader_duties").alias("source"))
    if not or_tenure:
        return found
    dept = F.nullif(F.trim("dept"), F.lit(""))
    held = mine(people).select("bureau", "person", "title", F.when(dept.isNotNull(), F.array(dept)).otherwise(F.array().cast("array<string>")).alias("departments"), F.lit("person_tenure").alias("source"))
    return first_source(found.unionByName(held), ["leader_duties", "person_tenure"])


def first_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """The rows of the first source that has any. Only its number is gathered."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    return search.beside(rows, rows.agg(F.min(rank).alias("_best"))).where(rank == F.col("_best")).drop("_best")


def with_roles(people: DataFrame, duties: DataFrame) -> DataFrame:
    """People (bureau, person, title, dept) and leaders (departments), with roles: appointee for those with a post, leader for those with duties."""
    held = people.select("bureau", "person", "title", "dept", F.lit(True).alias("_held"))
    led = latest_duties(duties).select("bureau", "person", F.col("title").alias("_title"), "departments", F.lit(True).alias("_led"))
    rows = held.join(led, ["bureau", "person"], "full")
    roles = F.filter(F.array(F.when(F.col("_held"), "appointee"), F.when(F.col("_led"), "leader")), lambda r: r.isNotNull())
    return rows.select("bureau", "person", F.coalesce("title", "_title").alias("title"), "dept", "departments", roles.alias("roles"))


def staff(people: DataFrame, duties: DataFrame, sites: DataFrame, department: str | None = None, levels: list[str] | None = None) -> DataFrame:
    """A department's people with roles and level: those with a post in it, else its leaders; all people without a department."""
    site = sites.select(F.col("code").alias("bureau"), "level")
    rows = with_roles(people, duties).join(F.broadcast(site), "bureau", "left").withColumn("level", units.level(F.col("level")))
    if levels:
        rows = rows.where(F.col("level").isin(*levels))
    if not department:
        return rows
    asked = lambda raw: F.coalesce(department_matches(raw, department, F.col("level")), F.lit(False))
    rows = rows.withColumn("source", F.when(asked(F.col("dept")), "appointee").when(F.exists("departments", asked), "leader"))
    return first_source(rows.where("source IS NOT NULL"), ["appointee", "leader"]).drop("source")


# ---------------------------------------------------------------- profiles
def profile_events(events: DataFrame, sites: DataFrame, bureau: str, name: str) -> DataFrame:
    """A person's events; where their bureau has none, those of the same name in bureaus of its level."""
    level = sites.select(F.col("code").alias("bureau"), "level")
    mine = sites.where(F.col("code") == bureau).select(F.col("level").alias("_level"))
    rows = events.where(F.col("person") == name).join(F.broadcast(level), "bureau", "left").join(F.broadcast(mine), F.col("level") == F.col("_level"), "left")
    own = F.col("bureau") == bureau
    rows = rows.where(own | F.col("_level").isNotNull()).withColumn("source", F.when(own, "own").otherwise("namesake"))
    return first_source(rows, ["own", "namesake"]).drop("level", "_level")


def profile_history(events: DataFrame) -> DataFrame:
    """Events as a profile shows them: n (newest first), the day a post ended, and current for the present one."""
    events = events.withColumn("bureau", F.col("bureau").cast("string"))
    ended = history.spans(events).select("id", "ended_on")
    rows = history.shown(events).join(ended, "id", "left")
    closed = history._first_leave(history.shown(events), False).where("NOT leave AND end IS NULL").select("id", F.lit(True).alias("open"))
    rows = rows.join(closed, "id", "left")
    first = F.min(F.when(F.col("open"), F.col("n"))).over(Window.partitionBy(*history.PERSON))
    return rows.withColumn("current", F.coalesce(F.col("n") == first, F.lit(False))).drop("open")


def tree(links: DataFrame) -> DataFrame:
    """root, path, depth and code of units (code, parent, name); one without a parent, or whose parent isn't there, is a root.

    Units on a circle have no root, and no row.
    """
    return links.sparkSession.sql("""WITH RECURSIVE tops AS (SELECT l.code, l.name FROM {links} l LEFT ANTI JOIN {links} p ON p.code = l.parent),
    t(code, root, path, depth) AS (SELECT code, name, name, 0 FROM tops UNION ALL SELECT l.code, t.root, concat(t.path, ' / ', l.name), t.depth + 1 FROM t JOIN {links} l ON l.parent = t.code)
    SELECT code, root, path, depth FROM t""", links=links)
