"""Anomalies and repairs of events, leaders' duties and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.persons import clean_name, plausible_name
from ..functions.titles import compact
from ..functions.urls import canonical_url, is_day, person_id
from . import extract, units

NOISE = "任命|免去|通知|决定|欢迎|试用期"
SEMANTIC = ("bureau", "person", "action", "dept", "title", "day")


def _found(rows: DataFrame, rules: list[tuple[str, str, Column]], target: str) -> DataFrame:
    made = F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for kind, severity, cond in rules])
    rows = rows.withColumn("a", F.explode(F.filter(made, lambda x: x.isNotNull())))
    return rows.select("a.kind", "a.severity", F.lit(target).alias("target_type"), F.col("id").cast("string").alias("target_id"), "bureau", "person")


def event_anomalies(events: DataFrame, today: str) -> DataFrame:
    """A row for each thing wrong with an event: its name, lack of a post, its day, noise in its department."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    given, day = text("day") != "", F.substring("day", 1, 10).try_cast("date")
    real = given & is_day(F.col("day"))
    late = F.datediff(day, F.lit(today).cast("date")) > 365
    dept = F.coalesce("dept", F.lit(""))
    return _found(events, [
        ("implausible_name", "error", ~plausible_name(F.col("person"))), ("missing_fields", "warn", (text("title") == "") & (text("dept") == "")), ("missing_date", "warn", ~given),
        ("bad_date", "warn", given & ~real), ("date_anomaly", "warn", real & (late | (F.year(day) < 1994))), ("parse_noise", "warn", (F.length(dept) > 40) | dept.rlike(NOISE))], "appointment_event")


def leader_anomalies(duties: DataFrame) -> DataFrame:
    """The same for leaders' duties (id, bureau, person, departments_json, duty_summary)."""
    list_ = F.from_json("departments_json", "array<string>")
    given = F.coalesce("departments_json", F.lit("")) != ""
    broken = given & list_.isNull()
    bare = F.coalesce(F.size(list_), F.lit(0)) <= 0
    return _found(duties, [
        ("implausible_name", "error", ~plausible_name(F.col("person"))), ("parse_noise", "warn", broken),
        ("missing_fields", "info", bare & F.coalesce(F.col("duty_summary").isin("分管工作", "分管"), F.lit(False)))], "leader_duty")


def conflicts(events: DataFrame) -> DataFrame:
    """Days on which a person is both appointed and dismissed, in at most two posts: bureau, person, day, first_id, n."""
    rows = events.where(F.coalesce("day", F.lit("")) != "").withColumn("day", F.substring("day", 1, 10))
    post = F.struct(F.coalesce("title", F.lit("")), F.coalesce("dept", F.lit("")))
    made = rows.groupBy("bureau", "person", "day").agg(
        F.bool_or(F.col("action") == "appoint").alias("a"), F.bool_or(F.col("action") == "dismiss").alias("d"), F.count_distinct(post).alias("posts"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return made.where("a AND d AND posts <= 2").select("bureau", "person", "day", "first_id", "n")


def upsert_anomalies(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored anomalies (kind, target_type, target_id, severity, status) with what a new scan found: new ones are open, open ones
    take the new severity, and those that someone handled stay as they are."""
    keys = ["kind", "target_type", "target_id"]
    joined = stored.select(*keys, "severity", "status").join(found.select(*keys, F.col("severity").alias("_new")).dropDuplicates(keys), keys, "full")
    open_ = F.coalesce(F.col("status") == "open", F.lit(True))
    return joined.select(*keys, F.when(open_, F.coalesce("_new", "severity")).otherwise(F.col("severity")).alias("severity"), F.coalesce("status", F.lit("open")).alias("status"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row of each person's act in a post on a day: one with a unit, then the longest clause, then the smallest id.

    A kept row without a unit takes the unit of the first (by id) that has one. events: id, SEMANTIC, unit, clause.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEMANTIC]
    unit = F.nullif(F.trim("unit"), F.lit(""))
    w = Window.partitionBy(*key)
    order = [F.desc(unit.isNotNull()), F.desc(F.length(F.coalesce("clause", F.lit("")))), F.col("id")]
    first = F.min(F.when(unit.isNotNull(), F.struct("id", "unit"))).over(w)["unit"]
    rows = events.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "unit": F.when(unit.isNotNull(), F.col("unit")).otherwise(first)})
    return rows.where("_n = 1").drop("_n")


def merge_notices(notices: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices (notice_id, url, body) with one row for each address, and events (id, notice_id, person, action, title, dept) of
    them alone.

    Of equal addresses the notice with most events stays, then the one with the longest body, then the smallest id; it gets
    the longest body. Events of the others go to it, unless it (or one with a smaller id) has the same. Notices without an
    address stay as they are. Columns: notice_id, url, body, n_merged; and those of events.
    """
    counts = events.groupBy("notice_id").agg(F.count(F.lit(1)).alias("_k"))
    rows = notices.join(counts, "notice_id", "left").withColumn("_url", F.coalesce(canonical_url(F.col("url")), F.concat(F.lit("id:"), "notice_id")))
    size = F.length(F.coalesce("body", F.lit("")))
    best = rows.groupBy("_url").agg(
        F.max_by("notice_id", F.struct(F.coalesce("_k", F.lit(0)), size, -F.col("notice_id"))).alias("keep"), F.max_by("body", F.struct(size, -F.col("notice_id"))).alias("body"), F.count(F.lit(1)).alias("n_merged"))
    kept = best.select(F.col("keep").alias("notice_id"), F.when(~F.col("_url").startswith("id:"), F.col("_url")).alias("url"), "body", "n_merged")
    moved = events.join(rows.join(best.select("_url", "keep"), "_url").select("notice_id", "keep"), "notice_id")
    act = ["keep", *[F.coalesce(c, F.lit("")) for c in ("person", "action", "title", "dept")]]
    first = Window.partitionBy(*act).orderBy(F.desc(F.col("notice_id") == F.col("keep")), "id")
    moved = moved.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept, moved.select(*[F.col("keep").alias(c) if c == "notice_id" else F.col(c) for c in events.columns])


def misnamed(events: DataFrame) -> DataFrame:
    """events (person, clause) where a name that can't be one is replaced by the first that the clause's patterns give."""
    clause = F.coalesce("clause", F.lit(""))
    names = F.array(*[clean_name(F.regexp_extract(clause, p, 1)) for p in (extract.AS, extract.BARE, extract.ROSTER)])
    wrong = (F.trim(F.coalesce("person", F.lit(""))) != "") & ~plausible_name(F.col("person"))
    return events.withColumn("person", F.when(wrong, F.coalesce(F.get(F.filter(names, plausible_name), F.lit(0)), F.col("person"))).otherwise(F.col("person")))


FULL_NAME = "(?:任命|聘任|免去)([一-龥·]{2,4})同志"


def full_names(events: DataFrame) -> DataFrame:
    """events (person, clause) with full: the longest name before 同志 in the clause that ends in a cut name; null for none."""
    found = F.regexp_extract_all(F.coalesce("clause", F.lit("")), F.lit(FULL_NAME), F.lit(1))
    old = F.trim("person")
    longer = F.filter(found, lambda n: n.endswith(old) & (F.length(n) > F.length(old)) & plausible_name(n))
    best = F.array_max(F.transform(longer, lambda n, i: F.struct(F.length(n).alias("size"), (-i).alias("first"), n.alias("name"))))
    return events.withColumn("full", F.when(old != "", best["name"]))


def rename(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows (bureau, person) under new names; moves: bureau, person, full, each person once."""
    to = moves.select(F.col("bureau").alias("_bureau"), F.col("person").alias("_person"), "full")
    rows = rows.join(to, (F.col("bureau") == F.col("_bureau")) & (F.col("person") == F.col("_person")), "left")
    return rows.withColumn("person", F.coalesce("full", "person")).drop("_bureau", "_person", "full")


def complete_names(events: DataFrame, duties: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events with cut names completed, duties and people (bureau, person) following them; a person who is there already stays once.

    Events without the full name in their clause keep theirs, and with it their person.
    """
    rows = full_names(events)
    moves = rows.where("full IS NOT NULL").groupBy("bureau", "person").agg(F.max_by("full", "id").alias("full"))
    kept = rows.withColumn("person", F.coalesce("full", "person")).drop("full")
    left = kept.select("bureau", "person").distinct()
    stays = people.join(moves, ["bureau", "person"], "left_semi").join(left, ["bureau", "person"], "left_semi").select(*people.columns)
    return kept, rename(duties, moves), rename(people, moves).unionByName(stays).dropDuplicates(["bureau", "person"])


def remap_local(events: DataFrame, sites: DataFrame) -> DataFrame:
    """events (bureau, unit) of the head office that name a registered bureau go to that one."""
    head = sites.where("level = 'headquarters'").select(F.col("code").alias("bureau"), F.lit(True).alias("_of_head"))
    rows = units.named_bureaus(events, sites).join(F.broadcast(head), "bureau", "left")
    return rows.withColumn("bureau", F.when(F.col("_of_head"), F.coalesce("named", "bureau")).otherwise(F.col("bureau"))).drop("named", "_of_head").select(*events.columns)


def unregistered(tables: dict[str, tuple[DataFrame, str]], sites: DataFrame) -> DataFrame:
    """Codes that tables (name: table and its column of codes) have and the registry lacks: source, code, n."""
    out = None
    for name, (rows, column) in tables.items():
        part = rows.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sites.select("code")), "code", "left_anti").select(F.lit(name).alias("source"), "code", "n")
        out = part if out is None else out.unionByName(part)
    return out


def purge(tables: dict[str, tuple[DataFrame, str]], codes: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of junk codes (code), a fixed list of a few."""
    return {name: rows.join(F.broadcast(codes.select(F.col("code").alias(column))), column, "left_anti").select(*rows.columns) for name, (rows, column) in tables.items()}


def sourced_people(people: DataFrame, events: DataFrame, duties: DataFrame) -> DataFrame:
    """People (bureau, person) who have an event or a duty."""
    known = events.select("bureau", "person").union(duties.select("bureau", "person")).distinct()
    return people.join(known, ["bureau", "person"], "left_semi")


def clean_names(rows: DataFrame) -> DataFrame:
    """rows (person) without white space in names; those without a name go."""
    return rows.withColumn("person", compact(F.col("person"))).where("person <> ''")


def identities(people: DataFrame) -> DataFrame:
    """People (bureau, person, identity_id) with an identity each: the one they have, else their own key. Namesakes in other
    bureaus are not merged; whoever shares an identity got it from someone who knew."""
    return people.withColumn("identity_id", F.coalesce(F.nullif(F.trim("identity_id"), F.lit("")), person_id(F.col("bureau"), F.col("person"))))


def appearances(people: DataFrame) -> DataFrame:
    """Each person with the others of their identity: bureau, person, other_bureau, other_person."""
    other = people.select("identity_id", F.col("bureau").alias("other_bureau"), F.col("person").alias("other_person"))
    same = (F.col("bureau") == F.col("other_bureau")) & (F.col("person") == F.col("other_person"))
    return people.join(other, "identity_id").where(~same).select("identity_id", "bureau", "person", "other_bureau", "other_person")


def richest_duties(duties: DataFrame) -> DataFrame:
    """One duty a leader: most departments, then with a summary, then the longest title, then the newest."""
    rich = F.struct(F.greatest(F.coalesce(F.size("departments"), F.lit(0)), F.lit(0)), F.coalesce("duty_summary", F.lit("")) != "", F.length(F.coalesce("title", F.lit(""))), "id")
    rest = [c for c in duties.columns if c not in ("bureau", "person")]
    return duties.groupBy("bureau", "person").agg(F.max_by(F.struct(*rest), rich).alias("x")).select("bureau", "person", "x.*")


def clean(events: DataFrame, duties: DataFrame, people: DataFrame, sites: DataFrame, junk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, duties and people cleaned in order: junk codes purged, local events remapped, names repaired and completed, people
    without a source dropped, identities given."""
    kept = purge({"events": (events, "bureau"), "duties": (duties, "bureau"), "people": (people, "bureau")}, junk)
    events = misnamed(clean_names(remap_local(kept["events"], sites)))
    events, duties, people = complete_names(events, kept["duties"], kept["people"])
    return events, duties, identities(sourced_people(people, events, duties))
