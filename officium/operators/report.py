"""The integrity report: all counters over events, duties, people and notices, with samples, reading each table once.

Rows of every table become keyed rows, and those that must meet (an event, its person and its notice; a person and its
sources) meet by their key in one grouping. Counters are sums over it; a counter's sample is at most ``SAMPLES`` ids, the smallest of each
remainder, so that no list grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.persons import plausible_name
from ..functions.urls import canonical_url, is_day
from .repair import NOISE

SAMPLES = 3
COUNTERS = (
    "events: implausible name", "events: no title or department", "events: no day", "events: bad day", "events: day out of range", "events: noise in department", "events: unregistered code", "events: no notice",
    "duties: implausible name", "duties: broken departments", "duties: nothing in charge", "duties: unregistered code", "people: no source", "people: unregistered code", "notices: no events", "notices: address again")


def integrity_report(events: DataFrame, duties: DataFrame, people: DataFrame, notices: DataFrame, sites: DataFrame, today: str) -> DataFrame:
    """counter, n and samples (array of ids) for each of COUNTERS.

    events: id, bureau, person, action, title, dept, day, notice_id; duties: id, bureau, person, departments_json, duty_summary; people: id, bureau,
    person; notices: id, url; sites: code, the registry. Ids are numbers.
    """
    registry = F.broadcast(sites.select(F.col("code").alias("bureau"), F.lit(True).alias("_registered")).distinct())
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    unknown = F.col("_registered").isNull()
    person = F.concat_ws(":", F.lit("p"), F.coalesce(F.col("bureau").cast("string"), F.lit("")), F.coalesce("person", F.lit("")))
    notice = lambda c: F.concat_ws(":", F.lit("n"), F.col(c).cast("string"))

    def keyed(rows: DataFrame, own: dict[int, Column], *keys: tuple[Column, str]) -> DataFrame:
        """For each row one keyed row with its own counters and one for each key that it is a part of."""
        flags = F.array(*[F.coalesce(own.get(i, F.lit(False)), F.lit(False)) for i in range(len(COUNTERS))])
        none = F.lit(None).cast("array<boolean>")
        parts = [F.struct(F.concat(F.lit("own:"), F.pmod(F.hash("id"), F.lit(997)).cast("string")).alias("key"), flags.alias("flags"), F.lit("own").alias("part"))]
        parts += [F.when(k.isNotNull(), F.struct(k.alias("key"), none.alias("flags"), F.lit(part).alias("part"))) for k, part in keys]
        return rows.select(F.col("id").cast("long").alias("id"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("id", "x.*")

    day, given = F.substring("day", 1, 10).try_cast("date"), text("day") != ""
    real = given & is_day(F.col("day"))
    dept = F.coalesce("dept", F.lit(""))
    of_events = keyed(events.join(registry, "bureau", "left"), {
        0: ~plausible_name(F.col("person")), 1: (text("title") == "") & (text("dept") == ""), 2: ~given, 3: given & ~real, 4: real & ((F.datediff(day, F.lit(today).cast("date")) > 365) | (F.year(day) < 1994)),
        5: (F.length(dept) > 40) | dept.rlike(NOISE), 6: unknown, 7: F.col("notice_id").isNull()}, (person, "event"), (notice("notice_id"), "event"))
    list_ = F.from_json("departments_json", "array<string>")
    of_duties = keyed(duties.join(registry, "bureau", "left"), {
        8: ~plausible_name(F.col("person")), 9: (F.coalesce("departments_json", F.lit("")) != "") & list_.isNull(), 10: (F.coalesce(F.size(list_), F.lit(0)) <= 0) & F.coalesce(F.col("duty_summary").isin("分管工作", "分管"), F.lit(False)), 11: unknown}, (person, "duty"))
    of_people = keyed(people.join(registry, "bureau", "left"), {13: unknown}, (person, "person"))
    of_notices = keyed(notices, {}, (notice("id"), "notice"), (F.concat(F.lit("u:"), F.nullif(canonical_url(F.col("url")), F.lit(""))), "address"))

    rows = of_events.unionByName(of_duties).unionByName(of_people).unionByName(of_notices)
    has = lambda part: F.count_if(F.col("part") == part)
    least = lambda part: [F.min(F.when((F.col("part") == part) & (F.pmod("id", F.lit(SAMPLES)) == r), F.col("id"))) for r in range(SAMPLES)]
    own = lambda i: F.coalesce(F.get("flags", F.lit(i)), F.lit(False))
    simple = [i for i in range(len(COUNTERS)) if i not in (12, 14, 15)]
    met = rows.groupBy("key").agg(
        *[F.count_if(own(i)).alias(f"c{i}") for i in simple], *[F.min(F.when(own(i) & (F.pmod("id", F.lit(SAMPLES)) == r), F.col("id"))).alias(f"s{i}_{r}") for i in simple for r in range(SAMPLES)],
        has("event").alias("events"), has("duty").alias("duties"), has("person").alias("people"), has("notice").alias("notices"), has("address").alias("addresses"),
        *[c.alias(f"p{r}") for r, c in enumerate(least("person"))], *[c.alias(f"n{r}") for r, c in enumerate(least("notice"))], *[c.alias(f"a{r}") for r, c in enumerate(least("address"))])
    # An event whose notice isn't there, a person without a source, a notice without events, an address's further notices.
    lost = (F.col("events") > 0) & (F.col("notices") == 0) & F.col("key").startswith("n:")
    bare = (F.col("people") > 0) & (F.col("events") + F.col("duties") == 0)
    idle = (F.col("notices") > 0) & (F.col("events") == 0)
    again = F.col("addresses") > 1
    total = {i: F.sum(f"c{i}") for i in simple} | {7: F.sum("c7") + F.sum(F.when(lost, F.col("events")).otherwise(0)), 12: F.sum(F.when(bare, F.col("people")).otherwise(0)), 14: F.sum(F.when(idle, F.col("notices")).otherwise(0)), 15: F.sum(F.when(again, F.col("addresses") - 1).otherwise(0))}
    sample = {i: [F.min(f"s{i}_{r}") for r in range(SAMPLES)] for i in simple} | {12: [F.min(F.when(bare, F.col(f"p{r}"))) for r in range(SAMPLES)], 14: [F.min(F.when(idle, F.col(f"n{r}"))) for r in range(SAMPLES)], 15: [F.min(F.when(again, F.col(f"a{r}"))) for r in range(SAMPLES)]}
    sums = met.agg(*[F.coalesce(total[i], F.lit(0)).cast("long").alias(f"n{i}") for i in total], *[F.array_sort(F.filter(F.array(*s), lambda x: x.isNotNull())).alias(f"s{i}") for i, s in sample.items()])
    lines = F.array(*[F.struct(F.lit(name).alias("counter"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("samples")) for i, name in enumerate(COUNTERS)])
    return sums.select(F.explode(lines).alias("x")).select("x.*")


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON lines, one file."""
    report.coalesce(1).write.mode("overwrite").json(path)  # sixteen rows
