"""Events read again out of stored bodies, against those stored before: what is new, what changed, what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract

KEY = ["source", "person", "action", "clause"]
FIELDS = ["unit", "dept", "title", "probation_years"]
BUREAU = r"[一-龥]{2,40}?(?:税务局|税务分局|稽查局)"


def found_events(notices: DataFrame) -> DataFrame:
    """KEY and FIELDS of the events in notices (source, text), each key once."""
    rows = extract.appointment_events(notices.select(F.col("source").alias("notice_id"), "text")).withColumnRenamed("notice_id", "source")
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*FIELDS), "n").alias("x")).select(*KEY, "x.*")


def compared(stored: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored events (id, KEY, FIELDS) of the read sources against the found ones, by key: id, KEY, the new FIELDS, and state.

    state: inserted (id null), updated, kept (nothing differs), deleted (with the stored fields: a tombstone). Events of
    sources that were not read are not compared. A null clause counts as empty.
    """
    key = lambda df: df.withColumn("clause", F.coalesce("clause", F.lit("")))
    old = key(stored).join(sources.select("source").distinct(), "source", "left_semi").select("id", *KEY, *[F.col(f).alias(f"_{f}") for f in FIELDS], F.lit(True).alias("_old"))
    rows = old.join(key(found).withColumn("_new", F.lit(True)), KEY, "full")
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    state = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(same, "kept").otherwise("updated")
    return rows.select("id", *KEY, *[F.when(F.col("_new").isNull(), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in FIELDS], state.alias("state"))


def applied(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored events after a comparison: those of sources that were not read, and what was found in the others."""
    read = rows.select("source").distinct()
    out = ["id", *KEY, *FIELDS]
    return stored.join(read, "source", "left_anti").select(*out).unionByName(rows.where("state <> 'deleted'").select(*out))


def counts(rows: DataFrame) -> DataFrame:
    """A row per source: inserted, updated, kept and deleted."""
    return rows.groupBy("source").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("inserted", "updated", "kept", "deleted")])


def with_units(events: DataFrame) -> DataFrame:
    """events (id, person, unit, clause) where a blank unit is the one that the clause names.

    That is the tax bureau of the post that the clause gives the person, else the first bureau of the head office in the clause,
    else the first local one of six letters or more.
    """
    blank = events.where(F.trim(F.coalesce("unit", F.lit(""))) == "").select("id", "person", F.coalesce("clause", F.lit("")).alias("clause"))
    patterns = [*extract.APPOINT, extract.BARE, extract.ROSTER]

    def given(trial: int, pattern: str) -> Column:
        one = lambda m, i: F.struct(F.lit(trial).alias("trial"), i.alias("at"), F.regexp_extract(m, pattern, 1).alias("name"), F.regexp_extract(m, pattern, 2).alias("post"))
        return F.transform(F.regexp_extract_all("clause", F.lit(pattern), F.lit(0)), one)

    found = F.concat(*[given(k, p) for k, p in enumerate(patterns)])
    posts = blank.select("id", F.explode(F.filter(found, lambda x: x["name"] == F.trim("person"))).alias("x")).select("id", "x.*")
    bureau = F.col("unit").rlike("税务局|稽查局")  # not a filter, which would be moved below the steps and repeat them
    named = extract.split_posts(posts, "post").groupBy("id").agg(F.min_by("unit", F.when(bureau, F.struct("trial", "at"))).alias("_post"))
    of_head = F.nullif(F.regexp_extract("clause", rf"{extract.HEAD}[^；。，,（）()\s]+?(?:税务局|税务分局|稽查局)", 0), F.lit(""))
    local = F.get(F.filter(F.regexp_extract_all("clause", F.lit(BUREAU), F.lit(0)), lambda b: (b.contains("税务局") | b.contains("稽查局")) & (b.startswith(extract.HEAD) | (F.length(b) >= 6))), 0)
    told = blank.join(named, "id", "left").select("id", F.coalesce(F.regexp_replace("_post", r"\s", ""), of_head, local).alias("_unit"))
    return events.join(told, "id", "left").withColumn("unit", F.when(F.trim(F.coalesce("unit", F.lit(""))) == "", F.coalesce("_unit", "unit")).otherwise(F.col("unit"))).drop("_unit").select(*events.columns)
