"""Merges, list heads, watches and checks: the relational core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], longest: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: new values win where they are not null, of the columns in ``longest`` the longer text; old ids stay.

    Which side a key is in is marked on the rows, since incoming rows can be without ids.
    """
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "id":
            return F.coalesce(o, n)
        if c in longest:
            return F.when(F.length(F.coalesce(n, F.lit(""))) > F.length(F.coalesce(o, F.lit(""))), n).otherwise(F.coalesce(o, n))
        return F.coalesce(n, o)

    state = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return joined.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys], state.alias("state"))


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def until(rows: DataFrame, keys: list[str], order: list[Column], stop: Column) -> DataFrame:
    """The rows of each key before the first where ``stop`` holds."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_stop", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(window)).where("_stop = 0").drop("_stop")


def match_watches(events: DataFrame, watches: DataFrame) -> DataFrame:
    """Events joined with the watches they answer: an equi-join per kind with what is left as a filter.

    watches: user, kind (bureau, person, department, post), bureau, person, dept, title.
    """
    w = watches.withColumnsRenamed({"bureau": "w_bureau", "person": "w_person", "dept": "w_dept", "title": "w_title"})
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    inside = lambda part, whole: F.coalesce(F.col(whole), F.lit("")).contains(F.col(part))
    bureau = events["bureau"] == w["w_bureau"]
    kinds = {
        "bureau": bureau,
        "person": (events["person"] == w["w_person"]) & (F.col("w_bureau").isNull() | bureau),
        "department": bureau & has("w_dept") & inside("w_dept", "dept"),
        "post": bureau & (has("w_dept") | has("w_title")) & (~has("w_dept") | inside("w_dept", "dept")) & (~has("w_title") | inside("w_title", "title")),
    }
    out = None
    for kind, on in kinds.items():
        part = events.join(w.where(F.col("kind") == kind), on).select("user", "kind", *[events[c] for c in events.columns])
        out = part if out is None else out.unionByName(part)
    return out


def since(matches: DataFrame, cursors: DataFrame) -> DataFrame:
    """The matches whose id is beyond their user's cursor; a user without one is at 0. cursors: user, last_id."""
    at = cursors.withColumnsRenamed({"user": "_user", "last_id": "_last"})
    rows = matches.join(at, F.col("user") == F.col("_user"), "left").where(F.col("id") > F.coalesce("_last", F.lit(0)))
    return rows.drop("_user", "_last")


def add_watches(watches: DataFrame, new: DataFrame) -> DataFrame:
    """Watches (user, kind, target, label) with new ones: one that is there stays once and takes the new label if there is one."""
    keys = ["user", "kind", "target"]
    new = new.groupBy(*keys).agg(F.max("label").alias("_new"))
    return watches.join(new, keys, "full").select(*keys, F.coalesce("_new", "label").alias("label"))


def remove_watches(watches: DataFrame, gone: DataFrame) -> DataFrame:
    return watches.join(gone, ["user", "kind", "target"], "left_anti")


def seed(cursors: DataFrame, watches: DataFrame, newest: int | DataFrame) -> DataFrame:
    """Cursors (user, last_id) with one for each user of watches who has none: at the greatest id so far.

    newest: that id, or the events with their id. A user's further watches leave the cursor where it is.
    """
    users = watches.select("user").distinct().join(cursors.select("user"), "user", "left_anti")
    if isinstance(newest, DataFrame):
        rows = users.withColumn("_one", F.lit(1)).join(F.broadcast(newest.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id")).withColumn("_one", F.lit(1))), "_one")  # one row
    else:
        rows = users.withColumn("last_id", F.lit(newest).cast(cursors.schema["last_id"].dataType))
    return cursors.unionByName(rows.select("user", "last_id"))


def new_heads(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each bureau's rows, newest first, above its baseline (bureau, last_day, last_id); all of a bureau without one."""
    rows = rows.join(F.broadcast(baseline), "bureau", "left")
    stop = (F.col("day") < F.col("last_day")) | (F.col("id") == F.col("last_id"))
    return until(rows, ["bureau"], [F.desc("day"), F.desc("id")], stop).drop("last_day", "last_id")


def unmatched(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """One row: how many rows of left have no partner."""
    return left.join(right, on, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")


def flagged(rows: DataFrame, rules: dict[str, tuple[Column, str]], key: Column) -> DataFrame:
    """A row per rule that holds: kind, severity, target."""
    found = F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for kind, (cond, severity) in rules.items()])
    return rows.select(key.alias("target"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("a.kind", "a.severity", "target")
